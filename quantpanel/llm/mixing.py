"""Mixing sources to target weights (11): copies of documents by pivotal dependent rounding.

Each source has a rate, its target over its size, so each of its documents is due rate copies: whole ones, and a
fraction that becomes 0 or 1. Two documents with fractions meet, and words move from one to the other until the copies of
one are whole; which way they move is drawn so that each keeps its expected copies, and the words of both stay as many.
Documents of a source are dealt over blocks of about BLOCK by a hash of their values; a block leaves at most one document
with a fraction, and those meet in blocks of FAN, level by level, until a source has one. That last one is rounded to
the nearer whole number, so the words taken of a source miss its target by at most half of that one document, and large documents
meet first, so that it tends to be a small one.

Blocks, order and draws follow from the rows' values alone: neither partitions nor reruns change the outcome.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, U64, join_counted, mix, store, width

#: Documents of a source that meet in one task, and those with a fraction left that meet at a level of the tree.
BLOCK, FAN = 2_000, 512
#: A fraction this near to a whole number is one.
EPS = 1e-9
_ROW = "name string, doc_id long, no_id boolean, size long, no long, whole long, p double"


def _draws(pdf: pd.DataFrame, seed: int) -> np.ndarray:
    """A number in [0, 1) of each row, from its values."""
    ids = pdf["doc_id"].to_numpy(dtype=np.int64).view(U64)
    h = mix(mix(ids + U64(seed)) + pdf["size"].to_numpy(dtype=np.int64).view(U64))
    h = mix(h + pdf["no"].to_numpy(dtype=np.int64).view(U64) + pdf["no_id"].to_numpy().astype(U64) * U64(0x632BE59BD9B4E019))
    return (h >> U64(11)).astype(np.float64) / 2**53


def settle(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Rows of one source with p made 0 or 1, but for at most one; words of the rows times p stay the same in sum."""
    pdf = pdf.assign(draw=_draws(pdf, seed)).sort_values(["size", "draw", "no_id", "doc_id", "no"], ascending=[False, True, True, True, True])
    sizes, p, draws = pdf["size"].tolist(), pdf["p"].tolist(), pdf["draw"].tolist()
    open_ = -1
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = float(round(p[k]))
            continue
        if open_ < 0:
            open_ = k
            continue
        i, a, b = open_, sizes[open_], sizes[k]
        give, take = min(a * p[i], b * (1 - p[k])), min(b * p[k], a * (1 - p[i]))  # words from i to k, or back
        moved = give if draws[k] * (give + take) < take else -take
        p[i] -= moved / a
        p[k] += moved / b
        done_i, done_k = not EPS < p[i] < 1 - EPS, not EPS < p[k] < 1 - EPS
        p[i], p[k] = float(round(p[i])) if done_i else p[i], float(round(p[k])) if done_k else p[k]
        open_ = -1 if done_i and done_k else k if done_i else i
    return pdf.assign(p=p).drop(columns="draw")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sizes (name, size) with target: shares of the whole by weight, held at most * size, the excess shared again.

    Weights repeat over the names in their order. Each round is one sum over the sources; it ends when none is above.
    """
    spark = sizes.sparkSession
    order = sizes.repartitionByRange(width(spark), "name").sortWithinPartitions("name")
    local = order.withColumn("part", F.spark_partition_id()).withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("name")))
    local = store(local, "sources-in-order")
    before = local.groupBy("part").agg(F.max("at").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    number = F.coalesce("before", F.lit(0)) + F.col("at") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("long")
    known = store(local.join(F.broadcast(before.select("part", "before")), "part").select("name", "size", "n_docs", weight.alias("weight")), "weights")
    whole = known.agg(F.sum("size")).first()[0] or 0
    level = Fraction(0)
    while True:
        above = F.col("weight") * F.lit(str(level.numerator)).cast("decimal(38, 0)") > F.col("size") * F.lit(str(most * level.denominator)).cast("decimal(38, 0)")
        held, shared = known.agg(F.sum(F.when(above, F.col("size") * most).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        new = Fraction(whole - (held or 0), shared) if shared else level
        if new == level:
            break
        level = new
    target = F.when(above, F.col("size") * float(most)).otherwise(F.col("weight") * F.lit(float(level.numerator)) / F.lit(float(level.denominator)))
    return known.select("name", "n_docs", F.col("size").alias("source_size"), target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target (words of its source), copies, taken.

    docs: doc_id, text, source; other columns are not read. Words are runs of what is no blank or \\t-\\r; a null text has
    none. Sources are in code point order, null last, with weights repeating, and share the words of all documents; a target
    stops at most times its source's size. copies is a whole number of at most `most`, and taken = copies * size. Null
    doc_ids are documents, repeated rows each count; documents without words, and sources without any, take nothing.
    Empty tables give no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size")
    name = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("name")
    ids = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id")]
    rows = store(docs.select(name, *ids, size).groupBy("name", "doc_id", "no_id", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")
    targets = store(source_targets(rows.groupBy("name").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.sum("m").alias("n_docs")), weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    due = join_counted(_each(rows), targets, "name", "n_docs").where("size > 0")
    p = F.col("rate") - F.floor("rate")
    due = due.withColumn("rate", rate).select("name", "doc_id", "no_id", "size", "no", F.floor("rate").cast("long").alias("whole"), p.alias("p"), "n_docs")
    blocks = F.ceil(F.col("n_docs") / BLOCK).cast("long")
    open_ = due.withColumn("block", F.pmod(F.xxhash64("doc_id", "no_id", "size", "no"), blocks)).drop("n_docs")
    settled, level = [], 0
    while True:
        schema = f"{_ROW}, block long"
        done = store(open_.groupBy("name", "block").applyInPandas(_settling(seed + level), schema), "settled")
        rest = (F.col("p") > 0) & (F.col("p") < 1)
        last = done.where(rest).agg(F.max("block")).first()[0] or 0
        if not last:  # one block of each source, or none with a fraction: what is left is rounded to the nearer number
            settled.append(done.withColumn("p", F.round("p")))
            break
        settled.append(done.where(~rest))
        open_, level = done.where(rest).withColumn("block", F.floor(F.col("block") / FAN)), level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.select("name", "doc_id", "no_id", "size", (F.col("whole") + F.col("p").cast("long")).alias("copies"))
    out = out.unionByName(_each(rows).where("size = 0").select("name", "doc_id", "no_id", "size", F.lit(0).cast("long").alias("copies")))
    source = F.when(F.col("name") != "1", F.substring("name", 2, 2**31 - 1)).alias("source")
    out = join_counted(out, targets, "name", "n_docs")
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), source, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _settling(seed: int):
    def f(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return settle(pdf, seed)

    return f


def _each(rows: DataFrame) -> DataFrame:
    """A row for each of the m equal rows, numbered; many equal rows are dealt over tasks in runs of HOT_ROWS."""
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / HOT_ROWS))))
    if (rows.agg(F.max("m")).first()[0] or 0) > HOT_ROWS:
        runs = runs.repartition(width(rows.sparkSession), "name", "doc_id", "no_id", "size", "run")
    lo, hi = F.col("run") * HOT_ROWS, F.least((F.col("run") + 1) * HOT_ROWS, F.col("m")) - 1
    return runs.select("name", "doc_id", "no_id", "size", F.explode(F.sequence(lo, hi)).alias("no"))
