"""Conversation prefix trie (12): nodes are distinct prefixes, tallied in tables addressed by minimal perfect hashes.

A prefix is known by its depth and two 64-bit numbers, the exclusive or of hashes of its turns and their places, so that
a conversation of any length is hashed piecewise, over ranges of its turns. Prefixes are counted; runs of prefixes with
the same members make one segment of the trie, so it has at most twice as many segments as there are conversations, however
long these are. Segments of many members (see `heavy`) are few; each subtree below them goes to a shard. A shard gives its segments
slots by a minimal perfect hash of their prefix, checks every address against the prefix stored there, scatters the
segments' own counts into flat arrays, and adds them up through the array of parents' slots, deepest first. What the
subtrees add up to then goes to the heavy segments in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import U64, join_counted, map_rows, mix, store, width
from .tokens import build_index, slots_of

#: Turns that the conversation of a hundred passes to the others, at most.
HEAD = 5
#: Conversations below a segment that is no subtree of its own, at least; segments in a shard, about.
LIGHT, SHARD = 1000, 50_000
#: Heavy prefixes are at most 2 ** HEAVY_BITS, as each takes as many turns as it has members.
HEAVY_BITS = 19
#: Bytes of a run of ids that is handed on for its digest to be taken where the run before it is known.
RUN_BYTES = 1 << 20
KEY = ["depth", "a", "b"]


def running(df: DataFrame, key: str, order: list[str], sums: list[str], xors: list[str] = []) -> DataFrame:
    """df with run_<c> of each column: its sum, or exclusive or, over the key's rows up to this one in ascending order.

    Rows are dealt by ranges of key and order, so a key with many rows lies on several tasks; each goes on from what the
    earlier ones add up to. Only keys on the edge of a range, two a partition, take part in that. Keys are no nulls.
    """
    n = width(df.sparkSession)
    parts = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    schema = StructType(list(df.schema.fields))
    for c in [*sums, *xors]:
        schema = schema.add(f"run_{c}", LongType())
    schema = schema.add("part", IntegerType())
    local = store(map_rows(parts, partial(_local, key=key, sums=sums, xors=xors), schema), "running")
    ends = local.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    split = ends.select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias(key)).groupBy(key).count().where("count > 1").select(key)
    runs = [f"run_{c}" for c in [*sums, *xors]]
    ended = local.join(F.broadcast(split), key).groupBy(key, "part").agg(F.max(F.struct(*order, *runs)).alias("last"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = [(F.sum if c in sums else F.bit_xor)(f"last.run_{c}").over(before).alias(f"carry_{c}") for c in [*sums, *xors]]
    carried = store(ended.select(key, "part", *carry), "carried")
    out = local.join(F.broadcast(carried), [key, "part"], "left")
    for c in sums:
        out = out.withColumn(f"run_{c}", F.col(f"run_{c}") + F.coalesce(f"carry_{c}", F.lit(0)))
    for c in xors:
        out = out.withColumn(f"run_{c}", F.col(f"run_{c}").bitwiseXOR(F.coalesce(f"carry_{c}", F.lit(0).cast("long"))))
    return out.select(*df.columns, *runs)


def _local(batches: Iterator[pd.DataFrame], key: str, sums: list[str], xors: list[str]) -> Iterator[pd.DataFrame]:
    part, last, carry = TaskContext.get().partitionId(), None, {}
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[key].to_numpy(dtype=np.int64)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(keys)))
        new = {}
        for c in [*sums, *xors]:
            v = pdf[c].to_numpy(dtype=np.int64)
            total = np.cumsum(v) if c in sums else np.bitwise_xor.accumulate(v)
            before = np.concatenate(([0], total))[starts]
            before = before[group]
            run = total - before if c in sums else total ^ before
            if last == keys[0]:
                mine = group == 0
                run[mine] = run[mine] + carry[c] if c in sums else run[mine] ^ carry[c]
            new[c], carry[c] = run, run[-1]
        last = keys[-1]
        yield pdf.assign(**{f"run_{c}": v for c, v in new.items()}, part=part)


def rebuilt(turns: DataFrame, group: int = 100, shared: int = HEAD + 1) -> DataFrame:
    """(conv_id, depth, digest, chars): a row of depth 0 for each conversation and one for each of its rebuilt turns.

    turns: conv_id, turn, role, text; other columns are not read. Turns are in the order of turn, null first; of turns that
    tie the digests of role and text decide. A null role or text is empty, a null conv_id belongs to no conversation,
    repeated rows are turns of their own; no rows give none. Conversation c begins with the first h original turns of
    conversation c - c % group (all if fewer, none if absent) and goes on with its own after its first h; h is the
    unsigned crc32 of the decimal c, modulo `shared`. c % group has the sign of c.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    convs = store(rows.select("conv_id").distinct(), "conversations")
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest", "row")
    heads = rows.where(F.col("conv_id") % group == 0).withColumn("at", F.row_number().over(first)).where(F.col("at") < shared)
    heads = heads.groupBy("conv_id").agg(F.collect_list(F.struct("at", "digest", "chars")).alias("head")).withColumnRenamed("conv_id", "base")
    copied = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base").select("conv_id", F.explode("head").alias("x")).where(F.col("x.at") <= h)
    copied = copied.select("conv_id", F.lit(1).cast("long").alias("copied"), F.lit(0).cast("long").alias("own"), F.col("x.at").cast("long").alias("turn"), "x.digest", F.lit(0).cast("long").alias("row"), "x.chars")
    own = rows.select("conv_id", F.lit(0).cast("long").alias("copied"), F.lit(1).cast("long").alias("own"), F.col("turn").cast("long").alias("turn"), "digest", "row", "chars")
    placed = running(copied.unionByName(own), "conv_id", ["own", "turn", "digest", "row"], ["copied", "own"])
    placed = placed.where((F.col("own") == 0) | (F.col("run_own") > h))
    depth = F.when(F.col("own") == 0, F.col("run_copied")).otherwise(F.col("run_copied") + F.col("run_own") - h)
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return roots.unionByName(placed.select("conv_id", depth.cast("long").alias("depth"), "digest", "chars"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of prefix and id: the digest of a prefix that ends within the task, runs of ids of the others."""
    columns = [*KEY, "lo", "ids", "sha"]
    state = {"key": None, "lo": 0, "ids": [], "size": 0, "whole": False}

    def run() -> tuple:
        return (*state["key"], state["lo"], ",".join(state["ids"]).encode(), None)

    for pdf in batches:
        out = []
        keys = [pdf[c].to_numpy(dtype=np.int64) for c in KEY]
        ids = pdf["conv_id"].to_numpy(dtype=np.int64)
        starts = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))) if len(ids) else np.empty(0, np.int64)
        for s, e in zip(starts, np.append(starts[1:], len(ids))):
            key = tuple(int(k[s]) for k in keys)
            if key != state["key"]:
                if state["key"] is not None and state["ids"]:
                    out.append((*state["key"], state["lo"], None, hashlib.sha256(",".join(state["ids"]).encode()).hexdigest()) if state["whole"] else run())
                state |= {"whole": state["key"] is not None, "key": key, "lo": int(ids[s]), "ids": [], "size": 0}
            if not state["ids"]:
                state["lo"] = int(ids[s])
            mine = ids[s:e].astype(str).tolist()
            state["ids"] += mine
            state["size"] += sum(map(len, mine))
            if state["size"] > RUN_BYTES:
                out.append(run())
                state |= {"ids": [], "size": 0, "whole": False}
        yield pd.DataFrame(out, columns=columns)
    if state["ids"]:
        yield pd.DataFrame([run()], columns=columns)


def _joined_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of prefixes over their runs of ids, in order; only the digest's state is held."""
    last, sha = None, None
    for pdf in batches:
        out = []
        for depth, a, b, ids in zip(pdf["depth"], pdf["a"], pdf["b"], pdf["ids"]):
            if (depth, a, b) != last:
                out += [(*last, sha.hexdigest())] if last else []
                last, sha = (depth, a, b), hashlib.sha256(ids)
            else:
                sha.update(b"," + ids)
        yield pd.DataFrame(out, columns=[*KEY, "sha"])
    if last:
        yield pd.DataFrame([(*last, sha.hexdigest())], columns=[*KEY, "sha"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, sha) of ends (depth, a, b, conv_id): SHA-256 of the ids that end at a prefix, ascending, with commas.

    Ids are sorted and written out by ranges; one task then reads the runs of one prefix, as a digest can't be taken in parts.
    """
    n = width(ends.sparkSession)
    parts = ends.select(*KEY, "conv_id").repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    found = store(map_rows(parts, _digests, "depth long, a long, b long, lo long, ids binary, sha string", ints=False), "digests")
    runs = found.where("sha is null").repartition(n, *KEY).sortWithinPartitions(*KEY, "lo").select(*KEY, "ids")
    joined = map_rows(runs, _joined_digests, "depth long, a long, b long, sha string", ints=False)
    return found.where("sha is not null").select(*KEY, "sha").unionByName(joined)


class NodeTable:
    """Slots for distinct prefixes (depth, a, b) by a minimal perfect hash; an address is checked against the prefix stored there."""

    def __init__(self, depth: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.n, self.seed = len(depth), 0
        while True:
            keys = self._folded(depth, a, b)
            if len(np.unique(keys)) == self.n:
                break
            self.seed += 1  # two prefixes fold to one number: another fold parts them
        self.disp, _, place = build_index(keys)
        self.at = place.astype(np.int64)
        self.depth, self.a, self.b = depth[self.at], a[self.at], b[self.at]

    def _folded(self, depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(mix(mix(a.view(U64) + U64(self.seed)) + b.view(U64)) + depth.view(U64)).view(np.int64)

    def slots(self, depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each prefix, -1 of one that is not in the table."""
        s = slots_of(self._folded(depth, a, b), self.disp, self.n)
        return np.where((self.depth[s] == depth) & (self.a[s] == a) & (self.b[s] == b), s, -1)


def tally(pdf: pd.DataFrame) -> pd.DataFrame:
    """Segments of a shard with leaves and saved summed over their subtrees; top: the parent is in no slot of this shard."""
    own = [pdf[c].to_numpy(dtype=np.int64) for c in KEY]
    table = NodeTable(*own)
    mine = table.slots(*own)
    up = np.empty(table.n, dtype=np.int64)
    up[mine] = table.slots(*[pdf[f"p{c}"].to_numpy(dtype=np.int64) for c in KEY])
    leaves, saved = np.zeros(table.n, dtype=np.int64), np.zeros(table.n, dtype=np.int64)
    np.add.at(leaves, mine, pdf["leaves"].to_numpy(dtype=np.int64))
    np.add.at(saved, mine, pdf["saved"].to_numpy(dtype=np.int64))
    order = np.argsort(-table.depth, kind="stable")
    cuts = np.flatnonzero(np.diff(table.depth[order])) + 1
    for level in np.split(order, cuts):
        inner = level[up[level] >= 0]
        np.add.at(leaves, up[inner], leaves[inner])
        np.add.at(saved, up[inner], saved[inner])
    return pdf.assign(leaves=leaves[mine], saved=saved[mine], top=up[mine] < 0)


def _pairs(columns: list[str], prefix: str) -> list[F.Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in columns]


def prefix_nodes(seqs: DataFrame, light: int = LIGHT) -> DataFrame:
    """One row per node of the trie of seqs (conv_id, depth from 0, digest, chars; depth 0 is the root, which all have).

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves and
    saved_tokens ((n_convs - 1) * chars of each node) over the subtree, ends_sha256 (of the ids of members that end there). Equal
    conversations are members of the same nodes; no rows give no nodes.
    """
    spark = seqs.sparkSession
    lane = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "digest", "depth")).otherwise(F.lit(0).cast("long")).alias(c) for k, c in ((1, "a"), (2, "b"))]
    placed = running(seqs.select("conv_id", "depth", "chars", *lane), "conv_id", ["depth"], [], ["a", "b"])
    before = [F.col(f"run_{c}").bitwiseXOR(F.col(c)).alias(f"p{c}") for c in ("a", "b")]
    rows = store(placed.select("conv_id", "depth", "chars", *before, F.col("run_a").alias("a"), F.col("run_b").alias("b")), "prefixes")
    nodes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    nodes = store(nodes.withColumn("pdepth", F.col("depth") - 1), "nodes")
    total_rows, whole = nodes.agg(F.sum("n_convs"), F.max("n_convs")).first()
    kids = nodes.where("depth > 0").groupBy(F.col("pdepth").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"), F.max("n_convs").alias("kn"))
    nodes = nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    passing = (F.col("n_children") == 1) & (F.col("kn") == F.col("n_convs"))
    nodes = nodes.withColumn("passing", F.coalesce(passing, F.lit(False))).withColumn("w", (F.col("n_convs") - 1) * F.col("chars")).drop("kn", "chars")
    nodes = store(running(nodes, "conv_id", ["depth"], ["w"]), "nodes-in-order")
    # segments: runs of nodes of the same members, known by their smallest member and number
    pkey = F.struct(*[F.col(f"p{c}") for c in KEY]).alias("pkey")
    branches = nodes.where("not passing and n_children > 0").select(F.struct(*_pairs(KEY, "p")).alias("pkey"), F.col("conv_id").alias("parent"), F.col("n_convs").alias("parent_n"), F.col("n_children").alias("n_"))
    firsts = join_counted(nodes.where("depth > 0").select(pkey, "conv_id", "n_convs"), branches, "pkey", "n_").select("conv_id", "n_convs", "pkey", "parent", "parent_n")
    segments = nodes.groupBy("conv_id", "n_convs").agg(F.max(F.struct(*KEY, "n_children")).alias("end"), F.min(F.struct("depth", (F.col("run_w") - F.col("w")).alias("run"))).alias("start"), F.sum("w").alias("saved"), F.count(F.lit(1)).alias("m"))
    segments = segments.join(firsts, ["conv_id", "n_convs"], "left").select(
        "conv_id", "n_convs", "m", "saved", "parent", "parent_n", F.col("start.depth").alias("first"), F.col("start.run").alias("before"), *[F.col(f"end.{c}").alias(c) for c in KEY],
        *[F.coalesce(f"pkey.p{c}", F.lit(-1 if c == "depth" else 0).cast("long")).alias(f"p{c}") for c in KEY], (F.col("end.n_children") == 0).cast("long").alias("leaves"),
    )
    segments = store(segments, "segments")
    limit = max(light, (total_rows or 0) >> HEAVY_BITS)
    heavy = F.expr(f"n_convs > {limit} or n_convs = {whole or 0}")
    above = store(nodes.where(heavy).select(*KEY, F.lit(True).alias("heavy")), "heavy-nodes")  # at most 2 ** HEAVY_BITS
    cuts = rows.join(F.broadcast(above), KEY, "left").where("heavy is null").groupBy("conv_id").agg(F.min(F.struct(*KEY)).alias("cut"))
    small = segments.where(~heavy).join(cuts, "conv_id")
    shards = max(width(spark), -(-segments.count() // SHARD))
    out = ["conv_id", "n_convs", *KEY, "pdepth", "pa", "pb", "leaves", "saved"]
    schema = ", ".join(f"{c} long" for c in out) + ", shard long, top boolean"
    light_ = small.select(*out, F.pmod(F.xxhash64("cut"), F.lit(shards)).cast("long").alias("shard")).groupBy("shard").applyInPandas(tally, schema)
    light_ = store(light_, "light-segments")
    below = light_.where("top").groupBy(F.col("pdepth").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    upper = segments.where(heavy).join(below, KEY, "left").withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
    upper = upper.select(*out, F.lit(0).cast("long").alias("shard")).groupBy("shard").applyInPandas(tally, schema)
    sums = light_.unionByName(upper).select("conv_id", "n_convs", F.col("leaves").alias("n_leaves"), F.col("saved").alias("total"))
    segment = F.struct("conv_id", "n_convs").alias("segment")
    sums = store(segments.join(sums, ["conv_id", "n_convs"]).select(segment, "m", "first", "before", "parent", "n_leaves", "total"), "sums")
    ends = ends_digests(rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("k")).select("conv_id", "k.*"))
    found = join_counted(nodes.select(segment, *KEY, "conv_id", "n_convs", "n_children", "run_w", "w"), sums, "segment", "m").join(ends, KEY, "left")
    parent = F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id"))
    saved = F.col("total") - (F.col("run_w") - F.col("w") - F.col("before"))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
