"""Benchmark decontamination (8): prefix-filtered set join of item windows with whole documents.

A window of an item occurs in a document only if all its shingles do, so one necessary prefix token is enough: its
rarest shingle, by counts over all documents. Documents are read twice, whatever the size
of the benchmark: once to count shingles, once to send on those that are prefix tokens of some window, with the words
around them. A hit's place in its window gives the start, bounds drop windows that do not fit, and the words are
compared exactly.

Windows, counts and prefix tokens are tables. Tasks get only a map of bits of bounded size (SIEVE) of the shingles that
the benchmark has; what passes it by chance meets nothing in the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, U64, codes_of, gram_hashes, map_rows, small_batches, store

SHINGLE = 4
#: Bits of the map of shingles: 8 MB.
SIEVE = 26
#: Shingles that a task counts before it hands them over.
COUNTED = 200_000
#: Bytes that are no word characters become blanks, A-Z becomes a-z; bytes from 0x80 on stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    return [w for w in text.encode().translate(_TABLE).decode().split(" ") if w] if text else []


def _windows(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """(item, words, size, grams) of each window of each item."""
    for pdf in batches:
        out = []
        for item, text, c in zip(pdf["item"], pdf["text"], codes_of(pdf["text"], table=_TABLE), strict=True):
            words = words_of(text)
            if words:
                size = min(window, len(words))
                q = min(SHINGLE, size)
                grams = gram_hashes(c, q).view(np.int64)
                out += [(item, " ".join(words[k : k + size]), size, grams[k : k + size - q + 1]) for k in range(len(words) - size + 1)]
        yield pd.DataFrame(out, columns=["item", "words", "size", "grams"])


def _places(grams: np.ndarray) -> np.ndarray:
    return (grams >> U64(64 - SIEVE)).astype(np.int64)


def _sieve(grams: DataFrame) -> np.ndarray:
    """Bits of the shingles in `gram`, gathered as at most 2 ** (SIEVE - 6) numbers whatever their count."""
    slot = F.shiftrightunsigned("gram", 64 - SIEVE)
    rows = grams.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - SIEVE}) & 63 as int))").alias("bit"))
    table = np.zeros(1 << (SIEVE - 6), dtype=np.int64)
    found = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    table[found["at"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return np.unpackbits(table.view(np.uint8), bitorder="little") if len(found) > 1 << 14 else table


def _passed(grams: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    at = _places(grams)
    if sieve.dtype == np.uint8:
        return np.flatnonzero(sieve[at])
    return np.flatnonzero(sieve[at >> 6] >> (at & 63) & 1)


def _counted(batches: Iterator[pd.DataFrame], sieve: np.ndarray, sizes: list[int]) -> Iterator[pd.DataFrame]:
    kept, n = [], 0
    for pdf in batches:
        for c in codes_of(pdf["text"], table=_TABLE):
            for q in sizes:
                if len(c) >= q:
                    g = gram_hashes(c, q)
                    kept.append(g[_passed(g, sieve)])
                    n += len(kept[-1])
        if n >= COUNTED:
            yield _summed(kept)
            kept, n = [], 0
    yield _summed(kept)


def _summed(parts: list[np.ndarray]) -> pd.DataFrame:
    grams, n = np.unique(np.concatenate([np.empty(0, dtype=U64), *parts]), return_counts=True)
    return pd.DataFrame({"gram": grams.view(np.int64), "n": n})


def _probed(batches: Iterator[pd.DataFrame], sieve: np.ndarray, sizes: list[int], window: int) -> Iterator[pd.DataFrame]:
    """Of each row its words and its hits: shingle, place, words before it that are sent, and the words around it."""
    for pdf in batches:
        n_words, hits = [], []
        for text, c in zip(pdf["text"], codes_of(pdf["text"], table=_TABLE), strict=True):
            mine, words = [], None
            for q in sizes:
                if len(c) >= q:
                    g = gram_hashes(c, q)
                    for p in _passed(g, sieve).tolist():
                        words = words if words is not None else words_of(text)
                        lo = max(0, p - window + q)
                        mine.append({"gram": int(g[p].view(np.int64)), "place": p, "lead": p - lo, "around": " ".join(words[lo : p + window])})
            n_words.append(len(c))
            hits.append(mine)
        yield pdf[["doc_id", "th"]].assign(n_words=n_words, hits=hits)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs (doc_id, text); th is xxhash64 of the text.

    contaminated: n_hit > 0 and share * n_hit >= n_words. Null and wordless texts have no words and no hits, null and
    wordless items no windows; with no items nothing is hit. Every row of docs is judged on its own text, also where a
    doc_id is null or repeats. item_ids are of any type and sort as strings; a null item_id is no item, items that
    repeat an item_id count once. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    items = items.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    wins = store(map_rows(items, partial(_windows, window=window), "item string, words string, size int, grams array<long>"), "windows")
    sizes = sorted(min(SHINGLE, r[0]) for r in wins.select("size").distinct().collect())  # at most `window` sizes
    sizes = sorted(set(sizes))
    one = store(wins.groupBy("words").agg(F.first("size").alias("size"), F.first("grams").alias("grams")), "distinct-windows")
    tokens = one.select("words", "size", F.posexplode("grams").alias("at", "gram"))
    counts = map_rows(docs, partial(_counted, sieve=_sieve(tokens), sizes=sizes), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)), "gram", "at")).alias("t")
    prefix = store(tokens.join(counts, "gram", "left").groupBy("words", "size").agg(rare).select("words", "size", "t.gram", "t.at"), "prefix-tokens")
    found = map_rows(docs, partial(_probed, sieve=_sieve(prefix), sizes=sizes, window=window), f"doc_id {id_type}, th long, n_words long, hits array<struct<gram: long, place: int, lead: int, around: string>>")
    found = store(found, "hits")
    hits = found.where("size(hits) > 0").select("doc_id", "th", F.explode("hits").alias("h")).select("doc_id", "th", "h.*").distinct()
    size = prefix.agg(F.sum(F.octet_length("words") + 32)).first()[0] or 0
    met = hits.join(F.broadcast(prefix) if size <= BROADCAST_BYTES else prefix.hint("merge"), "gram")
    met = met.where("lead >= at and array_join(slice(split(around, ' '), lead - at + 1, size), ' ') = words")
    met = store(met.selectExpr("doc_id", "th", "place - at as start", "size", "words").distinct(), "occurrences")
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop"))))  # at most a few for each word
    merged = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("stop")), lambda a, x: F.struct((a.hit + F.greatest(F.lit(0), x.stop - F.greatest(x.start.cast("long"), a.stop))).alias("hit"), F.greatest(a.stop, x.stop.cast("long")).alias("stop")))
    hit = met.groupBy("doc_id", "th").agg(merged["hit"].alias("n_hit"))
    owners = wins.select("words", "item").distinct()
    size = owners.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 32)).first()[0] or 0
    named = met.select("doc_id", "th", "words").distinct().join(F.broadcast(owners) if size <= BROADCAST_BYTES else owners.hint("merge"), "words")
    named = named.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item")).alias("names"))
    both = hit.toDF("_i", "_t", "n_hit").join(named.toDF("_j", "_u", "names"), F.expr("_i <=> _j and _t = _u")).drop("_j", "_u")
    both = store(both.select("_i", "_t", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "names"), 256).alias("items_sha256")), "judged")
    zero = F.lit(0).cast("long")
    out = found.select("doc_id", "th", "n_words").join(both, F.expr("doc_id <=> _i and th = _t"), "left")
    out = out.select("doc_id", "th", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 and {int(share)} * n_hit >= n_words"))
