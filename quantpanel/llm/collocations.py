"""Phrase collocation mining (13): counts of padded longest windows, whose ROLLUP sums give every shorter phrase.

Each place of a text leads a window of up to four words of its piece; columns led by one, two and three words make the
row, zeros pad it. Only these longest windows are counted; a ROLLUP over their columns sums the windows that share a
prefix, which is the count of that prefix as a phrase. A window ends early at a pair of words, or a word, that a first
count of words and pairs shows to be rarer than the least count: no candidate holds one, so nothing that is asked for is
lost. Tasks learn of the frequent ones by a map of bits of a fixed size (SIEVE): a bit set by another pair only makes a
window longer than it need be. Words travel as 64-bit hashes; the table of words is checked for two words of one hash, and
the count is made again with other hashes if there are any.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, _codes, _sliced, map_rows, mix, small_batches, store

#: Words in the longest phrase.
LONGEST = 4
#: 2 ** SIEVE bits tell which words and pairs may be frequent: 8 MB.
SIEVE = 26
#: Words whose counts a task gathers before it hands them on.
GATHERED = 1_000_000
#: Texts of a language that are hashed together, in bytes.
BLOB = 4 << 20
_COLUMNS = ["c1", "c2", "c3", "c4"]
_PARTS = ["p1", "p2", "p3", "p4"]
_MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A-Z become a-z, the tab and the marks that end pieces become blanks.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 or b in _MARKS else b for b in range(256))
_ENDS = np.isin(np.arange(256), np.frombuffer(_MARKS, dtype=np.uint8))


def _shuffled(seed: int) -> bytes | None:
    """Another name for each byte but the blank, so that words get other hashes; none for the first try."""
    if not seed:
        return None
    others = np.array([b for b in range(256) if b != 32])
    table = np.arange(256)
    table[others] = np.random.default_rng(seed).permutation(others)
    return bytes(table.astype(np.uint8))


def _blobs(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(lang, codes, pieces, places, plain bytes) of the words of texts of one language; a long text stays whole."""
    names = _shuffled(seed)
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            block, size = [], 0
            for text in [*texts, None]:
                if text is not None:
                    raw = text.encode()
                    block.append(raw)
                    size += len(raw)
                if block and (text is None or size > BLOB):
                    yield _blob(lang, b"\n".join(block), names)
                    block, size = [], 0


def _blob(lang: str, raw: bytes, names: bytes | None) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, bytes]:
    plain = raw.translate(_PLAIN)
    codes, places, at = [np.empty(0, dtype=U64)], [np.empty(0, dtype=np.int64)], 0
    for part in _sliced(plain.translate(names) if names else plain):
        c, p = _codes(part)
        codes.append(c)
        places.append(p + at)
        at += len(part)
    codes, places = np.concatenate(codes), np.concatenate(places)
    pieces = np.cumsum(_ENDS[np.frombuffer(raw, dtype=np.uint8)], dtype=np.int64)[places] if len(places) else places
    return lang, codes, pieces, places, plain


def _of_lang(lang: str) -> np.ndarray:
    return _codes(lang.encode().replace(b" ", b"\x01"))[0][:1] if lang else np.ones(1, dtype=U64)


def _keys(lang: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and of the pairs that begin at all but the last word, within their language."""
    words = mix(codes + _of_lang(lang))
    return words, mix(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def _counted(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """(lang, code, word, n) of words and (null, key, null, n) of pairs of words of a piece."""
    words, pairs, n = {}, [], 0

    def out() -> Iterator[pd.DataFrame]:
        if pairs:
            key, count = np.unique(np.concatenate(pairs), return_counts=True)
            yield pd.DataFrame({"lang": None, "code": key.view(np.int64), "word": None, "n": count})
        for lang, (known, codes, counts) in words.items():
            key, count = _summed(codes, counts)
            yield pd.DataFrame({"lang": lang, "code": key.view(np.int64), "word": [known[k] for k in key.tolist()], "n": count})

    for lang, codes, pieces, places, plain in _blobs(batches, seed):
        if not len(codes):
            continue
        known, seen, counts = words.setdefault(lang, ({}, [], []))
        key, first, count = np.unique(codes, return_index=True, return_counts=True)
        for k, p in zip(key.tolist(), places[first].tolist()):
            if k not in known:
                end = plain.find(b" ", p)
                known[k] = plain[p : end if end >= 0 else len(plain)].decode()
        seen.append(key)
        counts.append(count)
        pairs.append(_keys(lang, codes)[1][pieces[1:] == pieces[:-1]])
        n += len(codes)
        if n >= GATHERED:
            yield from out()
            words, pairs, n = {}, [], 0
    yield from out()


def _bits(keys: DataFrame) -> np.ndarray:
    """The map of bits of column key: at most 2 ** (SIEVE - 6) numbers come to the driver, whatever the count of keys."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - SIEVE}) & 63 as int))")
    found = keys.groupBy(F.shiftrightunsigned("key", 70 - SIEVE).alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    table = np.zeros(1 << (SIEVE - 6), dtype=np.int64)
    table[found["at"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return table


def _may(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = (keys >> U64(64 - SIEVE)).astype(np.int64)
    return (table[at >> 6] >> (at & 63) & 1).astype(bool)


def _led(lang: str, codes: np.ndarray, pieces: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """The lead-window columns: each word that may be frequent, and the next three as far as the window goes."""
    words, pairs = _keys(lang, codes)
    first = _may(words, table)
    go = np.zeros(len(codes), dtype=bool)
    go[:-1] = (pieces[1:] == pieces[:-1]) & first[:-1] & first[1:]
    at = np.flatnonzero(go)
    go[at] = _may(pairs[at], table)
    columns, reach = [codes], first
    for k in range(1, LONGEST):
        on = np.zeros(len(codes), dtype=bool)
        on[: len(codes) - k] = reach[: len(codes) - k] & go[k - 1 : len(codes) - 1]
        column = np.zeros(len(codes), dtype=U64)
        at = np.flatnonzero(on)
        column[at] = codes[at + k]
        columns.append(column)
        reach = on
    at = np.flatnonzero(first)
    return [c[at] for c in columns]


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and their counts, by a hash of the row; rows of one hash are compared."""
    key = columns[0]
    for c in columns[1:]:
        key = mix(key * U64(0x9E3779B97F4A7C15) + c)
    _, first, at, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if all((c[first][at] == c).all() for c in columns):
        return [c[first] for c in columns], count
    rows, count = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    return list(rows.T), count


def _windows(batches: Iterator[pd.DataFrame], seed: int, table: np.ndarray) -> Iterator[pd.DataFrame]:
    """(lang, c1, c2, c3, c4, n): distinct windows of some millions of words at a time."""
    held, n = {}, 0

    def out() -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            columns, count = _distinct([np.concatenate(c) for c in zip(*parts)])
            yield pd.DataFrame({"lang": lang} | {c: v.view(np.int64) for c, v in zip(_COLUMNS, columns)} | {"n": count})

    for lang, codes, pieces, _, _ in _blobs(batches, seed):
        if len(codes):
            held.setdefault(lang, []).append(_led(lang, codes, pieces, table))
            n += len(codes)
        if n >= GATHERED:
            yield from out()
            held, n = {}, 0
    yield from out()


def _pad(columns: list[F.Column]) -> list[F.Column]:
    return [c.alias(q) for c, q in zip([*columns, *[F.lit(0).cast("long")] * (LONGEST - len(columns))], ["q1", "q2", "q3", "q4"])]


def _runs(size: int) -> list[tuple[int, int]]:
    """(from, to) of the runs of 2 words or more that are shorter than a phrase of size words."""
    return [(a, a + n) for n in range(2, size) for a in range(size - n + 1)]


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """The first `top` phrases of two to four words of each language by score.

    docs: lang, text; other columns are not read. Lang null is `und`; a null or empty text has no words; repeated rows
    count again; no rows give none. Words are cut at blanks and tabs, pieces at . , ; : ! ? and line ends, A-Z become a-z.
    A candidate has a = f(phrase) >= least. Of its cuts the one with the smallest floor(2000000 * a / (l + r)) counts, and
    of equal ones the first. Candidates inside a longer one with 100 * f(longer) >= share * a go.
    Returns lang, rank, phrase, a, l, r, n, score, ranked by score, a (falling) and the phrase's UTF-8 bytes, so that no
    two phrases tie.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    seed = 0
    while True:
        counts = map_rows(texts, partial(_counted, seed=seed), "lang string, code long, word string, n long", ints=False)
        counts = counts.groupBy("lang", "code", "word").agg(F.sum("n").alias("n"))
        counts = store(counts.where((F.col("n") >= least) | F.col("word").isNotNull()), "word-counts")
        words = counts.where("word is not null")
        if words.where("code = 0").isEmpty() and words.groupBy("lang", "code").count().where("count > 1").isEmpty():
            break
        seed += 1
    frequent = words.where(F.col("n") >= least)
    keys = map_rows(frequent.select("lang", "code"), _hashed, "key long", ints=False)
    table = _bits(keys.unionByName(counts.where("word is null").select(F.col("code").alias("key"))))
    windows = map_rows(texts, partial(_windows, seed=seed, table=table), "lang string, c1 long, c2 long, c3 long, c4 long, n long", ints=False)
    sums = spark.sql(
        "SELECT lang, c1, c2, c3, c4, 4 - grouping(c2) - grouping(c3) - grouping(c4) AS size, grouping(c1) AS none, sum(n) AS f "
        "FROM {windows} GROUP BY lang, ROLLUP (c1, c2, c3, c4)",
        windows=windows,
    )
    last = F.element_at(F.array(*[F.coalesce(c, F.lit(0)) for c in _COLUMNS]), F.col("size").cast("int"))
    parts = [F.coalesce(c, F.lit(0)).alias(p) for c, p in zip(_COLUMNS, _PARTS)]
    phrases = store(sums.where((F.col("none") == 0) & (F.col("f") >= least)).where(last != 0).select("lang", F.col("size").cast("int").alias("size"), *parts, "f"), "phrases")
    return _ranked(phrases, words, frequent, top, share)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, codes in pdf.groupby("lang")["code"]:
            yield pd.DataFrame({"key": _keys(lang, codes.to_numpy(dtype=np.int64).view(U64))[0].view(np.int64)})


def _ranked(phrases: DataFrame, words: DataFrame, frequent: DataFrame, top: int, share: int) -> DataFrame:
    known = phrases.select("lang", *[F.col(p).alias(q) for p, q in zip(_PARTS, ("q1", "q2", "q3", "q4"))], "f")
    on = ["lang", "q1", "q2", "q3", "q4"]
    candidates = phrases.where("size > 1").withColumnRenamed("f", "a")

    def exploded(ways) -> F.Column:
        by = F.lit(None)
        for size in range(2, LONGEST + 1):
            some = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *_pad([F.col(p) for p in _PARTS[lo:hi]])) for k, side, lo, hi in ways(size)]
            if some:
                by = F.when(F.col("size") == size, F.array(*some)).otherwise(by)
        return F.explode(by).alias("x")

    cuts = candidates.select("lang", *_PARTS, "a", exploded(lambda n: [(k, s, *((0, k) if s == 1 else (k, n))) for k in range(1, n) for s in (1, 2)])).select("lang", *_PARTS, "a", "x.*")
    cuts = cuts.join(known, on).groupBy("lang", *_PARTS, "a", "k").agg(F.max(F.when(F.col("side") == 1, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 2, F.col("f"))).alias("r"))
    score = F.expr("cast(a as decimal(19, 0)) * cast(2000000 as decimal(7, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", *_PARTS, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", *_PARTS, "a", "b.l", "b.r", "b.score")
    inside = candidates.where("size > 2").select("lang", F.col("a").alias("f"), exploded(lambda n: [(0, 0, a, b) for a, b in _runs(n)])).select("lang", "x.*", "f")
    inside = inside.groupBy(*on).agg(F.max("f").alias("longer")).withColumnsRenamed(dict(zip(on[1:], _PARTS)))
    exact = F.expr(f"cast(longer as decimal(19, 0)) * 100 >= cast(a as decimal(19, 0)) * {int(share)}")
    left = best.join(inside, ["lang", *_PARTS], "left").where(F.col("longer").isNull() | ~exact).drop("longer")
    order = [F.desc("score"), F.desc("a")]
    near = store(left.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("at") <= top).drop("at"), "near-the-top")
    texts = near.select("lang", *_PARTS, F.posexplode(F.array(*_PARTS)).alias("pos", "code")).where("code <> 0").join(frequent.select("lang", "code", "word"), ["lang", "code"])
    texts = texts.groupBy("lang", *_PARTS).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = near.join(texts, ["lang", *_PARTS]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return out.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
