"""Substring dedup (9): fixed-block anchors.

A window of `window` words that starts in two places covers, in the other place, one whole block of
BLOCK = (window + 1) // 2 words aligned to its document. So the non-overlapping blocks of all documents are the
reference index, every rolling BLOCK-word run of every document probes it, and only windows that hold a hit can repeat.
The hits are extended by counting those windows alone by their full word sequence: runs of repeated windows are the
maximal exact repeats.

Hashes travel packed: one row for each task batch and bucket, with the hashes of its places as bytes, so a probe costs
about five bytes of shuffle instead of a row. A hash that occurs twice within a batch is settled there and travels
once, so a passage that fills a third of the corpus sends one entry for each batch. The buckets answer with the places
that meet something elsewhere.

Documents with equal word sequences are one class: its first document stands for all in both steps, and of a class of
two or more every window repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, codes_of, join_classes, join_ids, keyed, map_rows, own_keys, release, rolling, runs, small_batches, store, width

#: Words that a batch gathers before it is sent on.
BATCH_WORDS = 1_500_000
#: Entries that a bucket should hold at most, on average.
BUCKET_ENTRIES = 1_000_000
_SENT = "kind int, batch long, bucket int, hashes binary, places binary, blocks binary, docs binary, lengths binary, near binary"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            words = words_of(text)
            joined = b" ".join(words)
            d = xxhash.xxh3_128_intdigest(joined)
            rows.append((len(words), d >> 65, d & (2**63 - 1), hashlib.sha256(joined).hexdigest()))
        n, one, two, sha = zip(*rows, strict=True)
        yield pdf[["doc_id", "th"]].assign(n_words=n, h1=one, h2=two, sha=sha)


def _pack_places(p: np.ndarray) -> bytes:
    """Ascending places as differences, byte planes apart so that the empty ones compress away."""
    return np.diff(p, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack_places(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64))


def _ranges(raw) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i4").reshape(-1, 2) if raw is not None else np.empty((0, 2), dtype="<i4")


class _Batch:
    """Documents of one batch laid end to end; sends their hashes by bucket."""

    def __init__(self, run: int, buckets: int, blocks: bool):
        self.run, self.buckets, self.blocks, self.done = run, buckets, blocks, 0
        self.clear()

    def clear(self):
        self.docs, self.lengths, self.codes, self.masks, self.size = [], [], [], [], 0

    def add(self, doc: int, codes: np.ndarray, mask: np.ndarray | None):
        self.docs.append(doc)
        self.lengths.append(len(codes))
        self.codes.append(codes)
        self.masks.append(np.ones(len(codes), dtype=bool) if mask is None else mask)
        self.size += len(codes)

    def rows(self) -> pd.DataFrame:
        partition = TaskContext.get().partitionId() if TaskContext.get() else 0
        batch, turn = (partition << 24) + self.done, (partition + self.done) % self.buckets
        self.done += 1
        lengths = np.array(self.lengths, dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        codes = np.concatenate(self.codes)
        valid = np.concatenate(self.masks)
        within = np.arange(len(codes)) - np.repeat(starts, lengths)
        valid &= within <= np.repeat(lengths - self.run, lengths)
        places = np.flatnonzero(valid)
        out = []
        near = np.zeros(len(codes), dtype=bool)
        if len(places):
            h = rolling(codes, self.run)[places]
            block = within[places] % self.run == 0 if self.blocks else np.ones(len(places), dtype=bool)
            order = np.argsort(h, kind="stable")
            sh = h[order]
            first = np.concatenate(([True], sh[1:] != sh[:-1]))
            group = np.cumsum(first) - 1
            many = np.bincount(group)[group] > 1
            near[places[order[many]]] = True
            held = np.maximum.reduceat(block[order].astype(np.int8), np.flatnonzero(first)) > 0
            keep = order[first]
            # a hash that repeats here travels once, as a block if any of its places is one
            by_place = np.argsort(keep, kind="stable")
            keep, held = keep[by_place], held[by_place]
            h, places = h[keep], places[keep]
            bucket = ((h >> U64(32)) % U64(self.buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
            for b in range(self.buckets):
                at = order[cuts[b] : cuts[b + 1]]
                if len(at):
                    # the filter step needs few bits (a false hit only adds a window to count), the count needs all
                    hashes = h[at].astype("<u4" if self.blocks else "<u8").tobytes()
                    out.append((0, batch, b, hashes, _pack_places(places[at]), np.packbits(held[at]).tobytes(), None, None, None))
        out.append((1, batch, turn, None, None, None, np.array(self.docs, dtype="<i8").tobytes(), lengths.astype("<i4").tobytes(), runs(near).astype("<i4").tobytes()))
        self.clear()
        return pd.DataFrame(out, columns=[c.split()[0] for c in _SENT.split(", ")])


def _candidates(n: int, hits: np.ndarray, window: int, block: int) -> np.ndarray:
    """Window starts of a document of n words that have a hit (a start of a BLOCK-run) within them."""
    mask = np.zeros(n + 1, dtype=np.int64)
    for lo, hi in hits:
        mask[max(0, lo - (window - block))] += 1
        mask[hi] -= 1
    return np.cumsum(mask)[:n] > 0


def _sent(batches: Iterator[pd.DataFrame], run: int, buckets: int, window: int | None, block: int) -> Iterator[pd.DataFrame]:
    """window: None in the filter step; else only the windows that hits allow are sent."""
    batch = _Batch(run, buckets, window is None)
    for pdf in batches:
        hits = pdf["hits"] if window is not None else [None] * len(pdf)
        for doc, c, h in zip(pdf["key"], codes_of(pdf["text"]), hits, strict=True):
            if len(c) < run:
                continue
            batch.add(doc, c, None if window is None else _candidates(len(c), _ranges(h), window, block))
            if batch.size >= BATCH_WORDS:
                yield batch.rows()
    if batch.docs:
        yield batch.rows()


def _met(keys, pdf: pd.DataFrame, wide: bool) -> pd.DataFrame:
    """Of one bucket: the places whose hash another place holds (as a block), and the heads of batches as they are."""
    heads = pdf.loc[pdf["kind"] == 1, ["batch", "docs", "lengths", "near"]].assign(hits=None)
    pdf = pdf[pdf["kind"] == 0].sort_values("batch")
    if pdf.empty:
        return heads
    hashes = [np.frombuffer(x, dtype="<u8" if wide else "<u4") for x in pdf["hashes"]]
    held = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(h)).astype(bool) for x, h in zip(pdf["blocks"], hashes, strict=True)]
    index, counts = np.unique(np.concatenate([h[b] for h, b in zip(hashes, held, strict=True)]), return_counts=True)
    out = []
    if len(index):
        for batch, h, b, places in zip(pdf["batch"], hashes, held, pdf["places"], strict=True):
            at = np.minimum(np.searchsorted(index, h), len(index) - 1)
            hit = (index[at] == h) & (counts[at] > b)
            if hit.any():
                out.append((batch, None, None, None, runs_of_places(_unpack_places(places)[hit])))
    met = pd.DataFrame(out, columns=list(heads.columns))
    return met if heads.empty else pd.concat([met, heads]) if out else heads


def runs_of_places(p: np.ndarray) -> bytes:
    cut = np.flatnonzero(np.diff(p) != 1) + 1
    lo = p[np.concatenate(([0], cut))]
    hi = p[np.concatenate((cut - 1, [len(p) - 1]))] + 1
    return np.stack((lo, hi), axis=1).astype("<i4").tobytes()


def _by_document(keys, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one batch: for each document the runs of its places that were hit."""
    head = pdf[pdf["docs"].notna()].iloc[0]
    docs, lengths = np.frombuffer(head["docs"], dtype="<i8"), np.frombuffer(head["lengths"], dtype="<i4").astype(np.int64)
    near = np.zeros(int(lengths.sum()) + 1, dtype=np.int64)
    for raw in (head["near"], *pdf["hits"].dropna()):
        r = _ranges(raw)
        np.add.at(near, r[:, 0], 1)
        np.add.at(near, r[:, 1], -1)
    hit = np.cumsum(near)[:-1] > 0
    out, at = [], 0
    for doc, n in zip(docs.tolist(), lengths.tolist(), strict=True):
        mine = runs(hit[at : at + n])
        if len(mine):
            out.append((doc, mine.astype("<i4").tobytes()))
        at += n
    return pd.DataFrame(out, columns=["key", "hits"])


def _exchange(docs: DataFrame, run: int, buckets: int, window: int | None, block: int, tag: str) -> DataFrame:
    """(key, hits): runs of places of each document that meet an equal run of words elsewhere."""
    sent = map_rows(docs, partial(_sent, run=run, buckets=buckets, window=window, block=block), _SENT)
    met = sent.groupBy("bucket").applyInPandas(lambda key, pdf: _met(key, pdf, window is not None), "batch long, docs binary, lengths binary, near binary, hits binary")
    return store(met.groupBy("batch").applyInPandas(_by_document, "key long, hits binary"), f"{tag}-hits")


def _cut(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text, full, hits in zip(pdf["text"], pdf["full"].fillna(0), pdf["hits"], strict=True):
            words = words_of(text)
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for lo, hi in [(0, len(words))] if full == 1 else _ranges(hits):
                gone[lo] += 1
                gone[min(len(words), hi - 1 + window)] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g]) if gone.any() else b" ".join(words)
            same = text is not None and not gone.any()
            rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), text if same else kept.decode(), runs(gone).ravel().tolist()))
        n, removed, sha, kept, spans = zip(*rows, strict=True)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": n, "n_removed": removed, "kept_sha256": sha, "kept_text": kept, "removed": spans})


def _cut_rows(batches: Iterator[pa.RecordBatch], window: int, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows as they are but for the text, their column `at`."""
    for b in batches:
        pdf = b.select(["text", "full", "hits"]).to_pandas().assign(doc_id=0)
        kept = next(_cut(iter([pdf]), window))["kept_text"] if len(pdf) else []
        columns = b.column("row").flatten()
        columns[at] = pa.array([k if t is not None else None for k, t in zip(kept, pdf["text"], strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def repeated_windows(docs: DataFrame, window: int = 35) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(classes, hits, keys): (key, doc_id, n_words, sha, copies) of each row, the repeated windows of class heads, own_keys."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = _identified(docs)
    prof = store(map_rows(docs, _profiles, "doc_id long, th long, n_words long, h1 long, h2 long, sha string"), "word-profiles")
    keys = own_keys(prof, nulls=True)
    prof = keyed(prof, keys) if keys is None else store(keyed(prof, keys), "keyed-profiles")
    cls = prof.where("n_words > 0").groupBy("h1", "h2", "n_words").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    classes = join_classes(prof.select("key", "doc_id", "n_words", "h1", "h2", "sha"), cls, ["h1", "h2", "n_words"])
    classes = store(classes.select("key", "doc_id", "n_words", "sha", F.coalesce("head", "key").alias("head"), F.coalesce("copies", F.lit(1)).alias("copies")), "word-classes")
    block = (window + 1) // 2
    words = classes.where("key = head").agg(F.sum("n_words")).first()[0] or 0
    others = store(classes.where(f"key <> head or n_words < {window}").select("key").distinct(), "others")
    docs = keyed(docs, keys).select("key", "text")
    buckets = max(width(spark), words // BUCKET_ENTRIES + 1)
    anchors = _exchange(join_ids(docs, others, "key", "left_anti"), block, int(buckets), None, block, "anchors")
    release(spark)
    hits = _exchange(join_ids(docs, anchors, "key", "inner", ("hits",)), window, int(buckets), window, block, "windows")
    release(spark, anchors)
    return classes, hits, keys


def _known(classes: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """(key, full, hits) of each document that loses words; full: all of them."""
    full = F.expr(f"cast(copies > 1 and n_words >= {window} as int)")
    joined = classes.select("key", full.alias("full")).distinct().join(hits.dropDuplicates(["key"]), "key", "left")
    return store(joined.where("full = 1 or hits is not null"), "cuts")


def cut_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """The rows and columns of docs, whatever their names, with the text as remove_repeats keeps it.

    A null text stays null, a text that loses all is empty.
    """
    classes, hits, keys = repeated_windows(docs, window)
    rows = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text"), keys)
    rows = join_ids(rows, _known(classes, hits, window), "key", "left", ("hits",)).select("row", "text", "full", "hits")
    return rows.mapInArrow(partial(_cut_rows, window=window, at=docs.columns.index("text"), names=docs.columns), docs.schema)


def remove_repeats(docs: DataFrame, window: int = 35, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text, removed]) for each row of docs (doc_id, text).

    Each word that a window covers whose word sequence also starts elsewhere, in the same document or another, goes;
    windows are judged on the input, by 64-bit hashes of their words. kept_sha256 is of the other words joined by one
    blank; kept_text is that, or the text itself where nothing goes; removed lists [start, end) runs of words. Null and
    wordless texts have no words and keep none; a text of fewer words than a window loses nothing. Each row counts as a
    place: rows that repeat a doc_id and its words are copies of each other, other texts of a doc_id are documents of
    their own, and so are texts whose doc_id is null. Other columns are ignored; an empty table gives no rows. With
    texts=False, documents that lose nothing or everything are not read again.
    """
    classes, hits, keys = repeated_windows(docs, window)
    known = _known(classes, hits, window)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<int>"
    read = keyed(_identified(docs), keys).select("key", "doc_id", "text")
    if texts:
        return map_rows(join_ids(read, known, "key", "left", ("hits",)).select("doc_id", "text", "full", "hits"), partial(_cut, window=window), schema)
    nothing = hashlib.sha256(b"").hexdigest()
    rows = store(join_ids(classes, store(known.select("key", "full"), "cut-keys"), "key", "left").select("doc_id", "n_words", "sha", "full"), "cut-rows")
    gone = rows.where("full = 1").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(nothing).alias("kept_sha256"))
    same = rows.where("full is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    cut = map_rows(join_ids(read, store(known.where("full = 0"), "cut-parts"), "key", "inner", ("hits",)).select("doc_id", "text", "full", "hits"), partial(_cut, window=window), schema)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(gone).unionByName(same)
