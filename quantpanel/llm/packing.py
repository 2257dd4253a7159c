"""Best-fit packing (7): bounded-space online best fit over a bitset of free spaces.

Documents are encoded once into pieces of at most CAPACITY tokens; only the rows that describe them are packed. A packer
keeps a fixed number of open bins, filed by free space, and a bitset with a bit for each free space that some open bin
has: the tightest bin for a piece is the lowest set bit at or above its length, found by a shift. When a piece fits in
no open bin and all are in use, the fullest closes. Each task packs some hundred thousand pieces; what its bins still
lack at the end goes as whole bins to further rounds, where bins that fit together are joined by the same rule: only bins
that the emptiest one fits into take part, dealt over tasks of TASK_PIECES, until one task sees them all or a round saves little.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_rows, small_batches, store
from .tokens import END_ID, crc_of, encoder

CAPACITY = 4096
OPEN_BINS = 2048
#: Pieces that one task packs.
TASK_PIECES = 400_000
#: Bins filled to this share rest; rounds end when one saves less than this share of its bins.
FULL, WORTH = 0.98, 0.01
#: Column for the place that a bin itself was given; not to be among the columns of pieces.
MOVED = "_moved_to"


class Packer:
    """place(length) -> (bin, offset, bins that it closed)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open, self.made, self.closed = 0, 0, 0, 0

    def _file(self, free: int, number: int):
        self.by_free[free].append(number)
        self.bits |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest
                self.closed += 1
            number, free = self.made, self.capacity
            self.made += 1
        if free > length:
            self._file(free - length, number)
        return number, self.capacity - free


def _pieces(batches: Iterator[pd.DataFrame], vocabulary: str, end_id: int, capacity: int) -> Iterator[pd.DataFrame]:
    enc = encoder(vocabulary, end_id)
    w = enc.dtype.itemsize
    for pdf in batches:
        out = []
        for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            raw = enc.encode(text)
            for k, at in enumerate(range(0, len(raw), capacity * w)):
                part = raw[at : at + capacity * w]
                out.append((doc, k, at // w, len(part) // w, crc_of(part, enc.dtype)))
        yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])


def _packed(batches: Iterator[pd.DataFrame], capacity: int, open_bins: int, base: int) -> Iterator[pd.DataFrame]:
    packer = Packer(capacity, open_bins)
    first = base + ((TaskContext.get().partitionId() if TaskContext.get() else 0) << 36)
    for pdf in batches:
        if not len(pdf):
            continue
        spots = [packer.place(n) for n in pdf["length"].tolist()]
        bins, offsets = zip(*spots, strict=True)
        yield pdf.assign(sequence_id=np.array(bins, dtype=np.int64) + first, offset=np.array(offsets, dtype=np.int64))


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents of at most capacity tokens whole, longer ones cut."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_rows(docs.select("doc_id", "text"), partial(_pieces, vocabulary=vocabulary, end_id=end_id, capacity=capacity), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """pieces with sequence_id and offset: in each sequence the pieces lie gapless from 0 and hold at most capacity.

    length is from 1 to capacity; rows that repeat are packed each on their own; an empty table gives no rows. Columns
    of any other names stay as they are, but sequence_id and offset must not be among them.
    """
    pieces = store(pieces, "pieces")
    n, round_ = pieces.count(), 0
    parts = max(1, -(-n // TASK_PIECES))
    spread = pieces.repartition(parts) if parts > 1 else pieces.coalesce(1)
    spot = StructType.fromDDL("sequence_id long, offset long")
    done = store(map_rows(spread, partial(_packed, capacity=capacity, open_bins=open_bins, base=0), StructType([*pieces.schema, *spot])), "packed")
    if parts == 1:
        return done
    # bins with room from different tasks meet as items; at tells the place of each first bin
    at = store(done.groupBy(F.col("sequence_id").alias("bin")).agg(F.sum("length").alias("length")).withColumns({"seq": F.col("bin"), "off": F.lit(0).cast("long")}), "bins")
    while parts > 1:
        round_ += 1
        open_, n = _may_combine(at, capacity)
        parts = -(-n // TASK_PIECES)
        if n < 2:
            break
        again = open_.repartition(parts) if parts > 1 else open_.coalesce(1)
        moved = store(map_rows(again, partial(_packed, capacity=capacity, open_bins=open_bins, base=round_ << 56), "bin long, length long, sequence_id long, offset long"), "moved")
        saved = n - moved.select("sequence_id").distinct().count()
        if saved:
            new = moved.select(F.col("bin").alias("seq"), F.col("sequence_id").alias("new_seq"), F.col("offset").alias("more"))
            at = store(at.join(new, "seq", "left").select("bin", "length", F.coalesce("new_seq", "seq").alias("seq"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off")), "bins")
        if saved < WORTH * n:
            break
    found = at.where("bin <> seq or off <> 0").select(F.col("bin").alias("sequence_id"), F.struct(F.col("seq").alias("sequence_id"), F.col("off").alias("offset")).alias(MOVED))
    done = done.join(found, "sequence_id", "left").withColumns({"sequence_id": F.coalesce(f"{MOVED}.sequence_id", "sequence_id"), "offset": F.col("offset") + F.coalesce(f"{MOVED}.offset", F.lit(0))})
    return done.select(*pieces.columns, "sequence_id", "offset")


def _may_combine(at: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(bin, length) of the bins of at (seq, length) that the emptiest other bin fits into, and their number."""
    fill = store(at.groupBy(F.col("seq").alias("bin")).agg(F.sum("length").alias("length")), "fill")
    least = fill.agg(F.min("length")).first()[0]
    open_ = fill.where(F.col("length") <= min(FULL * capacity, capacity - (least or 0)))
    return open_, open_.count()


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces of docs (doc_id, text) and their places in sequences of at most capacity tokens.

    Null and empty texts are the end id alone; a null doc_id keeps its pieces, and rows that repeat a doc_id are packed
    each on their own; other columns are ignored; an empty table gives no rows.
    """
    return pack(pieces_of(docs, vocabulary, capacity=capacity), capacity, open_bins)
