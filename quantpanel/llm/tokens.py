"""Token-ID / binary output (1): shards of raw ids with a minimal perfect hash index and stored fingerprints.

A shard file holds, in order: MAGIC; the raw ids of its documents, end to end in ascending doc_id order; the document
table (keys, first ids); the index; a JSON footer and its length. Ids take two bytes where the vocabulary allows, else
four. The index is hash-and-displace: a key's bucket has a displacement, key and displacement give the slot, and the
slot holds the fingerprint of its key and the place of the document. A key that the shard does not hold fails the
fingerprint (32 bits) or, at worst, the comparison with the stored key. Lookup reads footer, index and one run of ids.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Remembered, held, map_rows, mix, shared_path, small_batches, store, width

MAGIC = b"TOKSHARD1\0"
END_ID = 1
#: Slots that are tried at once when an index is built.
TRIES = 100_000
_MASK = 2**64 - 1


class Encoder:
    """Ids of whole texts by the tokenizers library, as packed little-endian ids with the end id.

    Words between blanks or line ends are encoded on their own, each distinct one once for as long as it is remembered;
    that equals encoding the text whole, as this tokenizer drops white space and never merges across it. A text that
    holds a special token's opening goes to the library whole.
    """

    #: Words of a generation that are remembered: twice as many take some 150 MB.
    WORDS = 500_000

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype, self.kind = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.end = np.array([end_id], dtype=self.dtype).tobytes()
        self.model, self.memo = self.tokenizer.model, Remembered(self._word)
        self.memo.LIMIT = self.WORDS
        # words may be taken alone only where white space is dropped between pieces of a Split pattern
        pre = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.by_word = bool(pre) and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and "\\s+" in json.dumps(spec.get("normalizer")).replace("\\\\", "\\")
        self.pieces = re.compile(self._latin(pre[0]["pattern"]["Regex"])).findall if self.by_word else None
        opening = {t["content"][:2] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, opening))) if opening else None
        self.bytes = self._byte_letters()

    @staticmethod
    def _latin(pattern: str) -> str:
        """The pattern with its letters and numbers listed up to U+00FF, beyond which a word goes to the library."""
        for name, kind in ((r"\p{L}", "L"), (r"\p{N}", "N")):
            pattern = pattern.replace(name, "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind))
        return pattern

    @staticmethod
    def _byte_letters() -> list[str]:
        """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes follow from U+0100."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        return [chr(b) if b in own else chr(next(rest)) for b in range(256)]

    def _word(self, word: str) -> bytes:
        low, tokenize = word.lower(), self.model.tokenize
        if word.isascii():
            plain = word.isprintable()
        else:
            plain = max(low) <= "ÿ" and max(word) <= "ÿ" and min(low) > " "
        if not word or not plain:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        elif low.isalpha() and low.isascii():
            ids = [t.id for t in tokenize(low)]
        else:
            ids = []
            for piece in self.pieces(low):
                ids += [t.id for t in tokenize(piece if piece.isascii() else "".join(map(self.bytes.__getitem__, piece.encode())))]
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if not self.by_word or (self.special and self.special.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes() + self.end
        return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" "))) + self.end


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One for each worker process, so words are remembered across its tasks."""
    return held(("encoder", path, end_id), lambda: Encoder(path, end_id))


def crc_of(raw: bytes, dtype: np.dtype) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(raw, dtype=dtype).astype("<u4").tobytes())


# -- minimal perfect hash ---------------------------------------------------------------------------------------------


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + d.astype(U64) * U64(0x9E3779B97F4A7C15)) % U64(n)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(displacements, fingerprints, order) for distinct int64 keys: order[slot] is the key's place among keys.

    Buckets of a size, largest first, try a run of displacements all at once; those whose first fit meets no bucket of an
    earlier place keep it, the rest go on. A bucket of one names its slot.
    """
    n = len(keys)
    if not n:
        return np.empty(0, "<i4"), np.empty(0, "<u4"), np.empty(0, "<u4")
    h = mix(keys.view(U64) + U64(0x51ED270B))
    r = (n + 3) // 4
    bucket = ((h >> U64(32)) % U64(r)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=r)
    starts = np.cumsum(sizes) - sizes
    disp, taken, slot_of = np.zeros(r, "<i4"), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    first = np.full(n, r, dtype=np.int64)
    for size in range(int(sizes.max()), 1, -1):
        left = np.flatnonzero(sizes == size)
        d = np.ones(len(left), dtype=np.int64)
        while len(left):
            members = order[starts[left][:, None] + np.arange(size)]
            tries = d[:, None] + np.arange(max(1, min(4096, TRIES // (len(left) * size))))
            slots = _slots(h[members][:, None, :], tries[:, :, None], n)
            ok = ~taken[slots].any(axis=2) & (np.diff(np.sort(slots, axis=2), axis=2) > 0).all(axis=2)
            fits, pick = ok.any(axis=1), ok.argmax(axis=1)
            d = np.where(fits, tries[np.arange(len(left)), pick], tries[:, -1] + 1)
            fit = np.flatnonzero(fits)
            chosen = slots[fit, pick[fit]]
            np.minimum.at(first, chosen.ravel(), np.repeat(fit, size))
            won = (first[chosen] == fit[:, None]).all(axis=1)
            first[chosen.ravel()] = r
            at, chosen = fit[won], chosen[won]
            disp[left[at]], slot_of[members[at]] = d[at], chosen
            taken[chosen.ravel()] = True
            rest = np.ones(len(left), dtype=bool)
            rest[at] = False
            left, d = left[rest], d[rest]
    alone = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)[: len(alone)]
    disp[alone] = -free - 1
    slot_of[order[starts[alone]]] = free
    place = np.zeros(n, "<u4")
    place[slot_of] = np.arange(n)
    prints = np.zeros(n, "<u4")
    prints[slot_of] = fingerprints(keys)
    return disp, prints, place


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U64) ^ U64(0xA0761D6478BD642F)) >> U64(32)).astype("<u4")


def slots_of(keys: np.ndarray, disp: np.ndarray, n: int) -> np.ndarray:
    h = mix(keys.view(U64) + U64(0x51ED270B))
    d = disp[((h >> U64(32)) % U64(len(disp))).astype(np.int64)].astype(np.int64)
    return np.where(d < 0, -d - 1, _slots(h, d, n))


# -- shard files ------------------------------------------------------------------------------------------------------


def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes under a name of its own and renames at the end, so a task that runs again or twice leaves one whole file."""

    def __init__(self, uri: str, dtype: np.dtype):
        self.fs, self.path = open_fs(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.dtype = self.fs.open_output_stream(self.part), dtype
        self.out.write(MAGIC)
        self.keys, self.firsts, self.nulls, self.n = [], [np.zeros(1, dtype=np.int64)], [], 0

    def add(self, keys: pd.Series, raws: list[bytes]):
        """Documents of a batch: their keys (nullable) and packed ids."""
        self.out.write(b"".join(raws))
        ends = self.n + np.cumsum(np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))) // self.dtype.itemsize
        self.firsts.append(ends)
        self.n = int(ends[-1])
        self.nulls.append(keys.isna().to_numpy(dtype=bool))
        self.keys.append(keys.fillna(0).to_numpy(dtype="<i8"))

    def close(self) -> dict:
        keys, nulls, firsts = np.concatenate(self.keys), np.concatenate(self.nulls), np.concatenate(self.firsts)
        at = np.flatnonzero(~nulls)
        distinct, first = np.unique(keys[at], return_index=True)
        disp, prints, place = build_index(distinct)
        place = at[first][place].astype("<u4") if len(place) else place
        parts, meta, offset = [keys, firsts.astype("<i8"), nulls.astype(np.uint8), disp, prints, place], {}, len(MAGIC) + self.n * self.dtype.itemsize
        for name, a in zip(("keys", "firsts", "nulls", "disp", "prints", "place"), parts, strict=True):
            meta[name] = [offset, len(a), a.dtype.str]
            self.out.write(a.tobytes())
            offset += a.nbytes
        foot = json.dumps(meta | {"ids": self.dtype.str}).encode()
        self.out.write(foot + struct.pack("<q", len(foot)))
        self.out.close()
        self.fs.move(self.part, self.path)
        return {"n_docs": len(keys), "n_tokens": self.n, "first_id": int(keys[at].min()) if len(at) else None, "last_id": int(keys[at].max()) if len(at) else None}


class Shard:
    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        (n,) = struct.unpack("<q", self._read(size - 8, 8))
        meta = json.loads(self._read(size - 8 - n, n))
        self.dtype = np.dtype(meta.pop("ids"))
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        for name, (offset, count, dtype) in meta.items():
            setattr(self, name, np.frombuffer(self._read(offset, count * np.dtype(dtype).itemsize), dtype=dtype))

    def _read(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of the (first) document of each key, -1 where the shard does not hold it."""
        if not len(self.place) or not len(keys):
            return np.full(len(keys), -1, dtype=np.int64)
        slot = slots_of(keys, self.disp, len(self.place))
        place = self.place[slot].astype(np.int64)
        return np.where((self.prints[slot] == fingerprints(keys)) & (self.keys[place] == keys), place, -1)

    def ids(self, place: int, stop: int | None = None) -> bytes:
        lo, hi = int(self.firsts[place]), int(self.firsts[place + 1 if stop is None else stop])
        return self._read(len(MAGIC) + lo * self.dtype.itemsize, (hi - lo) * self.dtype.itemsize)


def _written(batches: Iterator[pd.DataFrame], root: str, vocabulary: str, end_id: int) -> Iterator[pd.DataFrame]:
    enc, out = encoder(vocabulary, end_id), None
    shard = TaskContext.get().partitionId()
    uri = f"{root}/shard-{shard:08d}.tok"
    for pdf in batches:
        if out is None and len(pdf):
            out = ShardWriter(uri, enc.dtype)
        if len(pdf):
            out.add(pdf["doc_id"], [enc.encode(t) for t in pdf["text"]])
    if out is not None:
        yield pd.DataFrame([{"shard": shard, "uri": uri, **out.close()}])


def _list_read(batches: Iterator[pd.DataFrame], chunk: int = 1 << 22) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for uri, base in zip(pdf["uri"], pdf["base"], strict=True):
            s = Shard(uri)
            n, held = len(s.keys), s.nulls == 0
            place = np.arange(n)
            place[held] = s.places(s.keys[held])  # by the index; a repeated key leads to its first document
            if (place < 0).any():
                raise ValueError(f"the index of {uri} misses keys it was built on")
            repeated = s.keys[place] == s.keys
            if not repeated.all():
                raise ValueError(f"the index of {uri} confuses keys")
            at = 0
            while at < n:
                stop = max(at + 1, int(np.searchsorted(s.firsts, s.firsts[at] + chunk, "right")) - 1)
                raw, first, w = s.ids(at, stop), int(s.firsts[at]), s.dtype.itemsize
                crc = [crc_of(raw[(int(s.firsts[k]) - first) * w : (int(s.firsts[k + 1]) - first) * w], s.dtype) for k in range(at, stop)]
                ids = pd.array(s.keys[at:stop], dtype="Int64")
                ids[~held[at:stop]] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": base + s.firsts[at:stop], "n_tokens": np.diff(s.firsts[at : stop + 1]), "ids_crc32": crc, "shard_start": s.firsts[at:stop]})
                at = stop


def write_tokens(docs: DataFrame, vocabulary: str, root: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode docs (doc_id, text) into shard files in ascending doc_id order; returns the manifest, one row a shard.

    Null and empty texts hold the end id alone. Null ids come first. Documents that repeat an id all stay, in the order
    of their texts; keyed access gives the first. Other columns are ignored; an empty table has no shards.
    Manifest: shard, uri, base (ids of all shards before), n_docs, n_tokens, first_id, last_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    root = root or shared_path(spark, "tokens")
    fs, path = open_fs(root)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    done = map_rows(rows, partial(_written, root=root, vocabulary=vocabulary, end_id=end_id), "shard long, uri string, n_docs long, n_tokens long, first_id long, last_id long")
    done = store(done, "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard, not a document
    return done.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, by way of their indexes."""
    parts = manifest.select("uri", "base", "shard").repartition(width(manifest.sparkSession), "shard")
    return map_rows(parts, _list_read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard_start long")


def _looked_up(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    out = []
    for uri in left["uri"]:
        s = Shard(uri)
        keys = right["doc_id"].to_numpy(dtype="<i8")
        for k, place in zip(keys.tolist(), s.places(keys).tolist(), strict=True):
            if place >= 0:
                raw = s.ids(place)
                out.append((k, np.frombuffer(raw, dtype=s.dtype).astype(np.int64).tolist()))
    return pd.DataFrame(out, columns=["doc_id", "ids"])


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the given doc_ids that the shards hold: each key goes to the shard whose range holds it."""
    lo, hi, n = manifest.agg(F.min("first_id"), F.max("last_id"), F.count(F.lit(1))).first()
    if lo is None:
        return keys.select("doc_id", F.lit(None).cast("array<long>").alias("ids")).limit(0)
    step = max(1, (hi - lo) // n + 1)
    cells = manifest.where("first_id is not null").select("shard", "uri", "first_id", "last_id", F.explode(F.expr(f"sequence((first_id - {lo}) div {step}, (last_id - {lo}) div {step})")).alias("cell"))
    asked = keys.select("doc_id").distinct().withColumn("cell", F.expr(f"(doc_id - {lo}) div {step}"))
    met = asked.join(cells, "cell").where("doc_id between first_id and last_id").select(F.col("shard").alias("at"), "doc_id")
    return manifest.select("shard", "uri").groupBy("shard").cogroup(met.groupBy("at")).applyInPandas(_looked_up, "doc_id long, ids array<long>")
