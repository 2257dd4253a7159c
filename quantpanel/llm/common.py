"""Helpers that the corpus operators share: shared tables, word hashing, id sets of checked size, components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A table of at most so many bytes of values is broadcast; beyond it the same step is a shuffled join.
BROADCAST_BYTES = 16 << 20
#: Parts that the rows of one key are dealt over, so that a key with a third of all rows is no single task's work.
SALTS = 16
#: Rows of one key that a shuffled join may bring together.
HOT_ROWS = 10_000
#: Rows in an Arrow batch of whole texts, so that a batch stays in the tens of MB.
BATCH_ROWS = 1000
U64 = np.uint64
_OWN: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="spark-corpus-")
            atexit.register(shutil.rmtree, _OWN["dir"], True)
        root = f"file://{_OWN['dir']}"
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors cost no earlier stage."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and let Spark drop the shuffles of finished steps.

    Only for tables that `store` returned and whose readers are stored themselves.
    """
    root = checkpoint_root(spark).rstrip("/").split("://")[-1].lstrip("/")
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of BATCH_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, f: Callable, schema: str | StructType, ints: bool = True) -> DataFrame:
    """df through f (frames to frames) by Arrow batches; whole numbers stay whole beside nulls, as pandas' Int64 and Int32.

    A result column of whole numbers may be such a column, an int64 one, or Python ints and None.
    """
    types = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(types)
    kinds = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()} if ints else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(b.to_pandas(types_mapper=kinds.get) for b in batches):
            yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)

    return df.mapInArrow(run, types)


def join_ids(df: DataFrame, ids: DataFrame, key: str, how: str, values: tuple[str, ...] = ()) -> DataFrame:
    """Join df with a narrow stored table on key; that table is broadcast only if it is measured to be small.

    values: its columns of text or bytes, whose lengths count.
    """
    size = F.lit(16)
    for c in values:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    small = (ids.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join of rows with one row for each class, by keys that many rows may share: rows are dealt over SALTS parts.

    A null key meets nothing. classes should hold those of two rows or more only, as each is sent SALTS times.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c not in keys]), F.lit(SALTS)).cast("int")
    many = classes.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("_salt", salt).join(many, [*keys, "_salt"], how).drop("_salt")


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the one row of groups that has their key and its count: keys of more than HOT_ROWS rows are not shuffled whole."""
    hot = store(groups.where(F.col(count) > HOT_ROWS), "hot-groups")
    n = hot.count()
    if not n:
        return rows.join(groups, key)
    small = n * 128 <= BROADCAST_BYTES
    keys = F.broadcast(hot.select(key)) if small else hot.select(key).hint("merge")
    of_hot = rows.join(F.broadcast(hot), key) if small else join_classes(rows, hot, [key], "inner")
    return of_hot.unionByName(rows.join(keys, key, "left_anti").join(groups.where(F.col(count) <= HOT_ROWS), key))


def unused(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs but for the rows that bad names by doc_id, null included, and th, the xxhash64 of the text."""
    th = unused(docs, "th")
    bad = store(bad.select("doc_id", "th").distinct(), "rows-that-go")
    small = bad.count() * 16 <= BROADCAST_BYTES
    bad = bad.select(F.col("doc_id").alias(unused(docs, "bad_id")), F.col("th").alias(unused(docs, "bad_th")))
    rows = docs.withColumn(th, F.xxhash64("text"))
    met = F.col("doc_id").eqNullSafe(F.col(bad.columns[0])) & (F.col(th) == F.col(bad.columns[1]))
    return rows.join(F.broadcast(bad) if small else bad.hint("merge"), met, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def own_keys(rows: DataFrame, nulls: bool = False) -> DataFrame | None:
    """(doc_id, th, key) of the documents among rows (doc_id, th: a hash of the text) whose doc_id stands for several texts.

    With nulls, texts whose doc_id is null have keys as well. The keys are numbers above all doc_ids, or below all where
    there is no room; None if there are no such documents, so that each doc_id is its own key.
    """
    known = rows.select("doc_id", "th")
    several = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo <> hi").select("doc_id")
    several = store(several, "repeated-ids")
    least, most, empty = known.agg(F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if several.isEmpty() and not (nulls and empty):
        return None
    least, most = least or 0, most or 0
    number = F.monotonically_increasing_id()
    key = number + F.lit(most + 1) if most < 2**62 else F.lit(least - 1) - number
    found = join_ids(known, several, "doc_id", "left_semi").distinct()
    found = found.unionByName(known.where("doc_id is null").distinct()) if nulls else found
    return store(found.select("doc_id", "th", key.alias("key")), "own-keys")


def keyed(docs: DataFrame, keys: DataFrame | None) -> DataFrame:
    """docs (doc_id, th, ...) with the key of each: doc_id, or what own_keys gives."""
    if keys is None:
        return docs.withColumn("key", F.col("doc_id"))
    mine = keys.toDF("_i", "_t", "_k")
    return docs.join(mine, F.expr("doc_id <=> _i and th = _t"), "left").withColumn("key", F.coalesce("_k", "doc_id")).drop("_i", "_t", "_k")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Remembered(dict):
    """word -> what find makes of it. At most 2 * LIMIT words are held: a full generation becomes the old one, whose words come back when met."""

    LIMIT = 120_000

    def __init__(self, find: Callable):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, word):
        found = self.old.pop(word, self)
        if found is self:
            found = self.find(word)
        if len(self) >= self.LIMIT:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """What make builds, kept for the tasks of a worker process until another operator asks for something of its own."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


#: Bytes of white space become blanks and, in _LOWER, A-Z become a-z.
_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in _BLANKS)
#: A number for each place in a word and byte, 0 for the blank; words longer than PLACES go on with other factors.
PLACES = 64
_NUMBERS = np.random.default_rng(20240229).integers(0, 2**64, (PLACES, 256), dtype=U64)
_NUMBERS[:, 32] = 0
_NUMBERS = _NUMBERS.ravel()
#: Bytes of a text that are hashed at once.
SLICE = 1 << 20


def _sliced(raw: bytes) -> Iterator[bytes]:
    """raw in slices of SLICE bytes, each ending at a blank if it can; a word longer than a slice stays whole."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            end = raw.rfind(b" ", at, end) + 1
            end = end if end > at else (raw.find(b" ", at + SLICE) + 1 or len(raw))
        yield raw[at:end]
        at = end


def _codes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place in raw) of each word."""
    b = np.frombuffer(raw, dtype=np.uint8)
    word = b != 32
    before = np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    at = np.flatnonzero(word & ~before)
    if not len(at):
        return np.empty(0, dtype=U64), at
    b, starts = b[at[0] :], at - at[0]
    size = np.diff(starts, append=len(b))
    place = np.arange(len(b), dtype=np.int32) - np.repeat(starts.astype(np.int32), size)
    numbers = _NUMBERS[(place & (PLACES - 1)) << 8 | b]
    if size.max() > PLACES:
        far = np.flatnonzero(place >= PLACES)
        numbers[far] *= mix((place[far] // PLACES).astype(U64)) | U64(1)
    return mix(np.add.reduceat(numbers, starts)), at


def word_codes(text: str | bytes | None, table: bytes = _BLANKS) -> np.ndarray:
    """64-bit hashes of the words of a whole text, by tabulation; table maps bytes, all that part words to the blank."""
    if not text:
        return np.empty(0, dtype=U64)
    raw = (text.encode() if isinstance(text, str) else text).translate(table)
    return np.concatenate([_codes(x)[0] for x in _sliced(raw)])


def codes_of(texts, lower: bool = False, table: bytes | None = None) -> Iterator[np.ndarray]:
    """word_codes of each text, null or empty ones included; short texts are hashed many at once."""
    table = table or (_LOWER if lower else _BLANKS)
    block, size = [], 0
    for text in texts:
        raw = text.encode() if text else b""
        if block and size + len(raw) > SLICE:
            yield from _block(block, table)
            block, size = [], 0
        block.append(raw)
        size += len(raw) + 1
    yield from _block(block, table)


def _block(raws: list[bytes], table: bytes) -> Iterator[np.ndarray]:
    if len(raws) == 1:
        yield word_codes(raws[0], table)
    elif raws:
        codes, at = _codes(b" ".join(raws).translate(table))
        ends = np.cumsum([len(r) + 1 for r in raws])
        yield from np.split(codes, np.searchsorted(at, ends[:-1]))


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q words; codes holds at least q."""
    n = len(codes) - q + 1
    acc = np.full(n, q, dtype=U64)
    for k in range(q):
        acc *= U64(0x9E3779B97F4A7C15)
        acc += codes[k : k + n]
    return mix(acc)


def rolling(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q words by doubling, for long runs: log2(q) passes."""
    length, acc, done, out = 1, mix(codes), 0, None
    while True:
        if q & length:
            n = len(codes) - q + 1
            part = acc[done : done + n]
            out = mix(part + U64(length)) if out is None else mix(out * U64(0x9E3779B97F4A7C15) + part)
            done += length
        if 2 * length > q:
            return out
        acc = mix(acc[:-length] * U64(0x9E3779B97F4A7C15) + acc[length:])
        length *= 2


def runs(mask: np.ndarray) -> np.ndarray:
    """[start, end) rows of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def frames(batches: Iterator[pd.DataFrame], rows) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = rows(pdf)
        if len(out):
            yield out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each id in edges; component is the smallest id that links reach.

    Every round each node points to its smallest neighbour, pointers are shortened once, and the graph is contracted.
    The rounds follow the logarithm of the longest chain, each is a few joins on stored tables, and nothing is collected.
    Rows with a null or equal ends are no links; no rows give no rows.
    """
    e = store(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    label = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a").toDF("a", "b"))
        p = store(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")), "parents")
        far = store(p.join(p.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p").select("v", F.col("pp").alias("p")), "parents")
        if label is None:
            label = far.select(F.col("v").alias("id"), F.col("p").alias("component"))
        else:
            label = label.join(far.withColumnRenamed("v", "component"), "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        label = store(label, "labels")
        e = e.join(far.toDF("a", "pa"), "a").join(far.toDF("b", "pb"), "b").where("pa <> pb")
        e = store(e.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return label if label is not None else edges.select(F.col(a).cast("long").alias("id"), F.col(a).cast("long").alias("component")).limit(0)
