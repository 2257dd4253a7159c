"""N-gram Jaccard join (2): partitioned universe, pigeonhole on filled segments, exact check.

Sets fall into size bands in which a set can link only with sets of its own or the next band. For a band the largest
symmetric difference of linked sets is H, so a set that fills H + 1 segments or more agrees with any set that it links
with in one that it fills, and sends no empty ones; a set that fills fewer sends all. A band has so many segments that
nearly all its sets fill H + 1. So the signatures of a set depend on its size, not on how many sets there are, and sets
do not meet for what both lack.

Documents with equal sets are one class. Candidates of a signature first meet its most central class only (a star, linear
in the signatures); parity sketches drop pairs that are too far apart before any text moves. What the links found leave in different components may still link: in small signatures such classes
meet in pairs, of which parity sketches drop those too far apart within the join; in large ones (families of near copies around one text, most of which agree in the segments that nobody
changed) each class probes with an allocation of its own, which gives the crowded segments no unit and takes
one-deletion neighbourhoods of uncrowded ones instead. So no link between different classes is lost, and a family is
not expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, codes_of, components, gram_hashes, join_classes, join_counted, join_ids, keyed, map_rows, mix, own_keys, release, small_batches, store, width


#: Undecided signatures of at most so many classes meet in pairs; those of larger ones take allocated probes.
FEW = 200
#: Signatures that a task hands over at once, and that a bucket should hold on average.
OUT_ROWS, BUCKET_ROWS = 1_000_000, 2_000_000
#: Longs of a parity sketch at least.
SKETCH = 8


def shingles(codes: np.ndarray, q: int) -> np.ndarray:
    """Sorted distinct hashes of the q-word shingles; the whole sequence if there are fewer words; empty without words."""
    return np.unique(gram_hashes(codes, min(q, len(codes)))) if len(codes) else codes


def sets_of(texts, q: int) -> Iterator[np.ndarray]:
    return (shingles(c, q) for c in codes_of(texts, lower=True))


def band_bounds(percent: int, most: int) -> list[tuple[int, int]]:
    out, lo = [], 1
    while lo <= most:
        hi = lo * 100 // percent
        out.append((lo, hi))
        lo = hi + 1
    return out


def difference(percent: int, hi: int) -> int:
    """Largest symmetric difference of linked sets of which the smaller has at most hi members."""
    top = hi + hi * 100 // percent
    return max(s - 2 * -(-percent * s // (100 + percent)) for s in range(max(2, top - 64), top + 1))


def band_plan(lo: int, h: int) -> tuple[int, int]:
    """(segments, h) of a band whose sets have lo members at least: the fewest of which a set of lo fills h + 1, less two deviations."""
    m = h + 1
    while True:
        empty, both = m * (1 - 1 / m) ** lo, m * (m - 1) * max(0.0, 1 - 2 / m) ** lo
        if m - empty - 2 * math.sqrt(max(0.0, empty + both - empty**2)) >= h + 1:
            return m, h
        m += 1 + m // 500


def _profiles(batches: Iterator[pd.DataFrame], q: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for s in sets_of(pdf["text"], q):
            one, two = mix(s), mix(s ^ U64(0x5851F42D4C957F2D))
            rows.append((len(s), one.sum(dtype=U64), two.sum(dtype=U64)))
        n, one, two = zip(*rows, strict=True)
        yield pdf[["doc_id", "th"]].assign(n_shingles=n, h1=np.array(one, dtype=U64).view(np.int64), h2=np.array(two, dtype=U64).view(np.int64))


def signatures(s: np.ndarray, band: int, plan: tuple[int, int]) -> np.ndarray:
    m, h = plan
    salt = U64((band * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    x = mix(s + salt)
    seg = ((x >> U64(11)) % U64(m)).astype(np.int64)
    acc = np.zeros(m, dtype=U64)
    np.add.at(acc, seg, x)
    out = mix(acc ^ (np.arange(m, dtype=U64) * U64(0xD6E8FEB86659FD93) + salt))
    filled = np.bincount(seg, minlength=m) > 0
    return out[filled] if filled.sum() > h else out


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of whole numbers, each place of a byte on its own, so that the empty ones compress away."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


_LOW = U64((1 << 48) - 1)
_SENT = "bucket int, kind int, sigs binary, docs binary, names binary"


def _batch(sigs: list, sizes: list, docs: list, buckets: int, turn: int) -> pd.DataFrame:
    """Rows of a batch by bucket. A signature that several of its documents share is settled here: it travels once, and
    its documents go to a bucket that depends on the batch, whatever the signature."""
    s, d = np.concatenate(sigs), np.repeat(np.arange(len(docs)), sizes)
    key = ((s >> U64(48)) % U64(buckets)) << U64(48) | (s & _LOW)
    order = np.argsort(key, kind="stable")
    key, d = key[order], d[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    many = ~first
    many[:-1] |= ~first[1:]
    names, out = np.array(docs, dtype="<i8"), []
    if many.any():
        used, at = np.unique(d[many], return_inverse=True)
        out.append((turn % buckets, 1, _planes(key[many], 8), _planes(at, 4), names[used].tobytes()))
    key, d = key[first], d[first]
    cuts = np.searchsorted(key >> U64(48), np.arange(buckets + 1).astype(U64))
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        mine = slice(cuts[bucket], cuts[bucket + 1])
        used, at = np.unique(d[mine], return_inverse=True)
        out.append((bucket, 0, _planes(np.diff(key[mine] & _LOW, prepend=U64(0)), 6), _planes(at, 4), names[used].tobytes()))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _SENT.split(", ")])


def _signed(batches: Iterator[pd.DataFrame], q: int, bounds: list, plans: list, buckets: int) -> Iterator[pd.DataFrame]:
    los, turn = np.array([lo for lo, _ in bounds]), TaskContext.get().partitionId() if TaskContext.get() else 0
    docs, sigs, sizes, size = [], [], [], 0
    for pdf in batches:
        for doc, s in zip(pdf["key"], sets_of(pdf["text"], q), strict=True):
            if not len(s):
                continue
            band = int(np.searchsorted(los, len(s), "right")) - 1
            mine = [signatures(s, b, plans[b]) for b in (band, band - 1) if b >= 0]
            sigs += mine
            docs.append(doc)
            sizes.append(sum(map(len, mine)))
            size += sizes[-1]
            if size >= OUT_ROWS:
                yield _batch(sigs, sizes, docs, buckets, turn)
                docs, sigs, sizes, size, turn = [], [], [], 0, turn + 1
    if docs:
        yield _batch(sigs, sizes, docs, buckets, turn)


def _shared(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """(sig, doc) of the signatures of one bucket that several documents have."""
    bucket, sigs, docs, done = U64(int(key[0])) << U64(48), [], [], []
    for kind, raw, at, names in zip(pdf["kind"], pdf["sigs"], pdf["docs"], pdf["names"], strict=True):
        who = np.frombuffer(names, dtype="<i8")[_numbers(at, 4).astype(np.int64)]
        if kind:
            done.append((_numbers(raw, 8), who))
        else:
            sigs.append(np.cumsum(_numbers(raw, 6), dtype=U64) | bucket)
            docs.append(who)
    if sigs:
        s, d = np.concatenate(sigs), np.concatenate(docs)
        order = np.argsort(s, kind="stable")
        s, d = s[order], d[order]
        same = np.concatenate((s[1:] == s[:-1], [False]))
        many = same.copy()
        many[1:] |= same[:-1]
        done.append((s[many], d[many]))
    s, d = (np.concatenate(x) for x in zip(*done, strict=True))
    return pd.DataFrame({"sig": s.view(np.int64), "doc": d})


def _verified(batches: Iterator[pd.DataFrame], q: int, percent: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep, last, x = [], None, None
        texts = [t for a, ta, tb in zip(pdf["a"], pdf["ta"], pdf["tb"], strict=True) for t in ((ta, tb) if a != last else (tb,)) if ((last := a) or True)]
        sets, last = sets_of(texts, q), None
        for a in pdf["a"]:
            if a != last:
                x, last = next(sets), a
            y = next(sets)
            ok = percent * max(len(x), len(y)) <= 100 * min(len(x), len(y))
            if ok:
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok = 100 * common >= percent * (len(x) + len(y) - common)
            keep.append(ok)
        yield pdf.loc[keep, ["a", "b"]]


def _segments(s: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(exact key of each segment, segment and hash of each member, key of its segment without it)."""
    salt = U64((band * 0x9E3779B97F4A7C15 + 0x7654321) & (2**64 - 1))
    x = mix(s + salt)
    seg = ((x >> U64(11)) % U64(m)).astype(np.int64)
    acc = np.zeros(m, dtype=U64)
    np.add.at(acc, seg, x)
    places = np.arange(m, dtype=U64) * U64(0xD6E8FEB86659FD93) + salt
    return mix(acc ^ places), seg, x, mix((acc[seg] - x) ^ places[seg])


def _own_plans(s: np.ndarray, los: np.ndarray, plans: list) -> list[tuple[int, int]]:
    band = int(np.searchsorted(los, len(s), "right")) - 1
    return [(b, plans[b][0]) for b in (band, band - 1) if b >= 0]


def _indexed(batches: Iterator[pd.DataFrame], q: int, los: np.ndarray, plans: list) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = []
        for doc, s in zip(pdf["key"], sets_of(pdf["text"], q), strict=True):
            for b, m in _own_plans(s, los, plans):
                exact, seg, _, near = _segments(s, b, m)
                keys = np.concatenate((exact, near))
                slots = np.concatenate((np.arange(m), seg)) + (b << 24)
                parts.append((keys.view(np.int64), np.full(len(keys), doc, dtype=np.int64), slots, np.arange(len(keys)) < m))
        if parts:
            yield pd.DataFrame(dict(zip(("key", "doc", "slot", "exact"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def allocate(m: int, units: int, costs: dict[int, tuple[int, int]]) -> np.ndarray:
    """Allowance (0, 1 or 2) of each segment, units in all at least, of least cost: costs has (equal, near) meetings."""
    one, two = np.zeros(m), np.zeros(m)
    for seg, (f1, f2) in costs.items():
        one[seg], two[seg] = f1, f2
    block = two < 2 * one  # both units at once are cheaper than the first alone, twice
    first, second = np.where(block, two / 2, one), np.where(block, two / 2, two - one)
    order = np.argsort(np.concatenate((first, second)), kind="stable")
    out = np.zeros(m, dtype=np.int64)
    for k in order.tolist():
        if units <= 0:
            break
        seg = k % m
        if block[seg]:
            if not out[seg]:
                out[seg] = 2
                units -= 2
        else:
            out[seg] += 1
            units -= 1
    return out


def _probing(batches: Iterator[pd.DataFrame], q: int, los: np.ndarray, plans: list, most: list) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys, docs = [], []
        for doc, s, slots, f1, f2 in zip(pdf["key"], sets_of(pdf["text"], q), pdf["slots"], pdf["f1"], pdf["f2"], strict=True):
            costs = dict(zip(map(int, slots), zip(f1, f2, strict=True), strict=True)) if slots is not None else {}
            for b, m in _own_plans(s, los, plans):
                exact, seg, _, near = _segments(s, b, m)
                give = allocate(m, most[b] + 1, {k & 0xFFFFFF: v for k, v in costs.items() if k >> 24 == b})
                keys += [exact[give > 0], near[give[seg] == 2]]
                docs.append(np.full(len(keys[-1]) + len(keys[-2]), doc, dtype=np.int64))
        if keys:
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "doc": np.concatenate(docs)})


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the members over buckets: a power of two of them, over half the set's size and SKETCH longs at least."""
    longs = max(SKETCH, 1 << max(0, (len(s) - 1).bit_length() - 7))
    odd = np.bincount((mix(s + U64(0x632BE5AB)) % U64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketched(batches: Iterator[pd.DataFrame], q: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = list(sets_of(pdf["text"], q))
        yield pd.DataFrame({"doc": pdf["key"], "size": [len(s) for s in sets], "k": [sketch(s) for s in sets]})


def _may_link(percent: int) -> F.Column:
    """Of x and y with sizes and sketches: bits of parity that differ are members that differ, so too many are no link.

    A sketch twice as long is folded first; sets whose sketches lie farther apart in length are left to the exact check.
    """
    folded = "case when size({0}.k) = size({1}.k) * 2 then zip_with(slice({0}.k, 1, size({1}.k)), slice({0}.k, 1 + size({1}.k), size({1}.k)), (p, q) -> p ^ q) else {0}.k end"
    apart = f"aggregate(zip_with({folded.format('x', 'y')}, {folded.format('y', 'x')}, (p, q) -> bit_count(p ^ q)), 0, (t, n) -> t + n)"
    total = "(x.size + y.size)"
    bound = f"{total} - 2 * (({percent} * {total} + {99 + percent}) div {100 + percent})"
    comparable = "greatest(size(x.k), size(y.k)) <= 2 * least(size(x.k), size(y.k))"
    return F.expr(f"case when {percent} * greatest(x.size, y.size) > 100 * least(x.size, y.size) then false when {comparable} then {apart} <= {bound} else true end")


def hot_pairs(hot: DataFrame, sketches: DataFrame, texts: DataFrame, q: int, bounds: list, plans: list, percent: int) -> DataFrame:
    """Candidates (a, b) across components among the documents of large signatures: (sig, doc, c, many, n).

    Every such document is indexed with all its segments and their one-deletion neighbourhoods; each that is not of the
    largest component of its signatures probes with an allocation of H + 1 units over its segments that meets the fewest.
    """
    los, most = np.array([lo for lo, _ in bounds]), [h for _, h in plans]
    top = store(hot.groupBy("sig").agg(F.max(F.struct("many", "c")).alias("top"), F.count(F.lit(1)).alias("rows")), "tops")
    docs = join_counted(hot.drop("n"), top, "sig", "rows").groupBy("doc", "c", "many").agg(F.max(F.expr("c <> top.c")).alias("probes"))
    docs = store(docs, "hot-documents")
    mine = store(texts.join(docs.toDF("key", "c", "many", "probes"), "key"), "hot-texts")
    index = store(map_rows(mine.select("key", "text"), partial(_indexed, q=q, los=los, plans=plans), "key long, doc long, slot long, exact boolean"), "hot-index")
    met = store(index.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("f")).where("f > 0"), "hot-keys")
    costs = join_counted(index, met, "key", "f").groupBy("doc", "slot").agg(F.sum(F.when(F.col("exact"), F.col("f")).otherwise(0)).alias("f1"), F.sum("f").alias("f2"))
    costs = costs.groupBy("doc").agg(F.collect_list(F.struct("slot", "f1", "f2")).alias("l")).selectExpr("doc as key", "l.slot as slots", "l.f1 as f1", "l.f2 as f2")  # as many as a document has segments
    probing = mine.where("probes").select("key", "text").join(costs, "key", "left")
    probe = map_rows(probing, partial(_probing, q=q, los=los, plans=plans, most=most), "key long, doc long")
    known = docs.select("doc", "c", "many").join(sketches, "doc")
    x, y = probe.join(known, "doc").alias("x"), index.select("key", "doc").distinct().join(known, "doc").alias("y")
    met = x.join(y, F.expr("x.key = y.key and struct(x.many, x.c) < struct(y.many, y.c)") & _may_link(percent))
    return met.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))


def verify(pairs: DataFrame, texts: DataFrame, q: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by their exact sets."""
    rows = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return map_rows(rows.select("a", "b", "ta", "tb"), partial(_verified, q=q, percent=percent), "a long, b long")


def jaccard_groups(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, th, n_shingles, class_id, component_id, kept) for each row of docs (doc_id, text); th is xxhash64 of the text.

    kept: the rows of one document of each component, that of the smallest doc_id but where ids repeat, and all rows
    that link with nothing.

    Null and empty texts, and those of white space only, have an empty set and link with nothing: component_id = doc_id.
    A doc_id that stands for several texts is a document for each: rows get the component of their own text, named by
    its smallest doc_id. A null doc_id links with nothing and has a null component. Ties do not arise, repeated rows are
    one document. Other columns are ignored. An empty table gives no rows.
    """
    spark, q = docs.sparkSession, shingle_words
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    prof = map_rows(docs, partial(_profiles, q=q), "doc_id long, th long, n_shingles long, h1 long, h2 long")
    prof = store(prof, "profiles")
    keys = own_keys(prof)
    prof = prof if keys is None else store(keyed(prof, keys), "keyed-profiles")
    prof = keyed(prof, None) if keys is None else prof
    cls = prof.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "h1", "h2").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    ids = join_classes(prof, cls.drop("rows"), ["n_shingles", "h1", "h2"]).select("doc_id", "th", "key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("head", "key")).alias("class_key"))
    ids = store(ids, "classes")
    reps = ids.where("n_shingles > 0 and key = class_key")
    most = reps.agg(F.max("n_shingles")).first()[0]
    if most is None:
        return ids.select("doc_id", "th", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    bounds = band_bounds(percent, most)
    band = F.expr("case " + " ".join(f"when n_shingles <= {hi} then {k}" for k, (_, hi) in enumerate(bounds)) + " end")
    sets = dict(reps.groupBy(band.alias("band")).count().collect())  # one row a band: the logarithm of the largest size
    plans = [band_plan(lo, difference(percent, hi)) for lo, hi in bounds]

    others = store(ids.where("doc_id is not null and (n_shingles = 0 or key <> class_key)").select("key").distinct(), "others")
    docs = keyed(docs.where("doc_id is not null"), keys).select("key", "text")
    own = join_ids(docs, others, "key", "left_anti")
    rows = sum(n * (plans[k][0] + (plans[k - 1][0] if k else 0)) for k, n in sets.items() if k is not None)
    buckets = min(1 << 14, max(width(spark), int(rows) // BUCKET_ROWS + 1))
    sent = map_rows(own, partial(_signed, q=q, bounds=bounds, plans=plans, buckets=buckets), _SENT)
    met = sent.groupBy("bucket").applyInPandas(_shared, "sig long, doc long")
    met = store(met, "met")  # rows may repeat, which only weighs them more
    release(spark)
    wanted = store(met.select(F.col("doc").alias("key")).distinct(), "wanted")
    texts = store(join_ids(docs, wanted, "key", "left_semi").dropDuplicates(["key"]), "texts")  # rows of a key have one text

    # the star of a signature is about its most central class: the one that meets the most others in all
    counts = store(met.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "counts")
    central = store(join_counted(met, counts, "sig", "n").groupBy("doc").agg(F.sum("n").alias("weight")), "central")
    centres = met.join(central, "doc").groupBy("sig").agg(F.max(F.struct("weight", -F.col("doc"))).alias("c"), F.count(F.lit(1)).alias("n"))
    centres = store(centres.selectExpr("sig", "-c.col2 as rep", "n"), "centres")
    release(spark)
    plain, met = met, store(join_counted(met, centres, "sig", "n").select("sig", "doc", "rep"), "stars")
    release(spark, plain, counts, central, centres, wanted)
    sketches = store(map_rows(texts, partial(_sketched, q=q), "doc long, size long, k array<long>"), "sketches")
    stars = met.where("rep <> doc").select(F.least("rep", "doc").alias("a"), F.greatest("rep", "doc").alias("b")).distinct()
    near = stars.join(sketches.alias("x"), F.expr("a = x.doc")).join(sketches.alias("y"), F.expr("b = y.doc")).where(_may_link(percent)).select("a", "b")
    near = store(near, "near")
    release(spark)
    links = store(verify(near, texts, q, percent), "links")
    release(spark, near)
    comp = components(links)
    # what stands with the centre of its signature is decided; the rest may still link across components
    left = store(met.where("rep <> doc").select("sig", "doc").join(comp.toDF("doc", "c"), "doc", "left").select("sig", "doc", F.coalesce("c", "doc").alias("c")), "leaves")
    split = left.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("sig", "n")
    leaves, split = left, store(split, "split")
    left = store(join_counted(leaves, split, "sig", "n").select("sig", "doc", "c", "n"), "undecided")
    release(spark, met, leaves, split)
    if not left.isEmpty():
        few = left.where(F.col("n") <= FEW).join(sketches, "doc")
        found = few.alias("x").join(few.alias("y"), F.expr("x.sig = y.sig and x.doc < y.doc and x.c <> y.c") & _may_link(percent))
        found = found.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
        hot = left.where(F.col("n") > FEW)
        sizes = comp.groupBy("component").count().toDF("c", "many")
        hot = store(hot.join(sizes, "c", "left").select("sig", "doc", "c", F.coalesce("many", F.lit(1)).alias("many"), "n"), "hot")
        if not hot.isEmpty():
            found = found.unionAll(hot_pairs(hot, sketches, texts, q, bounds, plans, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        found = store(found.distinct(), "pairs")
        release(spark, left)
        more = store(verify(found, texts, q, percent), "more-links")
        release(spark, found)
        comp = components(links.union(more))
    release(spark, texts, sketches, others)
    out = ids.join(comp.toDF("class_key", "component"), "class_key", "left").withColumn("component", F.coalesce("component", "class_key"))
    out = out.withColumn("kept", F.coalesce(F.col("key") == F.col("component"), F.lit(True)))
    if keys is None:
        return out.select("doc_id", "th", "n_shingles", F.col("class_key").alias("class_id"), F.col("component").alias("component_id"), "kept")
    # keys that are no doc_ids give way to the smallest doc_id of their class and component
    out = store(out, "keyed-components")
    for c, name in (("class_key", "class_id"), ("component", "component_id")):
        least = out.where("doc_id is not null").groupBy(c).agg(F.min("doc_id").alias(name), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        out = join_classes(out, least.drop("rows"), [c]).withColumn(name, F.coalesce(name, "doc_id"))
    return out.select("doc_id", "th", "n_shingles", "class_id", "component_id", "kept")
