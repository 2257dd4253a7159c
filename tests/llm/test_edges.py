"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
import corpus_pipeline
from tokenizers import Tokenizer

from quantpanel.llm import decontaminate, embedding_dedup, licences, ngram_join, packing, quality, substring_dedup, tokens, toxicity, warc
from quantpanel.llm import queries as q

BIG = 2**60
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(120_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
#: A null id, ids that doubles cannot tell apart, a repeated row, a doc_id with two texts, null, empty, blank and long texts.
ROWS = [
    (None, "alone without an id " + PASSAGE), (BIG + 1, "one text of these few words here"), (BIG + 3, "another text of other words there"), (5, "repeated row " + PASSAGE), (5, "repeated row " + PASSAGE),
    (6, "first text of six"), (6, "second and different text of six"), (7, None), (8, ""), (9, " \n\t "), (10, LONG), (11, "Ünïcode 漢字 text here"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def clashing(df):
    """df with columns of names that operators use inside."""
    names = ("th", "key", "hits", "full", "row", "bin", "place", "bad_id", "bad_th", "TH_", "sequence", "label", "count")
    return df.select("doc_id", "text", *[F.lit(k).alias(n) for k, n in enumerate(names)])


def words(text):
    return brute.WHITE.findall(text or "")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(q.vocabulary())


def test_tokens(spark, tokenizer):
    manifest = tokens.write_tokens(clashing(frame(spark)), q.vocabulary())
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(manifest).collect()), key=lambda r: r[2])
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for d, t in ordered:
        ids = brute.token_ids(t, tokenizer)
        want.append((d is not None, d or 0, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert got == want
    asked = spark.createDataFrame([(d,) for d in (BIG + 1, BIG + 3, 5, 11, 12, 7, 10, -4)], "doc_id long")
    found = {r.doc_id: r.ids for r in tokens.lookup(manifest, asked).collect()}
    assert found == {d: brute.token_ids(next(t for i, t in ROWS if i == d), tokenizer) for d in (BIG + 1, BIG + 3, 5, 11, 7, 10)}
    empty = tokens.write_tokens(frame(spark, []), q.vocabulary())
    assert tokens.read_tokens(empty).collect() == [] and tokens.lookup(empty, asked).collect() == []


def test_index_is_minimal_and_perfect():
    for n in (0, 1, 2, 3, 50, 5000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
        disp, prints, place = tokens.build_index(keys)
        if n:
            slots = tokens.slots_of(keys, disp, len(keys))
            assert sorted(slots) == list(range(len(keys))) and (place[slots] == np.arange(len(keys))).all() and (prints[slots] == tokens.fingerprints(keys)).all()


def test_encoder_equals_the_library(tokenizer):
    r, enc = random.Random(3), tokens.Encoder(q.vocabulary())
    enc.memo.LIMIT = 50
    letters = "abcXYZ 0123456789.,'!?\t\n\x0b\x85\xa0\xadéßÀÿÆŒœ漢́·²¼ªº_-|<>"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(30)))
        assert enc.encode(text) == np.array(brute.token_ids(text, tokenizer), dtype=enc.dtype).tobytes(), repr(text)


def test_ngram_join(spark):
    rows = [*ROWS, (20, "a b c d e f g h i j"), (21, "A B C D E F G H I J"), (22, "a b c d e f g h i j"), (23, "a b"), (24, "a b")]
    got = ngram_join.jaccard_groups(clashing(frame(spark, rows)), 3, 90).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    for d, t in rows:
        assert len(brute.shingle_set(t, 3)) in [n for n, _ in by[d]]
    assert {d: by[d][0][1] for d in (BIG + 1, BIG + 3, 5, 7, 20, 21, 22, 23, 24)} == {BIG + 1: BIG + 1, BIG + 3: BIG + 3, 5: 5, 7: 7, 20: 20, 21: 20, 22: 20, 23: 23, 24: 23}
    assert by[None] == [(62, None)] and [c for _, c in by[6]] == [6, 6]
    assert sum(r.kept for r in got if r.doc_id in (20, 21, 22)) == 1 and all(r.kept for r in got if r.doc_id in (6, 7, 8, 9))
    twice = ngram_join.jaccard_groups(frame(spark, [(1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z"), (0, "k l m")]), 3, 90).collect()
    assert sorted((r.doc_id, r.component_id) for r in twice) == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (BIG + 1, [2.0, 0.0]), (BIG + 3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1))).collect()}
    assert got[1] == (2, 1, True) and got[10] == (2, 1, False) and got[BIG + 1] == (2, 1, False) and got[BIG + 3] == (0, BIG + 3, True) and got[None] == (0, None, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_classifiers(spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 1), (6, 3, 1), (7, None, None)], "doc_id long, toxic int, quality int")
    for f, label in ((toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")):
        got = f(clashing(frame(spark)), labels.select("doc_id", label)).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in ROWS) and all(0 <= r.score <= 1 for r in got)
        assert f(frame(spark, []), labels).collect() == []
        assert {r.score for r in f(frame(spark), labels.where("false")).collect()} <= {0.0, 1 / (1 + np.exp(30))}


def test_lexicon_against_plain_distances():
    def plain(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    r, terms = random.Random(4), ["stupid", "moronic", "worthless", "despicable", "fool"]
    lexicon = toxicity.Lexicon({(t, False): 1.0 + k for k, t in enumerate(terms)})
    for _ in range(4000):
        w = list(r.choice(terms))
        for _ in range(r.randrange(4)):
            i = r.randrange(len(w))
            w[i : i + 1] = r.choice([[], [r.choice("aeistmo")], [w[i], r.choice("aeistmo")]])
            w = w or ["x"]
        w = "".join(w)
        near = [1.0 + k for k, t in enumerate(terms) if toxicity.allowed(len(t)) and plain(t, w) <= toxicity.allowed(len(t))]
        want = (0, lexicon.words[w]) if w in terms else (2, max(near)) if near else None
        assert lexicon.match(w) == want, w


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon({("stupid", False): 2.0})
    n, found = toxicity.matches('You stupid man. He wrote: "a stupid plan" and left.', lexicon)
    assert n == 10 and [(w, quoted) for w, _, _, quoted in found] == [("stupid", False), ("stupid", True)]


def test_additive_model_against_plain_loops():
    x = np.array([[0.0, 1], [0, 2], [1, 1], [1, 2], [2, 1], [2, 2]] * 10)
    y = np.array([0.0, 0, 0, 1, 1, 1] * 10)
    model = quality.AdditiveModel().fit(x, y)
    for row in x[:6]:
        f = model.bias + sum(model.tables[j][sum(c <= row[j] for c in model.cuts[j])] for j in range(2))
        f += sum(t[sum(c <= row[a] for c in model.pair_cuts[a]), sum(c <= row[b] for c in model.pair_cuts[b])] for (a, b), t in model.pairs.items())
        assert abs(model.score(row[None])[0] - 1 / (1 + np.exp(-f))) < 1e-12
    assert ((model.score(x) > 0.5) == (y == 1)).all()
    g, h = np.array([3.0, -1, -1, 2]), np.ones(4)
    gains = [g[:k].sum() ** 2 / (k + 1) + g[k:].sum() ** 2 / (5 - k) - g.sum() ** 2 / 5 for k in (1, 2, 3)]
    assert model._split(g, h) == (max(gains), 1 + gains.index(max(gains)))


def test_licences(spark):
    mit, apache = licences.TEMPLATES["MIT text"], licences.TEMPLATES["Apache-2.0 header"]
    wrapped = lambda t, n, mark: "\n".join(mark + " ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    rows = [(1, "Copyright 2024 Some Body\n\n" + wrapped(mit, 9, "") + "\n\nzib zab"), (2, wrapped(apache, 7, "# ") + "\nimport os"), (3, "We met by the lake. Released under the MIT License. Then all went home."), (4, "Licensed under the Apache\nLicense, Version 2.0.\nzorg blah"), (5, "nothing of the kind")]
    got = {r.doc_id: r.licence for r in licences.scan_licences(clashing(frame(spark, [*ROWS, *[(r[0] + 100, r[1]) for r in rows]]))).collect()}
    assert [got[k] for k in (101, 103, 104, 105)] == ["MIT text", "MIT", "Apache-2.0", None] and got[102].startswith("Apache-2.0") and got[BIG + 1] is None and got[7] is None
    assert [r.n_units for r in licences.scan_licences(frame(spark), known=spark.createDataFrame([], "licence string, grams array<string>")).collect()] == [0] * len(ROWS)
    assert licences.scan_licences(frame(spark, [])).collect() == []


def test_packing(spark, tokenizer):
    got = packing.pack_documents(clashing(frame(spark)), q.vocabulary()).collect()
    want = sorted((str(d), k, at, len(x[at : at + 4096]), brute.crc(x[at : at + 4096])) for d, x in ((d, brute.token_ids(t, tokenizer)) for d, t in ROWS) for k, at in enumerate(range(0, len(x), 4096)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert packing.pack_documents(frame(spark, []), q.vocabulary()).collect() == []
    pieces = spark.createDataFrame([(k, 7 + k % 5, "x") for k in range(40)], "id long, length long, bin string").withColumn("place", F.lit(1))
    bins = {}
    for r in packing.pack(pieces, capacity=20, open_bins=3).collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, bins.values())) == 40 and all(sum(n for _, n in b) <= 20 for b in bins.values())


def test_bins_of_many_tasks_meet(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_PIECES", 30)
    r = random.Random(1)
    pieces = spark.createDataFrame([(k, r.randrange(1, 60)) for k in range(1000)], "id long, length long")
    bins = {}
    for x in packing.pack(pieces, capacity=100, open_bins=4).collect():
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for spots in bins.values():
        spots.sort()
        assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:])) and sum(spots[-1]) <= 100
    assert sum(map(len, bins.values())) == 1000


def test_contamination(spark):
    items = [("b", "Seven words are what this item has"), ("a10", PASSAGE), ("a9", " ".join(PASSAGE.split()[:13])), (None, "no item"), ("n", None), ("e", "  "), ("b", "seven WORDS are what this item has")]
    docs = [*ROWS, (30, "so seven words, are what this item has, indeed"), (31, "seven words are what this item")]
    table = spark.createDataFrame(items, "item_id string, text string").withColumn("words", F.lit(1))
    got = decontaminate.contamination(clashing(frame(spark, docs)), table).collect()
    want = brute.contamination([((d, k), t) for k, (d, t) in enumerate(docs)], [(i, t) for i, t in items if i is not None])
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted((str(d), *w) for (d, _), w in want.items())
    none = decontaminate.contamination(frame(spark, docs), table.where("false")).collect()
    assert len(none) == len(docs) and not any(r.n_hit for r in none) and {r.items_sha256 for r in none} == {hashlib.sha256(b"").hexdigest()}
    assert decontaminate.contamination(frame(spark, []), table).collect() == []


def test_substrings(spark):
    rows = [*ROWS, (40, "x " + PASSAGE + " y"), (41, PASSAGE + " " + PASSAGE), (42, " ".join(["same"] * 80))]
    want = brute.repeats([((d, k), t) for k, (d, t) in enumerate(rows)])
    for texts in (False, True):
        got = substring_dedup.remove_repeats(clashing(frame(spark, rows)), 35, texts=texts).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(d), *w) for (d, _), w in want.items())
    extra = clashing(frame(spark, rows)).withColumn("big", F.when(F.col("doc_id") > 6, F.lit(BIG + 1)))
    cut = substring_dedup.cut_repeats(extra, 35)
    assert cut.schema == extra.schema
    kept = cut.collect()
    assert len(kept) == len(rows) and {r.big for r in kept} == {None, BIG + 1}
    assert sorted((str(r.doc_id), hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest()) for r in kept) == sorted((str(d), w[2]) for (d, _), w in want.items())
    assert [r.text for r in kept if r.doc_id == 7] == [None] and [r.text for r in kept if r.doc_id == 41] == [""]
    assert substring_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_archives(spark, tmp_path):
    forged = warc.record(99, "http://forged/", b"not a record of the archive", None).decode()
    pages = [(None, "u", "x"), (BIG + 1, None, None), (BIG + 3, "u", ""), (4, "u", forged), (5, "u", "WARC/1.1\r\n" * 50), (6, "u", forged), (7, "u", "ü" * 300_000), (8, "u\r\nInjected: 1", "q"), (8, "u", "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df)).collect())
    size = len(forged.encode())
    assert got == sorted([("None", 1, "response", None), (str(BIG + 1), 0, "revisit", BIG + 3), (str(BIG + 3), 0, "response", None), ("4", size, "revisit", 6), ("6", size, "response", None), ("5", 500, "response", None), ("7", 600_000, "response", None), ("8", 1, "response", None), ("8", 1, "response", None)])
    assert warc.read_archives(warc.write_archives(df.where("false"))).collect() == []


def test_records_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 1000)
    pages = [(k, "http://a/", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" + "z" * (k * 37 % 2500)) for k in range(120)]
    done = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_archives(done).collect()) == [(p, len(h)) for p, _, h in pages]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, k, rows, folder):
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], DOCS)
    extra = docs.withColumns({"th": F.lit(1), "key": F.lit(2), "row": F.lit(3), "hits": F.lit(4), "full": F.lit(5)})
    out = corpus_pipeline.STAGES[k][1](spark, extra, folder)
    if k < 4:
        assert out.columns == extra.columns
    return out.collect()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels that make one word toxic, and a benchmark of one item."""
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(1000, 1400)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def ids(rows):
    return sorted(str(r.doc_id) for r in rows)


def test_stage_toxicity(spark, folder):
    r = random.Random(1)
    some = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(30))
    made = [(k, some() + (" vilegrunt" if k % 2 == 0 else "")) for k in range(1000, 1400)]
    got = stage(spark, 0, [*ROWS, *made, (1, "a vilegrunt here"), (None, "one more vilegrunt here"), (6, "vilegrunt six")], folder)
    assert ids(got) == sorted([*[str(d) for d, _ in ROWS], *[str(k) for k, _ in made if k % 2]])
    assert stage(spark, 0, [], folder) == []


def test_stage_near_duplicates(spark, folder):
    text = " ".join(f"n{k}" for k in range(40))
    rows = [*ROWS, (50, text), (51, text + " z"), (52, text.replace("n20", "m")), (53, text)]
    got = stage(spark, 1, rows, folder)
    linked = brute.ngram_join([(50, text), (51, text + " z"), (52, text.replace("n20", "m")), (53, text)], 5, 80)
    assert ids(got) == sorted([*[str(d) for d, _ in ROWS if d != 5], "5", *[str(d) for d, (_, c) in linked.items() if d == c]])
    assert stage(spark, 1, [], folder) == []


def test_stage_repeats(spark, folder):
    rows = [*ROWS, (60, "v " + PASSAGE)]
    want = brute.repeats([((d, k), t) for k, (d, t) in enumerate(rows)])
    got = stage(spark, 2, rows, folder)
    assert sorted((str(r.doc_id), hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest()) for r in got) == sorted((str(d), w[2]) for (d, _), w in want.items())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got) and stage(spark, 2, [], folder) == []


def test_stage_decontamination(spark, folder):
    want = brute.contamination([((d, k), t) for k, (d, t) in enumerate(ROWS)], [(1, PASSAGE)])
    assert ids(stage(spark, 3, ROWS, folder)) == sorted(str(d) for (d, _), w in want.items() if not w[4])
    assert stage(spark, 3, [], folder) == []


def test_stage_packing(spark, folder, tokenizer):
    got = stage(spark, 4, ROWS, folder)
    assert sum(r.length for r in got) == sum(len(brute.token_ids(t, tokenizer)) for _, t in ROWS) and stage(spark, 4, [], folder) == []


def test_pipeline_is_its_stages(spark, tokenizer):
    """On a supplied table: what toxicity keeps, then brute force for each later stage."""
    sf = "/root/testdata/sf0.001"
    kept = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id", "text").collect()
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(r[0], r[1]) for r in kept]
    groups = brute.ngram_join(docs, 5, 80)
    docs = [(d, t) for d, t in docs if groups[d][1] == d]
    seen, texts = {}, []
    for _, t in docs:
        w = words(t)
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    for d, t in docs:
        w = words(t)
        gone = {i for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for i in range(k, k + 35)}
        texts.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    bad = brute.contamination(texts, items)
    want = sorted((d, k, len(x[at : at + 4096]), brute.crc(x[at : at + 4096])) for d, x in ((d, brute.token_ids(t, tokenizer)) for d, t in texts if not bad[d][4]) for k, at in enumerate(range(0, len(x), 4096)))
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()) == want
