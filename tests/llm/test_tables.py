"""The registered queries against brute force on the supplied tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from tokenizers import Tokenizer

from quantpanel.llm import queries as q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def ids(docs):
    t = Tokenizer.from_file(q.vocabulary())
    return {d: brute.token_ids(x, t) for d, x in docs}


def rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_op1(spark, ids):
    start, want = 0, {}
    for d in sorted(ids):
        want[d] = (start, len(ids[d]), brute.crc(ids[d]))
        start += len(ids[d])
    assert rows(q.op1_token_output(spark, SF)) == want


def test_op2(spark, docs):
    assert rows(q.op2_ngram_join(spark, SF)) == brute.ngram_join(docs, 3, 90)


def test_op3(spark):
    vectors = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute.near_vectors(vectors, 0.9), rows(q.op3_embedding_dedup(spark, SF))
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())


@pytest.mark.parametrize("name, label, at", [("op4_toxicity", "toxic", 0.3), ("op6_quality", "quality", 0.7)])
def test_classifiers_on_held_out_rows(spark, name, label, at):
    got = rows(getattr(q, name)(spark, SF))
    held = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label).collect() if got[r[0]][0]]
    assert len(held) > 50 and all(0 <= g[1] <= 1 and g[2] == int(g[1] >= at) for g in got.values())
    assert sum((got[d][1] >= at) == bool(y) for d, y in held) >= 0.93 * len(held)


def test_op7(spark, ids):
    got = q.op7_best_fit_packing(spark, SF).collect()
    want = {(d, k): (at, len(x[at : at + 4096]), brute.crc(x[at : at + 4096])) for d, x in ids.items() for k, at in enumerate(range(0, len(x), 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in bins.values():
        spots.sort()
        assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:])) and sum(spots[-1]) <= 4096
    assert len(bins) <= 1.01 * sum(r.length for r in got) / 4096 + 1


def test_op8(spark, docs):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(q.op8_decontamination(spark, SF)) == brute.contamination(docs, items)


def test_op9(spark, docs):
    assert rows(q.op9_substring_dedup(spark, SF)) == brute.repeats(docs)


def test_op10(spark):
    import base64
    import hashlib

    pages = [(r[0], (r[1] or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    last = {}
    for p, b in pages:
        last[b] = max(p, last.get(b, p))
    want = {p: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last[b] == p else "revisit", None if last[b] == p else last[b]) for p, b in pages}
    assert rows(q.op10_warc(spark, SF)) == want
