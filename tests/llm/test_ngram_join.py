"""Long sets: sketches of different lengths drop no link, and the groups agree with brute force."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute

import numpy as np

from quantpanel.llm import ngram_join


def _texts():
    """Texts of 300 to 2,400 words with copies that lack or change up to 15 % of the words, beyond both ends of a doubling."""
    rng, out = random.Random(3), []
    for n in (300, 1000, 1020, 1030, 1100, 2040, 2060, 2400):
        words = [f"w{rng.randrange(50_000)}" for _ in range(n)]
        out.append(" ".join(words))
        for share in (0.001, 0.01, 0.02, 0.04):
            out.append(" ".join("x" if rng.random() < share else w for w in words))
        for share in (0.05, 0.1, 0.15):
            out.append(" ".join(words[: int(n * (1 - share))]))
    return list(enumerate(out))


def test_long_texts_match_brute_force(spark):
    docs = [*_texts(), (900, None), (901, ""), (902, " \n "), (903, "one two")]
    got = ngram_join.jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80).collect()
    want = brute.ngram_join(docs, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_no_rows(spark):
    assert ngram_join.jaccard_groups(spark.createDataFrame([], "doc_id long, text string"), 5, 80).collect() == []


def test_sets_meet_for_what_they_hold():
    """Linked sets share a signature, others do not meet for segments that both leave empty, however many they are."""
    rng = np.random.default_rng(5)
    for k, (lo, hi) in enumerate(ngram_join.band_bounds(80, 400)):
        plan = ngram_join.band_plan(lo, ngram_join.difference(80, hi))
        full = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
        for n in (lo, hi):
            for _ in range(20):
                x = full(n)
                y = np.concatenate((x[n // 10 :], full(n // 12)))
                common = n - n // 10
                if len(y) >= lo and 100 * common >= 80 * (n + n // 12):
                    assert np.intersect1d(ngram_join.signatures(x, k, plan), ngram_join.signatures(y, k, plan)).size
        if lo >= 100:
            sigs = np.concatenate([np.unique(ngram_join.signatures(full(hi), k, plan)) for _ in range(300)])
            assert len(np.unique(sigs)) == len(sigs) and len(sigs) < 300 * hi / 2
