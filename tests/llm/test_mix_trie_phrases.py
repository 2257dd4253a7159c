"""Source mixing, the conversation trie and phrase collocations against brute force: supplied tables and hard cases."""

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from quantpanel.llm import collocations as col
from quantpanel.llm import conversation_trie as ct
from quantpanel.llm import mixing
from quantpanel.llm import queries as q

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string, depth string, a string, key string"
DOCS = "doc_id long, text string, source string, lang string, size string, p string, name string, n string"


def nodes(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def phrases(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def mixed(df):
    return sorted(df.select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect(), key=repr)


def check_mix(rows, docs, weights=(5, 2, 1), most=3):
    """Each row once, targets exact, each source within its target by half of one document, caps held."""
    size = {(d, s): len(brute.WHITE.findall(t or "")) for d, t, s in docs}
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((d, s, len(brute.WHITE.findall(t or ""))) for d, t, s in docs)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(brute.WHITE.findall(t or ""))
    want, taken, largest = brute.source_targets(sizes, weights, most), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        assert 0 <= r.copies <= most and r.taken == r.copies * r.size <= most * r.size
        if r.size:
            rate = float(want[r.source]) / sizes[r.source]
            assert np.floor(rate) <= r.copies <= np.ceil(rate)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - float(want[s])) <= largest[s] / 2 + 1e-3 for s in sizes)
    return size


def test_op11(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    check_mix(mixed(mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet"))), docs)
    got = q.op11_source_mix(spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_mix_of_many_blocks_is_the_same_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    monkeypatch.setattr(mixing, "FAN", 3)
    monkeypatch.setattr(mixing, "HOT_ROWS", 50)
    rng = random.Random(5)
    docs = [(rng.choice([None, 7, 2**61, *range(3000)]), "w " * rng.choice([0, 1, 2, 9, 40, 700]), rng.choice(["b", "b", "b", "a", "é", "", None])) for _ in range(3000)]
    docs += [(5, "x y z", "b")] * 400
    table = spark.createDataFrame([(*d, None, "s", "p", "n", "m") for d in docs], DOCS)
    first = mixed(mixing.mix_sources(table.repartition(3)))
    check_mix(first, docs)
    assert first == mixed(mixing.mix_sources(table.repartition(7, "text")))
    assert first != mixed(mixing.mix_sources(table, seed=99))


def test_mix_of_empty_and_wordless_tables(spark):
    assert mixed(mixing.mix_sources(spark.createDataFrame([], DOCS))) == []
    rows = mixed(mixing.mix_sources(spark.createDataFrame([(1, None, "a", *"xxxxx"), (None, " ", None, *"xxxxx")], DOCS)))
    assert [(r.doc_id, r.copies, r.taken, r.target) for r in rows] == [(1, 0, 0, 0.0), (None, 0, 0, 0.0)]


def test_copies_keep_their_expectation_and_the_words(spark):
    """Over many seeds each document gets its rate on average, and each draw keeps the words of the block."""
    sizes = np.array([5, 5, 8, 13, 40, 1, 2, 90])
    pdf = pd.DataFrame({"name": "0a", "doc_id": np.arange(8), "no_id": False, "size": sizes, "no": 0, "whole": 1, "p": 0.3})
    total, seeds = np.zeros(8), 3000
    for seed in range(seeds):
        out = mixing.settle(pdf, seed).sort_values("doc_id")
        assert abs((out["size"] * out["p"]).sum() - 0.3 * sizes.sum()) < 1e-6
        assert ((out["p"] > 0) & (out["p"] < 1)).sum() <= 1
        total += out["p"].to_numpy()
    assert np.abs(total / seeds - 0.3).max() < 0.03


def test_op12(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(q.op12_conversation_trie(spark, SF)) == brute.trie(turns)


def hard_turns():
    rng = random.Random(3)
    out = [(None, 0, "user", "lost"), (-5, 0, "user", "x"), (-100, 0, "user", "minus"), (-100, 1, None, None)]
    for c in range(0, 260):
        for k in range(rng.choice([1, 2, 6, 9])):
            out.append((c, None if k == 0 and c % 7 == 0 else k, rng.choice(["user", None]), rng.choice(["a", "b", "é😀", "", None])))
    out += [(300, k, "user", "same" if k % 2 else str(k % 5)) for k in range(900)]  # one long conversation
    out += [(c, k, "user", f"turn {k}") for c in range(401, 440) for k in range(c - 400)]  # a conversation that grows, no base
    out += [(700, 3, "user", "twice")] * 8 + [(701, 3, "user", "tie"), (701, 3, "assistant", "tie"), (2**62, 1, "user", "far")]
    return out


@pytest.mark.parametrize("light", [1000, 4])
def test_trie_of_hard_cases(spark, monkeypatch, light):
    """Nulls, ties, repeats, clashing columns, a conversation over several tasks, heavy prefixes, runs of ids cut short."""
    monkeypatch.setattr(ct, "RUN_BYTES", 20)
    turns = hard_turns()
    table = spark.createDataFrame([(*t, "d", "a", "k") for t in turns], TURNS)
    assert nodes(ct.prefix_nodes(ct.rebuilt(table), light=light)) == brute.trie(turns)


def test_trie_of_no_conversations(spark):
    assert nodes(ct.prefix_nodes(ct.rebuilt(spark.createDataFrame([], TURNS)))) == []
    one = [(4, None, None, None)]
    assert nodes(ct.prefix_nodes(ct.rebuilt(spark.createDataFrame([(*one[0], "", "", "")], TURNS)))) == brute.trie(one)


def test_node_table_parts_prefixes_that_fold_together(monkeypatch):
    fold = ct.NodeTable._folded
    monkeypatch.setattr(ct.NodeTable, "_folded", lambda self, d, a, b: d.copy() if self.seed == 0 else fold(self, d, a, b))
    d, a, b = np.array([1, 1, 2]), np.array([5, 6, 5]), np.array([7, 7, 7])
    t = ct.NodeTable(d, a, b)
    assert t.seed == 1 and sorted(t.slots(d, a, b)) == [0, 1, 2]
    assert t.slots(np.array([3, 1]), np.array([5, 5]), np.array([7, 8])).tolist() == [-1, -1]


def test_op13(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    assert phrases(q.op13_phrase_collocations(spark, SF)) == brute.collocations(docs)


def hard_docs():
    rng = random.Random(8)
    word = lambda: rng.choice(["New", "york", "ÄB", "x\x0by", "a\x00b", "the", "the", "of", "é", "z,z", "q.", "w\tw", "😀", "ﬀ"])
    docs = [(rng.choice(["en", "en", None, "und", "de", ""]), " ".join(word() for _ in range(rng.choice([0, 1, 3, 50])))) for _ in range(400)]
    docs += [("en", None), ("en", ""), ("de", "ha " * 5000 + "\n" + "one two three four five " * 200)] + [("en", "exact same words here")] * 300
    return docs


def test_phrases_of_hard_cases(spark, monkeypatch):
    """Nulls, marks within words, long and repeated texts, clashing columns; blocks and tasks that hand on early."""
    monkeypatch.setattr(col, "GATHERED", 500)
    monkeypatch.setattr(col, "BLOB", 300)
    docs = hard_docs()
    table = spark.createDataFrame([(k, t, "s", lang, "3", "p", "n", "m") for k, (lang, t) in enumerate(docs)], DOCS)
    assert phrases(col.collocations(table, least=5, top=20)) == brute.collocations(docs, 5, 20)
    assert phrases(col.collocations(table.limit(0))) == []


def test_words_of_one_hash_are_counted_again(spark, monkeypatch):
    """Words that clash under the first names of bytes get other hashes."""
    tries = []

    def shuffled(seed, real=col._shuffled):
        tries.append(seed)
        return bytes(b if b != 122 else 121 for b in range(256)) if seed == 0 else real(seed)  # z is taken for y

    docs = [("en", "fuzzy words fuzyy words") for _ in range(40)]
    out = [f for s in (0, 1) for f in col._counted(iter([pd.DataFrame(docs, columns=["lang", "text"])]), s)]
    assert len(out) == 4
    monkeypatch.setattr(col, "_shuffled", shuffled)
    first = pd.concat(col._counted(iter([pd.DataFrame(docs, columns=["lang", "text"])]), 0))
    assert len(first[first["word"].notna()]) == 2 and tries == [0]
