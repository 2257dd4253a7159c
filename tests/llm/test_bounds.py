"""Rounds that end, scans that stay linear: hostile or unlucky inputs of packing and archives."""

import time

import pandas as pd

from quantpanel.llm import packing, substring_dedup, warc


def test_bins_that_cannot_combine_do_not_meet(spark, monkeypatch):
    """Pieces over half a bin: no later round moves any, and no task packs more than TASK_PIECES rows."""
    monkeypatch.setattr(packing, "TASK_PIECES", 100)
    sizes = []
    real = packing._may_combine

    def counted(at, capacity):
        open_, n = real(at, capacity)
        sizes.append(n)
        return open_, n

    monkeypatch.setattr(packing, "_may_combine", counted)
    pieces = spark.range(1000).selectExpr("id", "2500L as length")
    assert packing.pack(pieces).select("sequence_id").distinct().count() == 1000 and sizes == [0]
    few = pieces.unionByName(spark.range(1000, 1090).selectExpr("id", "1500L as length"))
    got = packing.pack(few)
    fill = got.groupBy("sequence_id").sum("length").collect()
    assert got.count() == 1090 and all(r[1] <= 4096 for r in fill) and len(fill) < 1070


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_PIECES", 50)
    pieces = spark.range(2000).selectExpr("id", "cast(20 + id * 7919 % 1500 as bigint) as length")
    got = packing.pack(pieces, open_bins=4).collect()
    spots = {}
    for r in got:
        spots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) == 2000 and len(spots) <= 1.1 * sum(r.length for r in got) / 4096
    for b in spots.values():
        b.sort()
        assert b[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(b, b[1:])) and sum(b[-1]) <= 4096


def ranges(tmp_path, raw):
    path = tmp_path / "a.warc"
    path.write_bytes(raw)
    return pd.DataFrame([{"uri": f"file://{path}", "lo": 0, "hi": len(raw), "size": len(raw)}])


def test_many_magics_without_a_blank_line_take_seconds(tmp_path):
    for payload in (b"WARC/1.1\r\n" * 800_000, b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 1\r\n" * 100_000):
        raw = warc.record(1, "u", payload, None) + warc.record(2, "u", b"x", None)
        began = time.time()
        found = pd.concat(warc._scanned(iter([ranges(tmp_path, raw)])))
        assert time.time() - began < 30
        at, chain = dict(zip(found["off"], found["next"])), [0]
        while chain[-1] in at:
            chain.append(at[chain[-1]])
        assert chain == [0, len(raw) - len(warc.record(2, "u", b"x", None)), len(raw)]


def test_candidates_are_those_of_the_whole_header(tmp_path):
    """Every magic gets the fields between it and the next blank line, the last of a name counting, as header_of reads them."""
    raw = b"WARC/1.0\r\nContent-Length: 4\r\nWARC/1.1\r\nWARC-Type: a\r\nContent-Length: 7\r\nWARC/1.1\r\nX: 1\r\n\r\nWARC/1.1\r\nWARC-Type: a\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\n" + b"z" * 40
    want = {}
    for m in warc.MAGIC.finditer(raw):
        head = raw[m.start() : raw.find(b"\r\n\r\n", m.start()) + 4]
        if b"9" * 30 not in head and (h := warc.header_of(head)):
            want[m.start()] = m.start() + h[1] + int(h[0][b"Content-Length"]) + 4
    found = pd.concat(warc._scanned(iter([ranges(tmp_path, raw)])))
    assert dict(zip(found["off"].tolist(), found["next"].tolist())) == want and len(want) == 2


def test_hashes_of_words_are_shuffled_not_stored_too(spark, monkeypatch):
    """What batches of texts send to the buckets is the size of the input: it lies on disk once."""
    stored, real = [], substring_dedup.store
    monkeypatch.setattr(substring_dedup, "store", lambda df, tag: (stored.append(set(df.columns)), real(df, tag))[1])
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()) == [(1, 60), (2, 60), (3, 0)]
    assert stored and not any("hashes" in c for c in stored)
