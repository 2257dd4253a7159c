"""Archives hold urls of any length whole, and readers follow their headers over the end of a range."""

import pandas as pd
import pyarrow.fs

from quantpanel.llm import warc


def test_long_urls_are_whole(spark, tmp_path):
    pages = [(i, "http://a.example/?q=" + "x é" * k, f"<p>{i % 3}</p>") for i, k in enumerate((1, 3000, 100_000, 5, 400_000))]
    done = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    assert sorted(r.page_id for r in warc.read_archives(done).collect()) == [0, 1, 2, 3, 4]
    raw = b""
    for r in done.collect():
        fs, path = pyarrow.fs.FileSystem.from_uri(r.uri)
        with fs.open_input_file(path) as f:
            raw += f.read()
    assert all(b"WARC-Target-URI: " + u.replace(" ", "%20").encode() + b"\r\n" in raw for _, u, _ in pages)


def test_headers_over_the_end_of_a_range(tmp_path):
    one = [warc.record(i, "http://a/" + "y" * k, b"text", None) for i, k in enumerate((10, 300_000, 20))]
    (tmp_path / "a.warc").write_bytes(b"".join(one))
    size, first = sum(map(len, one)), len(one[0])
    for lo, hi, want in ((0, first + 1, [0, first]), (first, first + 100, [first]), (first + 100, size, [size - len(one[2])])):
        (out,) = warc._scanned(iter([pd.DataFrame([(f"file://{tmp_path}/a.warc", lo, hi, size)], columns=["uri", "lo", "hi", "size"])]))
        assert out["off"].tolist() == want
