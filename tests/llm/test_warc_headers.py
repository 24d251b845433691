import pytest

from subsetry.llm import warc


def test_headers_of_any_length(spark):
    rows = [(1, "http://a/" + " " * 30_000, "first"), (2, "u", "second"), (3, "v" * 300_000, "third"), (4, "u", "fourth")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.round_trip(df).collect()) == [(i, len(h)) for i, _, h in rows]


@pytest.mark.parametrize("raw", [warc.record(1, "u", b"x", None, False)[:-3], b"junk" * 9, warc.record(1, "u", b"x", None, False) + b"junk"])
def test_a_broken_file_is_an_error(spark, tmp_path, raw):
    (tmp_path / "a.warc").write_bytes(raw)
    files = spark.createDataFrame([("a.warc", len(raw))], "name string, bytes long")
    with pytest.raises(Exception, match="no record at|records end at"):
        warc.boundaries(files, f"file://{tmp_path}").collect()


def test_candidates_read_on():
    raw = warc.record(1, "u" * 500, b"x", None, False) + warc.record(2, "u", b"WARC/1.0\r\n" * 50, None, False)
    whole = list(warc.candidates(raw, 0, len(raw)))
    left = iter([raw[k : k + 100] for k in range(20, len(raw), 100)])
    assert whole[0] == (0, raw.index(b"WARC/1.0", 5)) and whole[1][1] == len(raw)
    assert list(warc.candidates(raw[:20], 0, 10, lambda n: next(left, b""))) == whole[:1]
