"""Archives written and read again."""

import hashlib

import pytest

from gridweave.llm import registry, warc


def pages():
    long, other = "ä" * 600, "b" * 1000
    return [
        (1, "http://a", long), (2, "http://b", long), (9, None, long), (3, "x\r\ny", "b" * 999), (4, "u", "b" * 999), (5, "u", other), (6, "u", other), (6, "u", other),
        (7, "u", None), (8, "u", ""), (None, "u", other), (10, "u", "c" * 200_000), (None, "u", "d" * 1000), (None, "v", "d" * 1000),
    ]


def expected(rows):
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        same = [q for q, _, x in rows if (x or "").encode() == b and q is not None]
        top = max(same) if same and len(b) >= 1000 and sum((x or "").encode() == b for _, _, x in rows) > 1 else None
        revisit = top is not None and (p is None or p < top)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path, monkeypatch):
    rows = pages()
    spark.createDataFrame([(*r, "digest") for r in rows], "page_id long, url string, html string, digest string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "RANGE", 2000)
    got = registry.op1_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_selected_records_alone_are_read(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)
    index = warc.write(df)
    got = warc.read(index.where("page_id in (3, 10)")).orderBy("page_id").collect()
    assert [(r.page_id, r.url, bytes(r.payload)) for r in got] == [(3, "x%0D%0Ay", b"b" * 999), (10, "u", b"c" * 200_000)]
    assert warc.read(index.limit(0)).count() == 0
    assert warc.write(df.limit(0)).count() == 0


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", warc.GAP + 21, 5), ("b", 0, 5), ("b", 5, warc.RANGE)]
    assert list(warc.ranges(rows)) == [("a", 0, 20, [0, 1]), ("a", warc.GAP + 21, warc.GAP + 26, [2]), ("b", 0, 5, [3]), ("b", 5, warc.RANGE + 5, [4])]


def test_a_broken_record_is_an_error():
    whole = warc.record(1, "u", b"payload", "d" * 40, None, False)
    assert warc.parse(whole)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(b"nothing")
    with pytest.raises(ValueError):
        warc.parse(whole.replace(b"Content-Length: 7", b"Content-Length: 9"))
