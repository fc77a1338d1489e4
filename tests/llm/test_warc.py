import gzip
from hashlib import sha256

from sylvan.llm import common, warc


def test_url_keys():
    assert warc.url_key("https://www.Example.com:80/a?b=c#d") == "com,example,www)/a?b=c"
    assert warc.url_key("http://u@h.org") == "org,h)/" and warc.url_key("x.y?q") == "y,x)?q"
    assert warc.url_key(None) == warc.url_key("") == "-" and " " not in warc.url_key("http://a b/c d\n")


def test_record_round_trip():
    raw = warc.record(7, "http://a/\r\nX: y", b"pay\r\n\r\nload", "d", None)
    head, payload = warc.parse(raw)
    assert payload == b"pay\r\n\r\nload" and head["X-Page"] == "7" and "X" not in head
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, size int")


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    long = "<p>" + "same page " * 20
    rows = [(i, f"http://h{i % 4}.com/{i % 9}", long if i % 3 == 0 else f"<p>page {i} é😀") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://one.url/", "x"), (102, "http://one.url/", "x"), (-5, "http://one.url/", "y" * 100), (103, "http://one.url/", "y" * 100), (None, "http://n/", long)]
    pages = table(spark, rows)
    manifest = warc.write(spark, pages, common.Scratch(spark, "t"))
    got = warc.read_records(spark, warc.look_up(spark, pages, manifest)).collect()
    assert len(got) == len(rows)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = min((p for p, _, h in rows if p is not None and (h or "").encode() == raw), default=None)
        revisit = page is not None and len(raw) >= 100 and page > first
        want.append((page, len(raw), sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    hot = warc.write(spark, pages, common.Scratch(spark, "t"), hot=5)  # one payload has more copies than that
    assert sorted(map(str, warc.read_records(spark, warc.look_up(spark, pages, hot)).collect())) == sorted(map(str, got))
    one = spark.createDataFrame([("http://one.url/", 103), ("http://missing/", 1)], "url string, page_id long")
    assert [r.kind for r in warc.look_up(spark, one, manifest).collect()] == ["revisit"]


def test_empty_table(spark):
    pages = table(spark, [])
    manifest = warc.write(spark, pages, common.Scratch(spark, "t"))
    assert warc.read_records(spark, warc.look_up(spark, pages, manifest)).count() == 0
