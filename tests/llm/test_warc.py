import base64
import gzip
import hashlib
import heapq
import random

from tonelake.llm import warc


def brute(rows, least=0):
    first = {}
    for p, _, h in rows:
        data = (h or "").encode()
        if len(data) >= least and p is not None:
            first[data] = min(p, first.get(data, p))
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        to = first.get(data) if len(data) >= least else None
        to = None if to == p else to
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def got(rows):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


def test_loser_tree_merges():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(20), rng.randrange(3)) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == list(heapq.merge(*runs))


def test_edge_rows(spark, tmp_path):
    rows = [(3, "http://a.b/x?b=1&a=2", "same"), (1, "https://www.a.b:443/", "same"), (2, None, None), (5, "u\r\nv", ""), (None, "http://n/", "alone"), (6, "http://n/", "é\r\n\r\nWARC/1.1\r\n\n" * 9), (7, "http://n/", "é" * 900_000), (8, "http://n/", "same"), (None, "http://z/", "same"), (10**15, "http://[bad/", "odd"), (-(2**63), "http://[::1]:8080/x", "odd"), (2**63 - 1, "no url at all : //", "odd"), (-7, "http://u@h.b:99:9/?", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, offset int")
    path = str(tmp_path / "w")
    entries = warc.archive(df, path=path).collect()
    assert got(entries) == brute(rows)
    assert [warc._order((e.url_key, e.captured_at, e.page_id, 0, 0, 0, 0, 0, e.file, e.offset)) for e in entries] == sorted(warc._order((e.url_key, e.captured_at, e.page_id, 0, 0, 0, 0, 0, e.file, e.offset)) for e in entries)
    for e in entries:  # the index leads to the payload
        data = gzip.open(e.file.removeprefix("file:")).read()
        _, fields, block = next(warc.records(iter([data[e.offset :]])))
        assert fields["WARC-Type"] == e.record_type
        if e.record_type == "response":
            assert block.partition(b"\r\n\r\n")[2] in {(h or "").encode() for p, _, h in rows if p == e.page_id}
    assert got(warc.archive(df, min_bytes=3).collect()) == brute(rows, 3)
    assert warc.archive(df.limit(0)).count() == 0


def test_keys():
    assert warc.url_key("https://me@www.Example.com:443/A?b=2&a=1#f") == "com,example)/A?a=1&b=2"
    assert warc.url_key("http://[bad/") == "[bad)/" and warc.url_key("http://[::1]:80/") == "[::1])/" and warc.url_key("") == ")/"


def test_reading_in_pieces():
    data = b"".join(b"WARC/1.1\r\nA: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, 3 * i, b"x\r\n" * i) for i in range(40))
    want = list(warc.records(iter([data])))
    assert [int(f["A"]) for _, f, _ in want] == list(range(40)) and all(len(b) == 3 * int(f["A"]) for _, f, b in want)
    for size in (1, 7, 100):
        assert list(warc.records(iter([data[i : i + size] for i in range(0, len(data), size)]))) == want
    packed = gzip.compress(data[:500]) + gzip.compress(data[500:])
    assert b"".join(warc.inflated(packed)) == data and b"".join(warc.inflated(b"")) == b""


def test_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert got(warc.archive(pages).collect()) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])
