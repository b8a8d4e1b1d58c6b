"""Archives and vectors against brute force, and on awkward tables."""

import base64
import gzip
import hashlib
import random

from wattframe.llm import topk, warc

PAGES = "page_id BIGINT, url STRING, html STRING, offset INT, sha STRING"


def test_archives(spark, tmp_path):
    html = ["<p>one</p>", None, "", "<p>one</p>", "é" * 3000, "x\r\n\r\ny", "<p>one</p>", "z" * 200_000]
    rows = [(i, None if i == 4 else f"http://e.com/{i}\r\n", h, 1, "s") for i, h in enumerate(html)]
    pages = spark.createDataFrame([*rows, rows[5], (None, "u", "lost", 1, "s")], PAGES)
    folder = f"file://{tmp_path}/w"
    got = warc.archive_pages(pages, folder).collect()
    assert len(got) == 10  # a record per row, also without an id
    assert [(r.record_type, r.refers_to, bytes(r.payload)) for r in got if r.page_id is None] == [("response", None, b"lost")]
    got = [r for r in got if r.page_id is not None]
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    for r in got:
        body = (html[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        own = first[html[r.page_id] or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if own == r.page_id else ("revisit", own))
        assert r.payload is None or bytes(r.payload) == body
    index = spark.read.parquet(f"{folder}/index").collect()
    for r in index:  # each record is a gzip file of its own
        raw = (tmp_path / "w" / "records" / r.archive).read_bytes()[r.offset : r.offset + r.length]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_pages_without_an_id(spark, tmp_path):
    rows = [(None, "u", "a", 1, "s"), (3, "u", "a", 1, "s"), (None, None, "b", 1, "s"), (None, "u", "b", 1, "s"), (5, "u", "a", 1, "s")]
    got = warc.archive_pages(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/w").collect()
    found = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, bytes(r.payload or b"").decode()) for r in got)
    assert found == [(0, "response", 0, "b"), (0, "response", 0, "b"), (0, "revisit", 3, ""), (3, "response", 0, "a"), (5, "revisit", 3, "")]


def test_records_over_chunk_borders():
    raw = [warc.record(i, "u", bytes(random.Random(i).randbytes(50 * i)), "D", None) for i in range(9)]
    whole = b"".join(raw)
    for step in (1, 7, 1000):
        assert list(warc.records(whole[k : k + step] for k in range(0, len(whole), step))) == raw


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)], 0) for i in range(400)]
    rows[7] = (7, rows[8][1], 0)
    rows[50] = (50, rows[8][1], 0)
    odd = [(900, None, 0), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (902, [float("nan")] * 6, 0), (903, [1.0], 0), (None, [1.0] * 6, 0), rows[8]]
    d = spark.createDataFrame(rows + odd, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").selectExpr("*", "1 AS near", "2 AS v")
    got = {}
    for x in topk.search(d).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    import numpy as np

    v = {i: np.floor(256 * np.array(e, dtype=np.float32).astype(float)).astype(int) for i, e, _ in rows}
    want = {q: sorted(((i, int(v[q] @ x)) for i, x in v.items() if i != q), key=lambda p: (-p[1], p[0]))[:5] for q in range(0, 400, 50)}
    assert got == want
    assert topk.search(d.limit(0)).count() == 0
    two = d.where("vec_id IN (0, 1)")
    assert [tuple(x)[:3] for x in topk.search(two).collect()] == [(0, 1, 1)]


def test_each_length_is_searched_by_itself(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "PIVOT_ROWS", 5)
    big = 2.0**21  # products past the exact range of doubles, within 64 bits
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(100 + i, [i / 3, 0.5, -1.0]) for i in range(30)] + [(200, []), (201, [])]
    rows += [(300 + i, [big + i / 256, 1.0, 1.0, i / 256]) for i in range(5)]
    got = {}
    for x in topk.search(spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    v = {i: [int(256 * x // 1) for x in e] for i, e in rows}
    want = {}
    for q in (0, 50, 100, 200, 300):
        scores = [(i, sum(a * b for a, b in zip(v[q], x))) for i, x in v.items() if i != q and len(x) == len(v[q])]
        want[q] = sorted(scores, key=lambda p: (-p[1], p[0]))[:5]
    assert got == want and want[300][0][1] > 2**53
