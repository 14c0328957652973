from __future__ import annotations

import base64
import hashlib
import io
import struct

import numpy as np
import pandas as pd
import pytest
import zstandard

from driftwell.llm import knn, warc
from driftwell.llm.common import components, scratch_path


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    v = [[float(x) for x in rng.standard_normal(8)] for _ in range(150)]
    v[30:60] = [v[30]] * 30
    found = [(k, x, "a", "b") for k, x in enumerate(v)] + [(200, None, "", ""), (201, [None] * 8, "", ""), (202, [float("nan")] * 8, "", ""), (203, [float("inf")] * 8, "", ""), (None, v[0], "", "")]
    df = spark.createDataFrame(found, "vec_id long, embedding array<float>, cell string, score string").repartition(3)
    vectors = knn.whole_vectors(df)
    got = {}
    for r in knn.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(np.array(v, np.float32).astype(float) * 64)
    for q in range(0, 150, 20):
        scores = whole @ whole[q]
        order = [k for k in np.lexsort((np.arange(150), -scores)) if k != q][:7]
        assert sorted(got[q]) == [(n, k, int(scores[k])) for n, k in enumerate(order, 1)]
    assert len(got) == 8
    few = vectors.filter("vec_id < 3")
    assert knn.top_k(few, few, 20).count() == 6
    assert knn.top_k(vectors.filter("vec_id < 0"), vectors, 5).count() == 0


def test_products_of_large_numbers_are_exact():
    a, b = np.array([[2.0**40, 1.0], [3.0, -5.0]]), np.array([[2.0**20, 7.0], [2.0**20, 6.0], [-1.0, 2.0]])
    assert knn._products(a, b).tolist() == [[2**60 + 7, 2**60 + 6, 2 - 2**40], [3 * 2**20 - 35, 3 * 2**20 - 30, -13]]
    found = knn._solve(2, 2)((0, 0, 0), pd.DataFrame({"vec_id": [9], "v": [a[0]]}), pd.DataFrame({"vec_id": [1, 2, 9], "v": list(b)}))
    assert found.values.tolist() == [[9, 1, 2**60 + 7], [9, 2, 2**60 + 6]]


def test_top_k_joins_bounded_blocks(spark, monkeypatch):
    """One cell holds nearly all vectors and gets nearly all queries: no task may hold many of either."""
    monkeypatch.setattr(knn, "BLOCK_ROWS", 32)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 8, raising=False)
    monkeypatch.setattr(knn, "PIVOTS", 2)
    solve = knn._solve

    def bounded(k, width):
        run = solve(k, width)

        def checked(key, queries, rows):
            assert len(queries) <= 32 and len(rows) <= 128, f"{len(queries)} queries, {len(rows)} rows"
            return run(key, queries, rows)

        return checked

    monkeypatch.setattr(knn, "_solve", bounded)
    rng = np.random.default_rng(3)
    whole = np.floor(np.vstack([rng.standard_normal((390, 6)), rng.standard_normal((10, 6)) + 50]) * 64)
    whole[:300] = np.floor(whole[:300] / 640)
    vectors = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(whole)], "vec_id long, v array<double>").repartition(3)
    got = {}
    for r in knn.top_k(vectors, vectors.filter("vec_id % 2 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(got) == 200
    for q, ranks in got.items():
        scores = whole @ whole[q]
        order = [k for k in np.lexsort((np.arange(400), -scores)) if k != q][:5]
        assert sorted(ranks) == [(n, k, int(scores[k])) for n, k in enumerate(order, 1)]


def test_top_k_sends_few_vectors_at_a_time(spark, monkeypatch):
    """A task passes on a bounded number of vectors at a time, however many cells its queries meet."""
    monkeypatch.setattr(knn, "AT_ONCE", 1 << 13)
    monkeypatch.setattr(knn, "SPAN_LEAST", 64, raising=False)

    def watched(mapped):
        def run(df, f, *a, **b):
            def checked(batches):
                for out in f(batches):
                    n = len(out) if isinstance(out, pd.DataFrame) else out.num_rows
                    names = list(out.columns) if isinstance(out, pd.DataFrame) else out.schema.names
                    assert "v" not in names or n * 16 <= 1 << 13, f"{n} vectors"
                    yield out

            return mapped(df, checked, *a, **b)

        return run

    rng = np.random.default_rng(5)
    whole = np.floor(rng.standard_normal((1500, 16)) * 9)
    vectors = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(whole)], "vec_id long, v array<double>").coalesce(1)
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(type(vectors), name, watched(getattr(type(vectors), name)))
    got = knn.top_k(vectors, vectors, 3).toPandas().sort_values(["query_id", "rank"])
    scores = (whole @ whole.T - 1e9 * np.eye(1500)).astype(int)
    best = np.lexsort((np.broadcast_to(np.arange(1500), scores.shape), -scores))[:, :3]
    assert got["vec_id"].tolist() == best.ravel().tolist()
    assert got["score"].tolist() == np.take_along_axis(scores, best, 1).ravel().tolist()


@pytest.mark.parametrize("scale", [1, 100, 2**20, 2**40])
def test_top_k_in_many_tasks(spark, monkeypatch, scale):
    """Many spans, some of one cell, each for several tasks; lengths that need each of the number types; repeated ids on both sides."""
    for name, value in {"PIVOTS": 16, "SPAN_LEAST": 20, "SPAN_MOST": 60, "TASK_QUERIES": 16, "BLOCK_ROWS": 16, "BLOCK_QUERIES": 8}.items():
        monkeypatch.setattr(knn, name, value, raising=False)
    rng = np.random.default_rng(scale)
    whole = np.floor(rng.standard_normal((400, 5)) * 4 + 30 * rng.integers(0, 2, (400, 5))) * (scale if scale <= 2**20 else 2**10)
    whole[:150] = whole[0] + rng.integers(0, 2, (150, 5))
    whole[:, 0] += rng.integers(0, 2, 400)
    if scale > 2**20:  # rows that are no queries, whose products with themselves don't fit a long
        whole[1:380:2, 0] *= scale / 2**15
    ids = np.arange(400)
    ids[380:] = rng.choice(np.arange(0, 40, 4), 20)
    rows = [(int(k), [float(x) for x in v]) for k, v in zip(ids, whole, strict=True)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    got = {}
    for r in knn.top_k(vectors, vectors.filter("vec_id % 4 = 0"), 6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == sorted({k for k, _ in rows if k % 4 == 0})
    exact = [(k, [int(x) for x in v]) for k, v in rows]
    for q, ranks in got.items():
        found = [(-sum(a * b for a, b in zip(v, w, strict=True)), n) for k, v in exact if k == q for n, w in exact if n != q]
        assert sorted(ranks) == [(n, k, -s) for n, (s, k) in enumerate(sorted(found)[:6], 1)]


def test_top_k_of_lengths_that_differ(spark):
    """Shorter vectors end in zeros, queries may be longer than all rows; empty ones score 0."""
    rows = [(1, [3.0]), (2, []), (3, [-1.0, 2.0]), (4, [5.0, 300.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>")
    queries = spark.createDataFrame([(9, [2.0, 1.0, 7.0]), (4, [1.0])], "vec_id long, v array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(vectors, queries, 3).collect()]
    assert sorted(got) == [(4, 1, 1, 3), (4, 2, 2, 0), (4, 3, 3, -1), (9, 1, 4, 310), (9, 2, 1, 6), (9, 3, 2, 0)]
    assert knn.top_k(vectors, queries.filter("vec_id < 0"), 3).count() == 0


PAGES = [(1, "http://a", "x" * 150), (2, "http://b\r\n", "x" * 150), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "é😀" * 60), (9, "u", "é😀" * 60), (8, "u", "é😀" * 60), (None, "u", "x" * 150), (10, "u", "big" * 200_000), (10, "u", "big" * 200_000)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "q") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.read_archives(warc.write_archives(pages, scratch_path(spark, "warc"))).collect()
    first = {"x" * 150: 1, "é😀" * 60: 7, "big" * 200_000: 10}
    expected = []
    for page, _, html in PAGES:
        raw, to = (html or "").encode(), first.get(html)
        revisit = to is not None and page != to
        expected.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None, b"" if revisit else raw))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty, scratch_path(spark, "warc"))).count() == 0


def test_archives_in_a_folder_without_a_scheme(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"{tmp_path}/archives")
    assert all(r.path.startswith(f"file:///{str(tmp_path)[1:]}/archives/part-") for r in manifest.collect())
    assert warc.read_archives(manifest).count() == 4
    assert warc.located(spark, "s3a://bucket/a") == "s3://bucket/a" and warc.located(spark, "hdfs://name:9000/a/b") == "hdfs://name:9000/a/b"
    with pytest.raises(warc.ArchiveError):
        warc.write_archives(pages, "ftp://host/a")


def _archive(*records: bytes, dictionary: bytes = b"") -> bytes:
    return warc.dictionary_frame(dictionary) + b"".join(zstandard.ZstdCompressor().compress(r) for r in records)


def test_reader_finds_what_is_wrong():
    payload = b"hello" * 30
    good = warc.make_record(1, "http://a", payload, hashlib.sha256(payload).hexdigest(), "response", None, "2024-01-01T00:00:00Z")
    assert [warc.parse_record(r)["payload"] for r in warc.read_records(io.BytesIO(_archive(good, good)))] == [payload] * 2
    packed = zstandard.ZstdCompressor().compress(b"")
    assert list(warc.read_records(io.BytesIO(_archive(good, dictionary=packed)))) == [good]
    for bad in (good.replace(b"hello", b"jello", 1), good[:-1], good.replace(b"Content-Length: 2", b"Content-Length: 3"), good.replace(b"WARC-Date", b"X-Date"), b"no record"):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(bad)
    whole = _archive(good)
    for bad in (b"", whole[:6], whole[:-3], struct.pack("<II", 1, 0) + whole[8:], whole + b"rest"):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_records(io.BytesIO(bad)))


def test_reader_takes_archives_of_other_writers():
    """Names in another case, no digest or one in base 32, no fields of our own, and records that hold no HTTP."""
    body = b"HTTP/1.1 200 OK\r\ncontent-length: 5\r\n\r\nhello"
    head = "WARC/1.0\r\nwarc-type: {}\r\nWARC-RECORD-ID: <urn:x>\r\nwarc-date: 2020-01-01T00:00:00Z\r\nContent-Type: {}\r\n{}content-length: {}\r\n\r\n"
    record = lambda kind, content, more, raw: head.format(kind, content, more, len(raw)).encode() + raw + b"\r\n\r\n"
    http, sha1 = "application/http; msgtype=response", base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    found = warc.parse_record(record("response", http, "", body))
    assert (found["payload"], found["payload_bytes"], found["payload_digest"], found["page_id"]) == (b"hello", 5, hashlib.sha256(b"hello").hexdigest(), None)
    assert warc.parse_record(record("response", http, f"WARC-Payload-Digest: sha1:{sha1}\r\n", body))["payload"] == b"hello"
    assert warc.parse_record(record("warcinfo", "application/warc-fields", "", b"software: x"))["payload"] == b"software: x"
    revisit = warc.parse_record(record("revisit", http, "WARC-Refers-To-Target-URI: http://a\r\n", body[:-5]))
    assert (revisit["record_type"], revisit["payload_bytes"]) == ("revisit", 5)
    for more in (f"WARC-Payload-Digest: sha1:{sha1[::-1]}\r\n", "Page-Id: one\r\n", "Page-Payload-Length: 6\r\n"):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(record("response", http, more, body))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
