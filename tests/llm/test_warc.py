"""The content-addressed archive: round trips, roles, damage, odd rows."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cardsight.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows):
    """page_id, payload_bytes, payload_digest, record_type, refers_to by plain Python."""
    first, out = {}, []
    for page_id, _, html, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        seen = len(body) >= warc.LEAST and body in first
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if seen else "response",
                    first[body] if seen else None))
        first.setdefault(body, page_id)
    return sorted(out, key=str)


def odd_pages():
    rng = random.Random(5)
    texts = ["<p>" + "x" * n for n in (0, 95, 96, 97, 200)] + ["é" * 50, "é" * 49 + "a", "", None, "a\r\n\r\nb\r\n" * 40,
                                                           " 𝒳\x00" * 60, "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n" * 9,
                                                           "z" * 3_000_000]
    rows = [(i + 1, f"http://a/{i}", t, "x") for i, t in enumerate(texts * 3)]
    rows += [(None, None, texts[4], "x"), (None, "http://b\r\nWARC-Type: x", "only " * 40, "x"), (-7, "u", "neg" * 50, "x"),
             (7, "again", texts[6], "x"), (5, "again", texts[4], "x")]
    rng.shuffle(rows)
    return rows


def read(spark, path):
    return sorted((tuple(r) for r in warc.read_back(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_read_back_equals_brute_force(spark):
    rows = odd_pages()
    path = warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert read(spark, path) == brute(rows)
    assert sorted(((r[0], r[1]) for r in warc.pages(spark, path).collect()), key=str) == sorted(
        ((p, h or "") for p, _, h, _ in rows), key=str)
    # Each payload of enough bytes lies there once.
    stored = spark.read.parquet(f"{path}/payloads").count()
    assert stored == len({h for _, _, h, _ in rows if h and len(h.encode()) >= warc.LEAST})


def test_large_group_and_repeated_rows(spark):
    rows = [(i, "u", "same page " * 30, "x") for i in range(900)] + [(3, "u", "same page " * 30, "x")] * 2 + [
        (i, "u", f"{i % 400} " * 60, "x") for i in range(1000, 1800)]
    path = warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert read(spark, path) == brute(rows)


def test_empty(spark):
    path = warc.archive(spark.createDataFrame([], SCHEMA))
    assert read(spark, path) == [] and warc.pages(spark, path).count() == 0


def test_join_moves_no_payloads(spark):
    path = warc.archive(spark.createDataFrame(odd_pages(), SCHEMA))
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.records(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_damage_is_an_error(spark):
    path = warc.archive(spark.createDataFrame([(1, "u", "good " * 40, "x")], SCHEMA))
    payloads, responses, others = warc._opened(spark, path)
    bad = payloads.withColumn("body", F.lit(b"bad"))
    with pytest.raises(Exception, match="damaged payload"):
        responses.join(warc._verified(bad), "digest").collect()


def test_digest_of_two_payloads_is_an_error(spark):
    named = spark.createDataFrame([(1, 1, 200, 5, bytearray(b"d")), (2, 2, 200, 6, bytearray(b"d"))],
                                  "page_id long, row long, n_bytes long, second long, digest binary")
    with pytest.raises(Exception, match="different payloads"):
        warc._firsts(named).collect()


def test_exported_files_are_warc(spark, tmp_path):
    rows = [r for r in odd_pages() if r[2] and " " not in r[2]]
    path = warc.archive(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    warc.export(spark, path, str(tmp_path / "out"))
    data = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "out").glob("part-*")))
    got, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end].decode()
        assert head.startswith("WARC/1.1\r\n")
        size = int(head.split("Content-Length: ")[1].split("\r\n")[0])
        block = data[end:end + size]
        assert data[end + size:end + size + 4] == b"\r\n\r\n"
        got.append(block.split(b"\r\n\r\n", 1)[1] if block else None)
        at = end + size + 4
    assert len(got) == len(rows)
    want = {}
    for p, _, h, _ in rows:
        want.setdefault(h.encode(), []).append(p)
    assert sorted(b for b in got if b is not None) == sorted(
        b for b, ids in want.items() for _ in range(1 if len(b) >= warc.LEAST else len(ids)))
