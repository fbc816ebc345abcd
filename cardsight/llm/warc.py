"""Operator 13: a content-addressed WARC archive (DataFrame functions only).

Writing. A page becomes one WARC record whose payload is its html. Payloads are known
by their SHA-256. Of the records with equal payloads of at least ``LEAST`` bytes, the one
with the smallest page id is the response; the others are revisits that refer to it. The
archive is a folder of three tables:

* ``payloads``: the bytes of every such payload, once, under their digest;
* ``responses``: the exact headers of the records whose payload lies there;
* ``others``: the exact headers of revisits, which have no payload of their own, and the
  records with smaller payloads, whole.

The first two are bucketed and sorted by digest, so that putting records together again
joins bucket with bucket and moves no bytes.

Digests are verified. On the way in, a digest whose rows differ in length or in a second
hash is an error, not one payload. On the way out, bytes whose SHA-256 is not the digest
that they lie under are an error.

Reading. ``records`` joins headers and payloads to the original bytes of each record,
``parse`` takes records apart again, from their bytes alone, and ``pages`` looks up the
full payload of every page, that of the response for a revisit. ``export`` writes plain
WARC files.

A payload that many pages share is no hot key. At most ``1 / HOT_SHARE`` digests can hold
more than that share of all rows; these few are broadcast with their response.
Everything else is joined by shuffles in which no digest has more than that share. The
bytes of copies are put together in each task before they are shuffled.

Defined results: a null html is the empty payload; of rows that share page id and payload
one is the response (null ids come last), and the others refer to it; an empty table gives an empty archive; line
breaks in urls are written as %0D and %0A; a null url has no target line; other columns
are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsight.llm.common import shared_table
from cardsight.session import checkpoint_dir

LEAST = 100            # bytes from which a payload is stored under its digest
HOT_SHARE = 1 / 1000   # a digest that holds a greater share of the rows is joined by broadcast
DATE = "2000-01-01T00:00:00Z"

CRLF = "\r\n"
_END = CRLF + CRLF


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))


def _record_id(page: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"),
                    row.cast("string"), F.lit(">"))


def _named(pages: DataFrame) -> DataFrame:
    """page_id, url, row, digest, n_bytes, second and (if it is small) body of all pages."""
    body = _body()
    n = F.octet_length(body)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.monotonically_increasing_id().alias("row"), _digest(body).alias("digest"),
                        n.cast("long").alias("n_bytes"), F.xxhash64(body).alias("second"),
                        F.when(n < LEAST, body).alias("body"))


def _body() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def _digest(body: Column | str) -> Column:
    return F.unhex(F.sha2(body, 256))


def _firsts(named: DataFrame) -> DataFrame:
    """digest, first (page_id and row of the response), n_rows of the payloads to store; verified."""
    same = (F.min("n_bytes") == F.max("n_bytes")) & (F.min("second") == F.max("second"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    return (named.where(F.col("n_bytes") >= LEAST).groupBy("digest")
            .agg(F.min(order).alias("first"), F.count("*").alias("n_rows"), same.alias("same"))
            .select("digest", F.col("first.page_id").alias("first_page"), "n_rows",
                    F.when(F.col("same"), F.col("first.row")).otherwise(
                        F.raise_error(F.lit("different payloads have one digest"))).alias("first_row")))


def _join_by_digest(left: DataFrame, facts: DataFrame, hot: DataFrame) -> DataFrame:
    """``left`` with the columns of ``facts`` (one row per digest): hot digests by broadcast, the others by shuffle."""
    cold = facts.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    marked = left.join(F.broadcast(hot.select("digest", F.lit(True).alias("is_hot"))), "digest", "left")
    warm = marked.where("is_hot").drop("is_hot").join(
        F.broadcast(facts.join(F.broadcast(hot.select("digest")), "digest", "left_semi")), "digest")
    return warm.unionByName(marked.where("is_hot is null").drop("is_hot").join(cold, "digest"))


def _header(kind: str, n_bytes: Column) -> Column:
    """The exact header block of a record, with the blank line that ends it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF), _line(
        "Content-Length", n_bytes.cast("string")), F.lit(CRLF))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [F.lit("WARC/1.1" + CRLF), _line("WARC-Type", F.lit(kind)),
             _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"))), _line("WARC-Target-URI", url),
             _line("WARC-Date", F.lit(DATE)),
             _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))))]
    if kind == "revisit":
        return F.concat(*lines, _line("WARC-Profile", F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _line("WARC-Refers-To", _record_id(F.col("first_page"), F.col("first_row"))),
            _line("Content-Length", F.lit("0")), F.lit(CRLF))
    return F.concat(*lines, _line("Content-Type", F.lit("application/http; msgtype=response")),
                    _line("Content-Length", (F.octet_length(http) + n_bytes).cast("string")), F.lit(CRLF), http)


def _table(spark: SparkSession, path: str, name: str, columns: str, buckets: int) -> DataFrame:
    """The bucketed table at ``path/name``, under a name of its own in the session's catalog."""
    known = f"warc_{name}_{uuid.uuid4().hex}"
    place = f"{path}/{name}".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
              f"INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(known)


def _write_bucketed(df: DataFrame, path: str, name: str, buckets: int) -> None:
    (df.write.format("parquet").option("compression", "zstd").option("path", f"{path}/{name}")
       .bucketBy(buckets, "digest").sortBy("digest").saveAsTable(f"warc_new_{name}_{uuid.uuid4().hex}"))


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Write one record per row of ``pages`` (page_id, url, html); the archive's folder.

    The folder lies under the shared checkpoint folder unless ``path`` names another one.
    """
    spark = pages.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: what is told from a row, its number above all, must not change between the tables below.
    named = shared_table(_named(pages))
    firsts = shared_table(_firsts(named))
    hot = firsts.where(F.col("n_rows") > F.lit(HOT_SHARE * named.count()))

    # One copy of each payload's bytes; copies within a task are put together before the shuffle.
    body = _body()
    bodies = pages.select(body.alias("body")).where(F.octet_length("body") >= LEAST).select(_digest("body").alias("digest"), "body")
    _write_bucketed(bodies.groupBy("digest").agg(F.first("body").alias("body")), path, "payloads", buckets)

    n = F.col("n_bytes")
    big = _join_by_digest(named.where(n >= LEAST), firsts.drop("n_rows"), hot)
    first = F.col("row") == F.col("first_row")
    _write_bucketed(big.where(first).select("digest", "row", _header("response", n).cast("binary").alias("header"))
                    .repartition(buckets, "digest"), path, "responses", buckets)
    revisits = big.where(~first).select(F.col("digest"), "row", _header("revisit", n).cast("binary").alias("header"),
                                        F.lit(None).cast("binary").alias("body"))
    small = named.where(n < LEAST).select("digest", "row", _header("response", n).cast("binary").alias("header"), "body")
    revisits.unionByName(small).write.option("compression", "zstd").parquet(f"{path}/others")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")
    return path


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    others = spark.read.schema("digest binary, row long, header binary, body binary").parquet(f"{path}/others")
    return (_table(spark, path, "payloads", "digest BINARY, body BINARY", buckets),
            _table(spark, path, "responses", "digest BINARY, row BIGINT, header BINARY", buckets), others)


def _verified(payloads: DataFrame) -> DataFrame:
    """The payloads whose bytes have the digest that they lie under; any other is an error."""
    body = F.when(_digest("body") == F.col("digest"), F.col("body")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.hex("digest"))).cast("binary"))
    return payloads.select("digest", body.alias("body"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """row and record: the original bytes of every record, headers joined to their payloads."""
    payloads, responses, others = _opened(spark, path)
    joined = responses.join(_verified(payloads), "digest").select("row", "header", "body")
    whole = joined.unionByName(others.select("row", "header", F.coalesce("body", F.lit(b"")).alias("body")))
    return whole.select("row", F.concat("header", "body", F.lit(_END).cast("binary")).alias("record"))


def parse(found: DataFrame) -> DataFrame:
    """Records taken apart from their bytes: row, page_id, record_type, digest, refers_to, payload (null for revisits)."""
    text = F.col("record").cast("string")
    head = F.substring_index(text, _END, 1)

    def of(name: str, pattern: str) -> Column:
        got = F.regexp_extract(F.col("head"), f"(?:^|\\r\\n){name}: {pattern}\\r\\n", 1)
        return F.when(got != "", got)

    # A response's payload lies behind the second blank line (that of its HTTP headers).
    start = F.octet_length(F.substring_index(text, _END, 2)) + len(_END)
    size = F.octet_length("record") - start - len(_END)
    taken = found.select("row", F.concat(head, F.lit(CRLF)).alias("head"), F.substring(
        F.col("record"), start + 1, size).alias("rest"))
    kind = of("WARC-Type", "([a-z]+)")
    return taken.select("row", of("WARC-Record-ID", "<urn:page:(-?[0-9]*):[0-9]+>").cast("long").alias("page_id"),
                        kind.alias("record_type"), F.unhex(of("WARC-Payload-Digest", "sha256:([0-9a-f]+)")).alias("digest"),
                        of("WARC-Refers-To", "<urn:page:(-?[0-9]*):[0-9]+>").cast("long").alias("refers_to"),
                        F.when(kind == "response", F.col("rest")).alias("payload"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the archive alone.

    Size and digest are those of the full payload's bytes: the record's own, or for a
    revisit the bytes that are stored under its digest.
    """
    payloads, _, _ = _opened(spark, path)
    parsed = parse(records(spark, path)).select(
        "page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = parsed.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "digest")
    facts = payloads.select("digest", F.octet_length("body").cast("long").alias("payload_bytes"),
                            F.sha2("body", 256).alias("payload_digest"))
    return parsed.where("record_type = 'response'").select(*columns).unionByName(
        _join_by_digest(revisits, facts, _hot(revisits)).select(*columns))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id and html of every page, the payloads of revisits looked up under their digests."""
    payloads, _, _ = _opened(spark, path)
    parsed = parse(records(spark, path))
    html = F.col("payload").cast("string").alias("html")
    revisits = parsed.where("record_type = 'revisit'").select("page_id", "digest")
    return parsed.where("record_type = 'response'").select("page_id", html).unionByName(_join_by_digest(
        revisits, _verified(payloads).withColumnRenamed("body", "payload"), _hot(revisits)).select("page_id", html))


def _hot(rows: DataFrame) -> DataFrame:
    """The digests that hold more than ``HOT_SHARE`` of the rows: at most 1 / HOT_SHARE of them."""
    counts = shared_table(rows.groupBy("digest").agg(F.count("*").alias("n_rows")))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return counts.where(F.col("n_rows") > F.lit(HOT_SHARE * total))


def export(spark: SparkSession, path: str, to: str, compression: str = "gzip") -> None:
    """The archive as plain WARC files: each record ends in two line breaks, as the format has it."""
    (records(spark, path).select(F.expr("substring(cast(record as string), 1, char_length(cast(record as string)) - 4)"))
     .write.option("lineSep", _END).option("compression", compression).text(to))
