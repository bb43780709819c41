"""Operator 5, WARC: a content-addressed archive with exact record headers, read back through a join."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.common import shared_folder, written

#: Fixed values of the record format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MARK = b"WARC/1.1\r\nWARC-Type: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a payload's SHA-1: eight groups of 20 bits, four letters each."""

    def letters(digest: Column) -> Column:
        groups = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
        return F.concat(*[F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for v in groups for s in (15, 10, 5, 0)])

    return F.transform(F.array(F.sha1(payload)), letters)[0]  # so that the digest is computed once


def _field(name: str, form: str = "([^\r\n]*)") -> Column:
    """A field of a head. Lines end with CR LF alone: a url can hold any other character that some take for a line's end."""
    return F.regexp_extract("head", f"\r\n{name}: {form}\r\n", 1)


def write_archive(
    pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> None:
    """Write one WARC record per row: ``path/payloads`` (digest, payload) and ``path/headers`` (page_id, digest, head).

    Payloads of at least ``min_bytes`` bytes that are equal (SHA-256) are stored once; the record with the largest
    page_id is the response and the others revisit it. Copies are merged in each task before the shuffle, so a payload
    of a third of all rows moves once per task, and only digests and urls are joined. Two payloads of one digest that
    differ stop the job. Every record has an id of its own, of its page and its row. A null html is an empty payload, a
    null url leaves its header out (line breaks in urls are percent-encoded), a record without id is never revisited,
    repeated rows are records of one kind, an empty table makes an empty archive.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    stored = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"),
        F.min(F.struct(F.xxhash64("payload"), F.length("payload"))).alias("_a"),
        F.max(F.struct(F.xxhash64("payload"), F.length("payload"))).alias("_b"),
    )
    same = F.when(F.expr("_a = _b"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("binary"))
    stored.select("digest", same.alias("payload")).write.parquet(f"{path}/payloads")
    narrow = rows.select("page_id", "url", "digest", F.octet_length("payload").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"), F.monotonically_increasing_id().alias("number"))
    narrow = written(narrow, "records")
    first = narrow.filter((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max(F.struct("page_id", "number")).alias("k"))
    # both sides of the join are tables, so that a payload of very many pages can be split
    facts = narrow.join(written(first.select("digest", F.col("k.page_id").alias("keeper"), F.col("k.number").alias("keeper_number")), "keepers"), "digest", "left")
    revisit = F.expr("keeper is not null and page_id is distinct from keeper")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("number"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("keeper"), F.lit(":"), F.col("keeper_number"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.lit(len(HTTP_HEAD)) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.lit("\r\n"),
    )
    facts.select("page_id", "digest", head.alias("head")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: page_id, record_type, refers_to, digest, head, declared_sha1, payload (null for revisits) and record.

    Responses are joined with their payloads, one to one, and each payload's digest is computed anew; another digest
    or a response without payload stops the job. ``record`` holds the record's exact bytes.
    """
    heads = spark.read.parquet(f"{path}/headers").withColumns(
        {"record_type": _field("WARC-Type"), "refers_to": _field("WARC-Refers-To", "<urn:page:([^:\r\n]*):[0-9]+>"), "declared_sha1": F.substring(_field("WARC-Payload-Digest"), 6, 99)}
    )
    store = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.expr("digest = unhex(sha2(payload, 256))"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload is missing or damaged")).cast("binary"))
    full = heads.filter("record_type = 'response'").join(store, "digest", "left").withColumn("payload", checked)
    rest = heads.filter("record_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary"))
    block = F.concat(F.col("head").cast("binary"), F.lit(HTTP_HEAD).cast("binary"), F.coalesce("payload", F.lit("").cast("binary")), F.lit("\r\n\r\n").cast("binary"))
    records = full.unionByName(rest)
    return records.select(
        "page_id", "record_type", F.when(F.col("refers_to") != "", F.col("refers_to").cast("bigint")).alias("refers_to"),
        "digest", "head", "declared_sha1", "payload", block.alias("record"),
    )


def page_facts(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest (of the full payload, also for revisits), record_type, refers_to.

    Both are read from the bytes of the rebuilt record: what follows its head and the HTTP head, up to the two line ends.
    The head's length and digest must say the same. A revisit takes both from the response with its payload, and its own
    header must declare the same digest.
    """
    lead = F.octet_length("head") + len(HTTP_HEAD.encode())
    parsed = records.filter("record_type = 'response'").withColumn("body", F.substr("record", lead + 1, F.octet_length("record") - lead - 4))
    found = parsed.select(
        "page_id", F.octet_length("body").cast("long").alias("payload_bytes"), base32_sha1(F.col("body")).alias("payload_digest"),
        "record_type", "refers_to", "digest", "declared_sha1", _field("Content-Length").cast("long").alias("length"),
    )
    right = F.expr(f"length = payload_bytes + {len(HTTP_HEAD.encode())} and declared_sha1 = payload_digest")
    found = found.withColumn("payload_digest", F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's head doesn't fit its payload")).cast("string")))
    found = written(found, "responses")
    once = written(found.groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")), "payload-facts")
    rest = records.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "digest", "declared_sha1").join(once, "digest", "left")
    agreed = F.when(F.expr("declared_sha1 = payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit declares another digest")).cast("string"))
    rest = rest.withColumn("payload_digest", agreed)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.select(*names).unionByName(rest.select(*names))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write an archive of ``pages`` in the shared folder and give the facts read back from it."""
    path = shared_folder(pages.sparkSession, "archive")
    write_archive(pages, path)
    return page_facts(read_archive(pages.sparkSession, path))


def export_warc(records: DataFrame, path: str) -> None:
    """Write the records as .warc.gz files: each row is a record, and the writer's line end is the one between records.

    A file is one gzip stream, as Spark's writer makes it. ``import_warc`` reads them back. Empty payloads are records
    with the HTTP head alone, revisits have no payload, repeated rows are written as often; no records make no files.
    """
    block = F.concat("head", F.lit(HTTP_HEAD), F.coalesce(F.col("payload").cast("string"), F.lit("")))
    records.select(block).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _declared(head: bytes) -> int:
    found = re.search(rb"\r\nContent-Length: ([0-9]+)\r\n", head)
    if found is None:
        raise ValueError("a record's head has no length")
    return int(found[1])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads and blocks of the records of whole files, from pieces of text that begin after the format's mark.

    Where a piece is shorter than its head declares, the mark stood in the payload, and the next piece goes on with it.
    A task holds one record and one batch.
    """
    at, held, lead, whole = None, None, 0, -1

    for b in batches:
        heads, blocks = [], []
        for file, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if file != at:
                if held is not None or piece:
                    raise ValueError("a file begins or ends inside a record")
                at = file
                continue
            if held is None:
                held, whole = bytearray(piece.encode()), -1
            else:
                held += MARK + piece.encode()
            if whole < 0 and (lead := held.find(b"\r\n\r\n")) >= 0:
                whole = lead + 8 + _declared(b"\r\nWARC-Type: " + held[: lead + 2])
            if 0 <= whole < len(held) or whole == len(held) and not held.endswith(b"\r\n\r\n"):
                raise ValueError("a record isn't as long as its head declares")
            if whole == len(held):
                heads.append((b"\r\nWARC-Type: " + held[: lead + 2]).decode())
                blocks.append(bytes(held[lead + 4 : -4]))
                held = None
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(blocks, pa.binary())], ["head", "block"])
    if held is not None:
        raise ValueError("a file begins or ends inside a record")


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of exported files: record_id, record_type, refers_to (a record_id), declared_sha1 and payload (null for revisits).

    Records are cut by the length that their heads declare, so a payload can hold the format's own mark. A gzip file is
    read by one task, record by record. A damaged file stops the reading; empty payloads are empty, repeated records
    come as often as they were written, and a folder of empty files gives no rows.
    """
    files = spark.read.text(path, lineSep=MARK.decode()).select(F.col("_metadata.file_path").alias("file"), "value")
    found = files.mapInArrow(_cut, "head string, block binary")
    kind, refers, lead = _field("WARC-Type"), _field("WARC-Refers-To"), len(HTTP_HEAD.encode())
    payload = F.substr("block", F.lit(lead + 1), F.octet_length("block") - lead)
    return found.select(
        _field("WARC-Record-ID").alias("record_id"), kind.alias("record_type"), F.when(refers != "", refers).alias("refers_to"),
        F.substring(_field("WARC-Payload-Digest"), 6, 99).alias("declared_sha1"), F.when(kind == "response", payload).alias("payload"),
    )
