"""A content-addressed web archive.

Two tables: ``payloads`` holds the bytes of every distinct payload once, by SHA-256 and
length; ``records`` holds the exact header bytes of every WARC record with the address of
its payload.  A join puts the original records together again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddledger.llm.sampling import BROADCAST_ROWS
from oddledger.session import scratch, staged

# fixed values of WARC 1.1
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """Paths of a written archive."""

    records: str
    payloads: str

    def read_records(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("address binary, header binary").parquet(self.records)

    def read_payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("address binary, payload binary").parquet(self.payloads)


def _uuid(page_id: Column) -> Column:
    h = F.sha2(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary"), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is null is left out."""
    return F.concat(
        F.lit("WARC/1.1" + END),
        *[
            F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))
            for name, value in fields
        ],
        F.lit(END),
    )


def _one_line(text: Column) -> Column:
    """Control characters may not stand in a header value."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]+", " ")


def _known(page_id: Column) -> Column:
    """A null page_id comes before all others."""
    return F.coalesce(page_id, F.lit(-(2**63)))


def addressed(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, size, sha1, address) of every page; null html is empty."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), payload.alias("payload"))
    size = F.octet_length("payload").cast("long")
    return rows.select(
        "*",
        size.alias("size"),
        F.sha1("payload").alias("sha1"),
        F.unhex(F.concat(F.sha2("payload", 256), F.lpad(F.hex(size), 16, "0"))).alias("address"),
    )


def write(pages: DataFrame, least: int = 1000, folder: str | None = None) -> Archive:
    """Archive ``pages`` (page_id, url, html).

    Of records with equal payloads of at least ``least`` bytes the one with the largest
    page_id is a response, the others are revisits of it; smaller ones are all responses.
    Rows that share that page_id are all responses; a null page_id is a revisit where
    another record has the payload, else a response.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "archive")
    archive = Archive(f"{folder}/records", f"{folder}/payloads")
    rows = addressed(pages)
    facts = staged(rows.drop("payload"), "addresses")
    copies = staged(
        facts.groupBy("address")
        .agg(
            F.max("page_id").alias("owner"),
            F.max(_known(F.col("page_id"))).alias("page"),
            F.max("size").alias("size"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("n > 1")
        .drop("n"),
        "copies",
    )
    # the join carries payloads, so a short table of copies had better come to them
    few = copies.count() <= BROADCAST_ROWS
    fit = F.broadcast if few else lambda side: side
    owners = copies.filter((F.col("size") >= least) & F.col("owner").isNotNull())
    marked = facts.join(fit(owners.select("address", "owner")), "address", "left").withColumn(
        "refers",
        F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")),
    )
    again = F.col("refers").isNotNull()
    kind = F.when(again, "revisit").otherwise("response")
    header = _lines(
        ("WARC-Type", kind),
        ("WARC-Record-ID", _uuid(F.col("page_id"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", _one_line(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Refers-To", F.when(again, _uuid(F.col("refers")))),
        ("WARC-Profile", F.when(again, PROFILE)),
        ("X-Page-ID", F.col("page_id").cast("string")),
        ("X-Refers-To-Page-ID", F.col("refers").cast("string")),
        ("X-Payload-Length", F.col("size").cast("string")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(again, "0").otherwise(F.col("size").cast("string"))),
    )
    marked.select("address", F.encode(header, "UTF-8").alias("header")).write.parquet(
        archive.records
    )
    # of each payload one page brings the bytes
    own = rows.select("address", "payload", _known(F.col("page_id")).alias("own"))
    if few:
        kept = own.join(F.broadcast(copies.select("address", "page")), "address", "left")
        kept = kept.filter("page is null or page = own")
        single = kept.filter("page is null").select("address", "payload")
        shared = kept.filter("page is not null").select("address", "payload")
        # rows may share that page_id as well
        stored = single.unionByName(shared.dropDuplicates(["address"]))
    else:
        # the pages of a common payload differ, so no task gets all its copies
        first = facts.groupBy("address").agg(F.max(_known(F.col("page_id"))).alias("own"))
        stored = own.join(first, ["address", "own"]).select("address", "payload").dropDuplicates(["address"])
    stored.write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def verified(archive: Archive, spark: SparkSession) -> DataFrame:
    """(address, payload, size, sha1) of the stored payloads; bytes that do not give
    their address any more fail the job."""
    stored = archive.read_payloads(spark)
    size = F.octet_length("payload").cast("long")
    proof = F.unhex(F.concat(F.sha2("payload", 256), F.lpad(F.hex(size), 16, "0")))
    return stored.select(
        "address",
        F.when(proof == F.col("address"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary"))
        .alias("payload"),
        size.alias("size"),
        F.sha1("payload").alias("sha1"),
    )


def field(header: Column, name: str) -> Column:
    """Value of a header line, null where there is none."""
    value = F.regexp_extract(header.cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def _page_facts(records: DataFrame) -> list[Column]:
    head = F.col("header")
    return [
        field(head, "X-Page-ID").cast("long").alias("page_id"),
        field(head, "WARC-Type").alias("record_type"),
        field(head, "X-Refers-To-Page-ID").cast("long").alias("refers_to"),
    ]


def records(archive: Archive, spark: SparkSession) -> DataFrame:
    """The archived records: page_id, record_type, refers_to, record (the bytes of the
    WARC record), payload (the full payload, of revisits too)."""
    joined = archive.read_records(spark).join(verified(archive, spark), "address", "left")
    revisit = field(F.col("header"), "WARC-Type") == "revisit"
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        *_page_facts(joined),
        F.concat("header", body, F.lit((END * 2).encode())).alias("record"),
        "payload",
    )


def index(archive: Archive, spark: SparkSession) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    All of it comes from the records put together again: the fields from a record's own
    header, length and digest from its payload.
    """
    whole = records(archive, spark)
    text = F.col("record").cast("string")
    head = whole.withColumn("header", F.substr(text, F.lit(1), F.instr(text, END * 2) + 3))
    page_id, kind, refers = _page_facts(head)
    return head.select(
        page_id,
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        kind,
        refers,
    )


def export(archive: Archive, spark: SparkSession, folder: str) -> None:
    """Write the records as gzipped WARC files; payloads must be text in UTF-8."""
    record = records(archive, spark).select(
        F.expr("decode(substring(record, 1, length(record) - 4), 'UTF-8')").alias("value")
    )
    record.write.option("lineSep", END * 2).option("compression", "gzip").text(folder)
