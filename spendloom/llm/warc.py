"""WARC archives: writing captures, and assembling them again from their records.

A page is captured as three records: a request, a response (or a revisit, if a response with the same payload
exists) and a metadata record. Response and metadata name the request in WARC-Concurrent-To. Reading takes
the records of any archive apart by their Content-Length and joins those that name the same request into one
nested row per capture.

Archives are gzip files written by Spark's own text writer (the record separator is its line separator), so they
reach any store, and a lost executor leaves no half-written archive behind.

Defined cases: null html is an empty payload; a null page_id is the smallest, and its field is left out. Of
rows with equal payload all those with the largest page_id are responses (so repeated rows stay responses),
the rest revisit them. A null url leaves out the target; white space and control characters in a url become %20.
Every row is a capture of its own, so repeated rows give repeated captures. No pages: no captures. Other columns
are not looked at. When reading, records without partners give captures with null parts.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm.common import checkpointed

CAPTURED_AT = "2025-01-01T00:00:00Z"
#: Three records each; a task reads one archive at a time.
CAPTURES_PER_ARCHIVE = 2000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Five hexadecimal digits are four base32 characters."""
    hexed = F.sha1(payload.cast("binary"))
    groups = [F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    digits = [F.shiftright(g, shift).bitwiseAND(31) + 1 for g in groups for shift in (15, 10, 5, 0)]
    return F.concat(*[F.substring(F.lit(BASE32), d, F.lit(1)) for d in digits])


def urn(key: Column) -> Column:
    """A record id made from a hash of 32 hexadecimal digits."""
    parts = [F.substring(key, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def captures(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """page_id, url, payload, n_bytes, digest, record_type, refers_to. Only payloads of at least `smallest` bytes are revisited."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    read = read.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("same", F.sha2(F.col("payload").cast("binary"), 256))
    groups = read.filter(F.col("n_bytes") >= smallest).groupBy("same").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
    # written out, so that the join below deals both sides anew and Spark can split the rows of a frequent payload
    heads = checkpointed(groups.filter("n > 1 AND head IS NOT NULL").select(F.col("same").alias("head_of"), "head"))
    joined = read.join(heads, read["same"] == heads["head_of"], "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "n_bytes",
        base32_sha1(F.col("payload")).alias("digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("head")).alias("refers_to"),
        F.md5(F.concat_ws("|", F.col("same"), F.when(revisit, F.col("head")).otherwise(F.col("page_id")).cast("string"))).alias("response_key"),
    )


def record(kind: Column, record_id: Column, url: Column, block: Column, content_type: str, extra: list[Column]) -> Column:
    """One record; a null line is left out."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {CAPTURED_AT}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, r"[\x00-\x20]", "%20")),
        *extra,
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write(pages: DataFrame, folder: str, smallest: int = 0) -> None:
    """Writes the captures of pages as gzip archives into folder, which must not exist."""
    named = captures(pages, smallest).withColumn("request_id", urn(F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))))
    is_revisit = F.col("record_type") == "revisit"
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), F.col("request_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    path = F.regexp_replace(F.coalesce(F.regexp_extract("url", r"^[^/]*//[^/]*(/.*)$", 1), F.lit("")), r"[\x00-\x20]", "%20")
    request = record(F.lit("request"), F.col("request_id"), F.col("url"), F.concat(F.lit("GET /"), F.ltrim(path, F.lit("/")), F.lit(" HTTP/1.1"), F.lit(END)), "application/http; msgtype=request", [])
    response = record(
        F.col("record_type"),
        F.when(is_revisit, urn(F.md5("request_id"))).otherwise(urn(F.col("response_key"))),
        F.col("url"),
        F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload"))),
        "application/http; msgtype=response",
        [
            concurrent,
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
            F.when(is_revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("response_key")))),
        ],
    )
    fields = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("refers-to-page-id: "), F.col("refers_to").cast("string")))
    about = record(F.lit("metadata"), urn(F.md5(F.concat(F.col("request_id"), F.lit("metadata")))), F.col("url"), fields, "application/warc-fields", [concurrent])
    lines = named.select(F.explode(F.array(request, response, about)).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * CAPTURES_PER_ARCHIVE).text(folder)


NAMES = ["record_id", "warc_type", "concurrent_to", "refers_to", "target_uri", "payload_digest", "payload_bytes", "fields", "payload"]
KINDS = {"payload_bytes": "long", "fields": "map<string, string>", "payload": "binary"}


def headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse(archive: bytes) -> Iterator[tuple]:
    """The records of one archive (plain, or gzip of one or many members), with the payload last."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive))) if archive[:2] == b"\x1f\x8b" else io.BytesIO(archive)
    while first := stream.readline():
        if not first.strip():
            continue
        head = first
        while (line := stream.readline()).strip():
            head += line
        named = headers(head)
        block = stream.read(int(named.get("content-length", 0)))
        http, payload, fields = {}, None, {}
        if named.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = headers(top)
        elif named.get("content-type") == "application/warc-fields":
            fields = headers(b"\r\n" + block)
        whole = named.get("warc-type") == "response"
        n_bytes = len(payload) if whole and payload is not None else int(http["content-length"]) if "content-length" in http else None
        yield (
            named.get("warc-record-id"), named.get("warc-type"), named.get("warc-concurrent-to"), named.get("warc-refers-to"), named.get("warc-target-uri"),
            named.get("warc-payload-digest"), n_bytes, fields, payload if whole else None,
        )


def records(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in folder."""
    names = NAMES if with_payload else NAMES[:-1]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive in batch["content"]:
                out = []
                for row in parse(archive):
                    out.append(row[: len(names)])
                    if len(out) >= 1500:
                        yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})

    return spark.read.format("binaryFile").load(folder).select("content").mapInPandas(read, ", ".join(f"{n} {KINDS.get(n, 'string')}" for n in names))


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata that name the same request."""
    parts = F.struct(*[found[c] for c in found.columns])
    of = lambda *kinds: F.first(F.when(F.col("warc_type").isin(*kinds), parts), ignorenulls=True)
    joined = found.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id"))
    return joined.agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))


def round_trip(pages: DataFrame, folder: str, smallest: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all captures, from the archives written."""
    write(pages, folder, smallest)
    got = assemble(records(pages.sparkSession, folder))
    field = lambda name: F.col("metadata.fields")[name].cast("long")
    return got.select(
        field("page-id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.regexp_replace("response.payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        field("refers-to-page-id").alias("refers_to"),
    )
