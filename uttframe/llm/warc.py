"""Content-addressed WARC archive: each payload once, by a verified strong digest; exact record headers beside them.

``write_archive`` makes two tables under one root: ``payloads`` (sha256, payload, and how many records have it) and
``records`` (exact WARC and HTTP header bytes, record type, sha256, ...). ``read_archive`` joins them into the original
records; the records of a payload that very many share are dealt to several tasks. Of the rows with equal payloads of at
least ``min_revisit_bytes`` bytes, the one with the largest id (then URL) is the response and the others revisit it. A null
payload counts as an empty one; a null id sorts first and stays null; a null URL becomes a urn. Of rows that agree in id,
URL and payload (the only ties), one is the first copy and the others revisit it. Very long payloads are rows like others:
one is held at a time, and twice where two differ. An empty table gives an empty archive. Other columns of the input,
whatever their names, are not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, materialise, spread_join, stage_path

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(hex40: Column) -> Column:
    """Upper-case base32 of 20 bytes given in hex: each 5 hex digits are 4 symbols."""
    five = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(hex40, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    symbols = F.transform(five, lambda v: F.concat(*[F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]))
    return F.array_join(symbols, "")


def _urn(*parts: Column) -> Column:
    h = F.sha1(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header(date: str) -> Column:
    """The exact bytes before the payload: WARC header, blank line, HTTP header, blank line."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))))
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", _urn(F.col("page_id"), F.col("url"), F.col("copy"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("first_id"), F.col("first_url"), F.lit(1)))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", block.cast("string")),
    ]
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)) for k, v in fields]  # null fields vanish
    return F.concat_ws("", F.lit(f"WARC/1.1{CRLF}"), *lines, F.lit(CRLF), http).cast("binary")


def write_archive(pages: DataFrame, root: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})

    one = rows.groupBy("sha256").agg(F.first("payload").alias("payload"), F.min(F.xxhash64("payload")).alias("h0"), F.max(F.xxhash64("payload")).alias("h1"), F.min("payload_bytes").alias("n0"), F.max("payload_bytes").alias("n1"), F.count("*").alias("n_records"))
    same = (F.col("h0") == F.col("h1")) & (F.col("n0") == F.col("n1"))
    one.select("sha256", F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payloads differ under digest "), F.col("sha256"))).cast("binary")).alias("payload"), "n_records").write.parquet(f"{root}/payloads")

    keyed = materialise(rows.groupBy("page_id", "url", "sha256", "sha1", "payload_bytes").agg(F.count("*").alias("copies")), "warc-rows")
    first = materialise(keyed.groupBy("sha256").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("m")), "warc-first")
    many = first.filter(F.col("m") > max(1_000, keyed.count() // HOT_KEYS)).select("sha256")
    records = spread_join(keyed, first.drop("m"), ["sha256"], many, F.xxhash64("page_id", "url")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    is_first = (F.struct("page_id", "url") == F.col("first")) & (F.col("copy") == 1)
    records = records.select(
        "page_id", "url", "copy", "sha256", "sha1", "payload_bytes", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"),
        F.when(is_first | (F.col("payload_bytes") < min_revisit_bytes), "response").otherwise("revisit").alias("record_type"),
    ).withColumn("header", _header(date))
    records.select("page_id", "header", "sha256", F.when(F.col("record_type") == "revisit", F.col("first_id")).alias("refers_to")).write.parquet(f"{root}/records")


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """page_id, refers_to, header, payload (also a revisit's) and record: the bytes that a WARC file would hold."""
    stored = spark.read.parquet(f"{root}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
    n_records = stored.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    many = stored.filter(F.col("n_records") > max(1_000, n_records // HOT_KEYS)).select("sha256")
    whole = spread_join(spark.read.parquet(f"{root}/records"), stored.select("sha256", sound.alias("payload")), ["sha256"], many, F.col("header"))
    body = F.when(record_type(F.col("header")) == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return whole.select("page_id", "refers_to", "header", "payload", F.concat("header", body, F.lit(CRLF * 2).cast("binary")).alias("record"))


def record_type(header: Column) -> Column:
    return F.regexp_extract(F.decode(header, "utf-8"), r"\r\nWARC-Type: (\w+)\r\n", 1)


def export_warc(archive: DataFrame, path: str, compression: str = "gzip") -> None:
    """Plain WARC files of the records, for payloads in UTF-8: the blank lines after a record are the writer's separator."""
    text = F.decode(F.expr("substring(record, 1, length(record) - 4)"), "utf-8")
    archive.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def query(pages: DataFrame) -> DataFrame:
    root = stage_path(pages.sparkSession, "warc")
    write_archive(pages, root)
    back = read_archive(pages.sparkSession, root)
    return back.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), record_type(F.col("header")).alias("record_type"), "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS s, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('{BASE32}', ((('0x' || substr(s, (k // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM h
"""
