"""WARC archives: written by Spark's text sink, read back with boundary-chain verification.

Writing: one record a page, duplicates of a payload become revisits of the page with the largest id.
Every task writes one archive through Spark's committer, to any file system Spark reaches.

Reading: the text source splits archives at the bytes CR LF CR LF "WARC/1.", so tasks emit candidate
records. Lengths summed per archive give offsets; each candidate's Content-Length gives its
successor's offset. Chains of candidates in which each is followed by its successor shrink to one
node; pointer jumping over the nodes from offset 0 keeps what the archive's start reaches. Magic inside
a payload is not reached: its bytes go back to the record around it. Windows are per archive and hold a
few numbers a record, not payloads.

Nulls: a null html is an empty payload, a null url an empty one, a null page_id comes back as null
and ranks below all others. Repeated rows give repeated records; among them all with the largest id are responses. An
empty table gives empty archives and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, stash, table

CRLF2 = "\r\n\r\n"
MAGIC = "WARC/1."
SENT = 500_000  #: digests with several pages that may be sent to all executors (about 50 bytes each); beyond it they are joined by shuffle
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload):
    """Bare upper-case base-32 SHA-1 of a binary column."""
    h = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[part(i) for i in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    """Archives of the pages under path. Payloads of fewer than `least` bytes are never revisits."""
    html = F.coalesce(F.col(payload_col), F.lit(""))
    p = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "").alias("url"), html.alias("html"))
    p = p.withColumn("size", F.octet_length("html")).withColumn("digest", digest32(F.col("html").cast("binary")))
    tops = stash(p.where(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top"))
    if tops.count() <= SENT:
        tops = F.broadcast(tops)
    p = p.join(tops, "digest", "left").withColumn("top", F.when(F.col("size") >= least, F.col("top")))
    again = F.coalesce(F.col("top").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("top"))), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(CRLF2))
    block = F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit(f"{MAGIC}1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("size"), F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("top")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block, F.lit(CRLF2))
    p.select(F.concat(head, http, F.when(again, "").otherwise(F.col("html"))).alias("value")).write.option("lineSep", CRLF2).text(path)


def _parsed(d: DataFrame) -> DataFrame:
    """Header fields of `value`, a record without the bytes before its version; `own`: its length fits."""
    one, two = F.substring_index("value", CRLF2, 1), F.substring_index("value", CRLF2, 2)
    d = d.withColumn("size", F.octet_length("value")).withColumn("head", F.when(F.octet_length(one) < F.col("size"), one)).withColumn("h", F.octet_length("head")).withColumn("t", F.octet_length(two))
    field = lambda name, what: F.nullif(F.regexp_extract("head", rf"(?i)\r\n{name}: *{what}", 1), F.lit(""))
    d = d.withColumn("prefixed", F.col("value").startswith(MAGIC))
    ok = F.col("head").rlike(r"^(WARC/1\.)?[01](\r\n|$)")
    d = d.withColumn("length", F.when(ok, field("Content-Length", r"([0-9]{1,15})").cast("long")))
    d = d.withColumn("type", field("WARC-Type", r"(\w+)")).withColumn("page_id", field("WARC-Record-ID", r"<urn:page:(-?[0-9]+)>").cast("long"))
    d = d.withColumn("refers_to", field("WARC-Refers-To", r"<urn:page:(-?[0-9]+)>").cast("long")).withColumn("url", F.coalesce(field("WARC-Target-URI", r"([^\r\n]*)"), F.lit("")))
    d = d.withColumn("stated", field("WARC-Payload-Digest", r"sha1:([A-Z2-7]+)")).withColumn("stated_bytes", field("X-Payload-Length", r"([0-9]{1,15})").cast("long"))
    d = d.withColumn("own", F.coalesce((F.col("h") + 4 + F.col("length") == F.col("size")) | (F.col("h") + 8 + F.col("length") == F.col("size")), F.lit(False)))
    full = F.col("own") & (F.col("type") != "revisit")
    body = F.substring(F.col("value").cast("binary"), F.col("t") + 5, (F.col("length") - (F.col("t") - F.col("h"))).cast("int"))
    d = d.withColumn("bytes", F.when(full, F.octet_length(body).cast("long"))).withColumn("digest", F.when(full, digest32(body)))
    return d.drop("head")


FIELDS = ["type", "page_id", "refers_to", "url", "stated", "stated_bytes", "bytes", "digest"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact) of every record the
    archives' starts reach. intact: the payload has the stated digest (null for revisits)."""
    raw = spark.read.option("lineSep", CRLF2 + MAGIC).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    raw = raw.withColumn("hash", F.xxhash64("value"))
    c = _parsed(raw).drop("value")
    c = stash(c)
    order = W.partitionBy("file").orderBy("block", "at")
    step = len(CRLF2 + MAGIC)
    c = c.withColumn("no", F.row_number().over(order)).withColumn("content", F.coalesce(F.sum(F.col("size") + step).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    lead7 = F.when(F.col("no") == 1, 0).otherwise(len(MAGIC))
    c = c.withColumn("r", F.col("content") - lead7).withColumn("length", F.when((F.col("no") == 1) == F.col("prefixed"), F.col("length")))
    c = c.withColumn("next", F.col("r") + lead7 + F.col("h") + F.col("length") + 8)
    c = c.withColumn("follows", F.coalesce(F.lag("next").over(order) == F.col("r"), F.lit(False))).withColumn("leads", F.coalesce(F.col("next") == F.lead("r").over(order), F.lit(False)))
    c = stash(c)
    hit = c.where("NOT leads AND next IS NOT NULL").select("file", F.col("next").alias("r")).distinct().withColumn("hit", F.lit(True))
    c = c.join(hit, ["file", "r"], "left").withColumn("first", (~F.col("follows") | F.coalesce("hit", F.lit(False))).cast("int"))
    by_r = W.partitionBy("file").orderBy("r")
    c = stash(c.withColumn("run", F.sum("first").over(by_r)).drop("hit", "first"))
    runs = stash(c.groupBy("file", "run").agg(F.min("r").alias("a"), F.max(F.struct("r", "next")).alias("z")).select("file", "run", "a", F.col("z.next").alias("b")))
    most = runs.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    reached = runs.where("a = 0").select("file", "a")
    jump = runs.where("b IS NOT NULL AND b > a").select("file", "a", "b")
    hops = 1
    while hops < most:  # after k rounds every node within 2^k hops is reached
        got = reached.join(jump, ["file", "a"]).select("file", F.col("b").alias("a"))
        reached = reached.union(got).distinct().checkpoint()
        jump = jump.join(jump.select("file", F.col("a").alias("b"), F.col("b").alias("c")), ["file", "b"]).select("file", "a", F.col("c").alias("b")).checkpoint()
        hops *= 2
    alive = runs.join(reached, ["file", "a"], "left_semi").select("file", "run").withColumn("alive", F.lit(True))
    c = c.join(alive, ["file", "run"], "left").withColumn("alive", F.coalesce("alive", F.lit(False)) & F.col("length").isNotNull())
    c = stash(c.withColumn("owner", F.last(F.when(F.col("alive"), F.col("r")), True).over(by_r)))
    whole = c.where("alive AND own")
    broken = c.where("alive AND NOT own").select("file", "r", F.col("next").alias("until"))
    # a fragment inside a payload may look like a record of its own: its text was not kept above. It is found again by its
    # content, as row numbers depend on how the files are split, which may have changed; equal fragments have the same text
    joined = None
    if broken.limit(1).count():
        wanted = c.select("file", "owner", F.col("r").alias("from"), "size", "hash").join(broken.withColumnRenamed("r", "owner"), ["file", "owner"]).where(F.col("from") < F.col("until"))
        wanted = stash(wanted.select("file", "owner", "from", "size", "hash"))
        kinds = wanted.select("file", "size", "hash").distinct()
        texts = raw.withColumn("size", F.octet_length("value")).join(F.broadcast(kinds) if wanted.count() <= SENT else kinds, ["file", "size", "hash"], "left_semi")
        texts = texts.groupBy("file", "size", "hash").agg(F.min("value").alias("value"))
        again = wanted.join(texts, ["file", "size", "hash"])
        text = again.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("from", "value"))).alias("v"))
        joined = _parsed(text.select(F.array_join("v.value", CRLF2 + MAGIC).alias("value")))
    out = whole.select(*FIELDS)
    if joined is not None:
        out = out.union(joined.where("own").select(*FIELDS))
    return out.select(
        "page_id", "url", F.col("type").alias("record_type"), "refers_to", F.coalesce("bytes", "stated_bytes").alias("payload_bytes"), F.coalesce("digest", "stated").alias("payload_digest"), (F.col("digest") == F.col("stated")).alias("intact"))


def op4_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc_roundtrip": op4_warc_roundtrip}
SQL = {"op4_warc_roundtrip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p),
r AS (SELECT *, coalesce(page_id IS NULL AND top IS NOT NULL OR page_id < top, false) AS again FROM t)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(x, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))::INT & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to
FROM r
"""}
