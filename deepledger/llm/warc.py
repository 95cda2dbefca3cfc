"""WARC archives: written by the text sink, read back in splits by verifying chains of record borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deepledger.llm.common import cut, join_counted

MAGIC, CRLF = "WARC/1.0\r\n", "\r\n"
DATE = "2026-01-01T00:00:00Z"
#: Only equal payloads of at least so many bytes become revisits.
LEAST_BYTES = 100


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload, of at least LEAST_BYTES, has a smaller page_id elsewhere.

    The payloads stay where they are: only ids and digests are grouped and joined, and only digests that occur twice; the join
    has nothing after it that needs a key's rows together, so Spark may split a digest that a third of all pages share.
    """
    keyed = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).where(F.octet_length("payload") >= LEAST_BYTES)
    keyed = keyed.where("page_id is not null").select("page_id", F.sha2("payload", 256).alias("digest"))
    groups = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(groups, "digest").where("page_id != refers_to").select("page_id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str) -> None:
    """One record per row of (page_id, url, html), in as many archive files under path as there are partitions.

    A response holds an HTTP head and the payload, a revisit the head alone; the head's Content-Length is the payload's.
    Null html: empty. Null url: no target. Carriage returns and line feeds in a url are percent-encoded. Other columns are ignored.
    Repeated rows give repeated records. An empty table writes no record.
    """
    payload = F.col("html").cast("binary")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(payload, 256), "n_bytes": F.octet_length(payload)})
    rows = join_counted(rows, revisits(pages), ["page_id", "digest"])
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    fields = F.concat(
        F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), number("page_id"), F.lit(f">{CRLF}WARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <urn:page:"), number("refers_to"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2),
    )
    rows.select(F.concat(F.lit(MAGIC), fields, block).alias("value")).write.option("lineSep", CRLF * 2).text(path)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, row, chunk): what follows each magic string; the text source splits a file at it, for any number of tasks."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("chunk")
    )


def _parsed(rows: DataFrame, keep_payload: bool) -> DataFrame:
    """rows with the fields of the record that begins in each chunk, if it is one, in place of the chunk."""
    field = lambda name: F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    page = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    rows = rows.withColumn("header", F.substring_index(F.decode("chunk", "ISO-8859-1"), CRLF * 2, 1))  # a character for each byte
    rows = rows.withColumns({"body": F.length("header") + 4, "length": F.when(field("Content-Length").rlike("^[0-9]+$"), field("Content-Length").try_cast("long"))})
    rows = rows.withColumn("block", F.expr("substring(chunk, body + 1, cast(least(length, octet_length(chunk)) as int))"))
    rows = rows.withColumn("http", F.substring_index(F.decode("block", "ISO-8859-1"), CRLF * 2, 1))
    response = field("WARC-Type") == "response"
    rows = rows.withColumn("payload", F.when(response, F.expr("substring(block, length(http) + 5, octet_length(block))")))
    fields = {
        "span": (len(MAGIC) + F.col("body") + F.col("length") + 4).cast("long"), "size": (F.octet_length("chunk") + len(MAGIC)).cast("long"), "chunk_id": F.sha2("chunk", 256),
        "warc_type": field("WARC-Type"), "record_id": page("WARC-Record-ID"), "refers_to": page("WARC-Refers-To"),
        "target": F.when(F.col("header").contains("WARC-Target-URI: "), F.decode(F.encode(field("WARC-Target-URI"), "ISO-8859-1"), "UTF-8")),
        "digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", ""),
        "payload_bytes": F.coalesce(F.octet_length("payload").cast("long"), F.regexp_extract("http", r"Content-Length: ([0-9]+)", 1).try_cast("long")),
        "payload_digest": F.coalesce(F.sha2("payload", 256), F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "")),
    }
    return rows.withColumns(fields).drop("chunk", "header", "body", "length", "block", "http", *([] if keep_payload else ["payload"]))


def _placed(rows: DataFrame) -> DataFrame:
    """rows with the offset of the magic string before each chunk: sizes of earlier splits, one row per split, and of earlier chunks of its own."""
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("file", "split").agg(F.sum("size").alias("split_size"))
    starts = sizes.select("file", "split", F.coalesce(F.sum("split_size").over(before("file", "split")), F.lit(0)).alias("base"))
    inner = rows.withColumn("inner", F.coalesce(F.sum("size").over(before("file", "split", "row")), F.lit(0)))
    # a file's first chunk stands before any magic string, so each other begins where the one before it ends
    return inner.join(starts, ["file", "split"]).withColumn("offset", F.col("base") + F.col("inner") - len(MAGIC)).where("offset >= 0").drop("base", "inner", "split", "row")


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates that the chain from each file's first byte visits, of (file, offset, next).

    Candidates that lead to the one after them form runs, and runs become single links, so a file with nothing false in it is one
    run. Over the links goes pointer jumping: in each round every reached run marks the run and entry its jump leads to, and jumps
    double, so n runs take about log2(n) rounds. A reached run's candidates count from its entry on.
    """
    order = Window.partitionBy("file").orderBy("offset")
    head = F.coalesce(F.lag("next").over(order) != F.col("offset"), F.lit(True)).cast("long")
    members = cut(candidates.select("file", "offset", "next", head.alias("head")).withColumn("run", F.sum("head").over(order)).drop("head"))
    exits = members.groupBy("file", "run").agg(F.max_by("next", "offset").alias("entry"))
    entries = members.select("file", F.col("offset").alias("entry"), F.col("run").alias("to"))
    runs = exits.count()
    jumps = cut(exits.join(entries, ["file", "entry"]).select("file", "run", "to", "entry"), runs)
    found = cut(members.where("offset = 0").select("file", "run", F.col("offset").alias("entry")), runs)
    total, now = 0, found.count()
    while now > total:
        total = now
        ahead = found.select("file", "run").join(jumps, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        found = cut(found.union(ahead).distinct(), runs)
        onward = jumps.select("file", F.col("run").alias("to"), F.col("to").alias("beyond"), F.col("entry").alias("there"))
        jumps = cut(jumps.join(onward, ["file", "to"]).select("file", "run", F.col("beyond").alias("to"), F.col("there").alias("entry")), runs)
        now = found.count()
    return members.join(found, ["file", "run"]).where(F.col("offset") >= F.col("entry")).select("file", "offset")


RECORD = ("file", "offset", "warc_type", "record_id", "target", "refers_to", "digest", "payload_bytes", "payload_digest")


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records of all archives under path: the columns of RECORD and, with keep_payload, payload (null for revisits).

    Tasks propose (offset, successor) from every magic string; only records on the chain from a file's first byte are kept, so a
    payload that holds whole records yields none of them. Such a record's chunks are fetched by their digests and joined again.
    payload_bytes and payload_digest are measured on the payload of a response and read from the head of a revisit.
    No archive or an empty one: no rows. A file whose chain does not end at its last byte, one that is cut short too, is an error; one without any record border has no records.
    """
    columns = [*RECORD, *(["payload"] if keep_payload else [])]
    placed = cut(_placed(_parsed(_scan(spark, path), keep_payload)))
    kept = reachable(placed.where("span is not null").select("file", "offset", (F.col("offset") + F.col("span")).alias("next")))
    kept = cut(kept)
    ends = placed.groupBy("file").agg(F.max(F.col("offset") + F.col("size")).alias("end"))
    last = kept.join(placed.select("file", "offset", "span"), ["file", "offset"]).groupBy("file").agg(F.max(F.col("offset") + F.col("span")).alias("at"))
    broken = ends.join(last, "file", "left").where("at is null or at != end").first()
    if broken:
        raise ValueError(f"the records of {broken['file']} do not follow one another beyond byte {broken['at'] or 0} of {broken['end']}")
    marked = placed.join(kept.withColumn("kept", F.lit(True)), ["file", "offset"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    alone = F.col("kept") & (F.col("size") >= F.col("span"))
    order = Window.partitionBy("file").orderBy("offset")
    torn = marked.where(~F.coalesce(alone, F.lit(False))).withColumn("owner", F.last(F.when(F.col("kept"), F.col("offset")), ignorenulls=True).over(order))
    torn = cut(torn.where("owner is not null").select("file", "owner", "offset", "chunk_id"))
    records = marked.where(alone).select(*columns)
    if torn.isEmpty():
        return records
    chunks = _scan(spark, path).select("chunk", F.sha2("chunk", 256).alias("chunk_id"))
    chunks = join_counted(chunks, torn.select("chunk_id").distinct(), ["chunk_id"], "left_semi").groupBy("chunk_id").agg(F.first("chunk").alias("chunk"))
    parts = torn.join(chunks, "chunk_id").groupBy("file", F.col("owner").alias("offset")).agg(F.sort_array(F.collect_list(F.struct("offset", "chunk"))).alias("parts"))
    # bytes as characters, a bijection, so that one join makes the whole
    glued = F.encode(F.array_join(F.transform("parts", lambda p: F.decode(p["chunk"], "ISO-8859-1")), MAGIC), "ISO-8859-1")
    return records.unionByName(_parsed(parts.select("file", "offset", glued.alias("chunk")), keep_payload).select(*columns))
