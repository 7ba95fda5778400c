"""WARC archives as a chunked record table.

Writing. Spark's text writer makes the files: a row is one whole WARC record up to the last byte of
its closing ``CR LF CR LF``, which the writer's own line end supplies. Payloads are cut in the JVM into rows
(record identifier, chunk number) of at most ``chunk_chars`` characters, which reach Python in order and in small
batches: a first segment and ``continuation`` records (WARC 1.1 segmentation), so no Python task holds a
whole oversized payload or record. Each chunk row carries the incremental digest, the SHA-256 of the payload up to
and with that chunk. Files hold a bounded number of rows.

Reading. A task unpacks a file as a stream and cuts it into chunk rows. Records of one chunk are
checked in place. Chunks of longer records are dealt by record, sorted by chunk number and pass
through one running hash per record: the incremental digest of every chunk is checked and the last
one is the payload's digest. A mismatch or a missing chunk is an error.

Revisits. Of records with equal payloads of at least ``min_revisit`` bytes the smallest page_id is
the response; the others hold no payload but its digest, its length and a reference. The smallest ids are found by a
pre-aggregated minimum per digest; only digests that occur more than once are joined back.

Edge cases. Null html is an empty payload; null urls leave out the target header. Rows that repeat a page_id are
written each; if the smallest id of a payload occurs twice, both are responses. Null page_ids come
last in that order. Empty tables give an empty archive and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, with_small_batches

CHUNK_CHARS, ROWS_PER_FILE, MIN_REVISIT = 16_384, 2_000, 100
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = (
    "page_id string, row_id long, chunk_no int, n_chunks int, record_type string, refers_to string,"
    " payload_bytes long, payload_digest string, running_digest string, data binary"
)


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages with ``row_id``, payload size and digest, and ``refers_to`` where the record is a revisit."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.monotonically_increasing_id().alias("row_id"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"),
    )
    firsts = (
        rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    again = ~F.col("first_id").eqNullSafe(F.col("page_id")) & F.col("first_id").isNotNull()
    return rows.join(firsts, "payload_digest", "left").withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def header(kind: str, block: int, **fields: object) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {block}", "", ""])


def chunk_record(r, raw: bytes, running: str) -> str:
    """The WARC record of one chunk row as text, without its last line feed."""
    known = lambda v: v if isinstance(v, str) else None
    page, url, refers_to, size, k = known(r.page_id), known(r.url), known(r.refers_to), r.payload_bytes, r.k
    name = "null" if page is None else page
    # Only a page's own response is referred to, by the page alone.
    record = f"<urn:page:{name}>" if page is not None and refers_to is None and size >= MIN_REVISIT else f"<urn:page:{name}:row:{r.row_id}>"
    common = {
        "WARC_Record_ID": record, "X_Page_ID": name, "X_Row_ID": r.row_id,
        "WARC_Target_URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC_Payload_Digest": f"sha256:{r.payload_digest}", "X_Payload_Length": size,
    }
    if refers_to is not None:
        return header("revisit", 0, **common, WARC_Profile=REVISIT_PROFILE, WARC_Refers_To=f"<urn:page:{refers_to}>") + "\r\n\r"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n" if k == 0 else ""
    segment = {"X_Running_Digest": f"sha256:{running}", "X_Segments": r.n}
    if r.n > 1:
        segment |= {"WARC_Segment_Number": k + 1, "WARC_Segment_Origin_ID": record if k else None,
                    "WARC_Segment_Total_Length": size if k == r.n - 1 else None}
    block = {"Content_Type": "application/http; msgtype=response"} if k == 0 else {}
    own = {**common, "WARC_Record_ID": f"<urn:page:{name}:row:{r.row_id}:segment:{k + 1}>"} if k else common
    return header("continuation" if k else "response", len(http) + len(raw), **own, **segment, **block) + http + r.part + "\r\n\r"


def chunk_rows(pages: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Planned records as rows of one chunk each, ``k`` of ``n``, in order; revisits and empty payloads have one empty chunk."""
    # One pass of a pattern over the payload: repeated substrings would count its characters anew for each chunk.
    parts = F.regexp_extract_all("html", F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0))
    empty = F.col("refers_to").isNotNull() | (F.col("payload_bytes") == 0)
    records = plan_records(with_small_batches(pages)).withColumn("parts", F.when(empty, F.array(F.lit(""))).otherwise(parts))
    # Ids travel as text: pandas has no null integers.
    return records.select(
        F.col("page_id").cast("string").alias("page_id"), "row_id", "url", "payload_bytes", "payload_digest", F.col("refers_to").cast("string").alias("refers_to"),
        F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))


def write_archive(pages: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes gzipped WARC files under ``path`` (any file system that Spark writes to)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        running = hashlib.sha256()
        for batch in batches:
            out, held = [], 0
            for r in batch.itertuples(index=False):
                raw = r.part.encode("utf-8")
                if r.k == 0:
                    running = hashlib.sha256()
                running.update(raw)
                out.append(chunk_record(r, raw, running.hexdigest()))
                held += len(raw)
                if held > 4 << 20:
                    yield pd.DataFrame({"value": out})
                    out, held = [], 0
            yield pd.DataFrame({"value": out}, dtype=object)

    chunks = chunk_rows(pages, chunk_chars)
    chunks.mapInPandas(run, "value string").write.option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).text(path)


def parse_stream(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in a stream of bytes."""
    buffer = b""
    for piece in pieces:
        buffer += piece
        at = 0
        while (end := buffer.find(b"\r\n\r\n", at)) >= 0:
            first, *lines = buffer[at:end].decode("utf-8").split("\r\n")
            if first != "WARC/1.1":
                raise ValueError(f"not a WARC record: {first[:80]!r}")
            fields = dict(x.split(": ", 1) for x in lines)
            n = int(fields["Content-Length"])
            if len(buffer) < end + 4 + n + 4:
                break
            yield fields, buffer[end + 4 : end + 4 + n]
            at = end + 4 + n + 4
        buffer = buffer[at:]
    if buffer:
        raise ValueError("a WARC file ends inside a record")


def unpacked(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    d = zlib.decompressobj(31)
    rest = content
    while rest:
        piece = d.decompress(rest, step)
        rest = d.unconsumed_tail
        yield piece
        if d.eof:
            rest, d = d.unused_data, zlib.decompressobj(31)
    yield d.flush()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archive's chunk rows. Of records with one chunk the data are checked and not passed on unless asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for f, block in parse_stream(unpacked(content)):
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:")
                    page = None if f["X-Page-ID"] == "null" else f["X-Page-ID"]
                    size, running, data, n = int(f["X-Payload-Length"]), f.get("X-Running-Digest", "").removeprefix("sha256:"), None, int(f.get("X-Segments", 1))
                    refers = f["WARC-Refers-To"][len("<urn:page:") : -1] if kind == "revisit" else None
                    if kind == "response":
                        block = block.split(b"\r\n\r\n", 1)[1]
                    if kind != "revisit" and n > 1:
                        data, size, digest = block, len(block), None
                    elif kind != "revisit":
                        size, found = len(block), hashlib.sha256(block).hexdigest()
                        if found != digest or found != running:
                            raise ValueError(f"page {page}: the payload does not have its digest")
                    rows.append((page, int(f["X-Row-ID"]), int(f.get("WARC-Segment-Number", 1)), n, "revisit" if kind == "revisit" else "response", refers, size, digest, running, data))
                    held += len(data or b"") + 200
                    if held > 4 << 20:
                        yield frame(rows, columns)
                        rows, held = [], 0
                yield frame(rows, columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, CHUNK_SCHEMA)


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    return out.astype({"row_id": "int64", "chunk_no": "int32", "n_chunks": "int32", "payload_bytes": "int64"})


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, chunked payloads digested in chunk order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seen, running, size = None, 0, hashlib.sha256(), 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                page = r.page_id
                if r.n_chunks == 1:
                    out.append((page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
                    continue
                if r.row_id != key:
                    if seen:
                        raise ValueError("a record lacks its last chunks")
                    key, running, size = r.row_id, hashlib.sha256(), 0
                seen += 1
                running.update(r.data)
                size += len(r.data)
                if r.chunk_no != seen or running.hexdigest() != r.running_digest:
                    raise ValueError(f"page {page}: chunk {r.chunk_no} does not continue the record")
                if seen == r.n_chunks:
                    out.append((page, size, running.hexdigest(), r.record_type, None))
                    seen, key = 0, None
            done = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)
            yield done.astype({"payload_bytes": "int64"})
        if seen:
            raise ValueError("a record lacks its last chunks")

    dealt = chunks.repartition("row_id").sortWithinPartitions("row_id", "chunk_no")
    read = dealt.mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return read.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def archive_pages(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Writes the pages to an archive in the shared folder and reads its records back."""
    spark = pages.sparkSession
    path = scratch_path(spark, name)
    write_archive(pages, path)
    return read_records(read_chunks(spark, path))
