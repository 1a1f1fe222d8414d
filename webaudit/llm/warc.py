"""WARC archives: monolithic gzip in, one gzip member per record and a sidecar index out."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, drop_folder, lookup, scratch_path, table, text_columns

ARCHIVE_BYTES = 64 << 20  # payload bytes after which a task begins another archive
DEDUPE_BYTES = 100        # shorter payloads are never revisits
RECORDS_PER_BATCH = 512

WRITTEN = ("archive string, seq int, page_id long, payload_bytes long, payload_digest string, "
           "mono_bytes long")
READ = ("archive string, record_offset long, record_length long, page_id long, url string, "
        "payload_bytes long, payload_digest string, record_type string, refers_to long")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder; a task can open it wherever it runs."""
    return pafs.FileSystem.from_uri(folder)


def _name(page_id) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def _number(name: str) -> int | None:
    tail = name.strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def record(page_id, url: str | None, payload: bytes | None, size: int, digest: str,
           refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit keeps the HTTP head but not the payload."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = head if revisit else head + payload
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {_name(page_id)}", f"WARC-Target-URI: {uri}",
             "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, read one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        yield fields, block


def _payload(block: bytes) -> tuple[int, bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n")
                if x.lower().startswith(b"content-length:"))
    return size, payload


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as response records into archives that are one gzip stream each.

    Returns a row per record. Archives of failed or repeated task attempts have other names
    and are mentioned by no row.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out = squeeze = archive = None
        raw = seq = 0
        for pdf in batches:
            rows = []
            for page_id, url, html in zip(pdf["page_id"].array, pdf["url"].array, pdf["html"].array):
                payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(payload).hexdigest()
                page = None if pd.isna(page_id) else int(page_id)
                if out is None:
                    archive = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{archive}", compression=None)
                    squeeze, raw, seq = zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = record(page, url, payload, len(payload), digest)
                out.write(squeeze.compress(data))
                rows.append((archive, seq, page, len(payload), digest, len(data)))
                raw, seq = raw + len(data), seq + 1
                if raw >= archive_bytes:
                    out.write(squeeze.flush())
                    out.close()
                    out = None
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WRITTEN.split(", ")]).astype(
                {"page_id": "Int64"})
        if out is not None:
            out.write(squeeze.flush())
            out.close()

    # A page_id with NULLs must not pass through floating point, so it travels as text.
    keyed = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return keyed.mapInPandas(write, WRITTEN)


def normalise(roles: DataFrame, source: str, target: str, archives: int) -> DataFrame:
    """Rewrite monolithic archives: inflate each once, every record becomes its own member.

    ``roles``: ``archive, seq, revisit, refers_to``, one row per record; an archive's rows
    (bounded by its size) meet in one task, which streams the archive. Each archive gets a
    sidecar ``<archive>.idx`` with a line ``offset length`` per record. Returns
    ``archive, records, bytes``.
    """
    def rewrite(key, pdf: pd.DataFrame) -> pd.DataFrame:
        archive = key[0]
        store, root = _store(source)
        _, out_root = _store(target)
        store.create_dir(out_root, recursive=True)
        pdf = pdf.sort_values("seq")
        attempt = f"{out_root}/.{archive}-{uuid.uuid4().hex}"
        offset, index = 0, []
        # refers_to is text, as a nullable long would arrive as floating point
        with store.open_input_stream(f"{root}/{archive}", compression=None) as raw, \
                store.open_output_stream(attempt, compression=None) as out:
            records = parse(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20))
            for (fields, block), revisit, refers in zip(
                    records, pdf["revisit"], pdf["refers_to"], strict=True):
                size, payload = _payload(block)
                data = record(_number(fields["warc-record-id"]), fields["warc-target-uri"],
                              payload, size, fields["warc-payload-digest"].removeprefix("sha256:"),
                              None if refers == "null" else refers, bool(revisit))
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = squeeze.compress(data) + squeeze.flush()
                out.write(member)
                index.append(f"{offset} {len(member)}\n")
                offset += len(member)
        with store.open_output_stream(attempt + ".idx", compression=None) as out:
            out.write("".join(index).encode())
        store.move(attempt, f"{out_root}/{archive}")
        store.move(attempt + ".idx", f"{out_root}/{archive}.idx")
        return pd.DataFrame({"archive": [archive], "records": [len(index)], "bytes": [offset]})

    # As many partitions as archives: the rows are few and small, the work behind them is not.
    return roles.repartition(max(1, archives), "archive").groupBy("archive").applyInPandas(
        rewrite, "archive string, records long, bytes long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row per record of the named archives, found through their sidecar indexes."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        names = [c.split()[0] for c in READ.split(", ")]
        for pdf in batches:
            for archive in pdf["archive"]:
                with store.open_input_stream(f"{root}/{archive}.idx", compression=None) as f:
                    index = [tuple(map(int, x.split())) for x in f.read().decode().splitlines()]
                with store.open_input_file(f"{root}/{archive}") as f:
                    rows = []
                    for offset, length in index:
                        f.seek(offset)
                        fields, block = next(parse(io.BytesIO(zlib.decompress(f.read(length), 31))))
                        size, payload = _payload(block)
                        kind = fields["warc-type"]
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response":
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        refers = fields.get("warc-refers-to")
                        rows.append((archive, offset, length, _number(fields["warc-record-id"]),
                                     fields["warc-target-uri"], size, digest, kind,
                                     None if refers is None else _number(refers)))
                        if len(rows) == RECORDS_PER_BATCH:
                            yield pd.DataFrame(rows, columns=names).astype(
                                {"page_id": "Int64", "refers_to": "Int64"})
                            rows = []
                    yield pd.DataFrame(rows, columns=names).astype(
                        {"page_id": "Int64", "refers_to": "Int64"})

    return archives.select("archive").mapInPandas(read, READ)


def archive_pages(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES,
                  dedupe_bytes: int = DEDUPE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``folder`` and return its records, read back.

    Pages stay where they are scanned: only digests are shuffled. Of records with equal
    payloads of at least ``dedupe_bytes`` the one with the smallest page_id is the response
    (NULL ids last; of repeated ids, one row); the others become revisits, which store no
    payload. NULL html is an empty payload, a NULL url ``about:blank``. Other columns take
    no part. An empty table writes no archive and gives no rows.
    """
    spark = pages.sparkSession
    source = f"{folder}/monolithic"
    written = cut_lineage(write_monolithic(
        text_columns(pages, "page_id", "url", "html"), source, archive_bytes), "warc-written")
    total = written.count()
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "archive", "seq")
    first = (written.where(F.col("payload_bytes") >= dedupe_bytes).groupBy("payload_digest")
             .agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1"))
    roles = lookup(written, first, "payload_digest", total).select(
        "archive", "seq",
        F.coalesce(~((F.col("archive") == F.col("first.archive"))
                     & (F.col("seq") == F.col("first.seq"))), F.lit(False)).alias("revisit"),
        F.coalesce(F.col("first.page_id").cast("string"), F.lit("null")).alias("refers_to"))
    archives = written.select("archive").distinct().count()
    done = cut_lineage(normalise(roles, source, folder, archives), "warc-done")
    drop_folder(spark, source)
    return read_archives(done.repartition(max(1, archives)), folder)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record after the round trip through archives in the shared folder."""
    pages = table(spark, sf_dir, "pages")
    return archive_pages(pages, scratch_path(spark, "warc")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, coalesce(octet_length(encode(html)), 0) AS payload_bytes, d AS payload_digest,
  CASE WHEN dup AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN dup AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, html, sha256(coalesce(html, '')) AS d,
        coalesce(octet_length(encode(html)), 0) >= 100 AS dup,
        min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
