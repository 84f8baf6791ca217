"""WARC: a deterministic sharded writer, and the reader of what it wrote.

Records are range-sorted by page_id into shards of about ``shard_bytes`` of payload, whose bounds follow from a running
sum over the page_ids and so from the data alone, not from samples or partitions. Within a shard gzip files are rolled
by compressed size, with headers, lengths and SHA-1 digests made anew from the payload. Equal payloads are found by digest and length: the smallest page_id is the
response, the others are marked as its revisits. The marks travel with the pages through one range exchange, as rows
beside them, so the html is shuffled once and never joined.

Commit: a task writes temporary names that hold its attempt, and returns a row for each file; those rows, written by
Spark as the manifest, are the only files that count. They are renamed to names that depend on the data alone (shard
and roll), each by a task that may be repeated, and the manifest is read, never the folder. Record identifiers, dates
and order follow from the data too, so reruns give the same files, byte by byte.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from marlstone.llm.common import fresh_path, open_fs, running_sum, spread, written

#: Payload of a shard, which one task writes; and the compressed size at which its files roll.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 32 << 20
#: Stands in every record; the pages carry no date of their own.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SHA1_HEX = "[0-9a-f]{40}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(pairs: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def _record(page_id, url: str | None, payload: bytes, refers_to, nth: int) -> bytes:
    """A response, or a revisit of page ``refers_to``, as one gzip member; ``nth`` tells equal page_ids apart."""
    name = f"<urn:page:{'null' if page_id is None else page_id}:{nth}>"
    clean = "".join(c if c > " " and c != "\x7f" else "%" + f"{ord(c):02X}" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    pairs = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", DATE)]
    pairs += [("WARC-Target-URI", clean)] if clean else []
    pairs += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}:0>")] if revisit else []
    pairs += [("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block))]
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(_header(pairs) + block + b"\r\n\r\n") + z.flush()


def _marked(pages: DataFrame, smallest: int) -> DataFrame:
    """Pages (page_id, url, html, sha, mark null) and, beside them, a mark (page_id, null, null, sha, smallest page_id)
    for each page whose payload has a smaller page_id elsewhere."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.concat(F.sha1(body.cast("binary")), F.lit(":"), F.octet_length(body)).alias("sha"), F.octet_length(body).alias("_n"))
    keys = rows.where(F.col("_n") >= smallest).select("page_id", "sha")
    first = keys.groupBy("sha").agg(F.min("page_id").alias("mark"), F.count("*").alias("_rows")).where("_rows > 1 AND mark IS NOT NULL").drop("_rows")
    # one mark for each page, not row: a page's rows of one payload stand together and are told apart by the writer
    marks = keys.join(first, "sha").where(~F.col("page_id").eqNullSafe(F.col("mark"))).distinct()
    marks = marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "mark")
    return rows.select("page_id", "url", "html", "sha", F.lit(None).cast("long").alias("mark")).unionByName(marks)


def shard_starts(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """The first page_id of each shard but the first, ascending: pages stand by page_id, and one starts a shard where the
    payload before it, with 1 KB for each record, passes a multiple of ``shard_bytes``. One number a shard is collected.
    """
    size = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) + 1024
    each = pages.where("page_id IS NOT NULL").groupBy("page_id").agg(F.sum(size).alias("size"))
    at = running_sum(each, ["page_id"], "size", "upto").withColumn("shard", F.floor((F.col("upto") - F.col("size")) / shard_bytes))
    return sorted(r["first"] for r in at.groupBy("shard").agg(F.min("page_id").alias("first")).collect())[1:]


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, smallest: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The manifest (file, shard, roll, n_records, n_bytes, sha1) of the archives of ``pages`` (page_id, url, html) in ``folder``.

    Null html is an empty payload. Payloads of fewer than ``smallest`` bytes are always responses. Rows that repeat a
    page_id and payload are the response and revisits of it, all in one shard; null page_ids come first and are never
    referred to. An empty table gives no files. Other columns are not used.
    """
    spark = pages.sparkSession
    sort = ["shard", "page_id", "sha", F.col("mark").asc_nulls_last(), "url"]
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    starts = shard_starts(pages, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(page: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(starts, np.int64), page.to_numpy(np.int64), side="right"), dtype="int32")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        files, out, n, size, sha, roll = [], None, 0, 0, None, 0
        at, mark, nth, shard = None, None, 0, None

        def close():
            out.close()
            files.append((name, f"pages-{shard:06d}-{roll:05d}.warc.gz", shard, roll, n, size, sha.hexdigest()))

        for b in batches:
            for page, url, html, key, to, own in zip(b["page"], b["url"], b["html"], b["sha"], b["refers_to"], b["shard"], strict=True):
                if own != shard:
                    if out is not None:
                        close()
                    out, roll, shard = None, 0, int(own)
                if (page, key) != at:
                    at, mark, nth = (page, key), None, 0
                if to is not None:
                    mark = to
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                again = nth > 0 and len(payload) >= smallest and page is not None
                data = _record(page, url, payload, mark if mark is not None else page if again else None, nth)
                nth += 1
                if out is None:
                    name = f"_temporary-{shard:06d}-{roll:05d}-{task.taskAttemptId()}"
                    out, n, size, sha = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0, hashlib.sha1()
                out.write(data)
                sha.update(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    close()
                    out, roll = None, roll + 1
        if out is not None:
            close()
        yield pd.DataFrame(files, columns=["temporary", "file", "shard", "roll", "n_records", "n_bytes", "sha1"])

    # a mark sorts before its pages: nulls of ``mark`` come last
    rows = _marked(pages, smallest).withColumn("shard", shard_of(F.coalesce("page_id", F.lit(-(2**63)))))
    sorted_rows = rows.repartitionByRange(len(starts) + 1, "shard").sortWithinPartitions(*sort)
    # as text: pandas would turn integers beside nulls into floats
    texts = sorted_rows.select("shard", F.col("page_id").cast("string").alias("page"), "url", "html", "sha", F.col("mark").cast("string").alias("refers_to"))
    drafts = written(texts.mapInPandas(save, "temporary string, file string, shard int, roll int, n_records long, n_bytes long, sha1 string"), "drafts")

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        fs, base = open_fs(folder)
        for b in batches:
            for x in b.itertuples(index=False):
                if fs.get_file_info(f"{base}/{x.temporary}").type != FileType.NotFound:  # else an earlier try renamed it
                    fs.move(f"{base}/{x.temporary}", f"{base}/{x.file}")
                if fs.get_file_info(f"{base}/{x.file}").size != x.n_bytes:
                    raise OSError(f"{x.file} is not as its manifest says")
            yield b.drop(columns="temporary")

    return written(spread(drafts, "file").mapInPandas(commit, "file string, shard int, roll int, n_records long, n_bytes long, sha1 string"), "manifest")


class WarcError(ValueError):
    pass


def records(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict, bytes]]:
    """(header, block) of each record of a binary stream of gzip members, one record in memory at a time."""
    z, text, rest = zlib.decompressobj(31), bytearray(), b""
    while True:
        data = rest or stream.read(chunk)
        if not data:
            break
        text += z.decompress(data)
        rest = b""
        if z.eof:
            yield _parsed(bytes(text))
            rest, z, text = z.unused_data, zlib.decompressobj(31), bytearray()
    if text:
        raise WarcError("the archive ends within a record")


def _parsed(raw: bytes) -> tuple[dict, bytes]:
    head, mid, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mid or not lines[0].startswith("WARC/1."):
        raise WarcError("not a record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + digest(block) != h["WARC-Block-Digest"]:
        raise WarcError(f"{h.get('WARC-Record-ID')}: its length or digest is wrong")
    return h, block


def _page(name: str) -> int | None:
    page = name.split(":")[2]
    return None if page == "null" else int(page)


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the archives in the manifest.

    Every block's digest and every response's payload digest is verified; a revisit's payload is null, its bytes are
    those of its HTTP header.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        frame = lambda rows: pd.DataFrame(rows, columns=names, dtype=object).astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})
        fs, base = open_fs(folder)
        for b in batches:
            for file in b["file"]:
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{file}", compression=None) as f:
                    for h, block in records(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, own = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = next(int(x[15:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
                        if kind == "response" and (len(payload) != size or digest(payload) != own):
                            raise WarcError(f"{h['WARC-Record-ID']}: its payload is not what its digest says")
                        to = _page(h["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((_page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), size, own, kind, to, payload if kind == "response" else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                yield frame(rows)

    files = spread(manifest.select("file"), "file")
    return files.mapInPandas(parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT page_id, hex, unnest(range(8)) AS i FROM p),
b AS (SELECT page_id, i, ('0x' || substr(hex, i * 5 + 1, 5))::INTEGER AS v FROM g),
c AS (SELECT page_id, string_agg(
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1), '' ORDER BY i) AS payload_digest
      FROM b GROUP BY page_id),
f AS (SELECT hex, strlen(body) AS n, min(page_id) AS first FROM p GROUP BY hex, strlen(body))
SELECT p.page_id, strlen(p.body)::BIGINT AS payload_bytes, c.payload_digest,
       CASE WHEN f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first = p.page_id THEN NULL ELSE f.first END AS refers_to
FROM p JOIN c USING (page_id) JOIN f ON f.hex = p.hex AND f.n = strlen(p.body)
"""
