"""WARC archives, compressed record by record with a Zstandard dictionary.

Each file (``.warc.zst``) begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from the file's first
records (``sample_records`` and ``sample_bytes`` bound the sample), then a frame for each record: a ``warcinfo``, then
``response`` records with the whole HTTP response, or ``revisit`` records (identical payload digest) with headers alone. A reader
needs nothing but the file.

Of the rows with equal payloads of at least ``min_bytes`` bytes, that with the largest key is the response and the others
revisit it. Files of lost or retried tasks are not in the manifest and are never read.

A record's id is made of its page's key and its payload's digest, so ids differ but for rows with the same key and payload.

Defined results: a null html is an empty payload; a null key is below any other, and where all keys of a group are null all
are responses; rows with the same (largest) key and payload are all responses; a null url has no target header
and line breaks in one are percent-encoded; an empty table
makes no file. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import frame, input_parts, new_dir, staged, table
from tidewire.llm.token_files import _fs

SKIPPABLE = 0x184D2A5D
#: The profile of a revisit record, and the scheme of record ids here.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"
WRITTEN = "file string, n_records long"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def record_id(key: int | None, digest: str) -> str:
    return f"<{RECORD}{'' if key is None else key}:{digest}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """refers_to: the response's key if this is a revisit."""
    digest = digest32(payload)
    fields: list[tuple[str, object]] = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        payload = b""
    fields.append(("Content-Type", "application/http;msgtype=response"))
    return _headers(fields, head + payload)


def build_dictionary(samples: list[bytes], size: int):
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, threads=0, level=3)
    except zstandard.ZstdError:  # too few or too short records: their bytes are the dictionary
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_warc(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3, dictionary_bytes: int = 65_536, sample_records: int = 500, sample_bytes: int = 2_000_000, file_bytes: int = 32_000_000, block: int = 500_000) -> None:
    """Write the archives and their manifest (a Parquet table) under ``folder``.

    Digests are grouped first (with a partial step before the shuffle). The groups of several rows, at most ``block`` of them, are sent
    to the pages, so no payload is shuffled; more groups than that are joined by a shuffle, of which Spark splits a large
    group's side, as no step needs all of its rows together.
    """
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("key").alias("top"), F.count("*").alias("n")).where("n > 1")
    groups = staged(groups.select(F.unhex("digest").alias("digest"), "top"), "warc-groups")
    groups = F.broadcast(groups) if groups.count() <= block else groups
    told = rows.withColumn("digest", F.unhex("digest")).join(groups, "digest", "left").select("key", "url", "payload", F.when(~F.col("key").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        waiting: list[bytes] = []
        done: list[tuple[str, int]] = []
        size, count, out, squeeze, name = 0, 0, None, None, ""
        system, root = _fs(folder)

        def begin() -> None:
            nonlocal out, squeeze, name, size
            system.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            out = system.open_output_stream(f"{root}/{name}", compression=None)
            known = build_dictionary(waiting, dictionary_bytes)
            data = known.as_bytes()
            out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
            squeeze = zstandard.ZstdCompressor(level=level, dict_data=known)
            info = b"software: page archiver\r\nformat: WARC File Format 1.1\r\n"
            out.write(squeeze.compress(_headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info)))
            size = 0
            put()

        def put() -> None:
            nonlocal size, count
            for r in waiting:
                frame = squeeze.compress(r)
                out.write(frame)
                size += len(frame)
            count += len(waiting)
            waiting.clear()

        def end() -> None:
            nonlocal out, count
            out.close()
            done.append((name, count))
            out, count = None, 0

        held = 0
        for pdf in batches:
            for k, u, payload, ref in zip(pdf["key"].astype("Int64"), pdf["url"], pdf["payload"], pdf["refers_to"].astype("Int64")):
                r = record(None if k is pd.NA else k, u, bytes(payload), None if ref is pd.NA else ref, date)
                waiting.append(r)
                held += len(r)
                if out is not None:
                    put()
                    if size >= file_bytes:
                        end()
                        held = 0
                elif len(waiting) >= sample_records or held >= sample_bytes:
                    begin()
        if waiting:
            begin()
        if out is not None:
            end()
        yield frame(done, WRITTEN)

    told.mapInPandas(write, WRITTEN).write.parquet(f"{folder}/manifest")


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one file."""
    import zstandard

    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the file does not begin with a dictionary frame")
    known = data[8 : 8 + n]
    kind = zstandard.DICT_TYPE_FULLDICT if known[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known, dict_type=kind))
    stream = io.BufferedReader(opened.stream_reader(io.BytesIO(memoryview(data)[8 + n :]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("a record does not begin with its version")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.decode().partition(":")
            fields[k] = v.strip()
        block = stream.read(int(fields["Content-Length"]))
        stream.read(4)
        yield fields, block


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each page record; digests of responses are worked out anew and held against their headers."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("file")

    def key_of(uri: str) -> int | None:
        tail = uri.strip("<>").removeprefix(RECORD).partition(":")[0]
        return int(tail) if tail else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _fs(folder)

        for pdf in batches:
            for name in pdf["file"]:
                with system.open_input_file(f"{root}/{name}") as f:
                    data = f.readall()
                rows: list[tuple] = []
                size = 0
                for fields, block in read_records(data):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and (digest32(payload) != told or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"{name}: the payload of {fields['WARC-Record-ID']} is damaged")
                    rows.append((key_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], int(http["Content-Length"]), told, key_of(fields["WARC-Refers-To"]) if revisit else None, payload if payloads and not revisit else None))
                    size += len(payload) * payloads + 200
                    if size >= 16_000_000:
                        yield frame(rows, READ)
                        rows, size = [], 0
                yield frame(rows, READ)

    return manifest.repartition(input_parts(manifest)).mapInPandas(read, READ)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle_sql() -> dict[str, str]:
    base32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha1(h), CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '')"
    sql = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS top FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {base32} AS payload_digest,
  CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p JOIN g USING (h)"""
    return {"op8_warc": sql}
