"""Web archives of Zstandard frames: a dictionary in the leading skippable frame, then one frame per record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.llm.common import fresh_path, written

# The skippable frame that holds a dictionary, a trained dictionary's first bytes, the revisit profile.
SKIPPABLE, TRAINED = 0x184D2A5D, b"\x37\xa4\x30\xec"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_READ = 1 << 15
#: Tasks that read archives, at most.
MOST_READERS = 10_000


def _open(path: str, mode: str):
    files, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    if mode == "r":
        return files.open_input_file(at)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    return files.open_output_stream(at, compression=None)


def train_dictionary(pages: DataFrame, html: str = "html", rows: int = 400, chars: int = 8_000, size: int = 32_768) -> bytes:
    """A dictionary from at most *rows* pages, chosen by hash from all, *chars* characters of each; empty if there are too few."""
    h = F.col(html)
    few = F.pmod(F.xxhash64(h), F.lit(1 << 30)) < F.lit(int(min(1.0, 2 * rows / max(pages.count(), 1)) * (1 << 30)))  # so that tasks hand on few rows
    taken = pages.where((F.length(h) > 0) & few).select(F.substring(h, 1, chars).alias("t"), F.xxhash64(h).alias("h")).distinct().orderBy("h", "t").limit(rows).collect()
    samples = list(dict.fromkeys(r["t"].encode("utf-8", "replace") for r in taken))
    if len(samples) < 32:
        return b"".join(samples)[:size]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # samples too alike or too short to train on
        return b"".join(samples)[:size]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    if not content:
        return None
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if content[:4] == TRAINED else zstandard.DICT_TYPE_RAWCONTENT)


def _one_line(s: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def _sha1(b: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def record(row, date: str) -> bytes:
    """A WARC/1.1 record. A revisit has the response's HTTP head, whose Content-Length tells the full payload's size, without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.n_bytes}\r\n\r\n".encode()
    block = head + row.payload if row.record_type == "response" else head
    fields = {"WARC-Type": row.record_type, "WARC-Record-ID": _record_id(row.page_id, row.uid), "WARC-Date": date}
    if row.url is not None:
        fields["WARC-Target-URI"] = _one_line(row.url)
    if row.page_id is not None:
        fields["X-Page-ID"] = row.page_id
    fields["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(row.digest)).decode()
    fields["WARC-Block-Digest"] = _sha1(block)
    if row.record_type == "revisit":
        fields |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": _record_id(row.first_page, row.first_uid)}
        if row.first_page is not None:
            fields["X-Refers-To-Page-ID"] = row.first_page
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def _record_id(page_id: str | None, uid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{uid}')}>"


def write_archives(pages: DataFrame, folder: str, dictionary: bytes = b"", min_bytes: int = 256, level: int = 3,
                   date: str = "2000-01-01T00:00:00Z", archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record per row of *pages* (``page_id``, ``url``, ``html``; others are left out) and returns the manifest: ``path`` and ``records``.

    Null html is an empty payload; null ids and URLs are left out of the headers. Of rows with equal payloads of
    *min_bytes* or more, that with the smallest page_id (nulls last; of equal ids the smallest URL, then the first) is
    a response and the others revisit it. Tasks begin a new archive after *archive_bytes* of records. Archives are
    named by task and attempt and only those in the committed manifest count, so lost executors and repeated tasks do
    no harm. An empty table gives an empty manifest.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("uid")).withColumns(
        {"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    first = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url", "uid")).alias("f"))
    again = F.coalesce(F.col("f.uid") != F.col("uid"), F.lit(False))
    ready = rows.join(first, "digest", "left").select(
        F.col("page_id").cast("string"), "url", "payload", "uid", "n_bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("f.page_id").cast("string").alias("first_page"), F.coalesce("f.uid", F.lit(-1)).alias("first_uid"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_content_size=True)
        out, path, size, n, k = None, "", 0, 0, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{k}.warc.zst"
                    out, size, n, k = _open(path, "w"), 0, 0, k + 1
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                whole = record(row, date)
                out.write(press.compress(whole))
                size, n = size + len(whole), n + 1
                if size >= archive_bytes:
                    out.close()
                    yield pd.DataFrame({"path": [path], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n]})

    return written(ready.mapInPandas(write, "path string, records long"), "warc-manifest")


def frames(f) -> Iterator[bytes]:
    """The records of an open archive, one decoded frame each. A damaged or cut archive is a ValueError."""
    lead = f.read(8)
    if len(lead) < 8 or struct.unpack("<I", lead[:4])[0] != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    size = struct.unpack("<I", lead[4:])[0]
    content = f.read(size)
    if len(content) < size:
        raise ValueError("cut dictionary")
    if content[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):
        content = zstandard.ZstdDecompressor().decompress(content)
    expand, rest = zstandard.ZstdDecompressor(dict_data=_dictionary(content)), b""
    while rest or (rest := f.read(_READ)):
        frame, parts = expand.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise ValueError(f"damaged frame: {e}") from e
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := f.read(_READ)):
                raise ValueError("cut frame")
        yield b"".join(parts)


def parse(whole: bytes) -> dict:
    """A record's row; its version line, lengths and digests are checked, and a failure is a ValueError."""
    head, mark, body = whole.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.1", "WARC/1.0"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    length = int(fields["Content-Length"])
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(body)} bytes, Content-Length {length}")
    block = body[:length]
    if fields["WARC-Block-Digest"] != _sha1(block):
        raise ValueError("block digest")
    http, mark, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != full or fields["WARC-Payload-Digest"] != _sha1(payload)):
        raise ValueError("payload length or digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": full, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """A row per record of the archives at ``path``; each archive is streamed by one task, its number of ``records`` checked.

    ``payload`` is null for revisits, or for all where it isn't wanted.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ROWS.split(", ")]

        def table(rows: list[dict]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            return out.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})

        for batch in batches:
            for path, records in zip(batch["path"], batch["records"], strict=True):
                rows, size, n = [], 0, 0
                with _open(path, "r") as f:
                    for whole in frames(f):
                        row = parse(whole)
                        rows.append(row if payload else row | {"payload": None})
                        size, n = size + payload * len(whole), n + 1
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield table(rows)
                            rows, size = [], 0
                if n != records:
                    raise ValueError(f"{path} has {n} records, not {records}")
                if rows:
                    yield table(rows)

    # a stated number of tasks: the manifest is too small a table for the planner to see what its rows stand for
    return manifest.select("path", "records").repartition(max(1, min(manifest.count(), MOST_READERS))).mapInPandas(read, ROWS)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 256, payload: bool = False) -> DataFrame:
    """*pages* written as archives in the shared folder and read back."""
    return read_archives(write_archives(pages, fresh_path(spark, "warc"), train_dictionary(pages), min_bytes), payload)
