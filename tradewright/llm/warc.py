"""WARC archives with dictionary-compressed records.

Each file starts with a skippable Zstandard frame that holds a dictionary trained on records of that file; every record follows as a
frame of its own, so a reader can start at any record once it has the dictionary. Equal payloads are stored once and revisited.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewright.llm.common import cut, salted_join, utf8
from tradewright.session import stage_dir

MAGIC = 0x184D2A5D  # of the skippable frame that holds a dictionary
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_references(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html and refers_to, the page with the largest id among those with the same payload of at least `least` bytes."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n"))
    copies = cut(rows.where(F.col("n") >= least).groupBy("sha", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("many")).where("many > 1"))
    joined = salted_join(rows, copies, ["sha", "n"], "many", pages.count(), F.struct("page_id", "url"))
    own = F.col("refers_to").isNull() | F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select("page_id", "url", "html", F.when(~own, F.col("refers_to")).alias("refers_to"))


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record; a revisit holds the HTTP header, with the length of the payload, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:x-page:{name}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int, sample: int):
    """Trained on the first records, up to `sample` bytes; of too few records, their first bytes."""
    import zstandard

    chosen, total = [], 0
    for r in records:
        if total >= sample:
            break
        chosen.append(r[: 1 << 17])  # the trainer takes no longer samples
        total += len(chosen[-1])
    try:
        return zstandard.train_dictionary(size, chosen)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(chosen)[:size] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def file_bytes(records: list[bytes], size: int, sample: int, level: int) -> Iterator[bytes]:
    import zstandard

    trained = dictionary(records, size, sample)
    content = trained.as_bytes()
    yield struct.pack("<II", MAGIC, len(content)) + content
    press = zstandard.ZstdCompressor(level=level, dict_data=trained)
    for r in records:
        yield press.compress(r)


def write_archives(pages: DataFrame, folder: str, least: int = 1000, file_size: int = 1 << 24, dictionary_size: int = 1 << 16,
                   sample: int = 1 << 22, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Archives every row of pages (page_id, url, html) below `folder` and returns the manifest: path, records.

    Of equal payloads of at least `least` bytes the one with the largest page_id is a response and the others revisit it; rows with that same
    page_id are responses too. NULL html is an empty payload, a NULL page_id is written as null, a NULL url as a name made of the id.
    Files end at about `file_size` bytes of records, which bounds a task's memory. A file's name holds the task attempt,
    and only the manifest says which files count, so a lost or repeated task leaves no double records. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        made, held, size = [], [], 0

        def flush() -> None:
            nonlocal held, size
            name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):05d}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                for part in file_bytes(held, dictionary_size, sample, level):
                    out.write(part)
            made.append((name, len(held)))
            held, size = [], 0

        for batch in batches:
            for page, url, html, to in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), utf8(batch.column("html")), batch.column("refers_to").to_pylist()):
                held.append(record(page, url, html, to, date))
                size += len(held[-1])
                if size >= file_size:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["file", "records"])

    from pyarrow import fs

    folder = folder if "://" in folder else f"file://{folder}"
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    made = cut(with_references(pages, least).mapInArrow(run, "file string, records long"))
    return made.select(F.concat(F.lit(f"{folder}/"), "file").alias("path"), "records")


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a decompressed archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        stream.read(4)
        yield headers, block


def opened(raw) -> io.BufferedIOBase:
    """The records of an archive file, decompressed with the dictionary that it starts with."""
    import zstandard

    magic, size = struct.unpack("<II", raw.read(8))
    if magic != MAGIC:
        raise ValueError("the archive has no dictionary frame")
    return io.BufferedReader(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw.read(size))).stream_reader(raw, read_across_frames=True), 1 << 20)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the manifest's files: page_id, url, record_type, refers_to, payload_digest (hexadecimal), payload_bytes, and the payload
    (NULL of a revisit) if wanted. The digest and length of a response are those of the payload as read; a revisit states them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        number = lambda name: None if name == "null" else int(name)
        rows: list[tuple] = []

        def emit() -> pa.RecordBatch:
            nonlocal rows
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *([pa.binary()] if payloads else [])]
            names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"][: len(types)]
            arrays, rows = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], []
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                held = 0
                with store.open_input_stream(name, compression=None) as raw:
                    for headers, block in parsed(opened(raw)):
                        http, _, body = block.partition(b"\r\n\r\n")
                        page, to = (re.search(r"urn:x-page:([^>]*)", headers.get(h, "")) for h in ("WARC-Record-ID", "WARC-Refers-To"))
                        if headers["WARC-Type"] == "revisit":
                            digest, size, body = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex(), int(re.search(rb"Content-Length: (\d+)", http)[1]), None
                        else:
                            digest, size = hashlib.sha1(body).hexdigest(), len(body)
                        rows.append((number(page[1]), headers["WARC-Target-URI"], headers["WARC-Type"], number(to[1]) if to else None, digest, size, body))
                        held += len(block)
                        if held > 1 << 23:
                            yield emit()
                            held = 0
                if rows:
                    yield emit()

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + (", payload binary" if payloads else "")
    return manifest.select("path").repartition(F.xxhash64("path")).mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back from its archives.

    The archives stay in `folder`, by default a new one in the shared folder of the stage tables.
    """
    import uuid

    folder = folder or f"{stage_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, least), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
