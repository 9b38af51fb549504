"""WARC archives compressed with Zstandard and a dictionary (operator 12).

An archive is a Zstandard stream: a leading skippable frame holds the
dictionary (magic 0x184D2A5D, itself compressed), then comes one frame for each
record, so that a record can be read by its offset alone. Payloads that occur
more than once are stored once; the other records refer to it (``revisit``).

Archives are built where the pages are read, in tasks, and written by Spark's
own file writer with its commit protocol to any file system: a row is a whole
archive and a file of its own. The line break that the text writer adds is the
content of a closing skippable frame, which every reader passes over. The
reader takes files from Spark as well, finds each frame's end from its block
headers, decodes that frame alone and checks headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodline.llm.common import written
from moodline.operators.joins import checked_lookup_join

# Fixed values of the formats.
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50  # the first of 16
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads shorter than this are always stored.
MIN_REVISIT_BYTES = 1000
#: An archive is closed at so many bytes (or after one larger record).
ARCHIVE_BYTES = 32 << 20
#: Expected number of pages that the dictionary is trained on, and of each page
#: so many characters at most.
SAMPLE_PAGES, SAMPLE_CHARS = 1000, 8192
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Records of the pages have no date of their own.
DATE = "1970-01-01T00:00:00Z"
MAX_RECORD_BYTES = (1 << 31) - 1

_CONTROL = re.compile("[\x00-\x20\x7f]")
_PAGE = "urn:page:"


# --- records -----------------------------------------------------------------

def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool,
                 date: str = DATE) -> bytes:
    """A response record, or a revisit record, whose block is the HTTP header
    alone. Control characters and blanks of the address are percent-encoded."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_PAGE}{_number(page_id)}>"),
              ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_PAGE}{_number(refers_to)}>")]
    block = http if revisit else http + payload
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields).encode()
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _number(page_id: int | None) -> str:
    return "null" if page_id is None else str(page_id)


def _page(urn: str) -> int | None:
    found = re.fullmatch(rf"<{_PAGE}(null|-?[0-9]+)>", urn)
    if not found:
        raise ValueError(f"no page in {urn[:100]!r}")
    return None if found[1] == "null" else int(found[1])


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        key = name.decode("utf-8", "replace").lower()
        if not colon or not name or name != name.strip() or b"\n" in line:
            raise ValueError(f"no header field: {line[:60]!r}")
        if key in out:
            raise ValueError(f"field twice: {key}")
        out[key] = value.strip().decode()
    return out


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", value):
        raise ValueError(f"content-length {value[:30]!r}")
    return int(value)


def parse_record(data: bytes) -> dict | None:
    """The validated record of a decoded frame; None for types other than
    response and revisit. A ValueError says what is wrong."""
    end = data.find(b"\r\n\r\n")
    version, line_end, rest = data[:max(end, 0)].partition(b"\r\n")
    if version not in VERSIONS or not line_end:
        raise ValueError(f"no WARC version line: {data[:20]!r}")
    fields = _fields(rest)
    missing = [f for f in MANDATORY if f not in fields]
    if missing:
        raise ValueError(f"field missing: {', '.join(missing)}")
    length = _length(fields)
    if len(data) != end + 4 + length + 4 or data[-4:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(data) - end - 8} bytes, content-length {length}")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    block = data[end + 4:-4]
    http_end = block.find(b"\r\n\r\n")
    status, line_end, rest = block[:max(http_end, 0)].partition(b"\r\n")
    if not re.match(rb"HTTP/[0-9.]+ [0-9]{3}", status) or not line_end:
        raise ValueError("no HTTP header")
    payload, full = block[http_end + 4:], _length(_fields(rest))
    label, _, digest32 = fields.get("warc-payload-digest", "").partition(":")
    try:
        digest = base64.b32decode(digest32).hex()
    except ValueError:
        digest = ""
    if label != "sha1" or len(digest) != 40:
        raise ValueError("no SHA-1 payload digest")
    refers_to = None
    if kind == "response":
        if len(payload) != full:
            raise ValueError(f"payload of {len(payload)} bytes, HTTP content-length {full}")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload digest differs")
    else:
        if payload or "warc-refers-to" not in fields:
            raise ValueError("a revisit has a payload or refers to nothing")
        refers_to = _page(fields["warc-refers-to"])
    return {"page_id": _page(fields["warc-record-id"]), "target_uri": fields.get("warc-target-uri"),
            "payload_bytes": full, "payload_digest": digest, "record_type": kind, "refers_to": refers_to,
            "payload": payload if kind == "response" else None}


# --- archives ----------------------------------------------------------------

def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class ArchiveWriter:
    """Frames of an open archive; ``close`` gives its bytes."""

    def __init__(self, dictionary: bytes | None, level: int = LEVEL) -> None:
        self.lead = []
        data = None
        if dictionary:
            data = zstandard.ZstdCompressionDict(dictionary)
            self.lead = [skippable(DICTIONARY_MAGIC, zstandard.ZstdCompressor(level=19).compress(dictionary))]
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True)
        self._open()

    def _open(self) -> None:
        self.frames = list(self.lead)
        self.records, self.size = 0, sum(map(len, self.frames))

    def add(self, record: bytes) -> None:
        self.frames.append(self.compressor.compress(record))
        self.size += len(self.frames[-1])
        self.records += 1

    def close(self, last: bytes) -> bytes:
        """The archive without its last bytes ``last``: whoever stores it adds
        them, and a skippable frame declares them."""
        out = b"".join([*self.frames, skippable(SKIPPABLE_MAGIC, last)[:-len(last)]])
        self._open()
        return out


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, by its block headers."""
    header = zstandard.frame_header_size(data[at:at + 18])
    checksum = zstandard.get_frame_parameters(data[at:at + 18]).has_checksum
    at += header
    while True:
        if at + 3 > len(data):
            raise ValueError("frame cut off")
        word = int.from_bytes(data[at:at + 3], "little")
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
        if last:
            at += 4 * checksum
            if at > len(data):
                raise ValueError("frame cut off")
            return at


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """(dictionary of the leading skippable frame, where the frames start)."""
    if len(data) < 8 or int.from_bytes(data[:4], "little") != DICTIONARY_MAGIC:
        return None, 0
    end = 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise ValueError("dictionary cut off")
    body = bytes(data[8:end])
    if int.from_bytes(body[:4], "little") == FRAME_MAGIC:
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=MAX_RECORD_BYTES)
    return zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT), end


def read_frames(content: bytes) -> Iterator[tuple[int, bytes | Exception]]:
    """(offset, decoded frame, or what is wrong with it) one at a time. After a
    frame whose end cannot be found nothing more is read."""
    data = memoryview(content)
    try:
        dictionary, at = load_dictionary(data)
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    except (ValueError, zstandard.ZstdError) as e:
        yield 0, e
        return
    while at < len(data):
        start = at
        try:
            magic = int.from_bytes(data[at:at + 4], "little")
            if SKIPPABLE_MAGIC <= magic < SKIPPABLE_MAGIC + 16:
                at += 8 + int.from_bytes(data[at + 4:at + 8], "little")
                if at > len(data) or start + 8 > len(data):
                    raise ValueError("skippable frame cut off")
                continue
            if magic != FRAME_MAGIC:
                raise ValueError(f"no frame: magic {magic:#x}")
            end = frame_end(data, at)
        except (ValueError, zstandard.ZstdError) as e:
            yield start, e
            return
        at = end
        try:
            if zstandard.frame_content_size(data[start:start + 18]) > MAX_RECORD_BYTES:
                raise ValueError("record too large")
            out: bytes | Exception = decoder.decompressobj().decompress(data[start:end])
        except (ValueError, zstandard.ZstdError, MemoryError) as e:
            out = e
        yield start, out


# --- Spark jobs ----------------------------------------------------------------

def train_dictionary(pages: DataFrame, size: int = DICTIONARY_BYTES, id_col: str = "page_id", url_col: str = "url",
                     payload_col: str = "html") -> bytes | None:
    """A dictionary from a bounded sample of records, drawn by the hash of the
    id; None if there are too few to train on."""
    n = pages.count()
    cut = min(1 << 30, -(-SAMPLE_PAGES * (1 << 30) // max(n, 1)))
    sample = (pages.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < cut)
              .select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.left(F.col(payload_col), F.lit(SAMPLE_CHARS)))
              .limit(2 * SAMPLE_PAGES).collect())
    records = [build_record(i, u, (h or "").encode(), None, False) for i, u, h in sample]
    try:
        return zstandard.train_dictionary(size, records).as_bytes() if len(records) >= 16 else None
    except zstandard.ZstdError:
        return None


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT_BYTES, id_col: str = "page_id",
                 url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, target (largest page_id with that payload where a
    payload of ``min_revisit`` bytes or more occurs more than once, else null),
    shared. Only digests are shuffled; payloads stay in their task as long as
    the payloads that occur more than once are within the broadcast bound."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    key = F.when(F.octet_length(payload) >= min_revisit, F.sha2(payload, 256))
    page = F.col(id_col).cast("long")
    groups = written(pages.select(page.alias("page_id"), key.alias("_key")).filter(F.col("_key").isNotNull())
                     .groupBy("_key").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("_n"))
                     .filter(F.col("_n") > 1).select("_key", "target", F.lit(True).alias("shared")))
    rows = pages.select(page.alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        key.alias("_key"))
    return checked_lookup_join(rows, groups, "_key", groups.count(), how="left").drop("_key")


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL,
                   dictionary_bytes: int = DICTIONARY_BYTES, min_revisit: int = MIN_REVISIT_BYTES,
                   id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One record for each row of ``pages`` in archives under ``path``.

    A null payload counts as empty, a null address has no Target-URI, a null id
    is ``null``. Of records with equal payloads of ``min_revisit`` bytes or
    more the one with the largest id is the response, the others revisit it; of
    rows that share that largest id each is a response, and so are rows of a
    payload that no row with an id has. A payload of any size is one record in
    one frame; memory is bound by an archive and the largest record. An empty
    table gives a folder without archives. Other columns are not read, whatever
    their names."""
    dictionary = train_dictionary(pages, dictionary_bytes, id_col, url_col, payload_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(dictionary, level)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([writer.close(b"\n")], pa.binary())], ["archive"])

        for batch in batches:
            ids, urls, targets, shared = (batch.column(c).to_pylist() for c in ("page_id", "url", "target", "shared"))
            for i, payload in enumerate(batch.column("payload").cast(pa.binary())):
                revisit = bool(shared[i]) and targets[i] is not None and targets[i] != ids[i]
                writer.add(build_record(ids[i], urls[i], payload.as_py(), targets[i], revisit))
                if writer.size >= archive_bytes:
                    yield closed()
        if writer.records:
            yield closed()

    planned = plan_records(pages, min_revisit, id_col, url_col, payload_col)
    # the cast keeps the bytes as they are; a file for each row
    (planned.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(path))


def read_archives(spark: SparkSession, path: str, payload: bool = False, strict: bool = True) -> DataFrame:
    """page_id, target_uri, payload_bytes, payload_digest (hex SHA-1),
    record_type, refers_to, archive, offset (of the frame), error, and the
    payload if asked for (null for a revisit) of every response and revisit
    record; other types are passed over.

    Checked for each record: the frame's end, size and checksum, version line,
    header fields, Content-Length against the block and the closing lines, the
    HTTP length against the payload, the payload against its digest. What fails
    stops the job if ``strict``, else it is a row with ``error`` and nulls, and
    reading goes on with the next frame as long as its start is known. An
    archive without records gives no row."""
    names = ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    fields = [("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()),
              ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
              ("archive", pa.string()), ("offset", pa.int64()), ("error", pa.string())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for offset, frame in read_frames(content.as_buffer()):
                    try:
                        if isinstance(frame, Exception):
                            raise ValueError(str(frame))
                        record = parse_record(frame)
                    except ValueError as e:
                        if strict:
                            raise ValueError(f"{archive} at byte {offset}: {e}") from e
                        record = dict.fromkeys([*names, "payload"]) | {"error": str(e)}
                    if record is None:
                        continue
                    rows.append(record | {"archive": archive, "offset": offset})
                    size += len(record["payload"] or b"") if payload else 0
                    if len(rows) >= 4096 or size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "page_id long, target_uri string, payload_bytes long, payload_digest string, "
                                 "record_type string, refers_to long, archive string, offset long, error string"
                                 + ", payload binary" * payload)
