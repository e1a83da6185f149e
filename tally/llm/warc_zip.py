"""WARC records in ZIP archives: written by Spark tasks and read in place.

Each task writes one ZIP with two stored members, the records (each a gzip
member of its own, as is usual for WARC) and an index of them. The reader parses the end record, the central directory and its ZIP64
fields and the local headers, and then reads single records by their ranges:
nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import NULL_ID, id_key, materialise, new_path, open_store, qualified, spread_join

#: Fixed values of the ZIP format: signatures and record layouts.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_HEAD = struct.Struct("<4s5HIIIHH")
CENTRAL_HEAD = struct.Struct("<4s6HIIIHHHHHII")
END_HEAD = struct.Struct("<4sHHHHIIH")
END64_HEAD = struct.Struct("<4sQHHIIQQQQ")
LOCATOR_HEAD = struct.Struct("<4sIQI")
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
#: One index line per record: record key, offset and length within the records' member.
INDEX_LINE = struct.Struct("<qQQ")
#: Bytes of records that one reading task takes, about, and after which a writing task starts another archive.
SPLIT, ARCHIVE = 32 << 20, 1 << 30


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class StoredZipWriter:
    """Writes stored members of unknown length one after the other; always with ZIP64 fields."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def start(self, name: str) -> None:
        raw = name.encode()
        # Bit 3: length and checksum follow the data; bit 11: the name is UTF-8.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.members.append([raw, self.at, 0, 0])
        self._write(LOCAL_HEAD.pack(LOCAL, 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        m = self.members[-1]
        m[2] += len(data)
        m[3] = zlib.crc32(data, m[3])
        self._write(data)

    def end(self) -> None:
        _, _, size, crc = self.members[-1]
        self._write(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))

    def close(self) -> int:
        start = self.at
        for raw, at, size, crc in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._write(CENTRAL_HEAD.pack(CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32) + raw + extra)
        end, n = self.at, len(self.members)
        self._write(END64_HEAD.pack(END64, END64_HEAD.size - 12, 45, 45, 0, 0, n, n, end - start, start))
        self._write(LOCATOR_HEAD.pack(LOCATOR64, 0, end, 1))
        self._write(END_HEAD.pack(END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        return self.at


def _range(file, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def _wide(extra: bytes, size: int, packed: int, at: int) -> tuple[int, int, int]:
    """The three numbers with those that did not fit taken from the ZIP64 field."""
    pos = 0
    while pos + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, pos)
        if kind == 1:
            field, k, out = extra[pos + 4 : pos + 4 + n], 0, []
            for x in (size, packed, at):
                if x == FULL32 and k + 8 <= len(field):
                    x = struct.unpack_from("<Q", field, k)[0]
                    k += 8
                out.append(x)
            return tuple(out)
        pos += 4 + n
    return size, packed, at


def stored_members(file) -> dict[str, tuple[int, int]]:
    """name -> (offset of the data, length) of the stored members of a ZIP in a random-access file."""
    total = file.size()
    tail_at = max(0, total - END_HEAD.size - FULL16 - LOCATOR_HEAD.size)
    tail = _range(file, tail_at, total - tail_at)
    k = tail.rfind(END, 0, max(0, len(tail) - END_HEAD.size + len(END)))
    while k >= 0 and k + END_HEAD.size + struct.unpack_from("<H", tail, k + 20)[0] != len(tail):
        k = tail.rfind(END, 0, k)
    if k < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, size, at, _ = END_HEAD.unpack_from(tail, k)
    if k >= LOCATOR_HEAD.size and tail[k - LOCATOR_HEAD.size : k - LOCATOR_HEAD.size + 4] == LOCATOR64:
        where = LOCATOR_HEAD.unpack_from(tail, k - LOCATOR_HEAD.size)[2]
        head = END64_HEAD.unpack(_range(file, where, END64_HEAD.size))
        if head[0] != END64:
            raise ValueError("broken ZIP64 end record")
        n, size, at = head[7], head[8], head[9]
    directory, out, pos = _range(file, at, size), {}, 0
    for _ in range(n):
        h = CENTRAL_HEAD.unpack_from(directory, pos)
        if h[0] != CENTRAL:
            raise ValueError("broken central directory")
        pos += CENTRAL_HEAD.size
        name, extra = directory[pos : pos + h[10]], directory[pos + h[10] : pos + h[10] + h[11]]
        pos += h[10] + h[11] + h[12]
        full, packed, local = _wide(extra, h[9], h[8], h[16])
        if h[4] == 0 and not h[3] & 1:
            # The local header's own lengths tell where the data start.
            lh = LOCAL_HEAD.unpack(_range(file, local, LOCAL_HEAD.size))
            if lh[0] != LOCAL:
                raise ValueError("broken local header")
            out[name.decode("utf-8" if h[3] & 0x800 else "cp437")] = (local + LOCAL_HEAD.size + lh[9] + lh[10], packed)
    return out


def index_entry(page: int | None, at: int, size: int) -> bytes:
    return INDEX_LINE.pack(NULL_ID if page is None else page, at, size)


def index_ranges(raw: bytes) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record of an index."""
    for _, at, size in INDEX_LINE.iter_unpack(raw):
        yield at, size


def _record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}


def parse_record(raw: bytes) -> dict:
    """Page, type, payload digest and length of one record; a response's are taken from its payload itself."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = h["warc-record-id"][len("<urn:page:") : -1]
    refers = h.get("warc-refers-to")
    response = h["warc-type"] == "response"
    return {
        "page_id": int(page) if page else None,
        "url": h.get("warc-target-uri"),
        "record_type": h["warc-type"],
        "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None,
        "payload_bytes": len(payload) if response else int(_headers(http)["content-length"]),
        "payload_digest": sha1_base32(payload) if response else h["warc-payload-digest"].split(":")[1],
        "payload": payload if response else None,
    }


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, row_key, refers_to) of the pages whose payload a page with a larger id has too."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    keys = pages.select(id_key(id_col).alias("id"), F.xxhash64(body).alias("row_key"), F.sha1(F.encode(body, "UTF-8")).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= min_bytes)
    keys = materialise(keys, "warc-digests")
    groups = materialise(keys.groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1"), "warc-groups")
    # The empty page may be a third of all pages.
    return spread_join(keys, groups, ["digest"], "n").where("id < top").select("id", "row_key", F.col("top").alias("refers_to")).dropDuplicates(["id", "row_key"])


class ArchiveWriter:
    """One ZIP archive under a new name in ``root``: the records' member, then the index."""

    def __init__(self, root: str):
        self.name = f"{root}/pages-{uuid.uuid4().hex}.zip"
        fs, where = open_store(self.name)
        fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(where)
        self.zipped, self.index, self.bytes, self.records = StoredZipWriter(self.out), bytearray(), 0, 0
        self.zipped.start("archive/pages.warc.gz")

    def add(self, page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        raw = gzip.compress(_record(page, url, payload, refers_to), 1, mtime=0)
        self.zipped.write(raw)
        self.index += index_entry(page, self.bytes, len(raw))
        self.bytes += len(raw)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        """The archive's row of the manifest."""
        self.zipped.end()
        self.zipped.start("indexes/pages.idx")
        self.zipped.write(bytes(self.index))
        self.zipped.end()
        size = self.zipped.close()
        self.out.close()
        return pa.RecordBatch.from_pydict({"archive": [self.name], "records": [self.records], "bytes": [size]})


MANIFEST = "archive string, records long, bytes long"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes a WARC record per row into ZIP archives; returns their manifest (archive, records, bytes).

    Null html is an empty payload, a null url an empty one. Of rows with equal
    payloads of at least ``min_bytes`` bytes the one with the largest id is the
    response (repeated rows of that id all are), the others revisit it; a null
    id counts as the smallest. An archive gets a new name in each attempt, and
    only those in the committed manifest count.
    """
    spark = pages.sparkSession
    root = qualified(spark, path or new_path(spark, "warc"))
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), id_key(id_col).alias("id"), F.xxhash64(body).alias("row_key"), F.col(url_col).cast("string").alias("url"), body.alias("html"))
    rows = rows.join(revisits(pages, id_col, html_col, min_bytes), ["id", "row_key"], "left").select("page", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for page, url, html, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                out = out or ArchiveWriter(root)
                out.add(page, url, html.as_py().encode(), refers)
                if out.bytes >= ARCHIVE:
                    yield out.close()
                    out = None
        if out is not None:
            yield out.close()

    return materialise(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def splits(manifest: DataFrame, split_bytes: int = SPLIT) -> DataFrame:
    """(archive, data_at, first, ranges): runs of consecutive records of about ``split_bytes``, from the archives' indexes."""

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["archive"]:
                fs, where = open_store(archive)
                with fs.open_input_file(where) as f:
                    members = stored_members(f)
                    for name, (at, n) in members.items():
                        if not name.startswith("indexes/"):
                            continue
                        data_at, _ = members["archive/" + name.split("/", 1)[1].rsplit(".", 1)[0] + ".warc.gz"]
                        run, have, out = [], 0, []
                        for start, size in index_ranges(_range(f, at, n)):
                            run.append((start, size))
                            have += size
                            if have >= split_bytes:
                                out.append((archive, data_at, run))
                                run, have = [], 0
                        if run:
                            out.append((archive, data_at, run))
                        yield pd.DataFrame([(a, d, [{"start": s, "size": z} for s, z in r]) for a, d, r in out], columns=["archive", "data_at", "ranges"])

    # As many tasks as archives: each reads one archive's directory and index.
    n = max(1, manifest.count())
    return manifest.select("archive").repartitionByRange(n, "archive").mapInPandas(locate, "archive string, data_at long, ranges array<struct<start:long,size:long>>")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to[, url, payload].

    The index gives each record's range; records are read and parsed one by
    one, so memory holds one record (and one output batch) at a time, however
    long it is. Repeated rows and rows of a null id come back as they were
    written; no archives give no rows.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * with_payload
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                fs, where = open_store(s["archive"])
                with fs.open_input_file(where) as f:
                    rows: list[dict] = []
                    for r in s["ranges"]:
                        rows.append(parse_record(_range(f, s["data_at"] + r["start"], r["size"])))
                        if not with_payload:
                            rows[-1].pop("payload")
                        if len(rows) >= (200 if with_payload else 5000):
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    # As many tasks as splits, which a given number of partitions keeps apart.
    cut = materialise(splits(manifest), "warc-splits")
    cut = cut.select("*", F.get("ranges", F.lit(0))["start"].alias("at"))
    return cut.repartitionByRange(max(1, cut.count()), "archive", "at").mapInArrow(read, schema)
