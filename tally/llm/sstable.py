"""Token ids as sorted-string-table shards.

A shard holds documents in ascending key order:

    block*            entries (shared, unshared, value length as varints; key rest; value)
    index             per block: last key, offset, length, first document's ordinal and token offset
    bloom             bit array over the keys
    footer            offsets, counts, id width, hash count, magic

Keys are 9 bytes that sort as the ids do (null first). A key shares its prefix
with the key before it, anew in each block. Values are little-endian ids of
two or four bytes. A lookup reads footer, Bloom filter, index and one block.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import NULL_ID, id_key, materialise, new_path, open_store, qualified
from tally.llm.word_chunks import PIECES, PLAIN, PartCache, PieceCache, byte_characters

MAGIC = b"TLYSST1\0"
FOOTER = struct.Struct("<QQQQQQQBB6x8s")
INDEX = struct.Struct("<9sQQQQ")
BLOCK = 64 * 1024
BITS_PER_KEY, HASHES = 10, 7
#: Bytes of text that make a shard, about.
SHARD_TEXT = 128 << 20

_loaded: dict = {}


def key_of(i: int | None) -> bytes:
    """Nine bytes that sort as the ids do; null is the smallest."""
    return bytes(9) if i is None else b"\1" + struct.pack(">Q", (int(i) + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bits(key: bytes, n: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + k * b) % n for k in range(HASHES)]


class ShardWriter:
    """Writes one shard to an open binary stream; memory holds one block, the index and the keys."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.offset = self.tokens = self.docs = 0
        self.first = (0, 0)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = key_of(doc_id)
        if self.docs and key < self.keys[-1]:
            raise ValueError("documents must come in ascending order of their ids")
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = (self.docs, self.tokens)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.tokens += len(ids) // self.width
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append(INDEX.pack(self.last, self.offset, len(self.block), *self.first))
            self.offset += len(self.block)
            self.block = bytearray()

    def close(self) -> int:
        """Writes index, filter and footer; returns the bytes of the shard."""
        self._flush()
        index = b"".join(self.index)
        n = max(64, BITS_PER_KEY * len(self.keys))
        bits = np.zeros((n + 7) // 8 * 8, np.uint8)
        for key in self.keys:
            bits[_bits(key, n)] = 1
        bloom = np.packbits(bits).tobytes()
        end = self.offset
        self.out.write(index + bloom + FOOTER.pack(end, len(index), end + len(index), len(bloom), n, self.docs, self.tokens, self.width, HASHES, MAGIC))
        return end + len(index) + len(bloom) + FOOTER.size


class ShardReader:
    """Reads a shard from a random-access file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        f = FOOTER.unpack(file.read(FOOTER.size))
        if f[-1] != MAGIC:
            raise ValueError("not a shard")
        self.index_at, index_len, self.bloom_at, self.bloom_len, self.n_bits, self.docs, self.tokens, self.width = f[:8]
        file.seek(self.index_at)
        raw = file.read(index_len)
        self.blocks = [INDEX.unpack_from(raw, at) for at in range(0, index_len, INDEX.size)]
        self.last_keys = [b[0] for b in self.blocks]
        self.bloom = None

    def _entries(self, block) -> Iterator[tuple[bytes, memoryview]]:
        self.file.seek(block[1])
        raw = self.file.read(block[2])
        at, key = 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, memoryview(raw)[at : at + size]
            at += size

    def ids(self, value) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4")

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, tokens of the shard before it, ids) in key order, block by block."""
        for block in self.blocks:
            start = block[4]
            for key, value in self._entries(block):
                ids = self.ids(value)
                yield id_of(key), start, ids
                start += len(ids)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this key, by Bloom filter and binary search."""
        key = key_of(doc_id)
        if self.bloom is None:
            self.file.seek(self.bloom_at)
            self.bloom = np.unpackbits(np.frombuffer(self.file.read(self.bloom_len), np.uint8))
        if not self.bloom[_bits(key, self.n_bits)].all():
            return []
        out = []
        for block in self.blocks[bisect.bisect_left(self.last_keys, key) :]:
            found = False
            for k, v in self._entries(block):
                if k == key:
                    out.append(self.ids(v))
                    found = True
                elif k > key:
                    return out
            if not found and out:
                return out
        return out


class IdEncoder:
    """text -> ids as little-endian bytes, by the tokenizers library with a cache of parts."""

    def __init__(self, file: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        top = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id)
        self.width = 2 if top < 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.end = np.array([end_id], self.dtype).tobytes()
        self.code = "H" if self.width == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = dict(enumerate(byte_characters()))
        self.space = self.shown[32]
        self.model = self.tokenizer.model
        self.pieces = PieceCache(self._piece)
        self.cache = PartCache(self._whole)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and "\n" not in piece:
            shown = piece.replace(" ", self.space)
        else:
            shown = piece.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def document(self, text: str | None) -> bytes:
        """The ids of a whole text and the end id; null counts as empty.

        A plain text is split into pre-tokens here, and the library's model
        encodes each of them once; any other text goes through the library in
        parts.
        """
        text = text or ""
        if PLAIN(text) and not any(x in text for x in self.special):
            self.pieces.make_room()
            return b"".join(map(self.pieces.__getitem__, PIECES(text))) + self.end
        return self.cache.document(text) + self.end


def _encoder(file: str, end_id: int) -> IdEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (file, end_id) not in _loaded:
        _loaded[file, end_id] = IdEncoder(file, end_id)
    return _loaded[file, end_id]


MANIFEST = "shard string, first_id long, last_id long, docs long, tokens long, bytes long, has_null boolean"


def write_shards(docs: DataFrame, file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes shards; returns their manifest with ``start``.

    Text is range-partitioned by id before it is encoded, into parts of about
    SHARD_TEXT bytes but no fewer than shuffles have, so each task encodes and
    writes one shard. A shard gets a name of its own in each attempt; only
    those named in the committed manifest count. ``start`` is the number of
    ids in all shards before. Null text counts as empty (one id, the end), a
    null id sorts first, repeated ids follow one another; an empty table gives
    no shard. A very long text is one value, encoded whole by the task that has
    its id. Other columns are not read.
    """
    spark = docs.sparkSession
    root = qualified(spark, path or new_path(spark, "sstable"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(file, end_id)
        out = writer = None
        first = last = None
        has_null = False
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                if out is None:
                    name = f"{root}/shard-{uuid.uuid4().hex}.sst"
                    fs, where = open_store(name)
                    fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(where)
                    writer = ShardWriter(out, enc.width)
                writer.add(i, enc.document(text.as_py()))
                has_null |= i is None
                first = i if first is None else first
                last = i
        if out is not None:
            size = writer.close()
            out.close()
            row = pd.DataFrame([[name, first, last, writer.docs, writer.tokens, size, has_null]], columns=[c.split()[0] for c in MANIFEST.split(", ")])
            yield pa.RecordBatch.from_pandas(row.astype({"first_id": "Int64", "last_id": "Int64"}), preserve_index=False)

    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = pairs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_TEXT))
    manifest = materialise(pairs.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(write, MANIFEST), "sstable-manifest")
    # One row a shard: the running sum over shards is small.
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents, read back from the shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, base in zip(b.column("shard").to_pylist(), b.column("start").to_pylist()):
                fs, where = open_store(shard)
                with fs.open_input_file(where) as f:
                    rows: list[tuple] = []
                    for i, start, ids in ShardReader(f).scan():
                        wide = ids.astype("<u4")
                        rows.append((i, base + start, len(ids), zlib.crc32(wide.tobytes()), wide.astype(np.int32) if with_ids else None))
                        if len(rows) >= (500 if with_ids else 20_000):
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
        names = ["id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array(list(cols[4]), pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    # As many tasks as shards: each reads one.
    return manifest.select("shard", "start").repartitionByRange(max(1, manifest.count()), "start", "shard").mapInArrow(read, schema).withColumnRenamed("id", id_col)


def lookup(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted ids, each read from the shards whose range holds it; a null id finds the documents without one.

    The bounds of all shards, two numbers for each SHARD_TEXT bytes, go to
    every task, which finds an id's shards by binary search.
    """
    bounds = manifest.orderBy(F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first()).select("shard", "first_id", "last_id", "has_null").collect()
    names = [r["shard"] for r in bounds]
    # A shard that begins with null ids begins with the smallest key; one of null ids only also ends with it.
    low = np.array([NULL_ID if r["has_null"] or r["first_id"] is None else r["first_id"] for r in bounds], np.int64)
    high = np.array([NULL_ID if r["last_id"] is None else r["last_id"] for r in bounds], np.int64)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key = b["key"].to_numpy(np.int64)
            first, last = np.searchsorted(high, key, "left"), np.searchsorted(low, key, "right")
            hit = [(i, names[s]) for i, a, z in zip(key.tolist(), first.tolist(), last.tolist()) for s in range(a, z)]
            yield pd.DataFrame(hit, columns=["key", "shard"])

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, where = open_store(pdf["shard"].iloc[0])
        with fs.open_input_file(where) as f:
            shard = ShardReader(f)
            ids = [None if k == NULL_ID else int(k) for k in pdf["key"]]
            found = [(i, v.astype(np.int32)) for i in ids for v in shard.get(i)]
            return pd.DataFrame({"id": pd.array([i for i, _ in found], "Int64"), "ids": [v for _, v in found]})

    w = wanted.select(id_key(id_col).alias("key")).distinct()
    routed = w.mapInPandas(route, "key long, shard string")
    return routed.groupBy("shard").applyInPandas(find, "id long, ids array<int>").withColumnRenamed("id", id_col)
