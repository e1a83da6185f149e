"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at boundaries that no match of the pattern can cross, so
the pieces encode exactly as the whole text would. Decoding works on raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters encoded at once, about.
CHUNK = 1 << 16
#: A match never runs on from a letter, digit or ASCII sign into white space, nor
#: from an ASCII letter into an ASCII digit.
SAFE = re.compile(r"(?<=[A-Za-z0-9!-~À-ɏ])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])")

#: The characters with Unicode's White_Space property, as a regular-expression class body.
WHITE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space of which the library would need a stack as deep as the run is long.
LONG_RUN = re.compile(f"[{WHITE}]{{10000,}}")
#: How a pattern ends that takes a run of white space whole at the end of a text and else leaves its last character.
RUN_RULE = r"|\s+(?!\S)|\s+"

_loaded: dict = {}


def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a local rank file; loaded once per Python worker."""
    key = (rank_file, pattern)
    if key not in _loaded:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _loaded[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def split_safely(text: str, size: int = CHUNK) -> Iterator[str]:
    """Pieces of about ``size`` characters, cut at safe boundaries only; a text without one stays whole."""
    at = 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if m is None or m.start() >= len(text):
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode(enc, text: str | None, size: int = CHUNK) -> list[int]:
    """The ids of a whole text, special strings being ordinary text; null counts as empty.

    A long run of white space is one match of the pattern, all of it at the end
    of a text and all but its last character elsewhere, and is encoded as such.
    """
    text = text or ""
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    pattern = enc._pat_str
    runs = LONG_RUN.finditer(text) if pattern.endswith(RUN_RULE) and pattern.count(r"\s") == 3 else ()
    for run in runs:
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in split_safely(text[at : run.start()], size):
            ids += enc.encode_ordinary(piece)
        ids += enc._encode_single_piece(text[run.start() : end])
        at = end
    for piece in split_safely(text[at:], size):
        ids += enc.encode_ordinary(piece)
    return ids


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens) per row; null text counts as empty and gives no ids, null ids stay null.

    Rows are independent: repeated rows give repeated rows, other columns are
    not read, an empty table gives an empty result. A very long text is cut at
    safe places and around long runs of white space; what has neither, as a
    single run of signs, is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            ids = [encode(enc, t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())],
                names=["id", "ids", "n_tokens"],
            )

    return _pair(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>, n_tokens long").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) with the raw bytes of each id list; a null list decodes to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            raw = [enc.decode_bytes(x.as_py() or []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["id", "decoded"])

    pair = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return pair.mapInArrow(run, "id long, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded again,
    with digests in place of the ids and bytes so that only 100-odd bytes a document leave the task.
    Null texts, null and repeated ids, very long texts and empty tables as in :func:`encode_documents`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for t in b.column(1):
                ids = encode(enc, t.as_py())
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _pair(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def _pair(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text: Column = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
