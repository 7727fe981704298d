"""Byte-level BPE with the tiktoken library and a local rank file.

A long text is cut where the pre-token pattern ends a match whatever stands
around: before white space behind any other character, and between characters
of different kinds (letters, digits, others) save behind an apostrophe, which
may begin a contraction. The parts encode to the same ids as the whole. A run
of more than ``PART`` white-space characters never meets the pattern, whose
look-ahead would go through all of it: all but its last character are one match
(all of them at the end of the text), so they are merged as one piece. Only a
run of one kind without any such place, which is one match, is a longer part.

Edge cases: a null text is empty and has no ids; strings that look like special
tokens are ordinary text; repeated rows are encoded each for itself; an empty
table gives an empty result; ``encode`` passes other columns through unless
they bear the name of an output column, which then wins.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

PART = 1 << 16
# White space as the pattern sees it, and characters whose kind is the same in every version of Unicode.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_OTHER = r"!-&(-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1f"
_SAFE = re.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=[{_LETTER}])(?=[0-9'{_OTHER}])|(?<=[0-9])(?=[{_LETTER}'{_OTHER}])|(?<=[{_OTHER}])(?=[{_LETTER}0-9])")
_ONE_PIECE = r"(?s:.+)"


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(f"ranks:{path}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART) -> Iterator[str]:
    """Parts of about ``size`` characters whose joints no pre-token crosses; one part if there is no such place."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def pieces(text: str, size: int = PART) -> Iterator[tuple[bool, str]]:
    """Parts of a long text, and whether one is a whole pre-token of white space."""
    at = 0
    for run in re.finditer(rf"[{_SPACE}]{{{size + 1},}}", text):
        yield from ((False, part) for part in safe_parts(text[at : run.start()], size))
        at = run.end() - (run.end() < len(text))
        yield True, text[run.start() : at]
    yield from ((False, part) for part in safe_parts(text[at:], size))


def encode_text(path: str, pattern: str, text: str, size: int = PART) -> list[int]:
    enc = encoding(path, pattern)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    whole = encoding(path, _ONE_PIECE)
    return [token for one, part in pieces(text, size) for token in (whole if one else enc).encode_ordinary(part)]


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, an array of token ids, to each row."""
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode_text(path, pattern, text or "") for text in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, out])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{out}` array<int>"]))


def count_tokens(docs: DataFrame, path: str, pattern: str, column: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add ``out``, the number of token ids, to each row; the column itself goes."""
    docs = docs.select(*(c for c in docs.columns if c not in (column, out)), column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(encode_text(path, pattern, text.as_py() or "")) for text in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], out])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1]), f"`{out}` bigint"]))


def decode(rows: DataFrame, path: str, pattern: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the raw bytes of the ids (no UTF-8 repair), to each row; null ids give empty bytes."""
    rows = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [enc.decode_bytes(ids or []) for ids in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, out])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` binary"]))


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, and SHA-256 of the id list and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids_hash, text_hash = [], [], []
                for text in part.column("text").to_pylist():
                    ids = encode_text(path, pattern, text or "")
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(n, dtype=np.int64)), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
