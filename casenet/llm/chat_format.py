"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the
sorted spans of the assistant texts are intersected with the token spans by
binary search. Control strings that occur inside roles or texts are escaped:
a backslash is doubled and ``<|`` becomes ``<\\|``, so the markers of the
template are the only ones that a reader or the tokenizer can see, and
``unescape`` restores every text.

Edge cases: null roles and texts are empty; turns are ordered by (turn, role,
text), so ties and repeated rows have one defined order and all stay; a text or
conversation of any length is taken whole, as one row and one call of the
encoder, as the ids depend on all of it; a null
conv_id is a conversation like any other; an empty table gives an empty
result; columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, processors

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
SCHEMA = "conv_id bigint, n_turns bigint, formatted string, ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of ``path`` with the three markers as added tokens, and offsets that keep leading spaces."""
    loaded = Tokenizer.from_file(path)
    loaded.add_special_tokens([START, SEP, END])
    loaded.post_processor = processors.ByteLevel(trim_offsets=False)
    return loaded


def render(turns: list[tuple[str, str]], learned_role: str = "assistant") -> tuple[str, np.ndarray]:
    """The whole conversation and the (start, end) of each text of ``learned_role``, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        if role == learned_role and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def mask_tokens(start: np.ndarray, end: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for each token that lies within one of the sorted spans."""
    if not len(spans):
        return np.zeros(len(start), dtype=bool)
    at = np.searchsorted(spans[:, 0], start, side="right") - 1
    return (at >= 0) & (end <= spans[np.maximum(at, 0), 1]) & (end > start)


def masked_pieces(formatted: str, start: np.ndarray, end: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the mask: touching or overlapping token spans are joined, each text unescaped."""
    s, e = start[mask], end[mask]
    if not len(s):
        return []
    reach = np.maximum.accumulate(e)
    first = np.concatenate([[True], s[1:] > reach[:-1]])
    opens, closes = s[first], np.concatenate([reach[:-1][first[1:]], reach[-1:]])
    return [unescape(formatted[a:b]) for a, b in zip(opens.tolist(), closes.tolist(), strict=True)]


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def format_conversations(conversations: DataFrame, tokenizer_path: str, learned_role: str = "assistant") -> DataFrame:
    """One row for each conversation: its rendered text, token ids, token offsets and loss mask."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: dict[str, list] = {name: [] for name in ("n_turns", "formatted", "ids", "token_start", "token_end", "loss_mask")}
                for roles, texts in zip(part.column("roles").to_pylist(), part.column("texts").to_pylist(), strict=True):
                    formatted, spans = render(list(zip(roles, texts, strict=True)), learned_role)
                    coded = encoder.encode(formatted, add_special_tokens=False)
                    offsets = np.array(coded.offsets, dtype=np.int32).reshape(-1, 2)
                    row = (len(roles), formatted, coded.ids, offsets[:, 0], offsets[:, 1], mask_tokens(offsets[:, 0], offsets[:, 1], spans))
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
                kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["conv_id", *out])

    return whole.mapInArrow(run, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted rows hold when read back: turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, turns_hash, loss_chars, loss_hash, chars = [], [], [], [], []
            columns = [batch.column(c) for c in ("formatted", "token_start", "token_end", "loss_mask")]
            for k in range(batch.num_rows):
                text, start, end, mask = columns[0][k].as_py(), *(c[k].values.to_numpy(zero_copy_only=False) for c in columns[1:])
                turns = read_turns(text)
                loss = "".join(masked_pieces(text, start, end, mask.astype(bool)))
                n.append(len(turns))
                turns_hash.append(hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest())
                loss_chars.append(len(loss))
                loss_hash.append(hashlib.sha256(loss.encode()).hexdigest())
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(turns_hash, pa.string()), pa.array(loss_chars, pa.int64()), pa.array(loss_hash, pa.string()), pa.array(chars, pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
