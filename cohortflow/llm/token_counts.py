"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once, whole. Tokens of a byte-level vocabulary are byte
strings, so their lengths give every token's byte span and, by counting the
bytes that begin a character, its character span. Token spans and section spans
are both sorted and are joined on overlap by binary search. Rule for tokens that
cross a boundary: a token belongs to the section that holds most of its
characters, of equal shares to the first; a token that begins inside a character
covers that character. So each token counts once and the sections of a document
add up to its tokens.

Null and empty texts have one empty section and no tokens. Empty sections count
0. Repeated rows are counted each. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import slices

#: A longer text is encoded in pieces cut before a blank between two visible
#: characters, where no token of this vocabulary's pattern reaches across.
PIECE = 1 << 21
_CUT = re.compile(r"(?<=\S)(?= \S)")

_ENCODERS: dict[str | None, tuple] = {}


def encoder(path: str | None):
    """Encoding and the byte length of every id."""
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _ENCODERS[path] = (tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes)
    return _ENCODERS[path]


def token_spans(text: str, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of every token of the whole text."""
    coding, sizes = encoder(path)
    ids, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE and (m := _CUT.search(text, at + PIECE)):
            end = m.start()
        ids.append(np.array(coding.encode_ordinary(text[at:end]), np.int64))
        at = end
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = sizes[np.concatenate(ids)]
    end = np.cumsum(size)
    if end[-1] == len(text):  # one byte each
        return end - size, end
    data = np.frombuffer(text.encode(), np.uint8)
    begun = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters begun before each byte
    first = begun[end - size + 1] - 1
    return first, np.maximum(begun[end], first + 1)


def lines(text: str) -> np.ndarray:
    """Bounds of the lines, each with its newline: starts and the end of the text."""
    starts = [0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))]
    return np.array([*starts, len(text)], np.int64)


def attribute(first: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [bounds[k], bounds[k + 1]), and how many of them cross a bound."""
    n = len(bounds) - 1
    low = np.searchsorted(bounds[1:], first, side="right")
    high = np.searchsorted(bounds[1:], np.maximum(end - 1, first), side="right")
    owner, crossing = low.copy(), high > low
    for t in np.flatnonzero(crossing).tolist():
        inside = np.arange(low[t], high[t] + 1)
        share = np.minimum(end[t], bounds[inside + 1]) - np.maximum(first[t], bounds[inside])
        owner[t] = inside[int(share.argmax())]
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(docs: DataFrame, sections: Callable[[str], np.ndarray] = lines, path: str | None = None) -> DataFrame:
    """doc_id, section, first, end (characters), n_tokens, n_crossing for every section of every document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in range(6)]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = text or ""
                    bounds = sections(text)
                    n, crossing = attribute(*token_spans(text, path), bounds)
                    k = len(n)
                    for column, value in zip(out, ([doc] * k, range(k), bounds[:-1].tolist(), bounds[1:].tolist(), n.tolist(), crossing.tolist())):
                        column.extend(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                                 ["doc_id", "section", "first", "end", "n_tokens", "n_crossing"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, section int, first long, end long, n_tokens long, n_crossing long")
