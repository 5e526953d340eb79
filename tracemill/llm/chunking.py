"""Oversized texts cut into pieces at natural boundaries.

The ends of a text's tokens are the places where it may be cut; each has a
strength (paragraph, line, sentence, clause, word). A sparse table answers range
maximum queries over them: a piece ends at the strongest place in the window
between half the limit and the limit, of equal ones at the rightmost, and the
next piece begins ``overlap`` tokens before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.wordhash import slices
from tracemill.llm.tokens import RANKS, Tokenizer, tokenizer

#: Strengths of places. Fixed values.
INSIDE_CHARACTER, INSIDE_WORD, WORD_EDGE, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(8)
PIECES = "doc_id bigint, piece int, start bigint, end bigint, n_tokens int, boundary int, text string"

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_ENDS = np.zeros(256, np.int8)
_ENDS[list(b".!?")] = SENTENCE
_ENDS[list(b",;:")] = CLAUSE
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")] = True
_ALNUM[128:] = True


def strengths(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The strength of a cut before each byte ``at`` of a text, 0 < at < its length."""
    n = len(raw)
    white = _WHITE[raw]
    left = np.maximum.accumulate(np.where(white, -1, np.arange(n)))  # last byte that isn't white
    after = np.where(white, n, np.arange(n))
    right = np.minimum.accumulate(after[::-1])[::-1]
    lines = np.cumsum((raw == 10) | ((raw == 13) & (np.r_[raw[1:], 0] != 10)))
    begin, end = left[at - 1] + 1, right[at]
    upto = lambda x: np.where(x > 0, lines[np.maximum(x - 1, 0)], 0)
    breaks = upto(end) - upto(begin)
    spaced = end > begin
    before = np.where(begin > 0, _ENDS[raw[np.maximum(begin - 1, 0)]], 0)
    out = np.where(spaced, np.maximum(before, SPACE), INSIDE_WORD)
    out = np.where(breaks == 1, LINE, np.where(breaks > 1, PARAGRAPH, out))
    edge = ~spaced & (_ALNUM[raw[at - 1]] != _ALNUM[raw[at]])
    out = np.where(edge, WORD_EDGE, out)
    return np.where((raw[at] & 0xC0) == 0x80, INSIDE_CHARACTER, out).astype(np.int64)


class RangeMaximum:
    """A sparse table: the largest key of any range from two look-ups."""

    def __init__(self, keys: np.ndarray):
        self.rows = [keys]
        while 2 << (len(self.rows) - 1) <= len(keys):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.maximum(last[:-half], last[half:]))

    def largest(self, a: int, b: int) -> int:
        """Of keys a to b - 1."""
        row = (b - a).bit_length() - 1
        return int(max(self.rows[row][a], self.rows[row][b - (1 << row)]))


def pieces(text: str, limit: int, overlap: int, tok: Tokenizer) -> list[tuple[int, int, int, int]]:
    """``(first byte, end byte, tokens, strength of the end)`` of the pieces of a text.

    Tokens are those of the piece by itself, so never more than ``limit``; where
    the piece alone has more than its part of the whole text had, it is cut
    earlier. Overlaps are counted in tokens of the whole text; one that would
    begin within a character begins a few tokens before it, and where a piece
    has no room for more than its overlap, there is none.
    """
    whole = tok.encode(text)
    data = text.encode("utf-8", "surrogatepass")
    if len(whole) <= limit:
        return [(0, len(data), len(whole), PARAGRAPH)]
    edge = np.r_[0, np.cumsum(tok.sizes[np.array(whole)])]
    n = len(whole)
    raw = np.frombuffer(data, np.uint8)
    strength = np.full(n + 1, PARAGRAPH, np.int64)
    strength[1:n] = strengths(raw, edge[1:n])
    table = RangeMaximum(strength << 40 | np.arange(n + 1))
    out, start, last = [], 0, 0
    while True:
        most = limit
        while True:
            if start + most <= last:  # no room after the overlap: go on without one
                start, most = last, limit
            if start + most >= n:
                cut = n
            else:
                new = last + 1 - start  # a piece ends after the one before
                least = min(max(new, limit // 2), most)
                key = table.largest(start + least, start + most + 1)
                if key >> 40 == INSIDE_CHARACTER:  # nowhere in the window: any whole character will do
                    key = table.largest(start + new, start + most + 1)
                if key >> 40 == INSIDE_CHARACTER and start < last:
                    start, most = last, limit
                    continue
                cut = key & ((1 << 40) - 1)
            alone = len(tok.encode(data[edge[start] : edge[cut]].decode("utf-8", "surrogatepass")))
            if alone <= limit or most <= 1:
                break
            most = max(1, min(most, cut - start) - max(1, alone - limit))
        out.append((int(edge[start]), int(edge[cut]), alone, int(strength[cut])))
        if cut >= n:
            return out
        last = cut
        back = max(cut - overlap, start + 1)
        while back > start + 1 and strength[back] == INSIDE_CHARACTER:
            back -= 1
        start = back if strength[back] != INSIDE_CHARACTER else cut


def split_oversized(documents: DataFrame, limit: int = 512, overlap: int = 64, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """The pieces of every text, in order: ``doc_id, piece`` (from 0), ``start``, ``end``
    (characters of the text), ``n_tokens``, ``boundary`` (strength of its end), ``text``.

    A text within ``limit`` tokens is one piece, an empty one too; a null text or
    id gives no row. Of equal rows each gives its pieces; other columns are
    ignored. ``limit`` has to be over twice ``overlap`` and at least 8.
    """
    if limit < 8 or overlap < 0 or limit <= 2 * overlap:
        raise ValueError("limit has to be at least 8 and over twice the overlap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = pieces(text, limit, overlap, tok)
                    if len(found) == 1:
                        rows.append((doc, 0, 0, len(text), found[0][2], PARAGRAPH, text))
                        continue
                    data = text.encode("utf-8", "surrogatepass")
                    wide = len(data) != len(text)
                    at = byte = 0
                    for i, (a, b, n, s) in enumerate(found):
                        if wide:
                            at, byte = at + len(data[byte:a].decode("utf-8", "surrogatepass")), a
                        piece = data[a:b].decode("utf-8", "surrogatepass")
                        first = at if wide else a
                        rows.append((doc, i, first, first + len(piece), n, s, piece))
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null").mapInArrow(run, PIECES)
