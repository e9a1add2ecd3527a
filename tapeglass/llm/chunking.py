"""Oversized texts in pieces: content-defined chunking at natural boundaries.

A rolling hash over the words marks landmarks that depend on nearby text alone.  From the start of a
piece, the first landmark beyond the least size snaps to the nearest natural boundary between the
least and the greatest size, so an edit moves the cuts near it only.  Without a natural boundary the
landmark itself is the cut, without a landmark the last word (or character) that fits.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeglass.llm.tokens import Counter, counter, encode, tokenizer_file

#: natural boundaries, strongest first; a boundary is where the text after the match begins
BOUNDARIES = (
    ("heading", re.compile(r"\n+(?=#{1,6}\s|[A-Z0-9][A-Z0-9 .,&/-]{3,60}\n|(?:Item|Section|Chapter|Part)\s+\d)")),
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*|\f\s*")),
    ("turn", re.compile(r"[\r\n]+(?=[^\s:][^\n:]{0,40}:\s)")),
    ("line", re.compile(r"\r\n?|\n")),
    ("sentence", re.compile(r"(?<=[.!?])[\"')\]”’]*\s+|(?<=[。！？])(?:[”’」』]*)\s*")),
)
_WINDOW = 8
_MASK = 63


class Chunker:
    """Cuts texts under one tokenizer; see ``split_oversized``."""

    def __init__(self, path: str, limit: int, overlap: int, least: int):
        if not 0 <= overlap < least <= limit - overlap:
            raise ValueError("overlap must be below the least size, and both together within the limit")
        self.path, self.limit, self.overlap, self.least = path, limit, overlap, least
        self.counts: Counter = counter(path)

    def pieces(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """(start, end, characters shared with the piece before, tokens, boundary at the end) of each piece."""
        words, counts = self.counts.parts(text)
        total = sum(counts)
        if total <= self.limit:
            return [(0, len(text), 0, total, "end")]
        words, sizes, places = self.counts.fine_parts(words, counts)
        cum = [0, *np.cumsum(sizes).tolist()]
        # starts[k]: where part k begins, with the space before it
        starts = [*places.tolist(), len(text)]
        marks = self._landmarks(words)
        out, begin, body = [], 0, 0
        while True:
            start = self._head(text, starts, begin)
            rest = start[1] + cum[-1] - cum[start[0]]
            if rest <= self.limit:
                out.append((begin, len(text), body - begin, rest, "end"))
                return out
            cut, kind, n = self._cut(text, starts, cum, marks, begin, start, body)
            out.append((begin, cut, body - begin, n, kind))
            begin, body = self._back(text, starts, cum, cut, body), cut

    def _head(self, text: str, starts: list[int], at: int) -> tuple[int, int]:
        """The first part that begins at ``at`` or later, and the tokens up to it."""
        i = bisect_right(starts, at) - 1
        return (i, 0) if starts[i] == at else (i + 1, len(encode(self.path, text[at : starts[i + 1]])))

    def _landmarks(self, words: list[str]) -> np.ndarray:
        """Parts after which a landmark lies."""
        h = np.array(list(map(zlib.crc32, map(str.encode, words, repeat("utf-8"), repeat("replace")))), dtype=np.uint64)
        n = len(h) - _WINDOW + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        r = np.zeros(n, dtype=np.uint64)
        for k in range(_WINDOW):
            r = r * np.uint64(0x100000001B3) + h[k : k + n]
        r ^= r >> np.uint64(29)
        return np.flatnonzero((r & np.uint64(_MASK)) == 0) + _WINDOW

    def _exact(self, text: str, starts: list[int], cum: list[int], begin: int, start: tuple[int, int], z: int) -> int:
        """Tokens of text[begin:z] taken by itself."""
        i, head = start
        j = bisect_right(starts, z) - 1
        if j < i:
            return len(encode(self.path, text[begin:z]))
        return head + cum[j] - cum[i] + (0 if starts[j] == z else len(encode(self.path, text[starts[j] : z])))

    def _reach(self, text: str, starts: list[int], cum: list[int], begin: int, start: tuple[int, int], most: int) -> int:
        """The furthest end z with text[begin:z] within ``most`` tokens, at a part's end or inside a long part."""
        i, head = start
        k = max(i, bisect_right(cum, most - head + cum[i]) - 1) if head <= most else i - 1
        z = starts[k] if k >= i else begin
        after = starts[min(k + 1, len(starts) - 1)]
        if after - z > 48:  # a part without spaces
            x, y = z, after
            while x < y:
                mid = (x + y + 1) // 2
                if self._exact(text, starts, cum, begin, start, mid) <= most:
                    x = mid
                else:
                    y = mid - 1
            z = x
        return max(z, begin + 1)

    def _cut(self, text: str, starts: list[int], cum: list[int], marks: np.ndarray, begin: int, start: tuple[int, int], body: int) -> tuple[int, str, int]:
        high = self._reach(text, starts, cum, begin, start, self.limit)
        low = min(self._reach(text, starts, cum, body, self._head(text, starts, body), self.least), high)
        low = max(low, body + 1)
        k = int(np.searchsorted(marks, bisect_right(starts, low - 1)))
        mark = starts[int(marks[k])] if k < len(marks) and starts[int(marks[k])] <= high else None
        aim = high if mark is None else mark
        # text a little beyond the window lets a boundary see what follows it
        best = None
        zone = text[max(low - 8, 0) : high + 80]
        shift = max(low - 8, 0)
        for rank, (kind, pattern) in enumerate(BOUNDARIES):
            for m in pattern.finditer(zone):
                at = m.end() + shift
                if low <= at <= high and at > body:
                    key = (abs(at - aim), rank)
                    if best is None or key < best[0]:
                        best = (key, at, kind)
        options = [(best[1], best[2])] if best else []
        if mark is not None:
            options.append((mark, "landmark"))
        for at, kind in [*options, (high, "size")]:
            n = self._exact(text, starts, cum, begin, start, at)
            if n <= self.limit:
                return at, kind, n
        while n > self.limit and at > body + 1:
            at -= 1
            n = self._exact(text, starts, cum, begin, start, at)
        return at, "size", n

    def _back(self, text: str, starts: list[int], cum: list[int], cut: int, body: int) -> int:
        """Where the overlap begins: the latest part start that has ``overlap`` tokens up to the cut, or a character in a long part."""
        if not self.overlap:
            return cut
        j = bisect_right(starts, cut) - 1
        tail = 0 if starts[j] == cut else len(encode(self.path, text[starts[j] : cut]))
        k = j if tail >= self.overlap else bisect_right(cum, cum[j] + tail - self.overlap) - 1
        at = max(starts[max(k, 0)], body)
        start = self._head(text, starts, at)
        if self._exact(text, starts, cum, at, start, cut) > 2 * self.overlap:  # a long part: by characters
            x, y = at, cut
            while x < y:
                mid = (x + y + 1) // 2
                if self._exact(text, starts, cum, mid, self._head(text, starts, mid), cut) >= self.overlap:
                    x = mid
                else:
                    y = mid - 1
            at = x
        return at


PIECE = "piece_no int, start_char int, end_char int, shared_chars int, n_tokens int, boundary string, piece string"


def split_oversized(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, overlap: int = 64, least: int = 512, path: str | None = None, with_text: bool = True, only_split: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece_no (from 0), start_char, end_char, shared_chars, n_tokens, boundary, piece.

    A document within ``limit`` tokens is one piece.  Of a larger one each piece is ``text[start:end]``
    with at most ``limit`` tokens when taken by itself, and begins with the last ``overlap`` or a few
    more tokens (whole words) of the piece before, ``shared_chars`` characters.  Without the shared
    parts the pieces make up the text.  ``least``: tokens a piece has beyond its shared part before a
    landmark counts.  ``boundary``: what the piece ends at: ``heading``, ``paragraph``, ``turn``,
    ``line``, ``sentence``, ``landmark``, ``size``, or ``end`` of the text.

    Defined cases: null and empty texts have no pieces; repeated documents come out as often as they
    come; further columns are ignored; an empty table gives no rows.  ``only_split`` leaves out
    documents of one piece; a text of at most ``limit`` bytes then isn't even counted, as no token is
    shorter than a byte.
    """
    path = path or tokenizer_file()
    kind = documents.schema[doc_id].dataType.simpleString()
    flat = documents.select(F.col(doc_id), F.col(text).alias("_text")).where(F.col("_text").isNotNull() & (F.col("_text") != ""))
    if only_split:
        flat = flat.where(F.octet_length("_text") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker(path, limit, overlap, least)
        kinds = [pa.int32()] * 5 + [pa.string()] * 2
        for b in batches:
            rows, owner = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                cut = chunker.pieces(t)
                if only_split and len(cut) == 1:
                    continue
                for n, (a, z, shared, tokens, what) in enumerate(cut):
                    rows.append((n, a, z, shared, tokens, what, t[a:z] if with_text else None))
                    owner.append(i)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int32())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[doc_id, *[x.split()[0] for x in PIECE.split(", ")]])

    return flat.mapInArrow(run, f"`{doc_id}` {kind}, {PIECE}")
