"""Token sizes under a public tokenizer.

The tokenizer's file is a parameter.  Its default is the one file named here, looked up beside the
installed package of public tokenizers.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "byte_bpe_50k.tiktoken"

#: between lines, and before longer white space
_LINE = re.compile(r"(?<=\S\n)(?=\S)|(?<=\S)(?=\s\s)")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_file(name: str = DEFAULT) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The byte-level BPE of a file of ranks, once per process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def encode(path: str, text: str) -> list[int]:
    try:
        return encoding(path).encode_ordinary(text)
    except UnicodeEncodeError:  # a lone surrogate
        return encoding(path).encode_ordinary(text.encode("utf-8", "replace").decode())


class Counter:
    """Exact token counts, mostly from memory.

    The pattern that parts a text before pairs are merged never joins across a single space between
    two other characters, but takes that space to what follows.  So a text can be counted part by
    part, and most parts have been seen before.
    """

    def __init__(self, path: str, most: int = 400_000):
        self.path, self.most, self.later, self.whole = path, most, {}, {}

    def parts(self, text: str) -> tuple[list[str], list[int]]:
        """The text cut at single spaces, and the tokens of each part with its space before it."""
        pieces = _LONE_SPACE.split(text) if "  " in text else text.split(" ")
        seen = self.later
        counts = list(map(seen.get, pieces))
        counts[0] = len(encode(self.path, pieces[0])) if pieces[0] else 0
        if None in counts:
            if len(seen) > self.most:
                seen.clear()
            for i, n in enumerate(counts):
                if n is None:
                    p = pieces[i]
                    n = seen.get(p)
                    if n is None:
                        n = len(encode(self.path, " " + p))
                        if len(p) < 64:
                            seen[p] = n
                    counts[i] = n
        return pieces, counts

    def fine_parts(self, pieces: list[str], counts: list[int]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``parts`` with long ones cut further: parts, their tokens, and their places (with the space before them).

        The cuts lie where the pattern parts the text and a cut changes nothing on either side, which
        leaves out the inside of longer white space.
        """
        long = [i for i, p in enumerate(pieces) if len(p) > 48]
        if not long:
            lens = np.array(list(map(len, pieces)), dtype=np.int64) + 1
            lens[0] -= 1
            return pieces, np.array(counts, dtype=np.int64), np.cumsum(lens) - lens
        out: list[str] = []
        n: list[int] = []
        lens_out: list[int] = []
        last = 0
        for i in [*long, len(pieces)]:
            out += pieces[last:i]
            n += counts[last:i]
            lens_out += [x + 1 for x in map(len, pieces[last:i])] if last else [len(p) + (k > 0) for k, p in enumerate(pieces[:i])]
            if i == len(pieces):
                break
            p = " " * (i > 0) + pieces[i]
            for line in _LINE.split(p):
                if len(line) <= 64:
                    out.append(line)
                    n.append(len(encode(self.path, line)))
                    lens_out.append(len(line))
                    continue
                begin = 0
                for m in _pattern().finditer(line):
                    z = m.end()
                    if z == len(line) or not line[z - 1].isspace():
                        q = line[begin:z]
                        k = self.whole.get(q)
                        if k is None:
                            k = len(encode(self.path, q))
                            if len(q) < 64 and len(self.whole) < self.most:
                                self.whole[q] = k
                        out.append(q)
                        n.append(k)
                        lens_out.append(z - begin)
                        begin = z
            last = i + 1
        lens = np.array(lens_out, dtype=np.int64)
        return out, np.array(n, dtype=np.int64), np.cumsum(lens) - lens

    def count(self, text: str | None) -> int:
        return sum(self.parts(text)[1]) if text else 0


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def with_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``keep`` columns and the number of tokens of ``text`` (null or empty: 0)."""
    path = path or tokenizer_file()
    flat = df.select(*keep, F.col(text).alias("_text"))
    kept = len(keep)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields], f"`{name}` int"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [counter(path).count(t) for t in b.column(kept).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(n, pa.int32())], names=[*keep, name])

    return flat.mapInArrow(count, schema)
