"""Texts as words that compare equal whatever their markup, case and encoding."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

#: fixed values: tags that stand inside a line and don't part words
INLINE = "a abbr b big cite code del em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr".split()

_INLINE_TAG = re.compile(rf"</?(?:{'|'.join(INLINE)})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<(?:!--.*?--|[/!?]?[A-Za-z][^<>]*)>", re.S)
#: lower case for letters, a blank for what is neither letter nor digit, bytes of other characters as they are
_TABLE = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_FORMAT = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ((0xAD, 0xAD), (0x600, 0x605), (0x61C, 0x61C), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0xE0001, 0xE007F))) + "]")


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits, without tags, character references, format characters, case and compatibility forms.

    Words are UTF-8.  Null and empty texts have none.
    """
    return plain(text).split()


def plain(text: str | None) -> bytes:
    """The text with blanks for all that is no word; see ``words``."""
    if not text:
        return b""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _FORMAT.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
        text = text.casefold()
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        for c in set(text):
            if c > "\x7f" and not c.isalnum():
                text = text.replace(c, " ")
    return text.encode("utf-8", "replace").translate(_TABLE)


_BASE = 0xC2B2AE3D27D4EB4F
_powers = np.ones((2, 1), dtype=np.uint64)


def _tables(n: int) -> np.ndarray:
    """Powers of the base and of its inverse, modulo 2**64; kept and made longer when needed."""
    global _powers
    if _powers.shape[1] < n:
        out = np.ones((2, max(n, 2 * _powers.shape[1])), dtype=np.uint64)
        out[:, 1:] = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], dtype=np.uint64)
        _powers = np.multiply.accumulate(out, axis=1)
    return _powers


def hashed(texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
    """The words of all texts as 64-bit numbers in one array, a zero after each text, and where each text begins.

    A word's number depends on its bytes alone.
    """
    if not texts:
        return np.zeros(0, dtype=np.uint64), []
    # a byte that UTF-8 doesn't have stands after each text, apart from the words
    h = _numbers([plain(t) for t in texts])
    return h, np.r_[0, np.flatnonzero(h == 0)[:-1] + 1].tolist()


def _numbers(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" \xff ".join([*parts, b""]), dtype=np.uint8)
    inside = np.concatenate([np.zeros(1, dtype=np.int8), (raw > 32).view(np.int8), np.zeros(1, dtype=np.int8)])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _tables(len(raw))[:, : len(raw)]
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(raw * up, out=total[1:])
    h = (total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)
    mix(h)
    h |= np.uint64(1)
    h[raw[begin] == 255] = 0
    return h


def mix(h: np.ndarray) -> np.ndarray:
    """Spread in place, so that every bit depends on every bit."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
