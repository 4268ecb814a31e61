"""The words of many texts at once: each distinct word of a batch comes to Python once, whatever its number of places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: About how many bytes of text are taken together; a text of over twice the size goes in parts.
TOGETHER = 8 << 20


def fold(blanks: bytes) -> np.ndarray:
    """A table for bytes: A-Z become a-z, the blanks a space."""
    table = np.arange(256, dtype="u1")
    table[65:91] += 32
    table[list(blanks)] = 32
    return table


def offsets(texts: pa.Array) -> np.ndarray:
    """Where the texts (binary) lie in their buffer."""
    return np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1]


def in_parts(texts: pa.Array, blanks: bytes, together: int = TOGETHER) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """(first row, one after the last, arrays): rows whose texts are taken together, or one long text in arrays of one part each, cut behind blanks."""
    at, lo = offsets(texts).astype("i8"), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + together, "right")) - 1)
        parts = [texts.slice(lo, hi - lo)]
        if hi == lo + 1 and at[hi] - at[lo] > 2 * together:
            raw = np.frombuffer(texts.buffers()[2], "u1")[at[lo] : at[hi]]
            cuts = np.nonzero(np.isin(raw, np.frombuffer(blanks, "u1")))[0] + 1
            ends, a = [], 0
            while a < len(raw):
                k = int(np.searchsorted(cuts, a + together, "right"))
                k -= k > 0 and cuts[k - 1] > a
                a = int(cuts[k]) if k < len(cuts) and len(raw) - a > together else len(raw)
                ends.append(a)
            parts = [pa.array([raw[a:b].tobytes()], pa.binary()) for a, b in zip([0, *ends], ends)]
        yield lo, hi, parts
        lo = hi


def distinct(texts: pa.Array, table: np.ndarray, whole: bytes | None = None) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(code of each word, the distinct words, number of words up to each text's end). texts: binary, without nulls; table: `fold`.

    Words are what lies between spaces of the folded bytes; the empty word may be among them. A text that holds `whole` (two bytes) stays
    one unfolded word.
    """
    at = offsets(texts)
    raw = np.frombuffer(texts.buffers()[2] or b"", "u1")[at[0] : at[-1]]
    at = at - at[0]
    low = table[raw]
    start = np.ones(len(raw) + 1, bool)
    if len(raw):
        space = low == 32
        np.greater(space[:-1], space[1:], out=start[1:-1])
    if whole:
        held = np.nonzero((raw[:-1] == whole[0]) & (raw[1:] == whole[1]))[0]
        for k in np.unique(np.searchsorted(at, held, "right") - 1).tolist():
            a, b = at[k], at[k + 1]
            low[a:b], start[a + 1 : b] = raw[a:b], False
    start[at] = True
    cut = np.nonzero(start)[0].astype("i4")
    coded = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(low)]).dictionary_encode()
    lies = offsets(coded.dictionary).tolist()
    held = coded.dictionary.buffers()[2].to_pybytes() if len(coded.dictionary) else b""
    names = [held[a:b].rstrip(b" ") for a, b in zip(lies, lies[1:])]
    return coded.indices.to_numpy(), names, np.searchsorted(cut, at[1:])
