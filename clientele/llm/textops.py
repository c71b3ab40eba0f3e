"""Vectorised text primitives for code that runs inside Spark tasks.

Words are found and hashed with numpy over the UTF-8 bytes of many texts at
once, so no Python loop runs per word.  All hashes are deterministic 64-bit
values that do not depend on the process, the batch or the platform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one numpy pass; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Byte classes.  Fixed values: white space is [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that belong to a word of letters and digits: ASCII alphanumerics and every non-ASCII byte.
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n."""
    steps = np.full(n, base)
    steps[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(steps, dtype=np.uint64)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (index of the first text, bytes, text bounds) over runs of texts
    of about CHUNK_BYTES.  Nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(bounds, bounds[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, raw[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first]
        first = last


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses a text bound."""
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    at = bounds[1:-1]
    at = at[(at > 0) & (at < len(inside))]
    begin[at] = inside[at]
    end[at - 1] = inside[at - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; equal bytes have equal hashes wherever they stand."""
    down = _powers(_BASE_INV, len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) white-space words of a chunk in order,
    and for each text the index of its first word (one more at the end)."""
    low = LOWER[data]
    starts, ends = runs(~SPACE[data], bounds)
    return span_hash(prefix_hash(low), starts, ends), np.searchsorted(starts, bounds)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (n - 1 fewer than words)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[:len(hashes) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix(out * _BASE + hashes[k:len(hashes) - n + 1 + k])
    return out


def units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits and of the runs of
    signs, whether each is of letters, and for each text the index of its first."""
    kind = np.where(LETTER[data], np.uint8(1), np.uint8(2))
    kind[SPACE[data]] = 0
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[bounds] = True
    edges = np.flatnonzero(edge)
    starts, ends = edges[:-1], edges[1:]
    used = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[used], ends[used]
    return starts, ends, kind[starts] == 1, np.searchsorted(starts, bounds)
