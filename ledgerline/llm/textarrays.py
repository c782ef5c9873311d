"""Vectorised helpers over Arrow batches of texts: words, window hashes and winnowed anchors.

All hashes are 64-bit and wrap; they depend on content only, so that every task and every
rerun gives the same values. Batches are walked in slices of bounded bytes, so that memory
follows the slice (or the one longest text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time.
SLICE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_AT = _RNG.integers(0, 2**64, size=(256, 256), dtype=np.uint64)
_BYTE = _RNG.integers(0, 2**64, size=256, dtype=np.uint64)
_ROLL = 0x9E3779B97F4A7C15
_PREFIX = 0xD6E8FEB86659FD93
_PREFIX_INVERSE = pow(_PREFIX, -1, 2**64)
_POSITION_BITS = 28


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about `limit` bytes (one row at least)."""
    if not batch.num_rows:
        return
    offsets, _ = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and each text's first word index."""
    letter = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    full = offsets[:-1] < offsets[1:]
    at = offsets[:-1][full]
    first[at] = letter[at]
    at = offsets[1:][full] - 1
    last[at] = letter[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One content hash per word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
    values = _BYTE_AT[place & 255, data[place + np.repeat(starts, lengths)]]
    if lengths.max() > 256:
        values = values * (2 * (place >> 8) + 1).astype(np.uint64)
    return mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64))


def byte_hashes(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive symbols (n at least 1); shorter inputs give none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    done, length, power, width = None, 0, h, 1
    while True:
        if n & width:
            if done is None:
                done, length = power, width
            else:
                m = len(h) - length - width + 1
                done = done[:m] * np.uint64(pow(_ROLL, width, 2**64)) + power[length : length + m]
                length += width
        if width * 2 > n:
            return mix(done[: len(h) - n + 1])
        m = len(h) - 2 * width + 1
        power = power[:m] * np.uint64(pow(_ROLL, width, 2**64)) + power[width : width + m]
        width *= 2


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = w - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_PREFIX, _PREFIX_INVERSE)):
            grown = np.full(n, base, np.uint64)
            grown[0] = 1
            _powers[i] = np.cumprod(grown)
    return _powers


def spans_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the symbols of each span [start, end), wherever it lies."""
    powers, inverse = _powers_to(len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)])))
    return (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)


_PRIME = np.uint64((1 << 31) - 1)
_PRIME_BASE = 1_203_559_121
_prime_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _prime_powers_to(n: int) -> list[np.ndarray]:
    if len(_prime_powers[0]) < n:
        for i, base in enumerate((_PRIME_BASE, pow(_PRIME_BASE, -1, int(_PRIME)))):
            grown, done = np.ones(n, np.uint64), 1
            while done < n:
                m = min(done, n - done)
                grown[done : done + m] = grown[:m] * np.uint64(pow(base, done, int(_PRIME))) % _PRIME
                done += m
            _prime_powers[i] = grown
    return _prime_powers


def prime_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the symbols of each span by a polynomial modulo a prime: of another kind than spans_hashes."""
    powers, inverse = _prime_powers_to(len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((h >> np.uint64(34)) * powers[: len(h)] % _PRIME)))
    return (sums[ends] - sums[starts]) % _PRIME * inverse[starts] % _PRIME


def span_names(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Both hashes of each span in one value."""
    return mix(spans_hashes(h, starts, ends) ^ mix(prime_hashes(h, starts, ends)))


def inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """Which of the windows of n symbols lie in one text. bounds: each text's first symbol, and the end."""
    total = int(bounds[-1])
    if total < n:
        return np.zeros(0, bool)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return text[: total - n + 1] == text[n - 1 :]


def anchors(h: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> dict[str, np.ndarray]:
    """Winnowed anchors: the least gram of every window of `window` symbols inside one text.

    One row per run of windows with the same anchor: text (index), first and last (window
    starts, from the text's start), seed (the gram's hash) and around (hash of all symbols
    these windows cover, and of the anchor's place among them). Equal windows have equal
    seeds; equal `around` under one seed means the same windows one by one.
    """
    ok = inside(bounds, window)
    starts = np.flatnonzero(ok)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return {"text": empty, "first": empty, "last": empty, "seed": empty, "around": empty}
    grams = rolled(h, gram)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    order = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_min(order, window - gram + 1) & low).astype(np.int64)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    first, last = starts[head], starts[np.append(head[1:], len(starts)) - 1]
    at = at[head]
    around = span_names(h, first, last + window)
    around = mix(around + mix((at - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)))
    text = np.searchsorted(bounds, first, side="right") - 1
    return {"text": text, "first": first - bounds[text], "last": last - bounds[text], "seed": grams[at].view(np.int64), "around": around.view(np.int64)}


def cover_samples(h: np.ndarray, bounds: np.ndarray, cover: np.ndarray, window: int, wanted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The suffixes that start at places of a difference cover, with the windows each one speaks for.

    cover: mask of one period of places, counted from each text's start. Two equal windows
    hold, at one common distance from their starts and under a period, a sampled place each.
    One row per sampled place: text (index), first and last (the windows that start under a
    period before it), seed (name of the three blocks that any of these windows still holds
    from the place on) and around (name of everything these windows cover, and of the place
    in it). Equal `around` under one seed means the same windows one by one.
    wanted: mask of window starts; places that speak for none of them are left out.
    """
    period = len(cover)
    depth = window - period + 1
    lengths = np.diff(bounds)
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(int(lengths.sum())) - np.repeat(bounds[:-1], lengths)
    at = np.flatnonzero(cover[place % period] & (place <= np.repeat(lengths, lengths) - depth) & np.repeat(lengths >= window, lengths))
    text, place = text[at], place[at]
    first = np.maximum(place - period + 1, 0)
    last = np.minimum(place, lengths[text] - window)
    if wanted is not None:
        count = np.concatenate(([0], np.cumsum(wanted)))
        use = count[bounds[text] + last + 1] > count[bounds[text] + first]
        at, text, place, first, last = (x[use] for x in (at, text, place, first, last))
    thirds = [depth * k // 3 for k in range(4)]
    blocks = [spans_hashes(h, at + a, at + b) for a, b in zip(thirds[:-1], thirds[1:], strict=True)]
    seed = np.zeros(len(at), np.uint64)
    for block in blocks:
        seed = mix(seed * np.uint64(_ROLL) + mix(block))
    around = span_names(h, bounds[text] + first, bounds[text] + last + window)
    around = mix(around + mix((place - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)))
    return {"text": text, "first": first, "last": last, "seed": seed.view(np.int64), "around": around.view(np.int64)}


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the places in [0, length) that lie in any of the intervals [start, end)."""
    edges = np.zeros(length + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1]) > 0
