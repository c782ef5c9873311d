"""Statistics of whole texts, computed for a slice of texts at a time."""

from __future__ import annotations

import numpy as np

from ledgerline.llm import textarrays

#: Words of a window that counts as repeated when it occurs twice in a text.
REPEAT_WINDOW = 8

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_upper", "n_stops", "n_bytes", "longest_word")

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[list(b"0123456789")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?")] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _distinct(text: np.ndarray, keys: np.ndarray, texts: int) -> np.ndarray:
    """Distinct keys of each text."""
    salted = textarrays.mix(keys + textarrays.mix(text.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(salted, return_index=True)
    return np.bincount(text[first], minlength=texts)


def statistics(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """One array of longs per name in NAMES."""
    texts = len(offsets) - 1
    starts, ends, bounds = textarrays.words(offsets, data)
    text = np.repeat(np.arange(texts), np.diff(bounds))
    hashes = textarrays.word_hashes(data, starts, ends)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    out = {"n_words": np.diff(bounds), "word_chars": _per_text(~blank & ((data & 0xC0) != 0x80), offsets), "n_bytes": np.diff(offsets)}
    for name, table in (("n_symbols", _SYMBOLS), ("n_digits", _DIGITS), ("n_upper", _UPPER), ("n_stops", _STOPS)):
        out[name] = _per_text(table[data], offsets)

    cut = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1])
    line_starts = cut[cut < len(data)]
    line_ends = np.append(line_starts[1:], len(data)) if len(line_starts) else line_starts
    line_text = np.searchsorted(offsets, line_starts, side="right") - 1
    newline = np.zeros(len(line_starts), np.int64)
    if len(line_starts):
        newline = (data[line_ends - 1] == 10).astype(np.int64)
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(~blank, dtype=np.int64)))
    spoken = sums[line_ends] > sums[line_starts]
    a, b, line_text = line_starts[spoken], (line_ends - newline)[spoken], line_text[spoken]
    out["n_lines"] = np.bincount(line_text, minlength=texts)
    keys = textarrays.spans_hashes(textarrays.byte_hashes(data), a, b)
    out["n_dup_lines"] = out["n_lines"] - _distinct(line_text, keys, texts)
    out["n_distinct"] = _distinct(text, hashes, texts)

    repeated = np.zeros(len(hashes) + 1, np.int64)
    ok = np.flatnonzero(textarrays.inside(bounds, REPEAT_WINDOW))
    if len(ok):
        windows = textarrays.mix(textarrays.rolled(hashes, REPEAT_WINDOW)[ok] + textarrays.mix(text[ok].astype(np.uint64) + np.uint64(1)))
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = ok[counts[inverse] > 1]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(repeated[:-1]) > 0, bounds)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, text, ends - starts)
    out["longest_word"] = longest
    return {k: out[k].astype(np.int64) for k in NAMES}
