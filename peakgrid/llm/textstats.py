"""Statistics of whole texts, counted on UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np

from . import common

#: Fixed values of the quality rules: the symbols that they count.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbol_share", "upper_share", "digit_share", "mark_share", "dup_line_share", "repeat_share",
    "distinct_share", "adjacent_share", "wide_share", "line_words", "pipe_share", "bang_share",
)
_SYMBOLS, _SPACES = np.frombuffer(SYMBOLS, np.uint8), np.frombuffer(SPACES, np.uint8)


def _windows(ids: np.ndarray, n_ids: int) -> np.ndarray:
    """For each 3-word window a code that equal windows share."""
    if n_ids < 2_000_000:
        return (ids[:-2] * n_ids + ids[1:-1]) * n_ids + ids[2:]
    pair = np.unique(ids[:-1] * n_ids + ids[1:], return_inverse=True)[1]
    return pair[:-1] * n_ids + ids[2:]


def measure(text: bytes) -> tuple[list[int], list[float]]:
    """BASE counts and FEATURES of one text. Words are runs of bytes other than ASCII white space."""
    hist = np.zeros(256, np.int64)
    seen: dict[bytes, int] = {}
    found = []
    for part in common.blocks(text):
        hist += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words = part.split()
        found.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
    ids = found[0] if len(found) == 1 else np.concatenate(found)
    n = len(ids)
    chars = int(hist.sum() - hist[128:192].sum())
    word_chars = chars - int(hist[_SPACES].sum())
    symbols = int(hist[_SYMBOLS].sum())
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)] if b"\n" in text else [text] if n else []
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3 and len(seen) < n:
        code = _windows(ids, len(seen))
        _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
        often = count[inverse] > 1
        if often.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + n - 2] |= often
            repeat = int(covered.sum())
    letters = int(hist[65:91].sum() + hist[97:123].sum())
    wide = int(hist[192:].sum())
    some, all_chars = max(n, 1), max(word_chars, 1)
    return [n, word_chars, symbols, dup, repeat], [
        np.log1p(n), min(word_chars / some, 50.0), symbols / all_chars, int(hist[65:91].sum()) / max(letters, 1), int(hist[48:58].sum()) / all_chars,
        int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()) / all_chars, dup / max(len(lines), 1), repeat / some,
        len(seen) / some, float((ids[1:] == ids[:-1]).sum()) / some, wide / all_chars, np.log1p(n / max(len(lines), 1)), int(hist[124]) / all_chars, int(hist[33]) / all_chars,
    ]


def measure_all(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [measure(t) for t in rows]
    return np.array([b for b, _ in both], np.int64).reshape(len(rows), len(BASE)), np.array([f for _, f in both], np.float64).reshape(len(rows), len(FEATURES))
