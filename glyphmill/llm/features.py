"""Surface features of texts, computed over whole Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import Words, string_parts

#: Features of a text, in order.
NAMES = (
    "log_bytes", "upper", "digit", "space", "line", "bar", "mark", "stop", "symbol", "high", "log_words", "word_bytes",
    "distinct_words", "same_next", "top_line", "sign_after", "sign_apart", "shout_words", "line_bytes", "twice_words",
)
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b"|", b"!?", b".,;:", b"#$%&*+-/<=>@\\^_`{}~[]()\"'"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 9
_BLANK, _BAR, _MARK, _STOP, _SIGN = 3, 5, 6, 7, 8


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[off[1:]] - sums[off[:-1]]).astype(np.float64)


def features(column: pa.Array) -> np.ndarray:
    """A row of floats for each text; null and empty texts have zeros."""
    data, off = string_parts(column)
    w = Words(column)
    n_docs, cls = w.n_docs, _CLASS[data]
    n_bytes = np.diff(off).astype(np.float64)
    size = np.maximum(n_bytes, 1)
    share = [_per_doc(cls == k, off) / size for k in range(1, 10)]
    count = lambda doc, weights=None: np.bincount(doc, weights, minlength=n_docs).astype(np.float64)
    n_words = count(w.doc)
    per_word = np.maximum(n_words, 1)
    h = w.hashes(w.start, w.end)
    order = np.lexsort((h, w.doc))
    same = (w.doc[order][1:] == w.doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    distinct = n_words - count(w.doc[order][1:][same])
    # words that follow the same word, and pairs of words that came before in the text
    again = (w.doc[1:] == w.doc[:-1]) & (h[1:] == h[:-1])
    near = w.doc[1:] == w.doc[:-1]
    with np.errstate(over="ignore"):
        pair = (h[1:] * np.uint64(3) + h[:-1])[near]
    pd = w.doc[1:][near]
    po = np.lexsort((pair, pd))
    twice = (pd[po][1:] == pd[po][:-1]) & (pair[po][1:] == pair[po][:-1])
    # signs right behind a word (or behind its full stop or comma), and signs that stand apart after it
    pad = np.concatenate([cls, np.zeros(2, np.uint8)])
    after, after2 = pad[w.end], pad[np.minimum(w.end + 1, len(pad) - 1)]
    sign = lambda c: (c == _SIGN) | (c == _BAR)
    odd = sign(after) | ((after == _STOP) & (sign(after2) | (after2 == _MARK)))
    apart = (after == _BLANK) & sign(after2)
    up = np.concatenate([[0], np.cumsum(cls == 1)])
    low = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    shout = (up[w.end] - up[w.start] >= 1) & (low[w.end] == low[w.start]) & (w.end - w.start >= 2)
    # lines: the share of a text's lines that stand more than once
    line_end = np.unique(np.concatenate([np.flatnonzero(cls == 4), off[1:][n_bytes > 0] - 1])) + 1
    line_doc = np.searchsorted(off, line_end - 1, "right") - 1
    line_start = np.concatenate([[0], line_end[:-1]])[: len(line_end)]
    lh = w.hashes(line_start, line_end) if len(line_end) else np.zeros(0, np.uint64)
    lo = np.lexsort((lh, line_doc))
    repeated = (line_doc[lo][1:] == line_doc[lo][:-1]) & (lh[lo][1:] == lh[lo][:-1])
    n_lines = count(line_doc)
    return np.column_stack([
        np.log1p(n_bytes), *share, np.log1p(n_words), count(w.doc, (w.end - w.start).astype(float)) / per_word, distinct / per_word,
        count(w.doc[1:][again]) / per_word, count(line_doc[lo][1:][repeated]) / np.maximum(n_lines, 1), count(w.doc, odd.astype(float)) / per_word,
        count(w.doc, apart.astype(float)) / per_word, count(w.doc, shout.astype(float)) / per_word, np.log1p(n_bytes / np.maximum(n_lines, 1)),
        count(pd[po][1:][twice]) / per_word,
    ])
