"""Statistics of whole texts, by array kernels: what quality rules and classifiers read."""

from __future__ import annotations

import numpy as np

from lodestream.llm.common import _SPACE, Texts, mix, shingles

#: Fixed set of symbol characters.
SYMBOLS = "#*$%&|<>"


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL = _table(SYMBOLS)
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _table("0123456789")
_MARK = _table(".,;:")
_SHOUT = _table("!?")
_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])


def per_text(texts: Texts, member: np.ndarray) -> np.ndarray:
    """How many bytes of each text are members."""
    return np.diff(np.searchsorted(np.flatnonzero(member), texts.offsets))


def _own_key(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(h ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def repeated(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each item whether its owner has its hash twice or more."""
    key = _own_key(owner, h)
    k = np.sort(key)
    twice = k[1:][k[1:] == k[:-1]]
    if not len(twice):
        return np.zeros(len(h), dtype=bool)
    return twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key


def later_copies(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each item whether an earlier item of its owner has its hash."""
    out = np.ones(len(h), dtype=bool)
    if len(h):
        key = _own_key(owner, h)
        order = np.argsort(key)
        k = key[order]
        out[np.minimum.reduceat(order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])))] = False
    return out


def rule_counts(texts: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    nonspace = ~_SPACE[texts.data]
    owner = texts.word_owners()
    counts = np.bincount(owner, minlength=texts.n).astype(np.int64) if len(owner) else np.zeros(texts.n, np.int64)
    h = texts.word_hashes()
    lines_at, lines_to = texts.runs(texts.data != 10)
    with_word = np.concatenate([[0], np.cumsum(nonspace)])
    kept = with_word[lines_to] > with_word[lines_at]
    lines_at, lines_to = lines_at[kept], lines_to[kept]
    line_owner = texts.doc_of(lines_at)
    dup = later_copies(line_owner, texts.span_hashes(lines_at, lines_to))
    covered = np.zeros(len(h) + 1, dtype=np.int64)
    full, win_owner, _ = shingles(texts)
    n_long = max(0, len(h) - 4)
    inside = np.flatnonzero(owner[:n_long] == owner[4:]) if n_long else np.zeros(0, np.int64)
    twice = inside[repeated(win_owner[: len(inside)], full[: len(inside)])]
    np.add.at(covered, twice, 1)
    np.add.at(covered, np.minimum(twice + 5, len(h)), -1)
    in_repeat = np.cumsum(covered[:-1]) > 0
    return {
        "n_words": counts,
        "word_chars": per_text(texts, nonspace & _POINT[texts.data]),
        "n_symbols": per_text(texts, _SYMBOL[texts.data]),
        "n_dup_lines": np.bincount(line_owner[dup], minlength=texts.n).astype(np.int64),
        "n_repeat_words": np.bincount(owner[in_repeat], minlength=texts.n).astype(np.int64),
    }


FEATURES = ["words", "word_length", "symbols", "upper", "digits", "marks", "shouts", "lines", "distinct", "stutter", "repeats", "dup_lines"]


def features(texts: Texts, base: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """len(texts) x len(FEATURES) transformed statistics; an empty text has the statistics of no words. base: its rule_counts(), if at hand."""
    base = rule_counts(texts) if base is None else base
    owner = texts.word_owners()
    h = texts.word_hashes()
    words = np.maximum(base["n_words"], 1)
    points = np.maximum(per_text(texts, _POINT[texts.data]), 1)
    share = lambda x, of: np.log(x / of + 0.002)
    again = np.bincount(owner[later_copies(owner, h)], minlength=texts.n)
    same = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
    stutter = np.bincount(owner[same], minlength=texts.n) if len(same) else np.zeros(texts.n)
    count = lambda t: per_text(texts, t[texts.data])
    lines = per_text(texts, texts.data == 10)
    return np.column_stack([
        np.log1p(base["n_words"]), np.log(base["word_chars"] / words + 0.1),
        share(base["n_symbols"], points), share(count(_UPPER), points), share(count(_DIGIT), points),
        share(count(_MARK), words), share(count(_SHOUT), words), share(lines, words),
        (base["n_words"] - again) / words, share(stutter, words), share(base["n_repeat_words"], words), share(base["n_dup_lines"], lines + 1),
    ])
