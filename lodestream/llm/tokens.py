"""Token counts: greedy longest-match word pieces, counted by a linear automaton.

Each word of a text, with one space before it, is cut greedily into the longest pieces of a
byte vocabulary. The vocabulary is a trie whose nodes carry a failure link and how many
pieces are complete when it is taken, so a word is read once and no piece is ever built.

Defined results: null and empty texts have no words and no tokens; repeated rows are counted
one by one. All single bytes are pieces, so every word can be cut.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
from pyspark.sql import DataFrame

from lodestream.llm.common import Texts, with_kernel

#: Words whose counts a worker remembers; beyond it forgets them all and starts again.
REMEMBERED = 300_000
MOST_VOCABULARY_BYTES = 64 << 20


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def default_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Automaton:
    """rows[node] maps a byte to a child; link is where to go on when none fits, popped how many pieces are complete then."""

    def __init__(self, pieces: list[bytes]):
        leaf: dict[int, int] = {}
        rows, final = [{}], [False]
        for piece in {*pieces, *(bytes([b]) for b in range(256))} - {b""}:
            at = 0
            for b in piece:
                if rows[at] is leaf:
                    rows[at] = {}
                nxt = rows[at].get(b)
                if nxt is None:
                    nxt = rows[at][b] = len(rows)
                    rows.append(leaf)
                    final.append(False)
                at = nxt
            final[at] = True
        link, popped = [0] * len(rows), [0] * len(rows)
        level = [0]
        while level:
            below = []
            for u in level:
                for b, v in rows[u].items():
                    below.append(v)
                    if final[v]:
                        popped[v] = 1
                        continue
                    z, n = link[u], popped[u]
                    while (nxt := rows[z].get(b)) is None:
                        n += popped[z]
                        z = link[z]
                    link[v], popped[v] = nxt, n
            level = below
        self.rows, self.link, self.popped = rows, link, popped

    def count(self, word: bytes) -> int:
        rows, link, popped, at, n = self.rows, self.link, self.popped, 0, 0
        for b in word:
            while (nxt := rows[at].get(b)) is None:
                n += popped[at]
                at = link[at]
            at = nxt
        while at:
            n += popped[at]
            at = link[at]
        return n


class WordCounts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(b" " + word)
        if len(word) <= 64:
            self[word] = n
        return n


_ready: dict[str, WordCounts] = {}


def _counter(token: str, vocabulary) -> WordCounts:
    """This worker's counts for a broadcast vocabulary; one is kept at a time."""
    if token not in _ready:
        _ready.clear()
        _ready[token] = WordCounts(Automaton(vocabulary.value))
    return _ready[token]


def counting_kernel(spark, vocabulary: list[bytes]):
    """Kernel for with_kernel(): n_words and n_tokens. The vocabulary, a file of a few MB at most, is broadcast."""
    if sum(map(len, vocabulary)) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to be sent to every executor")
    shared, token = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def kernel(texts: Texts) -> dict:
        get = _counter(token, shared).__getitem__
        words, tokens, o = np.zeros(texts.n, np.int64), np.zeros(texts.n, np.int64), texts.offsets
        for k in range(texts.n):
            found = texts.data[o[k] : o[k + 1]].tobytes().split()
            words[k], tokens[k] = len(found), sum(map(get, found))
        return {"n_words": words, "n_tokens": tokens}

    return kernel


def count_tokens(documents: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens for each row."""
    vocabulary = read_vocabulary(vocabulary_path or default_vocabulary_path())
    kernel = counting_kernel(documents.sparkSession, vocabulary)
    return with_kernel(documents.select("doc_id", "text"), "text", kernel, "n_words long, n_tokens long", keep=["doc_id"])

