"""Token counts: greedy longest-match word pieces counted by an automaton in one pass over each word.

The vocabulary is a trie over bytes. A node that cannot go on has a failure link to the node of what is left after
the greedy pieces of its string are popped, and the number of those pieces, both computed once for all nodes. So a
word is counted in time linear in its length and no piece is ever built.

Words are runs of bytes other than space and tab to carriage return, each with one space put before it. Every byte
must be in the vocabulary, which is checked, so no word is unknown.

Results: one row per input row; a null or empty text has no words and no tokens.
"""

from __future__ import annotations

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, raw_texts

#: Words whose counts a worker keeps; a full cache is not extended.
_CACHE_WORDS = 400_000


class PieceCounter:
    def __init__(self, vocabulary):
        """vocabulary: byte strings; all 256 single bytes must be among them."""
        self.next: dict[int, int] = {}
        token = [False]
        for piece in vocabulary:
            node = 0
            for b in piece:
                at = node << 8 | b
                if at not in self.next:
                    self.next[at] = len(token)
                    token.append(False)
                node = self.next[at]
            token[node] = node > 0
        if any(b not in self.next or not token[self.next[b]] for b in range(256)):
            raise ValueError("the vocabulary must have every single byte")
        children: list[list[tuple[int, int]]] = [[] for _ in token]
        for at, node in self.next.items():
            children[at >> 8].append((at & 255, node))
        self.fail, self.pops = [-1] * len(token), [0] * len(token)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for b, node in children[parent]:
                if token[node]:
                    self.fail[node], self.pops[node] = 0, 1
                else:
                    pops, z = self.pops[parent], self.fail[parent]
                    while z >= 0 and z << 8 | b not in self.next:
                        pops += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[node], self.pops[node] = self.next[z << 8 | b], pops
                queue.append(node)
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """The number of greedy longest-match pieces of the byte string."""
        step, fail, pops, node, n = self.next, self.fail, self.pops, 0, 0
        for b in word:
            while (to := step.get(node << 8 | b)) is None:
                n += pops[node]
                node = fail[node]
            node = to
        while node:
            n += pops[node]
            node = fail[node]
        return n

    def count_text(self, raw: bytes) -> tuple[int, int]:
        """Words and pieces of a text."""
        words = raw.split()
        found = list(map(self.known.get, words))
        if None in found:
            for k, f in enumerate(found):
                if f is None:
                    found[k] = self.count(b" " + words[k])
                    if len(self.known) < _CACHE_WORDS:
                        self.known[words[k]] = found[k]
        return len(words), sum(found)


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file with a base64 string and a rank in each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(read_ranks(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) per row; vocabulary_path must be installed on every executor."""

    def run(batch: pa.RecordBatch) -> dict:
        c = counter(vocabulary_path)
        got = [c.count_text(raw) for raw in raw_texts(batch.column(1))]
        return {"doc_id": batch.column(0), "n_words": pa.array([g[0] for g in got], pa.int64()), "n_tokens": pa.array([g[1] for g in got], pa.int64())}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_words long, n_tokens long")
