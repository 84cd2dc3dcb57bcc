"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exceptions.

Folding lower-cases, maps homoglyphs and digit substitutions to plain letters and drops invisible characters. The
lexicon is learned from labelled rows: whole words and word beginnings that mark toxic texts, each weighted by its
log-odds, each as long as it can be without losing the texts it marks. A phrase of two words around an entry that
is seen in clean texts only is an exception: the entry does not count inside it. The sum of the matched weights,
as it is and by length, goes through a logistic curve fitted on the same rows.

Results: one row per input row; a null or empty text matches nothing and gets the score of no match. Without
labelled rows of both classes the lexicon is empty and every score is the share of class 1 (0.5 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_classifier import held_out, labelled_sample, score_texts

#: Look-alike characters and the letters that they stand for.
LOOK_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "ı": "i", "ⅼ": "l", "ɑ": "a", "ɡ": "g"}
SUBSTITUTED = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
_FOLD = str.maketrans(LOOK_ALIKE | SUBSTITUTED | dict.fromkeys(INVISIBLE) | {chr(0xFF41 + k): chr(97 + k) for k in range(26)})
_FOLD_ASCII = str.maketrans(SUBSTITUTED)
_WORD = re.compile(r"[^\W_]+")
SHORTEST, LONGEST = 3, 9


def fold(text: str) -> str:
    return text.lower().translate(_FOLD_ASCII if text.isascii() else _FOLD)


@dataclass
class Lexicon:
    """entries: '^beginning' or '^word$' to weight; exceptions: phrases within which entries do not count."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def automaton(self):
        if "_automaton" not in self.__dict__:
            import ahocorasick

            a = ahocorasick.Automaton()
            by_text: dict[str, list] = {}
            for e, w in self.entries.items():
                by_text.setdefault(e.strip("^$"), []).append((e.endswith("$"), w))
            for p in self.exceptions:
                by_text.setdefault(p, []).append((True, None))
            for text, kinds in by_text.items():
                a.add_word(text, (len(text), kinds))
            if by_text:
                a.make_automaton()
            self._automaton = a if by_text else None
        return self._automaton

    def matched(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of entries at word starts that are not inside an exception phrase."""
        if self.automaton() is None:
            return []
        found, free = [], []
        for last, (n, kinds) in self._automaton.iter(folded):
            start = last - n + 1
            if start and folded[start - 1].isalnum():
                continue
            ends = last + 1 == len(folded) or not folded[last + 1].isalnum()
            for whole, weight in kinds:
                if ends or not whole:
                    (found if weight is not None else free).append((start, last + 1, weight))
        return [f for f in found if not any(s <= f[0] and f[1] <= e for s, e, _ in free)]

    def features(self, raw: list[bytes]) -> np.ndarray:
        out = np.empty((len(raw), 2))
        for k, t in enumerate(raw):
            text = fold(t.decode("utf-8", "replace"))
            s = sum(w for _, _, w in self.matched(text))
            out[k] = s, 1000 * s / max(20, text.count(" ") + 1) if s else 0
        return np.log1p(out)

    def score(self, raw: list[bytes]) -> np.ndarray:
        a, b, c = self.curve
        x = self.features(raw)
        return 1 / (1 + np.exp(-np.clip(a * x[:, 0] + b * x[:, 1] + c, -30, 30)))


def learn_entries(texts: list[str], labels: np.ndarray, least_odds: float = 3.0) -> dict[str, float]:
    """Entries by document frequency in either class; texts are folded."""
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, labels):
        words = set(_WORD.findall(text))
        begin = {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
        count[int(y)].update(["^" + b for b in begin] + [f"^{w}$" for w in words])
    n1, n0 = int(sum(labels)), len(labels) - int(sum(labels))
    least = max(3, 0.008 * n1)
    odds = {e: float(np.log((c + 0.5) / (n1 + 1)) - np.log((count[0][e] + 0.5) / (n0 + 1))) for e, c in count[1].items() if c >= least}
    odds = {e: w for e, w in odds.items() if w >= least_odds and count[0][e] <= 0.02 * n0}
    chosen = {}
    for e in sorted(odds, key=len):
        if e.endswith("$"):
            continue
        if any(e[:k] in chosen for k in range(len(e))):
            continue
        # The longest way to say it that keeps nearly all of the texts it marks.
        best = e
        while True:
            longer = [x for x in odds if x.startswith(best) and len(x) == len(best) + 1 and count[1][x] >= 0.9 * count[1][e]]
            if not longer:
                break
            best = max(longer, key=lambda x: (x.endswith("$"), count[1][x]))
            if best.endswith("$"):
                break
        chosen[e] = best
    out = {b: odds[b] for b in chosen.values()}
    out |= {e: w for e, w in odds.items() if e.endswith("$") and not any(e.startswith(b) for b in out)}
    # Words that only copies of one text share stand after the same word each time; entries stand after many.
    before: dict[str, set] = {e: set() for e in out}
    lexicon = Lexicon(out)
    for text, y in zip(texts, labels):
        if y:
            for start, end, _ in lexicon.matched(text):
                word = _WORD.match(text, start)[0]
                seen = text[max(0, start - 24) : start].split()[-1:]
                for e in (*("^" + word[:k] for k in range(SHORTEST, len(word) + 1)), f"^{word}$"):
                    if e in before:
                        before[e].update(seen)
    return {e: w for e, w in out.items() if len(before[e]) >= max(2, 0.4 * count[1][e])}


def learn_exceptions(lexicon: Lexicon, texts: list[str], labels: np.ndarray, least: int = 3) -> list[str]:
    """Two-word phrases with an entry that occur in clean texts only, in at least so many of them."""
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, labels):
        phrases = set()
        for start, end, _ in lexicon.matched(text):
            if m := re.match(r"[^\W_]*\W[^\W_]+", text[start : start + 80]):
                phrases.add(m[0])
            if m := re.search(r"[^\W_]+\W[^\W_]+$", text[max(0, start - 40) : end]):
                phrases.add(m[0])
        count[int(y)].update(phrases)
    return sorted(p for p, c in count[0].items() if c >= least and not count[1][p])


def fit(raw: list[bytes], labels: np.ndarray, exceptions: list[str] = ()) -> Lexicon:
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        share = min(0.999, max(0.001, float(labels.mean()))) if len(labels) else 0.5
        return Lexicon({}, [], (0.0, 0.0, float(np.log(share / (1 - share)))))
    texts = [fold(t.decode("utf-8", "replace")) for t in raw]
    lexicon = Lexicon(learn_entries(texts, labels), sorted(fold(p) for p in exceptions))
    found = learn_exceptions(lexicon, texts, labels)
    lexicon = Lexicon(lexicon.entries, sorted({*lexicon.exceptions, *found}))
    x = np.column_stack([lexicon.features(raw), np.ones(len(raw))])
    w, ridge = np.zeros(3), np.diag([0.02, 0.02, 0.002]) * len(raw) / 10
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ w)
        w += np.clip(step, -2, 2)
    return Lexicon(lexicon.entries, lexicon.exceptions, tuple(map(float, w)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, modulus: int = 3, remainder: int = 1, max_rows: int = 1500, exceptions: list[str] = ()) -> DataFrame:
    """Learns the lexicon from at most max_rows labelled rows of either class outside the held-out fold; scores all."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw, y = labelled_sample(docs, labels, label, ~held_out(F.col("doc_id"), modulus, remainder), max_rows)
    scored = score_texts(docs, fit(raw, y, exceptions), threshold)
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", "predicted")
