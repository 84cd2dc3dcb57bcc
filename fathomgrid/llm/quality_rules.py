"""Quality rules: a short-circuit cascade ordered by rejection per cost, as measured on a sample.

Every rule is a test of one statistic of the text. On a bounded sample each rule's marginal time per byte and the share
of rows that it rejects are measured, given the rules before it and the statistics that are wanted anyhow; rules run in
the order of rejection per cost, and a row leaves the cascade at the first rule that rejects it. What only later rules
need is never computed for it. The order changes the time, never which rows are kept.

Results: one row per input row, each by its own text, also for repeated and null ids. A null or empty text has zeros
everywhere and is rejected for being short. The order never decides ties: kept and base_failed do not depend on it,
only failed_rule names the first rule in it that rejects. A table without rows gives none.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import hash_spans, word_spans
from .common import map_rows, raw_texts

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


class TextStats:
    """Statistics of one UTF-8 text, each computed when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self._known: dict = {}

    def __getattr__(self, name: str):
        known = self.__dict__["_known"]
        if name not in known:
            known[name] = getattr(TextStats, "_" + name)(self)
        return known[name]

    def known(self) -> set[str]:
        return set(self._known)

    def _n_words(self) -> int:
        return len(self.raw.split())

    def _word_chars(self) -> int:
        return len(self.raw.translate(None, _SPACES + _CONTINUATION))

    def _n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    def _lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(_SPACES)]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        buf = np.frombuffer(self.raw, np.uint8)
        start, end = word_spans(buf)
        if len(start) < 4:
            return 0
        h = hash_spans(buf, start, end)
        with np.errstate(over="ignore"):
            three = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        order = np.argsort(three, kind="stable")
        same = three[order][1:] == three[order][:-1]
        twice = np.zeros(len(three), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(len(h), bool)
        for k in range(3):
            hit[k : k + len(three)] |= twice
        return int(hit.sum())

    def _n_marks(self) -> int:
        return self.raw.count(b"!") + self.raw.count(b"?")

    def _n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _UPPER))

    def _n_lower(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _LOWER))


@dataclass(frozen=True)
class Rule:
    """rejects(stats) is true for a text that the rule turns down."""

    name: str
    rejects: Callable[[TextStats], bool]


#: The base rules, which are always part of the verdict.
BASE_RULES = (Rule("few_words", lambda t: t.n_words < 50), Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words))
#: The method's further rules. All limits are per word or line, so none depends on the corpus.
MORE_RULES = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 30 * t.n_words),
    Rule("marks", lambda t: 100 * t.n_marks > 50 * t.n_words),
    Rule("shouting", lambda t: t.n_upper > 200 and t.n_upper > 2 * t.n_lower),
    Rule("duplicate_lines", lambda t: len(t.lines) >= 4 and 100 * t.n_dup_lines > 70 * len(t.lines)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
)


def plan_cascade(sample: list[bytes], rules: tuple[Rule, ...], known: tuple[str, ...] = ()) -> list[dict]:
    """The rules in order, each with its marginal cost (ns a byte) and the share of the rows reaching it that it rejects.

    One after the other the rule with the most rejection per cost is taken, measured on the sample's rows that no rule
    before rejects. Statistics in known, and those that earlier rules have computed, cost nothing any more.
    """
    out, rows, done, left = [], list(sample), set(known), list(rules)

    def measure(r: Rule) -> dict:
        stats = [TextStats(t) for t in rows]
        for t in stats:
            for name in done:
                getattr(t, name)
        began = time.perf_counter_ns()
        rejected = [bool(r.rejects(t)) for t in stats]
        cost = max(1, time.perf_counter_ns() - began) / max(1, sum(map(len, rows)))
        return {"rule": r, "cost": cost, "rejects": sum(rejected) / max(1, len(rows)), "stays": [t for t, x in zip(rows, rejected) if not x], "uses": set().union(*(t.known() for t in stats))}

    while left:
        best = min(map(measure, left), key=lambda x: (-(x["rejects"] + 1e-6) / x["cost"], x["rule"].name))
        left.remove(best["rule"])
        rows, done = best.pop("stays"), done | best.pop("uses")
        out.append(best)
    return out


def first_rejection(stats: TextStats, order: list[Rule]) -> str | None:
    return next((r.name for r in order if r.rejects(stats)), None)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, sample_rows: int = 400, with_counts: bool = True) -> DataFrame:
    """(doc_id, kept, failed_rule) per row; with_counts adds the base statistics, which then are computed for all rows.

    The order is planned on at most sample_rows rows: those with the lowest hash of the id.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).distinct()
    got = docs.join(F.broadcast(picked), "doc_id").select("text").limit(2 * sample_rows).toArrow()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") if with_counts else ()
    order = [x["rule"] for x in plan_cascade(raw_texts(got.column(0).combine_chunks()) if got.num_rows else [], rules, counts)]
    base = {r.name for r in BASE_RULES}

    def run(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in (*counts, "kept", "failed_rule", "base_failed")}
        for raw in raw_texts(batch.column(1)):
            t = TextStats(raw)
            for c in counts:
                out[c].append(getattr(t, c))
            failed = first_rejection(t, order)
            out["failed_rule"].append(failed)
            out["kept"].append(failed is None)
            out["base_failed"].append(failed in base or any(r.rejects(t) for r in BASE_RULES))
        types = {"kept": pa.bool_(), "failed_rule": pa.string(), "base_failed": pa.bool_()}
        return {"doc_id": batch.column(0)} | {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}

    return map_rows(docs, run, "doc_id long, " + "".join(f"{c} long, " for c in counts) + "kept boolean, failed_rule string, base_failed boolean")
