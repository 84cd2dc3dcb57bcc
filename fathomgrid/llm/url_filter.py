"""URL filters: fixed host and path rules, and association rules mined from labelled URLs by FP-growth.

Plan
 1. The longest fixed rule that fits a URL decides it. Fixed rules are a parameter and make one CASE expression.
 2. URLs decided by a fixed rule are the labelled transactions: the tokens of host and path plus an item for the
    verdict. Two exact reductions come before mining, from one count by token. A token seen with one verdict only is
    a rule of confidence 1, and no longer rule with it can be surer, so it is not mined further. Tokens that always
    occur together are one item. FP-growth then mines what is left; rules with a verdict as consequent are kept if
    confidence and support are high enough, and a rule is pruned where a shorter one that it contains is as sure.
 3. The rules go into an inverted index under their rarest item. The items of every undecided URL probe the index
    by an equi-join; a found rule fits if all of its items are there. The surest rule decides, and without any the
    default verdict holds.

Rules have at most max_tokens items, which is part of the rule language: longer ones say little that their parts do
not. With a support of at least min_support, there are at most C(tokens of a URL, max_tokens) / min_support of them
whatever the input. The index is broadcast where its count is within broadcast_rows and joined by shuffle beyond.

Results: one row per input row. A null URL or one without :// has an empty host and path, no rule and the default
verdict. Repeated rows give repeated result rows, null ids stay null. Ties: longer fixed host first; for mined rules
more confidence, then more support, then block before allow. A table without rows gives none.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as plain text functions of the URL."""
    host = F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fixed rule that fits, or null; rules are (host/path, verdict)."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"))):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host parts, their words, and path words; numbers are left out."""
    split = lambda c, by: F.split(c, by)
    parts = F.transform(split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(split(host, r"[^a-z]+"), lambda x: F.concat(F.lit("w:"), x))
    paths = F.transform(split(F.lower(path), r"[^a-z]+"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(parts, words, paths), lambda x: F.length(x) > 2))


def token_counts(urls: DataFrame, min_support: float, total: int) -> DataFrame:
    """(token, n, blocked, item) of the tokens in at least min_support of the total rows (tokens, verdict).

    item is the first in order of the tokens that occur in the same rows: two sums over hashes of the rows tell them.
    """
    mark = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.array_sort("tokens"), "verdict"), F.lit(1 << 40)).cast("decimal(20,0)")
    rows = urls.select("tokens", "verdict", mark(1).alias("m1"), mark(2).alias("m2"))
    by_token = rows.select(F.explode("tokens").alias("token"), "verdict", "m1", "m2").groupBy("token")
    found = by_token.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.sum("m1").alias("s1"), F.sum("m2").alias("s2"))
    same = Window.partitionBy("n", "blocked", "s1", "s2")
    return found.where(F.col("n") >= min_support * total).select("token", "n", "blocked", F.min("token").over(same).alias("item"))


def mine_rules(urls: DataFrame, min_support: float, min_confidence: float, max_tokens: int) -> tuple[DataFrame, dict[str, str]]:
    """Rules (rule_id, items, verdict, confidence, support, probe) from rows (tokens, verdict), where verdict is block or
    allow, and the item of every token that stands for others or is stood for."""
    spark = urls.sparkSession
    schema = "rule_id long, items array<string>, verdict string, confidence double, support double, probe string"
    # Tokens of min_support are at most (tokens of a URL) / min_support, whatever the input.
    total = urls.count()
    tokens = token_counts(urls, min_support, total).collect()
    if not tokens:
        return spark.createDataFrame([], schema), {}
    item = {r["token"]: r["item"] for r in tokens}
    freq = {r["token"]: r["n"] for r in tokens}
    pure = {r["item"]: r for r in tokens if r["blocked"] in (0, r["n"])}
    rules = [((t,), "block" if r["blocked"] else "allow", 1.0, r["n"] / total) for t, r in sorted(pure.items())]
    mixed = sorted({r["item"] for r in tokens} - set(pure))
    if mixed:
        items = urls.select(F.array_append(F.filter("tokens", lambda t: t.isin(mixed)), F.concat(F.lit("="), "verdict")).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
        found = model.associationRules.where(F.size("antecedent") <= max_tokens).where("consequent[0] like '=%' and not exists(antecedent, x -> x like '=%')")
        # At most as many as the docstring says.
        rules += [(tuple(sorted(r["antecedent"])), r["consequent"][0][1:], r["confidence"], r["support"]) for r in found.collect()]
    kept, sure = [], {}
    for t, verdict, confidence, support in sorted(rules, key=lambda r: (len(r[0]), r[0], r[1])):
        parts = [p for n in range(1, len(t)) for p in combinations(t, n)]
        if not any(sure.get((p, verdict), -1.0) >= confidence for p in parts):
            sure[t, verdict] = confidence
            kept.append((len(kept), list(t), verdict, float(confidence), float(support), min(t, key=lambda x: (freq[x], x))))
    return spark.createDataFrame(kept, schema), {t: i for t, i in item.items() if t != i}


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", min_support: float = 0.005, min_confidence: float = 0.8, max_tokens: int = 3, default: str = "allow", broadcast_rows: int = 100_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) per row; rules are (host/path, allow or block)."""
    host, path = url_parts(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    base = base.withColumn("rule", fixed_rule(F.col("host"), F.col("path"), rules))
    with_tokens = base.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    verdict = F.lit(None).cast("string")
    for rule, v in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
    decided = shared_table(with_tokens.where("rule is not null").select("tokens", verdict.alias("verdict")))
    index, item = mine_rules(decided, min_support, min_confidence, max_tokens)
    maybe = F.broadcast if index.count() <= broadcast_rows else (lambda x: x)

    # Undecided URLs probe the index once per distinct (host, path): copies of a URL get the same verdict.
    open_urls = F.col("rule").isNull() & (F.col("host") != "")
    asked = with_tokens.where(open_urls).select("host", "path", "tokens").dropDuplicates(["host", "path"])
    if item:
        # The items of tokens that stand for each other; like the tokens of min_support, these are few.
        stands = base.sparkSession.createDataFrame(sorted(item.items()), "token string, item string")
        spread = asked.select("host", "path", F.explode("tokens").alias("token")).join(F.broadcast(stands), "token", "left")
        asked = spread.groupBy("host", "path").agg(F.collect_set(F.coalesce("item", "token")).alias("tokens"))
    probes = asked.select("host", "path", F.col("tokens").alias("url_items"), F.explode("tokens").alias("probe"))
    fits = probes.join(maybe(index), "probe").where(F.size(F.array_except("items", "url_items")) == 0)
    order = F.struct("confidence", "support", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("strict"), "verdict")
    mined = shared_table(fits.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence")))
    # The mined verdicts grow with the distinct URLs, so they are never broadcast; all other rows skip this join.
    met = base.where(open_urls).join(mined.hint("merge"), ["host", "path"], "left")
    met = met.select("page_id", "host", "path", "rule", F.coalesce("mined", F.lit(default)).alias("verdict"), "confidence")
    rest = base.where(~open_urls).select("page_id", "host", "path", "rule", F.coalesce(verdict, F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    return met.unionByName(rest)
