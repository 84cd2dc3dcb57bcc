"""Secret scans: base patterns plus multipart credential linking by an interval join, DataFrame only.

Plan
 1. Patterns pick the texts that can hold a base span, or both a key and an endpoint. For each kind of part, the matches
    and the text between them come from the same leftmost scan, so running sums of their lengths are code point offsets.
 2. Base spans (assign, access, hex) are reported as they are. Weak parts are only candidates: `key` is a token of
    mixed letters and digits that looks like a secret, `endpoint` is a URL.
 3. Weak parts join base and weak parts of the same row by an equi-join on (row, block of the scope's length)
    and the exact distance. A key is reported if an access identifier or an endpoint lies within the scope and it
    overlaps no base span; an endpoint if an access identifier or an assigned secret lies within the scope. A block
    holds a bounded number of parts, since parts of a kind do not overlap.

Results: each row is scanned by itself: rows with a repeated or null doc_id are as good as others. A null or empty
text has no spans. Offsets count code points, ends are exclusive. Ties in start are ordered by kind as listed, then by
end. A table without rows has no spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_table
from .common import free_name, row_keyed, split_by_ids

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "key", "endpoint")
BASE = KINDS[:3]


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
PATTERNS = {
    "assign": f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "key": "[A-Za-z0-9+/_-]{32,}",
    "endpoint": "[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.-]+[A-Za-z0-9](?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?",
}
#: A text without a match of this has no base span. Then only a key near an endpoint is reported in it.
_MAY = f"(?:{_NAMES})[\"']?\\x20*[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}"
_MAY_ENDPOINT, _MAY_KEY = "[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.-]", "[A-Za-z0-9+/_-]{32}"


def _literal(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _parts(kind: str) -> str:
    """SQL for the parts of one kind: kind, index, code points before it since the last one, its own, and if it counts."""
    if kind == "assign":
        good = "length(assign_value[i]) >= 6"
    elif kind == "access":
        good = "length(access[i]) >= 20"
    elif kind == "key":
        good = "key[i] rlike '[0-9]' and key[i] rlike '[A-Z]' and key[i] rlike '[a-z]'"
    else:
        good = "true"
    return f"case when size({kind}) > 0 then transform(sequence(0, size({kind}) - 1), i -> named_struct('kind', '{kind}', 'at', i, 'gap', length({kind}_rest[i]), 'size', length({kind}[i]), 'good', {good})) else array() end"


def secret_parts(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(row, kind, start, end) of all parts, strong and weak, where there may be a base span, or a key and an endpoint."""
    may = docs.select(F.col(key).alias("row"), F.col(text_col).cast("string").alias("text"))
    may = may.where(F.col("text").rlike(_MAY) | (F.col("text").rlike(_MAY_ENDPOINT) & F.col("text").rlike(_MAY_KEY)))
    cols = [c for k in KINDS for c in (f"regexp_extract_all(text, '{_literal(PATTERNS[k])}', 0) as {k}", f"split(text, '{_literal(PATTERNS[k])}', -1) as {k}_rest")]
    scanned = may.selectExpr("row", *cols, f"regexp_extract_all(text, '{_literal(PATTERNS['assign'])}', 2) as assign_value")
    rows = scanned.select("row", F.explode(F.concat(*(F.expr(_parts(k)) for k in KINDS))).alias("p")).select("row", "p.*")
    stop = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("at"))
    placed = rows.select("row", "kind", "size", "good", stop.cast("long").alias("end")).where("good")
    return placed.select("row", "kind", (F.col("end") - F.col("size")).cast("long").alias("start"), "end")


def link_parts(parts: DataFrame, scope: int = 200) -> DataFrame:
    """Base spans and those weak parts that a complementary part within scope code points makes credible."""
    blocks = lambda low, high: F.explode(F.sequence(F.expr(f"({low}) div {scope}"), F.expr(f"({high}) div {scope}")))
    weak = parts.where(~F.col("kind").isin(*BASE)).select("row", "kind", "start", "end").withColumn("block", blocks(f"greatest(0, start - {scope})", f"end + {scope}"))
    near = parts.select(F.col("row").alias("near_row"), F.col("kind").alias("near_kind"), F.col("start").alias("near_start"), F.col("end").alias("near_end")).withColumn("near_block", blocks("near_start", "near_end"))
    met = weak.join(near, (F.col("row") == F.col("near_row")) & (F.col("block") == F.col("near_block"))).where(f"near_start - end <= {scope} and start - near_end <= {scope}")
    overlap = F.col("near_kind").isin(*BASE) & (F.col("near_start") < F.col("end")) & (F.col("start") < F.col("near_end"))
    helps = F.when(F.col("kind") == "key", F.col("near_kind").isin("access", "endpoint")).otherwise(F.col("near_kind").isin("access", "assign"))
    judged = met.groupBy("row", "kind", "start", "end").agg(F.max(helps & ~overlap).alias("linked"), F.max(overlap & (F.col("kind") == "key")).alias("overlaps"))
    return parts.where(F.col("kind").isin(*BASE)).unionByName(judged.where("linked and not overlaps").drop("linked", "overlaps"))


def scan(docs: DataFrame, key: str, text_col: str = "text", scope: int = 200) -> DataFrame:
    """(row, spans) of rows with spans: an array of (start, rank, end, kind) in order. key has a value of its own in every
    row of docs, as row_keyed gives."""
    parts = shared_table(secret_parts(docs, key, text_col))
    rank = F.expr("array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), kind)").cast("int")
    span = F.struct("start", rank.alias("rank"), "end", "kind")
    return link_parts(parts, scope).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """(doc_id, spans) of every row; spans is an array, empty where there are none, of (start, rank, end, kind) in order."""
    keyed, key = row_keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
    return keyed.select(F.col(key).alias("row"), "doc_id").join(scan(keyed, key, "text", scope), "row", "left").select("doc_id", spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """docs with every span of the scan replaced by mask in its own row; all other columns as they are.

    Null and empty texts stay as they are. Overlapping spans become one mask.
    """
    keyed, key = row_keyed(docs, id_col)
    found = shared_table(scan(keyed, key, text_col, scope))
    may, clean = split_by_ids(keyed, found.select(F.col("row").alias(key)), key)
    spans = free_name(keyed.columns, "fathomgrid_spans")
    joined = may.join(found.select(F.col("row").alias(key), F.col("spans").alias(spans)), key, "left")
    # Walk the spans in order: what stands between the reach so far and the span stays, the span becomes the mask.
    text = f"cast(`{text_col}` as string)"
    walk = f"""aggregate({spans}, named_struct('reach', 0L, 'done', ''),
        (a, s) -> case when s.end <= a.reach then a
            when s.start < a.reach then named_struct('reach', s.end, 'done', a.done)
            else named_struct('reach', s.end, 'done', concat(a.done, substring({text}, cast(a.reach + 1 as int), cast(s.start - a.reach as int)), '{_literal(mask)}')) end,
        a -> concat(a.done, substring({text}, cast(a.reach + 1 as int))))"""
    masked = joined.withColumn(text_col, F.expr(f"case when {spans} is null or `{text_col}` is null then {text} else {walk} end"))
    return masked.select(*docs.columns).unionByName(clean.withColumn(text_col, F.expr(text)).select(*docs.columns))
