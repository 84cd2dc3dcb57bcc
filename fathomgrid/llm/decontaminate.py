"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows, DataFrame only.

Plan
 1. A window is a run of `window` consecutive words of an item (a shorter item is one window). Its shingles are its
    runs of three words (all of it, if shorter). The distinct shingles of all windows are the dictionary.
 2. One pass over all documents counts the dictionary's shingles. Full containment needs every shingle of a window,
    so the necessary prefix of a window in the order of rarity is its one rarest shingle; a window with a shingle
    that no document has is out.
 3. A second pass joins the documents' shingles with these prefixes only. A match at a place gives a candidate
    (row, start, window), of which the position and length bounds remove those that reach outside the text.
 4. A candidate is verified exactly: the words of the text from start on, as many as the window has, are the window's.
    Overlapping windows are merged to count the words hit.
 5. Words are counted where the result is read, so nothing with a row for every document is stored. Storing costs more
    than its rows: on a local folder without Hadoop's native library every file starts processes beside the executor.
Steps 2 and 3 compare 64-bit hashes of words after full lower-casing, which equal words always share; step 4 compares
the words themselves. Prefixes are broadcast while they are known to be few and joined by shuffle beyond, after a
bitmap of fixed size has removed most shingles.

Results: one row per input row, each judged by itself: rows with a repeated or null doc_id are as good as others. A
null or empty text has no words and is clean. Benchmark items without a word have no window; items that repeat are
counted one by one, null item_ids are not counted. Without documents there are no rows, without items none is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_table
from .common import drop_ids, may_be_in, row_keyed, split_by_ids

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII other than digits and letters.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same before A-Z are lower-cased.
_BETWEEN_CASED = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SHINGLE = 3


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), ""), F.array().cast("array<string>"))


def n_words_of(text: Column) -> Column:
    """The size of words_of, without lower-casing."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN_CASED), "")).cast("long")


def _loose(text: Column) -> Column:
    """Full lower-casing is much faster than translate; with one form of sigma it does not depend on the surroundings."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _loose_words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(_loose(text), _BETWEEN), ""), F.array().cast("array<string>"))


def _runs(words: str, size: str) -> str:
    """SQL for the array of all runs of size words as text, in order."""
    return f"case when size({words}) >= {size} then transform(sequence(0, size({words}) - {size}), i -> concat_ws(' ', slice({words}, i + 1, {size}))) else cast(array() as array<string>) end"


def _stored(df: DataFrame, few: bool) -> DataFrame:
    """df as a table; where its rows are known to be few, in no more files than there are cores, or 8."""
    return shared_table(df.coalesce(max(8, df.sparkSession.sparkContext.defaultParallelism)) if few else df)


def benchmark_windows(items: DataFrame, window: int, id_col: str, text_col: str, broadcast_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(content, size, item_id), (content, size, width, offset, h) of the shingles of each distinct window, and the rows
    of the first."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col).cast("string")).alias("w")).where("size(w) > 0")
    words = words.withColumn("size", F.least(F.size("w"), F.lit(window)))
    of_item = words.select("item_id", "size", F.explode(F.expr(_runs("w", "size"))).alias("content")).distinct()
    windows = of_item.count()
    of_item = _stored(of_item, windows <= broadcast_rows)
    spread = of_item.select("content", "size").distinct().withColumn("w", F.split(_loose(F.col("content")), " ")).withColumn("width", F.least("size", F.lit(SHINGLE)))
    hashes = "transform(sequence(0, size - width), i -> xxhash64(" + ", ".join(f"get(w, i + {k})" for k in range(SHINGLE)) + "))"
    return of_item, _stored(spread.select("content", "size", "width", F.posexplode(F.expr(hashes)).alias("offset", "h")), windows <= broadcast_rows), windows


def _places(docs: DataFrame, key: str, text_col: str, widths: list[int]) -> DataFrame:
    """(row, n, pos, h): the hash of the shingle of each width at each word.

    The outer generator keeps Spark from splitting every text once more to leave out those without a word; such a text
    has one row, with pos null.
    """
    words = docs.select(F.col(key).alias("row"), _loose_words(F.col(text_col).cast("string")).alias("w"))
    spread = words.select("row", "w", F.size("w").alias("n"), F.posexplode_outer("w").alias("pos", "x"))
    at = lambda k: F.get("w", F.col("pos") + k) if k else F.col("x")
    hashes = [F.xxhash64(*(at(k) for k in range(width))) for width in widths]
    if len(hashes) == 1:
        return spread.select("row", "n", "pos", hashes[0].alias("h"))
    return spread.select("row", "n", "pos", F.explode(F.array(*hashes)).alias("h"))


def _matches(places: DataFrame, hashes: DataFrame, small: bool) -> DataFrame:
    """The rows of places whose h is in hashes, a frame of distinct h; where these are many, some other rows too."""
    if small:
        return places.join(F.broadcast(hashes), "h")
    marked, hit = may_be_in(places, F.col("h"), hashes)
    return marked.where(hit).select(*places.columns)


def contamination(docs: DataFrame, key: str, items: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Two frames: the verified occurrences (row, start, size, content), and the windows (content, size, item_id).
    key is a column of docs with a value of its own in every row, as row_keyed gives."""
    of_item, parts, windows = benchmark_windows(items, window, item_col, item_text_col, broadcast_rows)
    maybe = F.broadcast if windows <= broadcast_rows else (lambda x: x)
    widths = sorted(r["width"] for r in parts.select("width").distinct().collect())
    places = _places(docs, key, text_col, widths or [1])

    dictionary = parts.select("h").distinct()
    few = dictionary.count() <= broadcast_rows
    freq = _matches(places, dictionary, few).groupBy("h").agg(F.count("*").alias("freq"))
    freq = _stored(freq if few else freq.join(dictionary, "h", "left_semi"), few)
    ranked = parts.join(maybe(freq), "h", "left").groupBy("content", "size").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "h", "offset")).alias("first"))
    prefix = _stored(ranked.where("first.freq > 0").select("content", "size", F.col("first.h").alias("h"), F.col("first.offset").alias("offset")), windows <= broadcast_rows)

    marked = places if windows <= broadcast_rows else _matches(places, prefix.select("h").distinct(), False)
    found = marked.join(maybe(prefix), "h").withColumn("start", F.col("pos") - F.col("offset"))
    candidates = shared_table(found.where("start >= 0 and start + size <= n").select("row", "start", "size", "content").distinct())

    texts = split_by_ids(docs.select(F.col(key).alias("row"), F.col(text_col).cast("string").alias("text")), candidates, "row")[0]
    texts = texts.select(F.col("row").alias("text_row"), words_of(F.col("text")).alias("w"))
    same = (F.col("row") == F.col("text_row")) & (F.slice("w", F.col("start") + 1, F.col("size")) == F.split("content", " "))
    verified = candidates.join(texts, same).select("row", "start", "size", "content")
    return verified, of_item


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) per row; items is the sorted array of item ids as text."""
    keyed, key = row_keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    verified, of_item = contamination(keyed, key, items, window, "text", item_col, item_text_col, broadcast_rows)
    verified = shared_table(verified)
    spans = verified.select("row", "start", (F.col("start") + F.col("size")).alias("stop")).distinct()
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.coalesce(F.max("stop").over(before), F.lit(0)))
    covered = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reach"))).alias("n_hit"))
    of_item = of_item.where("item_id is not null").select("content", F.col("item_id").cast("string").alias("item"))
    named = verified.select("row", "content").distinct().join(of_item, "content").select("row", "item").distinct()
    listed = named.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = keyed.select(F.col(key).alias("row"), "doc_id", n_words_of(F.col("text")).alias("n_words")).join(covered.join(listed, "row", "left"), "row", "left")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_col).cast("long").alias("n_items"), items_col.alias("items"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs without an occurrence of a window, with all their columns as they are."""
    keyed, key = row_keyed(docs, id_col)
    verified, _ = contamination(keyed, key, items, window, text_col, item_col, item_text_col)
    return drop_ids(keyed, shared_table(verified.select(F.col("row").alias(key)).distinct()), key).select(*docs.columns)
