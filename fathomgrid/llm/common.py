"""Helpers shared by the text operators: row keys, Arrow batches and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop_table, shared_table


def free_name(columns: Iterable[str], name: str) -> str:
    """name, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about size bytes, at least one row each."""
    rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 1 << 21


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session's limit for Arrow batches was set to BATCH_BYTES where it was Spark's default of 64 MB.

    A batch of texts is held several times over by the executor and its worker, so its size decides what both need.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":
        conf.set(name, str(BATCH_BYTES))
    return df


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, size: int = BATCH_BYTES, after: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with a function from one slice of a batch to a dict of columns in the order of schema.

    after is called when a task's rows are done: workers live on, and what they keep counts in later tasks.
    """

    def run(it: Iterable[pa.RecordBatch], fn=fn) -> Iterator[pa.RecordBatch]:
        try:
            for batch in it:
                for piece in pieces(batch, size):
                    yield pa.RecordBatch.from_pydict(fn(piece))
        finally:
            if after:
                after()

    return small_batches(df).mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds; rows (node, component).

    component is the smallest node reachable. Only nodes with an edge to another node are returned. Every round
    finds the lowest neighbour of every vertex twice and ends in a table in the shared folder; no vertex's neighbours
    are gathered in one row or, beyond a limit, in one task.
    """
    e = shared_table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        # It is done when every u has one v and no v is also a u.
        ends = e.select("u", F.lit(1).alias("up")).union(e.select("v", F.lit(0))).groupBy("u").agg(F.count("*").alias("n"), F.sum("up").alias("up"))
        state = ends.agg(F.count_if(F.expr("up > 1 or (up > 0 and n > up)")).alias("open"), F.max("n").alias("most"), F.sum("up").alias("edges")).first()
        if not state["open"]:
            break
        limit = max(256, 2 * state["edges"] // MOST_HUBS)
        limit = limit if state["most"] > limit else None
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_low(both, limit).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # Each end of a row with the lowest of both; the one that is lowest itself has none.
        small = _with_low(large, limit).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        before, e = e, shared_table(small.distinct())
        drop_table(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: At most so many vertices of very many edges are broadcast with their smallest neighbour in a round.
MOST_HUBS = 50_000


def _with_low(rows: DataFrame, limit: int | None) -> DataFrame:
    """(u, v, m): m is the smallest v of u. Rows of a u with over limit rows find it by broadcast and are dealt by v, the
    others in a window.

    Few exchanges are a point here: Spark's driver keeps a thread for each of the last minute's.
    """
    if limit is None:
        return rows.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
    hubs = rows.groupBy("u").agg(F.min("v").alias("hub_m"), F.count("*").alias("n")).where(F.col("n") > limit).select("u", "hub_m")
    found = rows.join(F.broadcast(hubs), "u", "left").withColumn("part", F.when(F.col("hub_m").isNotNull(), F.xxhash64("v")).otherwise(F.lit(0)))
    return found.select("u", "v", F.coalesce("hub_m", F.min("v").over(Window.partitionBy("u", "part"))).alias("m"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Bits of the filter below. Its table has at most 2**FILTER_BITS / 32 rows, whatever the input's size.
FILTER_BITS = 22


def _slot(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))


def may_be_in(rows: DataFrame, value: Column, values: DataFrame) -> tuple[DataFrame, Column]:
    """rows with two more columns, and a condition on them that holds wherever value is in the one column of values.

    A bitmap of fixed size over the hashes of values is broadcast, so rows need no shuffle. The condition may hold for
    a few others too; it does not hold for null.
    """
    wanted = values.toDF("x").where("x is not null").select(_slot(F.col("x")).alias("slot"))
    word, bits, at = (free_name(rows.columns, f"fathomgrid_{n}") for n in ("word", "bits", "at"))
    marks = wanted.groupBy(F.expr("slot div 32").alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias(bits))
    marked = rows.withColumn(at, _slot(value)).join(F.broadcast(marks), F.floor(F.col(at) / 32) == F.col(word), "left")
    hit = F.coalesce(F.expr(f"(shiftright({bits}, cast({at} % 32 as int)) & 1) = 1"), F.lit(False)) & value.isNotNull()
    return marked, hit


def split_by_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """docs in two parts: rows that may have an id in ids, and rows that surely have none (null ids are among these).

    The second part needs no shuffle. The first part still has to be joined exactly.
    """
    marked, hit = may_be_in(docs, F.col(id_col), ids.select(id_col))
    return marked.where(hit).select(*docs.columns), marked.where(~hit).select(*docs.columns)


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ids; only rows that may match are shuffled. Rows with a null id stay."""
    may, surely_not = split_by_ids(docs, ids, id_col)
    return may.join(ids.select(id_col).distinct(), id_col, "left_anti").select(*docs.columns).unionByName(surely_not)


def row_keyed(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a long column that is different in every row, and its name.

    It is the id where no other row has it. Rows whose id is null or occurs again (and a few that share a slot of the
    filter with these) get keys beyond all ids; they are stored, so that a task that runs again gives the same keys.
    """
    key = free_name(docs.columns, "fathomgrid_row")
    own = F.col(id_col).try_cast("long")
    ids = docs.select(own.alias("id"))
    often = shared_table(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id"))
    if often.isEmpty():
        return docs.withColumn(key, own), key
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    low, high, far = low or 0, high or 0, 1 << 62
    if high >= far and low <= -far:
        raise ValueError(f"{id_col} leaves no room for row keys: {low} to {high}")
    nth = F.monotonically_increasing_id()
    marked, hit = may_be_in(docs, own, often)
    several = marked.where(hit | own.isNull()).select(*docs.columns).withColumn(key, F.lit(high) + 1 + nth if high < far else F.lit(low) - 1 - nth)
    return marked.where(~hit & own.isNotNull()).select(*docs.columns, own.alias(key)).unionByName(shared_table(several)), key
