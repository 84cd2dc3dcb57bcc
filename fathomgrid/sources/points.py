"""Points from tables and text, and results to tables and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_columns(df: DataFrame, id_col: str, coords: list[str]) -> DataFrame:
    """(id, v) from an id column and numeric columns; rows with a null among them are left out."""
    v = F.array(*(F.col(c).cast("double") for c in coords))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull()))


def from_array(df: DataFrame, id_col: str, array_col: str, dim: int | None = None) -> DataFrame:
    """(id, v) from an id column and an array column; with dim, rows of another length are left out."""
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(array_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return out if dim is None else out.where(F.size("v") == dim)


def read_text(spark: SparkSession, path: str, dim: int, sep: str = ",", with_id: bool = True) -> DataFrame:
    """(id, v) from lines id,x1..xd and whatever follows; blanks around fields are ignored; lines that are short or have a
    field that is no number are left out.

    Without ids, the id is a hash of the line, so equal lines are equal points.
    """
    part = F.split(F.col("value"), "[" + sep.replace("\\", "\\\\").replace("]", "\\]") + "]")
    first = 1 if with_id else 0
    line_id = F.trim(part[0]).try_cast("long") if with_id else F.xxhash64("value")
    lines = spark.read.text(path).where(F.size(part) >= dim + first)
    return lines.select(line_id.alias("id"), F.transform(F.slice(part, first + 1, dim), lambda x: F.trim(x).try_cast("double")).alias("v")).where("id is not null and not exists(v, x -> x is null)")


def read_pivots(spark: SparkSession, path: str, dim: int, sep: str = ",") -> DataFrame:
    """(cell_id, v) from lines number,x1..xd."""
    return read_text(spark, path, dim, sep).select(F.col("id").alias("cell_id"), "v")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, pos, cell_id) from lines of blank-separated pivot numbers after the group's number."""
    part = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(part[0].try_cast("long").alias("group_id"), F.posexplode(F.slice(part, 2, 1_000_000)).alias("pos", "cell_id")).withColumn("cell_id", F.col("cell_id").cast("long"))


def weighted(df: DataFrame, line_col: str = "value") -> DataFrame:
    """(record, weight) from lines whose last comma separates a whole-number weight."""
    return df.select(F.regexp_extract(line_col, "^(.*),\\s*(\\d+)\\s*$", 1).alias("record"), F.regexp_extract(line_col, "^(.*),\\s*(\\d+)\\s*$", 2).cast("int").alias("weight"))


def as_lines(points: DataFrame) -> DataFrame:
    """One text column: id,x1..xd."""
    return points.select(F.concat_ws(",", F.col("id").cast("string"), F.transform("v", lambda x: x.cast("string"))).alias("value"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, replacing what is there; partitioned where asked."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_text(df: DataFrame, path: str, key: str, sep: str = "\t") -> None:
    """Lines key, separator, other columns; replaces what is there."""
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c != key]
    df.select(F.concat_ws(sep, F.col(key).cast("string"), *rest).alias("value")).write.mode("overwrite").text(path)


def numbered_pivots(points: DataFrame) -> DataFrame:
    """(cell_id, v): pivots renumbered 0, 1, ... in the order of their ids; for pivot sets, which are small."""
    from pyspark.sql import Window

    return points.select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("cell_id"), "v")
