"""Trajectory sources and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.functions.boxes import mercator
from driftgrid.scratch import materialize

POINTS = "tid INT, ts BIGINT, x DOUBLE, y DOUBLE"


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``tid ts x y`` lines; order them by (ts, tid) where arrival order matters."""
    return spark.read.csv(path, sep="\t", schema=POINTS)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as (seq, value): ``seq`` grows with the files' names and, within a file, with the lines; it is not gapless."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    stored = materialize(lines, "lines")
    files = stored.groupBy("file", "block").agg(F.min("id").alias("first"))
    order = files.withColumn("nth", F.row_number().over(Window.orderBy("file", "block")).cast("long") - 1)  # a row for each piece of a file
    return stored.join(F.broadcast(order), ["file", "block"]).select((F.col("nth") * (1 << 33) + F.col("id") - F.col("first")).alias("seq"), "value")


def parse_points(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated ``tid ts x y`` lines as points; other columns stay, malformed fields are null."""
    parts = F.split(column, "\t")
    fields = [F.get(parts, i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(T.StructType.fromDDL(POINTS))]
    return lines.select(*[c for c in lines.columns if c != column], *fields)


def parse_gps(lines: DataFrame, column: str = "value") -> DataFrame:
    """Raw GPS lines, tab or comma: id, date and time, lon, lat. A malformed line has x = 0."""
    parts = F.split(F.regexp_replace(column, "[\t,]", " "), " ")
    full = (F.size(parts) == 5) & (F.length(F.get(parts, 1)) == 10)
    ts = F.try_to_timestamp(F.concat_ws(" ", F.get(parts, 1), F.get(parts, 2)), F.lit("yyyy-MM-dd HH:mm:ss"))
    tid, lon, lat = F.get(parts, 0).try_cast("int"), F.get(parts, 3).try_cast("double"), F.get(parts, 4).try_cast("double")
    good = full & ts.isNotNull() & tid.isNotNull() & lon.isNotNull() & lat.isNotNull()
    x, y = mercator(lon, lat)
    return lines.select(tid.alias("tid"), F.unix_millis(ts).alias("ts"), F.when(good, x).otherwise(0.0).alias("x"), F.when(good, y).otherwise(0.0).alias("y"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables' events as points (seq, tid, ts, x, y)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("tid"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        (F.col("value") * 15.0).alias("x"), (F.get_json_object("props", "$.k").cast("double") * 88.0).alias("y"),
    )


def kafka_points(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same lines from Kafka, from the earliest offset on (needs the connector's jar)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return parse_points(raw.select(F.col("value").cast("string")))


def sample_until(points: DataFrame, start: int, length_ms: int) -> DataFrame:
    """Points before ``start + length_ms`` and the first one at or past it."""
    past = points.where(F.col("ts") >= start + length_ms).agg(F.min(F.struct("ts", "seq")).alias("m")).scalar()
    return points.where((F.col("ts") < start + length_ms) | (F.struct("ts", "seq") == past))


def write_results(results: DataFrame, path: str) -> None:
    """The folder is wiped first; any table of rows, arrays and structs can be written."""
    results.write.mode("overwrite").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_results` wrote, one row a query."""
    return spark.read.parquet(path)


def console(stream: DataFrame, rows: int = 20):
    """A streaming query that prints each batch."""
    return stream.writeStream.format("console").option("numRows", rows).option("truncate", False)


def split_round_robin(lines: DataFrame, n: int, path: str, order: str = "seq", column: str = "value") -> None:
    """Line i goes to folder ``part={i mod n}``."""
    lines.select(column, F.pmod(F.col(order), F.lit(n)).alias("part")).write.mode("append").partitionBy("part").text(path)
