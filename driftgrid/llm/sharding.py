"""Sharding over fixed virtual slots.

A record hashes into one of a few thousand virtual slots, once and for all; what
moves is whole slots. Bytes are aggregated per slot, and a versioned slot-to-shard
map (one row per slot and version) says which shard holds which slot. A new
corpus gets version 0 by placing slots, largest first, on the least loaded shard;
rebalancing, or adding a shard, writes a next version that moves only the slots
it must. The map never has more rows than slots, whatever the corpus, so it is
safe to broadcast and to fold over in one task. Records are placed by the stored
map alone: what it says in its newest version holds.

Defined cases: a null text has no bytes (size 16, crc of the empty string); null
or repeated ids and repeated rows are placed like any others, the text and the
row's place in the table take part in the slot hash so that neither one id nor rows
alike in all columns fill a slot; a long text is one record of its size; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgrid.scratch import materialize

SLOTS = 8192
OVERHEAD = 16


def with_slots(df: DataFrame, keys: list, slots: int = SLOTS) -> DataFrame:
    """Add ``virtual_slot``, a function of ``keys`` and the fixed slot count alone."""
    return df.withColumn("virtual_slot", F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"))


def slot_loads(spark: SparkSession, records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, n_rows, n_bytes) for every slot, empty ones too; needs virtual_slot and size."""
    loads = records.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(loads), "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes")
    )


def _fold(loads: DataFrame, state: str, step: str, order: str) -> DataFrame:
    """Fold over all slots (at most the slot count, in one row) and give back one row per slot."""
    one = loads.agg(F.expr(f"array_sort(collect_list({order}))").alias("s"))
    return one.select(F.expr(f"aggregate(s, {state}, (acc, x) -> {step}).placed AS placed")).select(F.explode("placed").alias("p")).select("p.*")


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 0: slots in descending bytes, each onto the shard with the fewest bytes (ties: lowest shard)."""
    least = "CAST(array_position(acc.load, array_min(acc.load)) AS INT) - 1"
    step = f"""element_at(transform(array({least}), t -> named_struct(
        'load', transform(acc.load, (v, i) -> IF(i = t, v + x.b, v)),
        'placed', concat(acc.placed, array(named_struct('virtual_slot', x.slot, 'n_rows', x.r, 'n_bytes', x.b, 'shard', t))))), 1)"""
    state = f"""named_struct('load', array_repeat(0L, {shards}), 'placed', CAST(array() AS
        ARRAY<STRUCT<virtual_slot: INT, n_rows: BIGINT, n_bytes: BIGINT, shard: INT>>))"""
    order = "named_struct('o', -n_bytes, 'slot', virtual_slot, 'r', n_rows, 'b', n_bytes)"
    return _fold(loads, state, step, order).withColumn("version", F.lit(0))


def next_map(old: DataFrame, loads: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of ``old`` for new loads and maybe more shards.

    Slots are visited in descending bytes; one moves, to the least loaded shard,
    only if its shard is over the mean by more than ``slack`` and the move
    leaves the target below what the source had. All other slots stay.
    """
    was = old.select("virtual_slot", F.col("shard").alias("was"), (F.col("version") + 1).alias("version"))
    now = loads.join(F.broadcast(was), "virtual_slot")
    begin = now.groupBy("was").agg(F.sum("n_bytes").alias("b")).agg(F.expr("map_from_entries(collect_list(struct(was, b)))").alias("m"))
    first = begin.select(F.expr(f"transform(sequence(0, {shards - 1}), i -> coalesce(try_element_at(m, i), 0L))").alias("first")).scalar()
    one = now.agg(
        F.expr("array_sort(collect_list(named_struct('o', -n_bytes, 'slot', virtual_slot, 'r', n_rows, 'b', n_bytes, 'w', was)))").alias("s"),
        F.max("version").alias("version"),
        F.sum("n_bytes").alias("total"),
    ).withColumn("first", first)
    least = "CAST(array_position(acc.load, array_min(acc.load)) AS INT) - 1"
    must = f"acc.load[x.w] > total / {shards}D * {1 + slack}D AND array_min(acc.load) + x.b < acc.load[x.w]"
    step = f"""element_at(transform(array(IF({must}, {least}, x.w)), t -> named_struct(
        'load', transform(acc.load, (v, i) -> IF(i = x.w, v - x.b, v) + IF(i = t, x.b, 0L)),
        'placed', concat(acc.placed, array(named_struct('virtual_slot', x.slot, 'n_rows', x.r, 'n_bytes', x.b, 'shard', t))))), 1)"""
    state = """named_struct('load', first, 'placed', CAST(array() AS
        ARRAY<STRUCT<virtual_slot: INT, n_rows: BIGINT, n_bytes: BIGINT, shard: INT>>))"""
    return one.select(F.expr(f"aggregate(s, {state}, (acc, x) -> {step}).placed AS placed"), "version").select(F.explode("placed").alias("p"), "version").select("p.*", "version")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append one version to the stored map; versions are never rewritten."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest by default."""
    stored = spark.read.parquet(path)
    at = F.lit(version) if version is not None else stored.agg(F.max("version")).scalar()
    return stored.where(F.col("version") == at)


def place(records: DataFrame, slot_map: DataFrame, order: list) -> DataFrame:
    """Add ``shard`` and ``slot``, the row's gapless place in its shard.

    A place is the rows of the shard's earlier virtual slots plus the row's rank
    inside its own, so that ranking works on thousands of groups and not on one
    group per shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order)).cast("long")
    return records.withColumn("__rank", rank).join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("__start") + F.col("__rank") - 1).drop("__start", "__rank")


def balanced(spark: SparkSession, records: DataFrame, path: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """The newest version of the map stored at ``path``, after a version 0 and, where that leaves a shard too full, an edited one."""
    loads = slot_loads(spark, records, slots)
    save_map(first_map(loads, shards), path)
    edited = next_map(load_map(spark, path), loads, shards)
    if not edited.join(load_map(spark, path), ["virtual_slot", "shard"], "left_anti").isEmpty():
        save_map(edited, path)
    return load_map(spark, path)


def op2_shard(spark: SparkSession, sf_dir: str, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.coalesce("text", F.lit(""))
    records = docs.select("doc_id", (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    records = materialize(with_slots(records, ["doc_id", "text_crc32", "size", "row"], slots), "sizes")
    slot_map = balanced(spark, records, f"{records.scratch_path}-map", shards, slots)
    return place(records, slot_map, ["doc_id", "text_crc32", "size", "row"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
