"""Shards of near equal bytes through fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabloom.llm.storage import text_key, whole_text

N_SLOTS = 4096
_MAP_SCHEMA = T.StructType([
    T.StructField("virtual_slot", T.IntegerType(), False), T.StructField("shard", T.IntegerType(), False),
    T.StructField("slot_bytes", T.LongType(), False), T.StructField("slot_rows", T.LongType(), False),
    T.StructField("first_position", T.LongType(), False),
])


def record_size(text: Column) -> Column:
    return F.octet_length(text).cast("long") + F.lit(8)


def slot_totals(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """(bytes, rows) per virtual slot; at most twice the number of slots reaches the driver."""
    totals = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    return {r[0]: (r[1], r[2]) for r in totals.collect()}


def balanced(sizes: dict[int, int], n_shards: int) -> dict[int, int]:
    """A first map: the largest slot goes to the lightest shard, again and again."""
    loads = [(0, shard) for shard in range(n_shards)]
    out = {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        load, shard = heapq.heappop(loads)
        out[slot] = shard
        heapq.heappush(loads, (load + sizes[slot], shard))
    return out


def rebalanced(old: dict[int, int], sizes: dict[int, int], n_shards: int) -> dict[int, int]:
    """An edited map: slots leave a shard only while it stands above the new mean, and go where most is missing.

    Slots of shards that no longer exist and slots new in ``sizes`` move too; all others keep their shard.
    """
    mean = sum(sizes.values()) / max(n_shards, 1)
    out = {s: old[s] for s in sizes if old.get(s, n_shards) < n_shards}
    loads = [0] * n_shards
    for slot, shard in out.items():
        loads[shard] += sizes[slot]
    homeless = [s for s in sizes if s not in out]
    for slot in sorted(out, key=lambda s: (-sizes[s], s)):
        shard = out[slot]
        if loads[shard] - sizes[slot] >= mean:
            loads[shard] -= sizes[slot]
            homeless.append(slot)
    for slot in homeless:
        out.pop(slot, None)
    queue = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(queue)
    for slot in sorted(homeless, key=lambda s: (-sizes[s], s)):
        load, shard = heapq.heappop(queue)
        out[slot] = shard
        heapq.heappush(queue, (load + sizes[slot], shard))
    return out


def map_frame(spark: SparkSession, shards: dict[int, int], totals: dict[int, tuple[int, int]]) -> DataFrame:
    """The map as a table; ``first_position`` is where a slot's rows begin inside their shard."""
    rows, begin = [], {}
    for slot in sorted(shards):
        size, n = totals[slot]
        shard = shards[slot]
        rows.append((slot, shard, size, n, begin.get(shard, 0)))
        begin[shard] = begin.get(shard, 0) + n
    return spark.createDataFrame(rows, _MAP_SCHEMA)


def write_map(frame: DataFrame, folder: str, version: int) -> None:
    """Store one version beside the earlier ones; a version is never overwritten."""
    frame.coalesce(1).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(_MAP_SCHEMA).parquet(f"{folder.rstrip('/')}/version={version}")


def with_slots(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot) per row.

    Rows of equal text share a slot, and so a shard. Only a text whose copies together are heavier than half a shard's
    share is split: its rows are hashed by id into a second range of as many slots. Such texts are sought in the slots
    above that weight; at most twice as many as there are shards reach the driver. Other texts of these slots stay.
    """
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), record_size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(n_slots)).cast("int").alias("virtual_slot"), *text_key(text),
    )
    totals = slot_totals(rows)
    most = sum(size for size, _ in totals.values()) / (2 * n_shards)
    heavy = sorted(slot for slot, (size, n) in totals.items() if size > most and n > 1)
    copies = rows.where(F.col("virtual_slot").isin(heavy)).groupBy("k1", "k2").agg(
        F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")
    ).where((F.col("b") > most) & (F.col("n") > 1)) if heavy else None
    hot = [(r["k1"], r["k2"]) for r in copies.collect()] if heavy else []
    if not hot:
        return rows.drop("k1", "k2")
    is_hot = F.lit(False)
    for k1, k2 in hot:
        is_hot = is_hot | ((F.col("k1") == k1) & (F.col("k2") == k2))
    spread = F.lit(n_slots) + F.pmod(F.xxhash64("doc_id", F.lit("spread")), F.lit(n_slots)).cast("int")
    return rows.withColumn(
        "virtual_slot", F.when(is_hot, spread).otherwise(F.col("virtual_slot"))
    ).drop("k1", "k2")


def shard_documents(
    docs: DataFrame, n_shards: int, map_folder: str, version: int = 1, previous: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS,
) -> DataFrame:
    """Every row with its shard by the law ``bytes``: (id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot).

    Records are hashed into fixed virtual slots, bytes are summed per slot, and the slot-to-shard map is stored in
    ``map_folder`` as ``version``. With ``previous`` an earlier version is edited, which moves as few slots as equal
    sizes allow. ``slot`` is the row's place in its shard, gapless from 0, by virtual slot and then id. The map has
    at most ``2 * n_slots`` rows, which bounds what is collected and broadcast.

    A null text has no bytes and the checksum 0; a null id sorts first. Repeated rows each get a place. An empty table
    gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = with_slots(docs, n_shards, id_col, text_col, n_slots)
    totals = slot_totals(rows)
    sizes = {slot: size for slot, (size, _) in totals.items()}
    if previous is None:
        shards = balanced(sizes, n_shards)
    else:
        old = {r["virtual_slot"]: r["shard"] for r in read_map(spark, map_folder, previous).collect()}
        shards = rebalanced(old, sizes, n_shards)
    write_map(map_frame(spark, shards, totals), map_folder, version)
    slots = read_map(spark, map_folder, version).select("virtual_slot", "shard", "first_position")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(order)).join(F.broadcast(slots), "virtual_slot")
    return placed.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_position") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
