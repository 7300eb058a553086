"""Sharding by a permutation-filled lookup table, in DataFrame expressions.

Each shard has a preference order over the slots of a table of prime size: start and step
come from hashes of its name, so the order is a permutation. Shards take turns, each claiming its first
free slot, until all are claimed; so shards own slots evenly, and when a shard goes,
few slots of the others change hands. A key's hash names its slot; the broadcast
table (of a size that the parameters fix) names the slot's shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
#: A prime, about a hundred times the number of shards: slots per shard then differ by at most one in about a hundred.
SLOTS = 6421
#: Preferences looked at first; only when none of them is free, the rest is.
PEEK = 32


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def _hash(text: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), start, length), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table. slots must be a prime not below the number of shards; shard names must differ."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, and one at least")
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, not below the number of shards")
    names = F.array(*[F.lit(s) for s in shards])
    n = len(shards)
    # One row for each shard; as literals, so that the fold below doesn't hash names again in every turn.
    named = spark.range(n).select("id", F.get(names, F.col("id").cast("int")).alias("s"))
    orders = named.select(_hash(F.col("s"), 1, 8) % slots, _hash(F.col("s"), 9, 8) % (slots - 1) + 1).orderBy("id").collect()
    starts, steps = (F.array(*[F.lit(int(o[k])).cast("long") for o in orders]) for k in (0, 1))
    none = F.struct(F.unhex(F.repeat(F.lit("00"), slots)).alias("taken"), F.array_repeat(F.lit(0).cast("long"), n).alias("tried"), F.lit("").alias("claims"))

    def turn(s: Column, t: Column) -> Column:
        i = (t % n).cast("int")
        first, step, tried = F.get(starts, i), F.get(steps, i), F.get(s["tried"], i)
        slot = lambda j: ((first + j * step) % slots).cast("int")
        free = lambda a, b: F.get(F.filter(F.sequence(a, b), lambda j: F.substring(s["taken"], slot(j) + 1, F.lit(1)) == F.unhex(F.lit("00"))), F.lit(0))
        last = F.lit(slots - 1).cast("long")
        peek = F.least(tried + PEEK, last)
        claim = F.array(F.coalesce(free(tried, peek), free(peek, last)))
        # A one-element transform binds the claimed preference, so that it is searched for once.
        done = F.transform(
            claim,
            lambda j: F.struct(
                F.overlay(s["taken"], F.unhex(F.lit("01")), slot(j) + 1, F.lit(1)).alias("taken"),
                F.concat(F.slice(s["tried"], F.lit(1), i), F.array(j + 1), F.slice(s["tried"], i + 2, F.lit(n))).alias("tried"),
                F.concat(s["claims"], F.lit(","), slot(j).cast("string")).alias("claims"),
            ),
        )
        return F.get(done, F.lit(0))

    filled = spark.range(1).select(F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), none, turn, lambda s: F.split(F.substring(s["claims"], 2, 1 << 30), ",")).alias("claims"))
    return filled.select(F.posexplode("claims").alias("t", "slot")).select(F.col("slot").cast("int").alias("slot"), F.get(names, F.col("t") % n).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key as text; a null key is placed like an empty text."""
    return (_hash(F.coalesce(key.cast("string"), F.lit("")), 1, 15) % slots).cast("int")


def placed(rows: DataFrame, table: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """rows with slot and shard (such columns of rows are replaced); rows are not moved, and repeated rows meet in one shard."""
    rows = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(table), "slot")  # the table has as many rows as slots


def write_shards(rows: DataFrame, path: str, files_per_shard: int = 4) -> None:
    """Write rows with a shard column as a folder for each shard; a shard is dealt over files_per_shard tasks by all its columns' hash."""
    salt = F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.lit(files_per_shard))
    rows.repartition(F.col("shard"), salt).write.mode("overwrite").partitionBy("shard").parquet(path)


def oracle_sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The placement of documents in DuckDB SQL, the filling of the table included."""
    h = lambda text, start, length: f"('0x' || substr(md5({text}), {start}, {length}))::BIGINT"
    return f"""
WITH RECURSIVE shards AS (SELECT range::INT AS i, 'shard-' || lpad(range::VARCHAR, 5, '0') AS shard FROM range({shards})),
orders AS (SELECT list({h('shard', 1, 8)} % {slots} ORDER BY i) AS starts, list({h('shard', 9, 8)} % {slots - 1} + 1 ORDER BY i) AS steps FROM shards),
fill(t, slot, taken) AS (
  SELECT -1, -1::BIGINT, repeat('0', {slots})::BIT
  UNION ALL
  SELECT t + 1, slot, set_bit(taken, slot::INT, 1) FROM (
    SELECT t, taken, (start + step * list_filter(range({slots}), lambda j: get_bit(taken, ((start + j * step) % {slots})::INT) = 0)[1]) % {slots} AS slot
    FROM (SELECT t, taken, starts[(t + 1) % {shards} + 1] AS start, steps[(t + 1) % {shards} + 1] AS step FROM fill, orders WHERE t + 1 < {slots}))),
slots AS (SELECT slot::INT AS slot, t % {shards} AS i FROM fill WHERE t >= 0)
SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, slot, shard
FROM (SELECT *, ({h("coalesce(doc_id::VARCHAR, '')", 1, 15)} % {slots})::INT AS slot FROM documents) JOIN slots USING (slot) JOIN shards USING (i)"""
