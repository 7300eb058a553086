"""Stateful streaming: online CUSUM and canonical variates, freshness by timers, windowed counts under a watermark, and joins to a static table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orebed.operators import kernels as K

#: Rows of a key that are scored and sent on at a time.
SLICE = 20_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which all executors see; where none is set, a local session takes one of its own and a cluster is an error."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not home and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    home = home or tempfile.mkdtemp(prefix="stream-")
    return f"{home}/{name}-{uuid.uuid4().hex}"


def replay(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(out: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now: written batch by batch, each batch replacing its own folder if it is run again."""
    spark = out.sparkSession
    home = shared_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/{'all' if mode == 'complete' else f'batch={number}'}")

    out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{home}/state").foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{home}/rows/*").select(out.columns)


def online_cusum(stream: DataFrame, key: str, order: list[str], value: str, target: float, scale: float, drift: float = 0.5, threshold: float = 5.0) -> DataFrame:
    """(key, event_id, pos, neg, alarm): one-sided sums of each key, kept as state between batches and started again after an alarm."""
    id_col = order[-1]
    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, `{id_col}` {stream.schema[id_col].dataType.simpleString()}, pos double, neg double, alarm boolean"

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, n = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values(order)
        z = np.nan_to_num((rows[value].to_numpy(dtype=float) - target) / scale)
        pos, neg, alarm = K.cusum(z, drift, threshold, p, n)
        state.update((0.0, 0.0) if alarm[-1] else (float(pos[-1]), float(neg[-1])))
        yield pd.DataFrame({key: name[0], id_col: rows[id_col].to_numpy(), "pos": pos, "neg": neg, "alarm": alarm})

    return stream.groupBy(key).applyInPandasWithState(run, schema, "p double, n double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], size: str, late: str) -> DataFrame:
    """Rows of each window and key; rows later than the watermark allows are dropped by the engine."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast(stream.schema[ts].dataType).alias("start"), *keys, "n")


def enriched(stream: DataFrame, static: DataFrame, key: str, flag: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream joined to a static table and flagged."""
    return flag(stream.join(static, key))


def streamed_freshness(stream: DataFrame, keys: list[str], ts: str, arrival: str, fresh_s: float = 300, expired_s: float = 3600, slack: str = "1 second") -> DataFrame:
    """(keys, ts, at, status, late): a row for each reading as it arrives, and one whenever a key's latest reading turns STALE or EXPIRED, whether rows come or not.

    ts and arrival are times; ts and at come out as seconds since the epoch. Timers run on the clock of arrivals, so a reading may be older than any before it: it is flagged late (older than the key's
    latest) and its status is that of its age, but it is not dropped and doesn't make the key fresher. Only arrivals themselves may not go back by more than slack from batch to batch. Between two arrivals the changes are given at the times at which they were due.
    """
    expired_s = max(expired_s, fresh_s)
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "ts", "at", "status", "late"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, stage = state.get if state.exists else (float("-inf"), 0)
        out: list[tuple] = []

        def until(clock: float) -> None:
            nonlocal stage
            for n, (limit, status) in enumerate(((fresh_s, "STALE"), (expired_s, "EXPIRED")), 1):
                if stage < n and latest + limit < clock:
                    out.append((*key, latest, latest + limit, status, False))
                    stage = n

        read = [part[["_at", "_ts"]].to_numpy(float) for part in parts]  # a key's rows of a batch come in several parts, in any order
        rows = np.concatenate(read) if read else np.empty((0, 2))
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        for first in range(0, len(rows), SLICE):
            for at, t in rows[first : first + SLICE].tolist():
                if latest > float("-inf"):
                    until(at)
                age = at - t
                out.append((*key, t, at, "FRESH" if age <= fresh_s else "STALE" if age <= expired_s else "EXPIRED", t < latest))
                if t >= latest:
                    latest, stage = t, 0 if age <= fresh_s else 1 if age <= expired_s else 2
            yield pd.DataFrame(out, columns=names)
            out.clear()
        clock = state.getCurrentWatermarkMs()
        until(clock / 1000)
        state.update((latest, stage))
        if stage < 2:
            state.setTimeoutTimestamp(max(int((latest + (fresh_s, expired_s)[stage]) * 1000), clock, 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    clocked = stream.select(*keys, seconds(ts).alias("_ts"), seconds(arrival).alias("_at"), F.col(arrival).cast("timestamp").alias("_clock")).where("_ts IS NOT NULL AND _at IS NOT NULL").withWatermark("_clock", slack)
    return clocked.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, ts double, at double, status string, late boolean", "latest double, stage int", "append", GroupStateTimeout.EventTimeTimeout)


#: Bytes of models that are broadcast to a stream's tasks at most.
MODEL_BYTES = 64 << 20


def trained_variates(reference: DataFrame, keys: list[str], order: str, columns: list[str], past: int, k: int, alpha: float = 0.99) -> dict[tuple, dict[str, np.ndarray]]:
    """A model of canonical variates for each key from its reference rows: scales, the mean of past blocks, the projection and the limit. A key's reference is fitted by one task."""

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        model = K.cva_trained(part.sort_values(order)[columns].to_numpy(float), past, k, alpha)
        rows = [] if model is None else [(*key, *(model[n].ravel().tolist() for n in K.CVA_PARTS))]
        return pd.DataFrame(rows, columns=[*keys, *K.CVA_PARTS])

    kinds = ", ".join(f"`{c}` {reference.schema[c].dataType.simpleString()}" for c in keys)
    fitted = reference.select(*keys, order, *columns).groupBy(*keys).applyInPandas(fit, f"{kinds}, " + ", ".join(f"{n} array<double>" for n in K.CVA_PARTS))
    width = past * len(columns)
    if fitted.count() * 8 * (width * (k + 1) + 3 * len(columns) + 1) > MODEL_BYTES:
        raise ValueError("too many keys for models that every task holds")
    return {tuple(r[c] for c in keys): {n: np.array(r[n]) for n in K.CVA_PARTS} for r in fitted.collect()}


def scaled(x: np.ndarray, model: dict[str, np.ndarray] | None) -> np.ndarray:
    """x on the model's scale, what is missing by the reference's median."""
    return x if model is None else (np.where(np.isfinite(x), x, model["fill"]) - model["center"]) / model["scale"]


def ring_scores(ring: np.ndarray, x: np.ndarray, model: dict[str, np.ndarray] | None, past: int) -> tuple[np.ndarray, np.ndarray]:
    """The ring behind rows x, and each one's score from the `past` rows before it, NaN without as many."""
    both, t2 = np.vstack([ring, x]), np.full(len(x), np.nan)
    first = max(0, past - len(ring))
    if model is not None and len(x) > first:
        width = past * x.shape[1]
        blocks = np.lib.stride_tricks.sliding_window_view(both, past, axis=0).transpose(0, 2, 1).reshape(-1, width)[len(ring) + first - past : len(both) - past]
        t2[first:] = (((blocks - model["mean"]) @ model["project"].reshape(-1, width).T) ** 2).sum(axis=1)
    return both[-past:], t2


def online_variates(stream: DataFrame, keys: list[str], order: list[str], columns: list[str], models: dict[tuple, dict[str, np.ndarray]], past: int) -> DataFrame:
    """(keys, id, t2, alarm): each row's past block against its key's model; the last `past` rows are a ring that is kept as state between batches.

    The last column of order is the row's id. Rows come in order over batches. A task holds a key's new rows of a batch, but only their order and values, and scores SLICE of them at a time. Missing values take the reference's median. t2 is null until the ring is full, and for keys without a model.
    """
    id_col, d = order[-1], len(columns)
    names = list(dict.fromkeys([*order, *columns]))
    schema = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in [*keys, id_col]) + ", t2 double, alarm boolean"
    shared = stream.sparkSession.sparkContext.broadcast(models)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = np.array(state.get[0], dtype=float).reshape(-1, d) if state.exists else np.zeros((0, d))
        model = shared.value.get(key)
        rows = pd.concat([part[names] for part in parts], ignore_index=True).sort_values(order, ignore_index=True)
        limit = model["limit"][0] if model is not None else np.inf
        state.update((np.vstack([ring, scaled(rows[columns].iloc[-past:].to_numpy(dtype=float), model)])[-past:].ravel().tolist(),))
        for at in range(0, len(rows), SLICE):
            part = rows.iloc[at : at + SLICE]
            ring, t2 = ring_scores(ring, scaled(part[columns].to_numpy(dtype=float), model), model, past)
            out = pd.DataFrame({id_col: part[id_col].to_numpy(), "t2": t2, "alarm": t2 > limit})
            for c, v in reversed(list(zip(keys, key, strict=True))):
                out.insert(0, c, v)
            yield out

    return stream.select(*keys, *order, *columns).groupBy(*keys).applyInPandasWithState(run, schema, "ring array<double>", "append", GroupStateTimeout.NoTimeout)
