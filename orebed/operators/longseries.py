"""Kernels over series of any length: rows dealt in order, blocks with halos, and states composed across blocks.

A series may be longer than a task can hold. Its rows are sorted over all tasks by range partitions, which gives
every row its place; places are cut into blocks. A filter needs some rows before and behind a block (its halo), which are copied to it.
A recursion needs the state that the blocks before leave: a block that is a function of few numbers is summed up by them and composed
with the others; any other recursion is run from a guess and again from where its predecessor ended, until all agree.
Keys are not null; the order's columns tell rows of a series apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.operators import kernels as K
from orebed.streaming.online import shared_folder

#: Rows of a block.
BLOCK = 1 << 16
#: Rows of a table that is broadcast at most, and bins of a series' values.
FEW, BINS = 500_000, 16


def settled(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: its rows and their places stay as they are, whatever is lost."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "settled"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared checkpoint folder by columns: for many rows that are dear to make and read several times."""
    path = f"{shared_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def placed(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """keys and columns with t_idx, each row's place in its series from 0, without gathering a series.

    Rows are sorted by range partitions and counted within each; only series that go on from an earlier partition (one for each
    partition at most) get an offset, so what is broadcast has as many rows as there are partitions.
    """
    wanted = df.select(*dict.fromkeys([*keys, *order, *columns]))
    in_order = wanted.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*dict.fromkeys([*keys, *columns])).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.select(keys).to_pandas()
            change = (own != own.shift()).any(axis=1).to_numpy()
            change[0] = tuple(own.iloc[0]) != last
            at = np.arange(len(own))
            start = np.maximum.accumulate(np.where(change, at, -1))
            local = np.where(start >= 0, at - start, at + seen)
            last, seen = tuple(own.iloc[-1]), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], names=[*batch.schema.names, "_local"])

    rows = settled(in_order.mapInArrow(run, f"{_types(in_order, in_order.columns)}, _local long"))
    ends = rows.groupBy(*keys, "_part").agg((F.max("_local") + 1).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ends.select(*keys, "_part", before.alias("_before")).where("_before IS NOT NULL")
    return rows.join(F.broadcast(offsets), [*keys, "_part"], "left").select(*dict.fromkeys([*keys, *columns]), (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("t_idx"))


def quantile_of(df: DataFrame, keys: list[str], value: str, q: float | Column, name: str) -> DataFrame:
    """(keys, name): the linearly interpolated quantile of each series' values that are not null, picked by their places in order; q may be read from the keys."""
    rows = placed(df.where(F.col(value).isNotNull()).withColumn("_tie", F.monotonically_increasing_id()), keys, [value, "_tie"], [value])
    at = rows.groupBy(*keys).agg(((F.max("t_idx")) * F.lit(q)).alias("_at"))
    near = rows.join(at, keys).where("t_idx IN (floor(_at), ceil(_at))")
    low, high = F.min_by(value, "t_idx"), F.max_by(value, "t_idx")
    return near.groupBy(*keys).agg((low + (high - low) * F.first(F.col("_at") - F.floor("_at"))).alias(name))


def few(df: DataFrame) -> DataFrame:
    """df, settled; it is broadcast where it has FEW rows at most."""
    df = settled(df)
    return F.broadcast(df) if df.count() <= FEW else df


def binned_quantile_of(df: DataFrame, keys: list[str], value: str, q: float | Column, name: str) -> DataFrame:
    """As quantile_of, for rows that are cheap to read three times: values are counted in BINS even bins of each series, and only those of the bins that hold the quantile get places.

    Bins keep the order of values, so what stands before a bin is a count; where values can't be binned (not finite, or all equal), one bin holds them all.
    """
    known = df.where(F.col(value).isNotNull())
    span = few(known.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(F.lit(1)).alias("_size")))
    width = F.col("_high") - F.col("_low")
    place = F.floor((F.col(value) - F.col("_low")) / width * BINS).cast("int")
    binned = known.join(span, keys).select(*keys, value, "_size", F.when((width > 0) & (width < float("inf")), F.least(place, F.lit(BINS - 1))).otherwise(0).alias("_bin"))
    behind = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin"))
    bins = binned.groupBy(*keys, "_bin", "_size").agg(F.count(F.lit(1)).alias("_n")).withColumn("_behind", behind).withColumn("_at", (F.col("_size") - 1) * F.lit(q))
    wanted = few(bins.where((F.col("_behind") - F.col("_n") <= F.ceil("_at")) & (F.col("_behind") > F.floor("_at"))).select(*keys, "_bin", "_at", (F.col("_behind") - F.col("_n")).alias("_before")))
    at = few(wanted.groupBy(*keys).agg(F.first("_at").alias("_at"), F.min("_before").alias("_before")))
    rows = placed(binned.join(wanted.select(*keys, "_bin"), [*keys, "_bin"], "left_semi").select(*keys, value).withColumn("_tie", F.monotonically_increasing_id()), keys, [value, "_tie"], [value])
    near = rows.join(at, keys).withColumn("t_idx", F.col("t_idx") + F.col("_before")).where("t_idx IN (floor(_at), ceil(_at))")
    low, high = F.min_by(value, "t_idx"), F.max_by(value, "t_idx")
    return near.groupBy(*keys).agg((low + (high - low) * F.first(F.col("_at") - F.floor("_at"))).alias(name))


def in_blocks(rows: DataFrame, at: str | Column = "t_idx", last: Column | None = None, before: int = 0, after: int = 0, size: int = BLOCK) -> DataFrame:
    """rows with _at and _block; a row also stands in the blocks whose first row is up to `before` behind it, or whose last row is up to `after` ahead of it."""
    at = F.col(at) if isinstance(at, str) else at
    out = rows.withColumn("_at", at.cast("long"))
    if not before and not after:
        return out.withColumn("_block", F.floor(F.col("_at") / size).cast("long"))
    first = F.greatest(F.floor((F.col("_at") - after) / size), F.lit(0))
    to = F.floor((F.col("_at") + before) / size)
    to = F.least(to, last) if last is not None else to
    return out.withColumn("_first", first.cast("long")).withColumn("_to", to.cast("long")).where("_first <= _to").withColumn("_block", F.explode(F.sequence("_first", "_to"))).drop("_first", "_to")


def per_block(blocks: DataFrame, keys: list[str], columns: list[str], kernel: Callable[[int, np.ndarray, np.ndarray], dict[str, object]], schema: str) -> DataFrame:
    """kernel(block, places, matrix of columns, by place) -> columns of schema, for each block of each series; nulls arrive as NaN."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at", kind="stable")
        out = pd.DataFrame(kernel(int(key[-1]), part["_at"].to_numpy(), part[columns].to_numpy(dtype=float)))
        for k, v in reversed(list(zip(keys, key[:-1], strict=True))):
            out.insert(0, k, v)
        return out

    return blocks.select(*keys, "_block", "_at", *columns).groupBy(*keys, "_block").applyInPandas(run, f"{_types(blocks, keys)}, {schema}")


# Recursions -----------------------------------------------------------------------------------------------------------


def saturating_counter(rows: DataFrame, keys: list[str], alarm: str | Column, normal: str | Column | None = None, initial: int = 0, maximum: int = 1000, size: int = BLOCK) -> DataFrame:
    """rows (keys, t_idx, ...) with criticality: up by one on an alarm, down by one without, held where the row is not normal, within 0 .. maximum.

    A row's step is a clamp (x -> min(high, max(low, x + shift))), and clamps compose to clamps: blocks are summed up by three numbers, which are
    composed in order for each series, and then every block runs from what it is entered with. A null flag is no alarm, a null normal is not normal.
    """
    flag = F.coalesce(F.col(alarm) if isinstance(alarm, str) else alarm, F.lit(False))
    hold = F.lit(False) if normal is None else ~F.coalesce(F.col(normal) if isinstance(normal, str) else normal, F.lit(False))
    blocks = in_blocks(rows.withColumn("_step", F.when(hold, 0).when(flag, 1).otherwise(-1)), size=size)

    def walked(steps: list[int], x: float) -> list[float]:
        out = []
        for s in steps:
            x = max(0, min(maximum, x + s))
            out.append(x)
        return out

    def summed(block: int, _: np.ndarray, x: np.ndarray) -> dict[str, object]:
        steps = x[:, 0].astype(int).tolist()
        return {"block": [block], "shift": [sum(steps)], "low": [int(walked(steps, -np.inf)[-1])], "high": [int(walked(steps, np.inf)[-1])]}

    clamps = per_block(blocks, keys, ["_step"], summed, "block long, shift long, low long, high long")

    def entered(part: pd.DataFrame) -> pd.DataFrame:
        part, x, out = part.sort_values("block"), initial, []
        for shift, low, high in zip(part["shift"], part["low"], part["high"], strict=True):
            out.append(x)
            x = min(high, max(low, x + shift))
        return part[keys].assign(_block=part["block"], _entry=out)

    entries = clamps.groupBy(*keys).applyInPandas(entered, f"{_types(rows, keys)}, _block long, _entry long")
    met = blocks.join(entries, [*keys, "_block"])
    counted = per_block(met, keys, ["_step", "_entry"], lambda _, at, x: {"_row": at, "criticality": np.array(walked(x[:, 0].astype(int).tolist(), int(x[0, 1])), dtype=np.int64)}, "_row long, criticality long")
    return rows.join(counted.withColumnRenamed("_row", "t_idx"), [*keys, "t_idx"])


def carried(rows: DataFrame, keys: list[str], columns: list[str], start: list[float], kernel: Callable[[np.ndarray, np.ndarray], tuple[dict[str, np.ndarray], np.ndarray]], schema: str, size: int = BLOCK) -> DataFrame:
    """(keys, t_idx, schema): kernel(matrix, state) -> (columns, state after) over each series as if in one piece.

    Blocks that have a successor are first run from `start`. Those whose predecessor ended in another state are run again from that one, until there are none:
    once where states are forgotten within a block (as after a reset), and never more often than a series has blocks.
    """
    blocks = in_blocks(rows, size=size)
    state = [f"_s{i}" for i in range(len(start))]
    own = F.array(*[F.lit(float(s)) for s in start])
    last = blocks.groupBy(*keys).agg(F.max("_block").alias("_last")).where("_last > 0")
    inner = settled(blocks.join(last, keys).where("_block < _last").select(*keys, "_block", "_at", *columns))

    def ends(entered: DataFrame) -> DataFrame:
        def run(block: int, _: np.ndarray, x: np.ndarray) -> dict[str, object]:
            entry = x[0, len(columns) :]
            return {"_ran": [block], "_from": [entry.tolist()], "_to": [kernel(x[:, : len(columns)], entry)[1].tolist()]}

        wide = inner.join(entered, [*keys, "_block"]).select(*inner.columns, *[F.col("_due")[i].alias(s) for i, s in enumerate(state)])
        return per_block(wide, keys, [*columns, *state], run, "_ran long, _from array<double>, _to array<double>").withColumnRenamed("_ran", "_block")

    done = settled(ends(inner.select(*keys, "_block").distinct().withColumn("_due", own)))
    by_place = Window.partitionBy(*keys).orderBy("_block")
    while True:
        due = done.withColumn("_due", F.coalesce(F.lag("_to").over(by_place), own))
        wrong = settled(due.where("_due != _from").select(*keys, "_block", "_due"))
        if wrong.isEmpty():
            break
        done = settled(done.join(wrong, [*keys, "_block"], "left_anti").unionByName(ends(wrong)))
    entries = done.select(*keys, (F.col("_block") + 1).alias("_block"), F.col("_to").alias("_due"))
    met = blocks.join(entries, [*keys, "_block"], "left").withColumn("_due", F.coalesce("_due", own)).select(*keys, "_block", "_at", *columns, *[F.col("_due")[i].alias(s) for i, s in enumerate(state)])

    def run(block: int, at: np.ndarray, x: np.ndarray) -> dict[str, object]:
        return {"t_idx": at, **kernel(x[:, : len(columns)], x[0, len(columns) :])[0]}

    return per_block(met, keys, [*columns, *state], run, f"t_idx long, {schema}")


def cusum(rows: DataFrame, keys: list[str], z: str = "z", drift: float = 0.5, threshold: float = 5.0, size: int = BLOCK) -> DataFrame:
    """(keys, t_idx, pos, neg, alarm): one-sided sums that start again after an alarm, over series of any length."""

    def run(x: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        pos, neg, alarm = K.cusum(np.nan_to_num(x[:, 0]), drift, threshold, *state)
        return {"pos": pos, "neg": neg, "alarm": alarm}, np.zeros(2) if alarm[-1] else np.array([pos[-1], neg[-1]])

    return carried(rows, keys, [z], [0.0, 0.0], run, "pos double, neg double, alarm boolean", size)


# Halos ----------------------------------------------------------------------------------------------------------------


def change_points(rows: DataFrame, keys: list[str], size: int, z: float, value: str = "value", block: int = BLOCK) -> DataFrame:
    """(keys, t_idx, score): contrasts of the medians on both sides of a place in pooled robust scales, strongest first, none nearer than size.

    Scores need a halo of size rows. Of those of z or more, a place is taken if none within size stands before it (higher score, then earlier), and whatever is
    nearer than size to it goes; that is done to all places at once, until none is left, and takes the places that going through them one by one takes.
    """
    blocks = in_blocks(rows, before=size, after=size, size=block)

    def scores(b: int, at: np.ndarray, x: np.ndarray) -> dict[str, object]:
        scored = K.contrasts(x[:, 0], size)
        keep = (at >= b * block) & (at < (b + 1) * block) & (scored >= z)
        return {"t_idx": at[keep], "score": scored[keep]}

    left = settled(per_block(blocks, keys, [value], scores, "t_idx long, score double"))
    near = Window.partitionBy(*keys).orderBy("t_idx").rangeBetween(-(size - 1), size - 1)
    taken = None
    while not left.isEmpty():
        best = F.max(F.struct("score", (-F.col("t_idx")).alias("_t"))).over(near)
        marked = left.withColumn("_is", best["_t"] == -F.col("t_idx"))
        marked = settled(marked.withColumn("_gone", F.max("_is").over(near)))
        now = marked.where("_is").select(*keys, "t_idx", "score")
        taken = now if taken is None else taken.unionByName(now)
        left = settled(marked.where("NOT _gone").select(*keys, "t_idx", "score"))
    return left if taken is None else taken


def _lengths(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg((F.max("t_idx") + 1).alias("_n"), F.min_by(value, "t_idx").alias("_head"), F.max_by(value, "t_idx").alias("_tail"))


def _periodic(images: DataFrame, period: Column, before: int, after: int, size: int, shift: Column | int = 0) -> DataFrame:
    """Rows at _p of a periodic sequence in every block that needs them, as often as the period is passed."""
    p = F.col("_p") - shift
    first, to = F.ceil((-before - p) / period), F.floor((F.col("_n") + size + after - p) / period)
    virtual = images.withColumn("_turn", F.explode(F.sequence(first.cast("long"), to.cast("long"))))
    last = F.floor((F.col("_n") - 1) / size)
    return in_blocks(virtual, F.col("_p") - shift + F.col("_turn") * period, last, before, after, size)


def wavelet_denoised(rows: DataFrame, keys: list[str], levels: int = 3, value: str = "value", size: int = BLOCK) -> DataFrame:
    """(keys, t_idx, smooth): the periodic db4 transform with details shrunk by the universal threshold, and back.

    Taps of all levels reach 7 (2**levels - 1) rows, which is the halo (about the ends, the padded series goes round); blocks begin at multiples of 2**levels. The noise is the median of the finest
    details of the whole series, picked by places. A series whose padding would be longer than itself stays as it is.
    """
    step, taps = 1 << levels, len(K.DB4)
    halo = -(-(taps - 1) * (step - 1) // step) * step + step
    size = -(-size // step) * step
    whole = rows.join(_lengths(rows, keys, value), keys).withColumn("_pad", F.pmod(-F.col("_n"), F.lit(step)))
    padded = whole.where("_pad <= _n")
    mirror = F.col("_n") * 2 - 1 - F.col("t_idx")
    images = padded.withColumn("_p", F.explode(F.array_compact(F.array(F.col("t_idx"), F.when(mirror < F.col("_n") + F.col("_pad"), mirror)))))
    blocks = settled(_periodic(images, F.col("_n") + F.col("_pad"), halo, halo, size).select(*keys, "_block", "_at", value, "_n", "_pad"))

    def finest(b: int, at: np.ndarray, x: np.ndarray) -> dict[str, object]:
        first, to = b * size - int(at[0]), int(min((b + 1) * size, x[0, 1] + x[0, 2])) - int(at[0])
        windows = np.lib.stride_tricks.sliding_window_view(x[:, 0], taps)[first:to:2]
        return {"d": np.abs(windows @ K.high_pass())}

    noise = quantile_of(per_block(blocks, keys, [value, "_n", "_pad"], finest, "d double"), keys, "d", 0.5, "_noise")

    def smoothed(b: int, at: np.ndarray, x: np.ndarray) -> dict[str, object]:
        n = int(x[0, 1])
        cut = x[0, 3] / 0.6745 * np.sqrt(2 * np.log(n + x[0, 2]))
        lead = int(at[0]) % step  # halos are whole steps, so none
        y = K.wavelet_shrunk(x[lead : lead + (len(x) - lead) // step * step, 0], levels, cut)
        inside = slice(b * size - int(at[0]), min((b + 1) * size, n) - int(at[0]))
        return {"t_idx": at[inside], "smooth": y[inside]}

    done = per_block(blocks.join(noise, keys), keys, [value, "_n", "_pad", "_noise"], smoothed, "t_idx long, smooth double")
    return done.unionByName(whole.where("_pad > _n").select(*keys, "t_idx", F.col(value).cast("double").alias("smooth")))


def bandpass_halo(fs: float, low: float, high: float, order: int) -> int:
    """Rows after which a band-pass has forgotten all but 1e-12: its slowest pole, by the nearest border of the band."""
    narrow = min(low, high - low, max(fs / 2 - high, (high - low) / 2))
    return int(np.ceil(28 / (2 * np.pi * narrow / fs * np.sin(np.pi / (2 * order)))))


def banded(rows: DataFrame, keys: list[str], fs: float, low: float, high: float, order: int = 4, value: str = "value", size: int = BLOCK) -> DataFrame:
    """(keys, t_idx, band, envelope): the zero-phase Butterworth band-pass, and the magnitude of its analytic signal.

    Ends are mirrored about their values as in kernels.bandpass. A block is filtered with halos beyond which the response has fallen to 1e-12; the
    band leaves out the constant, so the analytic signal dies away as fast, and the envelope needs no more.
    """
    pad = F.least(F.col("_n") - 1, F.lit(3 * (2 * order + 1)))
    halo = bandpass_halo(fs, low, high, order)
    whole = rows.join(_lengths(rows, keys, value), keys).withColumn("_pad", pad)
    t, n = F.col("t_idx"), F.col("_n")
    plain = F.struct((t + F.col("_pad")).alias("p"), F.col(value).alias("v"))
    head = F.when((t >= 1) & (t <= F.col("_pad")), F.struct((F.col("_pad") - t).alias("p"), (2 * F.col("_head") - F.col(value)).alias("v")))
    tail = F.when((t >= n - 1 - F.col("_pad")) & (t <= n - 2), F.struct((F.col("_pad") + 2 * (n - 1) - t).alias("p"), (2 * F.col("_tail") - F.col(value)).alias("v")))
    images = whole.withColumn("_i", F.explode(F.array_compact(F.array(plain, head, tail)))).select(*keys, "_n", "_pad", F.col("_i.p").alias("_p"), F.col("_i.v").alias("_v"))
    blocks = _periodic(images, n + 2 * F.col("_pad"), halo, halo, size, F.col("_pad"))

    def run(b: int, at: np.ndarray, x: np.ndarray) -> dict[str, object]:
        f = np.fft.fftfreq(len(x), 1 / fs)
        y = np.fft.ifft(np.fft.fft(x[:, 0]) * np.where(f > 0, 2, 0) * K.band_gain(np.abs(f), fs, low, high, order))
        inside = slice(b * size - int(at[0]), min((b + 1) * size, int(x[0, 1])) - int(at[0]))
        return {"t_idx": at[inside], "band": y.real[inside], "envelope": np.abs(y)[inside]}

    return per_block(blocks, keys, ["_v", "_n"], run, "t_idx long, band double, envelope double")


def cva_monitoring(rows: DataFrame, keys: list[str], columns: list[str], past: int, k: int, reference: float = 2 / 3, alpha: float = 0.99, size: int = BLOCK) -> DataFrame:
    """(keys, t_idx, t2, alarm): canonical variates between past and future blocks of rows, trained on the first part of each series.

    Missing values take the channel's median. Products of the blocks' rows are added up for each series, which gives a model of few numbers; scores need a
    halo of `past` rows; the limit is a quantile of the reference's scores. Series whose reference has fewer than three rows with both blocks get null scores and no alarm.
    """
    for c in columns:
        good = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
        rows = rows.withColumn(c, good).join(quantile_of(rows.withColumn(c, good), keys, c, 0.5, "_mid"), keys, "left").withColumn(c, F.coalesce(c, "_mid", F.lit(0.0))).drop("_mid")
    lengths = rows.groupBy(*keys).agg(F.floor((F.max("t_idx") + 1) * F.lit(reference)).cast("long").alias("_ref"))
    rows = settled(rows.join(lengths, keys).select(*keys, "t_idx", "_ref", *columns))
    stats = rows.where("t_idx < _ref").groupBy(*keys).agg(*[e.alias(f"_{s}{i}") for i, c in enumerate(columns) for s, e in (("m", F.avg(c)), ("s", F.stddev_pop(c)))])
    scale = lambda i: F.when(F.col(f"_s{i}") >= 1e-12, F.col(f"_s{i}")).otherwise(1.0)
    scaled = settled(rows.join(stats, keys, "left").select(*keys, "t_idx", "_ref", *[((F.col(c) - F.coalesce(f"_m{i}", F.lit(0.0))) / scale(i)).alias(c) for i, c in enumerate(columns)]))
    blocks = settled(in_blocks(scaled, before=past, after=past - 1, size=size))
    d = len(columns)

    def products(b: int, at: np.ndarray, x: np.ndarray) -> dict[str, object]:
        ref, sums = int(x[0, d]), np.zeros((2 * past * d + 1, 2 * past * d + 1))
        lo, hi = max(b * size, past), min((b + 1) * size, ref - past)
        if hi > lo:
            at0 = int(at[0])
            both = np.stack([x[i - past - at0 : i + past - at0, :d].ravel() for i in range(lo, hi)])
            both = np.column_stack([np.ones(len(both)), both])
            sums = both.T @ both
        return {"s": [sums.ravel().tolist()]}

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        s = np.sum(part["s"].tolist(), axis=0).reshape(2 * past * d + 1, -1)
        model = K.cva_model(s, past * d, k)
        return part[keys].iloc[:1].assign(_model=[None if model is None else np.concatenate([m.ravel() for m in model]).tolist()])

    models = per_block(blocks, keys, [*columns, "_ref"], products, "s array<double>").groupBy(*keys).applyInPandas(solved, f"{_types(rows, keys)}, _model array<double>")
    width = past * d
    own = blocks.where(F.floor(F.col("_at") / size) == F.col("_block")).select(*keys, "_block", F.col("_at").alias("t_idx"))
    size_of = F.size("_model")
    known = blocks.join(models.where("_model IS NOT NULL"), keys)

    def scored(part_key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at")
        model = np.asarray(part["_model"].iloc[0])
        mean, project = model[:width], model[width:].reshape(-1, width)
        at, x, b = part["_at"].to_numpy(), part[columns].to_numpy(float), int(part_key[-1])
        lo, hi = max(b * size, past), min((b + 1) * size, int(at[-1]) + 1)
        t2 = [float(((project @ (x[i - past - at[0] : i - at[0]].ravel() - mean)) ** 2).sum()) for i in range(lo, hi)]
        out = pd.DataFrame({"t_idx": np.arange(lo, max(lo, hi)), "t2": t2})
        for key, v in zip(keys, part_key[:-1], strict=True):
            out[key] = v
        return out[[*keys, "t_idx", "t2"]]

    scores = settled(known.where(size_of > 0).select(*keys, "_block", "_at", *columns, "_model").groupBy(*keys, "_block").applyInPandas(scored, f"{_types(rows, keys)}, t_idx long, t2 double"))
    limits = quantile_of(scores.join(lengths, keys).where("t_idx < _ref"), keys, "t2", alpha, "_limit")
    out = own.join(scores, [*keys, "t_idx"], "left").join(limits, keys, "left")
    return out.select(*keys, "t_idx", "t2", F.coalesce(F.col("t2") > F.col("_limit"), F.lit(False)).alias("alarm"))


def series_status(rows: DataFrame, keys: list[str], least: int, value: str = "value") -> DataFrame:
    """(keys, n, missing, status): whether kernels can take a series: `ok`, `too_short` (under `least` rows), `no_values` or `constant`."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("missing"), F.min(v).alias("_low"), F.max(v).alias("_high"))
    status = F.when(F.col("n") < least, "too_short").when(F.col("_low").isNull(), "no_values").when(F.col("_low") == F.col("_high"), "constant").otherwise("ok")
    return out.select(*keys, "n", "missing", status.alias("status"))
