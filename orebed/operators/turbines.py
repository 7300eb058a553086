"""Wind turbines by the names of their channels: roles of channels, and readings held against physical bounds.

Readings are long (unit, sample, channel, value) or lie in rows of several (unit, sample, channels, values), and channels are a table (unit, channel, name), so farms that name or number
their channels differently go through one plan. Of few units no one's readings are gathered: quantiles are picked by place, readings meet the table of channels where they lie, samples are formed once and written to the checkpoint folder.
Of more than MANY units readings are dealt by unit, once, and a task holds those of one; units of over LARGEST rows go as those of few do.
Values that are null or not finite count as missing; a missing value violates no bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.operators.longseries import binned_quantile_of, few, settled
from orebed.operators.series import finite

# What the name of a channel must hold to play a role, first choices first.
ROLES = {
    "ambient": (("ambient", "temp"), ("outside", "temp"), ("air", "temp")),
    "rotor": (("rotor", "speed"), ("rotation", "speed"), ("rotor", "rpm")),
    "torque": (("generator", "torque"), ("torque",)),
    "wind": (("wind", "speed"),),
    "pitch": (("pitch",), ("blade", "angle")),
    "generator": (("generator", "speed"), ("generator", "rpm"), ("rotor", "speed")),
    "power": (("active", "power"), ("real", "power"), ("electrical", "power"), ("generator", "power"), ("power",)),
}
# Offset, degrees for a unit of torque and of rotor speed that a part may be above the ambient temperature.
DISSIPATION = {"bearing": (2.0, 0.15, 0.30), "gearbox": (5.0, 0.18, 0.35), "generator": (8.0, 0.22, 0.40)}
#: Units from which on readings are dealt by unit, as all tasks have some then.
MANY = 500
#: Rows of a unit that a task gathers at most.
LARGEST = 500_000
FLAGS = [("power_exceeds_aerodynamic_limit", "electrical"), ("possible_unannounced_curtailment_or_electrical_loss", "electrical"), *(("temperature_above_steady_state_dissipation_bound", part) for part in DISSIPATION)]


@dataclass(frozen=True)
class Bounds:
    """Fixed limits of a turbine. area (m2) and rated (kW) are its own: without area the aerodynamic limit is not checked, without rated it is the reference's 99.5 % quantile of power."""

    density: float = 1.225
    area: float | None = None
    rated: float | None = None
    coefficient: float = 0.59
    tolerance: float = 0.20
    curtailed: float = 0.55
    pitch: float = 8.0
    active: float = 0.10
    margin: float = 12.0
    least: int = 8


def _holds(name: Column, tokens: tuple[str, ...]) -> Column:
    found = F.lit(True)
    for token in tokens:
        found = found & name.contains(token)
    return found


def channel_roles(channels: DataFrame, unit: str) -> DataFrame:
    """(unit, one column for each role with its channel, null if none plays it): by first choice of words, then by channel.

    Power is never read from a reactive channel, and from an apparent one only where its name says what power it is.
    A null name plays no role; repeated rows change nothing.
    """
    name = F.lower("name")
    chosen = []
    for role, choices in ROLES.items():
        rank = F.lit(None).cast("int")
        for i, tokens in reversed(list(enumerate(choices))):
            holds = _holds(name, tokens)
            if role == "power":
                holds = holds & ~name.contains("reactive")
                if tokens == ("power",):
                    holds = holds & ~name.contains("apparent")
            rank = F.when(holds, i).otherwise(rank)
        chosen.append(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("channel").alias("channel"))))["channel"].alias(role))
    return channels.groupBy(unit).agg(*chosen)


def subsystem(name: Column) -> Column:
    """The part of a turbine that a channel's name speaks of."""
    low = F.lower(name)
    says = lambda *words: F.coalesce(F.greatest(F.lit(False), *[low.contains(w) for w in words]), F.lit(False))
    out = F.lit("turbine")
    for part, words in reversed([("gearbox", ("gear", "sump")), ("bearing", ("bearing",)), ("generator", ("generator", "winding")), ("pitch_system", ("pitch", "blade")), ("electrical", ("power", "converter", "current", "voltage"))]):
        out = F.when(says(*words), part).otherwise(out)
    return out


def _named(channels: DataFrame, roles: DataFrame, unit: str) -> DataFrame:
    """(unit, channel, _plays, _part): named channels with the roles that they play, as bits, and the heated part that they are of."""
    named = channels.groupBy(unit, "channel").agg(F.min("name").alias("_name")).join(roles, unit)
    part = subsystem(F.col("_name"))
    heated = F.lower("_name").contains("temp") & part.isin(*DISSIPATION)
    plays = sum((F.when(F.col("channel") == F.col(r), 1 << i).otherwise(0) for i, r in enumerate(ROLES)), F.lit(0))
    return named.select(unit, "channel", plays.alias("_plays"), F.when(heated, part).alias("_part"))


def _known(readings: DataFrame, channels: DataFrame, roles: DataFrame, unit: str, sample: str) -> DataFrame:
    """(unit, sample, channel, _v, _plays, _part): readings of named channels."""
    return readings.select(unit, sample, "channel", finite("value").alias("_v")).join(few(_named(channels, roles, unit)), [unit, "channel"])


def _long(readings: DataFrame, unit: str, sample: str) -> DataFrame:
    """Readings in rows of their own."""
    if "channels" not in readings.columns:
        return readings
    return readings.select(unit, sample, F.explode(F.arrays_zip("channels", "values")).alias("_r")).select(unit, sample, F.col("_r.channels").alias("channel"), F.col("_r.values").alias("value"))


def _samples(known: DataFrame, unit: str, sample: str) -> DataFrame:
    """One row for each sample: its value in every role."""
    return known.groupBy(unit, sample).agg(*[F.max(F.when(F.col("_plays").bitwiseAND(1 << i) != 0, F.col("_v"))).alias(f"_{r}") for i, r in enumerate(ROLES)])


def wind_findings(readings: DataFrame, channels: DataFrame, unit: str, sample: str, reference: DataFrame | None = None, bounds: Bounds = Bounds()) -> DataFrame:
    """(unit, flag, subsystem, channel, violations, violation_fraction, p90, severity): bounds that at least bounds.least samples of a unit break.

    power_exceeds_aerodynamic_limit: power over what wind and rotor can give, and over rated power, with tolerance (p90 is of their ratio).
    possible_unannounced_curtailment_or_electrical_loss: little power though wind is in its upper 30 %, the generator turns and blades are not pitched (p90 is of
    the share that lacks). temperature_above_steady_state_dissipation_bound: a heated part over ambient temperature, torque and speed (p90 is of the degrees above).
    Fractions are of all samples of the unit; severity is from 1 to 5. reference (else the readings) has the quantiles of normal operation.
    A unit without wind or power channel, or without ambient, rotor and torque ones, has no findings of that kind. Empty readings give no rows.
    """
    roles = settled(channel_roles(channels, unit))
    frames = [readings] if reference is None else [readings, reference]
    if roles.count() <= MANY:
        found = _found_where_they_lie(*[_long(x, unit, sample) for x in frames], channels=channels, roles=roles, unit=unit, sample=sample, bounds=bounds)
    else:
        sizes = [x.groupBy(unit).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGEST).select(unit) for x in frames]
        large = settled(reduce(DataFrame.unionByName, sizes).distinct())
        found = None
        if not large.isEmpty():
            mine = lambda x, how: x.join(F.broadcast(large), unit, how)  # noqa: E731 of LARGEST rows each, so they are few
            found = _found_where_they_lie(*[_long(mine(x, "left_semi"), unit, sample) for x in frames], channels=mine(channels, "left_semi"), roles=mine(roles, "left_semi"), unit=unit, sample=sample, bounds=bounds)
            frames, channels, roles = [mine(x, "left_anti") for x in frames], mine(channels, "left_anti"), mine(roles, "left_anti")
        dealt = _found_by_unit(frames, _named(channels, roles, unit), unit, sample, bounds)
        found = dealt if found is None else found.unionByName(dealt)
    flag, part = (F.element_at(F.array(*[F.lit(k[j]) for k in FLAGS]), F.col("_f") + 1) for j in (0, 1))
    raw = F.when(F.col("flag").startswith("temperature"), 1.0 + F.col("p90") / max(bounds.margin, 1e-6)).when(F.col("flag").startswith("possible"), F.col("p90") * 3.0).otherwise(F.col("p90"))
    severity = F.greatest(F.lit(1.0), F.least(F.lit(5.0), raw))
    found = found.withColumns({"flag": flag, "subsystem": part})
    return found.select(unit, "flag", "subsystem", "channel", "violations", (F.col("violations") / F.col("_n")).alias("violation_fraction"), "p90", severity.alias("severity"))


def _found_where_they_lie(readings: DataFrame, reference: DataFrame | None = None, *, channels: DataFrame, roles: DataFrame, unit: str, sample: str, bounds: Bounds) -> DataFrame:
    """(unit, _f, channel, violations, p90, _n): findings by places and joins of all readings."""
    known = _known(readings, channels, roles, unit, sample)
    rows = samples = settled(_samples(known, unit, sample))
    normal = samples if reference is None else settled(_samples(_known(reference, channels, roles, unit, sample), unit, sample))
    kinds = {"rated": (F.col("_power"), 0.995), "turning": (F.abs("_generator"), 0.95), "windy": (F.col("_wind"), 0.70)}
    long = normal.select(unit, F.explode(F.array(*[F.struct(F.lit(k).alias("_kind"), v.alias("_x")) for k, (v, _) in enumerate(kinds.values())])).alias("_k")).select(unit, "_k.*")
    at = F.lit(0.0)
    for kind, (_, q) in enumerate(kinds.values()):
        at = F.when(F.col("_kind") == kind, q).otherwise(at)
    limits = binned_quantile_of(long, [unit, "_kind"], "_x", at, "_q").groupBy(unit).agg(*[F.max(F.when(F.col("_kind") == i, F.col("_q"))).alias(f"_{k}") for i, k in enumerate(kinds)])
    limits = few(roles.select(unit, F.col("power").alias("_pc"), F.col("generator").alias("_gc"), F.col("pitch").alias("_tc")).join(limits, unit, "left"))
    rows = rows.join(limits, unit)

    wind, power = F.col("_wind"), F.col("_power")
    rated = F.col("_rated") if bounds.rated is None else F.lit(bounds.rated)
    none = F.lit(None).cast("double")
    upper = none
    if bounds.area is not None:
        upper = 0.5 * bounds.density * bounds.area * bounds.coefficient * F.pow(F.greatest(wind, F.lit(0.0)), F.lit(3.0)) / 1000.0 * (1.0 + bounds.tolerance)
        upper = F.when(wind.isNotNull(), F.when(rated > 0, F.least(upper, rated * (1.0 + bounds.tolerance))).otherwise(upper))
    over = F.when((power > upper) & (wind > 2.0), power / F.greatest(upper, F.lit(1e-6)))
    turns = F.col("_gc").isNull() | (F.abs("_generator") > F.coalesce(bounds.active * F.col("_turning"), F.lit(0.0)))
    flat = F.col("_tc").isNull() | (F.abs("_pitch") < bounds.pitch)
    lost = F.when((rated > 0) & (power < bounds.curtailed * rated) & (wind >= F.col("_windy")) & turns & flat, (rated - power) / rated)

    electrical = rows.select(unit, F.explode(F.array(*[F.struct(F.lit(i).alias("_f"), F.col("_pc").alias("channel"), x.alias("_x")) for i, x in enumerate((over, lost))])).alias("_b")).select(unit, "_b.*")
    room, code = none, F.lit(None).cast("int")
    for i, (part, (offset, torque, speed)) in enumerate(DISSIPATION.items(), 2):
        room = F.when(F.col("_part") == part, offset + torque * F.abs("_torque") + speed * F.abs("_rotor")).otherwise(room)
        code = F.when(F.col("_part") == part, i).otherwise(code)
    hot = known.where("_part IS NOT NULL AND _v IS NOT NULL").select(unit, F.col(sample).alias("_s"), "channel", "_part", "_v")
    near = samples.where("_ambient IS NOT NULL AND _torque IS NOT NULL AND _rotor IS NOT NULL").select(F.col(unit).alias("_u"), sample, "_ambient", "_torque", "_rotor")
    heat = hot.join(near, (F.col(unit) == F.col("_u")) & F.col("_s").eqNullSafe(F.col(sample))).select(unit, code.alias("_f"), "channel", (F.col("_v") - (F.col("_ambient") + room + bounds.margin)).alias("_x"))
    keys = [unit, "_f", "channel"]
    broken = settled(electrical.unionByName(heat).where("_x > 0"))
    counts = few(broken.groupBy(*keys).agg(F.count(F.lit(1)).alias("violations")).where(F.col("violations") >= bounds.least))
    sizes = samples.groupBy(unit).agg(F.count(F.lit(1)).alias("_n"))
    p90 = binned_quantile_of(broken.join(counts, keys, "left_semi"), keys, "_x", 0.9, "p90")
    return counts.join(p90, keys).join(sizes, unit).select(*keys, "violations", "p90", "_n")


def _quantile(x: np.ndarray, q: float) -> float:
    """Of the values that are there, between the two next to the place; NaN without any."""
    x = x[~np.isnan(x)]
    if not len(x):
        return np.nan
    at = (len(x) - 1) * q
    low, high = int(np.floor(at)), int(np.ceil(at))
    x = np.partition(x, (low, high))
    return float(x[low] + (x[high] - x[low]) * (at - low))


def _unit_samples(rows: pa.Table, known: pa.Array, plays: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A unit's samples by role, and for each reading of a known channel its sample, channel (a place in known) and value. rows (sample, channels, values)."""
    lists = rows.column("_channels").combine_chunks(), rows.column("_values").combine_chunks()
    names = rows.column("_sample").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    of = np.repeat(names, pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(np.int64))
    at = pc.index_in(lists[0].flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
    v = lists[1].flatten().to_numpy(zero_copy_only=False).astype(float)
    of, at, v = of[at >= 0], at[at >= 0], v[at >= 0]
    v = np.where(np.isfinite(v), v, np.nan)
    there, of = np.unique(of, return_inverse=True)
    roles = {}
    for i, role in enumerate(ROLES):
        roles[role] = np.full(len(there), np.nan)
        mine = (plays[at] >> i) & 1 == 1
        np.fmax.at(roles[role], of[mine], v[mine])
    return roles, of, at, v


def _unit_findings(known: pa.Array, plays: np.ndarray, part: np.ndarray, readings: pa.Table, reference: pa.Table | None, bounds: Bounds) -> Iterator[tuple[int, object, int, float, int]]:
    """(_f, channel, violations, p90, samples) of a unit; part is a channel's place in DISSIPATION, -1 if it is of no heated part."""
    x, of, at, v = _unit_samples(readings, known, plays)
    normal = x if reference is None else _unit_samples(reference, known, plays)[0]
    first = {role: next(iter(known.filter(pa.array((plays >> i) & 1 == 1)).to_pylist()), None) for i, role in enumerate(ROLES)}
    wind, power = x["wind"], x["power"]
    rated = bounds.rated if bounds.rated is not None else _quantile(normal["power"], 0.995)
    turning, windy = _quantile(np.abs(normal["generator"]), 0.95), _quantile(normal["wind"], 0.70)
    broken: list[tuple[int, object, np.ndarray]] = []
    if bounds.area is not None:
        low = np.maximum(wind, 0.0)
        upper = 0.5 * bounds.density * bounds.area * bounds.coefficient * (low * low * low) / 1000.0 * (1.0 + bounds.tolerance)
        upper = np.minimum(upper, rated * (1.0 + bounds.tolerance)) if rated > 0 else upper
        over = (power > upper) & (wind > 2.0)
        broken.append((0, first["power"], power[over] / np.maximum(upper[over], 1e-6)))
    if rated > 0:
        lost = (power < bounds.curtailed * rated) & (wind >= windy)
        if first["generator"] is not None:
            lost &= np.abs(x["generator"]) > (0.0 if np.isnan(turning) else bounds.active * turning)
        if first["pitch"] is not None:
            lost &= np.abs(x["pitch"]) < bounds.pitch
        broken.append((1, first["power"], (rated - power[lost]) / rated))
    for i, (offset, torque, speed) in enumerate(DISSIPATION.values()):
        for c in np.flatnonzero(part == i).tolist():
            mine = at == c
            s = of[mine]
            room = offset + torque * np.abs(x["torque"][s]) + speed * np.abs(x["rotor"][s])
            broken.append((2 + i, known[c].as_py(), v[mine] - (x["ambient"][s] + room + bounds.margin)))
    for f, channel, values in broken:
        values = values[values > 0]
        if len(values) >= max(bounds.least, 1):
            yield f, channel, len(values), _quantile(values, 0.9), len(wind)


def _found_by_unit(frames: list[DataFrame], named: DataFrame, unit: str, sample: str, bounds: Bounds) -> DataFrame:
    """(unit, _f, channel, violations, p90, _n): findings of units whose rows a task can hold. frames: readings, and the reference if there is one."""
    code = F.lit(-1)
    for i, part in enumerate(DISSIPATION):
        code = F.when(F.col("_part") == part, i).otherwise(code)
    bits, most = len(ROLES), len(frames)
    what = F.array_sort(F.collect_list(F.struct("channel", (F.col("_plays") + (code + 1) * (1 << bits)).cast("double").alias("_what"))))
    kind = frames[0].schema[sample].dataType
    rows = named.where(F.col(unit).isNotNull()).groupBy(unit).agg(what.alias("_c")).select(unit, F.lit(0).alias("_of"), F.lit(None).cast(kind).alias("_sample"), F.col("_c.channel").alias("_channels"), F.col("_c._what").alias("_values"))
    for i, x in enumerate(frames, 1):
        lists = (F.col("channels"), F.col("values")) if "channels" in x.columns else (F.array("channel"), F.array("value"))
        rows = rows.unionByName(x.where(F.col(unit).isNotNull()).select(unit, F.lit(i).alias("_of"), F.col(sample).cast(kind).alias("_sample"), lists[0].alias("_channels"), lists[1].cast("array<double>").alias("_values")))

    def unit_rows(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held)
        of = table.column("_of").to_numpy()
        if of[0] != 0:
            return None  # none of its channels has a name
        know, what = table.column("_channels")[0].values, np.array(table.column("_values")[0].values, dtype=np.int64)
        mine = [table.filter(pa.array(of == i)) for i in range(1, most + 1)]
        if not mine[0].num_rows:
            return None
        got = list(_unit_findings(know, what & ((1 << bits) - 1), (what >> bits) - 1, mine[0], mine[1] if len(mine) > 1 else None, bounds))
        if not got:
            return None
        f, channel, n, p90, size = zip(*got, strict=True)
        units = table.column(0).combine_chunks().take(pa.array([0] * len(got), pa.int64()))
        return pa.RecordBatch.from_arrays([units, pa.array(f, pa.int32()), pa.array(channel, know.type), pa.array(n, pa.int64()), pa.array(p90, pa.float64()), pa.array(size, pa.int64())], names=[unit, "_f", "channel", "violations", "p90", "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if held and held[0].column(0)[0] != part.column(0)[0]:
                    if (out := unit_rows(held)) is not None:
                        yield out
                    held.clear()
                held.append(part)
        if held and (out := unit_rows(held)) is not None:
            yield out

    schema = f"`{unit}` {named.schema[unit].dataType.simpleString()}, _f int, channel {named.schema['channel'].dataType.simpleString()}, violations long, p90 double, _n long"
    return rows.repartition(unit).sortWithinPartitions(unit, "_of").mapInArrow(run, schema)


def wind_physics(units: DataFrame, findings: DataFrame, unit: str) -> DataFrame:
    """(unit, physics_consistent, max_severity, ranked_subsystems): each unit's verdict; parts by their worst finding, equal ones as electrical, then by channel."""
    parts = findings.groupBy(unit, "subsystem").agg(F.max("severity").alias("_s"), F.min("channel").alias("_c"))
    order = Window.partitionBy(unit).orderBy(F.desc(F.round("_s", 9)), F.col("subsystem") != "electrical", "_c")
    placed = parts.withColumn("_place", F.row_number().over(order))
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("_place", "subsystem"))), lambda x: x["subsystem"])
    g = placed.groupBy(unit).agg(F.max("_s").alias("_max"), ranked.alias("_ranked"))
    empty = F.array().cast("array<string>")
    return units.select(unit).distinct().join(g, unit, "left").select(unit, F.col("_max").isNull().alias("physics_consistent"), F.coalesce("_max", F.lit(0.0)).alias("max_severity"), F.coalesce("_ranked", empty).alias("ranked_subsystems"))
