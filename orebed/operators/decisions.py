"""Decisions from evidence: wind events, catalogue-guided root causes, diagnoses with reach, and ends of life with uncertainty."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.operators.diagnosis import clip, ladder
from orebed.operators.longseries import BLOCK, carried, settled

TINY = 1e-12


def run_places(rows: DataFrame, keys: list[str], flags: dict[str, Column], size: int = BLOCK) -> DataFrame:
    """(keys, t_idx, each flag's name): how many rows in a row its condition has held, 0 where it doesn't; series may be of any length."""
    names = list(flags)

    def run(x: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        out, at = {}, np.arange(len(x))
        for i, name in enumerate(names):
            off = np.maximum.accumulate(np.where(x[:, i] > 0, -1, at))
            out[name] = np.where(off >= 0, at - off, at + 1 + int(state[i]))
        return out, np.array([float(out[name][-1]) for name in names])

    flagged = rows.select(*keys, "t_idx", *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in flags.items()])
    return carried(flagged, keys, names, [0.0] * len(names), run, ", ".join(f"{n} long" for n in names), size)


def event_evidence(rows: DataFrame, keys: list[str], residual: str, drift: str, evaluable: str | None = None, outside: str | None = None, findings: DataFrame | None = None, least_run: int = 6, least_residual: float = 0.02, least_drift: float = 0.02, most_outside: float = 0.10, size: int = BLOCK) -> DataFrame:
    """A decision for each event (keys) from its rows' residual and drift alarms: `fault`, `monitor` or `abstain`, with what it rests on.

    Only evaluable rows count. A fault needs at least least_run rows in a row with both alarms, and each alarm on its share of rows; rows outside the known regimes are
    no evidence, but over most_outside of them the models aren't trusted and the decision is to abstain. findings (keys, n) are physics findings, which add a
    little to the score. first_index is where the first such run is long enough.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    use = on(evaluable) if evaluable else F.lit(True)
    flags = {"_r": use & on(residual), "_d": use & on(drift), "_b": use & on(residual) & on(drift)}
    places = run_places(rows, keys, flags, size)
    counts = rows.groupBy(*keys).agg(F.sum(use.cast("long")).alias("_n"), *[F.sum(c.cast("long")).alias(f"_n{n}") for n, c in flags.items()], F.sum((use & (on(outside) if outside else F.lit(False))).cast("long")).alias("_no"))
    runs = places.groupBy(*keys).agg(F.max("_r").alias("longest_residual"), F.max("_d").alias("longest_drift"), F.max("_b").alias("longest_both"), F.min(F.when(F.col("_b") >= max(1, least_run), F.col("t_idx"))).alias("_first"))
    out = counts.join(runs, keys)
    out = out.join(findings.select(*keys, F.col("n").alias("_f")), keys, "left") if findings is not None else out.withColumn("_f", F.lit(0))
    share = lambda c: F.col(c) / F.greatest(F.col("_n"), F.lit(1))
    out = out.withColumns({"residual_fraction": share("_n_r"), "drift_fraction": share("_n_d"), "both_fraction": share("_n_b"), "outside_fraction": share("_no"), "physics": clip(F.coalesce(F.col("_f"), F.lit(0)) / 3.0, 0.0, 1.0)})
    score = 0.25 * clip(F.col("residual_fraction") / 0.10, 0.0, 1.0) + 0.20 * clip(F.col("drift_fraction") / 0.10, 0.0, 1.0) + 0.30 * clip(F.col("both_fraction") / 0.05, 0.0, 1.0) + 0.20 * clip(F.col("longest_both") / max(1, least_run), 0.0, 1.0) + 0.05 * F.col("physics")
    sustained, burden = F.col("longest_both") >= max(1, least_run), (F.col("residual_fraction") >= least_residual) & (F.col("drift_fraction") >= least_drift)
    out = out.withColumn("score", clip(score, 0.0, 1.0)).withColumn("reason", ladder("burden_too_low", (F.col("outside_fraction") > most_outside, "outside_regimes"), (sustained & burden, "corroborated"), (~sustained, "no_sustained_run")))
    decision = F.when(F.col("reason") == "outside_regimes", "abstain").when(F.col("reason") == "corroborated", "fault").otherwise("monitor")
    sure = F.when(decision == "abstain", clip(F.col("outside_fraction") / max(most_outside, TINY), 0.0, 1.0)).when(decision == "fault", F.col("score")).otherwise(clip(1 - F.col("score"), 0.0, 1.0))
    first = F.when(decision == "fault", F.col("_first"))
    return out.select(*keys, decision.alias("decision"), "reason", "score", sure.alias("confidence"), "residual_fraction", "drift_fraction", "both_fraction", "outside_fraction", "longest_residual", "longest_drift", "longest_both", first.alias("first_index"))


#: Weights of the evidence for a variable, and what each later place of an order is worth of the one before.
BLEND, DECAY = {"generic": 0.35, "shift": 0.35, "contribution": 0.20}, 0.82


def normal_kind(kind: Column) -> Column:
    """A fault kind in the form that type scores are named by."""
    k = F.regexp_replace(F.lower(F.trim(kind)), "[- ]", "_")
    has = lambda *words: F.greatest(*[k.contains(w).cast("int") for w in (*words, words[0])]) > 0
    return F.when(has("random"), "random_variation").when(has("drift"), "slow_drift").when(has("sticking", "stiction"), "valve_sticking").when(has("constant", "fixed"), "constant_position").when(has("step"), "step").otherwise(k)


def guided_roots(scores: DataFrame, unit: str, catalogue: DataFrame, types: DataFrame | None = None, top: int = 12, threshold: float = 0.18, least_root: float = 0.08, least_margin: float = 0.035) -> DataFrame:
    """For each unit the catalogue's fault that its abnormal variables fit best, or why none is named.

    scores (unit, variable, generic, shift, contribution, onset_rank): evidence for a unit's variables, nulls where there is none; each kind is scaled by the unit's
    maximum and blended. types (unit, kind, score) is weak evidence for kinds of faults. Catalogue rows without roots and variables are left out. A fault's score is .42 of its best root,
    .24 of how many of its variables are among the top ones, .14 of their mean and .20 of its kind. The catalogue is a dimension of a few rows, which every unit is compared with.
    """
    own = Window.partitionBy(unit)
    level = lambda c: F.when(F.max(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))).over(own) > TINY, F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) / F.max(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))).over(own)).otherwise(0.0)
    onset = F.when(F.col("onset_rank").isNotNull(), F.pow(F.lit(DECAY), F.col("onset_rank") - 1))
    blended = scores.withColumn("_s", sum((w * level(F.col(c)) for c, w in BLEND.items()), F.lit(0.0)) + 0.10 * level(onset))
    ranked = blended.withColumn("_rank", F.row_number().over(own.orderBy(F.desc(F.round("_s", 12)), "variable"))).withColumn("_n", F.when(F.max("_s").over(own) > TINY, F.col("_s") / F.max("_s").over(own)).otherwise(0.0))
    units = ranked.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct("variable", "_n"))).alias("_level"), F.map_from_entries(F.collect_list(F.struct("variable", "_s"))).alias("_blend"), F.collect_set(F.when(F.col("_rank") <= top, F.col("variable"))).alias("_top"))
    if types is not None:
        units = units.join(types.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct("kind", "score"))).alias("_types")), unit, "left")
    else:
        units = units.withColumn("_types", F.lit(None).cast("map<string,double>"))
    fits = units.crossJoin(F.broadcast(catalogue.where("size(roots) > 0 OR size(affected) > 0")))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    of_roots = F.transform("roots", lambda r: F.struct(at(F.col("_level"), r).alias("s"), r.alias("r")))
    first_best = F.aggregate(of_roots, F.struct(F.lit(-1.0).alias("s"), F.lit(None).cast("string").alias("r")), lambda a, b: F.when(b["s"] > a["s"], b).otherwise(a))
    fits = fits.withColumns(
        {
            "root_score": F.coalesce(F.array_max(F.transform(of_roots, lambda x: x["s"])), F.lit(0.0)),
            "root": F.when(F.get(of_roots, F.lit(0))["s"] > 0.05, F.get("roots", F.lit(0))).otherwise(first_best["r"]),
            "overlap": F.size(F.array_intersect("_top", "affected")) / F.greatest(F.least(F.size("affected"), F.size("_top")), F.lit(1)),
            "_mean": F.when(F.size("affected") > 0, F.aggregate(F.transform("affected", lambda v: at(F.col("_level"), v)), F.lit(0.0), lambda a, b: a + b) / F.size("affected")).otherwise(0.0),
            "kind_score": F.greatest(F.coalesce(F.try_element_at("_types", normal_kind(F.col("kind"))), F.lit(0.0)), F.lit(0.0)),
        }
    )
    fits = fits.withColumn("catalogue_score", 0.42 * F.col("root_score") + 0.24 * F.col("overlap") + 0.14 * F.col("_mean") + 0.20 * F.col("kind_score"))
    order = own.orderBy(F.desc(F.round("catalogue_score", 12)), "fault_id")
    best = fits.withColumns({"_k": F.row_number().over(order), "_next": F.lead("catalogue_score").over(order)}).where("_k = 1")
    margin = F.col("catalogue_score") - F.coalesce("_next", F.lit(0.0))
    pattern = (F.col("overlap") >= 0.35) & (F.col("kind_score") >= 0.45)
    typed = F.coalesce(F.size("_types") > 0, F.lit(False))
    why = ladder(None, (F.col("catalogue_score") < threshold, "catalog_evidence_below_threshold"), (F.col("root").isNull() | ((F.col("root_score") < least_root) & ~pattern), "catalog_root_not_directly_supported"), (typed & (margin < least_margin), "ambiguous_catalog_fault_id"))
    named = F.col("abstain_reason").isNull()
    confidence = clip(0.50 * F.col("catalogue_score") + 0.35 * at(F.col("_blend"), F.col("root")) + 0.15 * F.greatest(margin, F.lit(0.0)), 0.0, 1.0)
    out = best.withColumn("abstain_reason", why).withColumn("margin", margin).withColumn("confidence", confidence)
    root = F.when(named | (F.col("abstain_reason") == "ambiguous_catalog_fault_id"), F.col("root"))
    return out.select(unit, root.alias("root_cause"), F.when(named, F.col("fault_id")).alias("fault_id"), F.when(named, F.col("label")).alias("fault_label"), "abstain_reason", "confidence", "margin", "catalogue_score", "root_score", "overlap", "kind_score")


def reached(roots: DataFrame, edges: DataFrame, unit: str, depth: int = 5) -> DataFrame:
    """(unit, node): what each unit's root acts on over its own edges (unit, cause, effect), in up to depth steps; the root too if it acts on anything."""
    step = settled(edges.select(unit, F.col("cause").alias("node"), F.col("effect").alias("_to")).distinct())
    start = roots.select(unit, F.col("root").alias("node")).distinct()
    seen = front = settled(start.join(step.select(unit, "node").distinct(), [unit, "node"], "left_semi"))
    for _ in range(depth):  # each round is written, so that plans don't nest
        front = settled(front.join(step, [unit, "node"]).select(unit, F.col("_to").alias("node")).distinct().join(seen, [unit, "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def diagnosed(ranking: DataFrame, edges: DataFrame, unit: str, catalogue: DataFrame, threshold: float = 0.35, depth: int = 5) -> DataFrame:
    """(unit, root, fault_label, confidence, abstain_reason, n_affected): the best root of each unit (unit, variable, score), what it reaches, and the catalogue's best pattern for both.

    A pattern scores 1 for its first root and the share of its variables that are reached; the first of equals counts, and none under a score over 0. Confidence is .75 of the root's score and .25 of half the pattern's.
    """
    best = ranking.groupBy(unit).agg(F.max_by(F.struct(F.col("variable").alias("root"), "score"), F.struct(F.round("score", 12).alias("s"), F.col("variable").alias("v"))).alias("_b")).select(unit, "_b.root", F.col("_b.score").alias("_s"))
    nodes = reached(best, edges, unit, depth).groupBy(unit).agg(F.collect_set("node").alias("_nodes"))
    met = best.join(nodes, unit, "left").withColumn("_nodes", F.coalesce("_nodes", F.array().cast("array<string>")))
    fits = met.crossJoin(F.broadcast(catalogue.select("fault_id", "label", "roots", "affected")))
    score = F.when(F.get("roots", F.lit(0)) == F.col("root"), 1.0).otherwise(0.0) + F.when(F.size("affected") > 0, F.size(F.array_intersect("affected", "_nodes")) / F.size("affected")).otherwise(0.0)
    top = fits.withColumn("_fit", score).groupBy(unit).agg(F.max_by(F.struct("label", "_fit"), F.struct(F.round("_fit", 12).alias("s"), (-F.col("fault_id")).alias("i"))).alias("_t"))
    out = met.join(top, unit, "left")
    base = clip(F.col("_s"), 0.0, 1.0)
    known = F.coalesce(F.col("_t._fit") > 0, F.lit(False))
    sure = F.when(known, clip(0.75 * base + 0.25 * F.least(F.col("_t._fit") / 2, F.lit(1.0)), 0.0, 1.0)).otherwise(base)
    label = F.when(known, F.col("_t.label")).otherwise(F.concat(F.lit("Process anomaly rooted at "), F.col("root")))
    weak = sure < threshold
    return out.select(unit, F.when(~weak, F.col("root")).alias("root"), F.when(~weak, label).alias("fault_label"), sure.alias("confidence"), F.when(weak, "root_cause_evidence_below_threshold").alias("abstain_reason"), F.size(F.array_except("_nodes", F.array("root"))).alias("n_affected"))


class _Line:
    """Running sums of a line of y over x, in the order and with the rounding of SQL's regr_slope and regr_intercept: which of two figures an end takes that lies between them is decided by these."""

    def __init__(self) -> None:
        self.n, self.sx, self.sy, self.mx, self.my, self.co, self.var = 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0

    def add(self, x: float | None, y: float | None) -> None:
        if x is None or y is None:
            return
        self.n += 1
        dx = x - self.mx
        self.mx += dx / self.n
        self.my += (y - self.my) / self.n
        self.sx, self.sy = self.sx + x, self.sy + y
        self.co, self.var = _fma(dx, y - self.my, self.co), _fma(dx, x - self.mx, self.var)

    def ends(self) -> tuple[float | None, float | None]:
        if not self.var:
            return None, None
        slope = self.co / self.n / (self.var / self.n)
        return slope, _fma(-slope, self.sx / self.n, self.sy / self.n)


def _fma(a: float, b: float, c: float) -> float:
    try:
        return math.fma(a, b, c)
    except (ValueError, OverflowError):  # of infinite values
        return a * b + c


def latest_lines(rows: DataFrame, keys: list[str], x: str, y: str, widths: list[int]) -> DataFrame:
    """(keys, _m0, _c0, _m1, ...): slope and intercept of the lines through the last n rows, for each of widths, and through all; null where x doesn't vary. Rows without y count, but lie on no line.

    Rows stream by in order; a task holds the sums of one line and the last of its rows, so that a series may be of any length.
    """
    kinds = [f"_{s}{i} double" for i in range(len(widths) + 1) for s in "mc"]
    ids = [f"_k{i}" for i in range(len(keys))]
    head = [f"{i} {rows.schema[k].dataType.simpleString()}" for i, k in zip(ids, keys, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        whole, last = _Line(), deque(maxlen=max(widths))
        for batch in batches:
            done: list[tuple[tuple, list[float | None]]] = []
            *of, xs, ys = (c.to_pylist() for c in batch.columns)
            for key, at, value in zip(zip(*of, strict=True), xs, ys, strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, ends(whole, last)))
                    now, whole = key, _Line()
                    last.clear()
                last.append((at, value))
                whole.add(at, value)
            if done:
                yield made(done, batch.schema)
            schema = batch.schema
        if now is not None:
            yield made([(now, ends(whole, last))], schema)

    def ends(whole: _Line, last: deque[tuple[float | None, float | None]]) -> list[float | None]:
        out, recent = [], list(last)
        for n in widths:
            line = _Line()
            for at, value in recent[-n:]:
                line.add(at, value)
            out += line.ends()
        return [*out, *whole.ends()]

    def made(done: list[tuple[tuple, list[float | None]]], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*(k for k, _ in done), strict=True))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.float64()) for c in zip(*(v for _, v in done), strict=True))], names=[*ids, *(k.split()[0] for k in kinds)])

    sent = rows.select(*[F.col(k).alias(i) for i, k in zip(ids, keys, strict=True)], F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    found = sent.repartition(*ids).sortWithinPartitions(*ids, "_x").mapInArrow(run, ", ".join(head + kinds))
    return found.withColumnsRenamed(dict(zip(ids, keys, strict=True)))


def life_interval(df: DataFrame, keys: list[str], limit: float, nominal: float, least: int = 20, window: int = 20, widths: tuple[int, ...] = (20, 40), horizon: float = 500.0, z: float = 1.96, x: str = "t_idx", raw: str = "value", smooth: str = "smooth") -> DataFrame:
    """Per key: state, the projected end of life with its interval, and what it is made of, from capacities (x, raw, smooth; nulls are missing readings).

    The end is where the line through the last `window` smoothed values crosses the limit. Its variance is the delta method's, from the raw values' scatter about that
    line; lines through the last `widths` values and through all of them that cross within the horizon widen the interval. A last reading that is missing, a short history, a
    line that doesn't fall and a crossing outside the horizon are reasons to abstain.
    """
    w = Window.partitionBy(*keys)
    window = max(3, window)
    fine = df.where(F.col(raw).isNotNull()).withColumns({"_back": F.row_number().over(w.orderBy(F.desc(x))), "_x": F.col(x).cast("double"), "_y": F.col(smooth), "_before": F.lag(F.col(x).cast("double")).over(w.orderBy(x))})
    g = fine.groupBy(*keys).agg(F.count(F.lit(1)).alias("cycles"), F.max("_x").alias("_now"), F.max_by("_y", "_x").alias("_level"), F.min(F.when(F.col("_y") <= limit, F.struct("_x", "_before"))).alias("_crossed"))
    g = g.join(latest_lines(df.where(F.col(raw).isNotNull()), keys, x, smooth, [window, *widths]), keys, "left")
    ends = df.groupBy(*keys).agg(F.max_by(F.col(raw).isNull(), x).alias("_gone"))
    g = ends.join(g, keys, "left").withColumn("cycles", F.coalesce("cycles", F.lit(0).cast("long"))).withColumn("_eol", F.try_divide(F.lit(limit) - F.col("_c0"), F.col("_m0")))
    off = fine.where(F.col("_back") <= window).join(g.select(*keys, "_m0", "_c0"), keys)
    sums = off.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_x").alias("_sx"), F.sum(F.col("_x") * F.col("_x")).alias("_sxx"), F.sum(F.pow(F.col(raw) - F.col("_m0") * F.col("_x") - F.col("_c0"), F.lit(2.0))).alias("_rss"))
    g = g.join(sums, keys, "left")
    state = ladder(
        "projected",
        (F.col("_gone"), "latest_capacity_missing"),
        (F.col("cycles") < least, "insufficient_history"),
        ((F.col("_level") <= limit) & F.col("_crossed._before").isNull(), "left_censored_crossing"),
        (F.col("_level") <= limit, "observed_crossing"),
        (F.coalesce(F.col("_m0") >= -1e-5, F.lit(True)), "non_degrading_or_unstable_slope"),
        ((F.col("_eol") < F.col("_now")) | (F.col("_eol") - F.col("_now") > horizon), "projection_outside_credible_horizon"),
    )
    g = g.withColumn("state", state)
    g1, g2, det = F.try_divide(-F.col("_eol"), F.col("_m0")), F.try_divide(F.lit(-1.0), F.col("_m0")), F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    variance = F.try_divide(F.col("_rss") / F.greatest(F.col("_n") - 2, F.lit(1.0)) * (g1 * g1 * F.col("_n") - 2 * g1 * g2 * F.col("_sx") + g2 * g2 * F.col("_sxx")), det)
    crossing = lambda i: F.when(F.col(f"_m{i}") < -1e-5, F.try_divide(F.lit(limit) - F.col(f"_c{i}"), F.col(f"_m{i}")))
    within = lambda e: F.when((e >= F.col("_now")) & (e - F.col("_now") <= horizon), e)
    others = [within(crossing(i)) for i in range(1, len(widths) + 2)]
    g = g.withColumns({"_u": z * F.sqrt(F.greatest(F.coalesce(variance, F.lit(0.0)), F.lit(0.0))), "_low": F.coalesce(F.least(*others), F.col("_eol")), "_high": F.coalesce(F.greatest(*others), F.col("_eol"))})
    seen = F.col("state").isin("observed_crossing", "left_censored_crossing")
    ahead = F.col("state") == "projected"
    pick = lambda a, b: F.when(seen, a).when(ahead, b)
    before = F.coalesce(F.col("_crossed._before"), F.lit(0.0))
    low, high = F.greatest(F.col("_now"), F.least(F.col("_eol") - F.col("_u"), F.col("_low"))), F.greatest(F.col("_eol") + F.col("_u"), F.col("_high"))
    g = g.withColumns({"eol": pick(F.col("_crossed._x"), F.col("_eol")), "eol_low": pick(before, low), "eol_high": pick(F.col("_crossed._x"), high)})
    return g.select(
        *keys,
        "cycles",
        "state",
        "eol",
        "eol_low",
        "eol_high",
        pick(F.lit(0.0), F.col("eol") - F.col("_now")).alias("remaining"),
        pick(F.col("eol_high") - F.col("eol_low"), F.greatest(F.col("eol") - F.col("eol_low"), F.col("eol_high") - F.col("eol"))).alias("uncertainty"),
        pick(F.lit(0.0), F.col("_u")).alias("line_uncertainty"),
        pick(F.lit(0.0), F.greatest(F.abs(F.col("_eol") - F.col("_low")), F.abs(F.col("_high") - F.col("_eol")))).alias("disagreement"),
        pick(F.lit(1.0), clip(1 - F.greatest(F.col("_level") - limit, F.lit(0.0)) / max(nominal - limit, 1e-6), 0.0, 1.0)).alias("risk"),
    )
