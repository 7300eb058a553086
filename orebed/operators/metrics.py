"""Evaluation metrics, calibration, triage, routing and sampling, as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.operators.longseries import placed


def ratio(a: Column, b: Column) -> Column:
    """a over b, null where b is 0."""
    return F.when(b != 0, a / b)


def binary_metrics(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and the rates of false positives and negatives, for 0/1 columns."""
    n = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(predicted) == p))
    g = df.groupBy(*(by or [])).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    c = F.col
    g = g.withColumn("precision", ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", ratio(c("tp"), c("tp") + c("fn")))
    return g.withColumn("f1", ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))).withColumn("fpr", ratio(c("fp"), c("fp") + c("tn"))).withColumn("fnr", ratio(c("fn"), c("fn") + c("tp")))


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Positives and negatives of each distinct score: curves are cumulative over these, not over rows."""
    return df.groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))


def running(df: DataFrame, by: str, sums: dict[str, Column], bins: int = 200) -> DataFrame:
    """df with the sums of all rows up to each in the order of by (distinct values): within bins of by, and on top of the bins before.

    Bin borders are quantiles of by, so no task gets a large part of the rows; only the bins' totals meet in one.
    """
    cuts = df.select(F.percentile_approx(by, F.array(*[F.lit(i / bins) for i in range(1, bins)]), 10 * bins)).first()[0] or []  # bins borders
    bin_ = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(by))) if cuts else F.lit(0)
    rows = df.withColumn("_bin", bin_)
    totals = rows.groupBy("_bin").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    w = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    before = totals.select("_bin", *[F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)).alias(f"_{n}") for n in sums])
    own = Window.partitionBy("_bin").orderBy(by)
    return rows.join(F.broadcast(before), "_bin").select(*df.columns, *[(F.sum(c).over(own) + F.col(f"_{n}")).alias(n) for n, c in sums.items()])


def auroc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve: chance that a positive outscores a negative, ties counting half."""
    s = running(_by_score(df, truth, score), score, {"seen": F.col("neg")})
    s = s.select("pos", "neg", (F.col("pos") * (F.col("seen") - F.col("neg") / 2)).alias("wins"))
    return s.agg(F.sum("wins").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(ratio(F.col("w"), F.col("p") * F.col("n")).alias("auroc"))


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Sum over thresholds of precision times the gain in recall."""
    s = running(_by_score(df, truth, score).withColumn("_down", -F.col(score)), "_down", {"tp": F.col("pos"), "seen": F.col("pos") + F.col("neg")})
    return s.agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("a"), F.sum("pos").alias("p")).select(ratio(F.col("a"), F.col("p")).alias("average_precision"))


def calibration_bins(df: DataFrame, truth: str, prob: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last closed: rows, mean probability, positive rate."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("confidence"), F.avg(F.col(truth).cast("double")).alias("accuracy"))


def calibration_error(df: DataFrame, truth: str, prob: str, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score."""
    e = calibration_bins(df, truth, prob, bins).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))
    return e.join(F.broadcast(df.agg(F.avg(F.pow(F.col(prob) - F.col(truth), F.lit(2.0))).alias("brier"))))  # one row each


def triage(df: DataFrame, truth: str, decision: str) -> DataFrame:
    """Release, intervene, review and abstain: coverage, unsafe releases, precision and recall of intervention; null on zero denominators."""
    n = lambda cond: F.count_if(cond)
    d, y = F.col(decision), F.col(truth)
    g = df.agg(F.count(F.lit(1)).alias("n"), n(d == "release").alias("released"), n(d == "intervene").alias("intervened"), n(d.isin("review", "abstain")).alias("deferred"), n((d == "release") & (y == 1)).alias("unsafe"), n((d == "intervene") & (y == 1)).alias("caught"), n(y == 1).alias("bad"))
    c = F.col
    return g.select("n", "released", "intervened", "deferred", ratio(c("n") - c("deferred"), c("n")).alias("coverage"), ratio(c("unsafe"), c("released")).alias("unsafe_rate"), ratio(c("caught"), c("intervened")).alias("precision"), ratio(c("caught"), c("bad")).alias("recall"))


def routing(df: DataFrame, truth: str, prob: str, tau1: float, tau2: float) -> DataFrame:
    """Rows below tau1 (fast), below tau2 (lightweight) and the rest (agentic): count, share, positive rate."""
    route = F.when(F.col(prob) < tau1, "fast").when(F.col(prob) < tau2, "lightweight").otherwise("agentic")
    g = df.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(truth).cast("double")).alias("positive_rate"))
    return g.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))  # three rows


def threshold_sweep(df: DataFrame, truth: str, score: str, grid: list[float]) -> DataFrame:
    """Precision, recall and released share at each threshold; scores are counted by grid cell first, so that rows aren't multiplied by the grid."""
    cuts = sorted(grid)
    cell = F.lit(0)
    for t in cuts:
        cell = cell + (F.col(score) >= t).cast("int")
    cells = df.groupBy(cell.alias("cell")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("cell"))
    at = cells.select("cell", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("flagged"), F.sum("pos").over(Window.partitionBy()).alias("p"))
    rows = at.where("cell > 0").withColumn("threshold", F.element_at(F.array(*[F.lit(t) for t in cuts]), F.col("cell")))
    return rows.select("threshold", "flagged", ratio(F.col("tp"), F.col("flagged")).alias("precision"), ratio(F.col("tp"), F.col("p")).alias("recall"))


def confusion_cube(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of each pair with all marginals (null: all)."""
    return df.cube(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1) of every label that occurs on either side, 0 where undefined."""
    t, p = df.groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(truth) == F.col(predicted)).alias("tp")), df.groupBy(F.col(predicted).alias("label")).agg(F.count(F.lit(1)).alias("p"))
    j = t.join(p, "label", "full").na.fill(0, ["t", "p", "tp"])
    z = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return j.select("label", z(F.col("tp"), F.col("p")).alias("precision"), z(F.col("tp"), F.col("t")).alias("recall"), z(2 * F.col("tp"), F.col("t") + F.col("p")).alias("f1"))


def stratified_quota(df: DataFrame, label: str, id_col: str, total: int, key: Column) -> DataFrame:
    """(label, id): total rows by each label's share (floors), lowest key first; map-side limited windows."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    n = sizes.agg(F.sum("_c").alias("_n"))
    quota = sizes.join(F.broadcast(n)).select(label, F.floor(F.col("_c") * total / F.col("_n")).cast("int").alias("_q"))  # one row
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(key, id_col))).where(F.col("_r") <= total)
    return ranked.join(F.broadcast(quota), label).where("_r <= _q").select(label, id_col)  # one row for each label


def group_folds(groups: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): round-robin over sorted distinct groups."""
    some = groups.select(group).distinct().select(group, F.col(group).cast("string").alias("_text"), F.lit(0).alias("_all"))
    return placed(some, ["_all"], ["_text"], [group]).select(group, (F.col("t_idx") % k).cast("int").alias("fold"))


def percentiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact p50, p95, p99 and mean."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return df.groupBy(*by).agg(p.alias("p"), F.avg(value).alias("mean")).select(*by, *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "mean")


def aggregate_claims(claims: DataFrame, key: str, status: str) -> DataFrame:
    """Each response's label by precedence: CONTRADICTED, CONFLICTING, UNKNOWN, SUPPORTED (all claims) or MIXED."""
    has = lambda s: F.bool_or(F.col(status) == s)
    all_ok = F.bool_and(F.col(status) == "SUPPORTED")
    return claims.groupBy(key).agg(F.when(has("CONTRADICTED"), "CONTRADICTED").when(has("CONFLICTING"), "CONFLICTING").when(has("UNKNOWN"), "UNKNOWN").when(all_ok, "SUPPORTED").otherwise("MIXED").alias("label"))


def decide(findings: DataFrame, rules: DataFrame, key: str, default: str, order: list[str], most: int = 10_000) -> DataFrame:
    """(key, action, matched, risk): the strongest action of all rules that match a finding in category and severity.

    rules: rule_id, category (null: any), severity_at_least, action. A rule for any category is written once for each category that
    findings have, so rules meet findings by an equal join; tables of up to most rules are broadcast.
    """
    rank = F.create_map(*[x for i, a in enumerate(order) for x in (F.lit(a), F.lit(i))])
    seen = findings.select(F.col("category").alias("_category")).distinct()
    some = rules.where(F.col("category").isNotNull()).withColumn("_category", F.col("category"))
    every = rules.where(F.col("category").isNull()).crossJoin(seen)  # rules for any category, by the few categories there are
    flat = some.unionByName(every).select("_category", "severity_at_least", "rule_id", rank[F.col("action")].alias("_rank"))
    flat = F.broadcast(flat) if rules.count() <= most else flat
    j = findings.join(flat, F.col("category").eqNullSafe(F.col("_category")) & (F.col("severity") >= F.col("severity_at_least")), "left")
    g = j.groupBy(key).agg(F.max(F.coalesce("_rank", F.lit(-1))).alias("_rank"), F.count_distinct("rule_id").alias("matched"), F.max(F.col("severity") / 4.0 * F.col("confidence")).alias("risk"))
    names = F.array(*[F.lit(a) for a in order])
    return g.select(key, F.get(names, F.greatest("_rank", F.lit(order.index(default)))).alias("action"), "matched", "risk")
