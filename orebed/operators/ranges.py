"""Normal ranges that statements cite from controlled documents, and unit conversion by aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.functions.text import sentences
from orebed.operators.longseries import stored

# The grammar of a stated range, of assets and of citations, and the kinds of documents that may prove one.
METRICS = ("discharge pressure", "pressure", "vibration", "temperature", "speed", "load")
STATED = "(?i)^([A-Za-z]+-\\d+)\\s+(?:current\\s+)?normal\\s+(discharge\\s+pressure|pressure|vibration|temperature|speed|load)\\s+(?:is|was)\\s+(\\d+(?:\\.\\d+)?)\\s*(?:to|[-–])\\s*(\\d+(?:\\.\\d+)?)\\s*(bar|mm/s(?:\\s+RMS)?|rpm|percent|%|°?C)\\.?$"
BAND = "\\d+(?:\\.\\d+)?\\s*(?:to|[-–])\\s*\\d+(?:\\.\\d+)?"
ASSET = "(?<![\\w-])[A-Za-z]+-\\d+\\b"
CITED = "\\[([A-Za-z0-9][A-Za-z0-9:_-]{2,127})\\]"
CONTROLLED = ("equipment_manual", "sop", "operating_limits", "inspection_procedure")
# Fixed values: (unit as shown, dimension, factor, shift, lower-cased aliases); base value = value * factor + shift. The canonical unit of each dimension stands below.
UNIT_ALIASES = (
    ("°C", "temperature", 1.0, 273.15, ("c", "°c", "celsius", "degc")),
    ("K", "temperature", 1.0, 0.0, ("k", "kelvin")),
    ("Pa", "pressure", 1.0, 0.0, ("pa", "pascal")),
    ("kPa", "pressure", 1000.0, 0.0, ("kpa", "kilopascal")),
    ("MPa", "pressure", 1000000.0, 0.0, ("mpa", "megapascal")),
    ("bar", "pressure", 100000.0, 0.0, ("bar",)),
    ("mm", "length", 0.001, 0.0, ("mm", "millimeter")),
    ("cm", "length", 0.01, 0.0, ("cm", "centimeter")),
    ("m", "length", 1.0, 0.0, ("m", "meter")),
    ("mm/s", "velocity", 0.001, 0.0, ("mm/s", "mm/s rms", "millimeter / second")),
    ("m/s", "velocity", 1.0, 0.0, ("m/s", "meter / second")),
    ("W", "power", 1.0, 0.0, ("w", "watt")),
    ("kW", "power", 1000.0, 0.0, ("kw", "kilowatt")),
    ("MW", "power", 1000000.0, 0.0, ("mw", "megawatt")),
    ("N", "force", 1.0, 0.0, ("n", "newton")),
    ("kN", "force", 1000.0, 0.0, ("kn", "kilonewton")),
    ("g", "mass", 0.001, 0.0, ("g", "gram")),
    ("kg", "mass", 1.0, 0.0, ("kg", "kilogram")),
    ("Hz", "frequency", 1.0, 0.0, ("hz", "hertz")),
    ("rpm", "frequency", 1 / 60, 0.0, ("rpm", "engineering_rpm")),
)
CANONICAL = {"temperature": "degc", "pressure": "bar", "length": "m", "velocity": "mm/s", "power": "kw", "force": "n", "mass": "kg", "frequency": "hz"}


def _unit(name: Column) -> Column:
    """struct<shown, dimension, factor, shift> of a unit's name in any case and spacing; null if it is unknown."""
    table = F.create_map(*[x for shown, dim, f, s, aliases in UNIT_ALIASES for a in aliases for x in (F.lit(a), F.struct(F.lit(shown).alias("shown"), F.lit(dim).alias("dimension"), F.lit(f).alias("factor"), F.lit(s).alias("shift")))])
    return table[F.regexp_replace(F.replace(F.lower(F.trim(name)), F.lit("r.m.s."), F.lit("rms")), "\\s+", " ")]


def convert_units(rows: DataFrame, value: str, unit: str, to: str | None = None) -> DataFrame:
    """rows with converted, shown_unit, dimension and unit_status.

    to: column of target units; without it each dimension's canonical unit is taken. The result has two decimals more
    than the value, at least 1 and at most 6. Status: UNIT_AMBIGUOUS (a unit is null, blank or unknown),
    INCOMPATIBLE_UNITS (other dimension) or OK; only OK rows have a result. Every row stays; a null value gives a null result.
    """
    source = _unit(F.col(unit))
    canonical = F.create_map(*[x for k, v in CANONICAL.items() for x in (F.lit(k), F.lit(v))])
    target = _unit(F.col(to) if to else canonical[source["dimension"]])
    status = F.when(source.isNull() | target.isNull(), "UNIT_AMBIGUOUS").when(source["dimension"] != target["dimension"], "INCOMPATIBLE_UNITS").otherwise("OK")
    text = F.col(value).cast("double").cast("string")
    places = F.length(F.regexp_extract(text, "\\.(\\d+)", 1)) - F.coalesce(F.regexp_extract(text, "E(-?\\d+)", 1).try_cast("int"), F.lit(0))
    kept = F.least(F.greatest(places + 2, F.lit(1)), F.lit(6))
    raw = (F.col(value).cast("double") * source["factor"] + source["shift"] - target["shift"]) / target["factor"]
    rounded = F.coalesce(*[F.when(kept == n, F.round(raw, n)) for n in range(1, 7)])
    fine = status == "OK"
    return rows.withColumns({"converted": F.when(fine, rounded), "shown_unit": F.when(fine, target["shown"]), "dimension": source["dimension"], "unit_status": status})


def stated_range(text: Column) -> Column:
    """struct<asset, metric, low, high, unit> of a text that states one normal range and nothing else, else null."""
    # One match for all parts; the mark that parts them is taken out of the text first, where it matches nothing either.
    parts = F.split(F.regexp_replace(F.translate(text, "\x01", "\x02"), STATED, "$1\x01$2\x01$3\x01$4\x01$5"), "\x01")
    number = lambda p, i: p[i].try_cast("decimal(38,12)")

    def fact(p: Column) -> Column:
        found = F.struct(F.lower(p[0]).alias("asset"), F.regexp_replace(F.lower(p[1]), "\\s+", " ").alias("metric"), number(p, 2).alias("low"), number(p, 3).alias("high"), F.regexp_replace(F.lower(p[4]), "\\s+", "").alias("unit"))
        return F.when(F.size(p) == 5, F.when(number(p, 2).isNotNull() & number(p, 3).isNotNull(), found))

    return F.transform(F.array(parts), fact)[0]


def _assets(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ASSET), F.lit(0)))


def proved_ranges(claims: DataFrame, evidence: DataFrame, case: str = "case") -> DataFrame:
    """(case, claim, evidence_id, status, n_sources): claims that a cited controlled document proves or others contradict.

    claims (case, claim, text, prompt); evidence (case, evidence_id, text, status, trust, kind). A claim takes part if it
    is one stated range with one citation, its prompt names no other asset, and the cited document is current, not untrusted
    and of a controlled kind, and states the same range. A sentence without an asset takes the only one that its document names. Status is
    CONFLICTING where controlled documents of the case state other ranges of that asset, metric and unit (n_sources counts
    these statements and the cited one), else SUPPORTED. Claims are left out where the case states the metric in
    another unit, or has a band of it outside this grammar. Nulls match nothing; repeated claims stay, each with its row.
    Everything meets by equal keys of case, asset and metric, so a case with very many documents is never gathered. Documents and claims are parsed once; what they state is kept in the checkpoint folder.
    """
    controlled = (F.lower("status") == "current") & (F.lower(F.coalesce("trust", F.lit(""))) != "untrusted") & F.lower("kind").isin(*CONTROLLED)
    own = _assets(F.col("text"))
    said = evidence.where(controlled & F.col("text").isNotNull()).select(case, "evidence_id", own.alias("_named"), F.explode(sentences(F.col("text"))).alias("_s"))
    said = said.withColumn("_s", F.trim("_s"))
    fact = F.coalesce(stated_range(F.col("_s")), F.when(F.size("_named") == 1, stated_range(F.concat_ws(" ", F.get("_named", F.lit(0)), F.col("_s")))))
    metrics = F.array_compact(F.array(*[F.when(F.lower("_s").rlike(f"\\b{m}\\b"), m) for m in METRICS]))
    said = said.withColumn("_fact", fact)
    band = F.col("_fact").isNull() & F.col("_s").rlike(BAND)
    said = stored(said.select(case, "evidence_id", "_fact", F.when(band, metrics).alias("_metrics"), F.when(band, F.transform("_named", F.lower)).alias("_named")), "ranges")
    facts = said.where("_fact IS NOT NULL").select(case, "evidence_id", "_fact.*")
    loose = said.where("_metrics IS NOT NULL").select(case, F.explode("_metrics").alias("metric"), "_named")
    of_all = loose.where(F.size("_named") == 0).select(case, "metric").distinct()
    of_one = loose.select(case, "metric", F.explode("_named").alias("asset")).distinct()

    cites = F.regexp_extract_all("text", F.lit(CITED), F.lit(1))
    bare = F.regexp_replace(F.trim(F.regexp_replace("text", CITED, "")), "[.]+$", "")
    asked = F.transform(_assets(F.coalesce("prompt", F.lit(""))), F.lower)
    wanted = claims.where(F.size(cites) == 1).select(case, "claim", F.get(cites, F.lit(0)).alias("evidence_id"), stated_range(F.trim(bare)).alias("_fact"), F.array_distinct(asked).alias("_asked"))
    wanted = stored(wanted, "claims").where("_fact IS NOT NULL").select(case, "claim", "evidence_id", "_fact.*", "_asked").where("low <= high AND (size(_asked) = 0 OR _asked = array(asset))").drop("_asked")

    key = [case, "asset", "metric"]
    ranges = ["low", "high", "unit"]
    same = facts.groupBy(*key, *ranges).agg(F.count(F.lit(1)).alias("_same"))
    totals = same.groupBy(*key).agg(F.sum("_same").alias("_all"), F.count_distinct("unit").alias("_units")).where("_units = 1")
    proved = wanted.join(facts.select(case, "evidence_id", *key[1:], *ranges).distinct(), [case, "evidence_id", *key[1:], *ranges], "left_semi")
    proved = proved.join(of_all, [case, "metric"], "left_anti").join(of_one, key, "left_anti").join(totals, key).join(same, [*key, *ranges])
    others = F.col("_all") - F.col("_same")
    return proved.select(case, "claim", "evidence_id", F.when(others > 0, "CONFLICTING").otherwise("SUPPORTED").alias("status"), (others + 1).alias("n_sources"))
