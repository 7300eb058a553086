"""Channel roles and physical bounds of turbines: suppliers are turbines of three makers that name their channels differently, line items are samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import turbines as W
from orebed.queries.base import query, table

# Per maker: a channel's number, name, and the expression that its readings are taken from.
MAKERS = {
    0: [(1, "Ambient Temperature", "10 + l_tax * 100"), (2, "Rotor Speed", "l_quantity / 4"), (3, "Generator Torque", "l_discount * 300"), (4, "Gearbox Oil Temp", "30 + l_quantity / 2"), (5, "Main Bearing Temperature", "15 + l_quantity / 3"), (6, "Wind Speed", "l_quantity / 2"), (7, "Reactive Power", "l_tax"), (8, "Active Power", "CASE WHEN l_linenumber < 7 THEN l_extendedprice / 40 END"), (9, "Pitch Angle", "l_discount * 150")],
    1: [(1, "wind speed avg", "l_quantity / 2"), (2, "Power", "l_extendedprice / 50"), (3, "blade angle", "l_discount * 100"), (4, "Generator RPM", "l_quantity * 30"), (5, "outside temp", "10 + l_tax * 100"), (6, "rotor rpm", "l_quantity / 4"), (7, "torque", "l_discount * 300"), (8, "winding temp", "60 * l_tax / l_quantity + 40"), (9, "reactive power", "l_tax")],
    2: [(3, "generator apparent power", "l_extendedprice / 30"), (4, "apparent power", "l_tax"), (5, "Wind speed 2", "l_quantity / 3"), (6, "Wind speed 1", "l_quantity / 2"), (7, "rotor speed", "CASE WHEN l_quantity > 10 THEN l_quantity ELSE -l_quantity END")],
}
ROLES_SQL = "roles(role, rank, words) AS (VALUES " + ", ".join(f"('{role}', {i}, {list(words)})" for role, choices in W.ROLES.items() for i, words in enumerate(choices)) + ")"
CHANNELS_SQL = "mk(maker, channel, name) AS (VALUES " + ", ".join(f"({m}, {c}, '{n}')" for m, rows in MAKERS.items() for c, n, _ in rows) + f"), {ROLES_SQL}, ro AS (SELECT maker, role, arg_min(channel, rank * 1000 + channel) AS channel FROM mk, roles WHERE len(list_filter(words, lambda w: NOT contains(lower(name), w))) = 0 AND (role <> 'power' OR (NOT contains(lower(name), 'reactive') AND (len(words) = 2 OR NOT contains(lower(name), 'apparent')))) GROUP BY ALL)"
RD_SQL = "rd AS (" + " UNION ALL ".join(f"SELECT l_suppkey AS unit, {m} AS maker, l_orderkey * 10 + l_linenumber AS sample, {c} AS channel, ({x})::DOUBLE AS v FROM lineitem WHERE l_suppkey % 3 = {m}" for m, rows in MAKERS.items() for c, _, x in rows) + ")"
FOUND_SQL = f"""{CHANNELS_SQL}, {RD_SQL}, sm AS (SELECT unit, maker, sample, {', '.join(f"max(v) FILTER (role = '{r}') AS {r}" for r in W.ROLES)} FROM rd LEFT JOIN ro USING (maker, channel) GROUP BY ALL),
has AS (SELECT maker, {', '.join(f"max(channel) FILTER (role = '{r}') AS c_{r}" for r in W.ROLES)} FROM ro GROUP BY maker),
q AS (SELECT unit, quantile_cont(power, 0.995) AS rated, quantile_cont(abs(generator), 0.95) AS turning, quantile_cont(wind, 0.7) AS windy, count(*) AS n FROM sm GROUP BY unit),
el AS (SELECT *, least(0.5::DOUBLE * 1.225 * 3000 * 0.59 * greatest(wind, 0) ** 3 / 1000 * 1.2, CASE WHEN rated > 0 THEN rated * 1.2 END) AS upper FROM sm JOIN q USING (unit) JOIN has USING (maker)),
pt AS (SELECT unit, maker, sample, channel, CASE WHEN name ILIKE '%gear%' THEN 'gearbox' WHEN name ILIKE '%bearing%' THEN 'bearing' ELSE 'generator' END AS part, v FROM rd JOIN mk USING (maker, channel) WHERE name IN ('Gearbox Oil Temp', 'Main Bearing Temperature', 'winding temp')),
fi AS (SELECT unit, 'power_exceeds_aerodynamic_limit' AS flag, 'electrical' AS subsystem, c_power AS channel, power / greatest(upper, 1e-6) AS x FROM el WHERE power > upper AND wind > 2
UNION ALL SELECT unit, 'possible_unannounced_curtailment_or_electrical_loss', 'electrical', c_power, (rated - power) / rated FROM el WHERE rated > 0 AND power < 0.55 * rated AND wind >= windy AND (c_generator IS NULL OR abs(generator) > coalesce(0.1 * turning, 0)) AND (c_pitch IS NULL OR abs(pitch) < 8)
UNION ALL SELECT unit, 'temperature_above_steady_state_dissipation_bound', part, channel, v - (ambient + 12 + CASE part WHEN 'gearbox' THEN 5 + 0.18 * abs(torque) + 0.35 * abs(rotor) WHEN 'generator' THEN 8 + 0.22 * abs(torque) + 0.40 * abs(rotor) ELSE 2 + 0.15 * abs(torque) + 0.30 * abs(rotor) END) AS x FROM pt JOIN sm USING (unit, maker, sample) WHERE x > 0),
fo AS (SELECT unit, flag, subsystem, channel, count(*) AS violations, count(*) / any_value(n) AS violation_fraction, quantile_cont(x, 0.9) AS p90 FROM fi JOIN q USING (unit) GROUP BY unit, flag, subsystem, channel HAVING count(*) >= 8),
fs AS (SELECT *, greatest(1.0::DOUBLE, least(5.0, CASE WHEN flag LIKE 'temp%' THEN 1 + p90 / 12 WHEN flag LIKE 'poss%' THEN p90 * 3 ELSE p90 END)) AS severity FROM fo)"""


def turbines(spark, sf_dir):
    """(readings, channels) of all suppliers; a line item has a sample's readings in one row."""
    lines = table(spark, sf_dir, "lineitem").withColumns({"unit": F.col("l_suppkey"), "sample": F.expr("l_orderkey * 10 + l_linenumber")})
    of_maker = lambda made: F.coalesce(*[F.when(F.col("unit") % 3 == maker, F.array(*[made(*row) for row in rows])) for maker, rows in MAKERS.items()])
    readings = lines.where("unit % 3 >= 0").select("unit", "sample", of_maker(lambda c, _, x: F.lit(c)).alias("channels"), of_maker(lambda c, _, x: F.expr(x).cast("double")).alias("values"))
    units = lines.where("unit % 3 >= 0").select("unit").distinct()
    channels = units.select("unit", F.explode(of_maker(lambda c, n, _: F.struct(F.lit(c).alias("channel"), F.lit(n).alias("name")))).alias("r")).select("unit", "r.*")
    return readings, channels


@query("channel_roles", f"WITH {CHANNELS_SQL}, u AS (SELECT DISTINCT l_suppkey AS unit FROM lineitem) SELECT unit, {', '.join(f'max(channel) FILTER (role = {chr(39)}{r}{chr(39)}) AS {r}' for r in W.ROLES)} FROM u JOIN ro ON unit % 3 = maker GROUP BY unit")
def channel_roles(spark, sf_dir):
    """Which channel of each turbine plays which role."""
    return W.channel_roles(turbines(spark, sf_dir)[1], "unit")


def found(spark, sf_dir):
    readings, channels = turbines(spark, sf_dir)
    return W.wind_findings(readings, channels, "unit", "sample", bounds=W.Bounds(area=3000.0))


@query("wind_findings", f"WITH {FOUND_SQL} SELECT * FROM fs", "violation_fraction p90 severity")
def wind_findings(spark, sf_dir):
    """Physical bounds that each turbine breaks, with how often and how far."""
    return found(spark, sf_dir)


@query("wind_physics", f"""WITH {FOUND_SQL}, g AS (SELECT unit, subsystem, max(severity) AS s, min(channel) AS c FROM fs GROUP BY ALL), v AS (SELECT unit, max(s) AS s, string_agg(subsystem, '>' ORDER BY round(s, 9) DESC, subsystem <> 'electrical', c) AS ranked FROM g GROUP BY unit)
SELECT unit, v.s IS NULL AS physics_consistent, coalesce(v.s, 0)::DOUBLE AS max_severity, coalesce(ranked, '') AS ranked_subsystems FROM (SELECT DISTINCT l_suppkey AS unit FROM lineitem) LEFT JOIN v USING (unit)""", "max_severity")
def wind_physics(spark, sf_dir):
    """Each turbine's verdict and its parts by their worst finding."""
    _, channels = turbines(spark, sf_dir)
    return W.wind_physics(channels, found(spark, sf_dir), "unit").withColumn("ranked_subsystems", F.array_join("ranked_subsystems", ">"))
