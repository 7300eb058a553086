"""The process benchmark's fault catalogue and topology as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fault number, label, kind, expected roots, affected variables, subsystem (x: measured, v: manipulated variable).
FAULTS = (
    (1, "A/C feed ratio step", "step", "x4 v4", "x4 x6 x9 x29 x31 v4", "feed/composition"),
    (2, "B composition step", "step", "x24", "x24 x30 x35 x36 x40 x41", "feed/composition"),
    (3, "D feed temperature step", "step", "x2 v1", "x2 x6 x9 x11 v1", "feed/reaction"),
    (4, "Reactor cooling-water inlet temperature step", "step", "v10 x21 x9", "v10 x21 x9 x7 x20", "reactor cooling"),
    (5, "Condenser cooling-water inlet temperature step", "step", "v11 x22 x11", "v11 x22 x11 x13 x16", "separator/condenser cooling"),
    (6, "A feed loss", "step", "x1 v3", "x1 v3 x4 x6 x9 x29", "feed"),
    (7, "C header pressure loss", "step", "x4 v4", "x4 v4 x6 x7 x9 x31", "feed"),
    (8, "A/B/C feed composition random variation", "random variation", "x23 x24 x25", "x23 x24 x25 x29 x30 x31 x35 x36", "feed/composition"),
    (9, "D feed temperature random variation", "random variation", "x2 v1", "x2 v1 x6 x9 x11", "feed/reaction"),
    (10, "C feed temperature random variation", "random variation", "x4 v4", "x4 v4 x6 x7 x9 x31", "feed/reaction"),
    (11, "Reactor cooling-water temperature random variation", "random variation", "v10 x21 x9", "v10 x21 x9 x7 x20", "reactor cooling"),
    (12, "Condenser cooling-water temperature random variation", "random variation", "v11 x22 x11", "v11 x22 x11 x13 x16", "separator/condenser cooling"),
    (13, "Reaction kinetics slow drift", "slow drift", "x9 x7", "x9 x7 x21 x35 x36 x40 x41", "reactor"),
    (14, "Reactor cooling-water valve sticking", "valve sticking", "v10", "v10 x21 x9 x7", "reactor cooling"),
    (15, "Condenser cooling-water valve sticking", "valve sticking", "v11", "v11 x22 x11 x13", "separator/condenser cooling"),
    (16, "Unknown fault", "unknown", "", "", "unknown"),
    (17, "Unknown fault", "unknown", "", "", "unknown"),
    (18, "Unknown fault", "unknown", "", "", "unknown"),
    (19, "Unknown fault", "unknown", "", "", "unknown"),
    (20, "Unknown fault", "unknown", "", "", "unknown"),
    (21, "Valve fixed at steady-state position", "constant position", "v1 v3 v4 v10 v11", "v1 v3 v4 v10 v11 x6 x9 x21 x22", "control valve"),
)
# Causes and effects.
EDGES = (
    "v1>x2 v2>x3 v3>x1 v4>x4 x1>x4 x2>x6 x3>x6 x4>x6 x23>x29 x24>x30 x25>x31 x6>x7 x6>x8 x6>x9 x29>x9 x30>x9 x31>x9 v10>x21 x21>x9 x9>x7 x7>x5 x8>x5 x9>x5 "
    "x5>x10 v6>x10 x5>x11 x5>x12 x5>x13 v11>x22 x22>x11 x11>x13 v7>x14 x14>x15 x14>x16 x14>x17 v9>x19 x19>x18 x18>x17 v8>x17 x17>x37 x17>x38 x17>x39 x17>x40 x17>x41 v5>x20 x20>x5"
)


def variable(short: str) -> str:
    """The full name of x1, v1 and so on."""
    return f"{'XMEAS' if short[0] == 'x' else 'XMV'}({short[1:]})"


def faults(spark: SparkSession) -> DataFrame:
    """(fault_id, label, kind, roots, affected, subsystem): 21 rows; the first root is the likeliest."""
    rows = [(i, f"IDV({i}): {label}", kind, [variable(s) for s in roots.split()], [variable(s) for s in affected.split()], part) for i, label, kind, roots, affected, part in FAULTS]
    return spark.createDataFrame(rows, "fault_id int, label string, kind string, roots array<string>, affected array<string>, subsystem string")


def topology(spark: SparkSession) -> DataFrame:
    """(cause, effect): what acts on what in the plant."""
    return spark.createDataFrame([tuple(variable(s) for s in e.split(">")) for e in EDGES.split()], "cause string, effect string")


def catalogue_sql() -> str:
    """The catalogue as rows for SQL."""
    listed = lambda names: "[" + ", ".join(f"'{variable(s)}'" for s in names.split()) + "]::VARCHAR[]"
    rows = ", ".join(f"({i}, 'IDV({i}): {label}', '{kind}', {listed(roots)}, {listed(affected)}, '{part}')" for i, label, kind, roots, affected, part in FAULTS)
    return f"(VALUES {rows}) AS cat(fault_id, label, kind, roots, affected, subsystem)"
