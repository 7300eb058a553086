"""Contracts of diagnostic payloads: each domain's fields, shapes, clocks and ranges, checked as expressions on the parsed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V, M, S, T, N = "array<double>", "array<array<double>>", "string", "array<string>", "double"
# Each workflow's domain, task, policy, model slots and fields.
WORKFLOWS = {
    "bearing": ("bearing", "fault_diagnosis", "bearing-policy-v2", (), {"signal": V, "sampling_rate_hz": N, "signal_unit": S, "channel_name": S, "sensor_location": S, "bearing_id": S, "shaft_speed_rpm": N, "load_percent": N, "fault_frequencies": "struct<BPFO:double,BPFI:double,BSF:double,FTF:double>"}),
    "process": ("process", "root_cause", "process-policy-v3", ("trained_fault_classifier",), {"signal_matrix": M, "normal_reference": M, "channel_names": T, "channel_units": T, "sampling_rate_hz": N, "reference_id": S, "reference_revision": S}),
    "wind_scada": ("wind_scada", "condition_monitoring", "wind-care-event-policy:1.0", (), {"train_matrix": M, "prediction_matrix": M, "channel_names": T, "channel_units": T, "train_timestamps": T, "prediction_timestamps": T, "reference_id": S, "reference_revision": S}),
    "battery_diagnosis": ("battery", "anomaly_localization", "battery-pack-policy-v2", ("trained_prognostic_model",), {"cell_voltage": M, "cell_temperature": M, "cell_ids": T, "timestamps": T, "voltage_unit": S, "temperature_unit": S, "pack_current": V, "current_unit": S}),
    "battery_prognosis": ("battery", "prognosis", "capacity-prognosis-policy-v1", (), {"cycle_index": V, "capacity_ah": V, "nominal_capacity_ah": N, "eol_capacity_ah": N, "capacity_unit": S, "battery_id": S}),
    "turbofan": ("turbofan", "remaining_useful_life", "turbofan-policy-v2", ("trained_rul_model",), {"signal_matrix": M, "channel_names": T, "channel_units": T, "cycle_index": V, "operating_conditions": "array<int>", "engine_id": S, "regime_map_revision": S, "require_calibrated_rul": "boolean"}),
    "transformer": ("transformer", "fault_diagnosis", "transformer-policy-v2", ("raw_waveform_model", "trained_image_model"), {"signal_matrix": M, "sampling_rate_hz": N, "sensor_positions": T, "channel_units": T, "fundamental_hz": N}),
}
METADATA = ("asset_id", "specimen_id", "dataset_id", "dataset_revision", "observation_timestamp_utc", "acquisition_end_utc", "provenance", "operating_context")
PROVENANCE = ("synthetic", "real", "public_dataset")
#: Values of one matrix at most.
MOST_VALUES = 1_000_000

_ALL = {f: t for *_, fields in WORKFLOWS.values() for f, t in fields.items()}
SCHEMA = f"contract_version string, domain string, task string, policy_ref string, inputs struct<{', '.join(f'{f}:{t}' for f, t in _ALL.items())}>, model_refs map<string,string>, run_context struct<metadata:struct<{', '.join(f'{m}:string' for m in METADATA)}>>"


def utc(c: Column) -> Column:
    """The time of an ISO 8601 text that names UTC, else null."""
    return F.when(c.rlike("(?:Z|[+-]00:?00)$"), F.regexp_replace(c, "(?:Z|[+-]00:?00)$", "+00:00").try_cast("timestamp"))


def increasing(a: Column) -> Column:
    return (F.size(a) < 2) | F.forall(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: (F.size(a) < 2) | F.coalesce(F.get(a, i - 1) < F.get(a, i), F.lit(False)))


def width(m: Column) -> Column:
    return F.size(F.get(m, F.lit(0)))


def ragged(m: Column) -> Column:
    """Whether a matrix isn't rectangular, holds nulls or is too large."""
    return (F.size(m) < 1) | F.exists(m, lambda r: r.isNull() | (F.size(r) != width(m)) | F.exists(r, lambda v: v.isNull())) | (F.size(m).cast("long") * width(m) > MOST_VALUES)


def mismatched(names: Column, units: Column, m: Column) -> Column:
    return (F.size(names) != width(m)) | (F.size(units) != width(m)) | (F.size(F.array_distinct(names)) != F.size(names))


def clock(a: Column, rows: Column) -> Column:
    """Whether times aren't UTC, strictly increasing and one for each row."""
    return (F.size(a) != rows) | F.exists(a, lambda t: utc(t).isNull()) | ~increasing(F.transform(a, utc))


def rules(name: str, i: Column, meta: Column) -> dict[str, Column]:
    """code -> condition under which a workflow's inputs break it."""
    f = lambda n: i[n]
    positive = lambda *names: ~F.coalesce(F.least(*[F.coalesce(f(n) > 0, F.lit(False)) for n in names], F.lit(True)), F.lit(False))
    duration = utc(meta["acquisition_end_utc"]).cast("double") - utc(meta["observation_timestamp_utc"]).cast("double")
    within = lambda n: ~F.coalesce((utc(F.get(f(n), F.lit(0))) >= utc(meta["observation_timestamp_utc"])) & (utc(F.element_at(f(n), -1)) <= utc(meta["acquisition_end_utc"])), F.lit(False))
    sampled = lambda rows: duration < (rows - 1) / F.when(f("sampling_rate_hz") > 0, f("sampling_rate_hz"))
    if name == "bearing":
        freq = [f("fault_frequencies")[k] for k in ("BPFO", "BPFI", "BSF", "FTF")]
        return {
            "too_short": F.size(f("signal")) < 256,
            "not_positive": positive("sampling_rate_hz", "shaft_speed_rpm") | ~F.coalesce(F.least(*freq) > 0, F.lit(False)),
            "unit": ~f("signal_unit").isin("m/s^2", "g"),
            "load": ~f("load_percent").between(0, 100),
            "nyquist": F.greatest(*freq) >= f("sampling_rate_hz") / 2,
            "specimen": f("bearing_id") != meta["specimen_id"],
            "interval": sampled(F.size(f("signal"))),
        }
    if name == "process":
        return {
            "shape": ragged(f("signal_matrix")) | ragged(f("normal_reference")),
            "channels": mismatched(f("channel_names"), f("channel_units"), f("signal_matrix")) | mismatched(f("channel_names"), f("channel_units"), f("normal_reference")),
            "not_positive": positive("sampling_rate_hz"),
            "interval": sampled(F.size(f("signal_matrix"))),
        }
    if name == "wind_scada":
        return {
            "too_short": F.size(f("train_matrix")) < 60,
            "shape": ragged(f("train_matrix")) | ragged(f("prediction_matrix")),
            "channels": mismatched(f("channel_names"), f("channel_units"), f("train_matrix")) | mismatched(f("channel_names"), f("channel_units"), f("prediction_matrix")),
            "clock": clock(f("train_timestamps"), F.size(f("train_matrix"))) | clock(f("prediction_timestamps"), F.size(f("prediction_matrix"))),
            "reference_overlap": utc(F.element_at(f("train_timestamps"), -1)) >= utc(F.get(f("prediction_timestamps"), F.lit(0))),
            "outside_interval": within("prediction_timestamps"),
        }
    if name == "battery_diagnosis":
        return {
            "shape": ragged(f("cell_voltage")) | ragged(f("cell_temperature")),
            "channels": (F.size(f("cell_ids")) != width(f("cell_voltage"))) | (F.size(F.array_distinct(f("cell_ids"))) != F.size(f("cell_ids"))),
            "alignment": (F.size(f("cell_temperature")) != F.size(f("cell_voltage"))) | (width(f("cell_temperature")) != width(f("cell_voltage"))) | (F.size(f("pack_current")) != F.size(f("cell_voltage"))),
            "unit": (f("voltage_unit") != "V") | (f("temperature_unit") != "degC") | (f("current_unit") != "A"),
            "clock": clock(f("timestamps"), F.size(f("cell_voltage"))),
            "not_positive": F.exists(F.flatten(f("cell_voltage")), lambda v: v <= 0),
            "outside_interval": within("timestamps"),
        }
    if name == "battery_prognosis":
        return {
            "too_short": (F.size(f("cycle_index")) < 20) | (F.size(f("capacity_ah")) < 20),
            "order": (F.size(f("cycle_index")) != F.size(f("capacity_ah"))) | ~increasing(f("cycle_index")),
            "not_positive": (F.array_min(f("cycle_index")) < 0) | (F.array_min(f("capacity_ah")) <= 0) | positive("nominal_capacity_ah", "eol_capacity_ah"),
            "limit": f("eol_capacity_ah") >= f("nominal_capacity_ah"),
            "unit": f("capacity_unit") != "Ah",
            "specimen": f("battery_id") != meta["specimen_id"],
        }
    if name == "turbofan":
        return {
            "shape": ragged(f("signal_matrix")),
            "channels": mismatched(f("channel_names"), f("channel_units"), f("signal_matrix")),
            "order": (F.size(f("cycle_index")) != F.size(f("signal_matrix"))) | ~increasing(f("cycle_index")),
            "too_short": F.size(f("operating_conditions")) < 8,
            "alignment": (F.array_min(f("cycle_index")) < 0) | (F.size(f("operating_conditions")) != F.size(f("signal_matrix"))) | F.exists(f("operating_conditions"), lambda c: c.isNull() | (c < 0)),
            "calibration": ~f("require_calibrated_rul"),
            "specimen": f("engine_id") != meta["specimen_id"],
        }
    return {
        "too_short": F.size(f("signal_matrix")) < 32,
        "shape": ragged(f("signal_matrix")),
        "channels": mismatched(f("sensor_positions"), f("channel_units"), f("signal_matrix")),
        "not_positive": positive("sampling_rate_hz", "fundamental_hz"),
        "nyquist": f("fundamental_hz") >= f("sampling_rate_hz") / 2,
        "interval": sampled(F.size(f("signal_matrix"))),
    }


def contract_violations(payloads: DataFrame, ids: list[str], payload: str) -> DataFrame:
    """(ids, violation): every rule that a JSON payload breaks; a payload that keeps its contract has no row.

    Fields that are absent, null or of another type are `missing:<field>`, fields that the workflow doesn't know `unknown:<field>`, and rules on missing fields don't fire. What is no JSON object is `malformed`, an
    unknown pair of domain and task `unsupported_task`. Metadata need all fields, UTC times in order and a known provenance.
    """
    p = F.col("_p")
    rows = payloads.select(*ids, F.col(payload).alias("_j")).withColumn("_p", F.from_json("_j", SCHEMA))
    inputs, meta = p["inputs"], p["run_context"]["metadata"]
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    named = lambda pairs: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in pairs]))
    start, end = utc(meta["observation_timestamp_utc"]), utc(meta["acquisition_end_utc"])
    common = [*((f"missing:{m}", blank(meta[m])) for m in METADATA), ("times", ~F.coalesce(start < end, F.lit(False))), ("provenance", ~meta["provenance"].isin(*PROVENANCE))]
    found = F.array(F.lit("unsupported_task"))
    for name, (domain, task, policy, slots, fields) in WORKFLOWS.items():
        known = F.array(*[F.lit(f) for f in fields])
        extra = F.transform(F.array_except(F.coalesce(F.json_object_keys(F.get_json_object("_j", "$.inputs")), F.array().cast("array<string>")), known), lambda f: F.concat(F.lit("unknown:"), f))
        used = F.coalesce(F.map_keys(p["model_refs"]), F.array().cast("array<string>"))
        own = [
            ("policy_ref", ~p["policy_ref"].eqNullSafe(policy)),
            ("model_slots", F.size(F.array_except(used, F.array(*[F.lit(s) for s in slots]).cast("array<string>"))) > 0),
            *([("model_required", ~F.array_contains(used, "trained_rul_model"))] if domain == "turbofan" else []),
            *((f"missing:{f}", blank(inputs[f]) if t == S else inputs[f].isNull()) for f, t in fields.items()),
            *rules(name, inputs, meta).items(),
        ]
        found = F.when((p["domain"] == domain) & (p["task"] == task), F.concat(named([*own, *common]), extra)).otherwise(found)
    bad = F.when(F.json_object_keys("_j").isNull() | p.isNull(), F.array(F.lit("malformed"))).otherwise(found)
    return rows.select(*ids, F.explode(bad).alias("violation"))
