"""Each workflow's sound payload is accepted and each broken one named."""

from __future__ import annotations

import json
from copy import deepcopy
from datetime import UTC, datetime, timedelta

import pytest

from orebed.operators import payloads as P


def times(n, start=0):
    return [(datetime(2026, 1, 1, tzinfo=UTC) + timedelta(seconds=i + start)).isoformat() for i in range(n)]


def sound(key):
    matrix = [[float(i), float(i + 1)] for i in range(32)]
    two = dict(channel_names=["a", "b"], channel_units=["K", "K"])
    inputs = {
        "bearing": dict(signal=[i % 7 / 10 for i in range(256)], sampling_rate_hz=8000.0, signal_unit="g", channel_name="x", sensor_location="drive end", bearing_id="s1", shaft_speed_rpm=1800.0, load_percent=50.0, fault_frequencies=dict(BPFO=100.0, BPFI=150.0, BSF=70.0, FTF=10.0)),
        "process": dict(signal_matrix=matrix, normal_reference=matrix, **two, sampling_rate_hz=1.0, reference_id="n", reference_revision="1"),
        "wind_scada": dict(train_matrix=[[1.0, 2.0]] * 64, prediction_matrix=matrix, **two, train_timestamps=times(64), prediction_timestamps=times(32, 100), reference_id="n", reference_revision="1"),
        "battery_diagnosis": dict(cell_voltage=[[3.5, 3.6]] * 32, cell_temperature=[[25.0, 26.0]] * 32, cell_ids=["1", "2"], timestamps=times(32, 100), voltage_unit="V", temperature_unit="degC", pack_current=[1.0] * 32, current_unit="A"),
        "battery_prognosis": dict(cycle_index=list(range(32)), capacity_ah=[2 - i / 100 for i in range(32)], nominal_capacity_ah=2.0, eol_capacity_ah=1.4, capacity_unit="Ah", battery_id="s1"),
        "turbofan": dict(signal_matrix=matrix, **two, cycle_index=list(range(32)), operating_conditions=[0] * 32, engine_id="s1", regime_map_revision="1", require_calibrated_rul=True),
        "transformer": dict(signal_matrix=matrix, sampling_rate_hz=1000.0, sensor_positions=["Ia", "Ib"], channel_units=["A", "A"], fundamental_hz=50.0),
    }[key]
    domain, task, policy, *_ = P.WORKFLOWS[key]
    meta = dict(asset_id="a", specimen_id="s1", dataset_id="d", dataset_revision="1", observation_timestamp_utc=times(1, 100)[0], acquisition_end_utc=times(1, 200)[0], provenance="synthetic", operating_context="lab")
    return dict(contract_version="1", domain=domain, task=task, policy_ref=policy, inputs=deepcopy(inputs), model_refs={"trained_rul_model": "m"} if key == "turbofan" else {}, run_context={"metadata": meta})


BROKEN = [
    ("bearing", "inputs.signal", [0.1] * 255, {"too_short"}),
    ("bearing", "inputs.fault_frequencies.BPFI", 4000.0, {"nyquist"}),
    ("bearing", "inputs.signal_unit", "mm/s", {"unit"}),
    ("bearing", "inputs.load_percent", 101.0, {"load"}),
    ("bearing", "inputs.bearing_id", "other", {"specimen"}),
    ("bearing", "inputs.sampling_rate_hz", 1.0, {"nyquist", "interval"}),
    ("bearing", "inputs.shaft_speed_rpm", None, {"missing:shaft_speed_rpm", "not_positive"}),
    ("bearing", "inputs.extra", 1, {"unknown:extra"}),
    ("process", "inputs.normal_reference", [[1.0, 2.0], [1.0]], {"shape"}),
    ("process", "inputs.channel_names", ["a", "a"], {"channels"}),
    ("process", "model_refs", {"other": "m"}, {"model_slots"}),
    ("process", "policy_ref", "process-policy-v2", {"policy_ref"}),
    ("wind_scada", "inputs.train_matrix", [[1.0, 2.0]] * 59, {"too_short", "clock"}),
    ("wind_scada", "inputs.prediction_timestamps", times(32, 60), {"reference_overlap", "outside_interval"}),
    ("wind_scada", "inputs.train_timestamps", [times(1)[0]] * 64, {"clock"}),
    ("battery_diagnosis", "inputs.pack_current", [1.0] * 31, {"alignment"}),
    ("battery_diagnosis", "inputs.timestamps", [t.replace("+00:00", "+01:00") for t in times(32, 100)], {"clock", "outside_interval"}),
    ("battery_diagnosis", "inputs.cell_voltage", [[3.5, 0.0]] * 32, {"not_positive"}),
    ("battery_prognosis", "inputs.cycle_index", [0] * 32, {"order"}),
    ("battery_prognosis", "inputs.eol_capacity_ah", 2.0, {"limit"}),
    ("battery_prognosis", "inputs.capacity_unit", "mAh", {"unit"}),
    ("turbofan", "model_refs", {}, {"model_required"}),
    ("turbofan", "inputs.require_calibrated_rul", False, {"calibration"}),
    ("turbofan", "inputs.operating_conditions", [0] * 7, {"too_short", "alignment"}),
    ("transformer", "inputs.fundamental_hz", 500.0, {"nyquist"}),
    ("transformer", "inputs.signal_matrix", [[1.0, 2.0]] * 31, {"too_short"}),
    ("transformer", "run_context.metadata.acquisition_end_utc", times(1, 100)[0], {"times", "interval"}),
    ("transformer", "run_context.metadata.provenance", "guess", {"provenance"}),
    ("transformer", "run_context.metadata.asset_id", " ", {"missing:asset_id"}),
    ("transformer", "task", "prognosis", {"unsupported_task"}),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"sound {k}", json.dumps(sound(k))) for k in P.WORKFLOWS] + [("no json", "oops"), ("none", None), ("list", "[1]"), ("empty", "{}")]
    for n, (key, path, value, _) in enumerate(BROKEN):
        p = at = sound(key)
        *way, last = path.split(".")
        for step in way:
            at = at[step]
        at[last] = value
        rows.append((str(n), json.dumps(p)))
    out = {}
    for r in P.contract_violations(spark.createDataFrame(rows, "id string, payload string"), ["id"], "payload").collect():
        out.setdefault(r.id, set()).add(r.violation)
    return out


def test_sound_payloads_are_accepted(found):
    assert not [k for k in found if k.startswith("sound")]


@pytest.mark.parametrize("n", range(len(BROKEN)))
def test_broken_payloads_are_named(found, n):
    assert found[str(n)] == BROKEN[n][3]


def test_what_is_no_payload(found):
    assert found["no json"] == found["none"] == found["list"] == {"malformed"}
    assert found["empty"] == {"unsupported_task"}
