"""Readers on small files."""

import json

from orebed.sources import readers as R


def test_trajectories(spark, tmp_path):
    rows = [(1, 1), (1, 2), (1, 2), (2, 1), (2, 5)]
    (tmp_path / "t.txt").write_text("\n".join(" ".join(map(str, [*r, *range(24)])) for r in rows) + "\n\n1 2 3\n")
    got = R.remaining_life(R.trajectories(spark, str(tmp_path)), 3.0).orderBy("unit", "cycle", "in_order").collect()
    assert [(r.unit, r.cycle, r.in_order, r.remaining) for r in got] == [(1, 1, True, 1.0), (1, 2, False, 0.0), (1, 2, True, 0.0), (2, 1, True, 3.0), (2, 5, True, 0.0)]
    assert got[0].settings == [0.0, 1.0, 2.0]
    assert len(got[0].sensors) == 21


def test_matrix_text(spark, tmp_path):
    (tmp_path / "m.dat").write_text("  1.5 nan\t-2e3\n\n4 x 6\n")
    assert [r.x for r in R.matrix_text(spark, str(tmp_path)).orderBy("line").collect()] == [[1.5, None, -2000.0], [4.0, None, 6.0]]


def test_separated_events(spark, tmp_path):
    (tmp_path / "e.csv").write_text("time_stamp;asset_id;train_test;status_type_id;s1_avg;s1_max\n2024-01-01 00:00:00;7.0;train;0;1.5;9\nbad; 8 ;prediction;x;oops;9\n")
    got = R.separated_events(spark, str(tmp_path)).orderBy("asset_id").collect()
    assert [(r.asset_id, r.is_normal, r.s1_avg) for r in got] == [("7", True, 1.5), ("8", False, None)]
    assert got[1].time_stamp is None
    assert "s1_max" not in got[0].asDict()


def test_answers_and_responses(spark, tmp_path):
    (tmp_path / "qa.json").write_text(json.dumps({"question": "q", "knowledge": "k", "right_answer": "r", "hallucinated_answer": "h"}) + "\n")
    assert [(r.answer, r.is_hallucinated) for r in R.answer_pairs(spark, str(tmp_path / "qa.json")).collect()] == [("r", False), ("h", True)]
    make = lambda i, s, labels, quality="good": json.dumps({"id": i, "source_id": s, "split": "test", "quality": quality, "labels": labels})
    (tmp_path / "r.jsonl").write_text("\n".join([make(1, "a", []), make(2, "a", [{"start": 0}]), make(3, "zz", []), make(4, "a", [], "truncated")]))
    (tmp_path / "s.jsonl").write_text(json.dumps({"source_id": "a", "task_type": "QA", "source_info": "i"}))
    got = R.labelled_responses(spark, str(tmp_path / "r.jsonl"), str(tmp_path / "s.jsonl"), split="test").orderBy("id").collect()
    assert [(r.id, r.is_hallucinated) for r in got] == [(1, False), (2, True)]


def test_folders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\nTwo words\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.TXT").write_text("two")
    (tmp_path / "c.bin").write_bytes(b"\0")
    assert [r.size for r in R.listed(spark, str(tmp_path), (".txt",)).collect()] == [14, 3]
    assert [(r.line, r.text) for r in R.searched(spark, str(tmp_path), "TWO").collect()] == [(2, "Two words"), (1, "two")]
    assert R.checksums(spark, str(tmp_path)).count() == 3
