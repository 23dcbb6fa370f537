"""Line readers over files cut into blocks, label files, and results published as a whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reelmill.operators import labels as lb
from reelmill.sources import canonical, results


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_are_numbered_over_blocks(spark, tmp_path, small_blocks, end):
    rng, want = random.Random(1), []
    for name, n in (("a_frames", 120), ("sub/b_frames", 3), ("c_frames", 0), ("d_frames", 70)):
        lines = [rng.choice(["", "  ", "\t"]) if rng.random() < 0.3 else json.dumps({"frame_id": i, "pad": "x" * rng.randrange(60)}) for i in range(n)]
        path = tmp_path / f"{name}.jsonl"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(end.join(lines).encode() + (end.encode() if n == 70 else b""))
        full = [(i + 1, t) for i, t in enumerate(lines) if t.strip()]
        want += [(path.name, at, k + 1, json.loads(t)["frame_id"]) for k, (at, t) in enumerate(full)]
    read = canonical.read_json_lines(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() > 3
    got = read.select(F.regexp_extract("file", "[^/]+$", 0).alias("f"), "line_no", "row_no", F.try_variant_get("record", "$.frame_id", "int").alias("id")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_usual_names_come_first_and_none_is_an_error(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "other.jsonl").write_text('{"a": 1}\n')
    assert canonical.read_json_lines(spark, str(tmp_path)).count() == 1
    (tmp_path / "x" / "run_frames.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert canonical.read_json_lines(spark, str(tmp_path)).count() == 2
    assert canonical.read_json_lines(spark, str(tmp_path), "*.jsonl").count() == 3
    assert canonical.read_json_lines(spark, str(tmp_path / "x" / "other.jsonl")).count() == 1
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError, match="no JSON lines"):
        canonical.read_json_lines(spark, str(tmp_path / "y"))
    with pytest.raises(ValueError, match="JSON lines"):
        canonical.read_json_lines(spark, str(tmp_path / "y" / "notes.txt"))


def test_a_line_holds_one_object(spark, tmp_path):
    lines = ['{"frame_id":1} {"frame_id":2}', '{"frame_id":3}', '{"frame_id":4},"end"]', "[1]", '"x"', '{"frame_id":5', ' {"frame_id": 6} ']
    (tmp_path / "r_frames.jsonl").write_text("\n".join(lines))
    read = canonical.read_json_lines(spark, str(tmp_path))
    assert sorted(r.line_no for r in canonical.bad_lines(read).collect()) == [1, 3, 4, 5, 6]


def test_label_files(spark, tmp_path):
    rows = [
        {"dataset": " d ", "sequence": "s", "frame_id": 1, "memory_update": "x", "source": "m"}, {"source_dataset": "d", "source_sequence": "s", "frame_id": 2, "memory_update": None, "verified_null": True},
        {"dataset": "d", "sequence": "s", "frame_id": 1, "memory_update": "y"}, {"dataset": "d", "sequence": "s", "memory_update": "y"}, {"dataset": "d", "sequence": "s", "frame_id": 3},
        {"dataset": "", "sequence": "s", "frame_id": 3, "memory_update": "y"}, {"dataset": "d", "sequence": "s", "frame_id": -3, "memory_update": "y"}, {"dataset": "d", "sequence": "s", "frame_id": "x", "memory_update": "y"}, [1],
    ]
    (tmp_path / "labels.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r.line_no: r for r in lb.read_label_lines(canonical.read_json_lines(spark, str(tmp_path))).collect()}
    assert [got[i + 1].problem for i in range(9)] == [None, None, "duplicate_label", "missing_field", "missing_field", "missing_field", "bad_frame_id", "bad_frame_id", "not_an_object"]
    assert (got[1].dataset, got[1].memory_update, got[1].source, got[2].verified_null, got[2].memory_update) == ("d", "x", "m", True, None)


def rows_of(spark, sequences, expected=None, bad=None):
    made = []
    for s, n in sequences.items():
        for i in range(n):
            box = [1.0, 2.0, 3.0] if (s, i) == bad else [1.0, 2.0, float("nan"), 4.0] if i == 1 else None if i == 2 else [i + 0.5, 2.0, 3.0, 4.0]
            made.append(("d", s, i, box, 0.25, json.dumps({"frame": i}), (expected or {}).get(s, n)))
    return spark.createDataFrame(made, results.SCHEMA).repartition(5)


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_results_are_published_whole(spark, tmp_path):
    results.write_results(rows_of(spark, {"a": 4, "b": 1}), str(tmp_path), tracker="t", parameter="p", extra='{"debug_limited": true}')
    assert files(tmp_path) == sorted(f"d/{s}{end}" for s in "ab" for end in (".txt", "_time.txt", "_frames.jsonl", "_manifest.json"))
    assert (tmp_path / "d" / "a.txt").read_text() == "0.500000\t2.000000\t3.000000\t4.000000\nnan\tnan\tnan\tnan\nnan\tnan\tnan\tnan\n3.500000\t2.000000\t3.000000\t4.000000\n"
    assert (tmp_path / "d" / "a_time.txt").read_text() == "0.250000000\n" * 4
    assert [json.loads(x)["frame"] for x in (tmp_path / "d" / "a_frames.jsonl").read_text().splitlines()] == [0, 1, 2, 3]
    manifest = json.loads((tmp_path / "d" / "a_manifest.json").read_text())
    assert (manifest["completed"], manifest["frames_written"], manifest["expected_frames"], manifest["error"], manifest["extra"]) == (True, 4, 4, None, {"debug_limited": True})
    with pytest.raises(Exception, match="has results already"):
        results.write_results(rows_of(spark, {"a": 4}), str(tmp_path))
    assert json.loads((tmp_path / "d" / "a_manifest.json").read_text()) == manifest
    results.write_results(rows_of(spark, {"a": 2}), str(tmp_path), overwrite=True)
    assert json.loads((tmp_path / "d" / "a_manifest.json").read_text())["frames_written"] == 2


def test_short_sequences_stay_partial_until_they_are_whole(spark, tmp_path):
    results.write_results(rows_of(spark, {"a": 2, "b": 2}, {"a": 5}), str(tmp_path))
    assert [f for f in files(tmp_path) if f.startswith("d/a")] == ["d/a.partial.txt", "d/a_frames.partial.jsonl", "d/a_manifest.partial.json", "d/a_time.partial.txt"]
    assert json.loads((tmp_path / "d" / "a_manifest.partial.json").read_text())["completed"] is False
    results.write_results(rows_of(spark, {"a": 5}), str(tmp_path))
    assert [f for f in files(tmp_path) if f.startswith("d/a")] == ["d/a.txt", "d/a_frames.jsonl", "d/a_manifest.json", "d/a_time.txt"]


@pytest.mark.parametrize("gap", [False, True])
def test_a_failing_task_leaves_partial_files_only(spark, tmp_path, gap):
    rows = rows_of(spark, {f"s{i}": 4 for i in range(12)}, bad=None if gap else ("s7", 3))
    rows = rows.where("not (sequence = 's7' and frame_id = 2)") if gap else rows
    with pytest.raises(Exception, match="must follow|four numbers"):
        results.write_results(rows, str(tmp_path))
    left = files(tmp_path)
    assert left and all(".partial." in f for f in left) and "d/s7_manifest.partial.json" in left
    error = json.loads((tmp_path / "d" / "s7_manifest.partial.json").read_text())["error"]
    assert error["type"] == "ValueError"


def test_report_has_every_section(spark, sf_dir):
    from reelmill.sources.fixtures import frames
    from reelmill.sources.report import evaluation_report

    made = evaluation_report(frames(spark, sf_dir))
    for part in ("# Evaluation report", "## For comparison only: dense convention", "## Conventions", "`hold_last`", "## Localisation of visible targets", "## Presence", "TP / FP / TN / FN", "## Identity", "## Recovery", "## Execution", "- `ok`: "):
        assert part in made, part
    bare = frames(spark, sf_dir).where("frame_id = 0").withColumns({"gt_identity": F.lit(None).cast("string"), "is_observation_frame": F.lit(True)})
    made = evaluation_report(bare)
    assert "No frame says whose the target is" in made and "## Main figures" in made and "| Reappearances | 0 |" in made and "| Recovery rate | N/A |" in made


def test_logs_images_and_records(spark, tmp_path):
    from reelmill.sources import scan, sinks

    lines = ['{"loss": 0.5, "global_step/max_steps": "10/200"}', '{"loss": 0.4}', '{"global_step/max_steps": "20/200"}', '{"loss": 0.3, "global_step/max_steps": "30/200", "x": 1}', '{"loss": 1, "global_step/max_steps": "x/200"}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = scan.training_log(canonical.read_json_lines(spark, str(tmp_path / "log.jsonl")))
    assert sorted(map(tuple, log.collect())) == [(10, 0.5), (30, 0.3)]
    folder = tmp_path / "img" / "s"
    folder.mkdir(parents=True)
    for name in ("2.jpg", "10.jpg", "1.PNG", "a.txt", "1.png"):
        (folder / name).write_bytes(b"x")
    found = scan.image_files(spark, str(tmp_path / "img")).orderBy("at").collect()
    assert [(r.at, r.name, r.folder) for r in found] == [(0, "1.png", "s"), (1, "2.jpg", "s"), (2, "10.jpg", "s")]
    records = spark.createDataFrame([(1, float("nan"), "f.jsonl")], "id int, score double, _file string")
    sinks.write_records(records, str(tmp_path / "records"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "records")).collect()] == [{"id": 1}]


def test_datasets_that_can_t_reach_a_ratio(spark):
    from reelmill.operators.planning import infeasible

    pool = spark.createDataFrame([("a", 10, 0, 2), ("a", 10, 0, 3), ("b", 10, 0, 9), ("c", 10, 8, 9)], "dataset string, target long, min_absent long, max_absent long")
    assert {(r.dataset, r.goal, r.least, r.most) for r in infeasible(pool, 0.3).collect()} == {("a", 6, 0, 5), ("c", 3, 8, 9)}
