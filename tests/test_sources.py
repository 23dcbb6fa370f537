"""Scans, canonical frames and sinks, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from reelmill.operators import audit
from reelmill.sources import canonical, scan, sinks


def put(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


def test_records_of_three_shapes(spark, tmp_path):
    rows = [
        {"sequence_name": "a", "frame_num": 3, "ground_truth_rect": [1, 2, 3, 4], "target_bbox": [1, 2, 3, 4]},
        {"sequence": "a", "frame_id": 4, "target_bbox": None, "execution": {"status": "OK"}, "prediction": {"bbox_xywh": [1, 1, 5, 5], "target_presence": "Not Found"}, "ground_truth": {"target_presence": True, "bbox_xywh": [0, 0, 0, 4]}},
        {"prediction": {"bbox": {"x1": 100, "y1": 100, "x2": 300, "y2": 500}, "bbox_format": "norm1000-xyxy", "image_size": [200, 100]}, "gt_bbox": None, "error_type": "ValueError", "is_keyframe": False},
        {"video": "b", "dataset": "lasot", "skipped": True, "pred_identity": "N/A", "gt_identity": False, "target_visible": 0},
    ]
    text = "\n".join(map(json.dumps, rows)) + "\n\n[1]\nnot json\n"
    lines = canonical.read_json_lines(spark, put(tmp_path, {"run/clip_frames.jsonl": text}))
    assert [r.line_no for r in canonical.bad_lines(lines).orderBy("line_no").collect()] == [6, 7]
    got = {(r.sequence, r.frame_id): r for r in canonical.canonical_frames(lines.where("record is not null")).collect()}
    a3, a4, clip, b = got["a", 3], got["a", 4], got["clip", 2], got["b", 3]
    assert tuple(a3.gt) == tuple(a3.pred) == (1, 2, 3, 4) and a3.gt_presence == a3.pred_presence == "present" and a3.dataset == "default"
    assert a4.pred is None and a4.gt is None and a4.pred_presence == "absent" and a4.gt_presence == "present" and a4.execution_status == "ok"
    assert [round(v, 6) for v in clip.pred] == [20, 10, 40, 40] and clip.execution_status == "internal_error"
    assert clip.pred_presence is None and clip.gt_presence == "absent" and clip.is_observation_frame is False
    assert (b.execution_status, b.pred_identity, b.gt_identity, b.gt_presence, b.pred_presence, b.dataset) == ("skipped", "not_applicable", "different", "absent", None, "lasot")


def test_folders(spark, tmp_path):
    path = put(tmp_path, {
        "car-1/groundtruth.txt": "1,2,3,4\n5,6,nan,8\n", "car-1/full_occlusion.txt": "0,1\n", "car-1/out_of_view.txt": "0,0\n",
        "dog-2/groundtruth.txt": "1 2 3 4\n5 6 0 8\n", "list.txt": "# note\ncar-1\n\ncar-1\n../x\n",
    })
    names = scan.subset_names(spark, f"{path}/list.txt")
    assert [(r.name, r.problem) for r in names.orderBy("at").collect()] == [("car-1", None), ("car-1", "duplicate"), ("../x", "unsafe")]
    frames = scan.scan_flagged(spark, path, names.where("problem is null")).orderBy("frame_id").collect()
    assert [(r.sequence, r.gt_presence, r.object_class, r.gt is None) for r in frames] == [("car-1", "present", "car", False), ("car-1", "absent", "car", True)]
    found = scan.scan_discovered(spark, path).orderBy("sequence", "frame_id").collect()
    assert [(r.sequence, r.gt_presence) for r in found] == [("car-1", "present"), ("car-1", "absent"), ("dog-2", "present"), ("dog-2", "absent")]
    assert scan.scan_absent_files(spark, path, names.where("problem is null")).where("gt_presence is not null").count() == 0
    assert scan.load_dataset(spark, "tnl2k", path, only=["dog-2"]).count() == 2


def test_benchmark_folder_and_problems(spark, tmp_path):
    path = put(tmp_path, {"s/groundtruth.txt": "1,2,3,4\n1,2,0,4\n1,2,3,4\n", "s/target_status.txt": "1\n1\n0\n", "s/keyframes.txt": "0 # first\n2\n"})
    frames = scan.scan_benchmark(spark, path)
    assert [r.is_observation_frame for r in frames.orderBy("frame_id").collect()] == [True, False, True]
    assert [(r.frame_id, r.problem, r.severity) for r in scan.benchmark_problems(frames).collect()] == [(1, "present_without_valid_box", "warning")]


def test_natural_order_and_text(spark):
    names = spark.createDataFrame([("img10.jpg",), ("img2.jpg",), ("IMG1.jpg",)], "n string")
    assert [r.n for r in names.orderBy(scan.natural_key(F.col("n"))).collect()] == ["IMG1.jpg", "img2.jpg", "img10.jpg"]
    assert [r[0] for r in spark.createDataFrame([(" a \n",), (" ",), (None,)], "t string").select(scan.optional_text(F.col("t"))).collect()] == ["a", None, None]


def test_segments_drop_with_reason(spark, tmp_path):
    from reelmill.operators.labels import clean_segments

    action = {"a1": {"start_frame": " 0 ", "end_frame": 99, "description": "walks  on"}, "a2": {"start_frame": 5, "end_frame": 2, "description": "x"}, "a3": {"start_frame": None, "end_frame": 2, "description": "x"}, "a4": {"start_frame": 1, "end_frame": 2, "description": " "}}
    put(tmp_path, {"clip.json": json.dumps({"action": action})})
    raw = scan.action_segments(scan.whole_files(spark, str(tmp_path), "*.json"))
    got = {r.name: (r.sequence, r.start_frame, r.text, r.drop_reason) for r in clean_segments(raw).collect()}
    assert got["a1"] == ("clip", 0, "Walks on", None)
    assert [got[k][3] for k in ("a2", "a3", "a4")] == ["end_lt_start(5>2)", "missing_frame_bounds", "empty_description"]


def test_sinks(spark, tmp_path):
    frames = spark.createDataFrame([("d", "s", i, float("nan") if i else 1.0) for i in range(3)], "dataset string, sequence string, frame_id int, score double")
    sinks.write_frames(frames, str(tmp_path / "frames"))
    back = spark.read.json(str(tmp_path / "frames"))
    assert back.count() == 3 and back.where("score is not null").count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_frames(frames, str(tmp_path / "frames"))
    expected = spark.createDataFrame([("d", "s", 3), ("d", "t", 2)], "dataset string, sequence string, expected_frames int")
    assert {r.sequence: r.completed for r in sinks.manifests(frames, expected).collect()} == {"s": True, "t": False}
    nested = frames.select("sequence", F.struct(F.lit(1.0).alias("x"), F.array(F.lit(2)).alias("l")).alias("b"))
    assert sinks.flattened(nested).columns == ["sequence", "b.x"]
    report = sinks.write_scores(frames.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")), nested, str(tmp_path / "out"))
    assert "d | 3" in report
    assert sinks.checksums(spark, str(tmp_path / "frames"), "*.json").count() >= 1


def test_strict_raises(spark):
    audit.strict(spark.range(0), "nothing")
    with pytest.raises(ValueError, match="ids"):
        audit.strict(spark.range(2), "ids")


def test_default_frame_ids_count_no_blank_lines(spark, tmp_path):
    (tmp_path / "run_frames.jsonl").write_text('{"gt_presence": "present"}\n\n \t\n{"gt_presence": "absent"}\n')
    lines = canonical.read_json_lines(spark, str(tmp_path))
    assert [(r.line_no, r.row_no) for r in lines.orderBy("line_no").collect()] == [(1, 1), (4, 2)]
    assert [r.frame_id for r in canonical.canonical_frames(lines).orderBy("frame_id").collect()] == [0, 1]
