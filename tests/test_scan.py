"""From pictures to an inventory: broken pictures, missing texts, transitions."""

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import scan

PICTURES = "source_file string, frame_index long, width int, height int, pixels binary"
TEXTS = "source_file string, frame_index long, source_type string, timestamp_s double, ocr_cp string, ocr_hp string, ocr_weight string"


def detail(shift=0):
    image = np.full((320, 180, 3), 250, np.uint8)
    image[104:120, 30:50] = 0
    image[205:215, 10:170] = 0
    image[90:100, 20 + shift : 60 + shift] = 60
    return image.tobytes()


def test_frames_that_fail_or_have_no_texts(spark):
    pictures = [("a", 0, 180, 320, detail()), ("a", 1, 180, 320, b"cut"), ("a", 2, 180, 320, detail()), ("b", 0, 180, 320, detail()), ("a", 2, 180, 320, detail())]
    texts = [("a", 0, "video", 0.0, "CP 150", "5 / 60 HP", "1.5 kg"), ("a", 1, "video", 0.1, "CP 150", None, None), ("a", 0, "video", 0.0, "CP 150", "5 / 60 HP", "1.5 kg"), ("z", 9, "video", 0.0, "CP 1", None, None)]
    found = {(r["source_file"], r["frame_index"]): r for r in scan.frames(spark.createDataFrame(pictures, PICTURES), spark.createDataFrame(texts, TEXTS)).collect()}
    assert set(found) == {("a", 0), ("a", 1), ("a", 2), ("b", 0)}
    a, broken, bare = found["a", 0], found["a", 1], found["b", 0]
    assert (a["classification"], a["cp"], a["hp"], a["weight_kg"], a["seq"], a["has_cp"]) == ("detail", 150, "5/60", "1.5", 0, True) and a["seq_id"] is not None
    assert (broken["classification"], broken["raw_classification"], broken["seq_id"], broken["notes"]) == ("non_extractable", "error", None, ["Frame analysis failed."])
    assert found["a", 2]["seq"] == 1  # the broken frame breaks the run
    assert bare["classification"] == "detail" and bare["cp"] is None and bare["has_cp"] is False
    notes = scan.warnings(scan.frames(spark.createDataFrame(pictures, PICTURES), spark.createDataFrame(texts, TEXTS))).collect()
    assert [(r["source_file"], r["frame_index"], r["message"]) for r in notes] == [("a", 1, "3 octets for 180 x 320 pixels")]


def test_nothing_in_nothing_out(spark):
    empty = spark.createDataFrame([], PICTURES)
    species = spark.createDataFrame([], "species_key string, species_name string, pokedex_id int, aliases array<string>")
    moves = spark.createDataFrame([], "move_key string, move_name string, move_type string, category string, upstream_ids array<string>")
    rows, diagnostics, frames = scan.export(empty, spark.createDataFrame([], TEXTS), species, moves)
    assert rows.count() == diagnostics.count() == frames.count() == 0


def test_summary_line():
    assert scan.summary_line({"list": 2, "detail": 5, "appraisal": 2}) == "9 frames: 5 detail, 2 appraisal, 2 list" and scan.summary_line({}) == "0 frames"


def test_export_command(spark, tmp_path, capsys):
    import json

    from orrery.__main__ import main
    from orrery.sinks import runs

    spark.createDataFrame([("a", i, 180, 320, detail()) for i in range(3)], PICTURES).write.parquet(str(tmp_path / "pictures.parquet"))
    (tmp_path / "texts.jsonl").write_text("".join(json.dumps({"source_file": "a", "frame_index": i, "source_type": "video", "timestamp_s": i / 3, "ocr_cp": "CP 150", "ocr_hp": "5 / 60 HP", "ocr_weight": "1.5 kg"}) + "\n" for i in range(3)))
    (tmp_path / "catalog.json").write_text(json.dumps({"species": [{"species_key": "a", "species_name": "A", "pokedex_id": 1}], "moves": [], "evolutions": [], "base_stats": [], "cp_multipliers": []}))
    root = str(tmp_path / "out")
    assert main(["export", "--pictures", str(tmp_path / "pictures.parquet"), "--texts", str(tmp_path / "texts.jsonl"), "--catalog", str(tmp_path / "catalog.json"), "--output", root, "--run", "one"]) == 0
    assert "3 frames: 3 detail; 0 rows, 0 warnings" in capsys.readouterr().out
    assert runs.runs(spark, root) == ["one"] and runs.read(spark, root, "one", "row_diagnostics").count() == 1 and runs.damaged(spark, root, "one") == []


def test_shapes_are_told_where_they_are_drawn(spark, small_dir):
    from orrery.plans import pictures

    plan = pictures._creatures(spark, small_dir)[0].rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS shapes") < plan.index("RepartitionByExpression")
