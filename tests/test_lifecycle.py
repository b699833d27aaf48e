"""Files of frames: guards, states, deletion that may run again, and peaks against a loop."""

import os
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import lifecycle

SCHEMA = "source_file string, frame_index long, frame_path string, at long, action string, reason string, phase string"


def test_guards(spark):
    root = "/data/run/frames"
    cases = {
        "/data/run/frames/frame_1.png": True, "file:///data/run/frames/frame_1.png": True, "file:/data/run/frames/a/frame_2.png": True, "/data/run/frames/frame_1__cp.png": False, "/data/run/frames/photo.png": False,
        "/data/run/frames/../frame_1.png": False, "/data/run/frames2/frame_1.png": False, "/data/run/frames/./frame_1.png": False, "/data/run/frame_1.png": False, "frame_1.png": False, "": False, None: False, "/data/run/frames/frame_src.png": False,
    }
    df = spark.createDataFrame([(p, "/data/run/frames/frame_src.png") for p in cases], "p string, o string")
    for base in (root, root + "/", "file://" + root):
        assert {r[0]: r[1] for r in df.select("p", lifecycle.is_ours(F.col("p"), base, F.col("o"))).collect()} == cases


def test_states(spark):
    rows = [("a", 1, "", 1, "processed", "extracted", ""), ("a", 1, "", 2, "processed", "visual_analysis", ""), ("a", 2, "", 1, "processed", "extracted", ""), ("a", 2, "", 5, "deleted", "completed_sequence_released", ""), ("a", 2, "", 5, "processed", "cp", "")]
    rows += [("a", 3, "", 1, "processed", "extracted", ""), ("a", 3, "", 2, "skipped", "skip:budget", ""), ("a", 4, "", 9, "retained", "unsafe", ""), ("a", 5, "", 1, "skipped", "x:already_absent", ""), ("a", 6, "", None, "deleted", "x", ""), ("a", 7, "", 3, None, None, "")]
    found = {r["frame_index"]: (r["state"], r["at"]) for r in lifecycle.states(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: ("protected", 2), 2: ("released", 5), 3: ("held", 1), 4: ("retained", 9), 5: ("released", 1)}


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_peaks_equal_a_loop(spark, tasks):
    rng = random.Random(3)
    rows = []
    for s in ["a", "a", "b", "c", None]:
        for i in range(rng.randrange(0, 150)):
            t = rng.randrange(500)
            rows.append((s, i, "", t, "processed", "extracted", ""))
            if rng.random() < 0.7:
                rows.append((s, i, "", t + rng.randrange(0, 60), "deleted", "x", ""))
            rows.append((s, i, "", t, "processed", "cp", ""))
    rows += [("d", 1, "", 5, "deleted", "x", ""), ("e", 1, "", None, "processed", "extracted", "")]
    want = {}
    for s in {r[0] for r in rows}:
        held = most = 0
        events = sorted((r[3], -(1 if r[5] == "extracted" else -1)) for r in rows if r[0] == s and r[3] is not None and (r[5] == "extracted" or r[4] == "deleted"))
        for _, d in events:
            held -= d
            most = max(most, held)
        if events:
            want[s] = most
    found = lifecycle.peaks(spark.createDataFrame(rows, SCHEMA), 20, tasks)
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == {k: (v, v > 20) for k, v in want.items()}
    assert {r[0] for r in lifecycle.limit_warnings(found, 20).collect()} == {k for k, v in want.items() if v > 20}


def test_release_may_run_again(spark, tmp_path):
    root = tmp_path / "frames"
    root.mkdir()
    outside = tmp_path / "keep.png"
    for p in [*(root / f"frame_{i}.png" for i in range(4)), root / "frame_9__cp.png", outside]:
        p.write_bytes(b"x")
    os.symlink(outside, root / "frame_link.png")
    paths = [*(str(root / f"frame_{i}.png") for i in range(3)), str(root / "frame_9__cp.png"), str(outside), f"{root}/../keep.png", str(root / "frame_link.png"), None]
    df = spark.createDataFrame([("a", i, p, c) for i, (p, c) in enumerate(zip(paths, ["list", "detail", "non_extractable", *["list"] * 5]))], "source_file string, frame_index long, frame_path string, raw_classification string")
    asked = lifecycle.unused(df)
    first = {r["frame_index"]: (r["action"], r["reason"]) for r in lifecycle.release(asked, str(root), F.col("reason")).collect()}
    assert first == {0: ("deleted", "classified:list"), 2: ("deleted", "classified:non_extractable"), **{i: ("retained", "unsafe_or_non_export_frame_path") for i in (3, 4, 5, 6)}, 7: ("skipped", "unsafe_or_non_export_frame_path")}
    again = {r["frame_index"]: (r["action"], r["reason"]) for r in lifecycle.release(asked, str(root), F.col("reason")).collect()}
    assert again[0] == ("skipped", "classified:list:already_absent") and outside.exists() and (root / "frame_1.png").exists() and (root / "frame_link.png").exists()


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "events")
    batch = spark.createDataFrame([("a", i, "", i, "processed", "extracted", "") for i in range(5)], SCHEMA)
    for n in (0, 0, 1, 0):
        lifecycle.append_batch(batch.withColumn("at", F.col("at") + 100 * n), folder, n)
    assert spark.read.parquet(folder).count() == 10
