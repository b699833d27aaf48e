"""Artefacts of runs: seen whole or not at all."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from orrery.sinks import runs


@pytest.fixture
def some(spark):
    return spark.createDataFrame([(1, "a<b>&'\"", None, {"x": 1.5}, True), (2, "two\nlines, and more", 0.1, {}, False), (3, None, None, None, None)], "id int, text string, v double, m map<string,double>, ok boolean")


def test_a_run_that_stops_half_way_is_not_seen(spark, tmp_path, some):
    root = str(tmp_path / "runs")
    assert runs.runs(spark, root) == []
    half = runs.Run(spark, root, "r1")
    half.table("rows", some)
    assert runs.runs(spark, root) == []
    with pytest.raises(FileNotFoundError):
        runs.read(spark, root, "r1", "rows")
    whole = runs.Run(spark, root, "r1")
    whole.table("rows", some)
    whole.table("lines", some.drop("m"), "json")
    whole.table("sheet", some.select("id", "text"), "csv")
    whole.table("none", some.limit(0))
    whole.document("note", {"é": [1]})
    assert runs.runs(spark, root) == []
    manifest = whole.commit()
    assert runs.runs(spark, root) == ["r1"] and runs.manifest(spark, root, "r1") == json.loads(json.dumps(manifest))
    assert {k: v["rows"] for k, v in manifest["tables"].items()} == {"rows": 3, "lines": 3, "sheet": 3, "none": 0}
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(runs.read(spark, root, "r1", "rows")) == key(some)
    assert key(runs.read(spark, root, "r1", "lines")) == key(some.drop("m"))
    assert key(runs.read(spark, root, "r1", "sheet")) == key(some.select(F.col("id").cast("string"), "text"))
    assert runs.read(spark, root, "r1", "none").columns == some.columns and runs.read(spark, root, "r1", "none").count() == 0
    assert runs.damaged(spark, root, "r1") == []
    assert len(glob.glob(f"{root}/r1/*")) == 2 and runs.sweep(spark, root, "r1") == 1 and runs.damaged(spark, root, "r1") == []


def test_a_later_run_takes_the_place_and_damage_shows(spark, tmp_path, some):
    root = str(tmp_path / "runs")
    for n in (2, 3):
        run = runs.Run(spark, root, "r")
        run.table("rows", some.where(F.col("id") <= n))
        run.table("again", some.repartition(n))
        run.commit()
    assert runs.read(spark, root, "r", "rows").count() == 3
    digests = runs.manifest(spark, root, "r")["tables"]
    assert digests["rows"]["digest"] == digests["again"]["digest"]  # parts and order don't matter
    about = runs.manifest(spark, root, "r")["tables"]["rows"]
    for f in glob.glob(f"{root}/r/{about['path']}/*.parquet"):
        os.unlink(f)
    assert runs.damaged(spark, root, "r") == ["rows"]
    for bad in ("", "_x", "a/b", ".h"):
        with pytest.raises(ValueError):
            runs.Run(spark, root, bad)
    with pytest.raises(ValueError):
        run.table("rows", some)
    with pytest.raises(ValueError):
        runs.Run(spark, root, "z").table("rows", some, "xlsx")


def test_cards(spark, some):
    lines = [r[0] for r in runs.cards(some.orderBy("id"), "ok").collect()]
    assert lines[0] == '<section>ignored candidate values: id: 1, text: a&lt;b&gt;&amp;&#x27;&quot;, m: {&quot;x&quot;:1.5}</section>' and lines[1].startswith("<section>id: 2, text: two lines, and more, v: 0.1")


def test_artefacts_of_scans_and_exports(spark, tmp_path):
    root = str(tmp_path / "runs")
    frames = spark.createDataFrame([("a", i, ["list", "detail"][i % 2], {"ocr": 0.5, "load": 0.1}) for i in range(6)], "source_file string, frame_index long, classification string, timing map<string,double>")
    fragments = spark.createDataFrame([("a", 1, "detail")], "source_file string, frame_index long, fragment_type string")
    warnings = spark.createDataFrame([("input", "x")], "phase string, message string")
    manifest = runs.write_scan(runs.Run(spark, root, "scan"), frames, fragments, warnings, {"visual": 2.0}, 3.0)
    assert manifest["documents"]["classification_counts"] == {"detail": 3, "list": 3} and manifest["documents"]["fragment_counts"] == {"detail": 1}
    assert manifest["documents"]["timing_profile"]["phases"]["visual"]["s"] == 2.0 and manifest["tables"]["audit"]["rows"] == 6
    events = spark.createDataFrame([("deleted", "x"), ("processed", "extracted"), ("processed", None)], "action string, reason string")
    rows = spark.createDataFrame([("Abc", 1)], "species string, cp int")
    done = runs.write_export(runs.Run(spark, root, "export"), rows, warnings, events, fragments, {"visual": 2.0}, 3.0, {"frames": 6})
    assert done["documents"]["counts"] == {"rows": 1, "frames": 6} and done["documents"]["warning_count"] == 1
    assert {(x["action"], x["reason"]): x["n"] for x in done["documents"]["lifecycle"]}[("deleted", "x")] == 1
    assert runs.runs(spark, root) == ["export", "scan"] and runs.read(spark, root, "export", "inventory").collect() == [("Abc", "1")]
