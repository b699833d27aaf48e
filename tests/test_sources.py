"""Sources, sinks, streams and the command line over small files."""

import json

import pytest
from pyspark.sql import functions as F

from orrery.__main__ import main
from orrery.operators import sequences
from orrery.sinks import tables
from orrery.sources import catalog, inventory, records
from orrery.streaming import frames as streams


def test_records_and_skipped_rows(spark, tmp_path):
    lines = ['{"frame_path": "a.png", "source_file": "v", "frame_index": "3", "timestamp_s": 1.5}', "", "no json", "[1]", '{"frame_path": " "}', '{"frame_path": "b.gif"}', '{"frame_path": "c.JPG", "frame_index": true}']
    (tmp_path / "f.jsonl").write_text("\n".join(lines) + "\n")
    found, skipped = records.read_records(spark, str(tmp_path / "f.jsonl"))
    assert sorted(tuple(r) for r in found.select("line", "frame_path", "source_file", "frame_index", "timestamp_s").collect()) == [(1, "a.png", "v", 3, 1.5), (7, "c.JPG", "", 0, 0.0)]
    assert sorted(tuple(r) for r in skipped.select("line", "reason").collect()) == [(3, "invalid JSON"), (4, "expected a JSON object"), (5, "missing frame_path"), (6, "unsupported image type")]
    assert {tuple(r) for r in records.source_summary(found).collect()} == {("v", 1, "image"), ("", 1, "image")}


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = records.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert found.count() == 5000 and found.where(F.col("text") != F.concat(F.lit("line "), F.col("line"))).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_discovery_and_timestamps(spark, tmp_path):
    for name in ("x.MP4", "sub/y.jpeg", "z.jsonl", "w.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"0")
    assert sorted(r[1] for r in records.discover(spark, str(tmp_path)).collect()) == ["image", "video"]
    rows = spark.createDataFrame([("v", f"{i}", 9.0) for i in range(4)] + [("w", "0", 0.0), ("w", "1", 0.0)], "source_file string, frame_path string, duration_s double")
    found = records.with_timestamps(rows).orderBy("source_file", "frame_path").collect()
    assert [r["timestamp_s"] for r in found] == [0.0, 3.0, 6.0, 9.0, 0.0, 1.0]


def test_carry_forward(spark):
    now = spark.createDataFrame([("v", 0, 10), ("v", 1, None), ("v", 2, 7)], "source_file string, frame_index long, cp long")
    earlier = spark.createDataFrame([("v", 0, "detail", True, 10), ("v", 1, "appraisal", True, 44), ("v", 2, "list", True, 9)], "source_file string, frame_index long, cls string, has_cp boolean, cp long")
    assert [tuple(r)[2:] for r in records.carry_forward(now, earlier).orderBy("frame_index").collect()] == [(10, False), (44, True), (7, False)]


def test_workbook_round_trip_and_header_shift(spark, tmp_path):
    df = spark.createDataFrame([("a & <b>", 1, True, 0.5), (None, None, None, None), ("c", -2, False, None)], "name string, n int, ok boolean, x double").coalesce(1)
    tables.write_workbook({"All": df, "Summary": df.limit(1)}, f"file://{tmp_path}/b.xlsx")
    back = inventory.read(spark, f"{tmp_path}/b.xlsx")
    assert [tuple(r) for r in back.collect()] == [("a & <b>", "1", "true", "0.5"), ("c", "-2", "false", None)]
    tables.write_workbook({"s": spark.createDataFrame([("1", "2", "3")], ["a", " ", "b"])}, f"file://{tmp_path}/s.xlsx")
    assert [r.asDict() for r in inventory.read(spark, f"{tmp_path}/s.xlsx").collect()] == [{"a": "1", "b": "2"}]
    with pytest.raises(ValueError):
        inventory.read(spark, "t.ods")


def test_csv_inventory(spark, tmp_path):
    (tmp_path / "i.csv").write_text('﻿Species Name,IV-Attack\n"Pid\ngey",15\n', encoding="utf-8")
    found = inventory.with_aliases(inventory.read(spark, f"{tmp_path}/i.csv"), {"species": ("species_name",), "iv_attack": ()})
    assert [r.asDict() for r in found.collect()] == [{"species": "Pid\ngey", "iv_attack": "15"}]
    with pytest.raises(ValueError):
        inventory.with_aliases(found, {"iv_defense": ()})


def test_catalog_and_templates(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"species": [{"species_key": "a", "forms": ["x"]}, 5, {"species_key": ""}], "base_stats": [{"species_key": "a", "base_attack": 3}], "moves": []}))
    found = catalog.read_catalog(spark, str(tmp_path / "c.json"))
    assert [(r["species_key"], r["forms"]) for r in found["species"].collect()] == [("a", ["x"])]
    assert [(r["form"], r["base_attack"]) for r in found["base_stats"].collect()] == [("Normal", 3)]
    assert found["moves"].count() == found["evolutions"].count() == 0
    items = [{"templateId": "outer", "data": {"k": 1}}, {"templateId": "flat"}]
    for name, root in (("l", items), ("o", {"itemTemplates": items}), ("t", {"templates": items})):
        (tmp_path / f"{name}.json").write_text(json.dumps(root))
        assert [r[0] for r in catalog.templates(spark, str(tmp_path / f"{name}.json")).select("template_id").collect()] == ["outer", "flat"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("KEEP", True, 1.23456789), ("KEEP", None, 2.0), ("<x>", False, None)], "recommendation string, ok boolean, timestamp_s double").coalesce(1)
    tables.write_csv(df, f"{tmp_path}/c", ["ok", "recommendation"])
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text.splitlines() == ["ok,recommendation", "True,KEEP", ",KEEP", "False,<x>"]
    tables.write_records(df, f"{tmp_path}/j", ["timestamp_s"])
    lines = [json.loads(x) for f in sorted((tmp_path / "j").glob("*.json")) for x in f.read_text().splitlines()]
    assert {x.get("timestamp_s") for x in lines} == {1.234568, 2.0, None}
    assert tables.write_manifest(df, df.select("recommendation"), f"file://{tmp_path}/m.json")["counts"] == {"total": 3, "KEEP": 2, "REVIEW": 0, "LET-GO": 0}
    tables.write_cards(df, f"file://{tmp_path}/s.html", "t", "ok")
    assert "&lt;x&gt;" in (tmp_path / "s.html").read_text() and "ignored candidate values: " in (tmp_path / "s.html").read_text()


def test_stream_latch_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", i, i % 7 == 0, i % 5 != 0) for i in range(90)]
    schema = "source string, at long, a boolean, b boolean"
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = streams.latch(stream, "source", "at", F.col("a"), F.col("b")).writeStream.format("memory").queryName("latched").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert sink.awaitTermination(90)
    want = sequences.latch(spark.createDataFrame(rows, schema), ["source"], ["at"], F.col("a"), F.col("b")).select("source", "at", "flag")
    assert {tuple(r) for r in spark.table("latched").collect()} == {tuple(r) for r in want.collect()}


def test_sessions(spark):
    rows = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:20:00'), ('a', timestamp'2024-01-01 02:00:00') as t(source, ts)")
    assert sorted(r["frames"] for r in streams.sessions(rows, "source", "ts").collect()) == [1, 2]


def test_command_line(spark, small_dir, tmp_path, capsys):
    assert main(["list"]) == 0 and "q_cp_parse" in capsys.readouterr().out
    assert main(["run", "q_cp_parse", "--data", small_dir, "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
