"""What runs beside Spark, reports, boxes and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from orrery import runtime
from orrery.__main__ import main
from orrery.functions import geometry
from orrery.operators import reports


def test_retries_halve_the_workers():
    tries = {}

    def work(item):
        tries[item] = tries.get(item, 0) + 1
        if item == "never" or (item == "late" and tries[item] < 3):
            raise OSError(item)
        return item.upper()

    found = runtime.with_retries(["a", "late", "never"], work, workers=8, attempts=3)
    assert found.results == {"a": "A", "late": "LATE"} and list(found.errors) == ["never"] and found.attempts == {"a": 1, "late": 3, "never": 3}
    assert [(e["workers"], e["items"], e["failed"]) for e in found.events] == [(3, 3, 2), (1, 2, 2), (1, 2, 1)]
    assert runtime.worker_count("auto", 1) == 1 and runtime.worker_count(3, 9) == 3 and runtime.worker_count(None, 0) == 1
    for bad in ("0", "x"):
        with pytest.raises(ValueError, match="workers"):
            runtime.worker_count(bad, 3)


def test_phases_and_log(tmp_path):
    ticks = iter(range(100))
    phases = runtime.Phases(lambda: float(next(ticks)))
    for _ in range(2):
        with phases.run("x"):
            pass
    assert phases.totals == {"x": 2.0} and phases.whole() == 5.0
    log = runtime.ProgressLog(f"{tmp_path}/log.tsv", lambda: 1.5)
    log.reset()
    log.add("scan", 3, "a\tb", ["cp", "hp"])
    lines = (tmp_path / "log.tsv").read_text().splitlines()
    assert lines[0].split("\t") == list(log.HEAD) and lines[1].split("\t")[2:] == ["scan", "3", "a b", "cp,hp"]


def test_reports(spark):
    frames = spark.createDataFrame([("a", 0, 0, "detail", {"x": 1.0, "y": 3.0}), ("a", 1, 0, "list", {"x": 2.0}), ("b", 0, None, "detail", {"y": 2.0})], "source_file string, frame_index long, seq long, classification string, timing map<string, double>")
    assert [(r["operation"], r["total_s"], r["frames"], r["share"]) for r in reports.operations(frames).collect()] == [("y", 5.0, 2, 62.5), ("x", 3.0, 2, 37.5)]
    assert [(r["source_file"], r["total_s"]) for r in reports.slowest_frames(frames).collect()] == [("a", 4.0), ("a", 2.0), ("b", 2.0)]
    assert [(r["seq"], r["total_s"], r["frames"]) for r in reports.slowest_sequences(frames).collect()] == [(0, 6.0, 2)]
    assert reports.profile(frames, {"scan": 5.0}, 10.0)["phases"] == {"scan": {"s": 5.0, "share": 50.0}} and reports.profile(frames, {}, 0.0)["classes"] == {"detail": 2, "list": 1}
    events = spark.createDataFrame([("scan", 1, 4, 10, 2), ("scan", 2, 2, 2, 0)], "phase string, attempt int, workers int, items int, failed int")
    assert tuple(reports.workers(events).first()) == ("scan", 2, 1, 4, 12, 2)
    asked = spark.createDataFrame([([(3, ["cp", "hp"]), (2, ["cp"])],), ([(1, ["cp"])],)], "read array<struct<frame: long, fields: array<string>>>")
    assert [tuple(r) for r in reports.asked_groups(asked).collect()] == [("cp", 2), ("cp,hp", 1)]
    assert {r["source_file"]: (r["frames"], r["detail"]) for r in reports.sources(frames).collect()} == {"a": (2, 1), "b": (1, 1)}
    kept = spark.createDataFrame([("deleted", "list"), ("deleted", "used"), ("kept", "open")], "action string, reason string")
    assert {(r["action"], r["reason"]): r["n"] for r in reports.lifecycle(kept).collect()} == {("deleted", None): 2, ("kept", None): 1, ("deleted", "list"): 1, ("deleted", "used"): 1, ("kept", "open"): 1}


def test_boxes_and_windows(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = lambda *xs: F.array(*map(F.lit, xs))
    assert one(geometry.clamped(F.lit(-1.0), F.lit(0.995), F.lit(2.0), F.lit(0.1))) == [0.0, 0.98, 1.0, 0.99]
    assert one(geometry.tag_box(F.lit(None).cast("double"))) == [0.06, 0.44, 0.94, 0.55] and [round(x, 3) for x in one(geometry.tag_box(F.lit(0.4)))] == [0.06, 0.435, 0.94, 0.545]
    assert one(geometry.distinct_boxes(F.array(lit(0.1, 0.2), lit(0.10001, 0.2), lit(0.3, 0.2)))) == [[0.1, 0.2], [0.3, 0.2]]
    assert [one(geometry.steady(lit(*x))) for x in ((0.0, 0.5, 1.0), (0.0, 0.5, 0.5), (0.0,))] == [True, False, True]
    w = one(geometry.seek_window(lit(*[k / 2 for k in range(20)]), F.lit(4), F.lit(9)))
    assert (w["start_s"], round(w["duration_s"], 3)) == (1.75, 3.5)
    assert [one(geometry.chunk_size(F.lit(100), F.lit(h), F.lit(f))) for h, f in ((0, True), (10, False), (95, False), (100, False))] == [100, 20, 5, 1]


def test_command_line(spark, tmp_path, capsys):
    assert main(["doctor"]) == 0 and "pyspark: " in capsys.readouterr().out
    (tmp_path / "bad.csv").write_text("name\nx\n")
    assert main(["validate", "--input", f"{tmp_path}/bad.csv"]) == 1 and main(["validate", "--input", f"{tmp_path}/bad.txt"]) == 2
    dump = [{"templateId": "V0016_POKEMON_PIDGEY", "pokemonSettings": {"pokemonId": "PIDGEY", "stats": {"baseAttack": 85, "baseDefense": 73, "baseStamina": 120}, "evolutionBranch": [{"evolution": "PIDGEOTTO"}]}}, {"templateId": "L", "playerLevel": {"cpMultiplier": [0.094, 0.16, 0.21]}}]
    (tmp_path / "dump.json").write_text(json.dumps(dump))
    assert main(["sync-metadata", "--dump", f"{tmp_path}/dump.json", "--output", f"{tmp_path}/cat"]) == 0
    (tmp_path / "in.csv").write_text("Species,iv_attack,iv_defense,iv_stamina\nPidgey,15,15,15\nPidgey,1,2,3\n")
    (tmp_path / "legacy.csv").write_text("species,evolution_species,move_name,move_type,note\nPidgey,,Gust,fast,x\n")
    assert main(["classify", "--input", f"{tmp_path}/in.csv", "--catalog", f"{tmp_path}/cat", "--legacy", f"{tmp_path}/legacy.csv", "--output", f"{tmp_path}/out"]) == 0
    made = spark.read.option("header", True).csv(f"{tmp_path}/out/classified_csv").collect()
    assert [r["recommendation"] for r in made] == ["KEEP", "KEEP"] and made[0]["possible_legacy_elite_moves"] == "Pidgey: Gust (x)" and (tmp_path / "out/classified.xlsx").exists()
    assert json.loads((tmp_path / "out/manifest.json").read_text())["counts"]["KEEP"] == 2
