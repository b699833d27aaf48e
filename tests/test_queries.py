"""Every named query against its SQL on the smallest tables, and small cases of the parsers and operators."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from orrery.functions import parsers
from orrery.operators import assembly, evolution, lookups, sequences, votes
from orrery.plans import REGISTRY


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for f in os.listdir(small_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{small_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if sql))
def test_query_equals_sql(spark, small_dir, con, name):
    query, sql = REGISTRY[name]
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    found = query(spark, small_dir)
    assert sorted(found.columns) == sorted(columns)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(want.fetchall())


def one(spark, parser, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(parser(F.col("t"))).collect()]


def test_parsers(spark):
    assert one(spark, parsers.parse_cp, ["CP 1234", "cp: 12|4", "ce501", "x 9999", "x 900", "CP none", None, ""]) == [1234, 1214, 501, None, 900, None, None, None]
    assert one(spark, parsers.parse_hp, ["77/80 HP", "O7 / 1O", "90/80", "1/9", None]) == ["77/80", "7/10", None, None, None]
    assert one(spark, parsers.parse_weight, ["(12,50 kg", "100 kg", "x5kg", "0 kg", "1001kg"]) == ["12.5", "1", None, None, None]
    assert one(spark, lambda c: parsers.parse_weight(c, strip_integers=False), ["100 kg"]) == ["100"]
    assert one(spark, parsers.parse_height, ["1.70 m", "3 mm"]) == ["1.7", None]
    assert one(spark, parsers.parse_iv, ["15.9", "-0.5", "16", "inf", "x", None]) == [15, 0, None, None, None, None]
    assert one(spark, parsers.display_name, ["  Pid  gey ", "1 kg", "a", "7/8 abcd", None]) == ["Pid gey", None, None, None, None]
    story = one(spark, parsers.parse_story, ["This Abc was caught\non 1/2/2024 around Rome, Italy.", "nothing"])
    assert tuple(story[0]) == ("Abc", "1/2/2024", "Rome, Italy", "Italy") and story[1] is None


def test_votes(spark):
    rows = [("a", 1)] * 3 + [("a", 2)] + [("b", 1)] * 2 + [("b", 2)] * 2 + [("c", None), ("c", 5)] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    assert {r["g"]: r["selected"] for r in votes.vote(df, ["g"], "v").collect()} == {"a": 1, "b": None, "c": 5}
    cp = spark.createDataFrame([("a", 150)] * 3 + [("a", 1501), ("b", 1231), ("b", 1232), ("b", 1233), ("b", 1234), ("c", 40)], "g string, v int")
    assert {r["g"]: r["selected"] for r in votes.cp_vote(cp, ["g"], "v").collect()} == {"a": 150, "b": 123, "c": 40}


def test_latch_equals_the_recurrence(spark):
    import random

    rng = random.Random(4)
    rows = [(s, i, rng.random() < 0.2, rng.random() < 0.6) for s in range(20) for i in range(30)]
    want, on = {}, {}
    for s, i, a, b in rows:
        on[s] = a or (b and on.get(s, False))
        want[s, i] = on[s]
    df = spark.createDataFrame(rows, "s int, i int, a boolean, b boolean")
    assert {(r["s"], r["i"]): r["flag"] for r in sequences.latch(df, ["s"], ["i"], F.col("a"), F.col("b")).collect()} == want


def test_runs_break_on_others(spark):
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate("aabxbb")], "s int, i int, c string")
    assert [r["run"] for r in sequences.with_runs(df, ["s"], ["i"], F.col("c") != "x", F.col("c")).orderBy("i").collect()] == [0, 0, 1, None, 2, 2]
    assert [r["run"] for r in sequences.with_skipping_runs(df, ["s"], ["i"], F.when(F.col("c") != "x", F.col("c"))).orderBy("i").collect()] == [0, 0, 1, None, 1, 1]


def test_cyclic_graphs_end(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 3)], "src long, dst long")
    assert evolution.paths(nodes, edges).count() == 10
    assert {r["node"]: r["root"] for r in evolution.families(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_lookups_refuse_ambiguity(spark):
    names = spark.createDataFrame([("pidgey", 1), ("pidgey", 2), ("raichu", 3), ("raichv", 4)], "n string, k long")
    index = lookups.unique_index(names, F.col("n"), "k")
    asked = spark.createDataFrame([(1, "pidgey"), (2, "raichu"), (3, "raichx"), (4, "raich")], "id int, t string")
    assert {r["id"]: r["f"] for r in lookups.exact(asked, F.col("t"), index, "f").collect()} == {1: None, 2: 3, 3: None, 4: None}
    assert {r["id"]: r["f"] for r in lookups.fuzzy(asked, F.col("t"), "id", index, "f").collect()} == {1: None, 2: None, 3: None, 4: None}


def test_contained_spans(spark):
    c = spark.createDataFrame([(1, "s", 2, 3), (2, "s", 2, 9), (3, "t", 2, 3)], "id long, s string, f long, l long")
    a = spark.createDataFrame([("s", 1, 5), ("s", 3, 20)], "s string, f long, l long")
    assert [r["id"] for r in assembly.contained(c, a, "s", "f", "l").collect()] == [1]


def test_rounds_over_a_graph_broadcast_nothing(spark, monkeypatch):
    """A broadcast a round would send the edges through the driver as often as there are rounds."""
    from orrery.operators import evolution

    nodes = spark.range(1, 41).withColumnRenamed("id", "node")
    edges = nodes.selectExpr("node AS src", "node * 2 AS dst").where("dst <= 40")
    plans, kind = [], type(nodes)
    held = kind.checkpoint

    def checkpoint(df, *args, **named):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return held(df, *args, **named)

    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    assert evolution.paths(nodes, edges).count() == sum(n.bit_length() for n in (40 // k for k in range(1, 41)))
    assert evolution.families(nodes, edges).select("root").distinct().count() == 20
    evolution.candidates(nodes.selectExpr("node", "cast(null as string) AS form"), edges)
    joins = [p for p in plans if "Join" in p]
    assert len(joins) > 10 and not [p for p in joins if "Broadcast" in p]


def test_gates_level_a_text_once_and_in_compiled_methods(spark, small_dir):
    from orrery.functions import parsers
    from orrery.plans import screens

    texts = spark.createDataFrame([("a", "Max  MOVE"), ("b", "maxmove"), ("c", None), ("d", "G-Max."), ("e", "")], "k string, t string")
    found = texts.select("k", parsers.contains_word(F.col("t"), ("max move", "g max")).alias("has"), parsers.contains_word(F.col("t"), ()).alias("none"))
    assert {r["k"]: r["has"] for r in found.collect()} == {"a": True, "b": False, "c": False, "d": True, "e": False} and not any(r["none"] for r in found.collect())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    told = texts.select(parsers.story_complete(F.lit("x. This Abc was caught on 1/2/2024 around X, Y.")).alias("yes"), parsers.story_complete(F.col("t")).alias("no"))
    assert {(r["yes"], r["no"]) for r in told.collect()} == {(True, False)}
    held = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        screens.classified(spark, small_dir)
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", held)
