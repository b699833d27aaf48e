"""Runs of frames that correct each other, and sequences read from the newest frame back, held against plain loops."""

import random

from pyspark.sql import functions as F

from orrery.operators import production, screens

BOOLS = [*screens.DETAIL_GATES, "has_transition", "stable_detail_signal", "horizontal_swipe_signal", "hp_area_card_split_signal", "iv_star_agreement", "appraisal_perfect"]
KINDS = {**{b: "boolean" for b in BOOLS}, "classification": "string", "raw_classification": "string", "cp": "long", "hp": "string", "weight_kg": "string", "height_m": "string", "story_text": "string", "iv_bar_count": "int", "iv_attack": "int", "iv_defense": "int", "iv_stamina": "int", "iv_sum": "int", "appraisal_star_count": "int", **{f"ocr_{x}": "string" for x in ("display_name", "moves", "special_sections")}}


def frames(spark, sources):
    rows = [(s, i, *[r.get(k, False if KINDS[k] == "boolean" else None) for k in KINDS]) for s, own in sources.items() for i, r in enumerate(own)]
    return spark.createDataFrame(rows, "source_file string, frame_index long, " + ", ".join(f"{k} {v}" for k, v in KINDS.items()))


def collected(df, *columns):
    out = {}
    for r in df.orderBy("source_file", "frame_index").collect():
        out.setdefault(r["source_file"], []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


def detail(**more):
    return {"classification": "detail", "raw_classification": "detail", **more}


def test_points_of_a_run(spark):
    run = [detail(hp="9/9", cp=c) for c in (150, 150, 150, 1501, None)]
    got = collected(production.with_cp_consensus(frames(spark, {"a": run, "b": [*run[:2], detail(cp=1501), detail(hp="9/9", cp=1502)]})), "cp", "cp_original")
    assert got == {"a": [(150, None), (150, None), (150, None), (150, 1501), (None, None)], "b": [(150, None), (150, None), (1501, None), (1502, None)]}


def test_weights_of_a_run(spark):
    w = lambda x, hp="9/9": detail(hp=hp, weight_kg=x)
    got = collected(production.with_weights(frames(spark, {"a": [w("2"), w(None), detail(), w("2"), w("2"), w("7")], "b": [w("2"), w(None), {"classification": "list", "raw_classification": "list"}, w(None), w("3", "8/8")]})), "weight_kg", "weight_original", "weight_filled")
    assert got["a"] == [("2", None, False), ("2", None, True), (None, None, False), ("2", None, False), ("2", None, False), ("2", "7", False)]
    assert [x[0] for x in got["b"]] == ["2", "2", None, None, "3"]


def test_powers_and_complete_values(spark):
    a = [detail(has_dynamax=True), detail(has_gigantamax=True), detail(), detail(ocr_moves="Power Up x"), {"classification": "appraisal", "raw_classification": "appraisal"}, detail(has_moves=True)]
    assert collected(production.with_powers(frames(spark, {"a": a})), "has_dynamax", "has_gigantamax")["a"] == [(False, True), (False, True), (False, False), (False, True), (False, False), (False, False)]
    whole = {"classification": "appraisal", "raw_classification": "appraisal", "has_iv": True, "iv_bar_count": 3, "iv_star_agreement": True, "has_iv_complete": True}
    assert collected(production.with_last_complete(frames(spark, {"a": [whole, whole, whole | {"iv_bar_count": 2}, detail(), whole]})), "has_iv_complete")["a"] == [False, True, False, False, True]


def plain_scan(rows, desired):
    """(accepted, conflicts, frames asked) by a loop over dictionaries."""
    accepted, conflicts, used, points, read, power = {}, [], {}, [], [], False
    appraisal = rows[0]["raw"] == "appraisal"

    def choice(values):
        n = {v: values.count(v) for v in values}
        if len(n) <= 1:
            return next(iter(n), None)
        ranked = sorted(n.values(), reverse=True)
        return max(n, key=n.get) if ranked[0] >= 3 and ranked[0] >= 2 * ranked[1] else None

    for i, r in sorted(enumerate(rows), reverse=True):
        free = lambda f: used.get(f, 0) < 3 or f not in ("cp", "height", "weight")
        wanted = {f for f in [*(set(desired) - set(accepted)), *conflicts, "cp"] if free(f)}
        done = {"hp", "weight"} | ({"story", "iv"} if appraisal else {"moves"}) <= set(accepted) and not conflicts
        if done:
            wanted = {f for f in wanted if f == "cp" or (f == "height" and not appraisal)} | ({"power"} if not appraisal and accepted.get("has_dynamax") == "true" and not power else set())
        if not wanted:
            break
        asked = sorted(wanted & set(r["can"]))
        if not asked:
            continue
        for f in asked:
            used[f] = used.get(f, 0) + 1
        read.append((i, asked))
        for f, v in r["told"].items():
            if f not in asked and f not in ("is_shadow", "has_dynamax", "has_gigantamax"):
                continue
            if f == "cp":
                points.append(int(v))
            elif f not in accepted:
                accepted[f] = v
            elif accepted[f] != v and f not in screens.FREE_FIELDS and f not in conflicts:
                conflicts.append(f)
            power |= f == "has_gigantamax"
        cp = choice(points)
        accepted.pop("cp", None)
        if cp is not None:
            accepted["cp"] = str(cp)
    return accepted, sorted(conflicts), read


def test_sequences_read_from_the_newest_frame(spark):
    rng = random.Random(5)
    plain, rows = {}, []
    for s in range(40):
        raw = rng.choice(["detail", "appraisal"])
        desired = screens.APPRAISAL_FIELDS if raw == "appraisal" else screens.DETAIL_FIELDS
        own = []
        for i in range(rng.randrange(1, 14)):
            told = {f: rng.choice(["5", "5", "5", "6"]) for f in desired if f not in ("cp", "tag") and rng.random() < 0.5}
            if rng.random() < 0.6:
                told["cp"] = rng.choice(["500", "500", "700"])
            if raw == "detail" and rng.random() < 0.3:
                told["has_dynamax"] = "true"
            if raw == "detail" and rng.random() < 0.1:
                told["has_gigantamax"] = "true"
            own.append({"raw": raw, "told": told, "can": [f for f in desired if rng.random() < 0.7]})
            rows.append((f"v{s}", 0, i, raw, told, own[-1]["can"]))
        plain[f"v{s}"] = plain_scan(own, desired)
    df = spark.createDataFrame(rows, "source_file string, seq long, frame_index long, raw_classification string, told map<string, string>, can array<string>")
    found = {r["source_file"]: r for r in production.scan(df).collect()}
    for s, (accepted, conflicts, read) in plain.items():
        r = found[s]
        assert (r["accepted"], sorted(r["conflicts"]), [(x["frame"], x["fields"]) for x in r["read"]]) == (accepted, conflicts, read), s
        assert r["completed"] == ("anchor" not in r["blockers"] and not conflicts)
    again = production.repaired(production.scan(df), df)
    assert again.count() == 40 and again.where(production.needs_repair()).count() <= production.scan(df).where(production.needs_repair()).count()


def test_weights_of_neighbouring_sequences(spark):
    rows = [("a", s, 10 * s + i, "detail", {"hp": hp, "weight": w}, ["hp", "weight"], w) for s, (hp, ws) in enumerate([("9/9", "222"), ("9/9", "27"), ("8/8", "3"), ("9/9", "4")]) for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "source_file string, seq long, frame_index long, raw_classification string, told map<string, string>, can array<string>, weight_kg string")
    got = collected(production.stabilised(df, production.scan(df)), "weight_kg", "weight_outlier")["a"]
    assert got == [("2", None)] * 4 + [("2", "7"), ("3", None), ("4", None)]


def test_transitions_cut_sequences(spark):
    own = [detail(stable_detail_signal=True) for _ in range(8)]
    df = frames(spark, {"a": own}).withColumns({"previous_frame_delta": F.when(F.col("frame_index") == 3, 0.1).when(F.col("frame_index") == 4, 0.03).otherwise(0.01), "future_frame_delta_3": F.when(F.col("frame_index").isin(3, 4), 0.05).otherwise(0.0), "horizontal_swipe_signal": F.col("frame_index") == 3})
    got = collected(production.with_sequences(production.with_transitions(df)), "in_transition", "seq")["a"]
    assert got == [(False, 0)] * 3 + [(True, None)] * 2 + [(False, 1)] * 3


def test_best_reading(spark):
    rows = [("a", "1234", 0.9, None, 0, False), ("a", "CP 55", 0.1, None, 1, False), ("a", "CP 555", 0.1, "b", 2, True), ("a", "xx", 1.0, None, 3, False)]
    df = spark.createDataFrame(rows, "g string, text string, confidence double, box string, attempt int, fallback boolean")
    assert [r["text"] for r in production.best_reading(df, ["g"], "cp").collect()] == ["CP 555"]
    w = spark.createDataFrame([("a", "5 kg", 0.9, None, 0, False), ("a", "6 kg", 0.2, "b", 1, True)], df.schema)
    assert production.best_reading(w, ["g"], "weight").first()["text"] == "5 kg" and production.best_reading(w.withColumn("prefer_fallback", F.lit(True)), ["g"], "weight").first()["text"] == "6 kg"


def test_runs_correct_each_other_without_a_join(spark):
    plan = production.postprocess(frames(spark, {"a": [detail(hp="9/9", cp=150)]}))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LocalRelation") + plan.count("LogicalRDD") == 1


def test_votes_of_runs_equal_a_loop(spark):
    rng = random.Random(5)
    sources = {s: [detail(hp=rng.choice(("9/9", "9/9", "9/9", "8/8", None)), cp=rng.choice((150, 150, 150, 1501, 1502, 99, None)), weight_kg=rng.choice(("2", "2", "2", "2", "7", None))) for _ in range(60)] for s in "abc"}
    points = collected(production.with_cp_consensus(frames(spark, sources)), "cp")
    weights = collected(production.with_weights(frames(spark, sources)), "weight_kg")
    for s, own in sources.items():
        runs, skipping, last = [], [], None
        for i, r in enumerate(own):
            if r["hp"] is not None:
                (runs[-1].append(i) if i and own[i - 1]["hp"] == r["hp"] else runs.append([i]))
                (skipping[-1].append(i) if last == r["hp"] else skipping.append([i]))
                last = r["hp"]
        cp, weight = [r["cp"] for r in own], [r["weight_kg"] for r in own]
        for run in runs:
            chosen = production.choose_points([own[i]["cp"] for i in run if own[i]["cp"] is not None])
            for i in run:
                cp[i] = chosen if chosen is not None and cp[i] is not None else cp[i]
        for run in skipping:
            n = {v: sum(own[i]["weight_kg"] == v for i in run) for v in ("2", "7")}
            top = max(n, key=n.get)
            wins = min(n.values()) == 0 < n[top] or (n[top] >= 3 and n[top] >= 3 * min(n.values()) and n[top] >= 0.75 * sum(n.values()))
            for i in run:
                weight[i] = top if wins else weight[i]
        assert points[s] == cp and weights[s] == weight
