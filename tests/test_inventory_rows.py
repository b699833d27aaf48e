"""Row assembly: the rules of each column, identities, merges, recovery, partial rows, diagnostics."""

from pyspark.sql import functions as F

from orrery.operators import inventory_rows as R

CORE = {"hp_current": "50", "hp_max": "60", "weight_kg": "1.25"}
DETAIL = CORE | {"fast_move_key": "tackle", "fast_move_name": "Tackle", "charged_move_key": "dig", "charged_move_name": "Dig"}
APPRAISAL = CORE | {"species_key": "pidgey", "catch_date_text": "1/2/2024", "location_text": "Rome", "canonical_name_text": "Pidgey", "iv_complete": "true", "iv_attack": "1", "iv_defense": "2", "iv_stamina": "3", "iv_sum": "6", "appraisal_star_count": "0", "iv_star_agreement": "true"}


def fragments(spark, *frames):
    """(seq, type, fields, source?) in order of frames."""
    rows = [(s, (x[0] if x else "a.mp4"), "video", i, float(i) / 3, kind, fields) for i, (s, kind, fields, *x) in enumerate(frames)]
    return spark.createDataFrame(rows, "seq_id long, source_file string, source_type string, frame_index long, timestamp_s double, fragment_type string, fields map<string, string>")


def one(spark, *frames):
    (row,) = R.candidates(fragments(spark, *frames)).collect()
    return row


def assembled(spark, *frames):
    rows, notes = R.assemble(fragments(spark, *frames))
    return [r.asDict() for r in rows.orderBy("first_frame_index").collect()], {r["seq_id"]: r for r in notes.collect()}


def test_outcomes_of_candidates(spark):
    assert (one(spark, (1, "detail", DETAIL))["anchor_kind"], one(spark, (1, "detail", DETAIL))["accepted"]) == ("detail", True)
    a = one(spark, (1, "appraisal", APPRAISAL))
    assert a["anchor_kind"] == "appraisal" and a["accepted"] and a["identity_key"] == "physical|a.mp4|50|60|1.250" and a["iv_complete"] is True
    s = one(spark, (1, "detail", CORE))
    assert s["anchor_kind"] == "support" and not s["accepted"]
    n = one(spark, (1, "detail", {k: v for k, v in DETAIL.items() if k != "weight_kg"}))
    assert n["identity_key"] is None and not n["accepted"] and n["anchor_kind"] == "detail"
    c = one(spark, (1, "detail", DETAIL), (1, "detail", DETAIL | {"hp_max": "61"}))
    assert c["anchor_kind"] == "conflict" and c["conflicts"] == ["hp_max"] and c["hp_max"] is None
    assert R.candidates(fragments(spark, (1, "list", CORE))).count() == 0


def test_votes_of_columns(spark):
    frames = [(1, "detail", DETAIL | {"hp_max": "60"})] * 4 + [(1, "detail", DETAIL | {"hp_max": "66", "weight_kg": "9"})]
    assert one(spark, *frames)["hp_max"] == 60 and one(spark, *frames)["weight_kg"] == 1.25
    cp = [(1, "detail", DETAIL | {"cp": v}) for v in ("150", "150", "150", "1501", "12")]
    assert one(spark, *cp)["cp"] == 150
    assert one(spark, (1, "detail", DETAIL | {"cp": "900"}), (1, "detail", DETAIL | {"cp": "700"}))["cp"] is None
    tall = one(spark, (1, "appraisal", APPRAISAL | {"height_m": "2"}), (1, "appraisal", APPRAISAL | {"height_m": "2"}), (1, "detail", DETAIL | {"height_m": "1.5"}))
    assert tall["height_m"] == 1.5
    places = [(1, "appraisal", APPRAISAL | {"location_text": v}) for v in ("Rome", "Rome", "Paris")]
    assert one(spark, *places)["catch_location"] == "Rome"
    stars = [(1, "appraisal", APPRAISAL | {"appraisal_star_count": v, "iv_complete": "false"}) for v in ("3", "3", "3", "0")]
    assert one(spark, *stars)["appraisal_star_count"] == 0


def test_locked_triplet_and_flags(spark):
    weak = APPRAISAL | {"iv_complete": "false", "iv_attack": "9"}
    row = one(spark, (1, "appraisal", weak), (1, "appraisal", weak), (1, "appraisal", APPRAISAL), (1, "appraisal", weak), (1, "appraisal", weak))
    assert (row["iv_attack"], row["iv_complete"], row["conflicts"]) == (1, True, [])
    other = APPRAISAL | {"iv_attack": "4"}
    row = one(spark, (1, "appraisal", APPRAISAL), (1, "appraisal", other))
    assert row["iv_attack"] is None and row["iv_complete"] is False and row["anchor_kind"] == "conflict"
    row = one(spark, (1, "detail", DETAIL | {"charged_move_key": "frustration", "has_dynamax": "true"}), (1, "detail", DETAIL | {"charged_move_key": "frustration", "has_gigantamax": "true"}))
    assert row["is_shadow"] and row["has_gigantamax"] and not row["has_dynamax"] and not row["has_tag_chips"]
    unsure = one(spark, (1, "appraisal", {k: v for k, v in APPRAISAL.items() if k not in ("iv_star_agreement", "iv_complete")}))
    assert unsure["accepted"] and unsure["iv_complete"] is False


def test_detail_and_appraisal_of_one_identity_merge(spark):
    rows, notes = assembled(spark, (1, "detail", DETAIL), (2, "appraisal", APPRAISAL), (3, "detail", CORE | {"cp": "500"}), (4, "detail", {"hp_current": "50", "hp_max": "60", "has_tag_chips": "true"}))
    assert len(rows) == 1 and rows[0]["members"] == 4 and rows[0]["anchor_kind"] == "detail+appraisal"
    assert (rows[0]["cp"], rows[0]["fast_move_key"], rows[0]["species_key"], rows[0]["has_tag_chips"], rows[0]["first_frame_index"], rows[0]["last_frame_index"]) == (500, "tackle", "pidgey", True, 0, 3)
    assert {k: v["outcome"] for k, v in notes.items()} == {1: "accepted", 2: "accepted", 3: "merged_support", 4: "merged_support"}


def test_conflicts_reject_groups_and_support_never_does(spark):
    rows, _ = assembled(spark, (1, "appraisal", APPRAISAL), (2, "appraisal", APPRAISAL | {"species_key": "raichu", "iv_attack": "7"}))
    assert rows == []
    rows, _ = assembled(spark, (1, "appraisal", APPRAISAL), (2, "detail", CORE | {"canonical_name_text": "Other", "catch_date_text": "9/9/2020"}))
    assert len(rows) == 1 and rows[0]["catch_date"] == "1/2/2024" and rows[0]["canonical_name"] == "Pidgey"


def test_low_points_of_an_appraisal_give_way(spark):
    rows, _ = assembled(spark, (1, "appraisal", APPRAISAL | {"cp": "41"}), (2, "detail", CORE | {"cp": "641"}))
    assert rows[0]["cp"] == 641


def test_support_alone_may_make_a_partial_row(spark):
    parts = [CORE | {"species_key": "pidgey"}, CORE | {"cp": "300"}]
    rows, notes = assembled(spark, *[(i, "detail", f) for i, f in enumerate(parts)])
    assert len(rows) == 1 and rows[0]["species_key"] == "pidgey" and rows[0]["cp"] == 300 and rows[0]["anchor_kind"] == "support"
    assert {v["outcome"] for v in notes.values()} == {"merged_support"}
    rows, notes = assembled(spark, (0, "detail", CORE), (1, "detail", CORE | {"cp": "300"}))
    assert rows == [] and {v["outcome"] for v in notes.values()} == {"rejected"}


RECOVERIES = [([{}], [{}], 1), ([{"species_key": "raichu"}], [{}], 0), ([{}, {"weight_kg": "3"}], [{}], 0), ([{"species_key": "pidgey"}, {"weight_kg": "3"}], [{}], 1), ([{"species_key": "pidgey"}, {"species_key": "pidgey", "weight_kg": "3"}], [{}], 0)]


def test_recovery_of_pairs_whose_weights_disagree(spark):
    frames = []
    for k, (details, appraisals, _) in enumerate(RECOVERIES):  # a source for each case
        frames += [(100 * k + i, "detail", DETAIL | {"weight_kg": "2"} | x, f"{k}.mp4") for i, x in enumerate(details)] + [(100 * k + 10 + i, "appraisal", APPRAISAL | x, f"{k}.mp4") for i, x in enumerate(appraisals)]
    every, _ = assembled(spark, *frames)
    for k, (details, appraisals, pairs) in enumerate(RECOVERIES):
        rows = [r for r in every if r["source_file"] == f"{k}.mp4"]
        joined = [r for r in rows if r["anchor_kind"] == "detail+appraisal"]
        assert len(joined) == pairs and all(r["group_key"].startswith("recovered|") and r["weight_kg"] == 1.25 and r["fast_move_key"] == "tackle" for r in joined)
        assert len(rows) == len(details) + len(appraisals) - pairs


def test_spans_inside_a_row_are_merged_support(spark):
    rows, notes = assembled(spark, (1, "detail", DETAIL), (2, "detail", {"hp_current": "9", "hp_max": "10"}), (1, "detail", DETAIL), (3, "detail", {"hp_current": "9", "hp_max": "10"}, "b.mp4"))
    assert len(rows) == 1 and notes[2]["outcome"] == "merged_support" and notes[3]["outcome"] == "rejected"
    assert notes[1]["moves_status"] == "resolved" and notes[2]["moves_status"] == "detail_without_moves" and "fast_move_key" in notes[1]["present_fields"] and "cp" in notes[1]["missing_fields"]


def test_empty_fragments(spark):
    rows, notes = R.assemble(fragments(spark, (1, "detail", DETAIL)).limit(0))
    assert rows.count() == 0 and notes.count() == 0


def test_rules_over_votes_read_them_once(spark):
    from orrery.operators import votes

    held = spark.createDataFrame([([(150, 3), (1501, 2), (99, 9)],), ([(1501, 1), (1502, 1), (1503, 1), (1504, 1)],), ([(120, 1)],), ([(50, 3), (60, 1)],), ([],), (None,)], "held array<struct<v: bigint, n: bigint>>")
    for rule in (votes.choice, votes.cp_choice):
        plan = held.select(rule(F.col("held")).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.splitlines()[0].count("held#") == 1
    assert [tuple(r) for r in held.select(votes.cp_choice(F.col("held")), votes.choice(F.col("held"), strictly=True, share=0.6)).collect()] == [(150, 99), (150, None), (120, 120), (50, 50), (None, None), (None, None)]
