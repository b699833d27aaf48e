"""Fragments of frames, and the species and moves that their texts name."""

import pytest

from orrery.functions import names, parsers
from orrery.operators import fragments, screens

GATES = [*screens.DETAIL_GATES, *screens.LIST_GATES, "has_transition"]


def frames(spark, *rows):
    kinds = {**{g: "boolean" for g in GATES}, "cp": "long", "hp": "string", "weight_kg": "string", "height_m": "string", "story_text": "string", "iv_attack": "int", "iv_defense": "int", "iv_stamina": "int", "iv_sum": "int", "appraisal_star_count": "int", "appraisal_perfect": "boolean", "iv_star_agreement": "boolean", **{f"ocr_{x}": "string" for x in ("cp", "display_name", "moves", "story", "special_sections")}}
    data = [("a", "video", i, float(i), r["classification"], r["classification"], *[r.get(k, False if kinds[k] == "boolean" and k in GATES else None) for k in kinds]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "source_file string, source_type string, frame_index long, timestamp_s double, classification string, raw_classification string, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))


def test_fields_behind_gates(spark):
    story = "x This Abc was caught on 1/2/2024 around Rome, Italy."
    found = fragments.extract(frames(
        spark,
        {"classification": "detail", "has_cp": True, "cp": 500, "has_hp": True, "hp": "50/60", "has_weight": True, "weight_kg": "1.25", "height_m": "9", "has_display_name": True, "ocr_display_name": " Abc  d ", "is_shadow": True},
        {"classification": "appraisal", "has_story": True, "story_text": story, "has_iv": True, "iv_attack": 1, "iv_sum": 9, "appraisal_perfect": False},
        {"classification": "list", "has_list_cp": True, "ocr_cp": "CP 9", "has_list_grid": True, "has_cp": True, "cp": 9},
        {"classification": "detail", "cp": 500}, {"classification": "detail", "has_cp": True, "cp": 1, "has_transition": True}, {"classification": "non_extractable", "has_cp": True, "cp": 1},
        {"classification": "detail", "has_display_name": True, "ocr_display_name": "Power Up"},
    )).orderBy("frame_index").collect()
    assert [r["frame_index"] for r in found] == [0, 1, 2]
    assert found[0]["fields"] == {"cp": "500", "hp_current": "50", "hp_max": "60", "weight_kg": "1.25", "display_name_text": "Abc d", "is_shadow": "true"}
    assert found[1]["fields"] == {"canonical_name_text": "Abc", "catch_date_text": "1/2/2024", "location_text": "Rome, Italy", "catch_country_text": "Italy", "iv_complete": "false", "iv_attack": "1", "iv_sum": "9", "appraisal_perfect": "false"}
    assert found[2]["fields"] == {"has_list_cp": "true", "has_list_grid": "true", "list_cp_text": "CP 9"} and found[2]["sources"]["list_cp_text"]["source"] == "text"


def plain(spark, *fields):
    return spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "n int, fields map<string, string>")


def test_species_by_name(spark):
    species = spark.createDataFrame([("pidgey", "Pidgey", 16, ["PIDGEY"]), ("mr-mime", "Mr. Mime", 122, ["Mister Mime"]), ("aa", "Twinny", 1, None), ("bb", "Twinny", 2, None), ("flabebe", "Flabébé", 669, None)], "species_key string, species_name string, pokedex_id int, aliases array<string>")
    asked = [{"canonical_name_text": "pidgey"}, {"canonical_name_text": "Pidgoy"}, {"display_name_text": "MR MIME"}, {"canonical_name_text": "x", "display_name_text": "Pidgey"}, {"display_name_text": "Twinny"}, {"display_name_text": "Flabebe!"}, {"cp": "1"}, {"display_name_text": "Pidg"}]
    got = [r["fields"] for r in fragments.with_species(plain(spark, *asked), species).orderBy("n").collect()]
    assert [g.get("species_key") for g in got] == ["pidgey", "pidgey", "mr-mime", None, None, "flabebe", None, None]
    assert got[0]["canonical_name_text"] == "pidgey" and got[1]["canonical_name_text"] == "Pidgey" and got[2]["canonical_name_text"] == "Mr. Mime" and got[0]["pokedex_id"] == "16"


def test_moves_by_mention(spark):
    moves = spark.createDataFrame([("tackle", "Tackle", ["V0221_MOVE_TACKLE_FAST"]), ("dig", "Dig", None), ("hydro-pump", "Hydro Pump", None), ("hydro-cannon", "Hydro Cannon", None), ("x-scissor", "X-Scissor", None), ("max-guard", "Max Guard", None), ("max-move", "Max Move", None), ("gust", "Gust", None), ("gusty", "Gust", None)], "move_key string, move_name string, upstream_ids array<string>")
    texts = [{"moves_text": "Tackle weather bonus X Scissor, Hydro Pump"}, {"moves_text": "Tackie Hydro Canon Dig"}, {"moves_text": "Gust Dig dig", "power_section_text": "Max Guard LV 3"}, {"moves_text": "Hydro Tackle"}, {"moves_text": "max guard max move"}, {"cp": "1"}]
    got = [r["fields"] for r in fragments.with_moves(plain(spark, *texts), moves).orderBy("n").collect()]
    slots = [[g.get(f"{s}_key") for s in (*fragments.SLOTS, "max_move")] for g in got]
    assert slots == [["tackle", "x-scissor", "hydro-pump", None], ["tackle", "hydro-cannon", "dig", None], ["dig", None, None, "max-guard"], ["tackle", None, None, None], ["max-move", None, None, "max-guard"], [None] * 4]
    assert got[0]["charged_move_name"] == "X-Scissor"


def one(spark, f, values):
    from pyspark.sql import functions as F

    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_names(spark):
    assert one(spark, names.normal_name, ["Mr. Mime", " Flabébé ", "Type: Null", "A&B", None]) == ["mr mime", "flabebe", "type null", "a and b", ""]
    assert one(spark, names.normal_move, ["X-Scissor", "U-turn!"]) == ["x scissor", "u turn"]
    assert one(spark, names.species_title, ["MR_MIME", "BULBASAUR", "TAPU_KOKO"]) == ["Mr. Mime", "Bulbasaur", "Tapu Koko"]
    assert one(spark, names.species_names, ["MR_MIME"]) == [["MR_MIME", "Mister Mime", "Mr Mime", "Mr. Mime"]]
    assert one(spark, names.move_title, ["VINE_WHIP_FAST", "DIG"]) == ["Vine Whip", "Dig"]


@pytest.mark.parametrize(("parser", "cases"), [
    (parsers.parse_cp, {"CP 12,345": None, "CP 12 34": None, "x 99999 500": 500, "xce50": 50, "CP1234 ||": 1234, "cp none": None, "CP 9999 500": None, "": None}),
    (parsers.parse_weight, {"0 kg 12 kg": "12", "1001 kg 5.5 kg": "5.5", "x5kg (7,50KG": "7.5", "kg": None}),
    (parsers.parse_height, {"101 m 2 m": "2", "0 m": None}),
    (parsers.display_name, {"POWER UP": None, "Stardust": None, "Pid gey": "Pid gey"}),
    (parsers.moves_tab, {"Gyms & Raids": True, "gymraids": True, "gym": False}),
    (parsers.story_words, {"THIS was Caught  around": True, "this caught": False}),
    (parsers.has_cp_prefix, {"C P: 12": True, "cee 1O": True, "12 CP": False}),
])
def test_parsers_take_the_first_plausible_value(spark, parser, cases):
    assert one(spark, parser, list(cases)) == list(cases.values())


def test_stories_in_either_case(spark):
    got = one(spark, parsers.parse_story, ["this Abc was caught on 1/2/2024 around Rome, Italy.", "This a. This Bc was caught on 1/2/2024 around X , !"])
    assert tuple(got[0]) == ("Abc", "1/2/2024", "Rome, Italy", "Italy") and got[1]["name"] == "Bc" and got[1]["country"] == "X"


def test_near_names_equal_brute_force_and_no_key_is_hot(spark):
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from orrery.operators import fragments, lookups

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(2, 8)))
    names = sorted({" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(300)})
    grams = []
    for _ in range(500):
        g = list(rng.choice(names))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(g) + 1)
            kind = rng.random()
            if kind < 0.4:
                g.insert(at, rng.choice("abc"))
            elif g and at < len(g) and g[at] != " ":
                g[at : at + 1] = [] if kind < 0.7 else [rng.choice("abc")]
        grams.append("".join(g))
    tokens = lambda t: len(t.split(" "))
    want = set()
    for i, g in enumerate(grams):
        for big in (False, True):
            hits = {n for k, n in enumerate(names) if (k % 2 == 0) == big and len(n) >= 5 and tokens(n) == tokens(g) and len(g) >= 3 and edits(g, n) <= (2 if " " in n and len(n) >= 9 else 1)}
            if len(hits) == 1:
                want.add((i, big, i % 7, tokens(g), hits.pop()))
    known = spark.createDataFrame([(n, n, k % 2 == 0, tokens(n)) for k, n in enumerate(names)], "norm string, key string, is_max boolean, tokens int")
    held = spark.createDataFrame([(i, i % 7, tokens(g), g) for i, g in enumerate(grams)], "row long, at int, tokens int, gram string")
    assert {tuple(r) for r in fragments.near_names(held, known).collect()} == want and len(want) > 100
    keys = held.select("gram").distinct().select("gram", F.explode(lookups.text_keys(F.col("gram"), F.lit(2))).alias("k")).groupBy("gram").count().agg(F.max("count")).first()[0]
    assert keys <= 25
    sizes = Counter(r[0] for r in known.select(F.explode(lookups.name_keys(F.col("norm"), F.lit(1))).alias("k")).collect())
    assert max(sizes.values()) < 0.1 * sum(sizes.values())
