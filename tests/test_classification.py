"""An inventory classified against a catalogue with forms, held against a plain rendering of the rules."""

import math

import pytest
from pyspark.sql import functions as F

from orrery.operators import classification as C
from orrery.operators import evolution

SPECIES = [("pidgey", "Pidgey", 16), ("pidgeotto", "Pidgeotto", 17), ("pidgeot", "Pidgeot", 18), ("mime-jr", "Mime Jr.", 439), ("mr-mime", "Mr. Mime", 122), ("mr-rime", "Mr. Rime", 866)]
EDGES = [("pidgey", "pidgeotto", None, None), ("pidgeotto", "pidgeot", None, None), ("mime-jr", "mr-mime", None, None), ("mr-mime", "mr-rime", "Galarian", None)]
STATS = [("pidgey", "Normal", 85, 73, 120), ("pidgeotto", "Normal", 117, 105, 160), ("pidgeot", "Normal", 166, 154, 195), ("mime-jr", "Normal", 125, 142, 85), ("mr-mime", "Normal", 192, 205, 120), ("mr-mime", "Galarian", 183, 169, 137), ("mr-rime", "Only", 212, 179, 190)]
LEVELS = [(1.0 + k / 2, round(0.094 + 0.0072 * k, 6)) for k in range(99)]
LEGACY = [("pidgey", "pidgeot", "Gust", "fast", "old event"), ("mr-mime", None, "Breaking Swipe", "charged", ""), (None, "mr-rime", "Psybeam!", "charged", None)]


@pytest.fixture(scope="module")
def catalog(spark):
    return {
        "species": spark.createDataFrame([(*s, [s[1].upper()]) for s in SPECIES], "species_key string, species_name string, pokedex_id int, aliases array<string>"),
        "evolutions": spark.createDataFrame(EDGES, "species_key string, evolves_to_key string, form string, evolves_to_form string").coalesce(1),
        "base_stats": spark.createDataFrame(STATS, "species_key string, form string, base_attack int, base_defense int, base_stamina int"),
        "cp_multipliers": spark.createDataFrame(LEVELS, "level double, cpm double"),
    }


@pytest.fixture(scope="module")
def legacy(spark):
    return spark.createDataFrame(LEGACY, "species_key string, evolution_species_key string, move_name string, move_type string, note string")


def expected(rows):
    stats = {(s, f.lower()): (a, d, t) for s, f, a, d, t in STATS}
    dex, names = {k: d for k, _, d in SPECIES}, {k: n for k, n, _ in SPECIES}

    def stat(s, f):
        own = [v for (k, _), v in stats.items() if k == s]
        return stats.get((s, f.lower())) or stats.get((s, "normal")) or (own[0] if len(own) == 1 else None)

    def reach(s, f):
        queue, out = [(s, f)], []
        while queue:
            s, f = queue.pop(0)
            if (s, f) not in out:
                out.append((s, f))
                queue += [(d, tf or ef or f) for src, d, ef, tf in EDGES if src == s and ef in (None, f)]
        return out

    def level(st, iv, cap):
        fits = [(lv, c) for lv, c in LEVELS if max(10, math.floor((st[0] + iv[0]) * math.sqrt(st[1] + iv[1]) * math.sqrt(st[2] + iv[2]) * c * c / 10)) <= cap]
        return fits[-1] if fits else None

    product = lambda st, iv, c: ((st[0] + iv[0]) * c) * ((st[1] + iv[1]) * c) * math.floor((st[2] + iv[2]) * c)
    out, groups, best = [], {}, {}
    for i, (s, f, iv) in enumerate(rows):
        r = {"keep": [], "leagues": {}}
        out.append(r)
        if s is None or iv is None:
            continue
        found = reach(s, f)
        ends = [x for x in found if not any(src == x[0] and ef in (None, x[1]) for src, _, ef, _ in EDGES)] or found[:1]
        final = max(ends, key=lambda x: (stat(*x)[0], sum(stat(*x)), dex[x[0]], x[0]) if stat(*x) else (0, 0, 0, x[0]))
        r["final"] = names[final[0]]
        groups.setdefault(final, []).append(i)
        fam = "mr-mime" if s.startswith("m") else "pidgey"
        for x in found:
            for lg, cap in (("LL", 500), ("GL", 1500), ("UL", 2500)):
                if (lv := level(stat(*x), iv, cap)) is not None:
                    key = (product(stat(*x), iv, lv[1]), lv[0], sum(iv))
                    if (fam, lg) not in best or key > best[fam, lg][0]:
                        best[fam, lg] = (key, i, x, iv, cap)
    for members in groups.values():
        ranked = sorted(members, key=lambda i: (-(10 * rows[i][2][0] + rows[i][2][1] + rows[i][2][2]), *(-v for v in rows[i][2]), i))
        for n, i in enumerate(ranked[:3], 1):
            out[i]["top"] = n
    for (_, lg), ((p, lv, _), i, x, iv, cap) in best.items():
        st, grid = stat(*x), []
        for a in range(16):
            for d in range(16):
                for t in range(16):
                    if (o := level(st, (a, d, t), cap)) is not None:
                        grid.append((-product(st, (a, d, t), o[1]), -o[0], (a, d, t)))
        out[i]["leagues"][lg] = (names[x[0]], round(p, 3), lv, sorted(grid).index((-p, -lv, tuple(iv))) + 1)
    return out


def test_inventory_against_plain_rules(spark, catalog, legacy):
    owned = [("Pidgey", "", (15, 15, 15)), ("PIDGEY", "", (14, 15, 15)), ("pidgeotto", "", (13, 15, 15)), ("Pidgey", "", (0, 0, 0)), ("Mr. Mime", "Galarian", (1, 2, 3)), ("mr mime", "", (9, 9, 9)), ("Mime Jr.", "Galarian", (3, 3, 3)), ("", "", (1, 1, 1)), ("Pidgey", "", None), ("Unknown Thing", "", (1, 2, 3))]
    rows = [(s, f, *(map(str, iv) if iv else (None, "x", "3")), {4: "Breaking  swipe", 0: "gust"}.get(i)) for i, (s, f, iv) in enumerate(owned)]
    table = spark.createDataFrame(rows, "`Species` string, Form string, `IV Attack` string, iv_defense string, iv_stamina string, charged_move_name string").coalesce(1)
    keys = {"pidgey": "pidgey", "pidgeotto": "pidgeotto", "mr. mime": "mr-mime", "mr mime": "mr-mime", "mime jr.": "mime-jr"}
    plain = expected([(keys.get(s.lower()), f or "Normal", iv) for s, f, iv in owned])
    found = [r.asDict() for r in C.classify(table, catalog, legacy).orderBy("__idx").collect()]
    assert [f["Species"] for f in found] == [s for s, _, _ in owned]
    for f, p in zip(found, plain, strict=True):
        if "final" in p:
            assert f["best_final_evolution"] == p["final"] and f["attacker_rank_in_family"] == p.get("top"), f
        for lg in ("LL", "GL", "UL"):
            x = f"pvp_{lg.lower()}_"
            got = (f[x + "as_species"], f[x + "stat_product"], f[x + "level"], f[x + "iv_rank"]) if f[x + "best"] else None
            assert got == p["leagues"].get(lg) or (got and abs(got[1] - p["leagues"][lg][1]) < 0.002 and got[::2] == p["leagues"][lg][::2]), (f["Species"], lg, got, p["leagues"].get(lg))
    assert found[0]["has_detected_legacy_move"] and found[0]["possible_legacy_elite_moves"] == "Pidgeot: Gust (old event)" and found[0]["recommendation"] == "KEEP" and "detected legacy move; possible legacy/Elite move" in found[0]["reason"]
    assert found[4]["has_detected_legacy_move"] and "Mr. Mime: Breaking Swipe" in found[4]["possible_legacy_elite_moves"] and "Mr. Rime: Psybeam!" in found[4]["possible_legacy_elite_moves"]
    assert not found[5]["has_detected_legacy_move"] and found[5]["possible_legacy_elite_moves"] == "Mr. Mime: Breaking Swipe"
    assert found[7]["recommendation"] == "REVIEW" and found[7]["reason"] == "missing species" and found[7]["family_id"] is None
    assert found[8]["reason"] == "possible legacy/Elite move; missing IV triplet" and found[8]["family_id"] == "pidgey"
    assert found[9]["best_final_evolution"] is None or found[9]["best_final_evolution"] == "Unknown Thing"
    assert C.output_columns(table)[:6] == table.columns and len(C.output_columns(table)) == 6 + len(C.ADDED)
    assert {n: d.count() for n, d in C.sheets(C.classify(table, catalog, legacy)).items()}["All"] == 10


def test_validation(spark):
    bad = spark.createDataFrame([("a", "1"), ("", "16")], "species string, iv_attack string").coalesce(1)
    errors, warnings = C.validate(bad)
    assert len(errors) == 2 and {(r["row"], r["problem"]) for r in warnings.collect()} == {(2, "missing or invalid iv_defense"), (2, "missing or invalid iv_stamina"), (3, "missing species"), (3, "missing or invalid iv_attack"), (3, "missing or invalid iv_defense"), (3, "missing or invalid iv_stamina")}
    assert len(C.validate(bad.limit(0).select("iv_attack"))[0]) == 4


def test_deep_graphs_and_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    nodes = spark.createDataFrame([(0,)], "node long")
    assert evolution.paths(nodes, chain).agg(F.max("depth")).first()[0] == 60
    every = spark.createDataFrame([(i,) for i in range(61)], "node long")
    assert {r["root"] for r in evolution.families(every, chain).collect()} == {0}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    reached = evolution.candidates(spark.createDataFrame([("a", None)], "node string, form string"), ring)
    assert sorted((r["node"], r["depth"]) for r in reached.collect()) == [("a", 0), ("b", 1)]
    assert [r["node"] for r in evolution.finals(reached, ring).collect()] == ["a"]


def test_the_last_entry_of_a_form_counts_whatever_the_partitions(spark):
    entries = [("a", "Normal", 1, 1, 1, 0), ("a", "Normal", 2, 2, 2, 7), ("a", "Normal", 3, 3, 3, 3), ("b", "X", 4, 4, 4, 1)]
    stats = spark.createDataFrame(entries, "species_key string, form string, base_attack int, base_defense int, base_stamina int, at long").repartition(5)
    asked = spark.createDataFrame([("a", "normal"), ("a", "other"), ("b", "normal"), ("c", "normal")], "node string, form_key string")
    assert {(r["node"], r["form_key"]): r["atk"] for r in C.with_stats(asked, stats).collect()} == {("a", "normal"): 2, ("a", "other"): 2, ("b", "normal"): 4, ("c", "normal"): None}


@pytest.mark.parametrize("levels", [LEVELS, LEVELS[:1], LEVELS[:2], [], [(1.0, 0.5), (2.0, 0.3), (3.0, 0.7)]])
def test_levels_found_by_halving_are_those_of_a_scan(spark, levels):
    rows = [(10 + 13 * i, 20 + 7 * i, 30 + 11 * i, i % 16, i * 3 % 16, i * 5 % 16) for i in range(60)]
    df = spark.createDataFrame(rows, "atk int, def int, sta int, iv_attack int, iv_defense int, iv_stamina int")
    want = set()
    for a, d, s, x, y, z in rows:
        for name, cap in (("GL", 1500), ("UL", 2500), ("LL", 500)):
            fits = [lv for lv, c in levels if max(10, math.floor((a + x) * math.sqrt(d + y) * math.sqrt(s + z) * c * c / 10)) <= cap]
            if fits:
                want.add((a, name, fits[-1]))
    assert {(r["atk"], r["league"], r["level"]) for r in C.best_levels(df, levels).collect()} == want
