"""Screen rules over signals rendered from the lineitem table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import screens
from orrery.plans.registry import query, table

#: Each signal in its range, from a number of the row; some are missing on some rows.
RANGES = {
    "detail_card_brightness": (0.60, 0.40, 7), "story_brightness": (0.60, 0.40, 11), "hp_green_ratio": (0.0, 0.25, 13), "moves_dark_ratio": (0.0, 0.35, 17), "name_dark_ratio": (0.0, 0.18, 19), "story_dark_ratio": (0.0, 0.2, 23), "orange_badge_ratio": (0.0, 0.05, 29), "iv_seal_color_ratio": (0.0, 0.04, 31),
    "list_pokemon_art_signal": (0.0, 0.1, 37), "pokemon_art_signal": (0.05, 0.3, 41), "horizontal_card_gap_ratio": (0.0, 0.08, 43), "tag_edge_ratio": (0.0, 0.12, 47), "list_text_dark_ratio": (0.0, 0.03, 53), "hp_region_dark_ratio": (0.0, 0.06, 59), "hp_bar_edge_ratio": (0.0, 0.15, 61), "hp_text_edge_ratio": (0.0, 0.2, 67),
    "moves_fast_row_dark_ratio": (0.03, 0.05, 71), "moves_charged_rows_dark_ratio": (0.04, 0.06, 73), "moves_complete_rows_dark_ratio": (0.05, 0.06, 79), "moves_completion_footer_dark_ratio": (0.05, 0.25, 83), "moves_completion_footer_height": (0.08, 0.08, 89), "moves_new_attack_button_height": (0.03, 0.06, 97), "moves_new_attack_button_green_ratio": (0.2, 0.3, 101), "moves_transition_guard_dark_ratio": (0.0, 0.02, 103),
}
FLAGS = {"iv_panel_visible": 2, "iv_seal_visible": 3, "hp_area_card_split_signal": 0, "hp_bar_anchor_visible": 4, "moves_tab_anchor_visible": 5, "moves_visual_region_anchored": 6}
_X = "(l_orderkey * 131 + l_linenumber * 17)"


def _signals_sql() -> str:
    """The same expressions in both dialects: thousandths of a range, some rows without a value."""
    some = [f"CASE WHEN {_X} % {p + 6} = 5 THEN NULL ELSE round({lo} + {wide} * (({_X} * {p}) % 1009) / 1008.0, 4) END AS {n}" for n, (lo, wide, p) in RANGES.items()]
    some += [f"({_X} + {k}) % 7 {'= 0' if k == 0 else '<> 0'} AS {n}" for n, k in FLAGS.items()]
    return f"SELECT l_orderkey, l_linenumber, {', '.join(some)}, {_X} % 5 AS list_bright_row_bands, {_X} % 4 AS iv_bar_count, {_X} % 16 AS iv_attack, {_X} % 13 AS iv_defense, {_X} % 15 AS iv_stamina, {_X} % 5 AS appraisal_star_count, {_X} % 29 = 0 AS appraisal_perfect, false AS sequence_transition_signal"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("orrery_lineitem")
    doubles = ", ".join(f"cast({n} AS double) AS {n}" for n in RANGES)
    rest = "l_orderkey, l_linenumber, " + ", ".join([*FLAGS, "list_bright_row_bands", "iv_bar_count", "iv_attack", "iv_defense", "iv_stamina", "appraisal_star_count", "appraisal_perfect", "sequence_transition_signal"])
    return spark.sql(f"SELECT {rest}, {doubles} FROM ({_signals_sql()} FROM orrery_lineitem)")


def split_methods(spark: SparkSession) -> None:
    """Rules make long methods, and HotSpot compiles none over 8000 octets: those are left out of whole-stage code, so that Spark splits them. A limit that the session was given stays."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    split_methods(spark)
    return screens.with_classes(screens.with_iv_evidence(signals(spark, sf_dir)))


def _base_sql() -> str:
    doubles = ", ".join(f"{n}::DOUBLE AS {n}" for n in RANGES)
    return f"raw AS (SELECT * REPLACE ({doubles}) FROM ({_signals_sql()} FROM lineitem)), s AS (SELECT *, coalesce(iv_panel_visible AND iv_seal_visible AND iv_bar_count>=1, false) AS iv_seen, iv_attack+iv_defense+iv_stamina AS total FROM raw)"


# The survey's tables, written out for DuckDB: b, sb, sd, hg, nd, md and so on are the signals by their initials.
SIGNAL_SQL = f"""{_base_sql()}, i AS (SELECT *, detail_card_brightness AS b, story_brightness AS sb, story_dark_ratio AS sd, hp_green_ratio AS hg, name_dark_ratio AS nd, moves_dark_ratio AS md, list_bright_row_bands AS bands, list_pokemon_art_signal AS la, pokemon_art_signal AS art,
 coalesce(horizontal_card_gap_ratio>=0.05,false) AS swipe, coalesce(detail_card_brightness>=0.7,false) AS card FROM s),
p AS (SELECT *, coalesce(b>=0.92 AND sb>=0.9 AND hg<0.01 AND md<0.08 AND nd>=0.035 AND nd<=0.16,false) AS grid, coalesce(b>=0.92 AND sb>=0.9 AND md<0.08 AND hg>=0.03 AND hg<=0.06 AND nd>=0.035 AND nd<=0.16 AND la>=0.015 AND la<=0.08 AND art>=0.1 AND art<=0.19 AND NOT iv_panel_visible AND NOT iv_seal_visible,false) AS sparse,
 coalesce(b>=0.93 AND sb>=0.9 AND hg<=0.04 AND md<=0.11 AND la>=0.01 AND la<=0.08 AND art>=0.1 AND art<=0.19 AND NOT iv_seal_visible,false) AS single, coalesce(b<0.7 AND (coalesce(nd>=0.4,false) OR coalesce(md>=0.45,false) OR coalesce(hg>=0.2 AND md>=0.2,false)),false) AS menu,
 card AND (coalesce(hg>=0.03,false) OR coalesce(md>=0.1,false) OR coalesce(nd>=0.025,false) OR coalesce(art>=0.08,false)) AS stable FROM i),
c AS (SELECT *, coalesce(sb>=0.68 AND sd>=0.08 AND greatest(orange_badge_ratio,coalesce(iv_seal_color_ratio,0))>=0.015 AND NOT hp_area_card_split_signal AND NOT (swipe AND b>=0.89) AND iv_panel_visible AND iv_seal_visible,false) AS app FROM p),
k AS (SELECT *, CASE WHEN grid OR sparse THEN 'list' WHEN NOT card AND bands>=3 THEN 'list' WHEN menu OR NOT card THEN 'non_extractable' WHEN b>=0.9 AND sb>=0.9 AND md>=0.08 AND NOT swipe THEN 'detail' WHEN app AND iv_seen THEN 'appraisal'
 WHEN bands>=3 AND hg<0.02 AND md>=0.18 AND md<0.3 THEN 'non_extractable' WHEN b>=0.7 AND hg>=0.03 AND nd>=0.025 THEN 'detail' WHEN b>=0.7 AND md>=0.1 THEN 'detail' WHEN (coalesce(b>=0.7,false)::INT+coalesce(hg>=0.03,false)::INT+coalesce(nd>=0.025,false)::INT+coalesce(md>=0.1,false)::INT)>=3 THEN 'detail' WHEN bands>=3 THEN 'list' ELSE 'non_extractable' END AS cls FROM c),
f AS (SELECT *, coalesce((nd>=0.042 AND nd<=0.045 AND b>=0.915 AND b<=0.918 AND art>=0.155 AND art<=0.17) OR (nd>=0.04 AND nd<=0.048 AND b>=0.917 AND b<=0.92 AND art>=0.155 AND art<=0.215),false) AS name_ev, coalesce(hp_region_dark_ratio>=0.036 AND hp_bar_edge_ratio>=0.09 AND hp_text_edge_ratio>=0.11,false) AS hp_ev,
 coalesce((nd>=0.055 AND nd<=0.075 AND b>=0.75 AND b<=0.83 AND art>=0.285 AND art<=0.34) OR (cls='appraisal' AND hg>=0.03 AND orange_badge_ratio>=0.015 AND b>=0.805 AND b<=0.812 AND art>=0.2 AND art<=0.22 AND nd>=0.085 AND nd<=0.12) OR (cls='detail' AND hg>=0.03 AND b>=0.9 AND b<=0.91 AND art>=0.19 AND art<=0.205 AND nd>=0.085 AND nd<=0.095),false) AS cp_ev,
 moves_tab_anchor_visible OR coalesce(art>=0.08,false) OR coalesce(tag_edge_ratio>=0.07,false) AS power_ev,
 coalesce(NOT swipe AND NOT hp_area_card_split_signal AND hp_bar_anchor_visible AND moves_tab_anchor_visible AND moves_visual_region_anchored AND (coalesce(moves_completion_footer_height,0)>=0.115 OR (coalesce(moves_new_attack_button_height,0)>=0.06 AND coalesce(moves_new_attack_button_green_ratio,0)>=0.35)) AND coalesce(moves_transition_guard_dark_ratio,1)<=0.012
  AND (coalesce(moves_fast_row_dark_ratio>=0.045 AND moves_charged_rows_dark_ratio>=0.07 AND moves_complete_rows_dark_ratio>=0.07 AND moves_completion_footer_dark_ratio>=0.085,false) OR coalesce(moves_fast_row_dark_ratio>=0.04 AND moves_charged_rows_dark_ratio>=0.055 AND moves_complete_rows_dark_ratio>=0.08 AND moves_completion_footer_dark_ratio>=0.2,false)),false) AS moves_ev FROM k)"""


@query(f"WITH {SIGNAL_SQL} SELECT l_orderkey, l_linenumber, cls AS raw_classification, single AS single_list, stable, menu, swipe FROM f")
def q_screen_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("l_orderkey", "l_linenumber", "raw_classification", F.col("single_list_screen_signal").alias("single_list"), F.col("stable_detail_signal").alias("stable"), F.col("menu_overlay_signal").alias("menu"), F.col("horizontal_swipe_signal").alias("swipe"))


@query(f"WITH {SIGNAL_SQL} SELECT l_orderkey, l_linenumber, name_ev, hp_ev, cp_ev, power_ev, moves_ev FROM f")
def q_visual_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"name_ev": "name_evidence", "hp_ev": "hp_evidence", "cp_ev": "cp_evidence", "power_ev": "power_evidence", "moves_ev": "moves_evidence"}
    return classified(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.col(v).alias(k) for k, v in names.items()])


@query(f"""WITH {SIGNAL_SQL} SELECT l_orderkey, l_linenumber, total::BIGINT AS iv_sum, CASE WHEN appraisal_perfect OR appraisal_star_count=4 THEN total=45 WHEN appraisal_star_count=0 THEN total<=22 WHEN appraisal_star_count=1 THEN total BETWEEN 23 AND 29 WHEN appraisal_star_count=2 THEN total BETWEEN 30 AND 36 ELSE total BETWEEN 37 AND 44 END AS agrees,
iv_seen, iv_seen AND iv_bar_count=3 AND CASE WHEN appraisal_perfect OR appraisal_star_count=4 THEN total=45 WHEN appraisal_star_count=0 THEN total<=22 WHEN appraisal_star_count=1 THEN total BETWEEN 23 AND 29 WHEN appraisal_star_count=2 THEN total BETWEEN 30 AND 36 ELSE total BETWEEN 37 AND 44 END AS complete FROM f""")
def q_iv_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("l_orderkey", "l_linenumber", "iv_sum", F.col("iv_star_agreement").alias("agrees"), "iv_seen", F.col("iv_seen_complete").alias("complete"))


#: Texts of the regions: what can be read differs from row to row.
TEXTS = {"cp": f"CASE {_X} % 3 WHEN 0 THEN 'CP ' || CAST({_X} % 900 + 100 AS STRING) ELSE '' END", "display_name": f"CASE {_X} % 4 WHEN 0 THEN 'Abcd' WHEN 1 THEN 'x1' ELSE '' END", "hp": f"CASE {_X} % 5 WHEN 0 THEN '50/60' ELSE 'hp' END", "weight": f"CASE {_X} % 6 WHEN 0 THEN '5.5 kg' ELSE 'kg' END", "height": f"CASE {_X} % 7 WHEN 0 THEN '1.5 m' ELSE '' END", "moves": f"CASE {_X} % 3 WHEN 0 THEN 'Tackle Frustration' WHEN 1 THEN 'Tackle' ELSE 'ab' END", "story": f"CASE {_X} % 2 WHEN 0 THEN 'This Abc was caught on 1/2/2024 around X, Y.' ELSE 'This' END", "special_sections": f"CASE {_X} % 8 WHEN 0 THEN 'GYMS & RAIDS Max Move 7 kg' WHEN 1 THEN 'gyms raids G-Max 2 m' WHEN 2 THEN 'gymraids' ELSE 'none' END"}


@query(f"""WITH {SIGNAL_SQL}, t AS (SELECT *, {_X} AS x FROM f), g AS (SELECT *, cls IN ('detail','appraisal') OR (cls<>'list' AND card AND NOT menu) AS maybe, cls='detail' AS d, cls='appraisal' AS a, x%8<3 AS tab, x%3<2 AND x%8<3 AS moves_read,
 x%6=0 OR x%8=0 AS weight, x%7=0 OR x%8=1 AS height, x%5=0 OR coalesce(hg>=0.03,false) AS hp FROM t),
h AS (SELECT *, maybe AND (x%3=0 OR cp_ev) AS g_cp, maybe AND (x%4=0 OR coalesce(nd>=0.05,false) OR name_ev) AS g_name, maybe AND hp AS g_hp, maybe AND weight AS g_weight, maybe AND d AND height AS g_height, maybe AND d AND (moves_read OR coalesce(md>=0.1,false)) AS g_moves,
 maybe AND d AND x%3=0 AND x%8<3 AS g_shadow, maybe AND d AND x%8=0 AS g_dyna, maybe AND d AND x%8=1 AS g_giga, a AND iv_seen AS g_iv, a AND x%2=0 AS g_story, maybe AND coalesce(tag_edge_ratio>=0.07,false) AS g_tag, maybe AND coalesce(art>=0.08,false) AS g_art FROM g),
o AS (SELECT *, CASE WHEN cls IN ('list','detail','appraisal') THEN cls WHEN menu OR NOT card THEN 'non_extractable' WHEN g_cp::INT+g_hp::INT+g_weight::INT+g_moves::INT+g_iv::INT+g_story::INT>=2 THEN 'detail' ELSE 'non_extractable' END AS label FROM h), z AS (SELECT *, label IN ('detail','appraisal') AS keep FROM o)
SELECT l_orderkey, l_linenumber, label AS classification, keep AND g_cp AS has_cp, keep AND g_name AS has_display_name, keep AND (hp OR hp_ev) AS has_hp, keep AND g_weight AS has_weight, keep AND g_height AS has_height, keep AND d AND moves_ev AS has_moves, keep AND g_shadow AS is_shadow, keep AND g_dyna AS has_dynamax, keep AND g_giga AS has_gigantamax,
keep AND g_iv AS has_iv, keep AND g_story AS has_story, keep AND g_tag AS has_tag_chips, keep AND g_art AS has_pokemon_art, cls='list' AND coalesce(list_text_dark_ratio>=0.012,false) AS has_list_cp, cls='list' AND coalesce(la>=0.015,false) AS has_list_pokemon_art FROM z""")
def q_feature_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = classified(spark, sf_dir).withColumns({f"ocr_{n}": F.expr(t) for n, t in TEXTS.items()})
    gated = screens.with_gates(screens.with_parsed(read))
    return gated.select("l_orderkey", "l_linenumber", "classification", "has_cp", "has_display_name", "has_hp", "has_weight", "has_height", "has_moves", "is_shadow", "has_dynamax", "has_gigantamax", "has_iv", "has_story", "has_tag_chips", "has_pokemon_art", "has_list_cp", "has_list_pokemon_art")


_ALL = "['cp','display_name','hp','weight','story','iv','iv_star_agreement','iv_sum','appraisal_star_count','appraisal_perfect','tag','height','moves','power','is_shadow','other']"


@query(f"""WITH {SIGNAL_SQL}, q AS (SELECT *, list_filter({_ALL}, lambda n: CASE WHEN n IN ('iv','iv_star_agreement','iv_sum','appraisal_star_count','appraisal_perfect','story') THEN cls='appraisal' WHEN n IN ('tag','hp','weight') THEN cls IN ('detail','appraisal') WHEN n IN ('height','is_shadow') THEN cls='detail'
 WHEN n='moves' THEN cls='detail' AND moves_ev WHEN n='power' THEN cls='detail' AND power_ev WHEN n='cp' THEN cls='appraisal' OR (cls='detail' AND cp_ev) WHEN n='display_name' THEN cls IN ('detail','appraisal') AND (coalesce(nd>=0.05,false) OR name_ev) ELSE true END) AS can FROM f)
SELECT l_orderkey, l_linenumber, list_aggregate(can,'string_agg',',') AS fields, coalesce(list_aggregate(list_sort(list_distinct(list_filter(can, lambda n: n IN ('cp','display_name','hp','weight','height','story')) || CASE WHEN list_contains(can,'moves') THEN ['moves','special_sections'] WHEN list_contains(can,'power') THEN ['special_sections'] ELSE [] END)),'string_agg',','),'') AS regions,
CASE cls WHEN 'appraisal' THEN 5 WHEN 'detail' THEN 7 ELSE 0 END::BIGINT AS read_by_class, CASE WHEN cls='appraisal' THEN 11 ELSE 8 END::BIGINT AS desired FROM q""")
def q_probe_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _ALL.strip("[]").replace("'", "").split(",")
    can = screens.probeable(F.array(*map(F.lit, names)))
    return classified(spark, sf_dir).withColumn("can", can).select("l_orderkey", "l_linenumber", F.array_join("can", ",").alias("fields"), F.array_join(screens.regions_for_fields(F.col("can")), ",").alias("regions"), F.size(screens.regions_for_class(F.lit("full"))).cast("long").alias("read_by_class"), F.size(screens.desired_fields()).cast("long").alias("desired"))
