"""What a frame shows, by rules over its signals: predicates, the screen's class, feature gates, and which fields are worth reading.

Rules are SQL predicates over columns of the signals' names. A missing column or a null makes a predicate false. Rules apply row by row in one pass; empty tables give empty ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import parsers, scoring

# The predicates over signals, in the order in which they build on each other.
PREDICATES = {
    "detail_card_visible": "detail_card_brightness >= 0.70",
    "horizontal_swipe_signal": "horizontal_card_gap_ratio >= 0.05",
    "list_grid_signal": "detail_card_brightness >= 0.92 AND story_brightness >= 0.90 AND hp_green_ratio < 0.01 AND moves_dark_ratio < 0.08 AND name_dark_ratio BETWEEN 0.035 AND 0.16",
    "sparse_list_grid_signal": "detail_card_brightness >= 0.92 AND story_brightness >= 0.90 AND moves_dark_ratio < 0.08 AND hp_green_ratio BETWEEN 0.03 AND 0.06 AND name_dark_ratio BETWEEN 0.035 AND 0.16 AND list_pokemon_art_signal BETWEEN 0.015 AND 0.08 AND pokemon_art_signal BETWEEN 0.10 AND 0.19 AND NOT coalesce(iv_panel_visible, false) AND NOT coalesce(iv_seal_visible, false)",
    "single_list_screen_signal": "detail_card_brightness >= 0.93 AND story_brightness >= 0.90 AND hp_green_ratio <= 0.04 AND moves_dark_ratio <= 0.11 AND list_pokemon_art_signal BETWEEN 0.01 AND 0.08 AND pokemon_art_signal BETWEEN 0.10 AND 0.19 AND NOT coalesce(iv_seal_visible, false)",
    "menu_overlay_signal": "detail_card_brightness < 0.70 AND (name_dark_ratio >= 0.40 OR moves_dark_ratio >= 0.45 OR (hp_green_ratio >= 0.20 AND moves_dark_ratio >= 0.20))",
    "stable_detail_signal": "detail_card_visible AND (hp_green_ratio >= 0.03 OR moves_dark_ratio >= 0.10 OR name_dark_ratio >= 0.025 OR pokemon_art_signal >= 0.08)",
    "name_evidence": "(name_dark_ratio BETWEEN 0.042 AND 0.045 AND detail_card_brightness BETWEEN 0.915 AND 0.918 AND pokemon_art_signal BETWEEN 0.155 AND 0.170) OR (name_dark_ratio BETWEEN 0.040 AND 0.048 AND detail_card_brightness BETWEEN 0.917 AND 0.920 AND pokemon_art_signal BETWEEN 0.155 AND 0.215)",
    "hp_evidence": "hp_region_dark_ratio >= 0.036 AND hp_bar_edge_ratio >= 0.090 AND hp_text_edge_ratio >= 0.110",
    "power_evidence": "coalesce(moves_tab_anchor_visible, false) OR pokemon_art_signal >= 0.08 OR coalesce(tag_edge_ratio, 0) >= 0.07",
    "moves_evidence": """NOT horizontal_swipe_signal AND NOT coalesce(hp_area_card_split_signal, false) AND NOT coalesce(sequence_transition_signal, false) AND hp_bar_anchor_visible AND moves_tab_anchor_visible AND moves_visual_region_anchored
        AND (coalesce(moves_completion_footer_height, 0) >= 0.115 OR (coalesce(moves_new_attack_button_height, 0) >= 0.060 AND coalesce(moves_new_attack_button_green_ratio, 0) >= 0.35)) AND coalesce(moves_transition_guard_dark_ratio, 1) <= 0.012
        AND ((moves_fast_row_dark_ratio >= 0.045 AND moves_charged_rows_dark_ratio >= 0.070 AND moves_complete_rows_dark_ratio >= 0.070 AND moves_completion_footer_dark_ratio >= 0.085)
          OR (moves_fast_row_dark_ratio >= 0.040 AND moves_charged_rows_dark_ratio >= 0.055 AND moves_complete_rows_dark_ratio >= 0.080 AND moves_completion_footer_dark_ratio >= 0.200))""",
}
# The screen's class by the first rule that holds. {appraisal} is whether one may be seen.
CLASSES = (
    ("list_grid_signal OR sparse_list_grid_signal", "list"),
    ("NOT detail_card_visible AND list_bright_row_bands >= 3", "list"),
    ("menu_overlay_signal OR NOT detail_card_visible", "non_extractable"),
    ("detail_card_brightness >= 0.90 AND story_brightness >= 0.90 AND moves_dark_ratio >= 0.08 AND NOT horizontal_swipe_signal", "detail"),
    ("{appraisal} AND story_brightness >= 0.68 AND story_dark_ratio >= 0.08 AND greatest(orange_badge_ratio, coalesce(iv_seal_color_ratio, 0)) >= 0.015 AND NOT coalesce(hp_area_card_split_signal, false) AND NOT (horizontal_swipe_signal AND detail_card_brightness >= 0.89) AND iv_panel_visible AND iv_seal_visible", "appraisal"),
    ("list_bright_row_bands >= 3 AND hp_green_ratio < 0.02 AND moves_dark_ratio >= 0.18 AND moves_dark_ratio < 0.30", "non_extractable"),
    ("detail_card_brightness >= 0.70 AND ((hp_green_ratio >= 0.03 AND name_dark_ratio >= 0.025) OR moves_dark_ratio >= 0.10)", "detail"),
    ("if(detail_card_brightness >= 0.70, 1, 0) + if(hp_green_ratio >= 0.03, 1, 0) + if(name_dark_ratio >= 0.025, 1, 0) + if(moves_dark_ratio >= 0.10, 1, 0) >= 3", "detail"),
    ("list_bright_row_bands >= 3", "list"),
)
# Bands in which the points show though they can't be read; they depend on the class.
CP_EVIDENCE = """(name_dark_ratio BETWEEN 0.055 AND 0.075 AND detail_card_brightness BETWEEN 0.75 AND 0.83 AND pokemon_art_signal BETWEEN 0.285 AND 0.34)
 OR (raw_classification = 'appraisal' AND hp_green_ratio >= 0.03 AND orange_badge_ratio >= 0.015 AND detail_card_brightness BETWEEN 0.805 AND 0.812 AND pokemon_art_signal BETWEEN 0.20 AND 0.22 AND name_dark_ratio BETWEEN 0.085 AND 0.12)
 OR (raw_classification = 'detail' AND hp_green_ratio >= 0.03 AND detail_card_brightness BETWEEN 0.90 AND 0.91 AND pokemon_art_signal BETWEEN 0.19 AND 0.205 AND name_dark_ratio BETWEEN 0.085 AND 0.095)"""
# Words of power sections, and of a shadow's moves.
DYNAMAX_WORDS, GIGANTAMAX_WORDS, SHADOW_WORDS = ("dynamax", "max move", "max guard", "max spirit"), ("gigantamax", "g max", "gmax"), ("shadow bonus", "frustration")
DETAIL_GATES = ("has_cp", "has_display_name", "has_hp", "has_weight", "has_height", "has_moves", "is_shadow", "has_dynamax", "has_gigantamax", "has_iv", "has_iv_complete", "has_story", "has_tag_chips", "has_pokemon_art")
LIST_GATES = ("has_list_grid", "has_list_cp", "has_list_display_name", "has_list_pokemon_art")
# Fields by class, those that never conflict, the regions that tell them, and regions read by class.
APPRAISAL_FIELDS = ("cp", "display_name", "hp", "weight", "story", "iv", "iv_star_agreement", "iv_sum", "appraisal_star_count", "appraisal_perfect", "tag")
DETAIL_FIELDS = ("cp", "display_name", "hp", "weight", "height", "tag", "moves", "power")
FREE_FIELDS = ("display_name", "height", "moves", "power", "tag", "is_shadow", "has_dynamax", "has_gigantamax", "iv_sum", "appraisal_star_count", "appraisal_perfect")
REGIONS_OF_FIELD = {"cp": ("cp",), "hp": ("hp",), "weight": ("weight",), "height": ("height",), "display_name": ("display_name",), "moves": ("moves", "special_sections"), "power": ("special_sections",), "story": ("story",), "has_dynamax": ("special_sections",), "has_gigantamax": ("special_sections",)}
REGIONS_OF_CLASS = {"appraisal": ("cp", "display_name", "hp", "weight", "story"), "detail": ("cp", "display_name", "hp", "weight", "height", "moves", "special_sections")}
# When a field may be told from a frame; fields not named always may.
PROBEABLE = {
    **dict.fromkeys(("iv", "iv_star_agreement", "appraisal_perfect", "appraisal_star_count", "iv_sum", "story"), "raw_classification = 'appraisal'"),
    **dict.fromkeys(("tag", "hp", "weight"), "raw_classification IN ('detail', 'appraisal')"),
    **dict.fromkeys(("is_shadow", "has_dynamax", "has_gigantamax", "height"), "raw_classification = 'detail'"),
    "moves": "raw_classification = 'detail' AND moves_evidence",
    "power": "raw_classification = 'detail' AND power_evidence",
    "cp": "raw_classification = 'appraisal' OR (raw_classification = 'detail' AND cp_evidence)",
    "display_name": "raw_classification IN ('detail', 'appraisal') AND (name_dark_ratio >= 0.05 OR name_evidence)",
}
_WORD = re.compile(r"[a-z_]+")
_FLAGS = ("iv_panel_visible", "iv_seal_visible", "hp_area_card_split_signal", "sequence_transition_signal", "hp_bar_anchor_visible", "moves_tab_anchor_visible", "moves_visual_region_anchored")


def signal_names() -> list[str]:
    """The columns that rules read and no rule makes."""
    text = " ".join([*PREDICATES.values(), *(c for c, _ in CLASSES), CP_EVIDENCE])
    words = {w for w in _WORD.findall(re.sub(r"'[^']*'|\{\w+\}", " ", text)) if "_" in w}
    return sorted(words - set(PREDICATES) - {"raw_classification", "non_extractable"})


def _holds(rule: str) -> Column:
    return F.coalesce(F.expr(rule), F.lit(False))


def with_predicates(df: DataFrame) -> DataFrame:
    """Adds the predicates; signals that df lacks are null."""
    missing = {n: F.lit(None).cast("boolean" if n in _FLAGS else "double") for n in signal_names() if n not in df.columns}
    out = df.withColumns(missing) if missing else df
    for name, rule in PREDICATES.items():
        out = out.withColumn(name, _holds(rule))
    return out


def raw_class(allow_appraisal: Column | bool = True) -> Column:
    """The class by the first rule that holds, over the columns of with_predicates."""
    found, may = F.lit("non_extractable"), allow_appraisal if isinstance(allow_appraisal, Column) else F.lit(allow_appraisal)
    for rule, label in reversed(CLASSES):
        holds = _holds(rule.replace("{appraisal} AND ", ""))
        found = F.when(holds & may if "{appraisal}" in rule else holds, label).otherwise(found)
    return found


def with_iv_evidence(df: DataFrame) -> DataFrame:
    """Adds iv_sum, iv_star_agreement, iv_seen and iv_seen_complete from the decoded bars and stars."""
    total = F.col("iv_attack") + F.col("iv_defense") + F.col("iv_stamina")
    seen = _holds("iv_panel_visible AND iv_seal_visible AND iv_bar_count >= 1")
    out = df.withColumns({"iv_sum": total.cast("long"), "iv_star_agreement": scoring.stars_agree(total, F.col("appraisal_star_count"), F.col("appraisal_perfect")), "iv_seen": seen})
    return out.withColumn("iv_seen_complete", F.col("iv_seen") & _holds("iv_bar_count = 3 AND iv_star_agreement"))


def with_classes(df: DataFrame) -> DataFrame:
    """Adds raw_classification: an appraisal counts only if its values are seen, else the rules run without it."""
    return with_predicates(df).withColumn("raw_classification", raw_class(F.coalesce("iv_seen", F.lit(False)))).withColumn("cp_evidence", _holds(CP_EVIDENCE))


def with_parsed(df: DataFrame, prefix: str = "ocr_") -> DataFrame:
    """Adds cp, hp, weight_kg, height_m, story_text, moves_text and special_text from texts of regions; moves count only under their tab, measures may stand in the special section."""
    text = lambda name: F.coalesce(F.col(f"{prefix}{name}"), F.lit(""))
    special = text("special_sections")
    measure = lambda f, name: F.coalesce(f(text(name)), f(special))
    moves = F.when(parsers.moves_tab(special), text("moves")).otherwise("")
    return df.withColumns({"cp": parsers.parse_cp(text("cp")), "hp": parsers.parse_hp(text("hp")), "weight_kg": measure(parsers.parse_weight, "weight"), "height_m": measure(parsers.parse_height, "height"), "story_text": F.when(text("story") != "", text("story")), "story_sentence_complete": parsers.story_complete(text("story")), "moves_text": moves, "special_text": special})


def with_gates(df: DataFrame, prefix: str = "ocr_") -> DataFrame:
    """Adds the feature gates and the final classification to a table with predicates, classes and parsed texts.

    A transition is never extractable; a list, a detail and an appraisal stay what they are; anything else under a visible card is a detail by two votes of six.
    Gates of a detail are false on all that ends up as neither detail nor appraisal.
    """
    raw = F.col("raw_classification")
    maybe = raw.isin("detail", "appraisal") | ((raw != "list") & F.col("detail_card_visible") & ~F.col("menu_overlay_signal"))
    detail, appraisal, is_list = raw == "detail", raw == "appraisal", raw == "list"
    power = F.concat_ws(" ", "special_text", "moves_text")
    giga = detail & parsers.contains_word(power, GIGANTAMAX_WORDS)
    above = lambda name, least: F.coalesce(F.col(name) >= least, F.lit(False))
    hp = F.col("hp").isNotNull() | above("hp_green_ratio", 0.03)
    draft = {
        "has_cp": F.col("cp").isNotNull() | F.col("cp_evidence"),
        "has_display_name": parsers.has_letters(F.col(f"{prefix}display_name")) | above("name_dark_ratio", 0.05) | F.col("name_evidence"),
        "has_hp": hp,
        "has_weight": F.col("weight_kg").isNotNull(),
        "has_height": detail & F.col("height_m").isNotNull(),
        "has_moves": detail & (parsers.has_letters(F.col("moves_text")) | above("moves_dark_ratio", 0.10)),
        "is_shadow": detail & parsers.contains_word(F.concat_ws(" ", "moves_text", "special_text"), SHADOW_WORDS),
        "has_dynamax": detail & ~giga & parsers.contains_word(power, DYNAMAX_WORDS),
        "has_gigantamax": giga,
        "has_iv": appraisal & F.col("iv_seen"),
        "has_iv_complete": appraisal & F.col("iv_seen_complete"),
        "has_story": appraisal & F.col("story_sentence_complete"),
        "has_tag_chips": above("tag_edge_ratio", 0.07),
        "has_pokemon_art": above("pokemon_art_signal", 0.08),
    }
    texts = is_list & above("list_text_dark_ratio", 0.012)
    listed = {"has_list_grid": is_list, "has_list_cp": texts, "has_list_display_name": texts, "has_list_pokemon_art": is_list & above("list_pokemon_art_signal", 0.015)}
    out = df.withColumns({k: F.coalesce(maybe & v, F.lit(False)) for k, v in draft.items()} | listed)
    votes = sum((F.col(k).cast("int") for k in ("has_cp", "has_hp", "has_weight", "has_moves", "has_iv", "has_story")), F.lit(0))
    transition = F.coalesce(F.col("sequence_transition_signal"), F.lit(False))
    label = F.when(transition, "non_extractable").when(raw.isin("list", "detail", "appraisal"), raw).when(F.col("menu_overlay_signal") | ~F.col("detail_card_visible"), "non_extractable").when(votes >= 2, "detail").otherwise("non_extractable")
    out = out.withColumns({"has_transition": transition, "classification": label})
    kept = F.col("classification").isin("detail", "appraisal")
    final = {k: kept & F.col(k) for k in DETAIL_GATES} | {"has_hp": kept & (hp | F.col("hp_evidence")), "has_moves": kept & detail & F.col("moves_evidence")}
    return out.withColumns(final)


def demoted(df: DataFrame, transition: Column) -> DataFrame:
    """df with the frames of a transition taken out of what can be extracted: their detail gates fall, but for moves that were seen complete."""
    moves = transition & (F.col("raw_classification") == "detail") & F.col("moves_evidence")
    cleared = {k: F.when(transition, False).otherwise(F.col(k)) for k in DETAIL_GATES} | {"has_moves": F.when(transition, moves).otherwise(F.col("has_moves"))}
    return df.withColumns(cleared | {"has_transition": F.col("has_transition") | transition, "sequence_transition_signal": F.coalesce(F.col("sequence_transition_signal"), F.lit(False)) | transition, "classification": F.when(transition, "non_extractable").otherwise(F.col("classification"))})


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def desired_fields() -> Column:
    return F.when(F.col("raw_classification") == "appraisal", _texts(*APPRAISAL_FIELDS)).otherwise(_texts(*DETAIL_FIELDS))


def probeable(fields: Column) -> Column:
    """Those of the fields that the frame may tell, by its class and signals."""
    barred = F.array(*[F.when(~_holds(rule), name) for name, rule in PROBEABLE.items()])  # each rule once a frame
    return F.array_except(fields, F.array_compact(barred))


def regions_for_fields(fields: Column) -> Column:
    """Regions to read for the fields, each once, sorted."""
    regions = F.create_map(*[x for name, found in REGIONS_OF_FIELD.items() for x in (F.lit(name), _texts(*found))])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(fields, lambda f: F.coalesce(regions[f], _texts())))))


def regions_for_class(mode: Column) -> Column:
    """Regions to read on a frame of its class; none where reading is off. The two reading modes don't differ."""
    by = F.create_map(*[x for name, found in REGIONS_OF_CLASS.items() for x in (F.lit(name), _texts(*found))])
    return F.when(mode == "off", _texts()).otherwise(F.coalesce(by[F.col("raw_classification")], _texts()))


def after_completion(fields: Column, power_pending: Column) -> Column:
    """What is still worth probing once a sequence is complete: points always; height, and power that was not told, on a detail."""
    detail = F.col("raw_classification") != "appraisal"
    late = F.filter(fields, lambda f: (f == "cp") | (detail & (f == "height")))
    return F.when(detail & power_pending, F.array_union(late, _texts("power"))).otherwise(late)
