"""From judged frames to fragments: what a frame tells, behind its gates, and the species and moves that its texts name.

Frames have the gates and parsed values of screens.with_gates, the decoded values of an appraisal, and texts of regions (ocr_*). A fragment has fields (a map of texts) and sources (the
field's origin and the gate that let it through). Frames that tell nothing, transitions and what can't be extracted give none. Nulls are absent. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import parsers
from orrery.functions.names import move_names, normal_move, normal_name, specific_max_move
from orrery.operators import lookups

HEADER = ("source_file", "source_type", "frame_index", "timestamp_s", "classification", "raw_classification")
#: Slots that moves fill in the order in which they are shown.
SLOTS = ("fast_move", "charged_move", "second_charged_move")
_DETAIL_FLAGS, _LIST_FLAGS = ("is_shadow", "has_dynamax", "has_gigantamax", "has_tag_chips"), ("has_list_grid", "has_list_cp", "has_list_display_name", "has_list_pokemon_art")


def _text(name: str) -> Column:
    flat = parsers.flat(F.col(f"ocr_{name}"))
    return F.when(flat != "", flat)


def _detail() -> list[tuple[str, Column, Column, str, str]]:
    """(field, gate, value, source, evidence)."""
    hp = parsers.hp_parts(F.col("hp"))
    story = parsers.parse_story(F.coalesce(F.col("story_text"), _text("story")))
    gate, text = F.col, lambda c: c.cast("string")
    power = gate("has_dynamax") | gate("has_gigantamax")
    found = [
        ("cp", gate("has_cp"), text(F.col("cp")), "value", "has_cp"),
        ("display_name_text", gate("has_display_name"), parsers.display_name(_text("display_name")), "text", "has_display_name"),
        ("hp_current", gate("has_hp"), text(hp["current"]), "value", "has_hp"),
        ("hp_max", gate("has_hp"), text(hp["max"]), "value", "has_hp"),
        ("weight_kg", gate("has_weight"), text(F.col("weight_kg").try_cast("double")), "value", "has_weight"),
        ("height_m", gate("has_height"), text(F.col("height_m").try_cast("double")), "value", "has_height"),
        ("moves_text", gate("has_moves"), _text("moves"), "text", "has_moves"),
        ("power_section_text", power, _text("special_sections"), "text", "has_dynamax or has_gigantamax"),
    ]
    found += [(f, gate("has_story"), story[k], "story", "has_story") for f, k in (("canonical_name_text", "name"), ("catch_date_text", "date"), ("location_text", "location"), ("catch_country_text", "country"))]
    found += [("iv_complete", gate("has_iv"), text(F.coalesce(gate("has_iv_complete"), F.lit(False))), "gate", "has_iv_complete")]
    found += [(c, gate("has_iv"), text(F.col(c)), "decoded", "has_iv") for c in ("iv_attack", "iv_defense", "iv_stamina", "iv_sum", "appraisal_star_count", "appraisal_perfect", "iv_star_agreement")]
    return found + [(c, gate(c), F.lit("true"), "gate", c) for c in _DETAIL_FLAGS]


def _list() -> list[tuple[str, Column, Column, str, str]]:
    flags = [(c, F.col(c), F.lit("true"), "gate", c) for c in _LIST_FLAGS]
    return [*flags, ("list_cp_text", F.col("has_list_cp"), _text("cp"), "text", "has_list_cp"), ("list_display_name_text", F.col("has_list_display_name"), _text("display_name"), "text", "has_list_display_name")]


def _maps(specs: list[tuple[str, Column, Column, str, str]]) -> tuple[Column, Column]:
    held = F.array(*[F.when(gate & value.isNotNull() & (value != ""), F.struct(F.lit(f).alias("f"), value.alias("v"), F.struct(F.lit(s).alias("source"), F.lit(e).alias("evidence")).alias("s"))) for f, gate, value, s, e in specs])
    kept = F.filter(held, lambda x: x.isNotNull())
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["f"], x["v"]))), F.map_from_entries(F.transform(kept, lambda x: F.struct(x["f"], x["s"])))


def extract(frames: DataFrame) -> DataFrame:
    """HEADER, fragment_type, fields and sources of the frames that tell something; other columns of frames that begin with seq_ stay."""
    usable = frames.where(~F.coalesce("has_transition", F.lit(False)) & F.col("classification").isin("list", "detail", "appraisal"))
    (d, ds), (li, ls) = _maps(_detail()), _maps(_list())
    is_list = F.col("classification") == "list"
    out = usable.select(*[c for c in frames.columns if c.startswith("seq_")], *HEADER, F.col("classification").alias("fragment_type"), F.when(is_list, li).otherwise(d).alias("fields"), F.when(is_list, ls).otherwise(ds).alias("sources"))
    return out.where(F.size("fields") > 0)


def _added(fields: Column, more: dict[str, Column]) -> Column:
    """The map with the values that are not null in place of its own."""
    fresh = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in more.items()]), lambda x: x["v"].isNotNull()))
    return F.map_concat(F.map_filter(fields, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)


def with_species(fragments: DataFrame, species: DataFrame) -> DataFrame:
    """Adds species_key, species_name and pokedex_id by the name of the story, or the shown one where there is none: an exact name first, then one within one edit that is alone.

    The name of a species replaces one that was only shown, or that was mended.
    """
    held = fragments.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    named = F.map_contains_key("fields", F.lit("canonical_name_text"))
    text = F.when(named, F.col("fields")["canonical_name_text"]).otherwise(F.col("fields")["display_name_text"])
    names = species.select("species_key", F.explode(F.concat(F.array("species_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).select(normal_name(F.col("name")).alias("norm"), F.col("species_key").alias("key")).where("norm <> ''").distinct()
    asked = held.select("__row", normal_name(text).alias("norm")).where("norm <> ''").checkpoint()
    exact = lookups.exact(asked, F.col("norm"), lookups.unique_index(names, F.col("norm"), "key"), "exact")
    mended = lookups.fuzzy(asked.join(exact.where("exact is null").select("__row"), "__row", "left_semi"), F.col("norm"), "__row", names, "near").select("__row", "near")
    found = exact.join(mended, "__row", "left").select("__row", F.coalesce("exact", "near").alias("__key"), F.col("exact").isNull().alias("__mended")).where("__key is not null")
    about = species.select(F.col("species_key").alias("__key"), "species_name", "pokedex_id").dropDuplicates(["__key"])
    joined = held.join(found.join(about, "__key"), "__row", "left")
    fields = _added(F.col("fields"), {"species_key": F.col("__key"), "species_name": F.col("species_name"), "pokedex_id": F.col("pokedex_id"), "canonical_name_text": F.when(~named | F.col("__mended"), F.col("species_name"))})
    return joined.withColumn("fields", F.when(F.col("__key").isNotNull(), fields).otherwise(F.col("fields"))).select(*fragments.columns)


def move_index(moves: DataFrame) -> DataFrame:
    """norm, key for the names that one move alone claims."""
    names = moves.select("move_key", F.explode(move_names(F.col("move_name"), F.col("move_key"), F.col("upstream_ids"))).alias("name"))
    return lookups.unique_index(names, normal_move(F.col("name")), "move_key")


def near_names(held: DataFrame, known: DataFrame) -> DataFrame:
    """row, is_max, at, tokens and key of grams (row, at, tokens, gram) that lie within the allowed edits of one name (norm, key, is_max, tokens) alone.

    A name in one part more than it may have edits leaves one part whole in any text within them: parts, with their number and the name's length, are the keys of an equi-join.
    """
    names = known.where(F.length("norm") >= 5).withColumn("edits", F.when(F.col("norm").contains(" ") & (F.length("norm") >= 9), 2).otherwise(1))
    index = names.select("norm", "key", "is_max", "tokens", "edits", F.explode(lookups.name_keys(F.col("norm"), F.col("edits"))).alias("k"))
    asked = held.select("gram", "tokens").distinct().where(F.length("gram") >= 3)
    tried = asked.withColumn("k", F.explode(lookups.text_keys(F.col("gram"), F.when(F.col("tokens") > 1, 2).otherwise(1))))
    met = tried.join(index, ["tokens", "k"]).where(F.levenshtein("gram", "norm", 2) >= 0).where(F.levenshtein("gram", "norm") <= F.col("edits"))
    alone = met.groupBy("gram", "tokens", "is_max").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key")).where("n = 1").drop("n")
    return held.join(alone, ["gram", "tokens"]).select("row", "is_max", "at", "tokens", "key")


def mentions(texts: DataFrame, row: str, text: Column, moves: DataFrame) -> DataFrame:
    """row, is_max and keys: the moves that a text names, each once, in their order; ordinary moves and max moves apart.

    A name counts where it stands as whole words, or where as many words lie within its allowed edits of it and of no other (two for longer names of several words, else one; names
    of five letters at least). Words that name something else exactly don't, nor a word and `bonus` after it. Of overlapping ones the leftmost, then the longest counts. Words meet
    names by equal segments (near_names).
    """
    index = move_index(moves)
    own = moves.select(normal_move(F.col("move_name")).alias("norm"), F.col("move_key").alias("key")).join(index.withColumnRenamed("key", "k"), "norm").where("key = k").select("norm", "key").distinct()
    known = own.select("norm", "key", specific_max_move(F.col("norm")).alias("is_max"), F.size(F.split("norm", " ")).alias("tokens")).checkpoint()  # a catalogue's moves
    wide = F.array(*map(F.lit, sorted(r[0] for r in known.select("tokens").distinct().collect()) or [1]))
    level = F.regexp_replace(normal_move(text), r"\b[a-z0-9]+\s+bonus\b", " ")
    words = texts.select(F.col(row).alias("row"), F.filter(F.split(level, " "), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    grams = F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.transform(F.filter(wide, lambda n: i + n <= F.size("w")), lambda n: F.struct(i.alias("at"), n.alias("tokens"), F.array_join(F.slice("w", i + 1, n), " ").alias("gram")))))
    held = words.select("row", F.explode(grams).alias("g")).select("row", "g.*")
    exact = held.join(known.withColumnRenamed("norm", "gram").drop("tokens"), "gram").select("row", "is_max", "at", "tokens", "key")
    near = near_names(held.where(~F.col("gram").endswith(" bonus")).join(index.select(F.col("norm").alias("gram")), "gram", "left_anti"), known)
    spans = exact.unionByName(near).groupBy("row", "is_max").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("tokens")).alias("m"), "key"))).alias("s"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("keys"))
    chosen = F.aggregate("s", start, lambda acc, x: F.when(x["at"] >= acc["end"], F.struct((x["at"] - x["m"]).alias("end"), F.concat(acc["keys"], F.array(x["key"])).alias("keys"))).otherwise(acc), lambda acc: acc["keys"])
    return spans.select("row", "is_max", F.array_distinct(chosen).alias("keys"))


def with_moves(fragments: DataFrame, moves: DataFrame) -> DataFrame:
    """Adds the first three ordinary moves that moves_text names to the slots, by their order on the screen, and a max move of the power section, else of the moves."""
    held = fragments.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    parts = held.select("__row", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col("fields")[c].alias("text")) for k, c in enumerate(("power_section_text", "moves_text"))])).alias("p")).select(F.struct("__row", "p.part").alias("id"), "p.text").where("text is not null")
    found = mentions(parts, "id", F.col("text"), moves).select("row.__row", "row.part", "is_max", "keys")
    ordinary = F.max(F.when((F.col("part") == 1) & ~F.col("is_max"), F.col("keys")))
    best = F.min(F.when(F.col("is_max"), F.struct("part", F.get("keys", F.lit(0)).alias("key"))))["key"]
    slots = found.groupBy("__row").agg(ordinary.alias("__o"), best.alias("__m")).select("__row", *[F.get("__o", F.lit(k)).alias(s) for k, s in enumerate(SLOTS)], F.col("__m").alias("max_move"))
    names = moves.select(F.col("move_key").alias("__k"), "move_name").dropDuplicates(["__k"])
    named = slots
    for s in (*SLOTS, "max_move"):
        named = named.join(names.select(F.col("__k").alias(f"__{s}"), F.col("move_name").alias(f"{s}_name")), F.col(s) == F.col(f"__{s}"), "left")
    joined = held.join(named, "__row", "left")
    more = {f"{s}_{x}": F.col(s) if x == "key" else F.col(f"{s}_name") for s in (*SLOTS, "max_move") for x in ("key", "name")}
    return joined.withColumn("fields", _added(F.col("fields"), more)).select(*fragments.columns)
