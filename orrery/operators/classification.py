"""Classification of an inventory: who is worth keeping, by attack, by leagues and by moves that can't be had again.

A table of any columns is read by their normal names. A catalogue has species, evolutions, base_stats and cp_multipliers (see sources.catalog); legacy has species_key,
evolution_species_key, move_name and note. What depends on the species alone (evolutions, finals, stats, families, legacy moves) is worked out once for each (species, form) that occurs; leagues are
settled over the distinct (species, form, values), at most 4096 of each form, so the inventory's rows are shuffled only to be numbered and joined. Absent texts are null. An empty table gives an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import parsers, scoring
from orrery.functions.names import key_title, normal_move, normal_name
from orrery.operators import evolution, lookups

# Names by which columns are known, the columns added, and the texts of reasons.
SPECIES_ALIASES = ("species_key", "species", "species_name", "canonical_name")
MOVE_ALIASES = ("fast_move", "fast_move_name", "fast_move_key", "charged_move_1", "charged_move_1_name", "charged_move", "charged_move_name", "charged_move_key", "charged_move_2", "charged_move_2_name", "second_charged_move", "second_charged_move_name", "second_charged_move_key")
VALUES = ("iv_attack", "iv_defense", "iv_stamina")
ADDED = ("family_id", "best_final_evolution", "attacker_score", "attacker_top3", "attacker_rank_in_family", "attacker_as_species", *[f"pvp_{x}_{y}" for x in ("ll", "gl", "ul") for y in ("best", "as_species", "stat_product", "level", "iv_rank")], "possible_legacy_elite_move", "possible_legacy_elite_moves", "has_detected_legacy_move", "protection_flags", "recommendation", "reason")
POSSIBLE, DETECTED, NOTHING = "possible legacy/Elite move", "detected legacy move", "not a top owned attacker or PvP candidate"


def column_key(name: str) -> str:
    """A column's normal name: no case, signs as single underscores."""
    return "_".join(re.sub(r"[\W_]+", " ", name.casefold()).split())


def _known(table: DataFrame) -> dict[str, str]:
    found: dict[str, str] = {}
    for c in table.columns:
        found.setdefault(column_key(c), c)
    return found


def _text(known: dict[str, str], alias: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{known[alias]}`").cast("string")), F.lit("")) if alias in known else F.lit("")


def numbered(table: DataFrame, name: str = "__idx") -> DataFrame:
    """table with the place of each row, from 0, in the order of its partitions; without a sort. Checkpointed, as the numbers must not change."""
    held = table.withColumns({"__part": F.spark_partition_id(), "__in": F.monotonically_increasing_id()}).checkpoint()
    parts = held.groupBy("__part").agg(F.count("*").alias("n"), F.min("__in").alias("first"))
    begins = parts.select(F.col("__part").alias("p"), "first", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("before"))  # one row for each partition
    return held.join(F.broadcast(begins), F.col("__part") == F.col("p")).withColumn(name, F.col("__in") - F.col("first") + F.col("before")).drop("__part", "__in", "p", "first", "before")


def validate(table: DataFrame) -> tuple[list[str], DataFrame]:
    """Errors of the table, and warnings (row, counted from 2 as a header stands before; problem) of rows without a species or with a bad value."""
    known, errors = _known(table), []
    if table.isEmpty():
        errors.append("the input has no rows")
    if not any(a in known for a in SPECIES_ALIASES):
        errors.append("the input has no column of species")
    errors += [f"the input has no column {c}" for c in VALUES if c not in known]
    named = F.lit(False)
    for a in SPECIES_ALIASES:
        named = named | (_text(known, a) != "")
    problems = [F.when(~named, "missing species")] + [F.when(parsers.parse_iv(_text(known, c)).isNull(), f"missing or invalid {c}") for c in VALUES]
    rows = numbered(table)
    return errors, rows.select((F.col("__idx") + 2).alias("row"), F.explode(F.filter(F.array(*problems), lambda x: x.isNotNull())).alias("problem"))


def species_index(species: DataFrame) -> DataFrame:
    """norm, key for the names, aliases and keys that one species alone claims."""
    names = species.select("species_key", F.explode(F.concat(F.array("species_name", "species_key"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return lookups.unique_index(names, normal_name(F.col("name")), "species_key")


def resolved(rows: DataFrame, known: dict[str, str], species: DataFrame) -> DataFrame:
    """Adds species_key: a key of the catalogue, else by name, else by a name's slug, alias after alias; else the slug of an unknown key."""
    key = parsers.slug(_text(known, "species_key"))
    attempts = [(0, "key", key)]
    for k, alias in enumerate(SPECIES_ALIASES[1:]):
        text = _text(known, alias)
        attempts += [(2 * k + 1, "name", normal_name(text)), (2 * k + 2, "key", parsers.slug(text))]
    tried = rows.select("__idx", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), text.alias("text")) for k, kind, text in attempts])).alias("a")).select("__idx", "a.*").where("text <> ''")
    there = species_index(species).select(F.lit("name").alias("kind"), F.col("norm").alias("text"), "key").unionByName(species.select(F.lit("key").alias("kind"), F.col("species_key").alias("text"), F.col("species_key").alias("key")).distinct())
    found = tried.join(there, ["kind", "text"]).groupBy("__idx").agg(F.min_by("key", "k").alias("__found"))
    return rows.join(found, "__idx", "left").withColumn("species_key", F.coalesce("__found", F.when(key != "", key))).drop("__found")


def families_of(catalog: dict[str, DataFrame]) -> DataFrame:
    """species_key, family_id: the component of the evolution graph, named by its least number in the index, then key."""
    s, e = catalog["species"], catalog["evolutions"]
    keys = s.select("species_key").unionByName(catalog["base_stats"].select("species_key")).unionByName(e.select("species_key")).unionByName(e.select(F.col("evolves_to_key").alias("species_key")))
    rooted = evolution.families(keys.distinct().withColumnRenamed("species_key", "node"), e.select(F.col("species_key").alias("src"), F.col("evolves_to_key").alias("dst")))
    dex = _last(s, "species_key", "pokedex_id").select(F.col("__k").alias("node"), F.col("__v").alias("pokedex_id"))
    ranked = rooted.join(dex, "node", "left").withColumn("o", F.struct(F.coalesce("pokedex_id", F.lit(9999)), "node"))
    heads = ranked.groupBy("root").agg(F.min_by("node", "o").alias("family_id"))
    return rooted.join(heads, "root").select(F.col("node").alias("species_key"), "family_id")


def _last(entries: DataFrame, key: str, value: str) -> DataFrame:
    """__k and __v: the value of each key's last entry, by its place in the document (column at), or by the order of rows where that isn't known."""
    held = entries if "at" in entries.columns else entries.withColumn("at", F.monotonically_increasing_id())
    return held.groupBy(F.col(key).alias("__k")).agg(F.max_by(value, "at").alias("__v"))


def with_stats(found: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds atk, def, sta and stat_form of (node, form_key): of the form itself, else the normal one, else the only one. Of several entries of a form the last one of the document counts."""
    placed = stats if "at" in stats.columns else stats.withColumn("at", F.monotonically_increasing_id())
    keyed = placed.select("at", "species_key", parsers.form_or_normal(F.col("form")).alias("stat_form"), F.col("base_attack").alias("atk"), F.col("base_defense").alias("def"), F.col("base_stamina").alias("sta")).withColumn("k", normal_name(F.col("stat_form")))
    one = F.struct("stat_form", "atk", "def", "sta")
    by_form = keyed.groupBy("species_key", "k").agg(F.max_by(one, "at").alias("s"))
    sole = keyed.groupBy("species_key").agg(F.count("*").alias("n"), F.max_by(one, "at").alias("only")).where("n = 1").select(F.col("species_key").alias("s3"), "only")
    exact = by_form.select(F.col("species_key").alias("s1"), F.col("k").alias("k1"), F.col("s").alias("exact"))
    normal = by_form.where("k = 'normal'").select(F.col("species_key").alias("s2"), F.col("s").alias("normal"))
    joined = found.join(exact, (F.col("node") == F.col("s1")) & (F.col("form_key") == F.col("k1")), "left").join(normal, F.col("node") == F.col("s2"), "left").join(sole, F.col("node") == F.col("s3"), "left")
    return joined.withColumn("__s", F.coalesce("exact", "normal", "only")).select(*found.columns, "__s.*")


def _named(df: DataFrame, key: str, species: DataFrame, out: str) -> DataFrame:
    """Adds the name of the species in a column; a key without an entry is put into words."""
    names = _last(species, "species_key", "species_name").withColumnRenamed("__v", "__n")
    return df.join(names, F.col(key) == F.col("__k"), "left").withColumn(out, F.when(F.col(key).isNotNull(), F.coalesce("__n", key_title(F.col(key))))).drop("__k", "__n")


def best_final(ends: DataFrame, species: DataFrame) -> DataFrame:
    """start, start_form, final_key and final_form_key: the final of most attack, then most of all, then the later in the index; one without stats comes last."""
    dex = _last(species, "species_key", "pokedex_id").withColumnRenamed("__v", "pokedex_id")
    known = F.col("atk").isNotNull()
    joined = ends.join(dex, F.col("node") == F.col("__k"), "left")
    order = [F.desc(F.coalesce("atk", F.lit(0))), F.desc(F.coalesce(F.col("atk") + F.col("def") + F.col("sta"), F.lit(0))), F.desc(F.when(known, F.coalesce("pokedex_id", F.lit(9999))).otherwise(0)), F.desc("node"), "depth", "trail"]
    ranked = joined.withColumn("__r", F.row_number().over(W.partitionBy("start", "start_form").orderBy(*order))).where("__r = 1")
    return ranked.select("start", "start_form", F.col("node").alias("final_key"), F.col("form_key").alias("final_form_key"))


def best_levels(df: DataFrame, multipliers: list[tuple[float, float]], caps: tuple = scoring.LEAGUES) -> DataFrame:
    """df (atk, def, sta and values) for each league whose cap some level keeps, with the highest such level, its multiplier and product. Levels are a bounded array within the row: no join."""
    a, d, s = F.col("atk") + F.col("iv_attack"), F.col("def") + F.col("iv_defense"), F.col("sta") + F.col("iv_stamina")
    steps = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(cpm).alias("cpm")) for level, cpm in multipliers]) if multipliers else F.expr("cast(array() as array<struct<level: double, cpm: double>>)")
    spread = df.withColumn("__c", F.explode(F.array(*[F.struct(F.lit(n).alias("league"), F.lit(cap).alias("cap")) for n, cap in caps]))).select("*", "__c.*").drop("__c")
    fits = lambda x: scoring.combat_points(a, d, s, x["cpm"]) <= F.col("cap")
    if all(x[1] <= y[1] for x, y in zip(multipliers, multipliers[1:])):
        # Points rise with the multiplier: the last step that fits is found by halving.
        span = F.struct(F.lit(-1).alias("low"), F.lit(len(multipliers) - 1).alias("high"))

        def half(at: Column, _: Column) -> Column:
            middle = F.floor((at["low"] + at["high"] + 1) / 2).cast("int")
            return F.when(at["low"] == at["high"], at).when(fits(F.get(steps, middle)), F.struct(middle.alias("low"), at["high"].alias("high"))).otherwise(F.struct(at["low"].alias("low"), (middle - 1).alias("high")))

        best = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(multipliers).bit_length()))), span, half, lambda at: F.when(at["low"] >= 0, F.get(steps, at["low"])))
    else:
        best = F.try_element_at(F.filter(steps, fits), F.lit(-1))
    leveled = spread.withColumn("__b", best).where("__b is not null").select("*", "__b.level", "__b.cpm").drop("__b")
    return leveled.withColumn("product", scoring.stat_product(a, d, s, F.col("cpm")))


def iv_ranks(winners: DataFrame, multipliers: list[tuple[float, float]]) -> DataFrame:
    """winners (atk, def, sta, values, league, level, product) with iv_rank among all 4096 triples of their stats: those better are counted, not sorted."""
    keys = winners.select("atk", "def", "sta", "league").distinct()
    sixteen = F.explode(F.sequence(F.lit(0), F.lit(15)))
    grid = keys.select("atk", "def", "sta").distinct()
    for c in VALUES:
        grid = grid.withColumn(c, sixteen)
        if c == VALUES[0]:
            grid = grid.repartition(int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # sixteen rows a stat line, before there are 4096
    better = best_levels(grid, multipliers).select("atk", "def", "sta", "league", F.struct((-F.col("product")).alias("p"), (-F.col("level")).alias("l"), *VALUES).alias("other"))
    own = winners.withColumn("__own", F.struct((-F.col("product")).alias("p"), (-F.col("level")).alias("l"), *VALUES))
    met = own.join(better, ["atk", "def", "sta", "league"]).where(F.col("other") <= F.col("__own"))
    return met.groupBy(*winners.columns).agg(F.count("*").alias("iv_rank"))


def legacy_of(reached: DataFrame, legacy: DataFrame, species: DataFrame) -> DataFrame:
    """start, start_form, the labels of legacy moves of all that a start can become, sorted, and the moves' normal names."""
    entries = legacy.where(F.trim("move_name") != "").withColumn("__about", F.coalesce("evolution_species_key", "species_key"))
    entries = _named(entries, "__about", species, "__who")
    label = F.concat(F.coalesce("__who", F.lit("Unknown")), F.lit(": "), "move_name", F.when(F.coalesce(F.col("note"), F.lit("")) != "", F.concat(F.lit(" ("), "note", F.lit(")"))).otherwise(""))
    spread = entries.select(F.explode(F.array_distinct(F.filter(F.array("species_key", "evolution_species_key"), lambda x: x.isNotNull()))).alias("__key"), label.alias("label"), normal_move(F.col("move_name")).alias("move"))
    return reached.join(spread, F.col("node") == F.col("__key")).groupBy("start", "start_form").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("legacy_labels"), F.collect_set("move").alias("legacy_moves"))


def classify(table: DataFrame, catalog: dict[str, DataFrame], legacy: DataFrame) -> DataFrame:
    """table with the columns ADDED, in its order of rows by column __idx."""
    known = _known(table)
    species = catalog["species"].checkpoint()
    multipliers = [(float(r[0]), float(r[1])) for r in catalog["cp_multipliers"].select("level", "cpm").distinct().orderBy("level").collect()]  # a hundred levels
    edges = catalog["evolutions"].withColumn("__at", F.monotonically_increasing_id()).select(F.col("species_key").alias("src"), F.col("evolves_to_key").alias("dst"), "form", F.col("evolves_to_form").alias("to_form"), F.col("__at").alias("at")).checkpoint()
    values = {c: parsers.parse_iv(_text(known, c)) for c in VALUES}
    shadow_known = "shadow" in known or "is_shadow" in known
    shadow = parsers.parse_bool(_text(known, "shadow")) | parsers.parse_bool(_text(known, "is_shadow"))
    rows = numbered(table)
    held = resolved(rows, known, species).select("__idx", F.col("species_key").alias("start"), parsers.form_or_normal(_text(known, "form")).alias("start_form"), *[v.alias(c) for c, v in values.items()], (shadow if shadow_known else F.lit(False)).alias("shadow"), F.array(*[normal_move(_text(known, a)) for a in MOVE_ALIASES if a in known]).cast("array<string>").alias("moves")).checkpoint()
    starts = held.where("start is not null").select(F.col("start").alias("node"), F.col("start_form").alias("form")).distinct()
    reached = with_stats(evolution.candidates(starts, edges), catalog["base_stats"]).checkpoint()
    finals = best_final(evolution.finals(reached, edges), species)
    finals = _named(finals, "final_key", species, "final_name")
    family = families_of(catalog)
    by_start = reached.where("depth = 0").select("start", "start_form").join(family, F.col("start") == F.col("species_key"), "left").select("start", "start_form", F.coalesce("family_id", "start").alias("family_id")).join(finals, ["start", "start_form"], "left").join(legacy_of(reached, legacy, species), ["start", "start_form"], "left").checkpoint()
    owned = held.join(by_start, ["start", "start_form"], "left")
    whole = F.col("iv_attack").isNotNull() & F.col("iv_defense").isNotNull() & F.col("iv_stamina").isNotNull()
    owned = owned.withColumn("score", F.when(whole, scoring.attacker_score(*[F.col(c) for c in VALUES])))

    # The three best attackers of each final form: Spark keeps three rows of a group in each task before it shuffles.
    order = W.partitionBy("final_key", "final_form_key", "shadow").orderBy(F.desc("score"), *[F.desc(c) for c in VALUES], "__idx")
    top = owned.where(F.col("score").isNotNull() & F.col("final_key").isNotNull()).withColumn("attacker_rank", F.row_number().over(order)).where("attacker_rank <= 3").select("__idx", "attacker_rank")

    # The best of each family and league, over the distinct values of each species and form; the first row and the nearest form win ties.
    distinct = owned.where(whole & F.col("start").isNotNull()).groupBy("start", "start_form", "family_id", *VALUES).agg(F.min("__idx").alias("__idx"))
    leveled = best_levels(distinct.join(reached.where("atk is not null"), ["start", "start_form"]), multipliers)
    rank = F.struct((-F.col("product")).alias("a"), (-F.col("level")).alias("b"), (-(F.col("iv_attack") + F.col("iv_defense") + F.col("iv_stamina"))).alias("c"), "__idx", "depth", "trail")
    won = leveled.groupBy("family_id", "league").agg(F.min_by(F.struct("__idx", "node", "atk", "def", "sta", *VALUES, "level", "product"), rank).alias("w")).select("family_id", "league", "w.*")
    named = _named(iv_ranks(won, multipliers), "node", species, "as_species")
    entry = F.struct(F.col("as_species"), F.round("product", 3).alias("stat_product"), "level", "iv_rank")
    leagues = named.groupBy("__idx").agg(*[F.max(F.when(F.col("league") == n, entry)).alias(f"__{n.lower()}") for n, _ in scoring.LEAGUES])

    joined = owned.join(top, "__idx", "left").join(leagues, "__idx", "left")
    legacy_there = F.col("legacy_labels").isNotNull()
    detected = F.coalesce(legacy_there & F.arrays_overlap(F.filter("moves", lambda x: x != ""), "legacy_moves"), F.lit(False))
    keep = [F.when(F.col("attacker_rank").isNotNull(), F.concat(F.lit("attacker top "), F.col("attacker_rank").cast("string")))]
    keep += [F.when(F.col(f"__{n.lower()}").isNotNull(), f"best owned PvP {n}") for n, _ in scoring.LEAGUES] + [F.when(detected, DETECTED)]
    no_edges, no_stats = edges.isEmpty(), not multipliers or catalog["base_stats"].isEmpty()
    missing = [F.when(F.col("start").isNull(), "missing species"), F.when(~whole, "missing IV triplet"), F.when(F.lit(no_edges), "missing evolution metadata"), F.when(F.lit(no_stats), "missing PvP stats metadata")]
    some = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    kept, possible, review = some(keep), some([F.when(legacy_there, POSSIBLE)]), some([F.when(legacy_there, POSSIBLE), *missing])
    added = {
        "family_id": F.col("family_id"), "best_final_evolution": F.col("final_name"), "attacker_score": F.col("score"), "attacker_top3": F.col("attacker_rank").isNotNull(), "attacker_rank_in_family": F.col("attacker_rank"), "attacker_as_species": F.when(F.col("attacker_rank").isNotNull(), F.col("final_name")),
        **{f"pvp_{n.lower()}_{x}": (F.col(f"__{n.lower()}").isNotNull() if x == "best" else F.col(f"__{n.lower()}")[x]) for n, _ in scoring.LEAGUES for x in ("best", "as_species", "stat_product", "level", "iv_rank")},
        "possible_legacy_elite_move": legacy_there, "possible_legacy_elite_moves": F.col("legacy_labels"), "has_detected_legacy_move": detected, "protection_flags": F.lit(None).cast("string"),
        "recommendation": F.when(F.size(kept) > 0, "KEEP").when(F.size(review) > 0, "REVIEW").otherwise("LET-GO"),
        "reason": F.array_join(F.when(F.size(kept) > 0, F.array_distinct(F.concat(kept, possible))).when(F.size(review) > 0, F.array_distinct(review)).otherwise(F.array(F.lit(NOTHING))), "; "),
    }
    judged = joined.select("__idx", *[v.alias(c) for c, v in added.items()])
    fresh = [c for c in table.columns if column_key(c) not in ADDED]
    return rows.select("__idx", *[F.col(f"`{c}`") for c in fresh]).join(judged, "__idx")


def output_columns(table: DataFrame) -> list[str]:
    """The input's columns, then those added that it has not already, whatever their spelling."""
    there = {column_key(c) for c in table.columns}
    return [*table.columns, *[c for c in ADDED if c not in there]]


def sheets(classified: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a workbook: all rows, each verdict, each league's best, attackers, legacy warnings and counts."""
    from orrery.sinks.tables import VERDICTS, summary

    found = {"All": classified} | {v: classified.where(F.col("recommendation") == v) for v in VERDICTS}
    found |= {f"PvP {name} League": classified.where(f"pvp_{key}_best") for name, key in (("Great", "gl"), ("Ultra", "ul"), ("Little", "ll"))}
    return found | {"Attacker Top 3": classified.where("attacker_top3"), "Legacy Warnings": classified.where("possible_legacy_elite_move"), "Summary": summary(classified)}
