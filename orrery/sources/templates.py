"""A catalogue made from a dump of templates: species, moves, evolutions, stats and multipliers; and its one-document form.

Templates have template_id, data (a variant) and at (their order). Members are taken only where they have the right kind: texts that are not empty, whole numbers or their digits, never booleans. What lacks a
required member is left out. An upstream dump is read from a path of any file system that Spark knows; nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import names, scoring
from orrery.sources.catalog import ARRAYS
from orrery.sources.catalog import templates as read_templates

#: Members of a template that describe a move, most telling first.
MOVE_KINDS = ("moveSettings", "combatMove", "combatMoveSettings")


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))


def text(v: Column, *paths: str) -> Column:
    """The first member that is a text and not empty."""
    return F.coalesce(*[F.when((_kind(v, p) == "STRING") & (F.try_variant_get(v, p, "string") != ""), F.try_variant_get(v, p, "string")) for p in paths])


def whole(v: Column, *paths: str) -> Column:
    """The first member that is a whole number, or a text of digits."""
    found = []
    for p in paths:
        raw, kind = F.try_variant_get(v, p, "string"), _kind(v, p)
        number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, p, "double"))
        found.append(F.when(number == F.floor(number), number.cast("int")))
        found.append(F.when((kind == "STRING") & raw.rlike("^[0-9]+$"), raw.try_cast("int")))
    return F.coalesce(*found)


def _settings(templates: DataFrame) -> DataFrame:
    """Templates of creatures, with v (their settings), id, key and form."""
    held = templates.select("at", "template_id", F.try_variant_get("data", "$.pokemonSettings", "variant").alias("v"))
    held = held.withColumn("id", text(F.col("v"), "$.pokemonId", "$.pokemon_id")).where("id is not null")
    return held.withColumns({"key": names.ascii_slug(F.col("id")), "form": names.form_title(text(F.col("v"), "$.form"), F.col("id"))})


def _sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def species(templates: DataFrame) -> DataFrame:
    v = F.col("v")
    from_id = F.regexp_extract("template_id", r"^V([0-9]{4})_POKEMON(?:_|$)", 1)
    dex = F.coalesce(whole(v, "$.pokedexId", "$.pokedex_id", "$.pokedexNumber"), F.when(from_id != "", from_id).try_cast("int"))
    held = _settings(templates).withColumn("dex", dex).where("dex is not null")
    ids = F.filter(F.array("id", "template_id"), lambda x: x.isNotNull())
    return held.groupBy(F.col("key").alias("species_key")).agg(F.min_by(names.species_title(F.col("id")), "at").alias("species_name"), F.min("dex").alias("pokedex_id"), _sorted_set(names.species_names(F.col("id"))).alias("aliases"), F.array_sort(F.collect_set("form")).alias("forms"), _sorted_set(ids).alias("upstream_ids"))


def moves(templates: DataFrame) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("kind"), F.try_variant_get("data", f"$.{m}", "variant").alias("v")) for k, m in enumerate(MOVE_KINDS)])
    held = templates.select("at", "template_id", F.explode(kinds).alias("m")).select("at", "template_id", "m.*").where("v is not null")
    held = held.withColumn("id", text(F.col("v"), "$.movementId", "$.uniqueId", "$.moveId")).where("id is not null")
    order, kind = F.struct("at", "k"), names.type_title(text(F.col("v"), "$.pokemonType", "$.pokemon_type", "$.type"))
    ids = F.filter(F.array("id", "template_id"), lambda x: x.isNotNull())
    return held.withColumn("type", kind).groupBy(names.ascii_slug(F.col("id")).alias("move_key")).agg(F.min_by(names.move_title(F.col("id")), order).alias("move_name"), F.min_by("type", F.when(F.col("type").isNotNull(), order)).alias("move_type"), F.min_by(names.move_category(F.col("id"), F.col("kind")), order).alias("category"), _sorted_set(ids).alias("upstream_ids"))


def evolutions(templates: DataFrame) -> DataFrame:
    held = _settings(templates).select("key", "form", F.explode(F.try_variant_get("v", "$.evolutionBranch", "array<variant>")).alias("b"))
    b = F.col("b")
    to = text(b, "$.evolution", "$.evolutionPokemonId", "$.pokemonId")
    rows = held.where(F.schema_of_variant(b).startswith("OBJECT")).withColumn("to", to).where("to is not null")
    form = names.form_title(text(b, "$.evolutionForm", "$.form", "$.pokemonDisplayForm"), F.col("to"))
    return rows.select(F.col("key").alias("species_key"), names.ascii_slug(F.col("to")).alias("evolves_to_key"), "form", form.alias("evolves_to_form"), F.lit(None).cast("string").alias("family_id")).distinct()


def base_stats(templates: DataFrame) -> DataFrame:
    """The last template of a species and form counts."""
    v = F.col("v")
    own = {c: F.coalesce(*[whole(v, f"$.{group}.{a}", f"$.{group}.{b}") for group in ("stats", "pokemonBaseStats")]) for c, a, b in (("base_attack", "baseAttack", "base_attack"), ("base_defense", "baseDefense", "base_defense"), ("base_stamina", "baseStamina", "base_stamina"))}
    held = _settings(templates).withColumns(own).where("base_attack is not null and base_defense is not null and base_stamina is not null")
    return held.groupBy(F.col("key").alias("species_key"), F.coalesce("form", F.lit("Normal")).alias("form")).agg(F.max_by(F.struct(*own), "at").alias("s")).select("species_key", "form", "s.*")


def cp_multipliers(templates: DataFrame, most: int = 50) -> DataFrame:
    """Levels up to `most` of the first template that has multipliers, and the half levels between them."""
    raw = F.try_variant_get("data", "$.playerLevel.cpMultiplier", "array<variant>")
    numbers = F.transform(F.filter(raw, lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")), lambda x: F.try_variant_get(x, "$", "double"))
    first = templates.select("at", numbers.alias("c")).where(F.size("c") > 0).agg(F.min_by("c", "at").alias("c")).where("c is not null")
    upto = F.sequence(F.lit(1), F.least(F.size("c"), F.lit(most)))

    def steps(n: Column) -> Column:
        own, after = F.get("c", n - 1), F.get("c", n)
        return F.array(F.struct(n.cast("double").alias("level"), own.alias("cpm")), F.struct((n + 0.5).cast("double").alias("level"), F.when(n < most, scoring.half_level(own, after)).alias("cpm")))

    return first.select(F.explode(F.flatten(F.transform(upto, steps))).alias("x")).select("x.*").where("cpm is not null")


def build(templates: DataFrame) -> dict[str, DataFrame]:
    """The catalogue's five tables."""
    return {"species": species(templates), "moves": moves(templates), "evolutions": evolutions(templates), "base_stats": base_stats(templates), "cp_multipliers": cp_multipliers(templates)}


#: The order of entries in a document.
_ORDER = {"species": ("pokedex_id", "species_key"), "moves": ("move_key",), "evolutions": ("species_key", "form", "evolves_to_key", "evolves_to_form"), "base_stats": ("species_key", "form"), "cp_multipliers": ("level",)}


def write_catalog(catalog: dict[str, DataFrame], path: str, generated_at: str | None = None, upstream: dict[str, str] | None = None) -> None:
    """One JSON document, as catalog.read_catalog reads it. A catalogue is a dimension: it goes through one task."""
    whole_ = None
    for name in ARRAYS:
        table = catalog[name]
        key = F.struct(*[F.coalesce(F.col(c), F.lit("")) if dict(table.dtypes)[c] == "string" else F.col(c) for c in _ORDER[name]])
        entries = table.agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.struct(*[c for c in table.columns if c != "at"]).alias("e")))), lambda x: x["e"]).alias(name))
        whole_ = entries if whole_ is None else whole_.crossJoin(entries)  # one row each
    about = F.struct(*[F.lit(v).alias(k) for k, v in (upstream or {"timestamp": None}).items()])
    whole_.select(F.lit(2).alias("schema_version"), F.lit(generated_at).alias("generated_at"), about.alias("upstream"), *ARRAYS).coalesce(1).write.mode("overwrite").json(path)


def sync(spark: SparkSession, dump: str, out: str, **about) -> dict[str, int]:
    """Makes a catalogue of a dump and writes it; counts by table. A dump with templates that gives an empty catalogue is an error, and nothing is written."""
    held = read_templates(spark, dump).checkpoint()
    made = {k: v.checkpoint() for k, v in build(held).items()}
    counts = {k: v.count() for k, v in made.items()}
    if not held.isEmpty() and not any(counts.values()):
        raise ValueError("The dump gives no entry of any kind; the catalogue stays as it is.")
    write_catalog(made, out, **about)
    return counts
