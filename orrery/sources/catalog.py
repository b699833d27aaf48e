"""Catalogues: one JSON document with arrays of entries, and template dumps with nested data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.parsers import form_or_normal, slug

#: The arrays of a catalogue and their entries.
ARRAYS = {
    "species": "species_key string, species_name string, pokedex_id int, aliases array<string>, forms array<string>, upstream_ids array<string>",
    "moves": "move_key string, move_name string, move_type string, category string, upstream_ids array<string>",
    "evolutions": "species_key string, evolves_to_key string, form string, evolves_to_form string, family_id string",
    "base_stats": "species_key string, form string, base_attack int, base_defense int, base_stamina int",
    "cp_multipliers": "level double, cpm double",
}


def _entries(v: Column, name: str) -> Column:
    """An array's objects; what is no array is an error, absence is an empty one."""
    raw = F.try_variant_get(v, f"$.{name}", "array<variant>")
    there = F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
    checked = F.when(there & raw.isNull(), F.raise_error(F.lit(f"{name} must be a list"))).otherwise(raw)
    return F.filter(checked, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def read_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A DataFrame for each array, with each entry's place in the document in column at; entries without their key are left out, base stats get the form Normal where they have none."""
    document = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    out = {}
    for name, schema in ARRAYS.items():
        fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
        held = document.select(F.posexplode(_entries(F.col("v"), name)).alias("at", "e"))
        rows = held.select(*[F.try_variant_get("e", f"$.{n}", kind).alias(n) for n, kind in fields], F.col("at").cast("long").alias("at"))
        key = fields[0][0]
        rows = rows.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
        out[name] = rows.withColumn("form", form_or_normal(F.col("form"))) if name == "base_stats" else rows
    return out


#: Fixed value: the columns of a table of moves that can't be had again.
LEGACY = "species_key string, evolution_species_key string, move_name string, move_type string, note string"


def read_legacy_moves(spark: SparkSession, path: str) -> DataFrame:
    """A curated CSV of species, evolution_species, move_name, move_type and note: species as slugs or null; rows without a move's name are skipped."""
    rows = spark.read.option("header", True).csv(path)
    key = lambda c: F.when(slug(F.coalesce(F.col(c), F.lit(""))) != "", slug(F.col(c)))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return rows.where(text("move_name") != "").select(key("species").alias("species_key"), key("evolution_species").alias("evolution_species_key"), text("move_name").alias("move_name"), text("move_type").alias("move_type"), text("note").alias("note"))


def templates(spark: SparkSession, path: str) -> DataFrame:
    """template_id, data (a variant) and at (its place) of a dump: a list, or an object with itemTemplates or templates. Items may nest under data and then inherit the outer id."""
    v = F.col("v")
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    items = F.coalesce(F.when(is_list, F.try_variant_get(v, "$", "array<variant>")), F.try_variant_get(v, "$.itemTemplates", "array<variant>"), F.try_variant_get(v, "$.templates", "array<variant>"))
    document = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    held = document.select(F.posexplode(F.coalesce(items, F.raise_error(F.lit("no list of templates")))).alias("at", "e"))
    inner = F.coalesce(F.try_variant_get("e", "$.data", "variant"), F.col("e"))
    held = held.select("at", "e", inner.alias("data"))
    return held.select(F.coalesce(F.try_variant_get("data", "$.templateId", "string"), F.try_variant_get("e", "$.templateId", "string")).alias("template_id"), "data", F.col("at").cast("long").alias("at"))
