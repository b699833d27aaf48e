"""Names: normal forms, and titles of upper-case ids. Nulls are empty names."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names that don't follow from their ids, and further names.
SPECIAL_NAMES = {
    "FARFETCHD": "Farfetch'd",
    "SIRFETCHD": "Sirfetch'd",
    "MR_MIME": "Mr. Mime",
    "MIME_JR": "Mime Jr.",
    "HO_OH": "Ho-Oh",
    "PORYGON_Z": "Porygon-Z",
    "TYPE_NULL": "Type: Null",
    "WO_CHIEN": "Wo-Chien",
    "CHI_YU": "Chi-Yu",
    "TING_LU": "Ting-Lu",
    "CHIEN_PAO": "Chien-Pao",
    "JANGMO_O": "Jangmo-o",
    "HAKAMO_O": "Hakamo-o",
    "KOMMO_O": "Kommo-o",
    "NIDORAN_FEMALE": "Nidoran Female",
    "NIDORAN_MALE": "Nidoran Male",
}
FURTHER_NAMES = {"MR_MIME": ("Mr Mime", "Mister Mime"), "MIME_JR": ("Mime Jr",), "NIDORAN_FEMALE": ("Nidoran F",), "NIDORAN_MALE": ("Nidoran M",)}


@lru_cache(1 << 16)
def normal(name: str | None, signs_part: bool = False) -> str:
    """Compatibility forms, no case, no marks on letters, `&` as a word; other signs go, or part words. Single blanks."""
    flat = unicodedata.normalize("NFKD", name or "").casefold().replace("&", " and ")
    kept = (c if c.isalnum() or c.isspace() else " " if signs_part else "" for c in flat if not unicodedata.category(c).startswith("M"))
    return " ".join("".join(kept).split())


@F.pandas_udf(StringType())
def _normal(names: pd.Series) -> pd.Series:
    return names.map(normal, na_action=None)


@F.pandas_udf(StringType())
def _normal_parted(names: pd.Series) -> pd.Series:
    return names.map(lambda x: normal(x, True), na_action=None)


def normal_name(name: Column) -> Column:
    """Normal name of a species or form. Spark has no compatibility forms, so this goes through Arrow."""
    return _normal(F.coalesce(name, F.lit("")))


def normal_move(name: Column) -> Column:
    """Normal name of a move, whose signs part words."""
    return _normal_parted(F.coalesce(name, F.lit("")))


def title(game_id: Column) -> Column:
    """`A_BIG_NAME` as `A Big Name`."""
    parts = F.filter(F.split(game_id, "_"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), " ")


def species_title(game_id: Column) -> Column:
    special = F.create_map(*[F.lit(x) for pair in SPECIAL_NAMES.items() for x in pair])
    return F.coalesce(special[game_id], title(game_id))


def species_names(game_id: Column) -> Column:
    """All names of a species, sorted: its title, its id, the id in words, and further ones."""
    further = F.create_map(*[x for k, names in FURTHER_NAMES.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])
    words = F.initcap(F.lower(F.replace(game_id, F.lit("_"), F.lit(" "))))
    some = F.concat(F.array(species_title(game_id), words, game_id), F.coalesce(further[game_id], F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(some, lambda x: x != "")))


def move_title(game_id: Column) -> Column:
    return title(F.regexp_replace(game_id, "_FAST$", ""))


def form_title(form_id: Column, game_id: Column) -> Column:
    """A form's name without that of its species; null where there is no form."""
    own = F.when(form_id.startswith(F.concat(game_id, F.lit("_"))), F.substr(form_id, F.length(game_id) + 2)).otherwise(form_id)
    return F.when(own.isin("", "NORMAL"), "Normal").otherwise(title(own))


def type_title(type_id: Column) -> Column:
    return title(F.regexp_replace(type_id, "^POKEMON_TYPE_", ""))


def move_category(game_id: Column, kind: Column) -> Column:
    """fast by the id; else combat for settings of combat, charged for the rest."""
    return F.when(game_id.endswith("_FAST"), "fast").when(kind == "combatMove", "combat").otherwise("charged")


def ascii_slug(game_id: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(game_id), "[^a-z0-9]+", "-"), "^-|-$", "")


def key_title(key: Column) -> Column:
    """A slug as a name, where a catalogue has none."""
    return title(F.replace(key, F.lit("-"), F.lit("_")))


def move_names(name: Column, key: Column, upstream_ids: Column) -> Column:
    """The names by which a move may be asked for: its own, its key in words, and its ids in words, without what all ids of moves have."""
    ids = F.transform(upstream_ids, lambda x: F.replace(F.regexp_replace(F.regexp_replace(x, "^(COMBAT_MOVE_)?(MOVE_)?", ""), "_FAST$", ""), F.lit("_"), F.lit(" ")))
    return F.concat(F.array(name, F.replace(key, F.lit("-"), F.lit(" "))), F.coalesce(ids, F.array().cast("array<string>")))


def specific_max_move(normal_: Column) -> Column:
    """Whether a normal move name is that of one max move, not of all."""
    return (normal_.startswith("max ") | normal_.startswith("g max ")) & ~normal_.isin("max move", "max moves")
