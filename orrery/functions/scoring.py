"""Arithmetic of the domain, as column expressions. The order of the factors is fixed, so that doubles agree bit by bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAGUES = (("LL", 500), ("GL", 1500), ("UL", 2500))


def combat_points(attack: Column, defense: Column, stamina: Column, cpm: Column) -> Column:
    """attack, defense and stamina with their individual values added."""
    return F.greatest(F.lit(10), F.floor(attack * F.sqrt(defense.cast("double")) * F.sqrt(stamina.cast("double")) * cpm * cpm / 10)).cast("long")


def stat_product(attack: Column, defense: Column, stamina: Column, cpm: Column) -> Column:
    return (attack * cpm) * (defense * cpm) * F.floor(stamina * cpm)


def attacker_score(attack: Column, defense: Column, stamina: Column) -> Column:
    return (10 * attack + defense + stamina).cast("long")


def star_tier(total: Column) -> Column:
    """Stars of an appraisal that the sum of its three values calls for; the badge of a perfect one shows three as well."""
    return F.when(total.between(0, 22), 0).when(total.between(23, 29), 1).when(total.between(30, 36), 2).when(total.between(37, 45), 3).cast("long")


def stars_agree(total: Column, stars: Column, perfect: Column) -> Column:
    """Whether the stars seen are those of the sum: four, or a perfect mark, stand for 45 only."""
    top = F.coalesce(perfect, F.lit(False)) | (stars == 4)
    return F.coalesce(F.when(stars.isNull(), False).when(top, total == 45).otherwise((star_tier(total) == stars) & (total <= 44)), F.lit(False))


def half_level(a: Column, b: Column) -> Column:
    return F.sqrt((a * a + b * b) / 2)
