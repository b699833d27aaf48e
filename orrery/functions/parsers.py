"""Tolerant parsers of recognised text, as column expressions. Nulls parse to null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike letters of digits, the ranges in which a value counts, spellings of a damaged prefix, signs that may stand before a measure, words of the interface and of a story.
GLYPHS, DIGITS = "OoIl|LSsTtB", "00111155448"
CP_RANGE, WEIGHT_MOST, HEIGHT_MOST = (10, 9366), 1000.0, 100.0
TRUE_WORDS = ("1", "true", "t", "yes", "y")
DAMAGED_PREFIX = "(?:c+p+e?|c+e+p+|e+p+|c+e+)"
BEFORE_MEASURE = r"\s(:;\[{|"
INTERFACE_WORDS = ("cp", "hp", "weight", "height", "stardust", "candy", "power up", "gyms", "raids", "trainer battles")
STORY_WORDS = ("this", "caught", "around")


def present(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (F.trim(c) != "")


def _number(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def parse_cp(text: Column) -> Column:
    """Combat points: the number after the prefix, else after a damaged one, else the first lone number of 3 to 5 digits in range. A prefixed number that goes on, or lies out of range, gives null."""
    clean = F.translate(F.regexp_replace(text, r"([0-9])\s+\|+\s*\z", "$1"), GLYPHS, DIGITS)
    ends, low = r"([0-9]{2,5})(?![\s,.]*[0-9])", F.lower(clean)
    explicit = F.regexp_extract(clean, r"(?i)\bCP\s*[:#-]?\s*" + ends + r"\b", 1)
    damaged = F.regexp_extract(low, DAMAGED_PREFIX + r"\s*" + ends, 1)
    lone = F.filter(F.regexp_extract_all(clean, F.lit(r"\b[0-9]{3,5}\b"), F.lit(0)), lambda n: n.cast("int").between(*CP_RANGE))
    found = F.when(explicit != "", _number(explicit)).when(damaged != "", _number(damaged)).when(~low.rlike(DAMAGED_PREFIX), _number(F.try_element_at(lone, F.lit(1))))
    return F.when(found.between(*CP_RANGE), found).cast("long")


def has_cp_prefix(text: Column) -> Column:
    """Whether a prefix, sound or damaged, stands right before two digits or more once all other signs are taken out."""
    compact = F.regexp_replace(F.lower(F.translate(text, GLYPHS, DIGITS)), "[^a-z0-9]+", "")
    return F.coalesce(compact.rlike(DAMAGED_PREFIX + "[0-9]{2,5}"), F.lit(False))


def parse_hp(text: Column) -> Column:
    """Hit points as `n/d`, the first match only, with n at most d and d at least 10."""
    clean = F.translate(text, GLYPHS, DIGITS)
    pattern = r"([0-9]{1,3})\s*/\s*([0-9]{2,3})"
    n, d = (_number(F.regexp_extract(clean, pattern, k)) for k in (1, 2))
    return F.when((n <= d) & (d >= 10), F.concat_ws("/", n.cast("string"), d.cast("string")))


def hp_parts(hp: Column) -> Column:
    ok = F.regexp_extract(hp, r"^([0-9]{1,3})/([0-9]{2,3})$", 0) != ""
    parts = F.split(hp, "/")
    return F.when(ok, F.struct(parts[0].cast("long").alias("current"), parts[1].cast("long").alias("max")))


def _measure(text: Column, whole: int, unit: str, most: float, strip_integers: bool) -> Column:
    clean = F.lower(F.replace(text, F.lit(","), F.lit(".")))
    pattern = r"(?:^|(?<=[%s]))([0-9]{1,%d}(?:\.[0-9]{1,2})?)\s*%s\b" % (BEFORE_MEASURE, whole, unit)
    sound = F.filter(F.regexp_extract_all(clean, F.lit(pattern), F.lit(1)), lambda x: (x.cast("double") > 0) & (x.cast("double") <= most))
    digits = F.try_element_at(sound, F.lit(1))
    bare = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", "")
    return bare if strip_integers else F.when(digits.contains("."), bare).otherwise(digits)


def parse_weight(text: Column, strip_integers: bool = True) -> Column:
    """The first measure in range, in kilograms, as text without closing zeros. strip_integers keeps the known quirk by which `100 kg` gives `1`."""
    return _measure(text, 4, "kg", WEIGHT_MOST, strip_integers)


def parse_height(text: Column, strip_integers: bool = True) -> Column:
    return _measure(text, 2, "m", HEIGHT_MOST, strip_integers)


def flat(text: Column) -> Column:
    """Without white space at the ends, single blanks within."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


_STORY = r"(?i)\bThis ((?:(?![.!?] This\b).)+?) was caught on ([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}) around ([^.!?]*[^.!?\s]) ?[.!?]"


def parse_story(text: Column) -> Column:
    """name, date (text), location and country (the location's last part) of the first sentence that tells a catch, in either case; null without one."""
    line = flat(text)
    name, date, place = (F.trim(F.regexp_extract(line, _STORY, k)) for k in (1, 2, 3))
    parts = F.filter(F.transform(F.split(place, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(name != "", F.struct(name.alias("name"), date.alias("date"), place.alias("location"), F.coalesce(F.try_element_at(parts, F.lit(-1)), place).alias("country")))


def story_complete(text: Column) -> Column:
    """Whether parse_story tells something: a match has a name, so one extraction settles it."""
    return F.coalesce(F.trim(F.regexp_extract(flat(text), _STORY, 1)) != "", F.lit(False))


def story_words(text: Column) -> Column:
    """Whether all words of a story occur, wherever they stand."""
    found = F.lit(True)
    for word in STORY_WORDS:
        found = found & flat(F.lower(text)).contains(word)
    return F.coalesce(found, F.lit(False))


def contains_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words occurs in the text once signs are levelled to blanks."""
    if not words:
        return F.lit(False)
    level = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    # One search for all: `or` would level the text again for each word.
    return F.coalesce(level.rlike("|".join(re.escape(word.lower()) for word in words)), F.lit(False))


def has_letters(text: Column, least: int = 3) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= least, F.lit(False))


def moves_tab(text: Column) -> Column:
    """Whether the tab over the moves was read, however damaged its spaces."""
    return F.coalesce(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "").rlike("gyms?raids"), F.lit(False))


def display_name(text: Column) -> Column:
    """The text, unless it looks like noise of the interface: few letters, more marks than letters, a measure, a fraction, digits with few letters, or a word of the interface."""
    line = flat(text)
    low = F.lower(line)
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    marks = F.length(F.regexp_replace(line, r"[\p{L}\p{N}\s]", ""))
    noise = (letters < 2) | (marks > letters) | low.rlike(r"[0-9]\s*(kg|m)\b") | line.rlike(r"[0-9]\s*/\s*[0-9]") | (line.rlike("[0-9]") & (letters <= 3)) | low.rlike(r"\b(?:%s)\b" % "|".join(INTERFACE_WORDS))
    return F.when(~noise, line)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def form_or_normal(form: Column) -> Column:
    return F.when(present(form), form).otherwise("Normal")


def parse_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*TRUE_WORDS), F.lit(False))


def parse_iv(text: Column) -> Column:
    """A number from 0 to 15, truncated towards zero; null otherwise, infinities too."""
    value = F.trim(text).try_cast("double")
    whole = F.when(F.abs(value) < 1e9, value.cast("long"))
    return F.when(whole.between(0, 15), whole)
