"""Personal data: fixed shapes, and bootstrapped contextual extraction, with DataFrame operations only.

Base entities are e-mail addresses, IP addresses, card numbers and phone numbers of the fixed patterns below. They seed the bootstrap: the words before an
entity are a lexical pattern (a label attached to it, else two words, or the one there is; numbers and addresses among them count as one sign, so that items of a list
have patterns too); patterns and the instances (distinct strings) they introduce form a graph. A pattern is accepted if at least `support` of its instances are
known, these are at least a share of `confidence` of the known and the contradicted ones (unknown instances met under `support` patterns or more that have no known one,
as ordinary numbers are), and at least a share of `majority` of all. Instances of accepted patterns are known from then on, until no instance is added. An occurrence of an identifier that is not in a base
entity is reported, as kind `context`, where an accepted pattern introduces it. Identifiers are runs of letters, digits and hyphens with 5 digits at least, of any length, as the
words of a pattern may be; signs that part lists (`,;&|/`) end a word. Counting distinct strings keeps copies of a document from vouching for themselves.

A null or empty text has no spans. Positions are code points, the end exclusive. Rows are independent but for the patterns, so repeated
rows and rows with null doc_id keep a row each. Empty tables give empty results. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm._shared import stage

#: The patterns, made linear in the text by possessive repeats. \G or the look-behind hold where a search from the left would begin.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IDENTIFIER = r"(?<![A-Za-z0-9_+@.%-])-?(?=[A-Za-z-]*+[0-9])[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+(?![A-Za-z0-9@_-])"
LEAST_DIGITS = 5
KINDS = ("email", "ip", "card", "phone", "context")


#: Matches that are gathered together.
_STRETCH = 100
_ENTRY = "struct<start: int, end: int, kind: int, found: string, cue: string>"


_WORD_OR_NUMBERS = r"\S++(?:(?<=[0-9().+-])\s++(?=[0-9().+-])\S++)*+"


def _last_words(piece: Column) -> Column:
    """The last six words of a text at most, of any length, with the white space around them; the numbers of a row are one word, as they are one sign once levelled. A pattern never looks further back."""
    return F.reverse(F.regexp_extract(F.reverse(piece), rf"^\s*+(?:{_WORD_OR_NUMBERS})?+(?:\s++{_WORD_OR_NUMBERS}){{0,5}}+\s*+", 0))


def _levelled(piece: Column) -> Column:
    """In lower case, with # for addresses and numbers (several in a row count once), and single blanks between words."""
    bare = F.regexp_replace(F.lower(piece), r"[^\s@]++@[a-z0-9-]++(?:\.[a-z0-9-]++)*+", "#")
    bare = F.regexp_replace(bare, r"[0-9](?:[\s().+-]*+[0-9])*+", "#")
    bare = F.regexp_replace(F.regexp_replace(bare, r"([,;&|/])(?=\S)", "$1 "), r"\s+", " ")
    return F.regexp_replace(bare, r"(#[^\p{L}#\s]*+)(?:\1)+", "$1")


def _cue(before: Column) -> Column:
    """The label attached to an occurrence, or the two words before it, or the one; a digest stands for a long one."""
    attached = F.regexp_extract(before, r"(?:^| )([^ ]*\p{L}[^ ]*)\z", 1)
    cue = F.when(attached != "", attached).otherwise(F.ltrim(F.regexp_extract(before, r"(?:^| )((?:[^ ]+ )?[^ ]+ ?)\z", 1)))
    return F.when(F.length(cue) > 64, F.md5(cue)).otherwise(cue)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often it stands in there."""
    return F.transform(F.array(value), use)[0]


def occurrences(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, found, cue) of the pattern's leftmost matches; cue: the pattern of words that introduces it."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(pieces.alias("p"), found.alias("m")), lambda x: x["m"].isNotNull())
    empty = F.expr(f"cast(array() as array<{_ENTRY}>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        before = F.substring_index(F.concat(acc["tail"], _levelled(_last_words(x["p"]))), " ", -4)
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["m"].alias("found"), _cue(before).alias("cue"))
        return F.struct(end.alias("at"), F.concat(before, _levelled(x["m"])).alias("tail"), F.concat(acc["out"], F.array(one)).alias("out"))

    def gathered(pairs: Column) -> Column:
        """A hundred matches at a time: what they give is set beside what was there, not copied one by one, so that the cost is linear in the matches."""

        def stretch(acc: Column, at: Column) -> Column:
            inner = F.aggregate(F.slice(pairs, at, _STRETCH), F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), empty.alias("out")), step)
            return _bound(inner, lambda x: F.struct(x["at"].alias("at"), x["tail"].alias("tail"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(_STRETCH)), lambda at: at <= F.size(pairs))
        begun = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.expr(f"cast(array() as array<array<{_ENTRY}>>)").alias("out"))
        return F.aggregate(starts, begun, stretch, lambda acc: F.flatten(acc["out"]))

    return _bound(pairs, gathered)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _valid_ip(x: Column) -> Column:
    def low(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.substring(F.concat(F.lit("0"), bare), 1, 4).try_cast("int") <= 255)

    return F.forall(F.split(x["found"], r"\."), low)


def _valid_card(x: Column) -> Column:
    digits = _digits(x["found"])
    return F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)


def base(text: Column) -> Column:
    """The base entities of a text, ordered by start, then kind."""
    none = F.expr(f"cast(array() as array<{_ENTRY}>)")
    number = text.rlike("[0-9]")
    email = F.when(text.contains("@"), occurrences(text, EMAIL, "email")).otherwise(none)
    ip = F.when(number, F.filter(occurrences(text, IP, "ip"), _valid_ip)).otherwise(none)
    card = F.when(number, F.filter(occurrences(text, CARD, "card"), _valid_card)).otherwise(none)
    phone = F.when(text.contains("+"), F.filter(occurrences(text, PHONE, "phone"), lambda x: F.length(_digits(x["found"])).between(10, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def spans(docs: DataFrame, support: int = 5, confidence: float = 0.9, majority: float = 0.5) -> DataFrame:
    """doc_id, the base entities and all spans (arrays of start, end, kind), for every row of docs."""
    return _spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], support, confidence, majority)


def _spans(docs: DataFrame, keys: list[str], support: int = 5, confidence: float = 0.9, majority: float = 0.5) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.filter(occurrences(text, IDENTIFIER, "context"), lambda x: F.length(_digits(x["found"])) >= LEAST_DIGITS)
    found = docs.select(*keys, base(text).alias("base"), F.when(text.rlike("[0-9]"), ids).alias("ids"))
    apart = F.filter("ids", lambda i: ~F.exists("base", lambda b: (b["start"] < i["end"]) & (i["start"] < b["end"])))
    found = stage(found.select(*keys, "base", F.coalesce(apart, F.slice("base", 1, 0)).alias("ids")), "entities")
    seeds = found.select(F.explode("base").alias("x"))
    wild = found.select(F.explode("ids").alias("x"))
    graph = seeds.unionByName(wild).select(F.col("x.kind").alias("kind"), F.col("x.cue").alias("cue"), F.col("x.found").alias("instance")).where("cue <> ''").distinct()
    graph = stage(graph, "graph")
    unknown = KINDS.index("context")
    known = stage(graph.where(F.col("kind") < unknown).select("instance").distinct(), "known")
    edges, size = graph.select("cue", "instance").distinct(), known.count()
    while True:  # accepted patterns and known instances only grow, so this ends
        marked = edges.join(known.withColumn("hit", F.lit(1)), "instance", "left")
        plain = marked.groupBy("cue").agg(F.count("hit").alias("good")).where("good = 0").select("cue")
        contradicted = marked.where("hit is null").join(plain, "cue", "left_semi").groupBy("instance").count().where(F.col("count") >= support).select("instance", F.lit(1).alias("bad"))
        scored = marked.join(contradicted, "instance", "left").groupBy("cue").agg(F.count("hit").alias("good"), F.count("bad").alias("bad"), F.count("*").alias("all"))
        enough = (F.col("good") >= support) & (F.col("good") >= confidence * (F.col("good") + F.col("bad"))) & (F.col("good") >= majority * F.col("all"))
        patterns = stage(scored.where(enough).select("cue"), "patterns")
        known, before = stage(known.unionByName(edges.join(patterns, "cue", "left_semi").select("instance")).distinct(), "known"), size
        size = known.count()
        if size == before:
            break
    shape = "array<struct<start: int, end: int, kind: int>>"
    bare = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    # Rows with identifiers to judge go through the patterns; the others are ready.
    plain = found.where("size(ids) = 0").select(*keys, "base", bare.alias("spans"))
    rest = found.where("size(ids) > 0").withColumn("_row", F.monotonically_increasing_id())
    rest = stage(rest, "identifiers")
    hits = rest.select("_row", F.explode("ids").alias("x")).withColumn("cue", F.col("x.cue")).where("cue <> ''").join(patterns, "cue", "left_semi")
    more = hits.groupBy("_row").agg(F.collect_list(F.struct("x.start", "x.end", "x.kind")).alias("more"))
    judged = rest.join(more, "_row", "left").select(*keys, "base", F.array_sort(F.concat(bare, F.coalesce("more", F.expr(f"cast(array() as {shape})")))).alias("spans"))
    return plain.unionByName(judged)


def listed(spans: Column) -> Column:
    """kind:start:end, by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(order, one), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with every span replaced by its kind, such as <EMAIL>; where spans overlap, the first one names them. n_chars follows the text.

    doc_id need not be unique: texts are matched by doc_id and a hash of the text. Column names of docs must not begin with `__or_`.
    """
    columns = docs.columns
    row = F.xxhash64("doc_id", "text")
    keyed = docs.withColumn("__or_row", row)
    one = keyed.select(F.col("doc_id").alias("__or_d"), F.col("__or_row").alias("__or_r"), "text").where("text is not null")
    hit = _spans(one, ["__or_d", "__or_r"], **options).where("size(spans) > 0").select("__or_d", "__or_r", F.col("spans").alias("__or_spans")).dropDuplicates(["__or_d", "__or_r"])
    joined = keyed.join(hit, (F.col("__or_row") == F.col("__or_r")) & F.col("doc_id").eqNullSafe(F.col("__or_d")), "left")
    text, names = F.col("text"), F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        ahead = F.when(x["start"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"] + 1))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], ahead).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    by_start = F.array_sort(F.transform("__or_spans", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    whole = F.aggregate(by_start, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    changed = joined.withColumn("text", F.when(F.col("__or_spans").isNull(), text).otherwise(whole))
    return changed.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])
