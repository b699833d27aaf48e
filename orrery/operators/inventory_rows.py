"""From the fragments of a sequence to a row candidate, and from candidates to the rows of an inventory.

Fragments have seq_id, source_file, source_type, frame_index, timestamp_s, fragment_type (list, detail, appraisal) and fields (a map of texts). Evidence is counted by (sequence, column, value),
which combines before the shuffle; each column's rule then reads its counts in one pass. Candidates that have one identity (source, hit points, weight) are merged by the
same rules over their own counts. Sequences without a detail or an appraisal give no candidate. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.parsers import present
from orrery.operators import assembly, votes

# Fields of fragments, the columns that they fill, and their kinds.
FIELDS = {
    "display_name_text": ("display_name", "string"), "species_key": ("species_key", "string"), "species_name": ("species_name", "string"), "pokedex_id": ("pokedex_id", "int"), "canonical_name_text": ("canonical_name", "string"), "catch_date_text": ("catch_date", "string"), "location_text": ("catch_location", "string"), "catch_country_text": ("catch_country", "string"),
    "cp": ("cp", "long"), "hp_current": ("hp_current", "int"), "hp_max": ("hp_max", "int"), "weight_kg": ("weight_kg", "double"), "height_m": ("height_m", "double"), "iv_complete": ("iv_complete", "boolean"), "iv_attack": ("iv_attack", "int"), "iv_defense": ("iv_defense", "int"), "iv_stamina": ("iv_stamina", "int"), "iv_sum": ("iv_sum", "int"), "appraisal_star_count": ("appraisal_star_count", "int"), "appraisal_perfect": ("appraisal_perfect", "boolean"),
    "fast_move_key": ("fast_move_key", "string"), "fast_move_name": ("fast_move_name", "string"), "charged_move_key": ("charged_move_key", "string"), "charged_move_name": ("charged_move_name", "string"), "second_charged_move_key": ("second_charged_move_key", "string"), "second_charged_move_name": ("second_charged_move_name", "string"), "max_move_key": ("max_move_key", "string"), "max_move_name": ("max_move_name", "string"),
    "is_shadow": ("is_shadow", "boolean"), "has_dynamax": ("has_dynamax", "boolean"), "has_gigantamax": ("has_gigantamax", "boolean"), "has_tag_chips": ("has_tag_chips", "boolean"),
}
COLUMNS = {column: kind for column, kind in FIELDS.values()}
SPAN = ("source_file", "source_type", "first_frame_index", "last_frame_index", "first_timestamp_s", "last_timestamp_s")
# Groups of columns that rules treat alike.
FLAGS = ("is_shadow", "has_dynamax", "has_gigantamax", "has_tag_chips")
ANY_TRUE = ("iv_complete", "appraisal_perfect", *FLAGS)
WEAK = ("display_name", "height_m", "appraisal_star_count", *ANY_TRUE)
CRITICAL = tuple(c for c in COLUMNS if c not in WEAK and c != "cp")
IDENTITY = ("species_key", "species_name", "pokedex_id", "canonical_name")
TRIPLET = ("iv_attack", "iv_defense", "iv_stamina")
LOCKED = (*TRIPLET, "iv_sum", "appraisal_star_count", "appraisal_perfect")
APPRAISAL_ANCHOR = ("hp_current", "hp_max", "weight_kg", "species_key", "catch_date", "catch_location", *TRIPLET)
MOVES = ("fast_move_key", "fast_move_name", "charged_move_key", "charged_move_name")


def _there(column: str) -> Column:
    return _all(column)


def _all(*columns: str) -> Column:
    """Whether all columns are present; never null."""
    return F.expr(" AND ".join(f"coalesce(trim(cast({c} AS string)) <> '', false)" for c in columns))


def has_moves() -> Column:
    return _all(*MOVES)


def appraisal_anchor() -> Column:
    return _all(*APPRAISAL_ANCHOR)


def detail_anchor() -> Column:
    return _all("fast_move_key", "charged_move_key") | _all("max_move_key")


def anchor_identity() -> Column:
    return _all("species_key") | _all("pokedex_id") | _all("canonical_name", "catch_date", "catch_location") | detail_anchor()


def corroborated() -> Column:
    return _all("cp") | _all(*TRIPLET) | _all("canonical_name", "catch_date", "catch_location") | detail_anchor() | F.coalesce(F.col("has_tag_chips"), F.lit(False))


def identity() -> Column:
    return F.concat(F.lit("physical|"), assembly.identity_key(F.col("source_file"), F.col("hp_current"), F.col("hp_max"), weight=F.col("weight_kg")))


def missing_for_anchor() -> Column:
    """What an appraisal lacks of its anchor, or the moves of a detail."""
    lacking = F.filter(F.array(*[F.when(~F.coalesce(_there(c), F.lit(False)), F.lit(c)) for c in sorted(APPRAISAL_ANCHOR)]), lambda x: x.isNotNull())
    return F.when(F.array_contains("fragment_types", "appraisal"), lacking).otherwise(F.array(F.lit("moves")))


def _side(side: str) -> Column:
    """The votes (v, n, na, nd) of one side of a column's counts: accepted evidence, support or both."""
    count = {"accepted": lambda x: (x["n"], x["na"], x["nd"]), "support": lambda x: (x["s"], x["sa"], x["sd"]), "both": lambda x: (x["n"] + x["s"], x["na"] + x["sa"], x["nd"] + x["sd"])}[side]
    held = F.transform("x", lambda x: F.struct(x["v"].alias("v"), *[c.alias(n) for c, n in zip(count(x), ("n", "na", "nd"), strict=True)]))
    return F.filter(held, lambda x: x["n"] > 0)


def _of(found: Column, what: str) -> Column:
    """The votes that appraisals (na) or details (nd) cast."""
    return F.transform(F.filter(found, lambda x: x[what] > 0), lambda x: F.struct(x["v"].alias("v"), x[what].alias("n")))


def _longs(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["v"].try_cast("long").alias("v"), x["n"].alias("n")))


def _picked(long: DataFrame, group: str, merging: bool) -> DataFrame:
    """group, and picks: a map from column to (value as text, whether accepted evidence conflicts), by each column's rule.

    long: group, column, v and counts: n, na, nd of accepted evidence, of it in appraisals and in details; s, sa, sd likewise of support. A row for each (group, column) is judged at once.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "na", "nd", "s", "sa", "sd")]
    by_value = long.groupBy(group, "column", "v").agg(*sums)
    by_column = by_value.groupBy(group, "column").agg(F.collect_list(F.struct("v", "n", "na", "nd", "s", "sa", "sd")).alias("x"))
    by_column = by_column.select(group, "column", _side("accepted").alias("acc"), _side("support").alias("sup"), _side("both").alias("both"))
    column = F.col("column")
    first = F.when(column.isin("cp", "height_m"), F.col("both")).when(F.size("acc") > 0, F.col("acc")).otherwise(F.col("sup"))
    judged = by_column.withColumn("first", first).withColumns({"seen": _of(F.col("both"), "na"), "details": _of(F.col("first"), "nd"), "generic": votes.choice(F.col("first"))})
    generic = F.col("generic")
    high = F.when(F.size("details") > 0, votes.choice(F.col("details"))).otherwise(generic)
    place = F.coalesce(votes.choice(_of(F.col("first"), "na"), least=2, strictly=True), generic)
    mine, other = votes.cp_choice(_longs(F.col("acc"))), votes.cp_choice(_longs(F.col("sup")))
    points = F.when((mine < 100) & (other >= 100), other).otherwise(votes.cp_choice(_longs(F.col("first")))).cast("string")
    has = lambda value: F.exists("both", lambda x: x["v"] == value)
    flag = F.when(has("true"), "true").when((column == "iv_complete") & has("false"), "false").otherwise(generic)
    named = F.when((F.size("seen") == 1) & F.lit(merging), F.get("seen", F.lit(0))["v"]).otherwise(generic)
    value = F.when(column == "cp", points).when(column == "height_m", high).when(column == "catch_location", place).when(column.isin(*ANY_TRUE), flag).when(column.isin(*IDENTITY), named).otherwise(generic)
    judged = judged.withColumn("value", value)
    entry = F.struct("column", F.struct("value", (F.col("value").isNull() & (F.size("acc") > 0) & column.isin(*CRITICAL)).alias("conflict")))
    only = lambda name, what: F.max(F.when(column == name, F.col(what)))
    whole = judged.groupBy(group).agg(F.map_from_entries(F.collect_list(entry)).alias("picks"), only("appraisal_star_count", "first").alias("stars"), only("iv_sum", "both").alias("sums"))
    none = F.expr("cast(array() as array<struct<v: string, n: bigint, na: bigint, nd: bigint>>)")
    return whole.select(group, "picks", F.when(F.col("stars").isNotNull(), votes.star_choice(F.col("stars"), F.coalesce("sums", none))).alias("stars"))


def _value(column: str) -> Column:
    return F.col("stars") if column == "appraisal_star_count" else F.col("picks")[column]["value"]


def _conflicts(but: Column) -> Column:
    """Columns whose accepted evidence conflicts, sorted; but: a map's keys that don't count."""
    found = F.transform(F.filter(F.map_entries("picks"), lambda x: x["value"]["conflict"] & ~F.array_contains(but, x["key"])), lambda x: x["key"])
    return F.coalesce(F.array_sort(found), F.array().cast("array<string>"))


def _finished(df: DataFrame) -> DataFrame:
    """Flags that follow from others: a frustrated move is a shadow's, one power excludes the other, a complete triplet has three values."""
    frustrated = (F.col("charged_move_key") == "frustration") | (F.col("second_charged_move_key") == "frustration")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in FLAGS}
    out = df.withColumns(flags | {"is_shadow": F.coalesce(frustrated, F.lit(False)) | flags["is_shadow"], "iv_complete": F.when(F.col("iv_complete") & ~_all(*TRIPLET), False).otherwise(F.col("iv_complete"))})
    return out.withColumn("has_dynamax", F.col("has_dynamax") & ~F.col("has_gigantamax"))


def candidates(fragments: DataFrame) -> DataFrame:
    """A row candidate for each sequence: the columns of a row, accepted, anchor_kind (appraisal, detail, support, conflict), identity_key, conflicts and what the merge needs."""
    f = fragments.where(F.col("fragment_type").isin("detail", "appraisal"))
    at = F.struct("source_file", "frame_index")
    field = lambda name: F.col("fields")[name]
    whole = (F.col("fragment_type") == "appraisal") & (field("iv_complete") == "true")
    for c in TRIPLET:
        whole = whole & field(c).isNotNull()
    locked = F.when(whole, F.struct(*[field(c).alias(c) for c in LOCKED]))
    frames = lambda kind: F.array_sort(F.collect_list(F.when(F.col("fragment_type") == kind, F.col("frame_index"))))
    span = f.groupBy("seq_id").agg(
        F.max_by("source_file", at).alias("source_file"), F.max_by("source_type", at).alias("source_type"), F.min("frame_index").alias("first_frame_index"), F.max("frame_index").alias("last_frame_index"), F.round(F.min("timestamp_s"), 6).alias("first_timestamp_s"), F.round(F.max("timestamp_s"), 6).alias("last_timestamp_s"),
        F.max_by("frame_index", at).alias("scan_start"), F.array_sort(F.collect_set("fragment_type")).alias("fragment_types"), frames("detail").alias("detail_frames"), frames("appraisal").alias("appraisal_frames"), F.coalesce(F.bool_or(field("iv_star_agreement") == "true"), F.lit(False)).alias("star_agreement"),
        F.when(F.count_distinct(F.when(whole, F.struct(*[field(c) for c in TRIPLET]))) == 1, F.max_by(locked, F.when(whole, at))).alias("locked"),
    )
    column = F.create_map(*[F.lit(x) for k, (c, _) in FIELDS.items() for x in (k, c)])
    long = f.select("seq_id", "fragment_type", F.explode("fields").alias("field", "v")).select("seq_id", column[F.col("field")].alias("column"), "v", F.lit(1).alias("n"), (F.col("fragment_type") == "appraisal").cast("int").alias("na"), (F.col("fragment_type") == "detail").cast("int").alias("nd"), F.lit(0).alias("s"), F.lit(0).alias("sa"), F.lit(0).alias("sd"))
    joined = span.join(_picked(long.where(F.col("column").isNotNull() & present(F.col("v"))), "seq_id", merging=False), "seq_id", "left")
    own = lambda c: F.when(F.col("locked").isNotNull(), F.lit("true")) if c == "iv_complete" else F.col("locked")[c] if c in LOCKED else F.lit(None).cast("string")
    settled = F.filter(F.array(*[F.when(F.col("locked")[c].isNotNull(), F.lit(c)) for c in LOCKED]), lambda x: x.isNotNull())
    cp = F.coalesce("cp_votes", F.expr("cast(array() as array<struct<v: string, n: bigint>>)"))
    counted = long.where((F.col("column") == "cp") & present(F.col("v"))).groupBy("seq_id", "v").agg(F.count("*").alias("n")).groupBy("seq_id").agg(F.collect_list(F.struct("v", "n")).alias("cp_votes"))
    raw = joined.join(counted, "seq_id", "left")
    typed = raw.select("seq_id", *SPAN, *[F.coalesce(own(c), _value(c)).cast(kind).alias(c) for c, kind in COLUMNS.items()], "scan_start", "fragment_types", "detail_frames", "appraisal_frames", "star_agreement", _conflicts(settled).alias("conflicts"), cp.alias("cp_votes"))
    done = _finished(typed).withColumn("identity_key", identity())
    kind = F.when(F.size("conflicts") > 0, "conflict").when(appraisal_anchor(), "appraisal").when(detail_anchor(), "detail").otherwise("support")
    done = done.withColumn("anchor_kind", kind)
    done = done.withColumn("accepted", F.col("identity_key").isNotNull() & F.col("anchor_kind").isin("appraisal", "detail"))
    unsure = F.col("accepted") & (F.col("anchor_kind") == "appraisal") & ~F.col("star_agreement")
    return done.withColumn("iv_complete", F.when(unsure & F.col("iv_complete").isNull(), False).otherwise(F.col("iv_complete"))).drop("star_agreement")


def _recovered(pool: DataFrame) -> DataFrame:
    """seq_id, recovered_key and whether the candidate is demoted: a detail and an appraisal of one source and hit points whose weights disagree, if they are the only ones, or the only pair of one species."""
    hp = ["source_file", "hp_current", "hp_max"]
    known = pool.where(F.col("hp_current").isNotNull() & F.col("hp_max").isNotNull() & F.col("source_file").isNotNull())
    a = known.where(F.col("accepted") & (F.col("anchor_kind") == "appraisal") & F.col("iv_complete") & appraisal_anchor())
    d = known.where((F.col("anchor_kind") == "detail") & F.array_contains("fragment_types", "detail") & has_moves())
    others = [c for c in CRITICAL if c not in ("weight_kg", "hp_current", "hp_max")]
    packed = lambda df, p: df.select(*hp, F.struct("seq_id", "identity_key", "first_frame_index", "last_frame_index", *others).alias(p), F.col("species_key").alias(f"s_{p}"))
    counts = packed(d, "d").groupBy(*hp).agg(F.count("*").alias("nd")).join(packed(a, "a").groupBy(*hp).agg(F.count("*").alias("na")), hp)
    agrees = ~F.col("d")["identity_key"].eqNullSafe(F.col("a")["identity_key"])
    for c in others:
        agrees = agrees & F.coalesce(~present(F.col("d")[c].cast("string")) | ~present(F.col("a")[c].cast("string")) | (F.col("d")[c] == F.col("a")[c]), F.lit(True))
    lone = counts.where("nd = 1 and na = 1")
    single = packed(d, "d").join(lone, hp).join(packed(a, "a"), hp).where(agrees).select(*hp, "d", "a")
    many = packed(d, "d").join(packed(a, "a"), hp).where(present(F.col("s_d")) & (F.col("s_d") == F.col("s_a"))).join(counts.where("nd > 1 or na > 1"), hp).where(agrees)
    one = many.groupBy(*hp).agg(F.count("*").alias("k"), F.first("d").alias("d"), F.first("a").alias("a")).where("k = 1").select(*hp, "d", "a")
    pairs = single.unionByName(one)
    key = F.concat_ws("|", F.lit("recovered"), *[F.col(c).cast("string") for c in hp], F.least("d.first_frame_index", "a.first_frame_index").cast("string"), F.greatest("d.last_frame_index", "a.last_frame_index").cast("string"))
    return pairs.select(F.explode(F.array(F.struct(F.col("d.seq_id").alias("seq_id"), F.lit(True).alias("demoted")), F.struct(F.col("a.seq_id").alias("seq_id"), F.lit(False).alias("demoted")))).alias("x"), key.alias("recovered_key")).select("x.*", "recovered_key")


def with_groups(found: DataFrame) -> DataFrame:
    """Adds group_key: the identity that a candidate has, adopts from its source and hit points if they have exactly one, or recovers with a partner; a recovered detail is support from then on."""
    hp = ["source_file", "hp_current", "hp_max"]
    only = found.where(F.col("identity_key").isNotNull()).groupBy(*hp).agg(F.count_distinct("identity_key").alias("k"), F.min("identity_key").alias("one")).where("k = 1").select(*hp, "one")
    adopted = found.join(only, hp, "left").withColumn("group_key", F.coalesce("identity_key", F.when(~F.col("accepted"), F.col("one")))).drop("one")
    sizes = adopted.where(F.col("group_key").isNotNull()).groupBy("group_key").agg(F.count("*").alias("k")).where("k > 1").select("group_key")
    pool = adopted.join(sizes, "group_key", "left_anti")
    joined = adopted.join(_recovered(pool), "seq_id", "left")
    return joined.withColumns({"group_key": F.coalesce("recovered_key", "group_key"), "accepted": F.col("accepted") & ~F.coalesce("demoted", F.lit(False))}).drop("recovered_key", "demoted")


def _merged(grouped: DataFrame) -> DataFrame:
    """One candidate for each group_key: accepted evidence first, support fills; a conflict of accepted critical evidence rejects the group."""
    kind = F.when(F.array_contains("fragment_types", "detail"), "detail").when(F.array_contains("fragment_types", "appraisal"), "appraisal")
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.array(F.struct(F.col(c).cast("string").alias("v"), F.lit(1).cast("long").alias("n"))).alias("x")) for c in COLUMNS if c != "cp"], F.struct(F.lit("cp").alias("column"), F.when(F.size("cp_votes") > 0, F.col("cp_votes")).otherwise(F.array(F.struct(F.col("cp").cast("string").alias("v"), F.lit(1).cast("long").alias("n")))).alias("x")))
    long = grouped.select("group_key", "accepted", kind.alias("kind"), F.explode(entries).alias("e")).select("group_key", "accepted", "kind", "e.column", F.explode("e.x").alias("x")).select("group_key", "accepted", "kind", "column", "x.*").where(present(F.col("v")))
    side = lambda holds, name: F.when(holds, F.col("n")).otherwise(0).alias(name)
    yes, appraisal, detail = F.col("accepted"), F.coalesce(F.col("kind") == "appraisal", F.lit(False)), F.coalesce(F.col("kind") == "detail", F.lit(False))
    long = long.select("group_key", "column", "v", side(yes, "n_"), side(yes & appraisal, "na"), side(yes & detail, "nd"), side(~yes, "s"), side(~yes & appraisal, "sa"), side(~yes & detail, "sd")).withColumnRenamed("n_", "n")
    newest = lambda c: F.max_by(c, F.when(present(F.col(c).cast("string")), F.col("scan_start")))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    kinds = lambda k: F.bool_or(F.col("anchor_kind") == k)
    anchor = F.when(kinds("detail") & kinds("appraisal"), "detail+appraisal").when(kinds("appraisal"), "appraisal").when(kinds("detail"), "detail").when(kinds("conflict"), "conflict").otherwise("support")
    span = grouped.groupBy("group_key").agg(
        newest("source_file").alias("source_file"), newest("source_type").alias("source_type"), F.min("first_frame_index").alias("first_frame_index"), F.max("last_frame_index").alias("last_frame_index"), F.min("first_timestamp_s").alias("first_timestamp_s"), F.max("last_timestamp_s").alias("last_timestamp_s"),
        F.max("scan_start").alias("scan_start"), union("fragment_types"), union("detail_frames"), union("appraisal_frames"), anchor.alias("anchor_kind"), F.count("*").alias("members"), F.bool_or("accepted").alias("some_accepted"),
    )
    joined = span.join(_picked(long, "group_key", merging=True), "group_key", "left")
    typed = joined.select("group_key", *SPAN, *[_value(c).cast(kind).alias(c) for c, kind in COLUMNS.items()], "scan_start", "fragment_types", "detail_frames", "appraisal_frames", "anchor_kind", "members", "some_accepted", _conflicts(F.array().cast("array<string>")).alias("conflicts"))
    done = _finished(typed)
    exportable = identity().isNotNull() & anchor_identity() & corroborated()
    return done.withColumn("accepted", (F.size("conflicts") == 0) & (F.col("some_accepted") | exportable))


def rows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inventory's rows, and the diagnostics of all candidates.

    A lone accepted candidate is a row as it is; several are merged, and support alone makes a partial row if it names and corroborates someone. A candidate that is not accepted counts as merged support
    if its identity, or its span, lies in a row's.
    """
    grouped = with_groups(found)
    keyed = grouped.where(F.col("group_key").isNotNull())
    sizes = keyed.groupBy("group_key").agg(F.count("*").alias("members"), F.bool_or("accepted").alias("some"))
    joined = keyed.join(sizes, "group_key")
    columns = ["group_key", *SPAN, *COLUMNS, "anchor_kind", "members"]
    lone = joined.where("members = 1 and accepted").select(*columns)
    merged = _merged(joined.where("members > 1 or not some").drop("members", "some")).where("accepted").select(*columns)
    out = lone.unionByName(merged)
    notes = F.when(has_moves(), F.lit(None).cast("string")).when(F.col("anchor_kind").contains("detail"), "no moves: details lack resolved ones").otherwise("no moves: no detail")
    return out.withColumn("note", notes), diagnostics(found, out)


def diagnostics(found: DataFrame, exported: DataFrame) -> DataFrame:
    """seq_id, outcome (accepted, merged_support, rejected), creature_like, moves_status, present and missing columns of every candidate."""
    spans = found.where("not accepted").select(F.col("seq_id").alias("id"), "source_file", "first_frame_index", "last_frame_index")
    inside = assembly.contained(spans, exported.select("source_file", "first_frame_index", "last_frame_index"), "source_file", "first_frame_index", "last_frame_index").distinct().withColumn("inside", F.lit(True))
    keys = exported.select(F.col("group_key").alias("identity_key")).distinct().withColumn("row_there", F.lit(True))
    joined = found.join(keys, "identity_key", "left").join(inside, F.col("seq_id") == F.col("id"), "left")
    outcome = F.when(F.col("accepted"), "accepted").when(F.coalesce(F.col("row_there"), F.col("inside"), F.lit(False)), "merged_support").otherwise("rejected")
    status = F.when(has_moves(), "resolved").when(F.array_contains("fragment_types", "detail"), "detail_without_moves").when(F.array_contains("fragment_types", "appraisal"), "appraisal_without_detail").otherwise("no_detail")
    held = lambda yes: F.filter(F.array(*[F.when(F.coalesce(_there(c), F.lit(False)) == F.lit(yes), F.lit(c)) for c in sorted(COLUMNS)]), lambda x: x.isNotNull())
    like = anchor_identity() | corroborated() | _all("hp_current", "hp_max")
    return joined.select("seq_id", outcome.alias("outcome"), like.alias("creature_like"), "anchor_kind", "identity_key", status.alias("moves_status"), held(True).alias("present_fields"), held(False).alias("missing_fields"), "detail_frames", "appraisal_frames")


def assemble(fragments: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and diagnostics from fragments. keep: how to hold the candidates, which are read several times; checkpoints by default (set spark.checkpoint.dir)."""
    return rows((keep or (lambda df: df.checkpoint()))(candidates(fragments)))
