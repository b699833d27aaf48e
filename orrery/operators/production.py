"""A production scan: frames of a sequence are read from the newest back until they tell enough; runs of frames correct each other; near misses get a second look.

Frames have source_file, frame_index and, where named, the columns of screens.with_gates. Runs are windows over (source_file, frame_index). What a scan asks of a frame depends on all it was told before, so a
sequence's frames are folded in their order, by Arrow batches of one sequence each. Empty tables give empty ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import parsers
from orrery.operators import screens, sequences, votes

# Frames that a field may be looked for on; words of a power section.
BUDGETS = {"cp": 3, "height": 3, "weight": 3}
POWER_WORDS = ("stardust", "candy", "power up", "evolve", "mega energy", "gyms", "raids", "trainer battles", "weather bonus", "new attack", "max move")
SOURCE = ["source_file"]
_BY = ["source_file", "frame_index"]


def is_candidate() -> Column:
    """Whether a frame belongs to a sequence at all."""
    return F.col("raw_classification").isin("detail", "appraisal") & F.coalesce(F.col("stable_detail_signal"), F.lit(False))


def transition_rules(delta_before: str = "previous_frame_delta", delta_after: str = "future_frame_delta_3") -> tuple[Column, Column]:
    """When a frame is in motion, and when it goes on after such a frame. Motion is the mean change of a sample to the frame before and to the third after."""
    p, f, raw = F.col(delta_before), F.col(delta_after), F.col("raw_classification")
    swipe = F.coalesce(F.col("horizontal_swipe_signal"), F.lit(False))
    goes_on = (p <= 0.005) & (f >= 0.04)
    sets = is_candidate() & (F.coalesce(F.col("hp_area_card_split_signal"), F.lit(False)) | ((raw == "appraisal") & (p >= 0.04) & (f >= 0.04)) | ((raw == "detail") & swipe & (p >= 0.06) & (f >= 0.04)))
    holds = is_candidate() & (((raw == "appraisal") & (goes_on | ((p >= 0.032) & (f >= 0.035)))) | ((raw == "detail") & (goes_on | ((p >= 0.03) & (f >= 0.035)) | ((p >= 0.06) & (f >= 0.03)))))
    return sets, holds


def with_transitions(frames: DataFrame, delta_before: str = "previous_frame_delta", delta_after: str = "future_frame_delta_3") -> DataFrame:
    """Adds in_transition: a frame in motion, or one that goes on after such a frame."""
    return sequences.latch(frames, SOURCE, ["frame_index"], *transition_rules(delta_before, delta_after), "in_transition")


def with_sequences(frames: DataFrame) -> DataFrame:
    """Adds seq: the number of a frame's sequence in its source, null outside of any. A sequence is a run of candidates of one class, broken by transitions and others."""
    return sequences.with_runs(frames, SOURCE, ["frame_index"], is_candidate() & ~F.col("in_transition"), F.col("raw_classification"), "seq")


def _settled() -> Column:
    kinds = ("detail", "appraisal")
    return F.col("classification").isin(*kinds) & F.col("raw_classification").isin(*kinds) & ~F.col("has_transition") & parsers.present(F.col("hp"))


def _with_choice(held: DataFrame, value: Column, rule: Callable[[Column], Column], out: str) -> DataFrame:
    """Adds what the rule chooses of the values (with their counts) of a row's run, __run; null outside of runs. It is worked out on one row of each run. All of it stays in a source's task, by one sort: nothing is shuffled or joined."""
    known = F.col("source_file").isNotNull() & F.col("__run").isNotNull()
    run, own = W.partitionBy("source_file", "__run"), W.partitionBy("source_file", "__run", "__v")
    held = held.withColumn("__v", value)
    held = held.withColumns({"__i": F.row_number().over(own.orderBy("frame_index")), "__n": F.count("*").over(own), "__k": F.row_number().over(run.orderBy("__v", "frame_index"))})
    vote = F.when(known & F.col("__v").isNotNull() & (F.col("__i") == 1), F.struct(F.col("__v").alias("v"), F.col("__n").alias("n")))
    held = held.withColumn("__votes", F.collect_list(vote).over(run))
    held = held.withColumn("__one", F.when(known & (F.col("__k") == 1), rule(F.col("__votes"))))
    return held.withColumn(out, F.max("__one").over(run)).drop("__v", "__i", "__n", "__k", "__votes", "__one")


def with_cp_consensus(frames: DataFrame) -> DataFrame:
    """cp corrected to the choice of its run of frames with the same hit points; a frame without them breaks a run. Missing points stay missing; cp_original holds what was replaced."""
    held = sequences.with_runs(frames, SOURCE, ["frame_index"], _settled(), F.col("hp"), "__run")
    joined = _with_choice(held, F.col("cp").cast("long"), votes.cp_choice, "__cp")
    wrong = F.col("cp").isNotNull() & F.col("__cp").isNotNull() & (F.col("cp") != F.col("__cp"))
    return joined.withColumns({"cp_original": F.when(wrong, F.col("cp")), "cp": F.when(wrong, F.col("__cp").cast(frames.schema["cp"].dataType)).otherwise(F.col("cp"))}).select(*frames.columns, "cp_original")


def with_weights(frames: DataFrame) -> DataFrame:
    """weight_kg filled and corrected by the dominant weight of its run: frames with other hit points, and lists, break runs; other frames neither belong to nor break them. weight_original holds what was replaced."""
    lists = (F.col("classification") == "list") | (F.col("raw_classification") == "list")
    key = F.when(lists, "#list").when(parsers.present(F.col("hp")), F.col("hp"))
    held = sequences.with_skipping_runs(frames, SOURCE, ["frame_index"], key, "__run").withColumn("__in", _settled() & ~lists)
    joined = _with_choice(held, F.when(F.col("__in") & parsers.present(F.col("weight_kg")), F.col("weight_kg")), lambda found: votes.choice(found, least=3, ratio=3.0, share=0.75), "__w")
    other = F.col("__in") & F.col("__w").isNotNull() & ~F.col("weight_kg").eqNullSafe(F.col("__w"))
    return joined.withColumns({"weight_original": F.when(other, F.col("weight_kg")), "weight_filled": other & F.col("weight_kg").isNull(), "weight_kg": F.when(other, F.col("__w")).otherwise(F.col("weight_kg")), "has_weight": F.col("has_weight") | other}).select(*[c for c in frames.columns], "weight_original", "weight_filled")


def with_powers(frames: DataFrame) -> DataFrame:
    """has_dynamax and has_gigantamax spread over runs of details, to the frames that show a power section or moves; the larger one excludes the other."""
    plain = (F.col("classification") == "detail") & (F.col("raw_classification") == "detail") & ~F.col("has_transition")
    held = sequences.with_runs(frames, SOURCE, ["frame_index"], plain, F.lit("detail"), "__run")
    run = W.partitionBy("source_file", "__run")
    some = lambda c: F.coalesce(F.bool_or(F.col(c)).over(run), F.lit(False))
    shows = F.col("has_dynamax") | F.col("has_gigantamax") | F.col("has_moves") | parsers.contains_word(F.concat_ws(" ", "ocr_special_sections", "ocr_moves"), POWER_WORDS)
    held = held.withColumns({"__g": some("has_gigantamax"), "__d": some("has_dynamax"), "__s": F.col("__run").isNotNull() & shows})
    giga, dyna = F.col("__s") & F.col("__g"), F.col("__s") & ~F.col("__g") & F.col("__d")
    return held.withColumns({"has_gigantamax": F.col("has_gigantamax") | giga, "has_dynamax": F.when(giga, False).otherwise(F.col("has_dynamax") | dyna)}).select(*frames.columns)


def with_last_complete(frames: DataFrame) -> DataFrame:
    """has_iv_complete kept on the last frame of each run of appraisals that has all three bars and agreeing stars, and taken off all others."""
    plain = (F.col("classification") == "appraisal") & (F.col("raw_classification") == "appraisal") & ~F.col("has_transition")
    held = sequences.with_runs(frames, SOURCE, ["frame_index"], plain, F.lit("appraisal"), "__run")
    whole = F.col("has_iv") & (F.col("iv_bar_count") == 3) & F.coalesce(F.col("iv_star_agreement"), F.lit(False))
    return sequences.last_of_run(held, SOURCE, "frame_index", "__run", whole, "__kept").withColumn("has_iv_complete", F.coalesce("__kept", F.lit(False))).select(*frames.columns)


def postprocess(frames: DataFrame) -> DataFrame:
    """Points, then weights, then powers, then complete values."""
    return with_last_complete(with_powers(with_weights(with_cp_consensus(frames))))


def told(prefix: str = "ocr_") -> Column:
    """What a frame tells, as a map from field to text; some fields only from an appraisal."""
    text = lambda name: F.when(F.trim(F.col(f"{prefix}{name}")) != "", F.trim(F.col(f"{prefix}{name}")))
    raw = F.col("raw_classification") == "appraisal"
    flag = lambda c: F.when(F.col(c), F.lit("true"))
    known = F.col("iv_attack").isNotNull() & F.col("iv_defense").isNotNull() & F.col("iv_stamina").isNotNull()
    found = {
        "cp": F.col("cp").cast("string"), "hp": F.when(parsers.present(F.col("hp")), F.trim("hp")), "weight": F.when(parsers.present(F.col("weight_kg")), F.trim("weight_kg")), "height": F.when(parsers.present(F.col("height_m")), F.trim("height_m")),
        "display_name": F.when(F.col("has_display_name"), text("display_name")), "moves": F.when(F.col("has_moves"), text("moves")), "power": text("special_sections"),
        "story": F.when(raw & parsers.story_complete(F.col("story_text")), F.trim("story_text")), "iv": F.when(raw & F.col("has_iv_complete") & known, F.concat_ws("/", "iv_attack", "iv_defense", "iv_stamina")), "iv_star_agreement": F.when(raw, flag("iv_star_agreement")), "iv_sum": F.when(raw, F.col("iv_sum").cast("string")),
        "appraisal_star_count": F.when(raw, F.col("appraisal_star_count").cast("string")), "appraisal_perfect": F.when(raw, flag("appraisal_perfect")), "tag": flag("has_tag_chips"), "is_shadow": flag("is_shadow"), "has_dynamax": flag("has_dynamax"), "has_gigantamax": flag("has_gigantamax"),
    }
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in found.items()]), lambda x: x["v"].isNotNull())
    return F.map_from_entries(pairs)


def anchored(accepted: Column, appraisal: Column) -> Column:
    """Whether a sequence knows enough: hit points and weight, and a story and values of an appraisal, or moves."""
    has = lambda *fields: F.size(F.array_except(F.array(*map(F.lit, fields)), F.map_keys(accepted))) == 0
    return has("hp", "weight") & F.when(appraisal, has("story", "iv")).otherwise(has("moves"))


def choose_points(values: list[int], low: int = 10, high: int = 9366) -> int | None:
    """votes.cp_choice for a list of readings."""
    counts = Counter(v for v in values if low <= v <= high)
    tall = {v: n for v, n in counts.items() if v >= 100}

    def clear(found: dict[int, int]) -> int | None:
        ranked = sorted(found.items(), key=lambda x: (-x[1], x[0]))
        if len(ranked) == 1 or (len(ranked) > 1 and ranked[0][1] >= 3 and ranked[0][1] >= 2 * ranked[1][1]):
            return ranked[0][0]
        return None

    if len(counts) == 1 or not tall:
        return clear(counts)
    longer: dict[int, list[int]] = {}
    for v in tall:
        if v >= 1000:
            longer.setdefault(v // 10, []).append(v)
    extended = [v for v, n in tall.items() if v in longer and (n >= 3 or (len(longer[v]) == 1 and tall[longer[v][0]] >= 2))]
    if extended:
        return min(extended, key=lambda v: (-tall[v], v))
    weights = {stem: sum(tall[v] for v in own) for stem, own in longer.items() if len(own) >= 4 and low <= stem <= high}
    shared = [stem for stem, n in weights.items() if n >= 3]
    return min(shared, key=lambda v: (-weights[v], v)) if shared else clear(tall)


class Accumulator:
    """What a sequence has told so far: a first value stays, a different one later is a conflict where the field can conflict; points are chosen anew each time."""

    def __init__(self, appraisal: bool):
        self.appraisal, self.accepted, self.conflicts, self.points, self.used = appraisal, {}, [], [], Counter()
        self.desired = screens.APPRAISAL_FIELDS if appraisal else screens.DETAIL_FIELDS

    def accept(self, told: dict[str, str]) -> None:
        for name, value in told.items():
            if name == "cp":
                self.points.append(int(value))
                if (chosen := choose_points(self.points)) is None:
                    self.accepted.pop("cp", None)
                else:
                    self.accepted["cp"] = str(chosen)
            elif name not in self.accepted:
                self.accepted[name] = value
            elif self.accepted[name] != value and name not in screens.FREE_FIELDS and name not in self.conflicts:
                self.conflicts.append(name)

    def complete(self) -> bool:
        needed = {"hp", "weight", *(("story", "iv") if self.appraisal else ("moves",))}
        return needed <= self.accepted.keys() and not self.conflicts

    def wanted(self, power_pending: bool) -> set[str]:
        """Fields still worth asking for, within their budgets."""
        open_ = {*self.desired} - self.accepted.keys() | {*self.conflicts, "cp"}
        left = {f for f in open_ if self.used[f] < BUDGETS.get(f, 1 << 30)}
        if not self.complete():
            return left
        return left & ({"cp"} if self.appraisal else {"cp", "height"}) | ({"power"} if power_pending and not self.appraisal else set())


_RESULT = "source_file string, seq long, raw_classification string, first_frame_index long, last_frame_index long, accepted map<string, string>, conflicts array<string>, read array<struct<frame: long, fields: array<string>>>"


def _folded(frames: DataFrame, every: bool) -> DataFrame:
    """The fold over each sequence, one at a time: a sequence is a stretch of video, some hundreds of small rows."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_index", ascending=False)
        state, read, resolved = Accumulator(rows["raw_classification"].min() == "appraisal"), [], False
        for frame, told, can in zip(rows["frame_index"], rows["told"], rows["can"], strict=True):
            told = dict(told)
            if every:
                asked = sorted(told)
            else:
                if not (wanted := state.wanted(state.accepted.get("has_dynamax") == "true" and not resolved)):
                    break
                if not (asked := sorted(wanted & {*can})):
                    continue
                state.used.update(asked)
                told = {k: v for k, v in told.items() if k in asked or k in ("is_shadow", "has_dynamax", "has_gigantamax")}
            state.accept(told)
            resolved |= "has_gigantamax" in told
            read.append({"frame": int(frame), "fields": asked})
        return pd.DataFrame([{"source_file": rows["source_file"].iloc[0], "seq": rows["seq"].iloc[0], "raw_classification": rows["raw_classification"].min(), "first_frame_index": rows["frame_index"].min(), "last_frame_index": rows["frame_index"].max(), "accepted": state.accepted, "conflicts": state.conflicts, "read": read}])

    can = F.col("can") if "can" in frames.columns else F.array().cast("array<string>").alias("can")
    held = frames.where("seq is not null").select("source_file", "seq", "frame_index", "raw_classification", "told", can)
    return _results(held.groupBy("source_file", "seq").applyInPandas(of, _RESULT))


def scan(frames: DataFrame) -> DataFrame:
    """source_file, seq, accepted (a map), conflicts, completed, blockers, read (frame and fields asked of it) of each sequence.

    frames: seq, raw_classification, told (what a frame tells, were it read) and can (the fields that it may tell). From the newest frame back, what is still missing, in conflict or worth another look, within each
    field's budget, is asked of frames that may tell it; once nothing is left to ask the scan ends, and older frames count for nothing.
    """
    return _folded(frames, every=False)


def refreshed(frames: DataFrame) -> DataFrame:
    """The results of sequences rebuilt from all their frames (seq, told), newest first, as after corrections or for a second look."""
    return _folded(frames, every=True)


def _results(found: DataFrame) -> DataFrame:
    """Adds sequence_type, completed, and blockers: what is missing of the useful fields, an anchor, and fields in conflict."""
    appraisal = F.col("raw_classification") == "appraisal"
    anchor = anchored(F.col("accepted"), appraisal)
    missing = F.array_except(screens.desired_fields(), F.map_keys("accepted"))
    blockers = F.array_sort(F.array_distinct(F.concat(missing, F.when(anchor, F.array().cast("array<string>")).otherwise(F.array(F.lit("anchor"))), F.col("conflicts"))))
    return found.withColumns({"sequence_type": F.concat(F.lit("detail/raw="), "raw_classification"), "completed": anchor & (F.size("conflicts") == 0), "blockers": blockers})


def needs_repair() -> Column:
    """Whether a result is a near miss: not complete though hit points and weight are known, or a detail complete by two frames or fewer."""
    core = F.map_contains_key("accepted", F.lit("hp")) & F.map_contains_key("accepted", F.lit("weight"))
    thin = F.col("completed") & (F.col("raw_classification") == "detail") & (F.size("read") <= 2) & F.map_contains_key("accepted", F.lit("moves"))
    return core & (~F.col("completed") | thin)


def repaired(results: DataFrame, frames: DataFrame) -> DataFrame:
    """results with near misses looked at again, on up to 18 frames of each and for every field; the others as they are."""
    again = results.where(needs_repair()).select("source_file", "seq")
    sample = sequences.repair_sample(frames.join(again, ["source_file", "seq"], "left_semi"), ["source_file", "seq"], "frame_index")
    second = refreshed(sample.drop("pick"))
    return results.join(again, ["source_file", "seq"], "left_anti").unionByName(second.select(*results.columns))


def stabilised(frames: DataFrame, results: DataFrame) -> DataFrame:
    """frames (weight_kg, seq) with weights corrected over neighbouring sequences of one source and hit points, two or more of them: the dominant weight replaces others, and fills nothing."""
    keyed = results.select("source_file", "seq", "first_frame_index", F.col("accepted")["hp"].alias("__hp"))
    runs = sequences.with_runs(keyed, SOURCE, ["first_frame_index"], F.col("__hp").isNotNull(), F.col("__hp"), "__run").where("__run is not null")
    several = runs.groupBy("source_file", "__run").agg(F.count("*").alias("k")).where("k > 1").select("source_file", "__run")
    member = runs.join(several, ["source_file", "__run"]).select("source_file", "seq", "__run")
    counts = frames.join(member, ["source_file", "seq"]).where(parsers.present(F.col("weight_kg"))).groupBy("source_file", "__run", "weight_kg").agg(F.count("*").alias("n"))
    chosen = counts.groupBy("source_file", "__run").agg(votes.choice(F.collect_list(F.struct(F.col("weight_kg").alias("v"), "n")), least=3, ratio=3.0, share=0.75).alias("__w")).where("__w is not null")
    joined = frames.join(member.join(chosen, ["source_file", "__run"]).select("source_file", "seq", "__w"), ["source_file", "seq"], "left")
    wrong = parsers.present(F.col("weight_kg")) & F.col("__w").isNotNull() & (F.col("weight_kg") != F.col("__w"))
    return joined.withColumns({"weight_outlier": F.when(wrong, F.col("weight_kg")), "weight_kg": F.when(wrong, F.col("__w")).otherwise(F.col("weight_kg"))}).drop("__w").select(*frames.columns, "weight_outlier")


def best_reading(df: DataFrame, group: list[str], kind: str) -> DataFrame:
    """The reading of each group that parses and is best: group and text, confidence, box, attempt (its place) and fallback (whether its box is a second choice).

    Points: a prefix, then more digits; hit points: the letters; weight and height: a fallback box where that is preferred (prefer_fallback). Then confidence, then the earliest.
    """
    text = F.col("text")
    parse = {"cp": parsers.parse_cp, "hp": parsers.parse_hp, "weight": parsers.parse_weight, "height": parsers.parse_height}[kind](text)
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    first = {"cp": [parsers.has_cp_prefix(text), digits], "hp": [F.lower(text).contains("hp"), F.lit(0)]}.get(kind, [F.col("fallback") & F.col("prefer_fallback") if "prefer_fallback" in df.columns else F.lit(False), F.lit(0)])
    score = F.struct(first[0].alias("a"), first[1].alias("b"), F.col("confidence").alias("c"), (-F.col("attempt")).alias("d"))
    return df.where(parse.isNotNull()).groupBy(*group).agg(F.max_by(F.struct("text", "confidence", "box"), score).alias("r")).select(*group, "r.*")
