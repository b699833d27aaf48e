"""The whole way: from pictures and the texts read on them to judged frames, and on to an inventory.

texts has source_file, frame_index, source_type, timestamp_s and, for each region that was read, ocr_<region>; what is missing counts as unread. A picture that can't be analysed is a frame of class
non_extractable with its error; so is one without texts a frame that only pixels tell about. Everything is one plan of joins and windows over sources; pixels are read once. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import fragments, inventory_rows, pictures, production, screens

REGIONS = ("cp", "display_name", "hp", "weight", "height", "moves", "special_sections", "story")


def frames(images: DataFrame | pictures.Encoded, texts: DataFrame) -> DataFrame:
    """Judged frames: signals, classes, sequences, parsed values and gates, transitions taken out, runs corrected; seq_id of those in a sequence, notes and error."""
    shown = pictures.scanned_sequences(images)
    known = {f"ocr_{r}": F.col(f"ocr_{r}") if f"ocr_{r}" in texts.columns else F.lit(None).cast("string") for r in REGIONS}
    read = texts.select(*pictures.KEYS, "source_type", F.col("timestamp_s").cast("double").alias("timestamp_s"), *[c.alias(n) for n, c in known.items()]).dropDuplicates(pictures.KEYS)
    gated = screens.with_gates(screens.with_parsed(shown.join(read, pictures.KEYS, "left")))
    moving = F.coalesce(F.col("in_transition"), F.lit(False))
    out = screens.demoted(gated, moving).withColumn("classification", F.when(F.col("error").isNotNull(), "non_extractable").otherwise(F.col("classification")))
    out = production.postprocess(out)
    notes = [(F.col("has_display_name") & F.col("error").isNull(), "Display-name evidence is weak identity evidence."), (moving, "Source-local transition evidence marked this frame as a transition."), (F.col("has_iv") & ~F.col("has_iv_complete"), "IV evidence was present but not complete."), (F.col("error").isNotNull(), "Frame analysis failed.")]
    return out.withColumns({"seq_id": F.when(F.col("seq").isNotNull(), F.xxhash64("source_file", "seq")), "notes": F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in notes]))})


def told(judged: DataFrame, species: DataFrame, moves: DataFrame) -> DataFrame:
    """Fragments of judged frames in sequences, with the species and moves that they name."""
    return fragments.with_moves(fragments.with_species(fragments.extract(judged.where("seq_id IS NOT NULL")), species), moves)


def export(images: DataFrame | pictures.Encoded, texts: DataFrame, species: DataFrame, moves: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The inventory's rows, the diagnostics of all candidates, and the judged frames, which are held by keep (checkpoint by default)."""
    judged = (keep or (lambda df: df.checkpoint()))(frames(images, texts))
    rows, diagnostics = inventory_rows.assemble(told(judged, species, moves), keep)
    return rows, diagnostics, judged


def warnings(judged: DataFrame) -> DataFrame:
    """phase, source_file, frame_index and message of frames that failed."""
    return judged.where("error IS NOT NULL").select(F.lit("visual").alias("phase"), "source_file", "frame_index", F.col("error").alias("message"))


def summary_line(counts: dict[str, int]) -> str:
    """What a run ends with: frames by class, most first."""
    listed = ", ".join(f"{n} {k}" for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])))
    return f"{sum(counts.values())} frames: {listed}" if counts else "0 frames"
