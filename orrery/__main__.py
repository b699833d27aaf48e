"""Command line: doctor, validate, classify, export, sync-metadata, list and run. 0 is success, 1 an input with errors, 2 a failure."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from orrery.plans import REGISTRY


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="orrery", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor", help="what is installed")
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query and write its result")
    run.add_argument("name", choices=sorted(REGISTRY))
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    validate = commands.add_parser("validate", help="errors and warnings of an inventory")
    validate.add_argument("--input", required=True)
    classify = commands.add_parser("classify", help="rank and label an inventory; writes CSV, a workbook and a manifest")
    classify.add_argument("--input", required=True)
    classify.add_argument("--catalog", required=True)
    classify.add_argument("--legacy")
    classify.add_argument("--output", required=True)
    export = commands.add_parser("export", help="an inventory from pictures and the texts read on them; writes a run's artefacts")
    export.add_argument("--pictures", required=True, help="a folder of image files, each a source of one frame, or Parquet of pictures")
    export.add_argument("--texts", required=True, help="JSON lines of source_file, frame_index, source_type, timestamp_s and ocr_<region>")
    export.add_argument("--catalog", required=True)
    export.add_argument("--output", required=True)
    export.add_argument("--run", default="export")
    sync = commands.add_parser("sync-metadata", help="make a catalogue of a dump of templates")
    sync.add_argument("--dump", required=True)
    sync.add_argument("--output", required=True)
    return parser


def _classify(spark: SparkSession, found: argparse.Namespace) -> int:
    from orrery.operators import classification
    from orrery.sinks import tables
    from orrery.sources import catalog, inventory

    table = inventory.read(spark, found.input)
    errors, warnings = classification.validate(table)
    if errors:
        print("\n".join(f"error: {e}" for e in errors))
        return 1
    legacy = catalog.read_legacy_moves(spark, found.legacy) if found.legacy else spark.createDataFrame([], catalog.LEGACY)
    out = classification.classify(table, catalog.read_catalog(spark, found.catalog), legacy).checkpoint()
    columns = classification.output_columns(table)
    tables.write_csv(out.orderBy("__idx"), f"{found.output}/classified_csv", columns)
    tables.write_workbook({k: v.select(*columns) if "__idx" in v.columns else v for k, v in classification.sheets(out).items()}, f"{found.output}/classified.xlsx")
    manifest = tables.write_manifest(out, warnings, f"{found.output}/manifest.json")
    print(", ".join(f"{k}: {v}" for k, v in manifest["counts"].items()))
    return 0


def _export(spark: SparkSession, found: argparse.Namespace) -> int:
    import time

    from pyspark.sql import functions as F

    from orrery.operators import scan
    from orrery.sinks import runs
    from orrery.sources import catalog, images

    began = time.perf_counter()
    pictures = spark.read.parquet(found.pictures) if found.pictures.rstrip("/").endswith(".parquet") else images.read(spark, found.pictures)
    schema = "source_file string, frame_index long, source_type string, timestamp_s double, " + ", ".join(f"ocr_{r} string" for r in scan.REGIONS)
    tables = catalog.read_catalog(spark, found.catalog)
    rows, diagnostics, frames = scan.export(pictures, spark.read.schema(schema).json(found.texts), tables["species"], tables["moves"])
    classes = {r[0]: r[1] for r in frames.groupBy("classification").count().collect()}  # four classes
    spent = time.perf_counter() - began
    processed = frames.select(F.lit("processed").alias("action"), F.lit("visual_analysis").alias("reason"), "source_file", "frame_index", F.lit("visual").alias("phase"))
    done = runs.write_export(runs.Run(spark, found.output, found.run), rows, scan.warnings(frames), processed, diagnostics, {"scan": spent}, spent, {"frames": sum(classes.values())})
    print(f"{scan.summary_line(classes)}; {done['documents']['counts']['rows']} rows, {done['documents']['warning_count']} warnings")
    return 0


def main(arguments: list[str] | None = None) -> int:
    found = _parser().parse_args(arguments)
    if found.command == "list":
        print("\n".join(sorted(REGISTRY)))
        return 0
    if found.command == "doctor":
        from orrery.runtime import doctor

        print("\n".join(f"{k}: {v}" for k, v in doctor().items()))
        return 0
    spark = SparkSession.builder.appName("orrery").getOrCreate()
    try:
        if found.command == "validate":
            from orrery.operators import classification
            from orrery.sources import inventory

            errors, warnings = classification.validate(inventory.read(spark, found.input))
            print("\n".join([*(f"error: {e}" for e in errors), f"{len(errors)} errors, {warnings.count()} warnings"]))
            return 1 if errors else 0
        if found.command == "classify":
            return _classify(spark, found)
        if found.command == "export":
            return _export(spark, found)
        if found.command == "sync-metadata":
            from orrery.sources import templates

            print(", ".join(f"{k}: {v}" for k, v in templates.sync(spark, found.dump, found.output).items()))
            return 0
        writer = REGISTRY[found.name][0](spark, found.data).write.mode("errorifexists")
        (writer.option("header", True) if found.format == "csv" else writer).format(found.format).save(found.out)
        return 0
    except (ValueError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
