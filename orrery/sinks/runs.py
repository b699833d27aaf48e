"""Artefacts of a run that appear together or not at all.

A run's tables are written by the executors as parts under a folder of their own attempt, `<root>/<run>/<attempt>/<table>`. What was written is read back and counted; counts and digests go
into one manifest, `<root>/_runs/<run>.json`, which is put in place last, whole, by a rename. Readers know a run by its manifest only, so that one that stopped half-way is not there. A
run that is done again takes the place of the one before by its manifest; files of attempts that no manifest names are removed by `sweep`.

A digest is the sum of the hashes of a table's rows (of its lines, for JSON and text): it doesn't depend on their order or parts. Empty tables are written, and read, as such.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import reports

FORMS = ("parquet", "json", "csv", "text")


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _put(spark: SparkSession, path: str, document: dict) -> None:
    """A small file, written beside its place and then renamed over it."""
    system, target = _files(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(beside, True)
    out.write(bytearray(json.dumps(document, indent=1, sort_keys=True, ensure_ascii=False).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, over)


def _load(spark: SparkSession, path: str) -> dict | None:
    system, target = _files(spark, path)
    if not system.exists(target):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def _opened(spark: SparkSession, path: str, form: str, schema: str | None) -> DataFrame:
    if form == "parquet":
        return spark.read.schema(schema).parquet(path)
    return _sheet(spark, path) if form == "csv" else spark.read.text(path)


def _sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def _digest(df: DataFrame) -> tuple[int, str]:
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")), F.lit(0)).alias("d")).first()
    return row["n"], str(row["d"])


class Run:
    """The artefacts of one run, until `commit` makes them seen."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        if "/" in name or name.startswith(("_", ".")) or not name:
            raise ValueError(f"Not a name of a run: {name!r}")
        self.spark, self.root, self.name, self.attempt = spark, root.rstrip("/"), name, uuid.uuid4().hex
        self.tables: dict[str, dict] = {}
        self.documents: dict[str, object] = {}
        self.seconds: dict[str, float] = {}

    def table(self, name: str, df: DataFrame, form: str = "parquet", columns: list[Column | str] | None = None) -> None:
        """Writes a table of the run; form is one of FORMS."""
        if form not in FORMS:
            raise ValueError(f"Not a form of artefacts: {form}")
        if name in self.tables:
            raise ValueError(f"Written already: {name}")
        began = time.perf_counter()
        path = f"{self.root}/{self.name}/{self.attempt}/{name}"
        chosen = df.select(*columns) if columns else df
        writer = chosen.write.mode("overwrite")
        if form == "csv":
            writer = writer.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "")
        writer.format(form).save(path)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
        rows, digest = _digest(_opened(self.spark, path, form, schema))
        self.tables[name] = {"form": form, "path": f"{self.attempt}/{name}", "schema": schema, "rows": rows, "digest": digest}
        self.seconds[f"{name}_writing"] = time.perf_counter() - began

    def document(self, name: str, value: object) -> None:
        """A small document that goes into the manifest."""
        self.documents[name] = value

    def commit(self) -> dict:
        manifest = {"run": self.name, "attempt": self.attempt, "tables": self.tables, "documents": self.documents}
        _put(self.spark, f"{self.root}/_runs/{self.name}.json", manifest)
        return manifest


def runs(spark: SparkSession, root: str) -> list[str]:
    """Names of the runs that are there."""
    system, folder = _files(spark, f"{root.rstrip('/')}/_runs")
    if not system.exists(folder):
        return []
    return sorted(f.getPath().getName().removesuffix(".json") for f in system.listStatus(folder) if f.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, root: str, run: str) -> dict:
    found = _load(spark, f"{root.rstrip('/')}/_runs/{run}.json")
    if found is None:
        raise FileNotFoundError(f"No such run: {run}")
    return found


def read(spark: SparkSession, root: str, run: str, table: str) -> DataFrame:
    """A table of a committed run; JSON and CSV come with the columns they were written with (CSV as strings)."""
    about = manifest(spark, root, run)["tables"][table]
    path = f"{root.rstrip('/')}/{run}/{about['path']}"
    if about["form"] == "json":
        return spark.read.schema(about["schema"]).json(path)
    if about["form"] == "csv":
        return _sheet(spark, path)
    return _opened(spark, path, about["form"], about["schema"])


def damaged(spark: SparkSession, root: str, run: str) -> list[str]:
    """Tables of a run whose rows are no longer those of its manifest."""
    out = []
    for name, about in manifest(spark, root, run)["tables"].items():
        path = f"{root.rstrip('/')}/{run}/{about['path']}"
        system, target = _files(spark, path)
        if not system.exists(target) or list(_digest(_opened(spark, path, about["form"], about["schema"]))) != [about["rows"], about["digest"]]:
            out.append(name)
    return sorted(out)


def sweep(spark: SparkSession, root: str, run: str) -> int:
    """Removes attempts of a run that its manifest doesn't name (all, where there is none); their number. Not while the run is being written."""
    named = (_load(spark, f"{root.rstrip('/')}/_runs/{run}.json") or {}).get("attempt")
    system, folder = _files(spark, f"{root.rstrip('/')}/{run}")
    if not system.exists(folder):
        return 0
    stale = [f.getPath() for f in system.listStatus(folder) if f.getPath().getName() != named]
    for path in stale:
        system.delete(path, True)
    return len(stale)


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def cards(df: DataFrame, rejected: str | None = None) -> DataFrame:
    """A line of HTML for each row: its values but nulls and false ones, escaped; those of rejected rows are marked as ignored. Executors make and write them."""
    kinds = dict(df.dtypes)
    shown = lambda c: F.when(~F.col(c) if kinds[c] == "boolean" else F.lit(False), None).otherwise(F.col(c).cast("string") if kinds[c] not in ("variant",) and not kinds[c].startswith(("map", "array", "struct")) else F.to_json(c))
    values = [F.when(shown(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.regexp_replace(shown(c), r"[\r\n]+", " "))) for c in df.columns if c != rejected]
    prefix = F.when(F.coalesce(F.col(rejected), F.lit(False)), "ignored candidate values: ").otherwise("") if rejected else F.lit("")
    return df.select(F.concat(F.lit("<section>"), _escaped(F.concat(prefix, F.concat_ws(", ", *values))), F.lit("</section>")).alias("value"))


def _counts(df: DataFrame, column: str) -> dict[str, int]:
    """Rows by a column of few values."""
    return {str(r[0]): r[1] for r in df.groupBy(column).count().orderBy(column).collect()}


def write_scan(run: Run, frames: DataFrame, fragments: DataFrame, warnings: DataFrame, phases: dict[str, float], run_total_s: float, sources: dict | None = None) -> dict:
    """Artefacts of a scan: frames, fragments, audit cards, a timing profile and the manifest with counts by class and fragment type. frames may have a map `timing`."""
    run.table("frames", frames, "json")
    run.table("fragments", fragments, "json")
    run.table("audit", cards(frames.drop("timing", "signals")), "text")
    run.table("warnings", warnings, "json")
    run.document("timing_profile", reports.profile(frames, phases | run.seconds, run_total_s + sum(run.seconds.values())) if "timing" in frames.columns else {"phases": phases | run.seconds})
    run.document("frame_count", run.tables["frames"]["rows"])
    run.document("classification_counts", _counts(frames, "classification"))
    run.document("fragment_counts", _counts(fragments, "fragment_type"))
    run.document("sources", sources or {})
    return run.commit()


def write_export(run: Run, rows: DataFrame, warnings: DataFrame, events: DataFrame, diagnostics: DataFrame, phases: dict[str, float], run_total_s: float, counts: dict[str, int] | None = None) -> dict:
    """Artefacts of an export: the inventory as CSV, warnings, lifecycle events, row diagnostics, a performance summary and the manifest. counts: figures of the run to keep."""
    flat = [F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in rows.dtypes]
    run.table("inventory", rows, "csv", flat)
    run.table("warnings", warnings, "json")
    run.table("frame_lifecycle", events, "json")
    run.table("row_diagnostics", diagnostics, "json")
    total = run_total_s + sum(run.seconds.values())
    spent = phases | run.seconds
    run.document("performance_summary", {"run_total_s": round(total, 6), "phases": {k: {"s": round(v, 6), "share": round(100 * v / total, 3) if total > 0 else 0.0} for k, v in spent.items()}})
    run.document("lifecycle", [r.asDict() for r in reports.lifecycle(events).orderBy(F.col("action"), F.col("reason").asc_nulls_first()).collect()])  # a few actions and reasons
    run.document("warning_count", run.tables["warnings"]["rows"])
    run.document("counts", {"rows": run.tables["inventory"]["rows"]} | (counts or {}))
    return run.commit()
