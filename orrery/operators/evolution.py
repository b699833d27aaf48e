"""Recursion over a graph of edges: paths, finals, families. Rounds are checkpointed (set spark.checkpoint.dir) and go on until nothing is added; cycles end by what was reached before.

Edges have columns src and dst, and may have form (null: for every form), to_form and at (their order). A node is a key with a form, `Normal` where there is none;
forms are compared by their normal names. Joins of a round are by shuffle and sort: a broadcast a round would pass through the driver as often as there are rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.names import normal_name
from orrery.functions.parsers import form_or_normal


def _typed(edges: DataFrame) -> DataFrame:
    have = set(edges.columns)
    column = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    held = edges.select("src", "dst", column("form", "string").alias("form"), column("to_form", "string").alias("to_form"), F.coalesce(column("at", "long"), F.lit(0)).alias("at"))
    if not {"form", "to_form"} & have:
        return held.withColumn("edge_form", F.lit(None).cast("string"))
    return held.withColumn("edge_form", F.when(F.col("form").isNotNull(), normal_name(F.col("form"))))


def _applies(edge_form: Column, form_key: Column) -> Column:
    return edge_form.isNull() | (edge_form == form_key)


def candidates(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """start, start_form, node, form, form_key, depth and trail of all that each start (node, form) can become, itself included; each form once, at its first place.

    Breadth first: a round joins what the last one found with the edges. Among equals of a round the first trail (the order of the edges gone) wins, so
    (depth, trail) is the order in which a queue would meet them.
    """
    typed = _typed(edges).checkpoint()
    form = form_or_normal(F.col("form"))
    front = starts.select(F.col("node").alias("start"), form.alias("start_form"), "node", form.alias("form")).distinct()
    front = front.withColumn("form_key", normal_name(F.col("form"))).withColumn("depth", F.lit(0).cast("long")).withColumn("trail", F.expr("cast(array() as array<bigint>)")).checkpoint()
    reached, key, depth = front, ["start", "start_form", "node", "form_key"], 0
    e = typed.select("src", "dst", F.col("form").alias("e_form"), "to_form", "at", "edge_form")
    while True:
        depth += 1
        step = front.join(e.hint("merge"), (F.col("node") == F.col("src")) & _applies(F.col("edge_form"), F.col("form_key")))
        step = step.select("start", "start_form", F.col("dst").alias("node"), form_or_normal(F.coalesce("to_form", "e_form", "form")).alias("form"), F.concat("trail", F.array("at")).alias("trail"))
        step = step.withColumn("form_key", normal_name(F.col("form"))).groupBy(*key).agg(F.min_by("form", "trail").alias("form"), F.min("trail").alias("trail"))
        new = step.join(reached.select(*key).hint("merge"), key, "left_anti")
        front = new.select("start", "start_form", "node", "form", "form_key", F.lit(depth).cast("long").alias("depth"), "trail").checkpoint()
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
        if depth % 16 == 0:  # keeps plans short
            reached = reached.checkpoint()


def finals(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """What has no edge of its own among what each start reaches; the start itself where a cycle leaves nothing."""
    if "form_key" not in reached.columns:
        return reached.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    out = _typed(edges).select("src", "edge_form").distinct()
    ends = reached.join(out, (F.col("node") == F.col("src")) & _applies(F.col("edge_form"), F.col("form_key")), "left_anti")
    none = reached.where("depth = 0").join(ends.select("start", "start_form").distinct(), ["start", "start_form"], "left_anti")
    return ends.unionByName(none.select(*ends.columns))


def paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """start, node, depth of all nodes reachable from each, the start included; each once, at its least depth. Forms play no part."""
    front = nodes.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0).cast("long")).checkpoint()
    reached, k, edges = front, 0, edges.select("src", "dst").checkpoint()
    while True:
        k += 1
        step = front.join(edges.hint("merge"), F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = step.join(reached.hint("merge"), ["start", "node"], "left_anti").withColumn("depth", F.lit(k).cast("long")).checkpoint()
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
        if k % 16 == 0:  # keeps plans short
            reached = reached.checkpoint()


def families(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each undirected component, by rounds of large-star and small-star until the edges no longer change: some log of the longest chain."""
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = small.select("e.u", "e.v").where("u <> v").distinct().checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    rooted = now.select(F.col("u").alias("n"), F.col("v").alias("r"))
    return nodes.select("node").join(rooted, F.col("node") == F.col("n"), "left").select("node", F.coalesce("r", "node").alias("root"))
