"""Rankings, levels, stat products, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import parsers, scoring
from orrery.plans.registry import query, table

OWNED_SQL = """owned AS (SELECT c_custkey AS id, c_nationkey AS species, c_mktsegment AS form, c_custkey%16 AS ia, (c_custkey*7)%16 AS idf, (c_custkey*13)%16 AS ist FROM customer),
cpm AS (SELECT n AS level2, 0.05*sqrt(n::DOUBLE) AS cpm FROM range(2,101) t(n)),
stats AS (SELECT n_nationkey AS species, n_regionkey AS family, 100+n_nationkey*7 AS atk, 90+n_nationkey*5 AS def, 110+n_nationkey*3 AS sta FROM nation)"""


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    values = [parsers.parse_iv(((F.col("c_custkey") * k) % 16).cast("string")).alias(n) for n, k in (("ia", 1), ("idf", 7), ("ist", 13))]
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("species"), F.col("c_mktsegment").alias("form"), *values)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("species"), F.col("n_regionkey").alias("family"), (100 + F.col("n_nationkey") * 7).alias("atk"), (90 + F.col("n_nationkey") * 5).alias("def"), (110 + F.col("n_nationkey") * 3).alias("sta"))


def recommend(keep: list, review: list) -> tuple:
    """The label and the reasons: any reason to keep wins, then any to review. Reasons keep their order, each once."""
    none = F.lit(None).cast("string")
    clean = lambda xs: F.array_distinct(F.filter(F.array(*xs, none), lambda x: x.isNotNull()))
    k, r = clean(keep), clean(review)
    return F.when(F.size(k) > 0, "KEEP").when(F.size(r) > 0, "REVIEW").otherwise("LET-GO"), F.array_join(F.when(F.size(k) > 0, k).otherwise(r), "; ")


@query(f"""WITH {OWNED_SQL}, r AS (SELECT *, 10*ia+idf+ist AS score, row_number() OVER (PARTITION BY species, form ORDER BY 10*ia+idf+ist DESC, ia DESC, idf DESC, ist DESC, id) AS rnk FROM owned)
SELECT id, species::BIGINT AS species, form, score::BIGINT AS score, CASE WHEN rnk<=3 THEN rnk END::BIGINT AS rnk, CASE WHEN rnk<=3 THEN 'KEEP' WHEN score>=140 THEN 'REVIEW' ELSE 'LET-GO' END AS recommendation,
CASE WHEN rnk<=3 THEN 'attacker top '||rnk WHEN score>=140 THEN 'strong attacker' ELSE '' END AS reasons FROM r""")
def q_attacker_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = scoring.attacker_score(F.col("ia"), F.col("idf"), F.col("ist"))
    order = W.partitionBy("species", "form").orderBy(F.desc("score"), F.desc("ia"), F.desc("idf"), F.desc("ist"), "id")
    scored = owned(spark, sf_dir).withColumn("score", score)
    # Each task keeps three rows of a group before the shuffle, and only those are joined back.
    top = scored.withColumn("rnk", F.row_number().over(order).cast("long")).where("rnk <= 3").select("id", "rnk")
    ranked = scored.join(top, "id", "left")
    label, reasons = recommend([F.when(F.col("rnk") <= 3, F.concat(F.lit("attacker top "), F.col("rnk").cast("string")))], [F.when(F.col("score") >= 140, "strong attacker")])
    return ranked.select("id", F.col("species").cast("long").alias("species"), "form", "score", "rnk", label.alias("recommendation"), reasons.alias("reasons"))


def best_level(rows: DataFrame) -> DataFrame:
    """rows with league, cap, level2, cpm and cp of the highest half level (twice the level, 2 to 100) whose points stay under the cap. Points grow with twice the level, so it is solved for, and of the steps around the solution the highest that fits is taken."""
    a, d, s = F.col("atk") + F.col("ia"), F.col("def") + F.col("idf"), F.col("sta") + F.col("ist")
    near = F.floor((F.col("cap") + 1) * 4000.0 / (a * F.sqrt(d.cast("double")) * F.sqrt(s.cast("double")))).cast("int")
    lowest, highest = F.lit(2), F.lit(100)
    around = F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.least(highest, near) + o), lambda n: (n >= lowest) & (n <= highest))
    steps = F.transform(around, lambda n: F.struct(n.cast("long").alias("level2"), (F.lit(0.05) * F.sqrt(n.cast("double"))).alias("cpm")))
    spread = rows.withColumn("c", F.explode(F.array(*[F.struct(F.lit(n).alias("league"), F.lit(cap).cast("long").alias("cap")) for n, cap in scoring.LEAGUES]))).select(*rows.columns, "c.*")
    best = F.try_element_at(F.filter(steps, lambda x: scoring.combat_points(a, d, s, x["cpm"]) <= F.col("cap")), F.lit(-1))
    found = spread.withColumn("b", best).where("b is not null").select(*rows.columns, "league", "cap", "b.*")
    return found.withColumn("cp", scoring.combat_points(a, d, s, F.col("cpm")))


@query(f"""WITH {OWNED_SQL}, caps(league,cap) AS (VALUES ('LL',500),('GL',1500),('UL',2500)),
e AS (SELECT o.id, s.family, s.species, atk+ia AS a, def+idf AS d, sta+ist AS s, ia+idf+ist AS total, level2, cpm, greatest(10, floor((atk+ia)*sqrt((def+idf)::DOUBLE)*sqrt((sta+ist)::DOUBLE)*cpm*cpm/10)) AS cp FROM owned o JOIN stats s USING (species) CROSS JOIN cpm),
b AS (SELECT *, row_number() OVER (PARTITION BY id, league ORDER BY level2 DESC) AS rn FROM e JOIN caps ON cp<=cap),
p AS (SELECT *, (a*cpm)*(d*cpm)*floor(s*cpm) AS product FROM b WHERE rn=1),
w AS (SELECT *, row_number() OVER (PARTITION BY family, league ORDER BY product DESC, level2 DESC, total DESC, id) AS r FROM p)
SELECT family::BIGINT AS family, league, id, species::BIGINT AS species, level2::BIGINT AS level2, cp::BIGINT AS cp, floor(product)::BIGINT AS product FROM w WHERE r=1""")
def q_pvp_best_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = owned(spark, sf_dir).join(stats(spark, sf_dir), "species").drop("form")
    best = best_level(rows)
    product = scoring.stat_product(F.col("atk") + F.col("ia"), F.col("def") + F.col("idf"), F.col("sta") + F.col("ist"), F.col("cpm"))
    ranked = best.withColumn("product", product)
    order = F.struct("product", "level2", (F.col("ia") + F.col("idf") + F.col("ist")).alias("t"), (-F.col("id")).alias("o"))
    won = ranked.groupBy("family", "league").agg(F.max_by(F.struct("id", "species", "level2", "cp", "product"), order).alias("w"))
    return won.select(F.col("family").cast("long").alias("family"), "league", "w.id", F.col("w.species").cast("long").alias("species"), F.col("w.level2").alias("level2"), "w.cp", F.floor("w.product").cast("long").alias("product"))


def iv_ranks(lines: DataFrame) -> DataFrame:
    """The rank of each of the 4096 value triples of every stat line, by league."""
    grid = lines
    for n in ("ia", "idf", "ist"):
        grid = grid.withColumn(n, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        if n == "ia":
            grid = grid.repartition(lines.sparkSession.sparkContext.defaultParallelism)  # sixteen rows a line, before there are 4096
    best = best_level(grid)
    product = scoring.stat_product(F.col("atk") + F.col("ia"), F.col("def") + F.col("idf"), F.col("sta") + F.col("ist"), F.col("cpm"))
    order = W.partitionBy("species", "league").orderBy(F.desc(product), F.desc("level2"), "ia", "idf", "ist")
    return best.select(F.col("species").cast("long").alias("species"), "league", "ia", "idf", "ist", "level2", F.row_number().over(order).cast("long").alias("rnk"))


@query(f"""WITH {OWNED_SQL}, caps(league,cap) AS (VALUES ('LL',500),('GL',1500),('UL',2500)),
g AS (SELECT species, atk, def, sta, a.n AS ia, d.n AS idf, s.n AS ist FROM stats, range(16) a(n), range(16) d(n), range(16) s(n)),
e AS (SELECT *, greatest(10, floor((atk+ia)*sqrt((def+idf)::DOUBLE)*sqrt((sta+ist)::DOUBLE)*cpm*cpm/10)) AS cp FROM g CROSS JOIN cpm),
b AS (SELECT species, atk, def, sta, ia, idf, ist, league, max(level2) AS level2, max(cpm) AS cpm FROM e JOIN caps ON cp<=cap GROUP BY ALL),
p AS (SELECT *, ((atk+ia)*cpm)*((def+idf)*cpm)*floor((sta+ist)*cpm) AS product FROM b)
SELECT species::BIGINT AS species, league, ia, idf, ist, level2, row_number() OVER (PARTITION BY species, league ORDER BY product DESC, level2 DESC, ia, idf, ist)::BIGINT AS rnk FROM p""")
def q_iv_rank_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv_ranks(stats(spark, sf_dir))


# Each nation's suppliers make a template of multipliers; the first one counts.
@query("""WITH t AS (SELECT s_nationkey AS g, 0.001*sqrt(s_suppkey::DOUBLE) AS cpm, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier), c AS (SELECT n, cpm FROM t WHERE g=(SELECT min(g) FROM t) AND n<=50),
x AS (SELECT n, cpm, lead(cpm) OVER (ORDER BY n) AS nxt FROM c) SELECT 2*n AS level2, floor(cpm*1000000000)::BIGINT AS cpm9 FROM x UNION ALL SELECT 2*n+1, floor(sqrt((cpm*cpm+nxt*nxt)/2)*1000000000)::BIGINT FROM x WHERE nxt IS NOT NULL""")
def q_cpm_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.sources import templates

    steps = F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda n: F.lit(0.001) * F.sqrt(n.cast("double")))
    dump = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("at")).agg(F.to_json(F.struct(F.struct(steps.alias("cpMultiplier")).alias("playerLevel"))).alias("j"))
    found = templates.cp_multipliers(dump.select("at", F.parse_json("j").alias("data")))
    return found.select((F.col("level") * 2).cast("long").alias("level2"), F.floor(F.col("cpm") * 1000000000).cast("long").alias("cpm9"))


EDGES_SQL = "n AS (SELECT p_partkey AS node FROM part), e AS (SELECT a.node AS src, b.node AS dst FROM n a JOIN n b ON b.node=2*a.node AND a.node>0)"
WALK_SQL = "walk AS (SELECT node AS start, node, 0 AS depth FROM n UNION ALL SELECT w.start, e.dst, w.depth+1 FROM walk w JOIN e ON w.node=e.src)"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = nodes.select(F.col("node").alias("src"), (F.col("node") * 2).alias("dst")).join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, edges.where("src <> dst").select("src", "dst")


@query(f"WITH RECURSIVE {EDGES_SQL}, {WALK_SQL} SELECT start, node, depth::BIGINT AS depth FROM walk")
def q_evolution_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.operators import evolution

    return evolution.paths(*graph(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES_SQL}, {WALK_SQL} SELECT start, node, depth::BIGINT AS depth FROM walk WHERE node NOT IN (SELECT src FROM e)")
def q_final_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.operators import evolution

    nodes, edges = graph(spark, sf_dir)
    return evolution.finals(evolution.paths(nodes, edges), edges).select("start", "node", "depth")


@query(f"WITH RECURSIVE {EDGES_SQL}, {WALK_SQL} SELECT node, min(start) AS root FROM walk GROUP BY node")
def q_family_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.operators import evolution

    return evolution.families(*graph(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES_SQL}, {WALK_SQL} SELECT start, arg_max(node, p_size::BIGINT*100000000+node) AS best FROM walk JOIN part ON p_partkey=node WHERE node NOT IN (SELECT src FROM e) GROUP BY start""")
def q_best_final_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.operators import evolution

    nodes, edges = graph(spark, sf_dir)
    ends = evolution.finals(evolution.paths(nodes, edges), edges)
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    return ends.join(sizes, "node").groupBy("start").agg(F.max_by("node", F.struct("p_size", "node")).alias("best"))
