"""Whole inventories: validated, resolved and classified against a catalogue made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import classification
from orrery.plans.registry import query, table


def catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A species for each nation, which becomes that of the nation five further; the last of several stat lines of a form counts."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    key, name = lambda c: F.concat(F.lit("n"), c.cast("string")), lambda c: F.concat(F.lit("Species "), F.chr(c + 65))
    k = F.col("k")
    species = n.select(key(k).alias("species_key"), name(k).alias("species_name"), (k + 1).alias("pokedex_id"), F.array(F.concat(F.lit("Alias "), k.cast("string"))).alias("aliases"), k.cast("long").alias("at"))
    edges = n.where("k < 20").select(key(k).alias("species_key"), key(k + 5).alias("evolves_to_key"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("evolves_to_form"))
    lines = n.select(key(k).alias("species_key"), F.lit("Normal").alias("form"), F.explode(F.array(F.lit(0), F.lit(1))).alias("late"), k)
    stats = lines.select("species_key", "form", *[F.when(F.col("late") == 1, base + k * step).otherwise(1).alias(c) for c, base, step in (("base_attack", 100, 7), ("base_defense", 90, 5), ("base_stamina", 110, 3))], (F.col("late") * 100 + k).cast("long").alias("at"))
    levels = table(spark, sf_dir, "nation").limit(1).select(F.explode(F.sequence(F.lit(2), F.lit(100))).alias("n")).select((F.col("n") / 2).alias("level"), (F.lit(0.05) * F.sqrt(F.col("n").cast("double"))).alias("cpm"))
    return {"species": species, "evolutions": edges, "base_stats": stats, "cp_multipliers": levels}


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer, in the order of keys; some name their species by an alias, some not at all, some values are missing."""
    c, k, n = table(spark, sf_dir, "customer").orderBy("c_custkey"), F.col("c_custkey"), F.col("c_nationkey")
    name = F.when(k % 37 == 0, "").when(k % 5 == 0, F.concat(F.lit(" ALIAS  "), n.cast("string"))).when(k % 41 == 0, "Unknown One").otherwise(F.concat(F.lit("Species "), F.chr(n + 65)))
    values = [F.when(k % 43 == 0, "x").otherwise(((k * m) % 16).cast("string")).alias(v) for v, m in (("iv_attack", 1), ("iv_defense", 7), ("iv_stamina", 13))]
    return c.select("c_custkey", name.alias("species"), *values)


# What the rows are, for DuckDB: st is the species' number, null where it has none.
_OWNED = """inv AS (SELECT row_number() OVER (ORDER BY c_custkey)-1 AS idx, c_custkey AS id, CASE WHEN c_custkey%37=0 THEN NULL WHEN c_custkey%5=0 THEN c_nationkey WHEN c_custkey%41=0 THEN NULL ELSE c_nationkey END AS st, c_custkey%37=0 AS nameless, c_custkey%43=0 AS bad, c_custkey%16 AS a, c_custkey*7%16 AS d, c_custkey*13%16 AS s FROM customer)"""
_LEVELED = """cpm AS (SELECT n, 0.05*sqrt(n::DOUBLE) AS cpm FROM range(2,101) t(n)), caps(l,cap) AS (VALUES ('LL',500),('GL',1500),('UL',2500)),
reach AS (SELECT n_nationkey AS st, n_nationkey+5*j AS nd, j FROM nation, range(5) t(j) WHERE n_nationkey+5*j<25)"""
_POINTS = "greatest(10, floor((100+7*nd+a)*sqrt((90+5*nd+d)::DOUBLE)*sqrt((110+3*nd+s)::DOUBLE)*cpm*cpm/10))"
_PRODUCT = "((100+7*nd+a)*cpm)*((90+5*nd+d)*cpm)*floor((110+3*nd+s)*cpm)"


@query(f"""WITH {_OWNED} SELECT idx+2 AS "row", problem FROM (SELECT idx, unnest(list_filter([CASE WHEN nameless THEN 'missing species' END, CASE WHEN bad THEN 'missing or invalid iv_attack' END, CASE WHEN bad THEN 'missing or invalid iv_defense' END, CASE WHEN bad THEN 'missing or invalid iv_stamina' END], lambda x: x IS NOT NULL)) AS problem FROM inv)""")
def q_inventory_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors, warnings = classification.validate(owned(spark, sf_dir))
    return warnings


@query(f"""WITH {_OWNED} SELECT id AS c_custkey, CASE WHEN st IS NOT NULL THEN 'n'||st END AS species_key FROM inv""")
def q_resolved_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classification.numbered(owned(spark, sf_dir))
    return classification.resolved(rows, {c: c for c in rows.columns}, catalog(spark, sf_dir)["species"]).select("c_custkey", "species_key")


@query(f"""WITH {_OWNED}, {_LEVELED},
att AS (SELECT idx, row_number() OVER (PARTITION BY st%5 ORDER BY 10*a+d+s DESC, a DESC, d DESC, s DESC, idx) AS rk FROM inv WHERE st IS NOT NULL AND NOT bad),
lv AS (SELECT idx, st, nd, j, a, d, s, l, max(n) AS n FROM inv JOIN reach USING (st) CROSS JOIN cpm CROSS JOIN caps WHERE NOT bad AND {_POINTS}<=cap GROUP BY ALL),
pr AS (SELECT *, {_PRODUCT} AS p FROM lv JOIN cpm USING (n)),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY st%5, l ORDER BY p DESC, n DESC, a+d+s DESC, idx, j) AS rk FROM pr) WHERE rk=1),
g AS (SELECT w.idx AS widx, w.l, w.nd, w.p AS wp, w.n AS wn, w.a AS wa, w.d AS wd, w.s AS ws, x.n AS a, y.n AS d, z.n AS s, cap FROM win w JOIN caps USING (l), range(16) x(n), range(16) y(n), range(16) z(n)),
gl AS (SELECT widx, l, nd, wp, wn, wa, wd, ws, a, d, s, max(n) AS n FROM g CROSS JOIN cpm WHERE {_POINTS}<=cap GROUP BY ALL),
gr AS (SELECT widx, l, count(*) FILTER (WHERE (-p, -n, a, d, s) <= (-wp, -wn, wa, wd, ws)) AS iv_rank FROM (SELECT *, {_PRODUCT} AS p FROM gl JOIN cpm USING (n)) GROUP BY widx, l)
SELECT i.id AS c_custkey, CASE WHEN st IS NOT NULL THEN 'n'||(st%5) END AS family_id, CASE WHEN st IS NOT NULL THEN 'Species '||chr((85+st%5)::INT) END AS best_final_evolution, CASE WHEN NOT bad THEN 10*a+d+s END::BIGINT AS attacker_score, CASE WHEN att.rk<=3 THEN att.rk END::INT AS attacker_rank_in_family,
 (SELECT 'Species '||chr((65+nd)::INT) FROM win WHERE win.idx=i.idx AND l='GL') AS pvp_gl_as_species, (SELECT n/2.0::DOUBLE FROM win WHERE win.idx=i.idx AND l='UL') AS pvp_ul_level, (SELECT iv_rank FROM gr WHERE widx=i.idx AND l='GL') AS pvp_gl_iv_rank, (SELECT iv_rank FROM gr WHERE widx=i.idx AND l='LL') AS pvp_ll_iv_rank,
 CASE WHEN coalesce(att.rk<=3,false) OR i.idx IN (SELECT idx FROM win) THEN 'KEEP' WHEN st IS NULL OR bad THEN 'REVIEW' ELSE 'LET-GO' END AS recommendation FROM inv i LEFT JOIN att USING (idx)""")
def q_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    legacy = spark.createDataFrame([], "species_key string, evolution_species_key string, move_name string, move_type string, note string")
    out = classification.classify(owned(spark, sf_dir), catalog(spark, sf_dir), legacy)
    whole = [F.col("attacker_score").cast("long").alias("attacker_score"), F.col("attacker_rank_in_family").cast("int").alias("attacker_rank_in_family")]
    return out.select("c_custkey", "family_id", "best_final_evolution", *whole, "pvp_gl_as_species", "pvp_ul_level", "pvp_gl_iv_rank", "pvp_ll_iv_rank", "recommendation")
