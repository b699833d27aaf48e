"""Sequences of frames: sessions, latches, fills, samples, budgets, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import sequences, votes
from orrery.plans.frames import FRAMES_SQL, frames
from orrery.plans.registry import query, table

RUNS_SQL = """m AS (SELECT *, cls IN ('detail','appraisal') AS mem FROM frames), st AS (SELECT *, mem AND NOT (coalesce(lag(mem) OVER w, false) AND lag(cls) OVER w = cls) AS s FROM m WINDOW w AS (PARTITION BY source ORDER BY i)),
runs AS (SELECT *, CASE WHEN mem THEN sum(s::INT) OVER (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING)-1 END::BIGINT AS run FROM st)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.with_runs(frames(spark, sf_dir), ["source"], ["i"], F.col("cls").isin("detail", "appraisal"), F.col("cls"))


@query(f"WITH {FRAMES_SQL}, {RUNS_SQL} SELECT source, run, min(cls) AS cls, min(i)::BIGINT AS first, max(i)::BIGINT AS last, count(*)::BIGINT AS n FROM runs WHERE run IS NOT NULL GROUP BY source, run")
def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).where("run is not null").groupBy("source", "run").agg(F.min("cls").alias("cls"), F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"))


@query(f"""WITH {FRAMES_SQL}, d AS (SELECT *, abs(k-coalesce(lag(k) OVER w,k)) AS p, abs(k-coalesce(lead(k,3) OVER w,k)) AS f, cls IN ('detail','appraisal') AS c FROM frames WINDOW w AS (PARTITION BY source ORDER BY i)),
ab AS (SELECT *, coalesce(c AND p>=40 AND f>=40,false) AS a, coalesce(c AND ((p<=5 AND f>=40) OR (p>=32 AND f>=35)),false) AS b FROM d),
z AS (SELECT *, max(CASE WHEN a THEN i END) OVER u AS la, max(CASE WHEN NOT a AND NOT b THEN i END) OVER u AS lo FROM ab WINDOW u AS (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT event_id, coalesce(la>coalesce(lo,-1),false) AS flag FROM z""")
def q_transition_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("source").orderBy("i")
    d = frames(spark, sf_dir).withColumn("p", F.abs(F.col("k") - F.coalesce(F.lag("k").over(w), F.col("k")))).withColumn("f", F.abs(F.col("k") - F.coalesce(F.lead("k", 3).over(w), F.col("k"))))
    c = F.col("cls").isin("detail", "appraisal")
    holds = c & (((F.col("p") <= 5) & (F.col("f") >= 40)) | ((F.col("p") >= 32) & (F.col("f") >= 35)))
    return sequences.latch(d, ["source"], ["i"], c & (F.col("p") >= 40) & (F.col("f") >= 40), holds).select("event_id", "flag")


WVOTE_SQL = "SELECT source, run, CASE WHEN count(*)=1 OR (max(n)>=3 AND max(n)>=3*coalesce((list_sort(list(n),'DESC'))[2],0) AND max(n)>=0.75*sum(n)) THEN arg_max(v,n) END AS sel FROM t GROUP BY source, run"


@query(f"""WITH {FRAMES_SQL}, x AS (SELECT *, CASE WHEN cls='list' THEN -1 ELSE CASE WHEN k%5=0 THEN NULL ELSE k%3 END END AS key, CASE WHEN k%4=0 THEN NULL WHEN k%4<3 THEN 7 ELSE k END::BIGINT AS wt FROM frames),
kk AS (SELECT *, lag(key) OVER (PARTITION BY source ORDER BY i) IS DISTINCT FROM key AS s FROM x WHERE key IS NOT NULL), r AS (SELECT *, sum(s::INT) OVER (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM kk),
t AS (SELECT source, run, wt AS v, count(*) AS n FROM r WHERE wt IS NOT NULL AND cls<>'list' GROUP BY 1,2,3), s AS ({WVOTE_SQL})
SELECT r.event_id, CASE WHEN r.cls<>'list' THEN coalesce(sel, wt) ELSE wt END AS weight FROM r LEFT JOIN s USING (source, run)""")
def q_weight_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    hp = F.when(F.col("k") % 5 != 0, F.col("k") % 3)
    x = frames(spark, sf_dir).withColumn("key", F.when(F.col("cls") == "list", -1).otherwise(hp)).withColumn("wt", F.when(F.col("k") % 4 == 0, None).when(F.col("k") % 4 < 3, 7).otherwise(F.col("k")).cast("long"))
    runs = sequences.with_skipping_runs(x, ["source"], ["i"], F.col("key")).where("run is not null")
    chosen = votes.vote(runs.where("cls <> 'list'"), ["source", "run"], "wt", ratio=3.0, share=0.75)
    joined = runs.join(chosen, ["source", "run"], "left")
    return joined.select("event_id", F.when(F.col("cls") != "list", F.coalesce("selected", "wt")).otherwise(F.col("wt")).alias("weight"))


@query(f"""WITH {FRAMES_SQL}, {RUNS_SQL}, g AS (SELECT *, bool_or(k%10=0) OVER q AS giga, bool_or(k%10=1) OVER q AS dyna FROM runs WHERE run IS NOT NULL WINDOW q AS (PARTITION BY source, run))
SELECT event_id, giga AS gigantamax, (NOT giga AND dyna) AS dynamax FROM g""")
def q_power_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = W.partitionBy("source", "run")
    g = sessions(spark, sf_dir).where("run is not null").withColumn("gigantamax", F.bool_or(F.col("k") % 10 == 0).over(q)).withColumn("d", F.bool_or(F.col("k") % 10 == 1).over(q))
    return g.select("event_id", "gigantamax", (~F.col("gigantamax") & F.col("d")).alias("dynamax"))


@query(f"WITH {FRAMES_SQL}, {RUNS_SQL} SELECT event_id, run IS NOT NULL AND k%2=0 AND i=max(CASE WHEN k%2=0 THEN i END) OVER (PARTITION BY source, run) AS kept FROM runs")
def q_last_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.last_of_run(sessions(spark, sf_dir), ["source"], "i", "run", F.col("k") % 2 == 0).select("event_id", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(f"""WITH {FRAMES_SQL}, z AS (SELECT *, max(i) OVER (PARTITION BY source) AS l FROM frames), p AS (SELECT * FROM z WHERE i<6 OR i>l-6 OR i IN (0, round(l/5.0)::BIGINT, round(2*l/5.0)::BIGINT, round(3*l/5.0)::BIGINT, round(4*l/5.0)::BIGINT, l))
SELECT event_id, row_number() OVER (PARTITION BY source ORDER BY i DESC)::BIGINT AS pick FROM p""")
def q_repair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.repair_sample(frames(spark, sf_dir), ["source"], "i").select("event_id", "pick")


@query(f"WITH {FRAMES_SQL} SELECT event_id, k%2=0 AND sum((k%2=0)::INT) OVER (PARTITION BY source ORDER BY i DESC ROWS UNBOUNDED PRECEDING)<=3 AS probed FROM frames")
def q_probe_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.within_budget(frames(spark, sf_dir), ["source"], [F.desc("i")], F.col("k") % 2 == 0).select("event_id", "probed")


@query(f"WITH {FRAMES_SQL}, s AS (SELECT source, i, value FROM frames) SELECT source, i, value FROM s ORDER BY value DESC, source, i LIMIT 10")
def q_slowest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("source", "i", "value").orderBy(F.desc("value"), "source", "i").limit(10)


@query(f"WITH {FRAMES_SQL} SELECT cls, event_type, count(*)::BIGINT AS n FROM frames GROUP BY GROUPING SETS ((cls),(cls,event_type))")
def q_lifecycle_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.groupingSets([[F.col("cls")], [F.col("cls"), F.col("event_type")]], "cls", "event_type").agg(F.count("*").alias("n"))


@query("SELECT coalesce(event_type,'total') AS label, count(*)::BIGINT AS n FROM events GROUP BY ROLLUP(event_type)")
def q_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("total")).alias("label"), "n")


@query(f"""WITH {FRAMES_SQL} SELECT event_id, CASE WHEN cls IN ('list') THEN 'list' WHEN k>=90 THEN 'non_extractable' WHEN cls='appraisal' AND value>=10 THEN 'appraisal' WHEN ((k>=30)::INT+(value>=20)::INT+(cls='detail')::INT)>=2 THEN 'detail' ELSE 'non_extractable' END AS label FROM frames""")
def q_rule_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.operators import rules

    return frames(spark, sf_dir).select("event_id", rules.first_match([(F.col("cls") == "list", "list"), (F.col("k") >= 90, "non_extractable"), ((F.col("cls") == "appraisal") & (F.col("value") >= 10), "appraisal"), (rules.count_true(F.col("k") >= 30, F.col("value") >= 20, F.col("cls") == "detail") >= 2, "detail")], "non_extractable").alias("label"))


GENERIC_SQL = "CASE WHEN count(*)=1 OR (max(n)>=3 AND max(n)>=2*coalesce((list_sort(list(n),'DESC'))[2],0)) THEN arg_max(v,n) END"


@query(f"WITH t AS (SELECT l_partkey, (l_quantity::BIGINT//20) AS v, count(*) AS n FROM lineitem GROUP BY 1,2) SELECT l_partkey, {GENERIC_SQL} AS selected, count(*)::BIGINT AS n_distinct FROM t GROUP BY 1")
def q_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.vote(table(spark, sf_dir, "lineitem").withColumn("v", F.expr("cast(l_quantity as bigint) div 20")), ["l_partkey"], "v")


@query("WITH t AS (SELECT l_partkey, l_returnflag||l_linestatus AS v, count(*) AS n FROM lineitem GROUP BY 1,2) SELECT l_partkey, CASE WHEN count(*)=1 OR (max(n)>=2 AND max(n)>coalesce((list_sort(list(n),'DESC'))[2],0)) THEN arg_max(v,n) END AS selected, count(*)::BIGINT AS n_distinct FROM t GROUP BY 1")
def q_text_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.text_vote(table(spark, sf_dir, "lineitem").withColumn("v", F.concat("l_returnflag", "l_linestatus")), ["l_partkey"], "v")


CPV = "CASE l_linenumber % 4 WHEN 0 THEN 40 + l_partkey % 3 WHEN 1 THEN 150 + l_partkey % 2 WHEN 2 THEN 1500 + l_suppkey % 10 ELSE 150 END"


@query(f"""WITH c AS (SELECT l_partkey AS g, {CPV} AS v, count(*) AS n FROM lineitem GROUP BY 1,2), o AS (SELECT g, CASE WHEN count(*)=1 THEN max(v) END AS one, max(v) AS most FROM c GROUP BY g),
h AS (SELECT * FROM c WHERE v>=100), va AS (SELECT g, v//10 AS stem, count(*) AS va, max(n) AS best, sum(n) AS total FROM h WHERE v>=1000 GROUP BY 1,2),
ex AS (SELECT h.g, arg_max(h.v, h.n*1000000-h.v) AS x FROM h JOIN va ON va.g=h.g AND va.stem=h.v WHERE h.n>=3 OR (va.va=1 AND va.best>=2) GROUP BY 1),
sh AS (SELECT g, arg_max(stem, total*1000000-stem) AS x FROM va WHERE va>=4 AND total>=3 GROUP BY 1), u AS (SELECT g, {GENERIC_SQL} AS x FROM h GROUP BY 1), e AS (SELECT g, {GENERIC_SQL} AS x FROM c GROUP BY 1)
SELECT o.g AS l_partkey, coalesce(o.one, CASE WHEN most>=100 THEN coalesce(ex.x, sh.x, u.x) ELSE e.x END) AS selected FROM o LEFT JOIN ex USING (g) LEFT JOIN sh USING (g) LEFT JOIN u USING (g) LEFT JOIN e USING (g)""")
def q_cp_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.cp_vote(table(spark, sf_dir, "lineitem").withColumn("v", F.expr(CPV)), ["l_partkey"], "v")


@query("SELECT p_partkey, CASE WHEN p_size<23 THEN 0 WHEN p_size<30 THEN 1 WHEN p_size<37 THEN 2 WHEN p_size<46 THEN 3 END::BIGINT AS stars FROM part")
def q_star_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.functions.scoring import star_tier

    return table(spark, sf_dir, "part").select("p_partkey", star_tier(F.col("p_size")).alias("stars"))


@query(f"""WITH {FRAMES_SQL} SELECT source, arg_max(value, i) FILTER (cls='detail') AS newest_detail, arg_max(k, i) FILTER (cls='appraisal' AND k%2=0) AS newest_even, bool_or(k=0) AS any_zero,
CASE WHEN count(DISTINCT CASE WHEN cls='list' THEN k%2 END)=1 THEN max(CASE WHEN cls='list' THEN k%2 END) END AS locked FROM frames GROUP BY source""")
def q_first_clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lst = F.when(F.col("cls") == "list", F.col("k") % 2)
    return frames(spark, sf_dir).groupBy("source").agg(F.max_by(F.when(F.col("cls") == "detail", F.col("value")), F.when(F.col("cls") == "detail", F.col("i"))).alias("newest_detail"), F.max_by("k", F.when((F.col("cls") == "appraisal") & (F.col("k") % 2 == 0), F.col("i"))).alias("newest_even"), F.bool_or(F.col("k") == 0).alias("any_zero"), F.when(F.count_distinct(lst) == 1, F.max(lst)).alias("locked"))


IDENT_SQL = "o AS (SELECT o_orderkey AS id, o_custkey%50 AS src, o_custkey%7 AS hp, CASE WHEN o_orderkey%5<>0 THEN o_totalprice END AS w, o_orderstatus AS role, CASE WHEN o_orderkey%3=0 THEN NULL ELSE o_custkey%4 END AS sp FROM orders), kd AS (SELECT *, CASE WHEN w IS NOT NULL THEN src||'|'||hp||'|'||printf('%.3f', w) END AS key FROM o)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.operators import assembly

    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 50 AS src", "o_custkey % 7 AS hp", "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS w", "o_orderstatus AS role", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 4 END AS sp", "o_custkey AS cust")
    return o.withColumn("key", assembly.identity_key(F.col("src"), F.col("hp"), weight=F.col("w")))


@query(f"WITH {IDENT_SQL} SELECT key, count(*)::BIGINT AS n, min(id) AS first, bool_or(role='F') AS accepted FROM kd WHERE key IS NOT NULL GROUP BY key")
def q_identity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.bool_or(F.col("role") == "F").alias("accepted"))


@query(f"WITH {IDENT_SQL}, c AS (SELECT *, (SELECT o_custkey FROM orders WHERE o_orderkey=id) AS cust FROM kd), u AS (SELECT cust, min(key) AS k FROM c WHERE key IS NOT NULL GROUP BY cust HAVING count(DISTINCT key)=1) SELECT id, coalesce(key, k) AS adopted FROM c LEFT JOIN u USING (cust)")
def q_unique_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.operators import assembly

    return assembly.adopt_unique(_candidates(spark, sf_dir), ["cust"], "key").select("id", "adopted")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS g, o_orderstatus AS role, CASE WHEN o_orderkey%3<>0 THEN o_orderkey%4 END AS sp FROM orders), d AS (SELECT * FROM o WHERE role='F'), a AS (SELECT * FROM o WHERE role='O'),
c AS (SELECT g, (SELECT count(*) FROM d WHERE d.g=q.g) AS nd, (SELECT count(*) FROM a WHERE a.g=q.g) AS na FROM (SELECT DISTINCT g FROM o) q),
p AS (SELECT g, d.id AS detail, a.id AS appraisal, d.sp AS s1, a.sp AS s2 FROM d JOIN a USING (g)), e AS (SELECT *, count(*) FILTER (s1=s2) OVER (PARTITION BY g) AS same FROM p)
SELECT g, detail, appraisal FROM e JOIN c USING (g) WHERE (nd=1 AND na=1 AND (s1 IS NULL OR s2 IS NULL OR s1=s2)) OR (NOT (nd=1 AND na=1) AND s1=s2 AND same=1)""")
def q_recovery_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.operators import assembly

    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS g", "o_orderstatus AS role", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 END AS sp")
    return assembly.recover_pairs(o.where("role = 'F'").drop("role"), o.where("role = 'O'").drop("role"), ["g"], "sp")


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS src, o_orderkey AS f, o_orderkey + (o_totalprice/10)::BIGINT AS l, o_orderstatus AS st FROM (SELECT * REPLACE (floor(o_totalprice/10)*10 AS o_totalprice) FROM orders)) SELECT DISTINCT c.id FROM s c JOIN s a ON a.src=c.src AND a.st='F' AND c.st<>'F' AND a.f<=c.f AND a.l>=c.l""")
def q_row_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.operators import assembly

    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS src", "o_orderkey AS f", "o_orderkey + cast(floor(o_totalprice / 10) as bigint) AS l", "o_orderstatus AS st")
    return assembly.contained(s.where("st <> 'F'"), s.where("st = 'F'"), "src", "f", "l")


@query("""WITH x AS (SELECT vec_id, label, embedding AS e, lag(embedding) OVER w AS p, lead(embedding,3) OVER w AS n FROM embeddings WINDOW w AS (PARTITION BY vec_id//50 ORDER BY vec_id))
SELECT vec_id, floor(1000000*coalesce(list_sum(list_transform(range(1,len(e)+1), lambda j: abs(e[j]::DOUBLE-p[j]::DOUBLE))),0))::BIGINT//10 AS prev, (n IS NOT NULL) AS has_next FROM x""")
def q_motion_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy(F.expr("vec_id div 50")).orderBy("vec_id")  # a source has fifty frames
    x = table(spark, sf_dir, "embeddings").withColumn("p", F.lag("embedding").over(w)).withColumn("n", F.lead("embedding", 3).over(w))
    delta = F.aggregate(F.zip_with("embedding", "p", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, d: s + d)
    return x.select("vec_id", F.floor(F.floor(1000000 * F.coalesce(delta, F.lit(0.0))) / 10).cast("long").alias("prev"), F.col("n").isNotNull().alias("has_next"))


@query("""SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS last_price, list_aggregate(list_sort(list(DISTINCT o_orderpriority)),'string_agg','|') AS priorities, min(o_orderkey) AS first_order FROM orders GROUP BY 1""")
def q_last_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("last_price"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"), F.min("o_orderkey").alias("first_order"))


@query("""SELECT c_custkey, 'negative balance' AS problem FROM customer WHERE c_acctbal<0 UNION ALL SELECT c_custkey, 'odd segment' FROM customer WHERE c_mktsegment='MACHINERY'""")
def q_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.operators import rules

    return rules.violations(table(spark, sf_dir, "customer"), "c_custkey", {"negative balance": F.col("c_acctbal") < 0, "odd segment": F.col("c_mktsegment") == "MACHINERY"})


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT event_id, CASE cls WHEN 'appraisal' THEN ['cp','hp','iv','story'] WHEN 'detail' THEN ['cp','hp','moves'] ELSE []::VARCHAR[] END AS want, CASE WHEN k%2=0 THEN ['hp'] ELSE ['cp','moves'] END AS have FROM frames)
SELECT event_id, list_aggregate(list_sort(list_filter(want, lambda x: NOT list_contains(have, x))),'string_agg',',') AS missing, len(list_filter(want, lambda x: list_contains(have, x)))::BIGINT AS got FROM s""")
def q_field_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    want = F.when(F.col("cls") == "appraisal", lit("cp", "hp", "iv", "story")).when(F.col("cls") == "detail", lit("cp", "hp", "moves")).otherwise(lit())
    have = F.when(F.col("k") % 2 == 0, lit("hp")).otherwise(lit("cp", "moves"))
    missing = F.array_sort(F.array_except(want, have))
    return frames(spark, sf_dir).select("event_id", F.when(F.size(missing) > 0, F.array_join(missing, ",")).alias("missing"), F.size(F.array_intersect(want, have)).cast("long").alias("got"))
