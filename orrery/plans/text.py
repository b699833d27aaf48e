"""Parsers and lookups over rendered and stored text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import parsers
from orrery.operators import lookups
from orrery.plans.registry import query, table

LINE = "l_orderkey, l_linenumber"


def _lines(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{text} AS txt")


CP_TEXT = """CASE l_orderkey % 12 WHEN 0 THEN 'CP' || CAST(l_partkey % 12000 AS STRING) WHEN 1 THEN 'cP: ' || translate(CAST(l_partkey % 12000 AS STRING), '015', 'OlS') WHEN 2 THEN 'xce' || CAST(l_suppkey AS STRING)
 WHEN 3 THEN 'level ' || CAST(l_partkey % 100000 AS STRING) || ' x' WHEN 4 THEN 'cp none' WHEN 5 THEN 'CP' || CAST(l_partkey % 900 + 10 AS STRING) || '  ||' WHEN 6 THEN 'CP ' || CAST(l_partkey % 90 + 10 AS STRING) || ',345'
 WHEN 7 THEN 'CP ' || CAST(l_partkey % 90 + 10 AS STRING) || ' 34' WHEN 8 THEN 'a 99999 ' || CAST(l_partkey % 900 + 100 AS STRING) || ' 5000' WHEN 9 THEN 'CP123456 ' || CAST(l_suppkey % 900 + 100 AS STRING) WHEN 10 THEN 'CP' || CAST(l_suppkey % 900 + 100 AS STRING) || 'x' ELSE 'eep ' || CAST(l_partkey % 9900 + 100 AS STRING) || '.' END"""
NUM = "CASE WHEN {x}='' THEN NULL ELSE {x}::BIGINT END"


def _sql(text: str) -> str:
    return text.replace("AS STRING)", "AS VARCHAR)")


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, {_sql(CP_TEXT)} AS txt FROM lineitem),
c AS (SELECT *, translate(regexp_replace(txt,'([0-9])\\s+\\|+\\s*$','\\1'),'OoIl|LSsTtB','00111155448') AS x FROM t),
d AS (SELECT *, regexp_extract(x,'(?i)\\bCP\\s*[:#-]?\\s*([0-9]+)([\\s,.]*[0-9])?([A-Za-z_])?',['n','more','word']) AS a, regexp_extract(lower(x),'(c+p+e?|c+e+p+|e+p+|c+e+)\\s*([0-9]+)([\\s,.]*[0-9])?',['pre','n','more']) AS b,
 regexp_matches(lower(x),'(c+p+e?|c+e+p+|e+p+|c+e+)') AS pre, list_filter(list_transform(regexp_extract_all(x,'\\b[0-9]{{3,5}}\\b'), lambda n: n::BIGINT), lambda n: n BETWEEN 10 AND 9366)[1] AS l FROM c),
v AS (SELECT *, CASE WHEN length(a.n) BETWEEN 2 AND 5 AND a.more='' AND a.word='' THEN try_cast(a.n AS BIGINT) WHEN length(b.n) BETWEEN 2 AND 5 AND b.more='' THEN try_cast(b.n AS BIGINT) WHEN NOT pre THEN l END AS n FROM d)
SELECT {LINE}, CASE WHEN n BETWEEN 10 AND 9366 THEN n END AS cp FROM v""")
def q_cp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, CP_TEXT).select("l_orderkey", "l_linenumber", parsers.parse_cp(F.col("txt")).alias("cp"))


HP_TEXT = "CASE l_linenumber % 3 WHEN 0 THEN 'HP ' || CAST(l_partkey % 200 AS STRING) || '/' || CAST(l_suppkey % 200 AS STRING) WHEN 1 THEN translate(CAST(l_suppkey % 90 AS STRING), '01', 'Ol') || ' / ' || CAST(l_suppkey % 90 + 10 AS STRING) ELSE 'hp' END"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, translate({_sql(HP_TEXT)},'OoIl|LSsTtB','00111155448') AS x FROM lineitem),
d AS (SELECT *, regexp_extract(x,'([0-9]{{1,3}})\\s*/\\s*([0-9]{{2,3}})',1) AS a, regexp_extract(x,'([0-9]{{1,3}})\\s*/\\s*([0-9]{{2,3}})',2) AS b FROM t),
v AS (SELECT *, CASE WHEN a<>'' THEN a::INT END AS n, CASE WHEN b<>'' THEN b::INT END AS m FROM d)
SELECT {LINE}, CASE WHEN n<=m AND m>=10 THEN n||'/'||m END AS hp, CASE WHEN n<=m AND m>=10 THEN n::BIGINT END AS hp_current, CASE WHEN n<=m AND m>=10 THEN m::BIGINT END AS hp_max FROM v""")
def q_hp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hp = _lines(spark, sf_dir, HP_TEXT).withColumn("hp", parsers.parse_hp(F.col("txt")))
    parts = parsers.hp_parts(F.col("hp"))
    return hp.select("l_orderkey", "l_linenumber", "hp", parts["current"].alias("hp_current"), parts["max"].alias("hp_max"))


WEIGHT_TEXT = "CASE l_orderkey % 5 WHEN 0 THEN 'WEIGHT (' || CAST(l_partkey % 1200 AS STRING) || ',' || CAST(l_suppkey % 10 AS STRING) || '0 KG' WHEN 1 THEN CAST(l_partkey % 120 AS STRING) || ' kg' WHEN 2 THEN '0 kg ' || CAST(l_partkey % 90 + 1 AS STRING) || ' kg' WHEN 3 THEN '1001 kg 5.' || CAST(l_suppkey % 10 AS STRING) || ' kg 7 kg' ELSE 'x' || CAST(l_partkey AS STRING) || 'kg' END"


def _measure_sql(text: str, whole: int, unit: str, most: int, out: str) -> str:
    return f"""WITH t AS (SELECT l_orderkey, l_linenumber, lower(replace({_sql(text)},',','.')) AS x FROM lineitem),
d AS (SELECT *, list_filter(regexp_extract_all(x,'(?:^|[\\s(:;\\[{{|])([0-9]{{1,{whole}}}(\\.[0-9]{{1,2}})?)\\s*{unit}\\b',1), lambda a: a::DOUBLE>0 AND a::DOUBLE<={most})[1] AS a FROM t)
SELECT {LINE}, regexp_replace(regexp_replace(a,'0+$',''),'\\.$','') AS {out} FROM d"""


@query(_measure_sql(WEIGHT_TEXT, 4, "kg", 1000, "weight"))
def q_weight_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, WEIGHT_TEXT).select("l_orderkey", "l_linenumber", parsers.parse_weight(F.col("txt")).alias("weight"))


HEIGHT_TEXT = WEIGHT_TEXT.replace("KG", "M").replace("kg", "m").replace("% 1200", "% 120")


@query(_measure_sql(HEIGHT_TEXT, 2, "m", 100, "height"))
def q_height_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, HEIGHT_TEXT).select("l_orderkey", "l_linenumber", parsers.parse_height(F.col("txt")).alias("height"))


STORY = "CASE o_orderkey % 3 WHEN 0 THEN 'Hello.  This ' || o_orderpriority || ' was caught on ' || CAST(o_custkey % 12 + 1 AS STRING) || '/2/2024 around City ' || CAST(o_custkey AS STRING) || ', Land ' || o_orderstatus || '! x' WHEN 1 THEN 'this one WAS caught on 1/' || CAST(o_custkey % 9 + 1 AS STRING) || '/202' || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE '3' END || ' around X ,.' ELSE 'This a. This b was\ncaught on 10/11/2023 around Y.' END"


@query(f"""WITH t AS (SELECT o_orderkey, regexp_replace({_sql(STORY)},'\\s+',' ','g') AS x FROM orders),
d AS (SELECT o_orderkey, regexp_extract(x,'(?i)\\bThis ([^.!?]+?) was caught on ([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}) around ([^.!?]*[^.!?\\s]) ?[.!?]',['a','b','c']) AS m FROM t)
SELECT o_orderkey, nullif(m.a,'') AS name, nullif(m.b,'') AS caught, nullif(m.c,'') AS location, list_filter(list_transform(string_split(nullif(m.c,''),','), lambda p: trim(p)), lambda p: p<>'')[-1] AS country FROM d""")
def q_story_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{STORY} AS txt").withColumn("s", parsers.parse_story(F.col("txt")))
    return s.select("o_orderkey", F.col("s.name").alias("name"), F.col("s.date").alias("caught"), F.col("s.location").alias("location"), F.col("s.country").alias("country"))


NAME = "CASE o_orderkey % 7 WHEN 5 THEN 'Power  Up ' || o_orderpriority WHEN 6 THEN 'Star' || CASE WHEN o_custkey % 2 = 0 THEN 'dust' ELSE 'mie' END WHEN 0 THEN '  ' || o_orderpriority || '  x' WHEN 1 THEN o_orderstatus WHEN 2 THEN '##--' || o_orderstatus || 'a' WHEN 3 THEN 'w ' || CAST(o_custkey AS STRING) || ' kg' ELSE CAST(o_custkey AS STRING) || '/' || o_orderpriority END"


@query(f"""WITH t AS (SELECT o_orderkey, trim(regexp_replace({_sql(NAME)},'\\s+',' ','g')) AS x FROM orders), d AS (SELECT *, length(regexp_replace(x,'[^\\p{{L}}]','','g')) AS l, length(regexp_replace(x,'[\\p{{L}}\\p{{N}}\\s]','','g')) AS m FROM t)
SELECT o_orderkey, CASE WHEN NOT (l<2 OR m>l OR regexp_matches(lower(x),'[0-9]\\s*(kg|m)\\b') OR regexp_matches(x,'[0-9]\\s*/\\s*[0-9]') OR (regexp_matches(x,'[0-9]') AND l<=3) OR regexp_matches(lower(x),'\\b(cp|hp|weight|height|stardust|candy|power up|gyms|raids|trainer battles)\\b')) THEN x END AS name FROM d""")
def q_name_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{NAME} AS txt").select("o_orderkey", parsers.display_name(F.col("txt")).alias("name"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name||'_'||p_type)),'[^\\p{L}\\p{N}]+','-','g'),'^-|-$','','g') AS slug, CASE WHEN p_size%3=0 THEN 'Normal' ELSE p_brand END AS form,
p_size%4 IN (0,2) AS flag, CASE WHEN p_size%5=0 THEN NULL WHEN p_size<16 THEN p_size::BIGINT END AS iv FROM part""")
def q_scalar_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    flag = F.element_at(F.array(F.lit(" Yes"), F.lit("no"), F.lit("T "), F.lit("")), (F.col("p_size") % 4 + 1).cast("int"))
    iv = F.when(F.col("p_size") % 5 == 0, "inf").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".9")))
    return p.select("p_partkey", parsers.slug(F.concat("p_name", F.lit("_"), "p_type")).alias("slug"), parsers.form_or_normal(F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_brand"))).alias("form"), parsers.parse_bool(flag).alias("flag"), parsers.parse_iv(iv).alias("iv"))


@query("""SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, coalesce(CAST(json_extract_string(props,'$.none') AS BIGINT), -1) AS missing, json_valid(props) AS ok FROM events""")
def q_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return v.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.coalesce(F.try_variant_get("v", "$.none", "bigint"), F.lit(-1).cast("long")).alias("missing"), F.col("v").isNotNull().alias("ok"))


NAMES_SQL = """names AS (SELECT lower(n_name) AS norm, n_nationkey::BIGINT AS key FROM nation UNION ALL SELECT lower(n_name), 200+n_nationkey FROM nation WHERE n_nationkey%5=0 UNION ALL SELECT lower(n_name), n_nationkey FROM nation WHERE n_nationkey%3=0 UNION ALL SELECT lower(r_name), 100+r_regionkey FROM region),
ix AS (SELECT norm, min(key) AS key FROM names GROUP BY norm HAVING count(DISTINCT key)=1)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations and regions; some belong to two keys and are left out, some come twice for one key."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    keyed = n.select(F.col("n_name").alias("name"), F.explode(F.expr("filter(array(n_nationkey, if(n_nationkey % 5 = 0, 200 + n_nationkey, null), if(n_nationkey % 3 = 0, n_nationkey, null)), x -> x is not null)")).alias("key"))
    both = keyed.unionByName(r.select(F.col("r_name").alias("name"), (100 + F.col("r_regionkey")).alias("key"))).withColumn("key", F.col("key").cast("long"))
    return lookups.unique_index(both, F.lower("name"), "key")


@query(f"WITH {NAMES_SQL} SELECT * FROM ix")
def q_name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query(f"WITH {NAMES_SQL} SELECT c_custkey, ix.key AS found FROM customer JOIN nation ON n_nationkey=c_nationkey LEFT JOIN ix ON ix.norm=CASE WHEN c_custkey%4=0 THEN 'no such name' ELSE lower(n_name) END")
def q_exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    name = F.when(F.col("c_custkey") % 4 == 0, "no such name").otherwise(F.lower("n_name"))
    return lookups.exact(asked, name, _index(spark, sf_dir), "found").select("c_custkey", "found")


@query("""SELECT c_custkey, coalesce(n.n_name, r.r_name, 'unknown') AS place FROM customer LEFT JOIN nation n ON n.n_nationkey=c_nationkey AND c_custkey%3=0 LEFT JOIN region r ON r.r_regionkey=c_nationkey%7""")
def q_cascade_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    first = c.join(n, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("c_custkey") % 3 == 0), "left")
    both = first.join(r, F.col("r_regionkey") == F.col("c_nationkey") % 7, "left")
    return both.select("c_custkey", F.coalesce("n_name", "r_name", F.lit("unknown")).alias("place"))


NEAR = "CASE s_suppkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN lower(n_name) || 'x' WHEN 2 THEN substring(lower(n_name), 2) ELSE 'zz' || lower(n_name) END"


@query(f"""WITH q AS (SELECT s_suppkey, {NEAR} AS x FROM supplier JOIN nation ON s_nationkey=n_nationkey),
m AS (SELECT s_suppkey, min(n_nationkey) AS k FROM q JOIN nation ON length(x)>=5 AND length(n_name)>=5 AND levenshtein(x, lower(n_name))<=1 GROUP BY s_suppkey HAVING count(DISTINCT n_nationkey)=1)
SELECT s_suppkey, m.k::BIGINT AS found FROM q LEFT JOIN m USING (s_suppkey)""")
def q_fuzzy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    q = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey", f"{NEAR} AS x")
    index = lookups.unique_index(n, F.lower("n_name"), "n_nationkey")
    return lookups.fuzzy(q, F.col("x"), "s_suppkey", index, "found").select("s_suppkey", F.col("found").cast("long").alias("found"))


@query("""WITH t AS (SELECT o_orderkey, 'the '||lower(o_orderpriority)||' of '||lower(n_name)||' and '||lower(r_name)||' end' AS x, n_nationkey, r_regionkey, n_name, r_name FROM orders JOIN nation ON n_nationkey=o_custkey%25 JOIN region ON r_regionkey=n_regionkey)
SELECT o_orderkey AS "row", (2+len(string_split(lower(x),' ')) - 2 - len(string_split(substr(x, strpos(x,' of ')+4),' ')))::BIGINT AS at, len(string_split(n_name,' '))::BIGINT AS n, n_nationkey::BIGINT AS key FROM t
UNION ALL SELECT o_orderkey, (len(string_split(x,' '))-1-len(string_split(r_name,' ')))::BIGINT, len(string_split(r_name,' '))::BIGINT, (100+r_regionkey)::BIGINT FROM t""")
def q_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    t = table(spark, sf_dir, "orders").join(n, F.col("n_nationkey") == F.col("o_custkey") % 25).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    x = t.selectExpr("o_orderkey", "split('the ' || lower(o_orderpriority) || ' of ' || lower(n_name) || ' and ' || lower(r_name) || ' end', ' ') AS w")
    names = n.select(F.lower("n_name").alias("norm"), F.col("n_nationkey").cast("long").alias("key")).unionByName(r.select(F.lower("r_name").alias("norm"), (100 + F.col("r_regionkey")).cast("long").alias("key")))
    return lookups.mentions(x, "o_orderkey", F.col("w"), names)


@query("""WITH l AS (SELECT p_partkey AS a, p_partkey*2 AS b, p_brand||' ('||p_type||')' AS label FROM part WHERE p_size<=5),
h AS (SELECT p.p_partkey, l.label, p.p_brand=split_part(l.label,' ',1) AS hit FROM part p JOIN l ON p.p_partkey=l.a OR p.p_partkey=l.b)
SELECT p_partkey, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels, bool_or(hit) AS detected FROM h GROUP BY p_partkey""")
def q_legacy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    label = F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))
    legacy = p.where("p_size <= 5").select(F.explode(F.array("p_partkey", F.col("p_partkey") * 2)).alias("k"), label.alias("label"), F.col("p_brand").alias("b"))
    hits = p.join(legacy, F.col("p_partkey") == F.col("k"))
    return hits.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"), F.bool_or(F.col("p_brand") == F.col("b")).alias("detected"))


# Names of parts, damaged in one to four places, against the names that stand alone.
@query("""WITH n AS (SELECT DISTINCT lower(p_name) AS norm FROM part), t AS (SELECT p_partkey AS k, CASE p_partkey%5 WHEN 0 THEN replace(lower(p_name), 'a', 'e') WHEN 1 THEN substr(lower(p_name), 2) || 'x' WHEN 2 THEN lower(p_name) WHEN 3 THEN substr(lower(p_name), 1, 3) || substr(lower(p_name), 5) ELSE lower(p_name) || 'yz' END AS gram FROM part),
d AS (SELECT DISTINCT gram, len(string_split(gram, ' ')) AS tokens FROM t), m AS (SELECT gram, norm FROM d JOIN n ON len(string_split(norm, ' ')) = tokens AND length(norm) >= 5 AND length(gram) >= 3 AND levenshtein(gram, norm) <= CASE WHEN contains(norm, ' ') AND length(norm) >= 9 THEN 2 ELSE 1 END),
o AS (SELECT gram, min(norm) AS name FROM m GROUP BY gram HAVING count(DISTINCT norm) = 1) SELECT k AS p_partkey, name FROM t JOIN o USING (gram)""")
def q_near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.operators import fragments

    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("norm"))
    known = parts.select("norm").distinct().select("norm", F.col("norm").alias("key"), F.lit(False).alias("is_max"), F.size(F.split("norm", " ")).alias("tokens"))
    damaged = F.expr("CASE p_partkey % 5 WHEN 0 THEN replace(norm, 'a', 'e') WHEN 1 THEN substr(norm, 2) || 'x' WHEN 2 THEN norm WHEN 3 THEN substr(norm, 1, 3) || substr(norm, 5) ELSE norm || 'yz' END")
    held = parts.select(F.col("p_partkey").alias("row"), F.lit(0).alias("at"), damaged.alias("gram")).withColumn("tokens", F.size(F.split("gram", " ")))
    return fragments.near_names(held, known).select(F.col("row").alias("p_partkey"), F.col("key").alias("name"))
