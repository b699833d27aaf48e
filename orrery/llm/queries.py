"""The operators' queries over the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import clustering, langid, lexical, media, mixing, neighbours, packing, pages, pii, secrets, simhash, substrings, urls

#: The rules of the URL query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def _count(column: str, kind: str | int):
    return F.size(F.filter(column, lambda x: x["kind"] == F.lit(kind))).cast("long")


def _listed(column: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.spans(_table(spark, sf_dir, "documents"))
    counts = [_count("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(_table(spark, sf_dir, "documents"))
    counts = [_count("base", i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "verdict string, host string, path string"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.probe(media.stored(_table(spark, sf_dir, "documents"))).drop("offsets", "seconds")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    marked = langid.predict(docs, model)
    return marked.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_secrets, op4_packing, op5_pii, op6_neighbours, op7_urls, op8_media, op9_language, op10_substrings, op11_pages, op12_lexical, op13_clustering)}

def _clustering_sql(rounds: int = 10) -> str:
    """Lloyd's rounds one after another, over components as rows."""
    parts = [
        "v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, list_transform(embedding, lambda x: floor(1024*x::DOUBLE)::BIGINT) AS p FROM embeddings WHERE len(embedding)=64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))=64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:'||coalesce(vec_id::VARCHAR,'')), p)-1 AS c, p FROM v QUALIFY c < 8)",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, list_sum(list_transform(list_zip(v.p, k.p), lambda z: (z[1]-z[2])*(z[1]-z[2])))::BIGINT AS d FROM v, c{i} k) GROUP BY r)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.p) AS x, unnest(range(64)) AS j FROM v JOIN a{i} a USING (r)) GROUP BY c, j)")
            parts.append(f"m{i} AS (SELECT c, list(((s-((s%n)+n)%n)//n)::BIGINT ORDER BY j) AS p FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS (SELECT c, coalesce(m.p, k.p) AS p FROM c{i} k LEFT JOIN m{i} m USING (c))")
    out = f"SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.p, ',')) AS centroid_sha256 FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} k ON k.c = a.c"
    return "WITH " + ",\n".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in parts) + "\n" + out


ORACLES: dict[str, str] = {
    # The given pages declare an article each and use few kinds of references; on others the operator does more than this.
    "op11_pages": r"""
WITH b AS (SELECT page_id, url, regexp_split_to_array(coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ''), '</?(?:p|h1)>') AS ts FROM pages),
n AS (SELECT page_id, url, array_to_string(list_filter(list_transform(ts, lambda t: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(t, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda t: t<>''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM n""",
    "op13_clustering": _clustering_sql(),
    "op12_lexical": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*)::BIGINT AS nn, sum(len(ts))::BIGINT AS ll FROM d WHERE len(ts)>0),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
qt AS (SELECT i, unnest(ts) AS t FROM q), words AS (SELECT DISTINCT t FROM qt),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM d) JOIN words USING (t) GROUP BY r, t),
w AS (SELECT t, floor(1000*ln((2*(SELECT nn FROM s)+2)::DOUBLE/(2*count(*)+1)::DOUBLE))::BIGINT AS w FROM p GROUP BY t),
x AS (SELECT qt.i, p.r, sum(w.w*((1000000000*p.tf)//(1000*p.tf+8*(100-90+((90*len(d.ts)*(SELECT nn FROM s))//(SELECT ll FROM s))))))::BIGINT AS score
      FROM qt JOIN p USING (t) JOIN w USING (t) JOIN d USING (r) GROUP BY qt.i, p.r),
k AS (SELECT x.i, d.doc_id, x.score, row_number() OVER (PARTITION BY x.i ORDER BY x.score DESC, d.doc_id NULLS LAST) AS rank FROM x JOIN d USING (r) WHERE score>0)
SELECT q.item_id, k.rank::INT AS rank, k.doc_id, k.score FROM k JOIN q USING (i) WHERE k.rank<=10""",
    "op7_urls": r"""
WITH rules(verdict, rh, rp) AS (VALUES ('allow','org','/'),('block','example.org','/es/'),('block','example.org','/en/1'),('allow','com','/fr/'),('block','com','/de/')),
p AS (SELECT page_id, CASE WHEN strpos(url,'://')>0 THEN substr(url, strpos(url,'://')+3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest,'^([^/?#]*)',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest,'^[^/?#]*([^?#]*)',1) AS path, row_number() OVER () AS rid FROM p),
m AS (SELECT rid, arg_max(rh||rp, length(rh||rp)*1000+length(rh)) AS rule, arg_max(r.verdict, length(rh||rp)*1000+length(rh)) AS verdict
      FROM q JOIN rules r ON (host = rh OR ends_with(host, '.'||rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, m.rule, coalesce(m.verdict,'allow') AS verdict FROM q LEFT JOIN m USING (rid)""",
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')),0)::BIGINT AS size, md5('mix-1:'||coalesce(doc_id::VARCHAR,'-')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE WHEN source_size>0 THEN [5,2,1][((row_number() OVER (ORDER BY source NULLS LAST)-1)%3+1)::INT] ELSE 0 END::BIGINT AS weight, source_size*2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER before,0.0) AS capped, sum(weight) OVER ()-coalesce(sum(weight) OVER before,0) AS wl, sum(source_size) OVER ()*1.5::DOUBLE AS wanted
      FROM w WINDOW before AS (ORDER BY weight=0, cap/nullif(weight,0), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CASE WHEN weight>0 THEN ((wanted-capped)/wl)::DOUBLE END AS level FROM l),
t AS (SELECT *, (SELECT arg_min(level, cap/weight) FROM v WHERE weight>0 AND level*weight<=cap) AS rest FROM v),
u AS (SELECT source, source_size, CASE WHEN weight=0 THEN 0.0 ELSE least(cap, coalesce(rest*weight, cap)) END::DOUBLE AS target FROM t),
x AS (SELECT d.doc_id, d.size, u.source_size, u.target, CASE WHEN u.source_size>0 THEN floor(u.target/u.source_size) ELSE 0 END::BIGINT AS epochs,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size ROWS UNBOUNDED PRECEDING) AS e FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (epochs*size + greatest(0, least(size, floor(target-epochs*source_size)::BIGINT-(e-size))))::BIGINT AS taken FROM x""",
}
