"""Queries of retrieval, metrics, calibration, promotion and the work queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from retort.functions.scores import cosine
from retort.ml import promotion
from retort.ml.calibration import scaled
from retort.operators import aggregates, fingerprints, queue, windows
from retort.plans.base import Plans
from retort.sources.tables import table

plans = Plans()
query = plans.query


def _queries(vectors):
    """The query set of the searches: every row whose id is divisible by 20, against all rows."""
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))


NEIGHBOURS_SQL = """
SELECT query_id, vec_id, label, query_label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (
 SELECT q.vec_id AS query_id, v.vec_id, v.label, q.label AS query_label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
 FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 10
"""


@query(f"SELECT query_id, vec_id, score, rank FROM ({NEIGHBOURS_SQL})")
def cosine_topk(spark, sf):
    vectors = table(spark, sf, "embeddings", deal=True)
    return fingerprints.cosine_search(vectors, _queries(vectors), "query_id", "vec_id", "query_vector", "embedding", 10)


@query("""
WITH b AS (SELECT vec_id, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END), '')::BIT AS bits FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, round(CASE WHEN bit_count(q.bits | v.bits) > 0 THEN bit_count(q.bits & v.bits)::DOUBLE / bit_count(q.bits | v.bits) ELSE 0 END, 6) AS score FROM b q JOIN b v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 10
""")
def tanimoto_topk(spark, sf):
    words = table(spark, sf, "embeddings", deal=True).select("vec_id", fingerprints.sign_words(F.col("embedding")).alias("words"))
    queries = words.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("words").alias("query_words"))
    return fingerprints.tanimoto_search(words, queries, "query_id", "vec_id", "query_words", "words", 10)


def _neighbours(spark, sf):
    vectors = table(spark, sf, "embeddings", deal=True)
    found = fingerprints.cosine_search(vectors, _queries(vectors), "query_id", "vec_id", "query_vector", "embedding", 10)
    labels = vectors.select("vec_id", "label")
    return found.join(labels, "vec_id").join(_queries(vectors).select("query_id", "query_label"), "query_id")


@query(f"""
WITH e AS (SELECT query_id, label, greatest(score, 0.000001) AS w FROM ({NEIGHBOURS_SQL})), s AS (SELECT query_id, label, sum(w) AS w FROM e GROUP BY 1, 2)
SELECT query_id, label, round(w / sum(w) OVER (PARTITION BY query_id), 5) AS share FROM s
""")
def neighbour_label_distribution(spark, sf):
    return aggregates.neighbour_distribution(_neighbours(spark, sf), "query_id", "label", "score").select("query_id", "label", F.round("share", 5).alias("share"))


@query(f"""
SELECT count(*) AS queries, round(avg(hit), 6) AS family_recall, round(avg(best), 5) AS mean_best FROM (SELECT query_id, max(CASE WHEN label = query_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit, max(score) AS best FROM ({NEIGHBOURS_SQL}) GROUP BY 1)
""")
def retrieval_benchmark(spark, sf):
    each = _neighbours(spark, sf).groupBy("query_id").agg(F.max((F.col("label") == F.col("query_label")).cast("double")).alias("hit"), F.max("score").alias("best"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 6).alias("family_recall"), F.round(F.avg("best"), 5).alias("mean_best"))


@query("""
WITH x AS (SELECT label, i, avg(v::DOUBLE) AS m, count(*) AS n FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2)
SELECT label, max(n) AS n, round(sqrt(sum(m * m)), 5) AS mean_norm, round(max(m) / sqrt(sum(m * m)), 5) AS top FROM x GROUP BY 1
""")
def route_embedding_mean(spark, sf):
    vectors = table(spark, sf, "embeddings")
    plain, unit = aggregates.mean_vectors(vectors, "label", "embedding", False), aggregates.mean_vectors(vectors, "label", "embedding")
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return plain.select("label", "n", F.round(size, 5).alias("mean_norm")).join(unit.select("label", F.round(F.array_max("vector"), 5).alias("top")), "label")


SCORED_SQL = "SELECT doc_id, toxic AS truth, (doc_id % 97) / 97.0::DOUBLE AS p, quality FROM labels"


def _scored(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("truth"), ((F.col("doc_id") % 97) / 97.0).alias("p"), "quality")


@query(f"""
WITH s AS (SELECT truth AS t, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS q FROM ({SCORED_SQL})), l AS (SELECT unnest([0, 1]) AS label),
c AS (SELECT label, count(*) FILTER (WHERE t = label) AS ist, count(*) FILTER (WHERE q = label) AS said, count(*) FILTER (WHERE t = label AND q = label) AS hit FROM s, l GROUP BY 1)
SELECT sum(ist)::BIGINT AS rows, round(sum(hit) / sum(ist), 6) AS accuracy, round(avg(CASE WHEN ist > 0 THEN hit / ist END), 6) AS balanced_accuracy, round(avg(2 * hit / (ist + said)), 6) AS macro_f1,
       round(sum(2 * hit / (ist + said) * ist) / sum(ist), 6) AS weighted_f1, round(max(ist) / sum(ist), 6) AS majority_accuracy FROM c
""")
def classification_metrics(spark, sf):
    scored = _scored(spark, sf).withColumn("said", F.when(F.col("p") >= 0.5, 1).otherwise(0))
    found = aggregates.classification_metrics(scored, "truth", "said")
    return found.select("rows", *[F.round(c, 6).alias(c) for c in found.columns if c != "rows"])


@query(f"""
SELECT least(CAST(floor(c * 15) AS INT), 14) AS bin, count(*) AS rows, round(avg(CASE WHEN (p >= 0.5) = (truth = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, round(avg(c), 6) AS confidence
FROM (SELECT *, greatest(p, 1 - p) AS c FROM ({SCORED_SQL})) GROUP BY 1
""")
def ece_reliability_bins(spark, sf):
    scored = _scored(spark, sf).withColumn("c", F.greatest("p", 1 - F.col("p")))
    found = aggregates.reliability_bins(scored, "c", (F.col("p") >= 0.5) == (F.col("truth") == 1))
    return found.select("bin", "rows", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"))


@query(f"""
SELECT count(*) AS rows, round(avg((p - truth) * (p - truth)), 6) AS brier, round(avg(-(truth * ln(q) + (1 - truth) * ln(1 - q))), 5) AS log_loss FROM (SELECT *, least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM ({SCORED_SQL}))
""")
def brier_logloss(spark, sf):
    found = aggregates.brier_and_log_loss(_scored(spark, sf), "p", "truth")
    return found.select("rows", F.round("brier", 6).alias("brier"), F.round("log_loss", 5).alias("log_loss"))


@query("""
WITH d AS (SELECT doc_id, list_distinct([lang, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE 'fr' END]) AS t, [CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'de' END] AS p FROM documents),
m AS (SELECT sum(len(list_intersect(t, p))) AS tp, sum(len(p)) AS said, sum(len(t)) AS are FROM d),
l AS (SELECT unnest(['en', 'fr', 'de', 'es']) AS label), e AS (SELECT label, count(*) FILTER (WHERE list_contains(t, label) AND list_contains(p, label)) AS tp, count(*) FILTER (WHERE list_contains(t, label)) AS are, count(*) FILTER (WHERE list_contains(p, label)) AS said FROM d, l GROUP BY 1)
SELECT (SELECT count(*) FROM e WHERE are + said > 0) AS labels, round(tp / said, 6) AS micro_precision, round(tp / are, 6) AS micro_recall, round(2 * tp / (said + are), 6) AS micro_f1, round((SELECT avg(2 * tp / (are + said)) FROM e WHERE are + said > 0), 6) AS macro_f1 FROM m
""")
def multilabel_metrics(spark, sf):
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        F.array_distinct(F.array("lang", F.when(d % 3 == 0, "en").otherwise("fr"))).alias("t"), F.array(F.when(d % 2 == 0, "en").otherwise("de")).alias("p")
    )
    found = aggregates.multilabel_metrics(rows, "t", "p")
    return found.select("labels", *[F.round(c, 6).alias(c) for c in found.columns if c != "labels"])


@query("""
SELECT count(*) AS rows, round(avg(abs(y - p)), 5) AS mae, round(quantile_cont(abs(y - p), 0.5), 5) AS median_ae, round(1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 5) AS r2,
       round(avg(CASE WHEN y BETWEEN p - 8 AND p + 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS coverage, round(avg(16.0::DOUBLE), 6) AS mean_width
FROM (SELECT l_quantity AS y, (l_partkey % 50 + l_quantity) / 2 AS p FROM lineitem)
""")
def regression_interval_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"), ((F.col("l_partkey") % 50 + F.col("l_quantity")) / 2).alias("p"))
    rows = rows.withColumn("low", F.col("p") - 8).withColumn("high", F.col("p") + 8)
    found = aggregates.regression_metrics(rows, "y", "p", "low", "high")
    return found.select("rows", *[F.round(c, 6 if c in ("coverage", "mean_width") else 5).alias(c) for c in found.columns if c != "rows"])


@query("""
WITH b AS (SELECT '__global__' AS family, l_quantity - l_partkey % 50 AS r FROM lineitem UNION ALL SELECT l_returnflag, l_quantity - l_partkey % 50 FROM lineitem)
SELECT family, count(*) AS rows, round(quantile_cont(r, 0.1), 6) AS low, round(quantile_cont(r, 0.9), 6) AS high FROM b GROUP BY 1 HAVING count(*) >= 30 OR family = '__global__'
""")
def residual_interval_quantiles(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("family"), (F.col("l_quantity") - F.col("l_partkey") % 50).alias("r"))
    found = aggregates.residual_intervals(rows, "family", "r")
    return found.select("family", "rows", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""
WITH g AS (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS t), s AS (SELECT truth, least(greatest(p, 1e-12), 1.0) AS a, least(greatest(1 - p, 1e-12), 1.0) AS b FROM ({SCORED_SQL}))
SELECT t AS temperature, round(avg(-ln(greatest(CASE WHEN truth = 1 THEN pow(a, 1 / t) ELSE pow(b, 1 / t) END / (pow(a, 1 / t) + pow(b, 1 / t)), 1e-12))), 5) AS log_loss FROM s, g GROUP BY 1
""")
def temperature_scaling_grid(spark, sf):
    scored = _scored(spark, sf).select("truth", F.array(1 - F.col("p"), F.col("p")).alias("probabilities"))
    tried = scored.select("truth", "probabilities", F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 2.0, 4.0)])).alias("temperature"))
    p = F.get(scaled(F.col("probabilities"), F.col("temperature")), F.col("truth"))
    return tried.groupBy("temperature").agg(F.round(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))), 5).alias("log_loss"))


@query("""
SELECT task, approved, final_stage, n_reasons FROM (VALUES ('parse_validity', true, 'production', 0), ('primary_solvent', false, 'candidate', 3), ('time_bucket', false, 'experimental', 1), ('other_task', true, 'validated', 0)) AS t(task, approved, final_stage, n_reasons)
""")
def promotion_gate(spark, sf):
    rows = [("parse_validity", 1000, 0.95, 0.95, 0.97, 0.6, 0.01), ("primary_solvent", 1000, 0.25, 0.28, 0.29, 0.39, 0.08), ("time_bucket", 400, 0.5, 0.5, 0.6, 0.5, 0.05), ("other_task", 900, 0.7, 0.7, 0.8, 0.5, None)]
    metrics = spark.createDataFrame(rows, "task string, rows long, macro_f1 double, balanced_accuracy double, accuracy double, majority_accuracy double, calibration double")
    return promotion.decide(metrics, promotion.rules(spark)).select("task", "approved", "final_stage", F.size("reasons").alias("n_reasons"))


QUEUE_SQL = "SELECT o_orderkey AS item_id, CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'mapped' ELSE 'quarantined' END AS status, (o_orderkey % 4)::INT AS attempts, o_orderdate AS started FROM orders"


def _queue(spark, sf):
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "pending").when(k % 5 == 1, "running").when(k % 5 == 2, "failed").when(k % 5 == 3, "mapped").otherwise("quarantined")
    return table(spark, sf, "orders").select(k.alias("item_id"), status.alias("status"), (k % 4).cast("int").alias("attempts"), F.col("o_orderdate").alias("started"))


@query(f"SELECT item_id, 'running' AS status, attempts + 1 AS attempts FROM ({QUEUE_SQL}) WHERE status = 'pending' OR (status = 'failed' AND attempts < 3) ORDER BY item_id LIMIT 64")
def queue_claim_next_n(spark, sf):
    return queue.claim(_queue(spark, sf), 64, most_attempts=3).select("item_id", "status", "attempts")


@query(f"SELECT CASE WHEN status = 'running' AND started < TIMESTAMP '1997-01-01' THEN 'pending' ELSE status END AS status, count(*) AS rows FROM ({QUEUE_SQL}) GROUP BY 1")
def queue_stale_recovery(spark, sf):
    recovered = queue.recover_stale(_queue(spark, sf), F.lit("1997-01-01").cast("timestamp_ntz"))
    return recovered.groupBy("status").agg(F.count("*").alias("rows"))


@query("""
SELECT label, round(avg(s), 5) AS mean_similarity, count(*) AS rows FROM (SELECT a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY 1
""")
def adjacent_vector_similarity(spark, sf):
    vectors = table(spark, sf, "embeddings", deal=True)
    nxt = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    joined = vectors.join(nxt, "vec_id").select("label", cosine(F.col("embedding"), F.col("other")).alias("s"))
    return joined.groupBy("label").agg(F.round(F.avg("s"), 5).alias("mean_similarity"), F.count("*").alias("rows"))


@query("""
SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part) WHERE rank <= 5
""")
def class_top_five(spark, sf):
    return windows.top_k(table(spark, sf, "part"), "p_brand", F.col("p_retailprice"), ["p_partkey"], 5).select("p_brand", "p_partkey", "p_retailprice", "rank")
