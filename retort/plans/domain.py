"""Queries of the domain stages, the remaining joins and set operators, and the stream, on the driver's tables.

Routes are orders, steps are lineitems. Where a query needs chemistry, each step's reaction is picked from a list by its keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from retort.chem.columns import describe_molecules, reaction_fingerprint, reaction_sides
from retort.functions import parsing
from retort.functions.scores import reaction_similarity, tanimoto
from retort.ml.features import hash_features, sparse_parts
from retort.operators import fingerprints, queue, reshape, windows
from retort.plans.base import Plans
from retort.plans.scalars import url_reaction
from retort.session import cut_lineage, ensure_checkpoint_dir
from retort.sources.tables import table
from retort.stages import context, derivation, mapping
from retort.streaming import events as streams

plans = Plans()
query = plans.query

REACTIONS = ("CCO>O.25.3600>CC=O", "CC(=O)Cl.NCC>>CC(=O)NCC", "CC=O>>CCO", "c1ccccc1Br.OB(O)c1ccccc1>>c1ccc(cc1)c1ccccc1", "CCO>>>>CC=O", "CCBr.N>>CCN", "C C O>>CC=O")
MOLECULES = ("CCO", "c1ccccc1", "CC(=O)O", "[Na+]", "C1CCOC1", "[Pd]", "CC(", "CN(C)C=O", "ClCCl")


def _pick(values: tuple[str, ...], key) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def reaction_steps(spark, sf):
    """Steps with labels: even lines leave an intermediate that the next line takes up."""
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").dropDuplicates(["l_orderkey", "l_linenumber"])
    entering = F.when(line % 2 == 1, F.concat(F.lit("M"), line.cast("string")))
    text = F.when(line % 2 == 1, F.concat(F.lit("M"), line.cast("string"), F.lit(".N>>CCN"))).otherwise(_pick(REACTIONS[:3], order))
    return rows.select(
        order.cast("string").alias("route_id"), F.format_string("%d::%03d", order, line).alias("step_id"), line.alias("step_index"), F.lit(None).cast("string").alias("canonical_reaction_smiles"), text.alias("reaction_smiles"),
        entering.alias("input_intermediate"), F.when(line % 2 == 0, F.concat(F.lit("M"), (line + 1).cast("string"))).alias("output_intermediate"), (line % 2 == 0).alias("parse_ok"),
    )


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem), p AS (SELECT o, n, lag(n) OVER (PARTITION BY o ORDER BY n) AS before FROM s)
SELECT CASE WHEN n % 2 = 0 THEN 'not_required' WHEN before = n - 1 THEN 'resolved' ELSE 'unresolved' END AS resolution_status, count(*) AS rows FROM p GROUP BY 1
""")
def symbolic_resolution_fold(spark, sf):
    return context.resolve_routes(reaction_steps(spark, sf)).groupBy("resolution_status").agg(F.count("*").alias("rows"))


@query("""
WITH k AS (SELECT (l_partkey % 7)::INT AS k FROM lineitem)
SELECT CASE k WHEN 4 THEN 'malformed_delimiter' WHEN 6 THEN 'invalid_reactant' ELSE 'valid' END AS parse_class, count(*) AS rows FROM k GROUP BY 1
""")
def reaction_parse_classes(spark, sf):
    rows = table(spark, sf, "lineitem").select(_pick(REACTIONS, F.col("l_partkey")).alias("r"))
    parsed = rows.select("r").distinct().withColumn("p", reaction_sides("r"))
    return rows.join(F.broadcast(parsed), "r").groupBy(F.col("p.parse_class").alias("parse_class")).agg(F.count("*").alias("rows"))


@query()
def repair_candidates_ranked(spark, sf):
    """Repairs of pages' addresses read as reactions with too many arrows."""
    rows = table(spark, sf, "pages").select("page_id", F.replace(url_reaction(F.col("url")), F.lit(">"), F.lit(">>")).alias("r"))
    repairs = F.pandas_udf(context._repairs, f"array<struct<{context._nested(context.REPAIR)}>>")
    return rows.withColumn("c", repairs("r", F.lit(None).cast("string"), F.lit(1.0))).select("page_id", F.posexplode("c").alias("rank", "x")).select("page_id", (F.col("rank") + 1).alias("rank"), "x.repair_type", "x.rank_score", "x.accepted")


@query("""SELECT 8::BIGINT AS molecules, 1::BIGINT AS invalid, 2::BIGINT AS aromatic_or_ring""")
def molecule_catalogue(spark, sf):
    steps = table(spark, sf, "part").select(F.array(_pick(MOLECULES, F.col("p_partkey"))).alias("m"))
    described = describe_molecules(reshape.distinct_catalogue(steps, ["m"]))
    return described.agg(F.count_if("info.valid").alias("molecules"), F.count_if(~F.col("info.valid")).alias("invalid"), F.count_if(F.col("info.rings") > 0).alias("aromatic_or_ring"))


@query()
def mapped_reaction_families(spark, sf):
    rows = table(spark, sf, "orders", deal=True).select(F.lit("v").alias("dataset_version"), F.col("o_orderkey").cast("string").alias("step_id"), F.col("o_custkey").cast("string").alias("route_id"), _pick(REACTIONS[:4], F.col("o_orderkey")).alias("r"))
    candidates = rows.select("dataset_version", "step_id", "route_id", F.regexp_replace("r", ">[^>]+>", ">>").alias("reaction_smiles"), F.lit("eligible").alias("eligibility_status"), F.lit("pending").alias("mapping_status"))
    derived = derivation.derive(mapping.map_candidates(candidates))
    return derivation.tables(derived).reaction_families.groupBy("reaction_family", "family_cluster_id").agg(F.count("*").alias("rows"))


@query()
def reaction_similarity_topk(spark, sf):
    """Parts with a reaction each; those with the same reaction are one kind of the search."""
    rows = table(spark, sf, "part").select("p_partkey", F.concat(_pick(MOLECULES[:6], F.col("p_partkey")), F.lit(">>"), _pick(MOLECULES[:5], F.col("p_size"))).alias("r"))
    prints = cut_lineage(rows.select("r").distinct()).withColumn("f", reaction_fingerprint("r"))  # else the filter goes below, with prints of all rows
    kinds = cut_lineage(prints.where("f.reactant is not null").select("r", F.col("f.reactant").alias("reactant"), F.col("f.product").alias("product")))
    queries = rows.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), "r")
    score = F.round(reaction_similarity(tanimoto(F.col("q_reactant"), F.col("reactant")), tanimoto(F.col("q_product"), F.col("product"))), 6)
    return fingerprints.search_kinds(rows, queries, kinds, "r", score, "query_id", "p_partkey", 5)


@query()
def char_ngram_hash_features(spark, sf):
    """Whole texts in the production number of bins; rows are digests of their sparse vectors."""
    hashed = hash_features(table(spark, sf, "documents", deal=True).select("doc_id", "text"), "text")
    parts = hashed.select("doc_id", sparse_parts("features").alias("v"))
    return parts.select("doc_id", F.size("v.indices").alias("bins"), F.xxhash64("v.indices").alias("bins_hash"), F.round(F.aggregate("v.values", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query("""
SELECT c.c_mktsegment, o.o_orderpriority, count(*) AS steps, sum(CAST(l.l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2
""")
def three_way_assignment_join(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return lines.join(orders, "l_orderkey").join(customers, "c_custkey").groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("steps"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""
SELECT coalesce(a.k, b.k) AS key, a.n AS left_rows, b.n AS right_rows, a.k IS NULL OR b.k IS NULL AS one_sided FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.k = b.k
""")
def key_set_compare(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("key")).agg(F.count("*").alias("left_rows"))
    b = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("right_rows"))
    return a.join(b, "key", "full_outer").withColumn("one_sided", F.col("left_rows").isNull() | F.col("right_rows").isNull())


@query("""SELECT 'part' AS source, p_brand AS label, count(*) AS rows FROM part GROUP BY 2 UNION ALL SELECT 'customer', c_mktsegment, count(*) FROM customer GROUP BY 2""")
def union_of_parts(spark, sf):
    a = table(spark, sf, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("rows")).select(F.lit("part").alias("source"), "label", "rows")
    return a.unionByName(table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("rows")).select(F.lit("customer").alias("source"), "label", "rows"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 700 ORDER BY o_orderkey LIMIT 40""")
def keyset_resume_page(spark, sf):
    return windows.search(table(spark, sf, "orders"), F.col("o_orderstatus") == "F", ["o_orderkey"], 40, after=F.col("o_orderkey") > 700).select("o_orderkey")


@query("""
SELECT '[' || coalesce(string_agg(r, ', ' ORDER BY r), '') || ']' AS missing FROM (SELECT unnest(['click', 'view', 'refund', 'purchase', 'audit']) AS r) WHERE r NOT IN (SELECT event_type FROM events)
""")
def required_minus_satisfied(spark, sf):
    found = table(spark, sf, "events").agg(F.collect_set("event_type").alias("s"))
    required = F.array(*[F.lit(x) for x in ("click", "view", "refund", "purchase", "audit")])
    return found.select(F.concat(F.lit("["), F.array_join(F.sort_array(F.array_except(required, F.col("s"))), ", "), F.lit("]")).alias("missing"))


@query("""
SELECT formed, broken, changed, count(*) AS rows FROM (SELECT CASE k WHEN 0 THEN '1-2' ELSE '' END AS formed, CASE k WHEN 1 THEN '2-3' ELSE '' END AS broken, CASE k WHEN 2 THEN '2-3' ELSE '' END AS changed FROM (SELECT o_orderkey % 4 AS k FROM orders)) GROUP BY ALL
""")
def bond_order_difference(spark, sf):
    k = F.col("o_orderkey") % 4
    before = F.when(k == 0, F.create_map(F.lit("2-3"), F.lit(1.0))).otherwise(F.create_map(F.lit("1-2"), F.lit(1.0), F.lit("2-3"), F.lit(1.0)))
    after = F.when(k == 1, F.create_map(F.lit("1-2"), F.lit(1.0))).when(k == 2, F.create_map(F.lit("1-2"), F.lit(1.0), F.lit("2-3"), F.lit(2.0))).otherwise(F.create_map(F.lit("1-2"), F.lit(1.0), F.lit("2-3"), F.lit(1.0)))
    rows = table(spark, sf, "orders").select(reshape.bond_difference(before, after).alias("d"))
    return rows.groupBy(*[F.array_join(f"d.{n}", ",").alias(n) for n in ("formed", "broken", "changed")]).agg(F.count("*").alias("rows"))


@query("""
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'mapped' ELSE o_orderstatus END AS status, count(*) AS rows, sum(CASE WHEN o_orderkey % 6 = 0 THEN 9 ELSE (o_orderkey % 4)::INT END)::BIGINT AS attempts FROM orders GROUP BY 1
""")
def queue_merge_results(spark, sf):
    state = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"))
    results = state.where("item_id % 3 = 0").select("item_id", F.lit("mapped").alias("status"), F.when(F.col("item_id") % 6 == 0, 9).alias("attempts"))
    return queue.merge_results(state, results).groupBy("status").agg(F.count("*").alias("rows"), F.sum("attempts").alias("attempts"))


@query("""SELECT substr(patent, 1, 4) AS office, count(DISTINCT patent) AS patents, count(*) AS routes FROM (SELECT 'US' || CAST(o_custkey AS VARCHAR) || 'A1' AS patent FROM orders) GROUP BY 1""")
def distinct_patents(spark, sf):
    route = F.concat(F.lit("US"), F.col("o_custkey").cast("string"), F.lit("A1-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    rows = table(spark, sf, "orders").select(parsing.patent_document_id(route).alias("patent"))
    return rows.groupBy(F.substring("patent", 1, 4).alias("office")).agg(F.countDistinct("patent").alias("patents"), F.count("*").alias("routes"))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS rows FROM events GROUP BY 1, 2""")
def stream_tumbling_counts(spark, sf):
    """The windowed count as a stream over the file, run until it has seen everything."""
    path = f"{sf}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    counted = streams.tumbling_counts(source)
    ensure_checkpoint_dir(spark)
    running = counted.writeStream.format("memory").queryName("retort_tumbling").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table("retort_tumbling").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "rows")
