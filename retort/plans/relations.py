"""Queries of the identity, join, aggregation, window and reshaping operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from retort.functions import parsing
from retort.operators import aggregates, identity, reshape, windows
from retort.operators.components import connected_components, sharing, stars
from retort.operators.packing import pack_components
from retort.plans.base import Plans
from retort.sources.tables import table

plans = Plans()
query = plans.query

LINE_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINE_SQL = ", ".join(LINE_ORDER)


@query(f"""
SELECT step_id, count(*) AS rows FROM (
 SELECT CASE WHEN n = 1 THEN k WHEN m = 1 THEN k || '::v' || h ELSE k || '::v' || h || '::' || CAST(m AS VARCHAR) END AS step_id FROM (
  SELECT k, h, row_number() OVER (PARTITION BY k ORDER BY {LINE_SQL}) AS n, row_number() OVER (PARTITION BY k, h ORDER BY {LINE_SQL}) AS m FROM (
   SELECT *, CAST(l_orderkey AS VARCHAR) || '::' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS k, substr(sha256(CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)), 1, 8) AS h FROM lineitem))) GROUP BY 1
""")
def step_key_conflict_suffix(spark, sf):
    key = F.format_string("%d::%03d", "l_orderkey", "l_linenumber")
    content = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return identity.suffix_repeated_keys(table(spark, sf, "lineitem"), key, content, [F.col(c) for c in LINE_ORDER]).groupBy("step_id").agg(F.count("*").alias("rows"))


@query(f"""
SELECT l_orderkey, l_linenumber, h AS content, CASE WHEN n = 1 THEN 'first' WHEN h = f THEN 'exact_duplicate' ELSE 'conflict' END AS content_status FROM (
 SELECT l_orderkey, l_linenumber, h, first_value(h) OVER w AS f, row_number() OVER w AS n FROM (
  SELECT *, sha256(CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)) AS h FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_SQL}))
""")
def first_seen_content_dedup(spark, sf):
    steps = table(spark, sf, "lineitem").withColumn("step", F.format_string("%d::%03d", "l_orderkey", "l_linenumber"))
    content = F.sha2(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), 256)
    found = identity.first_seen(steps, "step", content, [F.col(c) for c in LINE_ORDER])
    return found.select("l_orderkey", "l_linenumber", content.alias("content"), "content_status")


@query("""
SELECT o_custkey, o_orderkey, n AS instance_no, CASE WHEN n = 1 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) || '::instance::' || lpad(CAST(n AS VARCHAR), 3, '0') END AS route_instance_id
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS n FROM orders)
""")
def route_instance_numbering(spark, sf):
    return identity.number_instances(table(spark, sf, "orders"), "o_custkey", [F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "instance_no", "route_instance_id")


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, 'unique_source_route' AS method FROM lineitem l
JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1) u ON l.l_orderkey = u.l_orderkey
""")
def unique_key_bulk_assignment(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(identity.unique_keys(lines, "l_orderkey"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("unique_source_route").alias("method"))


@query("""SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def duplicate_group_listing(spark, sf):
    return identity.repeated_keys(table(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey")


@query("""
WITH a AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_extendedprice, l_shipdate) AS n FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_extendedprice, l_shipdate) AS n FROM lineitem WHERE l_returnflag <> 'A')
SELECT a.l_orderkey, a.l_partkey, a.l_linenumber AS left_line, b.l_linenumber AS right_line FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.n = b.n
""")
def priority_one_to_one_match(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_returnflag")
    order = [F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_shipdate")]
    left = lines.where("l_returnflag = 'A'").withColumnRenamed("l_linenumber", "left_line")
    right = lines.where("l_returnflag <> 'A'").withColumnRenamed("l_linenumber", "right_line")
    left_order, right_order = [F.col("left_line"), *order[1:]], [F.col("right_line"), *order[1:]]
    pairs = identity.rank_pairs(left, right.drop("l_returnflag").withColumnRenamed("l_extendedprice", "_p").withColumnRenamed("l_shipdate", "_d"), ["l_orderkey", "l_partkey"], left_order, [right_order[0], F.col("_p"), F.col("_d")])
    return pairs.select("l_orderkey", "l_partkey", "left_line", "right_line")


@query("""SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def unassigned_anti_join(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 5)""")
def duplicate_semi_join(spark, sf):
    many = identity.repeated_keys(table(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey").where("rows > 5")
    return table(spark, sf, "orders").join(many.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("""
WITH agg AS (SELECT l_orderkey, count(*) AS steps, count(*) FILTER (WHERE l_returnflag = 'R') AS mapped, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus, coalesce(steps, 0) AS steps, coalesce(mapped, 0) AS mapped, total FROM orders LEFT JOIN agg ON o_orderkey = l_orderkey
""")
def enriched_final_view(spark, sf):
    per = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("steps"), F.count_if(F.col("l_returnflag") == "R").alias("mapped"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total")
    )
    zero = F.lit(0).cast("long")
    return table(spark, sf, "orders").join(per, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("steps", zero).alias("steps"), F.coalesce("mapped", zero).alias("mapped"), "total")


@query("""
SELECT o_orderkey, count(l_orderkey) AS n_steps, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS steps
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")
def route_nested_document(spark, sf):
    steps = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("steps"))
    joined = table(spark, sf, "orders").select("o_orderkey").join(steps, "o_orderkey", "left")
    shown = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), s["l_partkey"].cast("string"))), ",")
    return joined.select("o_orderkey", F.coalesce(F.size("steps").cast("long"), F.lit(0).cast("long")).alias("n_steps"), F.coalesce(shown, F.lit("")).alias("steps"))


@query("""
SELECT conv_id, turn, prev_turn, role, prev_role, CASE WHEN role = prev_role THEN 'same_role' ELSE 'alternates' END AS edge_status FROM (
 SELECT conv_id, turn, role, lag(turn) OVER w AS prev_turn, lag(role) OVER w AS prev_role, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)) WHERE n > 1
""")
def adjacent_edges_lag(spark, sf):
    edges = windows.adjacent_edges(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn", "role"], ["turn", "role"])
    return edges.select("conv_id", "turn", "prev_turn", "role", "prev_role", F.when(F.col("role") == F.col("prev_role"), "same_role").otherwise("alternates").alias("edge_status"))


@query("""
WITH edges AS (SELECT conv_id, turn AS target, turn - 1 AS source FROM conversations WHERE turn > 0)
SELECT count(*) AS edges, count(*) FILTER (WHERE s.conv_id IS NULL) AS missing_source, count(*) FILTER (WHERE s.role = t.role) AS same_role
FROM edges e JOIN conversations t ON t.conv_id = e.conv_id AND t.turn = e.target LEFT JOIN conversations s ON s.conv_id = e.conv_id AND s.turn = e.source
""")
def edge_integrity_check(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    edges = turns.where("turn > 0").select("conv_id", F.col("turn").alias("target"), (F.col("turn") - 1).alias("source"))
    target = turns.select("conv_id", F.col("turn").alias("target"), F.col("role").alias("t_role"))
    source = turns.select("conv_id", F.col("turn").alias("source"), F.col("role").alias("s_role"))
    joined = edges.join(target, ["conv_id", "target"]).join(source, ["conv_id", "source"], "left")
    return aggregates.counters(joined, {"missing_source": F.col("s_role").isNull(), "same_role": F.col("s_role") == F.col("t_role")}).withColumnRenamed("rows", "edges")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bound FROM events
""")
def carry_forward_binding(spark, sf):
    events = table(spark, sf, "events").withColumn("anchor", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return windows.carry_forward(events, "user_id", ["ts", "event_id"], "anchor", "bound").select("event_id", "user_id", "bound")


@query("""
SELECT l_orderkey, kind AS evidence_type, text AS value_text, num AS value_double, count(*) AS rows FROM (
 SELECT l_orderkey, 'temperature' AS kind, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS text, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS num FROM lineitem WHERE l_quantity > 10
 UNION ALL SELECT l_orderkey, 'solvent', l_returnflag, NULL FROM lineitem UNION ALL SELECT l_orderkey, 'solvent', l_linestatus, NULL FROM lineitem) GROUP BY ALL
""")
def condition_evidence_unpivot(spark, sf):
    steps = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int")).alias("t"), F.array("l_returnflag", "l_linestatus").alias("s"))
    evidence = reshape.condition_evidence(steps, "l_orderkey", {"temperature": "t"}, {"solvent": "s"})
    return evidence.groupBy("l_orderkey", "evidence_type", "value_text", "value_double").agg(F.count("*").alias("rows"))


@query(r"""
WITH d AS (SELECT doc_id, source, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, 'reactant' AS role, (i - 1)::INT AS position, m AS molecule FROM (SELECT doc_id, unnest(w) AS m, generate_subscripts(w, 1) AS i FROM d)
UNION ALL SELECT doc_id, 'product', 0, source FROM d WHERE source <> ''
""")
def role_position_explode(spark, sf):
    words = F.split("text", "[\\x20\\x09-\\x0D]")
    steps = table(spark, sf, "documents").select("doc_id", words.alias("r"), F.array_compact(F.array("source")).alias("p"))
    return reshape.role_positions(steps, "doc_id", {"reactant": "r", "product": "p"})


@query(r"""
SELECT doc_id, count(*) AS lines, max(length(l))::INT AS longest FROM (SELECT doc_id, trim(unnest(string_split(trim(regexp_replace(text, '\r\n?', chr(10), 'g')), chr(10)))) AS l FROM documents) WHERE l <> '' GROUP BY 1
""")
def text_lines_explode(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(parsing.text_lines(F.col("text"))).alias("l"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("l")).alias("longest"))


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN '__total__' ELSE o_orderstatus END AS o_orderstatus, count(*) AS rows FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def status_histogram_with_total(spark, sf):
    return aggregates.histogram_with_total(table(spark, sf, "orders"), "o_orderstatus")


@query("""
SELECT count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE event_type = 'click' AND value <= 50) AS low_clicks, count(*) FILTER (WHERE user_id % 2 = 0) AS even_users FROM events
""")
def conditional_counts(spark, sf):
    t, v = F.col("event_type"), F.col("value")
    return aggregates.counters(table(spark, sf, "events"), {"errors": t == "error", "high": v > 50, "low_clicks": (t == "click") & (v <= 50), "even_users": F.col("user_id") % 2 == 0})


@query("""
SELECT l_orderkey, string_agg(l_returnflag || '=' || CAST(n AS VARCHAR), ',' ORDER BY l_returnflag) AS distribution, sum(n)::BIGINT AS total FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1
""")
def family_distribution_map(spark, sf):
    found = aggregates.distribution_map(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag")
    return found.select("l_orderkey", F.array_join(F.transform(F.map_entries("distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("distribution"), "total")


SPLIT_SQL = "CASE WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'val' ELSE 'test' END"


@query(f"""
WITH s AS (SELECT o_orderkey, {SPLIT_SQL} AS split FROM (SELECT o_orderkey, CAST(('0x' || substr(sha1(CAST(o_custkey AS VARCHAR)), 1, 12)) AS BIGINT) % 10000 AS b FROM orders)),
k AS (SELECT DISTINCT l_partkey AS key, split FROM lineitem JOIN s ON l_orderkey = o_orderkey),
g AS (SELECT key, count(*) AS n, bool_or(split = 'train') AS a, bool_or(split = 'val') AS v, bool_or(split = 'test') AS t FROM k GROUP BY 1)
SELECT count(*) AS keys, count(*) FILTER (WHERE n > 1) AS overlapping, count(*) FILTER (WHERE a AND v) AS train_val, count(*) FILTER (WHERE a AND t) AS train_test, count(*) FILTER (WHERE v AND t) AS val_test FROM g
""")
def split_membership_leakage(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), parsing.stable_group_split(F.col("o_custkey")).alias("split"))
    steps = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey")
    return aggregates.overlap_counts(aggregates.membership(steps, "l_partkey", "split"))


def route_components(spark, sf):
    """(node, component) of the routes: as the components of the graph of routes (r:), patents (p:, customer and month of an
    order) and signatures (s:, part and ship date of a line), a component being named by its least node.

    Most patents and signatures are one route's, so only routes that share one get edges, straight between them by number.
    The names are put to the components at the end: a least node is a patent, or else a route.
    """
    day, month = (F.date_format(c, form) for c, form in (("l_shipdate", "yyyyMMdd"), ("o_orderdate", "yyyyMM")))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("route"), F.col("o_custkey").alias("customer"), month.alias("month")).where("route is not null")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route"), F.col("l_partkey").alias("part"), day.try_cast("long").alias("day")).dropna()
    shared = sharing(lines, "route", ["part", "day"]).join(orders.select("route"), "route", "left_semi")
    groups = connected_components(stars(orders, "route", ["customer", "month"]).unionByName(stars(shared, "route", ["part", "day"])).distinct())

    patent = F.concat(F.lit("p:"), F.col("customer").cast("string"), F.lit(":"), "month")
    routes = orders.groupBy("route").agg(F.min(patent).alias("patent"))
    if not orders.where("customer is null or month is null").isEmpty():
        routes = routes.where("patent is not null").unionByName(routes.where("patent is null").join(lines.select("route"), "route", "left_semi"))
    name = F.concat(F.lit("r:"), F.col("route").cast("string"))
    groups = groups.withColumnRenamed("node", "route").withColumnRenamed("component", "group")
    least = groups.join(routes, "route").groupBy("group").agg(F.min(F.coalesce("patent", name)).alias("least"))
    found = routes.join(groups.join(least, "group"), "route", "left")
    return found.select(name.alias("node"), F.coalesce("least", "patent", name).alias("component"))


@query()
def connected_components_routes(spark, sf):
    """All routes with their leakage component; sizes agree with a union-find in the tests."""
    return route_components(spark, sf)


@query("""
WITH RECURSIVE e AS (SELECT 'c:' || o_custkey AS a, 'o:' || o_orderkey AS b FROM orders), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a)
SELECT node, min(seen) AS component FROM r GROUP BY 1
""")
def connected_components_small(spark, sf):
    """Customers with their orders: small components, which a recursive query can give as well."""
    return connected_components(table(spark, sf, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("dst")))


@query()
def greedy_component_split(spark, sf):
    return pack_components(route_components(spark, sf))


@query("""
WITH b AS (SELECT event_type AS g, value AS v FROM events UNION ALL SELECT '__global__', value FROM events),
c AS (SELECT g, count(*) AS n, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.01) AS q01, quantile_cont(v, 0.99) AS q99 FROM b GROUP BY 1),
d AS (SELECT b.g, quantile_cont(abs(v - median), 0.5) AS mad FROM b JOIN c ON b.g = c.g GROUP BY 1)
SELECT c.g AS event_type, n, round(median, 6) AS median, round(greatest(mad, 0.000001), 6) AS mad, round(q01, 6) AS q01, round(q99, 6) AS q99 FROM c JOIN d ON c.g = d.g
""")
def robust_family_stats(spark, sf):
    found = aggregates.robust_stats(table(spark, sf, "events"), "event_type", "value")
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("median", "mad", "q01", "q99")])


@query("""
WITH c AS (SELECT event_type AS g, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1),
d AS (SELECT g, m, lo, hi, greatest(quantile_cont(abs(value - m), 0.5), 0.000001) AS mad FROM events JOIN c ON event_type = g GROUP BY 1, 2, 3, 4)
SELECT event_id, round(least(1.0::DOUBLE, abs(value - m) / (1.4826::DOUBLE * mad) / 8 + CASE WHEN value < lo OR value > hi THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END), 5) AS anomaly FROM events JOIN d ON event_type = g
""")
def condition_anomaly_score(spark, sf):
    events = table(spark, sf, "events")
    stats = aggregates.robust_stats(events, "event_type", "value")
    score = aggregates.anomaly_score(F.col("value"), F.col("median"), F.col("mad"), F.col("q01"), F.col("q99"))
    return events.join(F.broadcast(stats), "event_type").select("event_id", F.round(score, 5).alias("anomaly"))


def _labelled(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(parts, "l_partkey").select("p_brand", parsing.stable_group_split(F.col("l_orderkey")).alias("split"))


SUPPORT_SQL = f"""
SELECT p_brand, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test, count(*) AS total FROM (
 SELECT p_brand, {SPLIT_SQL} AS split FROM (SELECT p_brand, CAST(('0x' || substr(sha1(CAST(l_orderkey AS VARCHAR)), 1, 12)) AS BIGINT) % 10000 AS b FROM lineitem JOIN part ON l_partkey = p_partkey)) GROUP BY 1
"""


@query(SUPPORT_SQL)
def label_support_pivot(spark, sf):
    return aggregates.label_support(_labelled(spark, sf), "p_brand", "split")


@query(f"""
WITH s AS ({SUPPORT_SQL}), t AS (SELECT sum(train) AS tr, sum(val) AS va, sum(test) AS te FROM s)
SELECT p_brand, (train >= 1000 AND tr - train >= 1000 AND val >= 1 AND va - val >= 1 AND test >= 1 AND te - test >= 1) AS retained FROM s, t
""")
def prefit_multilabel_support(spark, sf):
    from retort.ml.prefit import multilabel_support

    return multilabel_support(aggregates.label_support(_labelled(spark, sf), "p_brand", "split"), "p_brand", minimum=1000).select("p_brand", "retained")


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25
""")
def search_by_group_limit(spark, sf):
    orders = table(spark, sf, "orders").withColumn("neg", -F.col("o_totalprice"))
    return windows.search(orders, F.col("o_orderstatus") == "O", ["neg", "o_orderkey"], 25).select("o_orderkey", "o_custkey")


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def registry_latest_wins(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return reshape.latest_wins(log, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""
SELECT count(*) AS rows, sum(CAST(('0x' || substr(h, 1, 8)) AS BIGINT))::BIGINT AS digest_low, sum(CAST(('0x' || substr(h, 9, 8)) AS BIGINT))::BIGINT AS digest_high
FROM (SELECT sha256(CAST(n_nationkey AS VARCHAR) || chr(31) || n_name || chr(31) || CAST(n_regionkey AS VARCHAR)) AS h FROM nation)
""")
def dataset_digest(spark, sf):
    return parsing.dataset_digest(table(spark, sf, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


@query("""SELECT user_id, date_trunc('day', ts) AS day, event_type, count(*) AS rows FROM events GROUP BY 1, 2, 3""")
def tumbling_counts(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("rows"))
    return rows


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'queued' ELSE 'fresh' END AS source, o_orderkey AS key FROM orders""")
def queue_idempotent_populate(spark, sf):
    """Finished orders are in the queue; all orders come in twice over."""
    orders = table(spark, sf, "orders")
    state = orders.where("o_orderstatus = 'F'").select(F.lit("queued").alias("source"), F.col("o_orderkey").alias("key"))
    fresh = orders.select(F.lit("fresh").alias("source"), F.col("o_orderkey").alias("key"))
    return reshape.insert_missing(state, fresh.union(fresh), ["key"])
