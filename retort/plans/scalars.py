"""Queries of the parsing, condition and score expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from retort.functions import conditions, parsing, reactions, scores, taxonomy
from retort.plans.base import Plans
from retort.sources.tables import table

plans = Plans()
query = plans.query


@query("""
SELECT c_custkey, b AS bucket, CASE WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'val' ELSE 'test' END AS split
FROM (SELECT c_custkey, CAST(('0x' || substr(sha1(CAST(c_custkey AS VARCHAR)), 1, 12)) AS BIGINT) % 10000 AS b FROM customer)
""")
def stable_hash_split(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", parsing.stable_bucket(c).alias("bucket"), parsing.stable_group_split(c).alias("split"))


@query("""
SELECT o_orderkey, substr(sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority), 1, 16) AS short_hash,
       sha256('["' || CAST(o_orderkey AS VARCHAR) || '","' || o_orderstatus || '"]') AS json_hash
FROM orders
""")
def content_hash_keys(spark, sf):
    joined = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", parsing.stable_hash(joined).alias("short_hash"), parsing.content_hash(F.col("o_orderkey"), F.col("o_orderstatus")).alias("json_hash"))


@query(r"""
SELECT page_id, regexp_replace(raw, '^(.+)-[0-9]{4,}$', '\1') AS group_id
FROM (SELECT page_id, url || '-' || lpad(CAST(page_id AS VARCHAR), CASE WHEN page_id % 3 = 0 THEN 3 ELSE 5 END, '0') AS raw FROM pages)
""")
def group_id_suffix_strip(spark, sf):
    p = F.col("page_id")
    raw = F.concat("url", F.lit("-"), F.lpad(p.cast("string"), F.when(p % 3 == 0, 3).otherwise(5), F.lit("0")))
    return table(spark, sf, "pages").select("page_id", parsing.patent_document_id(raw).alias("group_id"))


@query("""
SELECT o_orderkey, lower(trim(raw)) IN ('true', '1', 'yes') AS flag
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' TRUE' WHEN 'O' THEN 'no' ELSE 'Yes ' END AS raw FROM orders)
""")
def loose_boolean_cast(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", " TRUE").when(F.col("o_orderstatus") == "O", "no").otherwise("Yes ")
    return table(spark, sf, "orders").select("o_orderkey", parsing.loose_boolean(raw).alias("flag"))


@query("""
SELECT doc_id, CASE WHEN lower(trim(raw)) NOT IN ('', 'nan', 'none', 'null') THEN trim(raw) END AS cleaned
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'None' WHEN 2 THEN '  ' WHEN 3 THEN 'null' ELSE ' ' || source || ' ' END AS raw FROM documents)
""")
def null_text_clean(spark, sf):
    d = F.col("doc_id") % 6
    raw = F.when(d == 0, " NaN ").when(d == 1, "None").when(d == 2, "  ").when(d == 3, "null").otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))
    return table(spark, sf, "documents").select("doc_id", parsing.clean_text(raw).alias("cleaned"))


@query("""
SELECT t AS temperature_bucket, h AS time_bucket, count(*) AS rows FROM (
  SELECT CASE WHEN x < 0 THEN '<0' WHEN x <= 25 THEN '0-25' WHEN x <= 60 THEN '25-60' WHEN x <= 100 THEN '60-100' ELSE '100+' END AS t,
         CASE WHEN y < 1 THEN '<1h' WHEN y <= 4 THEN '1-4h' WHEN y <= 16 THEN '4-16h' WHEN y <= 24 THEN '16-24h' ELSE '24h+' END AS h
  FROM (SELECT l_quantity * 3 - 20 AS x, l_quantity / 2 AS y FROM lineitem)) GROUP BY 1, 2
""")
def numeric_buckets_upper_inclusive(spark, sf):
    rows = table(spark, sf, "lineitem").select(conditions.temperature_bucket(F.col("l_quantity") * 3 - 20).alias("temperature_bucket"), conditions.time_bucket(F.col("l_quantity") / 2).alias("time_bucket"))
    return rows.groupBy("temperature_bucket", "time_bucket").agg(F.count("*").alias("rows"))


@query("""
SELECT event_id, t AS temperature_observed_c, CASE WHEN t_ok THEN t END AS temperature_clean_c, h_ok AS time_valid,
  CASE WHEN NOT coalesce(t_ok, true) OR NOT coalesce(h_ok, true) THEN 'suspicious' WHEN t IS NULL AND h IS NULL THEN 'missing' WHEN t IS NULL OR h IS NULL THEN 'partial' ELSE 'valid' END AS status,
  concat_ws(',', CASE WHEN NOT t_ok THEN 'temperature_out_of_plausibility_range' END, CASE WHEN NOT h_ok THEN 'time_out_of_plausibility_range' END) AS issues
FROM (SELECT event_id, t, h, t BETWEEN -150.0::DOUBLE AND 350.0::DOUBLE AS t_ok, h BETWEEN (1.0::DOUBLE / 3600.0::DOUBLE) AND 8760.0::DOUBLE AS h_ok
      FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value * 10 - 200 END AS t, CASE WHEN event_id % 13 <> 0 THEN value * 400 END AS h FROM events))
""")
def plausibility_validation(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    checked = conditions.validate_conditions(F.when(e % 11 != 0, v * 10 - 200), F.when(e % 13 != 0, v * 400))
    rows = table(spark, sf, "events").select("event_id", checked.alias("c"))
    return rows.select("event_id", "c.temperature_observed_c", "c.temperature_clean_c", "c.time_valid", "c.status", F.array_join("c.issues", ",").alias("issues"))


@query("""
WITH raw AS (SELECT CAST(l_quantity AS INT) - 20 AS a, CAST(round(l_extendedprice) AS INT) % 900 AS b FROM lineitem),
one AS (SELECT a, b, CASE WHEN a < 0 THEN a::DOUBLE END AS t0, CASE WHEN a < 0 THEN 1 ELSE 2 END AS n FROM raw),
two AS (SELECT *, (b > 300 OR (n = 2 AND b >= 60)) AS taken FROM one),
three AS (SELECT *, CASE WHEN taken THEN b / 3600.0::DOUBLE END AS time_h, CASE WHEN t0 IS NULL THEN a::DOUBLE ELSE t0 END AS temperature_c,
          (t0 IS NULL AND NOT taken AND b BETWEEN -150 AND 350) AS several FROM two)
SELECT temperature_c, round(time_h, 9) AS time_h, CASE WHEN time_h IS NOT NULL THEN 'high' WHEN several THEN 'low' ELSE 'medium' END AS confidence,
       CASE WHEN several THEN 'multi_temperature_profile_primary_selected' ELSE '' END AS issues, count(*) AS rows
FROM three GROUP BY 1, 2, 3, 4
""")
def positional_numeric_reparse(spark, sf):
    a, b = F.col("l_quantity").cast("int") - 20, F.round("l_extendedprice").cast("int") % 900
    text = F.concat(F.lit("CC>O."), a.cast("string"), F.lit("."), b.cast("string"), F.lit(">CO"))
    rows = table(spark, sf, "lineitem", deal=True).select(conditions.reparse_middle(text).alias("m"))
    return rows.groupBy(F.col("m.temperature_c").alias("temperature_c"), F.round("m.time_h", 9).alias("time_h"), F.col("m.confidence").alias("confidence"), F.array_join("m.issues", ",").alias("issues")).agg(F.count("*").alias("rows"))


def _unlike(pattern: str):
    return lambda x: ~(x.rlike(pattern) | reactions.is_placeholder(x))


def url_reaction(url):
    """A page's address as a reaction text: host labels, then what is between the first two slashes, then the rest."""
    return F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/", ">")


@query(r"""
WITH raw AS (SELECT page_id, trim(replace(regexp_replace(url, '^https?://', ''), '/', '>')) AS r FROM pages),
n AS (SELECT page_id, r, (length(r) - length(replace(r, '>>', ''))) // 2 AS doubles, length(r) - length(replace(r, '>', '')) AS singles, string_split(r, '>') AS f FROM raw),
s AS (SELECT page_id, doubles = 1 OR (doubles = 0 AND singles >= 2) AS good,
             CASE WHEN doubles = 1 THEN string_split(r, '>>')[1] WHEN doubles = 0 AND singles >= 2 THEN f[1] ELSE '' END AS a,
             CASE WHEN doubles = 1 THEN substr(r, instr(r, '>>') + 2) WHEN doubles = 0 AND singles >= 2 THEN array_to_string(f[3:], '>') ELSE '' END AS b FROM n),
m AS (SELECT page_id, good, list_filter(list_transform(string_split(a, '.'), lambda x: trim(x)), lambda x: x <> '') AS a, list_filter(list_transform(string_split(b, '.'), lambda x: trim(x)), lambda x: x <> '') AS b FROM s),
v AS (SELECT page_id, good, len(a) AS na, len(b) AS nb, len(list_filter(list_concat(a, b), lambda x: regexp_matches(x, '^(?i)M[0-9]+$'))) > 0 AS symbolic,
             len(list_filter(a, lambda x: NOT regexp_matches(x, '^([a-z-]+|(?i)M[0-9]+)$'))) = 0 AS ok_a, len(list_filter(b, lambda x: NOT regexp_matches(x, '^([a-z0-9-]+|(?i)M[0-9]+)$'))) = 0 AS ok_b FROM m)
SELECT page_id, CASE WHEN NOT good THEN 'malformed_delimiter' WHEN na = 0 OR nb = 0 THEN 'empty_reaction_side' WHEN ok_a AND ok_b AND NOT symbolic THEN 'valid' WHEN ok_a AND ok_b THEN 'symbolic_intermediate'
       WHEN NOT ok_a AND NOT ok_b THEN 'invalid_both_sides' WHEN NOT ok_a THEN 'invalid_reactant' ELSE 'invalid_product' END AS parse_class, na::INT AS reactants, nb::INT AS products FROM v
""")
def delimiter_parse_class(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", reactions.reaction_sides(url_reaction(F.col("url"))).alias("s"))
    fit = {"reactants": "\\A[a-z-]+\\z", "products": "\\A[a-z0-9-]+\\z"}
    ok = {side: F.size(F.filter(f"s.{side}", _unlike(pattern))) == 0 for side, pattern in fit.items()}
    return rows.select("page_id", reactions.parse_class(F.col("s"), ok["reactants"], ok["products"]).alias("parse_class"), F.size("s.reactants").alias("reactants"), F.size("s.products").alias("products"))


@query("""
SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(*) AS rows FROM events GROUP BY 1
""")
def json_payload_decode(spark, sf):
    decoded = F.coalesce(F.from_json("props", "map<string,bigint>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))
    rows = table(spark, sf, "events").select("event_type", F.try_element_at(decoded, F.lit("k")).alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count("*").alias("rows"))


@query("""
SELECT q AS quality, count(*) AS rows FROM (
  SELECT round(CASE WHEN l_returnflag = 'R' THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END * 0.55::DOUBLE
             + CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.30::DOUBLE + (1.0::DOUBLE - l_discount) * 0.15::DOUBLE, 6) AS q FROM lineitem) GROUP BY 1
""")
def weighted_quality_score(spark, sf):
    parse = F.when(F.col("l_returnflag") == "R", 0.65).otherwise(1.0)
    condition = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.5)
    return table(spark, sf, "lineitem").select(scores.step_quality(parse, condition, 1.0 - F.col("l_discount")).alias("quality")).groupBy("quality").agg(F.count("*").alias("rows"))


@query("""
SELECT o_orderkey, round(least(1.0, greatest(0.0, a)) * 0.30::DOUBLE + least(1.0, greatest(0.0, coalesce(b, 0.0))) * 0.20::DOUBLE + 0.5::DOUBLE * 0.15::DOUBLE
       + 1.0::DOUBLE * 0.15::DOUBLE + 0.0::DOUBLE * 0.10::DOUBLE + least(1.0, greatest(0.0, c)) * 0.10::DOUBLE, 6) AS route_quality
FROM (SELECT o_orderkey, (o_orderkey % 150) / 100.0::DOUBLE AS a, CASE WHEN o_orderkey % 4 <> 0 THEN (o_custkey % 100) / 100.0::DOUBLE END AS b, (o_orderkey % 20 - 5) / 10.0::DOUBLE AS c FROM orders)
""")
def route_quality_clamped(spark, sf):
    k = F.col("o_orderkey")
    parts = {
        "parse_completeness": (k % 150) / 100.0,
        "mapping_coverage": F.when(k % 4 != 0, (F.col("o_custkey") % 100) / 100.0),
        "condition_completeness": F.lit(0.5),
        "intermediate_continuity": F.lit(1.0),
        "evidence_support": (k % 20 - 5) / 10.0,
    }
    return table(spark, sf, "orders").select("o_orderkey", scores.route_quality(parts).alias("route_quality"))


@query("""
SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> ''), ',') AS names, 2 AS literal_items, 0 AS missing_items FROM part
""")
def list_text_decode(spark, sf):
    quoted = F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', ' ")), F.lit("', '']"))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(parsing.parse_list(quoted), ",").alias("names"),
        F.size(parsing.parse_list(F.concat(F.lit('["a", "'), F.col("p_partkey").cast("string"), F.lit('"]')))).alias("literal_items"),
        F.size(parsing.parse_list(F.when(F.col("p_partkey") % 2 == 0, "nan"))).alias("missing_items"),
    )


@query("""
SELECT s.smiles, CASE s.smiles WHEN 'O' THEN 'water' WHEN 'CO' THEN 'alcohol_protic' WHEN 'ClCCl' THEN 'halogenated' ELSE CASE WHEN s.smiles = '?' THEN 'unknown_solvent' WHEN s.smiles = 'CCBr' THEN 'halogenated' WHEN s.smiles = 'CSC' THEN 'heteroatom_polar_aprotic' WHEN s.smiles = 'CCCO' THEN 'protic' ELSE 'polar_aprotic' END END AS family, count(*) AS rows
FROM (SELECT ['O','CO','ClCCl','CCBr','CSC','CCCO','CC=O','?'][(l_linenumber % 8 + 1)::INT] AS smiles FROM lineitem) s GROUP BY 1, 2
""")
def solvent_family_rules(spark, sf):
    names = ["O", "CO", "ClCCl", "CCBr", "CSC", "CCCO", "CC=O", "?"]
    elements = [["O"], ["C", "O"], ["C", "Cl"], ["C", "Br"], ["C", "S"], ["C", "O"], ["C", "O"], []]
    at = (F.col("l_linenumber") % 8 + 1).cast("int")
    molecule = F.struct(
        (F.element_at(F.array(*[F.lit(x) for x in names]), at) != "?").alias("valid"),
        F.element_at(F.array(*[F.array(*[F.lit(e) for e in x]).cast("array<string>") for x in elements]), at).alias("elements"),
        F.when(at == 6, 1).otherwise(0).alias("hbd"),
        F.lit(0.3).alias("logp"),
        F.lit(0).alias("rings"),
    )
    smiles = F.element_at(F.array(*[F.lit(x) for x in names]), at)
    return table(spark, sf, "lineitem").select(smiles.alias("smiles"), taxonomy.solvent_family(smiles, molecule).alias("family")).groupBy("smiles", "family").agg(F.count("*").alias("rows"))


@query("""
SELECT c AS coverage, ok AS valid, issues, count(*) AS rows FROM (
 SELECT CASE k WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c, k < 2 AS ok,
        CASE k WHEN 2 THEN 'duplicate_reactant_map_numbers' WHEN 3 THEN 'no_overlapping_map_numbers' ELSE '' END AS issues FROM (SELECT o_orderkey % 4 AS k FROM orders)) GROUP BY 1, 2, 3
""")
def bond_set_diff(spark, sf):
    forms = ["[CH3:1][OH:2]>>[CH2:1]=[O:2]", "[CH3:1][Cl:2]>>[CH3:1]", "[CH3:1][CH3:1]>>[CH3:1]", "[CH3:1]>>[OH:2]"]
    text = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf, "orders").select(reactions.mapping_check(text).alias("m"))
    return rows.groupBy(F.col("m.coverage").alias("coverage"), F.col("m.valid").alias("valid"), F.array_join("m.issues", ",").alias("issues")).agg(F.count("*").alias("rows"))
