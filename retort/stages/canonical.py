"""Canonical steps, routes and quality events from raw step and route tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.chem.columns import reaction_sides
from retort.functions import conditions, parsing, scores
from retort.operators import identity
from retort.schemas import SOURCE_ROUTES, SOURCE_STEPS, align


@dataclass(frozen=True)
class Canonical:
    steps: DataFrame
    routes: DataFrame
    quality_events: DataFrame


def _step_index(c: Column) -> Column:
    """Truncated toward zero; null where it is no number."""
    return parsing.number(c).cast("int")


def canonical_steps(source: DataFrame, version: str = "v1") -> DataFrame:
    """The step table: parsed reactions, repaired and checked conditions, unique ids, split and quality.

    ``source`` has the columns of SOURCE_STEPS, all read as text, with duplicated headers merged first. Rows without a
    route id or a numeric index are left out. Rows of one key are put in order of their reaction text.
    """
    raw = align(parsing.coalesce_duplicate_headers(source), SOURCE_STEPS)
    rows = raw.withColumn("route_id", F.trim("route_id")).withColumn("step_index", _step_index(F.col("step_index"))).where("route_id <> '' and step_index is not null")
    reaction = F.trim(F.coalesce("step_working_reaction_smiles", F.lit("")))
    rows = rows.withColumn("reaction_smiles", reaction).withColumn("middle", conditions.reparse_middle(reaction))
    # molecules are parsed once for each distinct reaction
    parsed = rows.select("reaction_smiles").distinct().withColumn("parsed", reaction_sides("reaction_smiles"))
    rows = rows.join(parsed, "reaction_smiles")
    solvents = parsing.distinct_in_order(parsing.parse_list(F.col("step_solvent_list_norm")))
    agents = parsing.distinct_in_order(parsing.parse_list(F.col("step_agent_or_spectator_list_norm")))
    legacy_t, legacy_h = parsing.number(F.col("temperature_c_primary")), parsing.number(F.col("time_h_primary"))
    validity = conditions.validate_conditions(F.coalesce("middle.temperature_c", legacy_t), F.coalesce("middle.time_h", legacy_h))
    rows = rows.withColumns({"solvents": solvents, "agents": agents, "v": validity, "legacy_temperature_c": legacy_t, "legacy_time_h": legacy_h})
    key = F.format_string("%s::%03d", "route_id", "step_index")
    content = F.concat_ws("|", "reaction_smiles", "route_id", F.col("step_index").cast("string"))
    order = [F.col("reaction_smiles"), F.col("step_reaction_smiles"), F.col("temperature_c_primary"), F.col("time_h_primary")]
    rows = identity.suffix_repeated_keys(rows, key, content, order)
    patent = parsing.patent_document_id(F.col("route_id"))
    ok, symbolic = F.col("parsed.parse_class") == "valid", F.col("parsed.parse_class") == "symbolic_intermediate"
    given = F.when(F.trim("step_canonical_reaction_demapped") != "", F.trim("step_canonical_reaction_demapped"))
    complete = (F.size("solvents") > 0).cast("int") + F.col("v.temperature_clean_c").isNotNull().cast("int") + F.col("v.time_clean_h").isNotNull().cast("int")
    quality = scores.step_quality(F.when(ok, 1.0).when(symbolic, 0.65).otherwise(0.0), complete / 3.0, F.when(F.size("v.issues") == 0, 1.0).otherwise(0.0))
    return rows.select(
        F.lit(version).alias("dataset_version"),
        "step_id",
        "route_id",
        patent.alias("patent_document_id"),
        parsing.stable_group_split(patent).alias("split"),
        "step_index",
        F.trim(F.coalesce("step_reaction_smiles", "reaction_smiles")).alias("raw_reaction_text"),
        "reaction_smiles",
        F.coalesce(given, "parsed.canonical").alias("canonical_reaction_smiles"),
        F.col("parsed.reactants").alias("reactants"),
        F.col("parsed.products").alias("products"),
        ok.alias("parse_ok"),
        F.col("parsed.reactants_valid").alias("reactants_valid"),
        F.col("parsed.products_valid").alias("products_valid"),
        F.col("parsed.parse_class").alias("parse_failure_class"),
        parsing.loose_boolean(F.col("step_parse_ok")).alias("source_parse_ok"),
        symbolic.alias("symbolic_intermediate"),
        parsing.clean_text(F.col("step_input_intermediate")).alias("input_intermediate"),
        parsing.clean_text(F.col("step_output_intermediate")).alias("output_intermediate"),
        "solvents",
        "agents",
        F.get("solvents", F.lit(0)).alias("solvent_primary"),
        F.get("agents", F.lit(0)).alias("agent_primary"),
        (F.size("agents") > 0).alias("agent_present"),
        "legacy_temperature_c",
        "legacy_time_h",
        F.col("middle.method").alias("condition_extraction_method"),
        F.col("middle.confidence").alias("condition_extraction_confidence"),
        F.col("middle.numeric_tokens").alias("condition_numeric_tokens"),
        F.col("middle.issues").alias("condition_repair_issues"),
        F.col("v.temperature_observed_c").alias("temperature_observed_c"),
        F.col("v.temperature_clean_c").alias("temperature_c"),
        F.col("v.temperature_valid").alias("temperature_valid"),
        conditions.temperature_bucket(F.col("v.temperature_clean_c")).alias("temperature_bucket"),
        F.col("v.time_observed_h").alias("time_observed_h"),
        F.col("v.time_clean_h").alias("time_h"),
        F.col("v.time_valid").alias("time_valid"),
        conditions.time_bucket(F.col("v.time_clean_h")).alias("time_bucket"),
        F.col("v.status").alias("condition_status"),
        F.col("v.issues").alias("quality_issues"),
        quality.alias("quality_score"),
        F.lit(True).alias("eligible_parse_model"),
        ok.alias("eligible_condition_models"),
        ok.alias("eligible_retrieval"),
    )


def canonical_routes(source: DataFrame, version: str = "v1") -> DataFrame:
    """The route table. Of rows with one id, those equal to the first go and those that differ stay under a suffixed id."""
    raw = align(parsing.coalesce_duplicate_headers(source), SOURCE_ROUTES).withColumn("route_id", F.trim("route_id")).where("route_id <> ''")
    text = F.coalesce("multistep_reaction_text", F.lit(""))
    rows = raw.withColumn("source_content_hash", parsing.stable_hash(text, 16))
    order = [F.col("multistep_reaction_text"), F.col("route_step_count"), F.col("route_parsed_step_count")]
    seen = identity.first_seen(rows, "route_id", F.col("source_content_hash"), order).where("content_status <> 'exact_duplicate'")
    uid = F.when(F.col("content_status") == "first", F.col("route_id")).otherwise(F.concat("route_id", F.lit("::v"), F.substring("source_content_hash", 1, 8)))
    steps, parsed = (F.coalesce(parsing.number(F.col(c)).cast("int"), F.lit(0)) for c in ("route_step_count", "route_parsed_step_count"))
    patent = parsing.patent_document_id(F.col("route_id"))
    return seen.select(
        F.lit(version).alias("dataset_version"),
        uid.alias("route_uid"),
        "route_id",
        patent.alias("patent_document_id"),
        parsing.stable_group_split(patent).alias("split"),
        "source_content_hash",
        text.alias("multistep_reaction_text"),
        steps.alias("step_count"),
        parsed.alias("parsed_step_count_legacy"),
        parsing.loose_boolean(F.col("route_parse_ok")).alias("legacy_route_parse_ok"),
        F.when(steps != 0, parsed / steps).otherwise(0.0).alias("legacy_parse_rate"),
        parsing.loose_boolean(F.col("route_is_atom_mapped")).alias("is_atom_mapped"),
        parsing.parse_list(F.col("route_reactants_demapped")).alias("route_reactants"),
        parsing.parse_list(F.col("route_products_demapped")).alias("route_products"),
        parsing.parse_list(F.col("final_products_demapped")).alias("final_products"),
    )


def quality_events(steps: DataFrame, routes: DataFrame) -> DataFrame:
    """(entity_type, entity_id, rule_code, severity, observed_value, dataset_version) of what was noticed in building."""

    def event(kind: str, entity: str, code: Column, severity: str, observed: Column) -> Column:
        return F.struct(F.lit(kind).alias("entity_type"), F.col(entity).alias("entity_id"), code.alias("rule_code"), F.lit(severity).alias("severity"), F.to_json(F.struct(observed.alias("value"))).alias("observed_value"), F.col("dataset_version").alias("dataset_version"))

    key = F.format_string("%s::%03d", "route_id", "step_index")
    of_steps = F.array_compact(
        F.concat(
            F.array(
                F.when(F.col("step_id") != key, event("step", "step_id", F.lit("DUPLICATE_STEP_KEY"), "warning", key)),
                F.when(F.col("source_parse_ok") != F.col("parse_ok"), event("step", "step_id", F.lit("PARSE_STATUS_REEVALUATED"), "info", F.col("source_parse_ok").cast("string"))),
            ),
            F.transform("quality_issues", lambda i: event("step", "step_id", F.upper(i), "warning", F.concat_ws(",", F.col("temperature_observed_c").cast("string"), F.col("time_observed_h").cast("string")))),
        )
    )
    first = steps.select(F.explode(of_steps).alias("e")).select("e.*")
    conflict = routes.where("route_uid <> route_id").select(event("route", "route_uid", F.lit("DUPLICATE_ROUTE_ID_CONFLICT"), "warning", F.col("route_id")).alias("e")).select("e.*")
    return first.unionByName(conflict)


def build(step_source: DataFrame, route_source: DataFrame, version: str = "v1") -> Canonical:
    steps, routes = canonical_steps(step_source, version), canonical_routes(route_source, version)
    return Canonical(steps, routes, quality_events(steps, routes))


def metrics(canonical: Canonical) -> DataFrame:
    """(metric, value) counters of a build, tagged ones as ``tag::value`` (A1)."""
    s = canonical.steps
    plain = s.agg(
        F.count("*").alias("steps_total"),
        F.count_if("parse_ok").alias("steps_parse_valid"),
        F.count_if("symbolic_intermediate").alias("steps_symbolic_intermediate"),
        F.count_if(F.size("solvents") > 0).alias("steps_with_solvent"),
        F.count_if("agent_present").alias("steps_with_agents"),
        F.count_if(F.col("temperature_c").isNotNull()).alias("steps_with_clean_temperature"),
        F.count_if(F.col("time_h").isNotNull()).alias("steps_with_clean_time"),
        F.count_if(F.col("condition_extraction_method") == "positional_numeric_repair").alias("steps_condition_reparsed"),
    )
    long = plain.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in plain.columns]), F.array(*plain.columns))).alias("metric", "value"))
    tagged = s.select(F.concat(F.lit("parse_class::"), "parse_failure_class").alias("metric")).unionByName(s.select(F.concat(F.lit("split::"), "split").alias("metric")))
    return long.unionByName(tagged.groupBy("metric").agg(F.count("*").alias("value"))).unionByName(canonical.routes.agg(F.lit("routes_total").alias("metric"), F.count("*").alias("value")))
