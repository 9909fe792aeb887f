"""Stages on small fixtures, with the results that the fixtures' descriptions give."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from retort.chem.columns import reaction_fingerprint
from retort.functions import scores
from retort.governance import leakage, splits
from retort.ml import anomaly, calibration, train
from retort.operators import aggregates, fingerprints, identity, packing, queue
from retort.operators.components import connected_components
from retort.operators.packing import pack_sizes
from retort.plans import domain, relations
from retort.stages import canonical, context, derivation, mapping

STEPS = "route_id string, step_id string, step_index int, canonical_reaction_smiles string, reaction_smiles string, input_intermediate string, output_intermediate string, parse_ok boolean"


def test_anchored_label(spark):
    rows = [("r", "r::0", 0, "CCO>>CC=O", "CCO>>CC=O", None, "M1", True), ("r", "r::1", 1, None, "M1.N>>CCN", "M1", None, False)]
    got = {r["step_id"]: r for r in context.resolve_routes(spark.createDataFrame(rows, STEPS)).collect()}
    assert got["r::1"]["canonical_resolved_reaction_smiles"] == "CC=O.N>>CCN" and got["r::1"]["resolution_status"] == "resolved"
    assert got["r::1"]["edge"]["connecting_molecules"] == ["CC=O"] and got["r::1"]["edge"]["continuity_status"] == "resolved" and got["r::0"]["edge"] is None


def test_product_placeholder(spark):
    rows = [("r", "r::0", 0, None, "CCO>>M1", None, "M1", False), ("r", "r::1", 1, None, "M1>>CCN", "M1", None, False)]
    got = context.resolve_routes(spark.createDataFrame(rows, STEPS)).orderBy("step_id").collect()
    assert [r["resolution_status"] for r in got] == ["unresolved", "unresolved"] and got[0]["canonical_resolved_reaction_smiles"] is None
    assert got[1]["edge"]["continuity_status"] == "label_only"


def test_canonical_build(spark):
    names = "route_id string, step_index string, step_working_reaction_smiles string, step_parse_ok string, step_solvent_list_norm string, step_agent_or_spectator_list_norm string, temperature_c_primary string, time_h_primary string"
    raw = [("20200101-US123A1-0001", "0", "CCO>O.25.3600>CC=O", "true", "['O']", "[]", "25", "1"), ("20200101-US123A1-0001", "1.0", "CC=O>>M1", "true", "[]", "['[Pd]']", "-2100", "2"), ("", "0", "C>>C", "", "", "", "", ""), ("x", "nan", "C>>C", "", "", "", "", "")]
    routes = spark.createDataFrame([("a", "t"), ("a", "t"), ("a", "u")], "route_id string, multistep_reaction_text string")
    built = canonical.build(spark.createDataFrame(raw, names), routes)
    first, second = built.steps.orderBy("step_id").collect()
    assert (first["step_id"], second["step_id"]) == ("20200101-US123A1-0001::000", "20200101-US123A1-0001::001")
    assert second["parse_failure_class"] == "symbolic_intermediate" and second["temperature_c"] is None and first["split"] == second["split"]
    assert sorted(r["route_uid"].split("::")[0] for r in built.routes.collect()) == ["a", "a"] and built.routes.select("route_uid").distinct().count() == 2
    assert {r["rule_code"] for r in built.quality_events.collect()} == {"PARSE_STATUS_REEVALUATED", "TEMPERATURE_OUT_OF_PLAUSIBILITY_RANGE", "DUPLICATE_ROUTE_ID_CONFLICT"}


def test_two_path_assignment(spark):
    steps = [(f"s{i}", i, 0, f"t{i}") for i in range(100)] + [("g", 1000, 0, "A>>B"), ("g", 1001, 1, "B>>C"), ("g", 1002, 0, "A>>D")]
    instances = [(f"s{i}", f"s{i}", 1, f"t{i}", 1) for i in range(100)] + [("g", "g", 1, "A>>B\nB>>C", 2), ("g", "g::instance::002", 2, "A>>D", 1)]
    got = identity.assign_steps(
        spark.createDataFrame(steps, "source_route_id string, step_row long, step_index int, step_text string"),
        spark.createDataFrame(instances, "source_route_id string, route_instance_id string, route_order int, text string, step_count int"),
    )
    counts = {r["method"]: r["count"] for r in got.groupBy("method").count().collect()}
    assert counts == {"unique_source_route": 100, "exact_route_text_match": 3}
    audit = identity.assignment_audit(spark.createDataFrame(steps, "source_route_id string, step_row long, step_index int, step_text string"), got).first()
    assert audit["unassigned_steps"] == 0 and audit["repeated_assignments"] == 0


def test_components_are_a_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, k) for k in range(500, 560)]
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        lead[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for e in edges for n in e}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_route_components_link_only_shared_keys(spark, monkeypatch, tmp_path):
    """The whole graph's components, from edges of shared patents and signatures only; before, every row was an edge."""
    day = lambda k: datetime.datetime(1995 + k // 12 % 5, 1 + k % 12, 1 + k % 27, k % 3)
    rng = random.Random(5)
    orders = [(k, rng.randrange(60) if k % 9 else None, day(rng.randrange(60)) if k % 11 else None) for k in range(300)] + [(5, 61, day(3)), (250, 61, day(3)), (None, 1, day(1)), (900, None, None), (901, None, day(1))]
    lines = [(rng.randrange(330) if i % 40 else None, rng.randrange(25) if i % 30 else None, day(rng.randrange(60)) if i % 35 else None) for i in range(700)] + [(901, 99, day(9)), (902, 99, day(9)), (902, 98, day(9)), (7, 98, day(9))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges, search = [], relations.connected_components
    monkeypatch.setattr(relations, "connected_components", lambda frame, *a, **b: edges.append(frame.count()) or search(frame, *a, **b))
    got = [tuple(r) for r in relations.connected_components_routes(spark, str(tmp_path)).collect()]

    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    known = {o for o, _, _ in orders}
    pairs = [(f"r:{o}", f"p:{c}:{d:%Y%m}") for o, c, d in orders if None not in (o, c, d)] + [(f"r:{o}", f"s:{p}:{d:%Y%m%d}") for o, p, d in lines if None not in (o, p, d) and o in known]
    for a, b in pairs:
        a, b = find(a), find(b)
        lead[max(a, b)] = min(a, b)
    assert sorted(got) == sorted((x, find(x)) for x in lead if x[0] == "r")
    assert len(edges) == 1 and 0 < edges[0] < len(pairs) / 3


SPLIT_ROWS = [("s1", "r1", "p-a", "A>>B"), ("s2", "r2", "p-a", "B>>C"), ("s3", "r3", "p-b", "B>>C"), ("s4", "r4", "p-c", "D>>E"), ("s5", "r5", "p-d", "E>>F")]


def test_splits_leak_nothing_and_repeat(spark):
    steps = spark.createDataFrame([(*r, r[3], r[3]) for r in SPLIT_ROWS], "step_id string, route_id string, patent_document_id string, reaction_smiles string, canonical_resolved_reaction_smiles string, canonical_reaction_smiles string")
    first, again = splits.rebuild_splits(steps), splits.rebuild_splits(steps.orderBy(F.desc("step_id")))
    rows = {r["route_id"]: r for r in first.collect()}
    assert len({rows[r]["split_component_id"] for r in ("r1", "r2", "r3")}) == 1 and rows["r1"]["split_component_rows"] == 3
    assert splits.split_digest(first) == splits.split_digest(again) and leakage.audit(first).strict


def test_leakage_is_found(spark):
    steps = spark.createDataFrame([("a", "train", "p1", "C>>C"), ("b", "test", "p1", "N>>N")], "step_id string, split string, patent_document_id string, canonical_reaction_smiles string").withColumn("canonical_resolved_reaction_smiles", F.lit(None).cast("string"))
    report = leakage.audit(steps)
    assert not report.strict and {r["kind"]: r["train_test"] for r in report.counts.collect()} == {"patent": 1, "signature": 0}


def test_packing_fills_the_shares():
    rng = random.Random(1)
    sizes = [(f"c{i}", rng.randrange(1, 30)) for i in range(500)]
    chosen, filled = pack_sizes(sizes)
    total = sum(n for _, n in sizes)
    assert abs(filled["train"] / total - 0.8) < 0.01 and chosen == pack_sizes(list(reversed(sizes)))[0]


def test_packing_in_blocks(spark, monkeypatch):
    sizes = [(k, 1 + (k % 3 == 0) + 40 * (k == 7)) for k in range(1, 301)]
    members = spark.createDataFrame([(k,) for k, n in sizes for _ in range(n)], "component long")
    monkeypatch.setattr(packing, "PACKED_COMPONENTS", 70)
    got = {str(r["component"]): r["split"] for r in packing.pack_components(members).collect()}
    assert got == pack_sizes([(str(k), n) for k, n in sizes])[0]


def test_packing_writes_sizes_once(spark, monkeypatch):
    """No hash texts, no second copy in order and none of each block, which filled the disk before."""
    kept, cut = [], packing.cut_lineage
    monkeypatch.setattr(packing, "PACKED_COMPONENTS", 70)
    monkeypatch.setattr(packing, "cut_lineage", lambda frame: kept.append(frame.dtypes) or cut(frame))
    sizes = [(f"p:{k}", 1 + (k % 5 == 0) * (k % 4)) for k in range(400)]
    members = spark.createDataFrame([(c,) for c, n in sizes for _ in range(n)], "component string")
    got = [tuple(r) for r in packing.pack_components(members, seed=7).collect()]
    chosen = pack_sizes(sizes, 7)[0]
    assert sorted(got) == sorted((c, n, chosen[c]) for c, n in sizes)
    assert [[kind for _, kind in x] for x in kept] == [["string", "bigint", "bigint"]]


def test_reaction_search_scores_kinds_not_rows(spark, monkeypatch, tmp_path):
    """All pairs of rows give the same; before, a query met every row (200,000 pairs here)."""
    blocked, scored = fingerprints.search_blocked, []
    monkeypatch.setattr(fingerprints, "search_blocked", lambda index, queries, *a, **b: scored.append(index.count() * queries.count()) or blocked(index, queries, *a, **b))
    parts = spark.range(2000).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 50 > 0, F.col("id") * 7 % 43).cast("int").alias("p_size"))
    odd = spark.createDataFrame([(None, 3), (40, 4), (41, 4), (60, None)], "p_partkey long, p_size int")
    parts.union(odd).write.parquet(f"{tmp_path}/part.parquet")
    got = domain.reaction_similarity_topk(spark, str(tmp_path)).collect()
    assert sum(scored) < 10_000

    rows = spark.read.parquet(f"{tmp_path}/part.parquet").select("p_partkey", F.concat(domain._pick(domain.MOLECULES[:6], F.col("p_partkey")), F.lit(">>"), domain._pick(domain.MOLECULES[:5], F.col("p_size"))).alias("r"))
    index = rows.join(rows.select("r").distinct().withColumn("f", reaction_fingerprint("r")), "r").where("f.reactant is not null").select("p_partkey", "f.reactant", "f.product")
    queries = index.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("reactant").alias("qr"), F.col("product").alias("qp"))
    score = F.round(scores.reaction_similarity(scores.tanimoto(F.col("qr"), F.col("reactant")), scores.tanimoto(F.col("qp"), F.col("product"))), 6)
    assert sorted(got) == sorted(blocked(index, queries, score, "query_id", "p_partkey", 5).collect()) and len(got) > 300


def test_mapping_and_derivation(spark):
    class Fails:
        name = "rxnmapper"

        def map_batch(self, texts):
            if any("CCN" in t for t in texts):
                raise RuntimeError
            return [("[CH3:1][CH2:2][OH:3]>>[CH3:1][CH:2]=[O:3]", 0.95) for _ in texts]

    rows = [("v", "s1", "r", "CCO>>CC=O", "eligible"), ("v", "s2", "r", "CCN>>CCN", "eligible"), ("v", "s3", "r", "", "not_eligible")]
    candidates = spark.createDataFrame([(*r, "pending") for r in rows], "dataset_version string, step_id string, route_id string, reaction_smiles string, eligibility_status string, mapping_status string")
    mapped = {r["step_id"]: r for r in mapping.map_candidates(candidates, mapping.MappingConfig(backend=Fails())).collect()}
    assert mapped["s1"]["mapping_status"] == "mapped" and mapped["s2"]["backend"] == "mcs" and mapped["s3"]["mapping_status"] == "not_eligible"
    derived = derivation.derive(mapping.map_candidates(candidates, mapping.MappingConfig(backend=Fails())))
    families = {r["step_id"]: r["reaction_family"] for r in derived.collect()}
    assert families["s1"] == "oxidation_or_unsaturation" and derivation.tables(derived).rejected_derivations.count() == 0


def test_token_guard_and_timeout():
    import time

    config = mapping.MappingConfig(backend=type("B", (), {"name": "rxnmapper", "map_batch": lambda self, x: [("[CH4:1]>>[CH4:1]", 0.9)] * len(x)})(), fallback=False, tokens=lambda t: 602 if "CCN" in t else 512)
    (good, bad) = mapping._rows(config, ["CCO>>CC", "CCN>>CC"])
    assert good[0] == "mapped" and bad[0] == "failed" and bad[5] == "rxnmapper_sequence_too_long"
    began = time.perf_counter()
    assert mapping.bounded(time.sleep, 30, 0.5) is None and time.perf_counter() - began < 3


def test_queue(spark):
    state = spark.createDataFrame([("a", "pending", 0), ("b", "failed", 2), ("c", "failed", 3), ("d", "mapped", 1)], "item_id string, status string, attempts int")
    claimed = queue.claim(state, 10)
    assert [(r["item_id"], r["attempts"]) for r in claimed.orderBy("item_id").collect()] == [("a", 1), ("b", 3)]
    merged = queue.merge_results(state, spark.createDataFrame([("a", "mapped", None)], "item_id string, status string, attempts int"))
    assert {r["item_id"]: (r["status"], r["attempts"]) for r in merged.collect()}["a"] == ("mapped", 0)


def test_calibration_lowers_the_loss(spark):
    rows = [([0.99, 0.01], 0), ([0.98, 0.02], 1), ([0.97, 0.03], 0), ([0.1, 0.9], 1)]
    frame = spark.createDataFrame(rows, "probabilities array<double>, truth int")
    t = calibration.fit_temperature(frame)
    assert 0.25 <= t <= 8 and calibration.log_loss(frame, "probabilities", "truth", [t])[0] <= calibration.log_loss(frame, "probabilities", "truth", [1.0])[0]
    assert calibration.fit_temperature(frame.limit(0)) == 1.0


def test_ranking_precision(spark):
    rows = [(1, "a", 0.9, True), (1, "b", 0.8, False), (1, "c", 0.1, True), (2, "a", 0.5, True), (3, "a", 0.5, False)]
    got = aggregates.label_ranking_precision(spark.createDataFrame(rows, "id int, label string, score double, relevant boolean"), "id", "label", "score", "relevant").first()
    assert got["rows"] == 2 and got["lrap"] == pytest.approx(((1 + 2 / 3) / 2 + 1) / 2)


def test_anomaly_and_training(spark):
    rows = [(f"{'CCO' if i % 2 else 'CCN'}{'C' * (i % 7)}>>C", "yes" if i % 2 else "no", ("train", "train", "val", "test")[i // 2 % 4], float(i % 50), 1.0, "f") for i in range(240)]
    steps = spark.createDataFrame(rows, "t string, y string, split string, temperature_c double, time_h double, reaction_family string")
    model = anomaly.fit(steps)
    scored = anomaly.score(spark.createDataFrame([("f", 500.0, 1.0), ("new", 25.0, None)], "reaction_family string, temperature_c double, time_h double"), model)
    got = {r["reaction_family"]: r for r in scored.collect()}
    assert got["f"]["anomaly_score"] == 1.0 and "temperature_c_high_robust_z" in got["f"]["anomaly_reasons"] and got["new"]["anomaly_score"] < 0.1
    found = train.train_classifier(steps, "demo", "y", "t", size=1 << 10)
    assert found.trained and found.metrics["test"]["accuracy"] > 0.95
    assert not train.train_classifier(steps.where("y = 'yes'"), "demo", "y", "t", size=1 << 10).trained
