"""Sinks and sources, streams, queue outputs, governance and blending on small rows."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from retort.chem.columns import describe_molecules, product_scaffold
from retort.functions import parsing, scores, taxonomy
from retort.governance import acceptance
from retort.governance.registry import ReadOnly, Registry
from retort.ml import inference
from retort.operators import aggregates, queue, windows
from retort.service import Jobs
from retort.sources import datasets
from retort.stages import index, mapping
from retort.streaming import events as streams


def test_datasets(spark, tmp_path):
    rows = spark.createDataFrame([("a", {"x": 1}, ["d"]), ("b", None, None), ("c", {}, [])], "route_id string, family_distribution map<string,bigint>, diagnostics array<string>")
    assert datasets.write_dataset(rows, str(tmp_path), "routes") == 3 and datasets.dataset_rows(spark, str(tmp_path), "routes") == 3
    assert dict(spark.read.parquet(f"{tmp_path}/routes").dtypes)["family_distribution"] == "string"
    back = {r["route_id"]: r for r in datasets.read_dataset(spark, str(tmp_path), "routes").collect()}
    assert back["a"]["family_distribution"] == {"x": 1} and back["b"]["family_distribution"] == {} and back["b"]["diagnostics"] == []
    assert datasets.read_dataset(spark, str(tmp_path), "routes", ["route_id"]).columns == ["route_id"]
    datasets.encode_json(rows).coalesce(1).write.option("header", True).option("escape", '"').option("compression", "gzip").csv(f"{tmp_path}/plain")
    assert {r["route_id"]: r["family_distribution"] for r in datasets.read_dataset(spark, str(tmp_path), "plain").collect()} == {"a": {"x": 1}, "b": {}, "c": {}}
    with pytest.raises(FileNotFoundError):
        datasets.read_dataset(spark, str(tmp_path), "none")
    digest = datasets.tree_digest(spark, f"{tmp_path}/plain")
    assert digest == datasets.tree_digest(spark, f"{tmp_path}/plain") != datasets.tree_digest(spark, f"{tmp_path}/routes")
    assert datasets.content_digests(spark, f"{tmp_path}/plain").where("length(sha256) = 64").count() >= 1
    assert datasets.portable_path("/a/b/c.txt", "/a") == "b/c.txt" and datasets.portable_path("/x/c.txt", "/a") == "c.txt" and datasets.unique_headers(["k", "k", "n"]) == ["k", "k.1", "n"]


def test_publish_goes_back(spark, tmp_path):
    live, staged = f"{tmp_path}/live", f"{tmp_path}/staged"
    for folder, value in ((live, 1), (staged, 2)):
        for name in ("a", "b"):
            spark.range(value).write.parquet(f"{folder}/{name}")
    datasets.publish(spark, staged, live, ["a"])
    assert spark.read.parquet(f"{live}/a").count() == 2 and not os.path.exists(f"{live}/.a.old")
    spark.range(3).write.parquet(f"{staged}/a")
    with pytest.raises(OSError):
        datasets.publish(spark, staged, live, ["a", "missing"])
    assert spark.read.parquet(f"{live}/a").count() == 2


def test_texts_and_scores(spark):
    row = spark.range(1).select(
        parsing.distinct_in_order(F.array(F.lit(" b"), F.lit("a"), F.lit("b"), F.lit(" "))).alias("d"),
        parsing.normalize_text(F.lit(" a\r\nb\r ")).alias("n"),
        parsing.instance_step_id(F.lit("r"), F.lit("r::instance::002"), F.lit("r::003"), F.lit(3), F.lit(7)).alias("swapped"),
        parsing.instance_step_id(F.lit("r"), F.lit("r"), F.lit("x"), F.lit(3), F.lit(7)).alias("made"),
        scores.inverse_target(scores.forward_target(F.lit(5.0), "log1p"), "log1p").alias("back"),
        scores.forward_target(F.lit(-2.0), "log1p").alias("floor"),
        scores.nan_to_null(F.lit(float("nan"))).alias("nan"),
        product_scaffold(F.lit("CCO>>c1ccccc1CC")).alias("scaffold"),
    ).first()
    assert row["d"] == ["b", "a"] and row["n"] == "a\nb\n" or row["n"] == "a\nb"
    assert row["swapped"] == "r::instance::002::003" and row["made"] == "r::003::row::000000007" and row["back"] == pytest.approx(5.0) and row["floor"] == 0 and row["nan"] is None and row["scaffold"]
    molecules = describe_molecules(spark.createDataFrame([(m,) for m in ("[Pd]", "[Na+]", "CP", "CSC", "CCO", "CCCCCCCC", "CC(")], "molecule string"))
    named = {r["molecule"]: (r["a"], r["c"]) for r in molecules.select("molecule", taxonomy.agent_family(F.col("info")).alias("a"), taxonomy.catalyst_family(F.col("molecule"), F.col("info")).alias("c")).collect()}
    assert named["[Pd]"] == ("transition_metal_catalyst", "transition_metal_catalyst") and named["[Na+]"] == ("metal_reagent_or_salt", None)
    assert [named[m][0] for m in ("CP", "CSC", "CCO", "CCCCCCCC", "CC(")] == ["phosphorus_reagent_or_ligand", "sulfur_reagent", "small_molecule_reagent", "organic_reagent", "unknown_agent"]
    best = windows.global_top_k(spark.range(50), F.col("id") % 7, ["id"], 3)
    assert [r["id"] for r in best.collect()] == [6, 13, 20] and [r["id"] for r in windows.first_rows(spark.range(9), ["id"], 2).collect()] == [0, 1]


def test_queue_outputs(spark):
    rows = [("a", "mapped", "rxnmapper", False, None), ("b", "mapped", "mcs", True, None), ("c", "failed", "mcs", True, "mcs_timeout"), ("d", "failed", "rxnmapper", False, "rxnmapper_sequence_too_long")]
    out = queue.route_outputs(spark.createDataFrame(rows, "item_id string, status string, backend string, fallback_attempted boolean, error string"))
    got = {name: sorted(r["item_id"] for r in frame.collect()) for name, frame in out.items()}
    assert got == {"reaction_mappings_rxnmapper": ["a", "b", "c", "d"], "reaction_mappings_mcs_fallback": ["b", "c"], "reaction_mappings_rejected": ["b", "c", "d"], "reaction_mapping_exceptions": ["b", "c", "d"]}
    state = spark.createDataFrame([("a", None), ("b", 1)], "item_id string, fallback_attempts int")
    assert {r["item_id"]: r["fallback_attempts"] for r in queue.count_fallback(state, state.where("item_id = 'b'")).collect()} == {"a": 0, "b": 2}
    told = spark.createDataFrame([(0.9, 0.9, True, None, 10), (0.4, 0.9, True, None, 10), (0.9, 0.9, True, None, 600), (0.9, 0.9, True, "x", 10)], "c double, v double, ok boolean, e string, t int")
    assert [r["s"] for r in told.select(queue.mapping_status(*[F.col(c) for c in ("c", "v", "ok", "e", "t")]).alias("s")).collect()] == ["mapped", "low_confidence", "failed", "failed"]
    assert mapping.preflight(mapping.MappingConfig()) == "fallback" and mapping.preflight(mapping.MappingConfig(backend=mapping.Surroundings())) == "mcs"
    with pytest.raises(RuntimeError):
        mapping.preflight(mapping.MappingConfig(fallback=False))


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return streams.read_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)


def drain(frame, tmp_path, name, mode="append"):
    running = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    running.awaitTermination()
    return frame.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 6:02d}:{10 * (i % 6):02d}:00", i % 2, "click", float(i), None if i % 3 else i) for i in range(48)] + [(99, "2024-01-03 00:00:00", 0, "click", 1.0, None)]
    source = stream(spark, tmp_path, [(r[0], *r[1:]) for r in rows], "event_id long, t string, user_id long, event_type string, value double, anchor long").withColumn("ts", F.to_timestamp("t"))
    assert sum(r["rows"] for r in drain(streams.tumbling_counts(source), tmp_path, "tumbling", "complete")) == 49
    assert all(r["mean"] is not None for r in drain(streams.sliding_average(source, "value"), tmp_path, "sliding", "complete"))
    assert sum(r["rows"] for r in drain(streams.sessions(source), tmp_path, "sessions_", "complete")) == 49
    assert len(drain(streams.deduplicated(source, ["user_id", "event_type"]), tmp_path, "once")) == 2
    bound = {(r["user_id"], r["event_id"]): r["bound"] for r in drain(streams.carried_bindings(source, "user_id", "event_id", "anchor"), tmp_path, "bound", "append")}
    last: dict = {}
    for r in sorted(rows):
        last[r[2]] = r[5] if r[5] is not None else last.get(r[2])
        assert bound[r[2], r[0]] == last[r[2]]


def test_queue_stream(spark, tmp_path):
    step = lambda batch: batch.select("item_id", F.lit("mapped").alias("status"))
    for part in ([("a",), ("b",)], [("c",)]):
        pending = stream(spark, tmp_path, part, "item_id string")
        streams.run_queue(pending, step, f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
    streams.run_queue(pending, step, f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == 3 and {r["item_id"] for r in queue.current(log).collect()} == {"a", "b", "c"}


def test_registry(spark, tmp_path):
    registry = Registry(spark, f"{tmp_path}/registry")
    first = registry.register_model("t", "v", {"split_digest": "1"}, "candidate")
    assert registry.resolve("t") is None and registry.resolve("t", experimental=True)["id"] == first
    second = registry.register_model("t", "v", {"split_digest": "1"}, "screening")
    assert {r["id"]: r["status"] for r in registry.models().collect()} == {first: "superseded", second: "active"} and registry.resolve("t")["id"] == second
    with pytest.raises(PermissionError):
        registry.promote(second, "production")
    registry.promote(second, "production", approved=True)
    assert registry.resolve("t")["stage"] == "production" and registry.normalise() == 0
    assert registry.invalidate_other_splits("v", "2") == 1 and registry.resolve("t") is None
    with pytest.raises(ReadOnly):
        Registry(spark, f"{tmp_path}/registry", read_only=True).register_run("x", {})
    assert registry.register_run("r", {}).startswith("r-") and json.loads(registry.current("model").first()["payload"])["split_digest"] == "1"


def test_acceptance(spark):
    steps = spark.createDataFrame(
        [(f"r{i}::000", f"r{i}", "train" if i % 5 else "test", f"p{i}", f"C{'C' * i}>>CC{'C' * i}") for i in range(10)], "step_id string, route_id string, split string, patent_document_id string, canonical_reaction_smiles string"
    ).withColumns({"canonical_resolved_reaction_smiles": F.lit(None).cast("string"), "eligible_retrieval_v2": F.lit(True), "reaction_centre_fingerprint": F.sha2("step_id", 256), "reaction_family": F.lit("f"), "contextual_quality_score": F.lit(0.9)})
    routes = steps.select("route_id", "split", F.lit(1).cast("long").alias("step_count"))
    edges = spark.createDataFrame([], "route_id string, source_step_id string, target_step_id string")
    built = index.reaction_index(steps)
    report = acceptance.accept(steps, routes, edges, built)
    assert report["accepted"], report
    locked = acceptance.lock(report, {"steps": "x"}, "v")
    assert acceptance.verify_lock(locked) and not acceptance.verify_lock(locked | {"version": "w"})
    broken = acceptance.accept(steps, routes.withColumn("step_count", F.lit(2).cast("long")), edges, built)
    assert not broken["accepted"] and broken["integrity"]["step_count_mismatch"] == 10
    with pytest.raises(PermissionError):
        acceptance.lock(broken, {}, "v")
    vectors = index.route_index(built).collect()
    assert len(vectors) == 10 and all(sum(w * w for w in r["weights"]) == pytest.approx(1) for r in vectors)


def test_blend(spark):
    model = spark.createDataFrame([(1, "a", 0.6, "f"), (1, "b", 0.4, "f")], "query_id int, label string, probability double, query_family string")
    found = spark.createDataFrame([(1, 0.9, "f", "b"), (1, 0.3, "g", "a")], "query_id int, score double, reaction_family string, target string")
    row = inference.blend(model, found, "target").first()
    expected = {"a": 0.55 * 0.6 + 0.25 * 0.25 + 0.05, "b": 0.55 * 0.4 + 0.25 * 0.75 + 0.15 + 0.05}
    assert {p["label"]: p["score"] for p in row["predictions"]} == pytest.approx(expected) and row["applicability"] == "in_domain" and not row["abstained"]
    far = inference.blend(model, found.withColumn("score", F.lit(0.1)), "target").first()
    assert far["abstained"] and far["applicability"] == "out_of_domain" and inference.applicability_of(0.5) == "near_domain"
    shares = aggregates.neighbour_distribution(found.withColumn("target", F.lit("nan")), "query_id", "target", "score")
    assert shares.count() == 0


def test_jobs(spark):
    jobs = Jobs(spark)
    good, bad = jobs.submit(lambda: spark.range(5).count()), jobs.submit(lambda: 1 / 0)
    for _ in range(100):
        if all(jobs.state(j)["status"] in ("completed", "failed") for j in (good, bad)):
            break
        time.sleep(0.2)
    assert jobs.state(good) == {"status": "completed", "result": 5} and jobs.state(bad)["status"] == "failed"
