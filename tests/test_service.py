"""The workflow from an artifact to a served answer, through the HTTP surface."""

import json
import time
import zipfile

import pytest

from retort.api import Api
from retort.governance.registry import Registry
from retort.ml import train
from retort.workflow import Workflow

REACTIONS = ("CCO>O.25.3600>CC=O", "CC(=O)Cl.NCC>O.40.7200>CC(=O)NCC", "CC=O>CO.10.3600>CCO", "CCBr.N>O.60.1800>CCN")


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("root"))
    steps = ["route_id,step_index,step_working_reaction_smiles,step_parse_ok,step_solvent_list_norm,step_agent_or_spectator_list_norm,temperature_c_primary,time_h_primary"]
    routes = ["route_id,multistep_reaction_text,route_step_count,route_parse_ok"]
    for i in range(24):
        route = f"2020{i:04d}-US{i // 2}A1-0001"
        text = REACTIONS[i % 4]
        steps.append(f"{route},0,{text},true,\"['O']\",\"[]\",25,1")
        routes.append(f"{route},{text},1,true")
    archive = f"{root}/in.zip"
    with zipfile.ZipFile(archive, "w") as made:
        made.writestr("release/steps.csv", "\n".join(steps))
        made.writestr("release/routes.csv", "\n".join(routes))
    flow = Workflow(spark, root)
    flow.run(archive, "canonical", "indexes")
    return Api(spark, root, archive, key="secret")


def ask(api, method, path, body=None, query="", key="secret"):
    status, _, text, _ = api.answer(method, path, query, json.dumps(body).encode() if body is not None else b"", key)
    return status.value, json.loads(text)


def test_reads(api):
    assert ask(api, "GET", "/health", key=None)[1]["index_ready"] and ask(api, "GET", "/api/v2/health", key=None)[0] == 200
    assert ask(api, "GET", "/api/v1/models", key="wrong")[0] == 401 and ask(api, "GET", "/api/v1/models") == (200, [])
    assert ask(api, "GET", "/api/v2/datasets")[1]["contextual"]["final/steps"] == 24
    found = ask(api, "GET", "/api/v1/search", query="limit=3")[1]
    assert len(found) == 3
    status, route = ask(api, "GET", f"/api/v2/routes/{found[0]['route_id']}")
    assert status == 200 and len(route["steps"]) == 1 and ask(api, "GET", "/api/v2/routes/none")[0] == 404
    assert ask(api, "GET", "/nowhere")[0] == 404 and ask(api, "GET", "/api/v1/jobs/train")[0] in (404, 405)


def test_answers(api):
    status, got = ask(api, "POST", "/api/v2/inference/contextual", {"reaction_smiles": "CCO>>CC=O", "tasks": ["reaction_family"], "evidence_k": 3})
    assert status == 200 and got["parse_ok"] and got["applicability"] == "in_domain" and len(got["evidence"]) == 3 and got["tasks"][0]["reason"] == "no_served_model"
    assert ask(api, "POST", "/api/v2/inference/batch", {"reactions": ["CCO>>CC=O", "CC(>>C"], "tasks": ["reaction_family"]})[1]["rows"] == 2
    assert ask(api, "POST", "/api/v2/inference/repair", {"reaction_smiles": "CCO>>>>CC=O"})[1]["candidates"][0]["parse_valid"]
    parts = dict.fromkeys(("parse", "resolution", "route_continuity", "condition_completeness", "condition_plausibility", "mapping"), 0.5)
    assert ask(api, "POST", "/api/v2/inference/route-quality", parts)[1]["route_quality_score"] == 0.5
    assert ask(api, "POST", "/api/v2/inference/anomaly", {"reaction_smiles": "CCO>>CC=O", "temperature_c": 900})[1]["anomaly_score"] == 1.0
    assert ask(api, "POST", "/api/v2/inference/route-quality", parts | {"mapping": 2})[0] == 422
    assert ask(api, "POST", "/api/v2/inference/repair", {"reaction_smiles": "C", "odd": 1})[0] == 422 and ask(api, "POST", "/api/v2/inference/repair", {})[0] == 422


def test_jobs_and_protocol(api):
    status, job = ask(api, "POST", "/api/v2/jobs/freeze-baseline", {})
    for _ in range(240):
        state = ask(api, "GET", f"/api/v2/jobs/{job['job_id']}")[1]
        if state["status"] in ("completed", "failed"):
            break
        time.sleep(0.5)
    assert state["status"] == "completed" and state["detail"]["result"]["release"] == "v1.0.0-baseline"
    assert ask(api, "GET", "/health")[1]["baseline_frozen"]
    assert api.flow.freeze()["digests"] == state["detail"]["result"]["digests"] and api.flow.check_release()["passed"]
    heads = []
    import io

    body = b"".join(api({"REQUEST_METHOD": "GET", "PATH_INFO": "/metrics", "wsgi.input": io.BytesIO()}, lambda status, headers: heads.append((status, dict(headers)))))
    assert heads[0][0] == "200 OK" and "X-Request-ID" in heads[0][1] and b"retort_http_requests_total" in body


def test_models_come_back(spark, tmp_path):
    rows = [(f"{'CCO' if i % 2 else 'CCN'}{'C' * (i % 7)}>>C", "yes" if i % 2 else "no", ["a", "b"] if i % 2 else ["b", "c"], ("train", "train", "val", "test")[i // 2 % 4], float(i % 2), "f") for i in range(240)]
    steps = spark.createDataFrame(rows, "t string, y string, m array<string>, split string, v double, reaction_family string")
    asked = spark.createDataFrame([(1, "CCOC>>C", "f"), (2, "CCNC>>C", "f")], "query_id int, text string, family string")
    plain = train.train_classifier(steps, "demo", "y", "t", size=1 << 10)
    train.save(plain, f"{tmp_path}/plain")
    said = {r["query_id"]: r["label"] for r in train.label_probabilities(train.load(spark, f"{tmp_path}/plain"), asked, "text").where("probability > 0.5").collect()}
    assert said == {1: "yes", 2: "no"}
    several = train.train_multilabel(steps, "demo", "m", "t", minimum=20, size=1 << 10)
    train.save(several, f"{tmp_path}/several")
    back = train.label_probabilities(train.load(spark, f"{tmp_path}/several"), asked, "text")
    assert {(r["query_id"], r["label"]) for r in back.where("probability > 0.5").collect()} == {(1, "a"), (2, "c")}
    line = train.train_regression(steps, "demo", "v", "t", size=1 << 10)
    train.save(line, f"{tmp_path}/line")
    values = {r["query_id"]: r for r in train.predict_value(train.load(spark, f"{tmp_path}/line"), asked, "text", "family").collect()}
    assert values[1]["predicted"] > values[2]["predicted"] and values[1]["low"] <= values[1]["predicted"] <= values[1]["high"]


def test_releases_lock_once(spark, tmp_path):
    registry = Registry(spark, f"{tmp_path}/registry")
    assert registry.register_release("r1", {"a": 1}) == {"a": 1} and registry.release("r1") == {"a": 1} and registry.release("r2") is None
    with pytest.raises(PermissionError):
        registry.register_release("r1", {"a": 2})


@pytest.mark.parametrize(
    ("words", "expected"),
    [
        (["audit-source", "{root}/in.zip"], '"release/steps.csv"'),
        (["benchmark-mapper", "--root", "{root}", "--sizes", "4", "--rows", "8"], '"recommended": true'),
        (["identity", "--root", "{root}"], '"routes_without_steps": 0'),
        (["check-release", "--root", "{root}"], '"passed": true'),
        (["anomaly", "--root", "{root}"], '"anomaly": '),
        (["export", "--root", "{root}", "--target", "{root}/out"], '"digest"'),
        (["search", "--root", "{root}", "--limit", "2"], '"route_id"'),
        (["models", "--root", "{root}"], "[]"),
    ],
)
def test_commands(api, capsys, words, expected):
    from retort import cli

    if words[0] == "models":
        words = ["models", "--root", "{root}/fresh"]
    assert cli.main([w.format(root=api.root) for w in words]) == 0 and expected in capsys.readouterr().out
