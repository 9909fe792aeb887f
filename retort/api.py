"""HTTP surface: a WSGI application over the tables, models and jobs of a workflow's root (GV11).

    python -m retort.cli serve --root OUT --port 8000 [--key KEY]

Paths are a table of (method, path, handler, fields of the request); a field that isn't in it is refused. Long work runs
as jobs, two at a time. With a key, every path but the page, the metrics and the health checks needs it in X-API-Key.
"""

from __future__ import annotations

import hmac
import json
import re
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from http import HTTPStatus
from typing import Any
from urllib.parse import parse_qs, unquote

from pyspark.sql import SparkSession

from retort import __version__
from retort.answers import MOST_REACTIONS, Answers, NotReady
from retort.governance.registry import Registry
from retort.ml import tasks
from retort.service import Jobs, Routes
from retort.sources.datasets import _exists, read_dataset
from retort.stages.mapping import MappingConfig
from retort.workflow import Workflow

NEEDED = object()
MOST_BYTES = 8 << 20
#: name: (type, default or NEEDED, least, most); for texts least and most are lengths.
Field = tuple[type, Any, float | None, float | None]
TEXT, K = (str, NEEDED, 3, 100_000), (int, 5, 0, 50)
ASKED: dict[str, Field] = {"reaction_smiles": TEXT, "include_evidence": (bool, True, None, None), "evidence_k": K}
TASKS: dict[str, Field] = {"tasks": (list, None, None, None), "allow_experimental": (bool, False, None, None)}
MANY: dict[str, Field] = {"reactions": (list, NEEDED, None, None), "include_evidence": (bool, True, None, None), "evidence_k": (int, 5, 0, 25)}
SHARE: Field = (float, NEEDED, 0.0, 1.0)
READY = {"context": "context/steps", "mapping": "mapping/all", "derivation": "derivation/all", "canonical": "final/steps", "index": "index/reactions"}

PAGE = """<!doctype html><meta charset=utf-8><title>retort</title><h1>retort</h1>
<form onsubmit="event.preventDefault();fetch('/api/v2/inference/contextual',{method:'POST',headers:{'X-API-Key':key.value},body:JSON.stringify({reaction_smiles:r.value})}).then(x=>x.text()).then(x=>out.textContent=x)">
<input id=r size=60 placeholder="CCO>>CC=O"><input id=key placeholder="key"><button>Ask</button></form><pre id=out></pre>"""


class Refused(Exception):
    def __init__(self, status: HTTPStatus, text: str):
        super().__init__(text)
        self.status = status


def checked(given: dict, fields: dict[str, Field]) -> dict:
    """The request's values by the table of fields, with defaults."""
    if not isinstance(given, dict):
        raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, "an object is expected")
    if strange := set(given) - set(fields):
        raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"unknown fields {sorted(strange)}")
    out = {}
    for name, (kind, default, least, most) in fields.items():
        value = given.get(name, default)
        if value is NEEDED:
            raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"{name} is needed")
        if value is not None:
            if kind is float and isinstance(value, int) and not isinstance(value, bool):
                value = float(value)
            if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
                raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"{name} must be of type {kind.__name__}")
            size = len(value) if kind is str else value
            if (least is not None and size < least) or (most is not None and size > most):
                raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"{name} is out of range")
        out[name] = value
    return out


class Api:
    def __init__(self, spark: SparkSession, root: str, artifact: str | None = None, key: str | None = None, version: str = "v2"):
        self.spark, self.root, self.artifact, self.key = spark, root, artifact, key
        self.flow, self.jobs = Workflow(spark, root, version), Jobs(spark)
        self.registry = Registry(spark, f"{root}/registry", read_only=True)
        self.answers = Answers(spark, root, self.registry)
        self.detail: dict[str, dict] = {}
        self.requests: Counter = Counter()
        self.seconds: Counter = Counter()
        get, post = "GET", "POST"
        known = [*tasks.CLASSIFIERS, *tasks.MULTILABEL, *tasks.REGRESSIONS]
        self.known = known
        rows: list[tuple[str, str, Callable, dict[str, Field]]] = [
            (get, "/health", self.health, {}),
            (get, "/api/v1/datasets", lambda: {"active": self._sizes("canonical/steps", "canonical/routes")}, {}),
            (get, "/api/v1/models", lambda: [r.asDict() for r in self.registry.models().collect()], {}),
            (post, "/api/v1/inference/parse-quality", lambda **a: self._one(["parse_validity"], **a), ASKED),
            (post, "/api/v1/inference/conditions", lambda **a: self._one(None, **a), ASKED | TASKS),
            (post, "/api/v1/inference/batch", lambda **a: self._many("predictions", **(a | {"include_evidence": False})), MANY | TASKS),
            (get, "/api/v1/routes/{id}", lambda id: self.route("canonical", id), {}),
            (get, "/api/v1/search", self.search, {"patent_document_id": (str, None, None, None), "text": (str, "", None, None), "split": (str, None, None, None), "limit": (int, 25, 1, 250)}),
            (post, "/api/v1/jobs/train", self.train, {"tasks": (list, None, None, None)}),
            (get, "/api/v1/jobs/{id}", self.job, {}),
            (get, "/api/v2/health", lambda: {"status": "ok", "version": __version__} | self._ready(), {}),
            (get, "/api/v2/datasets", lambda: {"baseline": self._sizes("canonical/steps", "canonical/routes"), "contextual": self._sizes("final/steps", "final/routes")}, {}),
            (post, "/api/v2/inference/contextual", lambda **a: self._one(None, **a), ASKED | TASKS),
            (post, "/api/v2/inference/repair", self.answers.repair, {"reaction_smiles": (str, NEEDED, 1, 100_000), "contextual_candidate": (str, None, None, 100_000), "route_continuity_score": (float, 0.0, 0.0, 1.0)}),
            (post, "/api/v2/inference/anomaly", self.answers.anomaly, {"reaction_smiles": TEXT, "temperature_c": (float, None, None, None), "time_h": (float, None, 0.0, None)}),
            (post, "/api/v2/inference/route-quality", self.answers.route_quality, dict.fromkeys(("parse", "resolution", "route_continuity", "condition_completeness", "condition_plausibility", "mapping"), SHARE)),
            (post, "/api/v2/inference/batch", lambda **a: self._many("results", **a), MANY | TASKS),
            (get, "/api/v2/routes/{id}", lambda id: self.route("final", id), {}),
            (post, "/api/v2/jobs/freeze-baseline", lambda: self.submit(self.flow.freeze), {}),
            (post, "/api/v2/jobs/build-contextual", lambda: self.submit(self.flow.context), {}),
            (post, "/api/v2/jobs/map-reactions", self.map_reactions, {"fallback": (bool, True, None, None), "batch_size": (int, 16, 1, 512), "token_limit": (int, 512, 32, 8192), "seconds": (int, 30, 1, 600)}),
            (post, "/api/v2/jobs/derive-reaction-centres", lambda: self.submit(self.flow.derivation), {}),
            (post, "/api/v2/jobs/build-index", lambda: self.submit(self.flow.indexes), {}),
            (post, "/api/v2/jobs/train", self.train, {"tasks": (list, None, None, None)}),
            (post, "/api/v2/jobs/validate", lambda: self.submit(self.flow.validation), {}),
            (post, "/api/v2/jobs/lock-release", lambda release_id: self.submit(lambda: self.flow.lock(release_id), release_id=release_id), {"release_id": (str, "v2.0.0", 1, 80)}),
            (get, "/api/v2/jobs/{id}", self.job, {}),
        ]
        self.paths = [(m, re.compile("^" + re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", p) + "$"), p, h, f) for m, p, h, f in rows]

    # what the paths answer

    def _ready(self) -> dict:
        return {f"{k}_ready": _exists(self.spark, f"{self.root}/{v}") for k, v in READY.items()}

    def health(self) -> dict:
        return {"status": "ok", "version": __version__, "models": self.registry.models().count(), "baseline_frozen": self.registry.release("v1.0.0-baseline") is not None} | self._ready()

    def _sizes(self, *names: str) -> dict:
        return {n: read_dataset(self.spark, self.root, n).count() for n in names if _exists(self.spark, f"{self.root}/{n}")}

    def _names(self, chosen: list | None) -> list[str]:
        chosen = chosen or ["solvent_multilabel", "time_regression", "temperature_regression", "agent_multilabel"]
        if strange := [x for x in chosen if x not in self.known]:
            raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"unknown tasks {strange}")
        return chosen

    def _one(self, names: list[str] | None, reaction_smiles: str, include_evidence: bool, evidence_k: int, tasks: list | None = None, allow_experimental: bool = False) -> dict:
        return self.answers.predict([reaction_smiles], names or self._names(tasks), evidence_k, include_evidence, allow_experimental)[0]

    def _many(self, under: str, reactions: list, include_evidence: bool, evidence_k: int, tasks: list | None, allow_experimental: bool) -> dict:
        if not reactions or len(reactions) > MOST_REACTIONS:
            raise Refused(HTTPStatus.REQUEST_ENTITY_TOO_LARGE if reactions else HTTPStatus.UNPROCESSABLE_ENTITY, f"1 to {MOST_REACTIONS} reactions")
        found = self.answers.predict([str(r) for r in reactions], self._names(tasks or ["parse_failure_class", "reaction_family"]), evidence_k, include_evidence, allow_experimental)
        return {"rows": len(found), under: found}

    def _routes(self, kind: str) -> Routes:
        names = ("final/routes", "final/steps") if kind == "final" else ("context/routes", "context/steps")
        if not _exists(self.spark, f"{self.root}/{names[0]}"):
            raise NotReady(f"{names[0]} has not been built")
        return Routes(*[read_dataset(self.spark, self.root, n) for n in (*names, "context/route_edges")])

    def route(self, kind: str, route_id: str) -> dict:
        found = self._routes(kind).get(route_id)
        if found is None:
            raise Refused(HTTPStatus.NOT_FOUND, "no such route")
        return found

    def search(self, patent_document_id: str | None, text: str, split: str | None, limit: int) -> list[dict]:
        return self._routes("final").find(patent_document_id or text, split=split, limit=limit)

    def submit(self, work: Callable[[], object], **detail) -> dict:
        ident = self.jobs.submit(work)
        self.detail[ident] = detail
        return {"job_id": ident, "status": "queued", "detail": detail}

    def train(self, tasks: list | None) -> dict:
        names = self._names(tasks or ["parse_failure_class", "reaction_family"])
        from retort.ml.tasks import CLASSIFIERS

        plain, special = tuple(n for n in names if n in CLASSIFIERS), tuple(n for n in names if n not in CLASSIFIERS)
        return self.submit(lambda: self.flow.training(plain) | self.flow.specialist(special), tasks=names)

    def map_reactions(self, fallback: bool, batch_size: int, token_limit: int, seconds: int) -> dict:
        config = MappingConfig(fallback=fallback, batch=batch_size, token_limit=token_limit, seconds=seconds)
        return self.submit(lambda: self.flow.mapping(config), fallback=fallback, batch_size=batch_size, token_limit=token_limit, seconds=seconds)

    def job(self, id: str) -> dict:
        if id not in self.jobs.jobs:
            raise Refused(HTTPStatus.NOT_FOUND, "no such job")
        state = self.jobs.state(id)
        return {"job_id": id, "status": state["status"], "detail": self.detail.get(id, {}) | {k: v for k, v in state.items() if k != "status"}}

    def metrics(self) -> str:
        lines = ["# TYPE retort_http_requests_total counter"]
        lines += [f'retort_http_requests_total{{method="{m}",path="{p}",status="{s}"}} {n}' for (m, p, s), n in sorted(self.requests.items())]
        lines += ["# TYPE retort_http_request_seconds_total counter", *[f'retort_http_request_seconds_total{{method="{m}",path="{p}"}} {n:.6f}' for (m, p), n in sorted(self.seconds.items())]]
        return "\n".join(lines) + "\n"

    # the protocol

    def answer(self, method: str, path: str, query: str = "", body: bytes = b"", key: str | None = None) -> tuple[HTTPStatus, str, str, str]:
        """(status, content type, text, path of the table)."""
        if method == "GET" and path in ("/", "/metrics"):
            return HTTPStatus.OK, *(("text/html; charset=utf-8", PAGE) if path == "/" else ("text/plain; version=0.0.4", self.metrics())), path
        shown = "unknown"
        try:
            hits = [(m, found, p, h, f) for m, pattern, p, h, f in self.paths if (found := pattern.match(path))]
            if not hits:
                raise Refused(HTTPStatus.NOT_FOUND, "no such path")
            shown = hits[0][2]
            own = [x for x in hits if x[0] == method]
            if not own:
                raise Refused(HTTPStatus.METHOD_NOT_ALLOWED, f"{method} isn't taken here")
            _, found, shown, handler, fields = own[0]
            if self.key and not shown.endswith("/health") and not hmac.compare_digest(key or "", self.key):
                raise Refused(HTTPStatus.UNAUTHORIZED, "a valid key is needed")
            try:
                given = json.loads(body) if method == "POST" and body else {k: int(v[0]) if fields.get(k, (str,))[0] is int else v[0] for k, v in parse_qs(query).items()}
            except ValueError as problem:
                raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"can't be read: {problem}") from problem
            value = handler(**checked(given, fields), **{k: unquote(v) for k, v in found.groupdict().items()})
            return HTTPStatus.OK, "application/json", json.dumps(value, default=str), shown
        except Refused as problem:
            return problem.status, "application/json", json.dumps({"detail": str(problem)}), shown
        except NotReady as problem:
            return HTTPStatus.CONFLICT, "application/json", json.dumps({"detail": str(problem)}), shown

    def __call__(self, environ: dict, start: Callable) -> Iterable[bytes]:
        began, method = time.perf_counter(), environ["REQUEST_METHOD"]
        request = environ.get("HTTP_X_REQUEST_ID") or uuid.uuid4().hex
        size = int(environ.get("CONTENT_LENGTH") or 0)
        if size > MOST_BYTES:
            status, kind, text, path = HTTPStatus.REQUEST_ENTITY_TOO_LARGE, "application/json", '{"detail": "too long"}', "unknown"
        else:
            try:
                status, kind, text, path = self.answer(method, environ.get("PATH_INFO", "/"), environ.get("QUERY_STRING", ""), environ["wsgi.input"].read(size), environ.get("HTTP_X_API_KEY"))
            except Exception:
                self.requests[method, "unknown", 500] += 1
                raise
        self.requests[method, path, status.value] += 1
        self.seconds[method, path] += time.perf_counter() - began
        start(f"{status.value} {status.phrase}", [("Content-Type", kind), ("X-Request-ID", request)])
        return [text.encode()]


def serve(api: Api, port: int = 8000, host: str = "127.0.0.1") -> None:
    from socketserver import ThreadingMixIn
    from wsgiref.simple_server import WSGIServer, make_server

    class Threads(ThreadingMixIn, WSGIServer):
        daemon_threads = True

    make_server(host, port, api, server_class=Threads).serve_forever()
