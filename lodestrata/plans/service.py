"""What a service around the engine needs of it: requests with defaults, a token check, readiness and health."""

from __future__ import annotations

import hmac
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.sources.store import missing_paths

REQUEST = "query_id long, query string, collection_name string, history string, template_type string, strict_mode boolean, last_context string"


class Refused(Exception):
    """A request that is not answered, with the status that says why."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


def check_token(header: str | None, expected: str | None) -> None:
    """Refuses with 503 where no token is set, with 401 where the header does not carry it; compared in constant time."""
    wanted = (expected or "").strip()
    if not wanted:
        raise Refused(503, "no token is set for this service")
    scheme, _, given = (header or "").partition(" ")
    if scheme != "Bearer":
        raise Refused(401, "a bearer token is needed")
    if not hmac.compare_digest(given.strip().encode(), wanted.encode()):
        raise Refused(401, "wrong token")


def requests(spark: SparkSession, asked: list[dict]) -> DataFrame:
    """Questions of `answered` from requests: query and collection_name are needed, the rest has defaults."""
    rows = []
    for i, r in enumerate(asked):
        for name in ("query", "collection_name"):
            if not isinstance(r.get(name), str):
                raise Refused(422, f"{name} is missing")
        turns = [t for t in r.get("history") or [] if isinstance(t.get("content"), str)]
        history = "\n".join(("User: " if t.get("role") == "user" else "Assistant: ") + t["content"] for t in turns)
        said = [t.get("context_text") for t in turns if t.get("role") != "user"]
        rows.append((i, r["query"], r["collection_name"], history, r.get("template_type", "General"), bool(r.get("strict_mode", False)), said[-1] if said else None))
    return spark.createDataFrame(rows, REQUEST)


def ask(spark: SparkSession, request: dict, header: str | None, token: str | None, required: list[str], answer: Callable[[DataFrame], DataFrame]) -> dict:
    """One request as a dictionary of its answer's fields; `answer` is a plan such as `answered` with its models bound."""
    check_token(header, token)
    if missing := missing_paths(required, spark):
        raise Refused(503, "missing: " + ", ".join(missing))
    return answer(requests(spark, [request])).first().asDict(recursive=True)


def health(model: str, **settings: object) -> dict:
    """What a model boundary reports of itself."""
    return {"status": "ok", "model": model, **settings}
