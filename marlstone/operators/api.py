"""Requests to the read API as DataFrames and status codes, without a transport (API-01..10)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .engine import CatalogEngine, bounded_params

MOST_URL = 4096
_COVERAGE = "known_products bigint, known_opportunities bigint, product_revisions bigint, opportunity_revisions bigint, published_products bigint, published_opportunities bigint"
_SIDE = "struct<id: string, revision_id: string, observed_at: string, document: string>"
_OPPORTUNITY = (
    "opportunity_id string, publication struct<published_at: string, product_review_event_id: string, opportunity_review_event_id: string>, "
    f"product {_SIDE}, opportunity {_SIDE}, facets array<struct<namespace: string, concept_id: string, basis: string>>, capabilities array<struct<id: string, basis: string>>, "
    "sources array<struct<source_snapshot_id: string, source_identity: string, source_kind: string, source_locator: string, source_name: string, source_url: string, observed_at: string, content_hash: string>>, "
    "evidence array<struct<source_snapshot_id: string, evidence_key: string, quote: string, start_offset: int, end_offset: int>>"
)


@dataclass(frozen=True)
class Route:
    path: str
    rows: Callable[..., DataFrame]  # (engine, queue, params, *parts of the path)
    response: str  # DDL of a row
    one: bool = False  # no row means 404


def _limit(params: dict[str, list[str]]) -> int:
    return bounded_params({k: v for k, v in params.items() if k == "limit"})[2]


def _found(engine: CatalogEngine, rows: DataFrame) -> DataFrame:
    return engine.hydrate(rows).select(*[f.name for f in _schema(_OPPORTUNITY)])


def _search(engine: CatalogEngine, params: dict[str, list[str]]) -> DataFrame:
    q, wanted, limit = bounded_params(params)
    return _found(engine, engine.search(q, wanted, limit))


def _opportunity(engine: CatalogEngine, key: str) -> DataFrame:
    return engine.opportunity(key).select(*[f.name for f in _schema(_OPPORTUNITY)])


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


ROUTES = [
    Route("/health", lambda e, q, p: e.health(), f"status string, catalog_kind string, contract_version string, vocabulary_version string, {_COVERAGE}"),
    Route("/v1/coverage", lambda e, q, p: e.coverage(), _COVERAGE),
    Route("/v1/needs", lambda e, q, p: e.needs(), "need_id string, label string"),
    Route("/v1/capabilities", lambda e, q, p: e.capabilities(), "concept_id string, label string, opportunity_count bigint"),
    Route("/v1/opportunities", lambda e, q, p: _search(e, p), _OPPORTUNITY),
    Route("/v1/opportunities/{id}", lambda e, q, p, key: _opportunity(e, key), _OPPORTUNITY, one=True),
    Route(
        "/v1/evidence/{snapshot}/{evidence}", lambda e, q, p, s, k: e.evidence(s, k),
        "source_snapshot_id string, evidence_key string, quote string, start_offset int, end_offset int, source_kind string, source_locator string, source_name string, source_url string, source_observed_at string", one=True,
    ),
    Route("/v1/reviews", lambda e, q, p: e.reviews(q, (p.get("status") or ["open"])[0], _limit(p)), "review_id string, status string, created_at string"),
]


def contract() -> dict:
    """API-10: every path with the shape of a row of its answer."""
    return {"version": "0.1.0", "paths": {r.path: {"get": {"row": _schema(r.response).jsonValue(), "may_be_missing": r.one}} for r in ROUTES}}


def respond(engine: CatalogEngine, url: str, method: str = "GET", queue: DataFrame | None = None) -> tuple[int, DataFrame | dict | str]:
    """API-09: (status, rows), or (status, message) of what is not served.

    405 for anything but GET, 414 above ``MOST_URL`` characters, 400 for parameters out of
    bounds, 404 for unknown paths and for single things that are not there.
    """
    if method != "GET":
        return 405, "only GET is served"
    if len(url) > MOST_URL:
        return 414, f"a URL has at most {MOST_URL} characters"
    parts = urlsplit(url)
    if parts.path in ("/", "/openapi.json"):
        return 200, contract()
    params = parse_qs(parts.query, keep_blank_values=True)
    for r in ROUTES:
        hit = re.fullmatch(re.sub(r"\{\w+\}", "([^/]+)", r.path), parts.path)
        if not hit:
            continue
        try:
            rows = r.rows(engine, queue, params, *map(unquote, hit.groups()))
        except ValueError as e:
            return 400, str(e)
        if r.one and rows.isEmpty():
            return 404, "not found"
        return 200, rows
    return 404, "no such path"
