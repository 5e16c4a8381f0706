"""All registered queries, and their SQL with the views inlined."""

from __future__ import annotations

import re

from voxlake.workload import box_queries, job_queries, table_queries, views
from voxlake.workload.registry import Query

_MODULES = (box_queries, table_queries, job_queries)

# view name -> SQL; later views may read earlier ones
_VIEWS = {
    "cases": views.CASES_SQL,
    "proposals": views.PROPOSALS_SQL,
    "truth": views.TRUTH_SQL,
    "truth_boxes": box_queries.TRUTH_BOX_SQL,
    "voxels": views.VOXELS_SQL,
    "log_lines": views.LOG_SQL,
    "metrics": views.METRICS_SQL,
    "files": views.FILES_SQL,
    "tiles": views.TILES_SQL,
    "features": views.FEATURES_SQL,
    "tile_features": views.TILE_FEATURES_SQL,
    "headers": views.HEADERS_SQL,
    "slots": views.SLOTS_SQL,
    "runs": views.RUNS_SQL,
    "sweep": views.SWEEP_SQL,
    "split": box_queries.FOLDS_SQL,
}


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"(?:FROM|JOIN)\s+{name}\b", sql) is not None


def with_views(body: str) -> str:
    """The query with the views it reads, directly or through other views, as CTEs."""
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        text = frontier.pop()
        for name, sql in _VIEWS.items():
            if name not in needed and _mentions(text, name):
                needed.add(name)
                frontier.append(sql)
    ctes = [f"{name} AS ({sql.strip()})" for name, sql in _VIEWS.items() if name in needed]
    recursive = "WITH RECURSIVE " if "RECURSIVE" in body else "WITH "
    own = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", body)
    if not ctes:
        return body.strip()
    joiner = ",\n" if own != body else "\n"
    return recursive + ",\n".join(ctes) + joiner + own.strip()


def queries() -> dict[str, Query]:
    return {name: fn for m in _MODULES for name, fn in m.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for m in _MODULES for name, sql in m.REGISTRY.bodies.items()}
