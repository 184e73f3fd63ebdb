"""Questions about one model as named tools with JSON answers, for agents and the command line."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from .api import TABLES, Model

LIMIT = 200
Tool = Callable[..., object]
TOOLS: dict[str, Tool] = {}


def tool(f: Tool) -> Tool:
    TOOLS[f.__name__] = f
    return f


def rows(df: DataFrame, limit: int = LIMIT) -> dict:
    """Up to limit rows, with whether there were more."""
    found = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    return {"rows": found[:limit], "truncated": len(found) > limit}


def call(model: Model, name: str, **arguments: object) -> str:
    """A tool's answer as JSON; unknown tools raise with the known ones."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name!r}; known: {', '.join(sorted(TOOLS))}")
    return json.dumps(TOOLS[name](model, **arguments), default=str)


@tool
def header(m: Model) -> dict:
    return m.header


@tool
def summary(m: Model) -> dict:
    return m.summary()


@tool
def types(m: Model) -> dict:
    return {r.entity: r.n for r in m.types_count().orderBy("entity").collect()}


@tool
def schemas(m: Model) -> dict:
    return m.schemas()


@tool
def preview(m: Model, table: str, n: int = 5) -> dict:
    return rows(m.preview(table, n), n)


@tool
def products(m: Model, entity: str | None = None, mode: str | None = None, storey_guid: str | None = None, limit: int = LIMIT) -> dict:
    return rows(m.filter(entity, mode, storey_guid).orderBy("guid"), limit)


@tool
def by_type(m: Model, entity: str, include_subtypes: bool = True, limit: int = LIMIT) -> dict:
    return rows(m.by_type(entity, include_subtypes).orderBy("guid"), limit)


@tool
def product(m: Model, guid: str) -> dict | None:
    return m.product(guid)


@tool
def card(m: Model, guid: str, limit: int = 50) -> dict:
    return m.card(guid, limit)


@tool
def storeys(m: Model, limit: int = LIMIT) -> dict:
    return rows(m.storeys.orderBy("elevation", "guid"), limit)


@tool
def spaces(m: Model, limit: int = LIMIT) -> dict:
    return rows(m.spaces().orderBy("guid"), limit)


@tool
def parent(m: Model, guid: str) -> dict:
    return rows(m.parent(guid))


@tool
def children(m: Model, guid: str, limit: int = LIMIT) -> dict:
    return rows(m.children(guid).orderBy("child_guid"), limit)


@tool
def ancestors(m: Model, guid: str) -> dict:
    return rows(m.ancestors(guid))


@tool
def descendants(m: Model, guid: str, limit: int = LIMIT) -> dict:
    return rows(m.descendants(guid), limit)


@tool
def storey_of(m: Model, guid: str) -> str | None:
    return m.storey_of(guid)


@tool
def psets(m: Model, guid: str | None = None, pset_name: str | None = None, prop_name: str | None = None, limit: int = LIMIT) -> dict:
    return rows(m.find("psets", guid, limit + 1, pset_name=pset_name, prop_name=prop_name), limit)


@tool
def quantities(m: Model, guid: str | None = None, qto_name: str | None = None, quantity_name: str | None = None, limit: int = LIMIT) -> dict:
    return rows(m.find("quantities", guid, limit + 1, qto_name=qto_name, quantity_name=quantity_name), limit)


@tool
def materials(m: Model, guid: str | None = None, material_name: str | None = None, limit: int = LIMIT) -> dict:
    return rows(m.find("materials", guid, limit + 1, material_name=material_name), limit)


@tool
def classifications(m: Model, guid: str | None = None, limit: int = LIMIT) -> dict:
    return rows(m.find("classifications", guid, limit + 1), limit)


@tool
def type_summary(m: Model, sample_guids: int = 3) -> dict:
    return rows(m.type_summary(sample_guids).orderBy("entity"))


@tool
def type_bank(m: Model) -> dict:
    return rows(m.type_bank().orderBy("entity"))


@tool
def drift(m: Model, n: int = 20) -> dict:
    """The products farthest from their placement that are not ok."""
    from pyspark.sql import functions as F

    return rows(m.drift().where("severity <> 'ok'").orderBy(F.desc("drift_distance"), "guid"), n)


@tool
def tables(m: Model) -> list[str]:
    return list(TABLES)
