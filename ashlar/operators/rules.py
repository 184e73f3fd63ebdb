"""Floor labelling rules: prefix rules as columns, own callables, project files, a registry by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.step import store
from .summaries import cluster_elevations, floor_labels


@dataclass(frozen=True)
class Cluster:
    """What a rule sees of one floor: its members' names, the commonest of them, and the mean elevation."""

    names: tuple[str, ...]
    most_common_name: str
    elevation_mm: float


@dataclass(frozen=True)
class PrefixRule:
    """An override of any member decides; else the commonest name, cleaned, with the prefix unless it has it or is final."""

    prefix: str = ""
    overrides: dict[str, str] = field(default_factory=dict)
    idempotent_labels: tuple[str, ...] = ()
    apply_drop_leading_zero: bool = True

    def labels(self, clustered: DataFrame, group: str = "model_name") -> DataFrame:
        return floor_labels(clustered, group, self.prefix, self.overrides, tuple(self.idempotent_labels), self.apply_drop_leading_zero)


Rule = PrefixRule | Callable[[Cluster], str]
_RULES: dict[str, Rule] = {"default": PrefixRule()}


def register_rule(name: str, rule: Rule) -> None:
    _RULES[name] = rule


def get_rule(name: str) -> Rule:
    if name not in _RULES:
        raise KeyError(f"unknown rule {name!r}; known: {', '.join(known_rules())}")
    return _RULES[name]


def known_rules() -> list[str]:
    return sorted(_RULES)


def rule_from_yaml(path: str) -> PrefixRule:
    """The rule that a project file states with prefix, overrides, idempotent_labels and apply_drop_leading_zero, all optional."""
    import yaml  # only project files need it

    files: fs.FileSystem
    files, inner = store(path)
    with files.open_input_stream(inner) as f:
        stated = yaml.safe_load(f.read()) or {}
    unknown = set(stated) - {"prefix", "overrides", "idempotent_labels", "apply_drop_leading_zero"}
    if unknown:
        raise ValueError(f"unknown keys in {path}: {', '.join(sorted(unknown))}")
    return PrefixRule(stated.get("prefix") or "", dict(stated.get("overrides") or {}), tuple(stated.get("idempotent_labels") or ()), stated.get("apply_drop_leading_zero", True))


def federated_floors(storeys: DataFrame, tolerance_mm: float = 100.0, rule: Rule | str = "default", group: str = "model_name") -> DataFrame:
    """storeys(model_name, storey_name, elevation_mm, storey_guid) with cluster and label.

    A prefix rule is worked out as columns; any other callable sees one Cluster at a time in Arrow batches.
    """
    chosen = get_rule(rule) if isinstance(rule, str) else rule
    clustered = cluster_elevations(storeys, tolerance_mm, group)
    if isinstance(chosen, PrefixRule):
        labels = chosen.labels(clustered, group).select(group, "cluster", "label")
    else:
        labels = _called(clustered, chosen, group)
    return clustered.join(labels, [group, "cluster"])


def _called(clustered: DataFrame, rule: Callable[[Cluster], str], group: str) -> DataFrame:
    plain = floor_labels(clustered, group, drop_zeros=False).select(group, "cluster", "most_common", "elevation_mm")
    names = clustered.groupBy(group, "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("elevation_mm", "storey_name"))), lambda s: s["storey_name"]).alias("names"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            frame = pd.DataFrame({group: [r[group] for r in rows], "cluster": [r["cluster"] for r in rows], "label": [rule(Cluster(tuple(r["names"]), r["most_common"], r["elevation_mm"])) for r in rows]})
            yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([(group, batch.schema.field(group).type), ("cluster", pa.int32()), ("label", pa.string())]), preserve_index=False)

    kind = dict(clustered.dtypes)[group]
    return names.join(plain, [group, "cluster"]).mapInArrow(run, f"{group} {kind}, cluster int, label string")
