"""Registered observation sources: ``name -> f(raw DataFrame) -> observations``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obscat.schema import OBSERVATION

_SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def source(name: str):
    """Register an adapter under ``name``."""

    def register(adapter):
        _SOURCES[name] = adapter
        return adapter

    return register


def names() -> list[str]:
    return sorted(_SOURCES)


def read_source(name: str, raw: DataFrame) -> DataFrame:
    """Run an adapter and lay its rows out as observations; missing facts are NULL."""
    rows = _SOURCES[name](raw)
    unknown = set(rows.columns) - {f.name for f in OBSERVATION} - {"warnings"}
    if unknown:
        raise ValueError(f"source {name} returned unknown columns {sorted(unknown)}")
    out = []
    for field in OBSERVATION:
        if field.name == "source":
            out.append(F.lit(name).alias("source"))
        elif field.name in rows.columns:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
    return rows.select(*out)
