"""Settings with their defaults, from the environment and from the session."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from typing import Any, get_type_hints

from pyspark.sql import SparkSession

PREFIX, CONF = "MARGINALIA_", "spark.marginalia."


@dataclass(frozen=True)
class Settings:
    """Lists are parted by commas; the session's values go before the environment's, which go before the defaults."""

    excluded_folders: tuple[str, ...] = ("Journaling", "Atlas/People", "Atlas/work People")
    areas_folder: str = "Areas"
    least_areas_notes: int = 5
    search_threshold: float = -10.0
    search_limit: int = 10
    backend: str = "parquet"
    store: str = ""
    chunk_size: int = 1000
    chunk_overlap: int = 200

    @classmethod
    def load(cls, spark: SparkSession | None = None, environment: dict[str, str] | None = None) -> Settings:
        env, found = os.environ if environment is None else environment, {}
        kinds = get_type_hints(cls)
        for f in fields(cls):
            text = spark.conf.get(CONF + f.name, None) if spark is not None else None
            text = env.get(PREFIX + f.name.upper()) if text is None else text
            if text is not None:
                found[f.name] = _value(f.name, kinds[f.name], text)
        out = replace(cls(), **found)
        if out.chunk_overlap >= out.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")
        return out


def _value(name: str, kind: Any, text: str) -> Any:
    if kind in (int, float):
        try:
            return kind(text)
        except ValueError as e:
            raise ValueError(f"{name}: {text!r} is no {kind.__name__}") from e
    return tuple(x.strip() for x in text.split(",") if x.strip()) if kind is not str else text
