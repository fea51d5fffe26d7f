"""Which reading of sources goes with which framework: names of configurations to functions on sources (path, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import javatext
from ..sources import javaparse, mapper
from . import builders, resolve


def _by_batch(sources: DataFrame) -> DataFrame:
    found = resolve.batch_endpoints(javaparse.methods(javaparse.types(sources)))
    return found.select("path", F.substring_index("signature", ".", 1).alias("class_name"), F.substring_index("signature", ".", -1).alias("method_name"), "http_method", "end_point")


def _by_mapper(sources: DataFrame) -> DataFrame:
    return mapper.statements(sources).where("error is null").select("path", F.col("sql_id").alias("method"), F.upper("tag").alias("query_type"), F.col("resolved").alias("sql"))


def _by_builder(sources: DataFrame) -> DataFrame:
    known = javaparse.types(sources)
    return builders.statements(sources, javaparse.methods(known), known).select("path", "method", "query_type", "sql")


#: (path, class_name, method_name, http_method, end_point) of sources, by framework.
ENDPOINTS: dict[str, Callable[[DataFrame], DataFrame]] = {"spring_mvc": javatext.endpoints, "service_id": javatext.service_endpoints, "batch": _by_batch}
#: (path, method, query_type, sql) of sources, by the way they wrap SQL.
STATEMENTS: dict[str, Callable[[DataFrame], DataFrame]] = {"mapper": _by_mapper, "builder": _by_builder}


def chosen(ways: dict[str, Callable[[DataFrame], DataFrame]], name: str, sources: DataFrame) -> DataFrame:
    """What the way of that name, in any case, reads; an unknown name says which there are."""
    if name.lower() not in ways:
        raise ValueError(f"no way {name}; there are {', '.join(sorted(ways))}")
    return ways[name.lower()](sources)
