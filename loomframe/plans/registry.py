"""Registry of named plans, and nested configuration lookup."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BUILDERS: dict[str, Callable[..., DataFrame]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` as a query, with its SQL twin if it has one."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


class Tables:
    """Parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


    def spread(self, name: str, key: str) -> DataFrame:
        """A table for compute-heavy row work.

        A file with fewer splits than cores is spread by key first; larger tables
        already have a task per split and are left alone.
        """
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def rounded(column, digits: int = 6) -> Column:
    """Rounded double without negative zero, for comparison across engines."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def joined(column, separator: str = " ") -> Column:
    """Integer or string array as text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(column.cast("array<string>"), separator)


# --- plans built by name and parameters -------------------------------------


def builder(name: str):
    """Register ``fn(spark, **params) -> DataFrame`` under a name."""

    def register(fn: Callable[..., DataFrame]):
        BUILDERS[name] = fn
        return fn

    return register


def build(
    config: Mapping[str, Any], spark: SparkSession, overrides: Sequence[str] = ()
) -> DataFrame:
    """Build the plan a configuration names: ``{"target": name, "params": {...}}``.

    ``overrides`` are ``key=value`` pairs that replace parameters.
    """
    target = lookup(config, "target")
    if target not in BUILDERS:
        raise KeyError(f"unknown plan {target!r}; known: {sorted(BUILDERS)}")
    params = dict(lookup(config, "params", default={}))
    for item in overrides:
        key, _, value = item.partition("=")
        params[key] = _parsed(value, params[key]) if key in params else value
    return BUILDERS[target](spark, **params)


def _parsed(value: str, like: Any) -> Any:
    """``value`` as the type of the parameter that it replaces; ValueError if it isn't of that type."""
    if isinstance(like, str) or like is None:
        return value
    if isinstance(like, bool):
        if value.lower() not in ("true", "false"):
            raise ValueError(f"{value!r} is not true or false")
        return value.lower() == "true"
    if isinstance(like, (int, float)):
        return type(like)(value)
    made = json.loads(value)
    if not isinstance(made, (list, dict)) or isinstance(made, dict) != isinstance(like, Mapping):
        raise ValueError(f"{value!r} is not like {like!r}")
    return made


_MISSING = object()


def lookup(config: Any, path: str, default: Any = _MISSING, separator: str = "/") -> Any:
    """Value at a path such as ``a/b/0`` of nested mappings and lists."""
    at = config
    for part in path.split(separator):
        try:
            at = at[int(part)] if isinstance(at, (list, tuple)) else at[part]
        except (KeyError, IndexError, TypeError, ValueError):
            if default is _MISSING:
                raise KeyError(f"no entry {path!r}") from None
            return default
    return at


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Compose DataFrame steps, first to last."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def with_bundle(df: DataFrame, fn: Callable, inputs: Sequence[str], fields: str) -> DataFrame:
    """Add the columns a plug-in computes from a batch.

    ``fn(pandas frame of inputs) -> dict of columns`` provides every column named
    in ``fields``, a DDL list such as ``"ids array<int>, valid int"``.
    """
    names = T.StructType.fromDDL(fields).names

    @F.pandas_udf(T.StructType.fromDDL(fields))
    def run(*columns: pd.Series) -> pd.DataFrame:
        out = fn(pd.DataFrame(dict(zip(inputs, columns))))
        return pd.DataFrame({n: list(out[n]) for n in names})

    bundled = df.withColumn("__bundle", run(*inputs))
    return bundled.select(*df.columns, "__bundle.*")


def emit_rows(df: DataFrame, key: str, order: str, start: Callable[[], Callable], fields: str) -> DataFrame:
    """Rows that a plug-in emits for each group of ``key``, read in ``order``.

    ``start()`` begins a group and returns ``fn(row)``, which yields tuples of ``fields`` (a DDL list); after
    the group's last row it is called with None.  A group passes row by row through a table function
    with a partitioned table argument; what the plug-in remembers bounds its memory.
    """
    shape = T.StructType.fromDDL(fields)

    class Emit:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            missing = {key, order} - set(table.dataType.names)
            if missing:
                raise ValueError(f"the table has no column {sorted(missing)}")
            return AnalyzeResult(shape)

        def __init__(self):
            self.step = start()

        def eval(self, row):
            yield from self.step(row)

        def terminate(self):
            yield from self.step(None)

    return F.udtf(Emit)(df.asTable().partitionBy(key).orderBy(order))


def map_batches(df: DataFrame, fn: Callable, schema, rows: int = 4096) -> DataFrame:
    """Apply ``fn(pandas frame) -> pandas frame`` to batches of at most ``rows`` rows."""

    def run(parts):
        for part in parts:
            for low in range(0, len(part), rows):
                yield fn(part.iloc[low : low + rows])

    return df.mapInPandas(run, schema)
