"""Named queries over the given tables with their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import SPREAD, configure, spread

#: Tasks for each core of a table that ``Tables.dealt`` deals out.
TASKS_A_CORE = 3


class Tables:
    """Lazy access to the parquet tables of a folder: ``t.documents``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def even(self, name: str) -> DataFrame:
        """A table spread over all cores when it is small, for steps that cost
        much per row."""
        return spread(getattr(self, name))

    def dealt(self, name: str) -> DataFrame:
        """A table of short rows dealt out over all cores, a few tasks for
        each: its file has few splits, whatever its rows cost."""
        cores = self.spark.sparkContext.defaultParallelism
        return spread(getattr(self, name), int(self.spark.conf.get(SPREAD, "0")) or TASKS_A_CORE * cores)

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zoneless = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


@dataclass
class Entry:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(t) -> DataFrame`` under a name."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, build, sql)
        return build

    return wrap


def load_all() -> dict[str, Entry]:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return ENTRIES
