"""Named queries over the harness tables and their SQL, by subject."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from . import graphs, records, scalars, sets, sources, streams, trust, work


class Subject:
    """A module's queries and SQL in the form the driver asks for."""

    def __init__(self, module: ModuleType):
        self.module = module

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return dict(self.module.QUERIES)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.module.SQL)


MODULES = [Subject(m) for m in (trust, graphs, sets, scalars, streams, work, sources, records)]
