"""All queries of the reference's operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import extract, graph, json_index, json_table, lexical, ranking, records, recovery, rendered, selection, stats, structured, verify
from ..sources import offsets, scans

MODULES = (extract, lexical, records, json_index, json_table, structured, ranking, selection, rendered, recovery, graph, verify, stats, scans, offsets)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(m, name) for m in MODULES for name in (*m.SQL, *getattr(m, "UNSTATED", ()))}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
