"""All registered queries: each operator over whole tables, beside SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, files, joins, payloads, projections, selection, streams, windows
from .registry import Entry

Query = Callable[[SparkSession, str], DataFrame]

ENTRIES: dict[str, Entry] = {}
for _module in (projections, joins, aggregates, windows, selection, streams, payloads, files):
    ENTRIES |= _module.ENTRIES

QUERIES: dict[str, Query] = {name: e.query for name, e in ENTRIES.items()}
ORACLE_SQL: dict[str, str] = {name: e.oracle for name, e in ENTRIES.items() if e.oracle}
