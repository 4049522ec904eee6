"""All queries of the library by name, each over a folder of driver tables, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans import acts, archives, derived, payloads, scoring, streams
from spanloom.plans.dashboards import PANELS
from spanloom.plans.statements import STATEMENTS, for_duckdb, for_spark
from spanloom.plans.traces import QUERIES as TRACES
from spanloom.sources.views import Views, checked_by

TEXTS = {**STATEMENTS, **TRACES}
Query = Callable[[SparkSession, str], DataFrame]


def _panel(name: str) -> Query:
    panel = PANELS[name]
    return lambda spark, sf_dir: panel.build(getattr(Views(spark, sf_dir), panel.source))


def _statement(name: str) -> Query:
    return lambda spark, sf_dir: Views(spark, sf_dir).sql(for_spark(TEXTS[name]))


def _derived(query: Callable[[Views], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(Views(spark, sf_dir))


def queries() -> dict[str, Query]:
    made = derived.QUERIES | acts.QUERIES | payloads.QUERIES | archives.QUERIES | scoring.QUERIES | streams.QUERIES
    return {name: _panel(name) for name in PANELS} | {name: _statement(name) for name in TEXTS} | {name: _derived(query) for name, query in made.items()}


def oracle_sql() -> dict[str, str]:
    return {name: panel.sql() for name, panel in PANELS.items()} | {name: checked_by(for_duckdb(text)) for name, text in TEXTS.items()} | derived.ORACLES | acts.ORACLES | payloads.ORACLES | archives.ORACLES | scoring.ORACLES | streams.ORACLES
