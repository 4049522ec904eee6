"""Panels as data: one aggregation or listing over one view, built as a DataFrame plan or written as SQL for the check.

A panel is a filter, groups, aggregates, a filter on the groups, an order with a unique tie-break, and a limit. Expressions are
SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.sources.views import checked_by


@dataclass(frozen=True)
class Panel:
    source: str
    where: str = ""
    by: Mapping[str, str] = field(default_factory=dict)
    aggs: Mapping[str, str] = field(default_factory=dict)
    columns: Mapping[str, str] = field(default_factory=dict)
    having: str = ""
    order: Sequence[str] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False

    def build(self, df: DataFrame) -> DataFrame:
        """The panel over any DataFrame with the columns that its expressions name."""
        # times in the tables have no zone; a literal with one would keep the filter above the scan
        out = df.filter(self.where.replace("timestamp '", "timestamp_ntz '")) if self.where else df
        if self.aggs:
            keys = [F.expr(e).alias(n) for n, e in self.by.items()]
            out = out.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in self.aggs.items()])
        elif self.by or self.columns:
            out = out.select(*[F.expr(e).alias(n) for n, e in {**self.by, **self.columns}.items()])
        if self.distinct:
            out = out.distinct()
        if self.having:
            out = out.filter(self.having)
        if self.order:
            out = out.orderBy(*[F.expr(o.removesuffix(" desc")).desc_nulls_last() if o.endswith(" desc") else F.expr(o).asc_nulls_last() for o in self.order])
        if self.offset:
            out = out.offset(self.offset)
        return out.limit(self.limit) if self.limit is not None else out

    def sql(self) -> str:
        columns = {**self.by, **(self.aggs or self.columns)}
        shown = ", ".join(f"{e} AS {n}" for n, e in columns.items()) or "*"
        text = f"SELECT {'DISTINCT ' if self.distinct else ''}{shown} FROM {self.source}" + f" WHERE {self.where}" * bool(self.where)
        if self.aggs and self.by:
            text += " GROUP BY " + ", ".join(self.by.values())
        if self.having:
            text = f"SELECT * FROM ({text}) grouped WHERE {self.having}"
        if self.order:
            text = f"SELECT * FROM ({text}) listed ORDER BY " + ", ".join(f"{o} NULLS LAST" for o in self.order)
        if self.limit is not None:
            text += f" LIMIT {self.limit}"
        if self.offset:
            text += f" OFFSET {self.offset}"
        return checked_by(text)
