"""Tables that are computed once and read several times, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and one process does all, as in tests."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")


@contextmanager
def _setting(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


#: A result made under this drops its shuffle files as soon as it stands; else these wait for the driver's garbage collection.
_PASSING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A plan made under this is fixed, so that Spark knows how its result is dealt; of an adaptive one it forgets that.
_FIXED = {"spark.sql.adaptive.enabled": "false"}


def kept(df: DataFrame, dealt: bool = False) -> DataFrame:
    """df computed once, into the shared folder; it survives the loss of executors. What is dealt stays so for later plans."""
    shared_folder(df.sparkSession)
    with _setting(df.sparkSession, **_PASSING, **(_FIXED if dealt else {})):
        return df.select("*").checkpoint()


def kept_in_turn(slices: Iterable[DataFrame]) -> DataFrame:
    """Slices of a table, dealt alike, each computed when the one before stands: disk has the shuffle files of one at a time."""
    return reduce(DataFrame.unionByName, (kept(df, dealt=True) for df in slices))
