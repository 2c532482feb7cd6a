"""Builders of pair tables and scorers, called by name from SQL.

``build_pairs`` is a table function: SELECT * FROM build_pairs(name => 'ranked', rows => TABLE(t) PARTITION BY peptide
ORDER BY (score DESC, tcr)) gives, for the rows (peptide, tcr, score) of each key, what the named builder makes of them. Its columns are settled by ``analyze``
before the query runs, and Spark deals the keys to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: name -> (added columns, maker of a function that takes a key's rows one by one and gives what is added, or None to drop one).
BUILDERS: dict[str, tuple[list[StructField], Callable[[], Callable[[object], tuple | None]]]] = {}


def builder(name: str, *added: StructField):
    """Register a maker of builders by name."""

    def add(make):
        BUILDERS[name] = list(added), make
        return make

    return add


@builder("ranked", StructField("place", LongType()))
def _ranked():
    seen = 0

    def add(row):
        nonlocal seen
        seen += 1
        return (seen,)

    return add


@builder("first_ten", StructField("place", LongType()))
def _first_ten():
    each = _ranked()

    def add(row):
        (place,) = each(row)
        return (place,) if place <= 10 else None

    return add


@builder("valid", StructField("fault", StringType()))
def _valid():
    return lambda row: ("no score" if row["score"] is None else "",)


class BuildPairs:
    """A key's rows come one by one, in the order that the call asks for."""

    def __init__(self) -> None:
        self.add = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or name.value not in BUILDERS:
            raise ValueError(f"a table and one of {', '.join(sorted(BUILDERS))} are asked for")
        missing = {"peptide", "tcr", "score"} - set(rows.dataType.names)
        if missing:
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
        return AnalyzeResult(StructType([*rows.dataType.fields, *BUILDERS[name.value][0]]))

    def eval(self, rows, name: str) -> Iterator[tuple]:
        self.add = self.add or BUILDERS[name][1]()
        found = self.add(rows)
        if found is not None:
            yield (*rows, *found)


def register(spark: SparkSession) -> None:
    spark.udtf.register("build_pairs", udtf(BuildPairs))


