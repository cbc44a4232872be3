"""A query: how Spark builds it, the DuckDB SQL that states it, and the kinds of its columns."""

from dataclasses import dataclass
from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphgrid.plans.fixtures import duck_sql


@dataclass(frozen=True)
class Query:
    build: Callable
    body: str
    needs: tuple = ()
    ints: str = ""
    doubles: str = ""
    bools: str = ""
    strings: str = ""

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Integers as bigint, doubles to six places."""
        df = self.build(spark, sf_dir)
        columns = [F.col(c).cast("long").alias(c) for c in self.ints.split()] + [F.round(F.col(c).cast("double"), 6).alias(c) for c in self.doubles.split()]
        return df.select(*columns, *self.bools.split(), *self.strings.split())

    @property
    def sql(self) -> Optional[str]:
        if not self.body:
            return None
        columns = [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in self.ints.split()] + [f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in self.doubles.split()] + self.bools.split() + self.strings.split()
        return f"SELECT {', '.join(columns)} FROM ({duck_sql(self.body, *self.needs)}) result"
