"""Tables of an iteration in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_folder


class Rounds:
    """Each table is written and read again, which cuts lineage and survives lost executors; tables that no later one reads are removed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}", 0
        self.held: list[str] = []

    def save(self, df: DataFrame, lasting: bool = False) -> DataFrame:
        """``df`` from files of its own; ``lasting`` ones stay when rounds are removed."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        if not lasting:
            self.held.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_last(self, n: int) -> None:
        """Remove all but the last ``n`` tables that are not lasting."""
        gone, self.held = self.held[: len(self.held) - n], self.held[len(self.held) - n :]
        for path in gone:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
