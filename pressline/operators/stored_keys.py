"""Keys of stored rows as a bucketed table, so that looking links up never moves the stored side.

The table is written by hash of the key into a fixed number of buckets. A lookup deals the links into the same buckets and
joins bucket by bucket; the keys stay where they are, however long the history. Runs add files to the buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyTable:
    """A bucketed table of keys: its name in the session's catalog, its folder, its number of buckets, its key column.

    The number of buckets is fixed for the life of the table: choose it so that a bucket of the longest history fits a task.
    """

    name: str
    path: str
    buckets: int = 64
    key: str = "url"

    def open(self, spark: SparkSession) -> DataFrame:
        """The keys; registers the folder in the catalog of a new session."""
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (`{self.key}` STRING) USING parquet "
                f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
        return spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Adds the keys of ``rows``, each once and none that the table has; a repeated call adds nothing."""
        self.open(rows.sparkSession)
        new = self.missing(rows.select(self.key).filter(F.col(self.key).isNotNull()).distinct())
        # A task writes one file a bucket, not one per task and bucket.
        dealt = new.repartition(self.buckets, self.key)
        (
            dealt.write.mode("append").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
            .option("path", self.path).saveAsTable(self.name)
        )

    def missing(self, links: DataFrame) -> DataFrame:
        """Links whose key is not in the table, null keys included."""
        return self._lookup(links, "left_anti")

    def present(self, links: DataFrame) -> DataFrame:
        """Links whose key is in the table."""
        return self._lookup(links, "left_semi")

    def _lookup(self, links: DataFrame, how: str) -> DataFrame:
        keys = self.open(links.sparkSession)
        # Merge join on the bucketed side: a broadcast of it would grow with the history.
        return links.join(keys.hint("merge"), self.key, how)
