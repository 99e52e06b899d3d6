"""Named tables stored as Parquet under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortry.sources.workspace import file_system


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan a table; filters and column choice made by the caller reach the Parquet reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


class TableFolder:
    """The tables of a folder by attribute: ``tables.orders``.

    A schema is read from the files once per session and then declared, which saves every later
    query a job that opens files only to learn their columns. A table rewritten since is read anew.
    """

    _schemas: dict[tuple[str, str, str, int], T.StructType] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        system, where = file_system(self.spark, f"{self.folder}/{name}.parquet")
        key = (self.spark.conf.get("spark.app.id", ""), self.folder, name, system.getFileStatus(where).getModificationTime())
        if key not in self._schemas:
            self._schemas[key] = load(self.spark, self.folder, name).schema
        return self.spark.read.schema(self._schemas[key]).parquet(f"{self.folder}/{name}.parquet")


def load_stream(
    spark: SparkSession, folder: str, name: str, *, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The same table as a stream of its files.

    The last letter is written as a glob set, so a table made of one file and a table made of a
    folder of part files both work as a streaming path.
    """
    schema = load(spark, folder, name).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{folder}/{name[:-1]}[{name[-1]}].parquet")
