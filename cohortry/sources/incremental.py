"""A stored grouped result that a refresh brings up to date by reading only what was appended.

The source is a folder that files are added to and never taken from. Spark's file stream keeps the list
of the files it has read in its checkpoint, which is the high-water mark; every refresh runs it over what is new and
stores the totals of each step (see ``deltas``). A refresh that fails leaves its last step unfinished; the next one
repeats that step under the same number, so nothing is counted twice or lost.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortry.sources.deltas import Deltas, Measure
from cohortry.sources.workspace import file_system

# Spark's stream would pass over files a week older than the newest it has seen.
_ANY_AGE = "36500d"


class IncrementalSnapshot:
    """``measures`` per ``keys`` over the files of ``source``.

    ``prepare`` turns rows of the source into rows with the keys and the measured columns, by joining dimensions for
    instance. It sees appended rows only, so a row that changes the meaning of earlier ones (an edited dimension)
    takes a ``rebuild``. ``files_per_step`` bounds what one step reads.
    """

    def __init__(
        self, spark: SparkSession, path: str, source: str, schema: T.StructType, keys: Sequence[str], measures: Mapping[str, Measure],
        prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, *, files_per_step: int | None = None, fold_after: int = 16,
    ):
        self.spark, self.path, self.source, self.schema = spark, path.rstrip("/"), source, schema
        self.keys, self.measures, self.prepare = list(keys), dict(measures), prepare
        self.files_per_step, self.fold_after = files_per_step, fold_after
        self.rows_read = 0  # of the last refresh

    def _generations(self) -> list[int]:
        system, where = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("ready="))

    def _folder(self, generation: int) -> str:
        return f"{self.path}/generation={generation}"

    def _current(self) -> int:
        return max(self._generations(), default=0)

    def _deltas(self, generation: int) -> Deltas:
        return Deltas(self.spark, f"{self._folder(generation)}/totals", self.keys, self.measures)

    def _like(self) -> DataFrame:
        return self.prepare(self.spark.createDataFrame([], self.schema))

    def _run(self, generation: int) -> None:
        deltas = self._deltas(generation)
        reader = self.spark.readStream.schema(self.schema).option("maxFileAge", _ANY_AGE)
        if self.files_per_step is not None:
            reader = reader.option("maxFilesPerTrigger", self.files_per_step)
        query = (
            reader.parquet(self.source).writeStream.foreachBatch(lambda batch, step: deltas.write(self.prepare(batch), step))
            .option("checkpointLocation", f"{self._folder(generation)}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        self.rows_read = sum(p["numInputRows"] for p in query.recentProgress)
        deltas.fold(self._like(), after=self.fold_after)

    def refresh(self) -> DataFrame:
        """Read the files added since the last refresh and return the result over all of them."""
        self._run(self._current())
        return self.read()

    def rebuild(self) -> DataFrame:
        """Read everything again beside the stored result, which stays in place until that is complete."""
        generation = self._current() + 1
        system, beside = file_system(self.spark, self._folder(generation))
        system.delete(beside, True)  # what an earlier rebuild left unfinished
        self._run(generation)
        system.create(file_system(self.spark, f"{self.path}/ready={generation}")[1], True).close()
        for old in (g for g in (0, *self._generations()) if g < generation - 1):
            system.delete(file_system(self.spark, self._folder(old))[1], True)
        return self.read()

    def read(self) -> DataFrame:
        """The stored result, empty before the first refresh."""
        deltas = self._deltas(self._current())
        return deltas.finished(deltas.merged(self._like()))
