"""Tables that are changed by key: only the files that hold a changed row are written anew.

A table is a folder of Parquet files and a chain of versions. A version lists its files; writers add files under new names and
then the version that lists them, with one small file that only one writer can create. Until that file is there
readers see the version before, and a writer that fails leaves files that no version lists. ``clean`` removes those.
"""

from __future__ import annotations

import functools
import operator
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.sources.snapshots import update_where
from cohortry.sources.workspace import file_system, materialise

_FILE, _OLD, _KIND = "__file", "__old", "__kind"


class VersionConflict(RuntimeError):
    """Another writer made the next version first."""


class VersionedTable:
    """Rows of ``schema`` under ``path``, told apart by ``key``. The key of a row is unique and has no NULL."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        unknown = set(self.key) - set(self.schema.names)
        if unknown or not self.key:
            raise ValueError(f"no such key column: {sorted(unknown)}")

    # versions

    def versions(self) -> list[int]:
        """Numbers of the versions, ascending."""
        system, where = file_system(self.spark, f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in system.listStatus(where)) if system.exists(where) else []

    def files(self, version: int | None = None) -> list[str]:
        """Files of a version, the last one unless named, relative to the folder."""
        known = self.versions()
        if not known:
            return []
        system, where = file_system(self.spark, f"{self.path}/versions/{(known[-1] if version is None else version):012d}")
        stream = system.open(where)
        try:
            listed = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return listed.split("\n")[:-1] if listed else []

    def _commit(self, after: int, files: Sequence[str]) -> int:
        """Make version ``after + 1``. The list lies complete beside it before it gets its name."""
        system, target = file_system(self.spark, f"{self.path}/versions/{after + 1:012d}")
        draft = file_system(self.spark, f"{self.path}/drafts/{uuid.uuid4().hex}")[1]
        stream = system.create(draft, False)
        stream.write(bytearray("".join(f"{f}\n" for f in files).encode()))
        stream.close()
        system.mkdirs(target.getParent())
        try:
            placed = not system.exists(target) and system.rename(draft, target)
        except Py4JJavaError:
            placed = False
        if not placed:
            system.delete(draft, False)
            raise VersionConflict(f"{self.path}: version {after + 1} was made by another writer")
        return after + 1

    def _current(self) -> int:
        return max(self.versions(), default=0)

    def _written(self, rows: DataFrame) -> list[str]:
        """Write rows under new names and return these."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(f"{self.path}/{folder}")
        system, where = file_system(self.spark, f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in system.listStatus(where)]
        return [f"{folder}/{n}" for n in sorted(names) if n.endswith(".parquet")]

    def _scan(self, files: Sequence[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema).withColumn(_FILE, F.lit(""))
        named = F.regexp_extract("_metadata.file_path", r"(data/[0-9a-f]+/[^/]+)$", 1)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in files]).select("*", named.alias(_FILE))

    # reading and writing

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, the last one unless named."""
        return self._scan(self.files(version)).drop(_FILE)

    def create(self, rows: DataFrame, *, parts: int | None = None) -> DataFrame:
        """The first version. Files hold ranges of the key, so a change of neighbouring keys meets few of them."""
        if self.versions():
            raise ValueError(f"{self.path} holds a table")
        chosen = rows.select(*self.schema.names)
        ranged = chosen.repartitionByRange(*([parts] if parts else []), *self.key).sortWithinPartitions(*self.key)
        self._commit(0, self._written(ranged))
        return self.read()

    def _same_key(self, left: DataFrame, right: DataFrame) -> Column:
        return functools.reduce(operator.and_, [left[k] == right[k] for k in self.key])

    def _replaced(self, version: int, live: Sequence[str], touched: set[str], rows: DataFrame) -> int:
        """Write ``rows`` in place of the touched files, those of one file together, new ones among themselves.

        Rows without a file are dealt to as many tasks as any shuffle makes.
        """
        spread = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        place = F.when(F.col(_FILE).isNull(), F.concat(F.lit("new "), F.pmod(F.xxhash64(*self.key), F.lit(spread)).cast("string"))).otherwise(F.col(_FILE))
        new = self._written(rows.withColumn(_FILE, place).repartition(max(1, len(touched)) + spread, _FILE).sortWithinPartitions(_FILE, *self.key).drop(_FILE))
        return self._commit(version, [*(f for f in live if f not in touched), *new])

    def upsert(self, changes: DataFrame) -> dict[str, int]:
        """Rows of ``changes`` take the place of those with their key, or are added.

        Returns how many rows were updated and inserted and how many files were written anew. Rows that change nothing touch no file, so the
        same changes once more make no version. A key that occurs twice in ``changes``, or a NULL in one, is an error and changes nothing.
        """
        version, live = self._current(), self.files()
        names = self.schema.names
        given = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        no_key = functools.reduce(operator.or_, [F.col(k).isNull() for k in self.key])
        bad = given.groupBy(*self.key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | no_key)
        if not bad.isEmpty():
            raise ValueError(f"changes hold a key twice or without a value: {bad.drop('n').first()}")
        bounds = given.agg(*[f(k).alias(f"{f.__name__}_{k}") for k in self.key for f in (F.min, F.max)]).first()
        scanned = self._scan(live)
        for k in self.key:  # files whose keys lie outside are skipped by their statistics
            if bounds[f"min_{k}"] is not None:
                scanned = scanned.filter(F.col(k).between(F.lit(bounds[f"min_{k}"]), F.lit(bounds[f"max_{k}"])))
        held = scanned.select(*[F.col(c).alias(f"{_OLD}_{c}") for c in names], F.col(_FILE))
        match = functools.reduce(operator.and_, [F.col(k) == F.col(f"{_OLD}_{k}") for k in self.key])
        equal = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"{_OLD}_{c}")) for c in names])
        kind = F.when(F.col(_FILE).isNull(), "new").when(equal, "same").otherwise("changed")
        met = materialise(given.join(held, match, "left").withColumn(_KIND, kind).filter(F.col(_KIND) != "same").select(*names, _FILE, _KIND), "changes")
        counts = {r[_KIND]: r["n"] for r in met.groupBy(_KIND).agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            return {"updated": 0, "inserted": 0, "files": 0}
        touched = {r[_FILE] for r in met.filter(F.col(_FILE).isNotNull()).select(_FILE).distinct().collect()}
        before = self._scan([f for f in live if f in touched])
        kept = before.join(met.select(*self.key), self.key, "left_anti").select(*names, _FILE)
        self._replaced(version, live, touched, kept.unionByName(met.select(*names, _FILE)))
        return {"updated": counts.get("changed", 0), "inserted": counts.get("new", 0), "files": len(touched)}

    def _rewrite(self, condition: Column, rows_of: callable) -> int:
        version, live = self._current(), self.files()
        touched = {r[_FILE] for r in self._scan(live).filter(condition).select(_FILE).distinct().collect()}
        if touched:
            self._replaced(version, live, touched, rows_of(self._scan([f for f in live if f in touched])))
        return len(touched)

    def update(self, condition: Column, changes: Mapping[str, Column]) -> int:
        """Set columns on the rows that meet ``condition``; returns how many files were written anew."""
        if set(changes) & set(self.key):
            raise ValueError("a key is not updated: delete the row and insert another")
        return self._rewrite(condition, lambda rows: update_where(rows, condition, changes))

    def delete(self, condition: Column) -> int:
        """Drop the rows that meet ``condition``; one for which it is NULL stays. Returns how many files were written anew."""
        return self._rewrite(condition, lambda rows: rows.filter(~F.coalesce(condition, F.lit(False))))

    def clean(self, keep: int = 1) -> list[str]:
        """Forget all but the last ``keep`` versions and remove the files that those do not list. No writer may be at work."""
        known = self.versions()
        if not known:
            return []
        wanted = {f for v in known[-max(1, keep) :] for f in self.files(v)}
        system, data = file_system(self.spark, f"{self.path}/data")
        gone = []
        for folder in system.listStatus(data):
            name = folder.getPath().getName()
            listed = [f"data/{name}/{s.getPath().getName()}" for s in system.listStatus(folder.getPath())]
            if not wanted.intersection(listed):
                gone += [f for f in listed if f.endswith(".parquet")]
                system.delete(folder.getPath(), True)
                continue
            for file in listed:
                if file.endswith(".parquet") and file not in wanted:
                    gone.append(file)
                    system.delete(file_system(self.spark, f"{self.path}/{file}")[1], False)
        for v in known[: -max(1, keep)]:
            system.delete(file_system(self.spark, f"{self.path}/versions/{v:012d}")[1], False)
        system.delete(file_system(self.spark, f"{self.path}/drafts")[1], True)
        return sorted(gone)
