"""The catalog: two tables that change together.

Every run writes what it changed to a folder of its own in both tables, then one row that
names the folder to the ``commits`` table. Only runs with a commit row are read, so both
tables move together, a run that died leaves nothing visible, and a run writes as much as
it changed, not the whole catalog. Nothing is ever overwritten. For each key the newest
version counts.

    <root>/codes/v=<run>/   <root>/metadata/v=<run>/   <root>/commits/

A run is called after its version, one above those it saw, and a unique part. Two writers
that start from one version keep both their rows; for a key that both wrote, the names
decide. Readers see the last commit at the time they ask.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callshelf.functions.paths import tags_json_text
from callshelf.schemas import CODES, COMMITS, METADATA

TABLES = {"codes": CODES, "metadata": METADATA}


@dataclass(frozen=True, order=True)
class Run:
    """A committed run: its version and the folder of its rows."""

    version: int
    run: str


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class CatalogStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> CatalogStore:
        """Set up both tables, empty."""
        store = cls(spark, root)
        if not store.runs():
            for name in TABLES:
                if _exists(spark, f"{store.root}/{name}"):
                    raise RuntimeError(f"Table '{name}' of '{root}' has rows but no commits")
            empty = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
            store._write(empty, version=0, is_base=True, batch_id=None)
        return store

    # -- reading ------------------------------------------------------------

    def codes(self) -> DataFrame:
        return self._newest("codes")

    def metadata(self) -> DataFrame:
        return self._newest("metadata")

    def metadata_keys(self, runs: list[Run] | None = None) -> DataFrame:
        """``(cid, code_cid)`` of all versions. A key keeps its ``code_cid``, so a look-up
        needs no newest-version step and reads two columns only."""
        return self._rows("metadata", runs or self.runs()).select("cid", "code_cid")

    def metadata_export(self) -> DataFrame:
        """Metadata with the tags as the JSON text ``json.dumps`` writes."""
        return self.metadata().withColumn("tags", tags_json_text(F.col("tags")))

    def catalog(self) -> DataFrame:
        """Each metadata row with its code."""
        codes = self.codes().withColumnRenamed("cid", "code_cid")
        return self.metadata().join(codes, "code_cid")

    def total(self) -> DataFrame:
        """Number of code rows, without reading the code."""
        rows = self._rows("codes", self.runs())
        return rows.agg(F.count_distinct("cid").alias("total"))

    def require_tables(self, runs: list[Run] | None = None) -> None:
        """Both tables must be there, with the columns of their schema."""
        runs = self.runs() if runs is None else runs
        if not runs:
            raise RuntimeError(f"No catalog at '{self.root}'")
        for name, schema in TABLES.items():
            try:
                found = self.spark.read.parquet(f"{self.root}/{name}/v={runs[-1].run}").schema
            except AnalysisException as problem:
                raise RuntimeError(
                    f"The catalog at '{self.root}' has no table '{name}'"
                ) from problem
            types = {f.name: f.dataType.simpleString() for f in found}
            wrong = [f.name for f in schema if types.get(f.name) != f.dataType.simpleString()]
            if wrong:
                raise RuntimeError(f"Table '{name}' does not have the columns {wrong}")

    def has_batch(self, batch_id: str) -> bool:
        commits = self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")
        return not commits.where(F.col("batch_id") == batch_id).isEmpty()

    # -- writing ------------------------------------------------------------

    def commit(
        self,
        codes: DataFrame,
        metadata: DataFrame,
        batch_id: str | None = None,
        runs: list[Run] | None = None,
    ) -> int:
        """Make the changed rows of both tables visible at once. Returns the version.

        The changes may be computed from the catalog itself: nothing already written is
        touched. ``runs`` are those the changes were computed from, if read before.
        """
        version = (runs or self.runs())[-1].version + 1
        changed = {"codes": codes, "metadata": metadata}
        self._write(changed, version=version, is_base=False, batch_id=batch_id)
        return version

    def compact(self) -> int:
        """Write the newest rows as one version; the runs it folds are not read any more."""
        runs = self.runs()
        version = runs[-1].version + 1
        whole = {name: self._newest(name, runs) for name in TABLES}
        folds = [one.run for one in runs]
        self._write(whole, version=version, is_base=True, batch_id=None, folds=folds)
        return version

    def _write(
        self,
        tables: dict,
        *,
        version: int,
        is_base: bool,
        batch_id: str | None,
        folds: list[str] | None = None,
    ) -> None:
        run = f"{version:012d}-{uuid.uuid4().hex}"

        def write(name: str) -> None:
            columns = [F.col(f.name).cast(f.dataType) for f in TABLES[name]]
            tables[name].select(columns).write.parquet(f"{self.root}/{name}/v={run}")

        # the tables do not depend on each other: two jobs side by side
        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(write), tables))
        # one row in one file, moved into place by the job's commit
        row = self.spark.createDataFrame(
            [(version, is_base, batch_id, run, folds)], COMMITS
        ).coalesce(1)
        row.write.mode("append").parquet(f"{self.root}/commits")

    # -- runs ---------------------------------------------------------------

    def runs(self) -> list[Run]:
        """Committed runs that no other run holds, oldest first.

        The ledger has one short row per run, so it is small enough to look at here. Only a
        ledger that is not there means that there is no catalog; one that cannot be read is
        an error.
        """
        if not _exists(self.spark, f"{self.root}/commits"):
            return []
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits").collect()
        folded = {run for row in rows for run in row.folds or ()}
        return sorted(Run(row.version, row.run) for row in rows if row.run not in folded)

    def _versions(self) -> list[int]:
        return [one.version for one in self.runs()]

    def _rows(self, table: str, runs: list[Run]) -> DataFrame:
        """All rows of the runs of a table, with the run as column ``v``. Names sort as the
        versions do."""
        schema = T.StructType([*TABLES[table].fields, T.StructField("v", T.StringType())])
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
        return reader.parquet(*[f"{self.root}/{table}/v={one.run}" for one in runs])

    def _newest(self, table: str, runs: list[Run] | None = None) -> DataFrame:
        """Rows of which no newer version exists.

        Only keys and versions are shuffled to find the replaced rows. Those are few, as
        a rule, and then the wide rows stay where they are read. A single version, as
        ``compact`` leaves it, is read as it is.
        """
        runs = runs or self.runs()
        rows = self._rows(table, runs)
        if len(runs) == 1:
            return rows.drop("v")
        replaced = (
            rows.groupBy("cid")
            .agg(F.max("v").alias("newest"), F.count(F.lit(1)).alias("n"))
            .where("n > 1")
            .select(F.col("cid").alias("_cid"), "newest")
        )
        old = (F.col("cid") == F.col("_cid")) & (F.col("v") < F.col("newest"))
        return rows.join(replaced, old, "left_anti").select(*TABLES[table].fieldNames())
