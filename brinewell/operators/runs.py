"""Exactly one copy of each message: idempotent upserts into hash-bucketed, sorted storage, and compaction of its runs.

A batch is written as one run: files bucketed by the identifier's hash and sorted by it inside each bucket. Writing the same batch again replaces its run. Runs
of the same store have the same buckets, so two of them are merged by a sort-merge join, bucket beside bucket: no row is shuffled again, and of equal
identifiers the copy that comes first is kept. compact() folds all runs into one and drops them. The list of runs lies in the store's folder, so
another session that opens the folder goes on where this one stopped.

One identifier may have a third of all rows. A batch is therefore collapsed in two steps: inside blocks of consecutive order
values, which spreads a hot identifier over many tasks, then per identifier over the blocks' first copies alone. A copy that a
block has already ruled out is stored under a salted hash, so that no bucket grows with the copies of one identifier.

Defined results: rows with a null in a required column identify nothing and are neither copies nor kept; nulls in other
identifier columns equal each other; of full ties in the order columns one arbitrary row is first; empty tables give no rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinewell.session import file_system, shared_dir

BLOCK_ROWS = 65_536
MANIFEST = "runs.json"


class RunStore:
    """Storage of the rows of one kind of message: key names its identifier, order the columns that rank its copies.

    The first order column must be a bigint; its blocks bound what one task sees of a hot identifier. Without a path the store lasts as long as the driver.
    """

    def __init__(self, spark: SparkSession, key: list[str], order: list[str], required: list[str], path: str | None = None, buckets: int | None = None):
        self.spark, self.key, self.order, self.required = spark, key, order, required
        self.path = path or shared_dir(spark, "runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, dict] = {}
        if (known := self._read_manifest()) is not None:
            self.buckets, self.runs = known["buckets"], known["runs"]
        self.tables: dict[str, str] = {}

    # ---- the list of runs --------------------------------------------------------------------------------------------------

    def _read_manifest(self) -> dict | None:
        fs, at = file_system(self.spark, f"{self.path}/{MANIFEST}")
        if not fs.exists(at):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{MANIFEST}").collect()))

    def _write_manifest(self) -> None:
        """Written beside the old list and moved in its place, so that a reader finds one or the other whole."""
        fs, new = file_system(self.spark, f"{self.path}/{MANIFEST}.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": self.runs}).encode()))
        out.close()
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{MANIFEST}")
        fs.delete(at, False)
        fs.rename(new, at)

    def _delete(self, folder: str) -> None:
        fs, at = file_system(self.spark, folder)
        fs.delete(at, True)

    def _table(self, batch_id: str) -> DataFrame:
        """A run as a bucketed table of this session."""
        run = self.runs[batch_id]
        if run["folder"] not in self.tables:
            name = self.tables[run["folder"]] = f"run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"create table {name} ({run['schema']}) using parquet location '{run['folder']}' "
                f"clustered by (__hash) sorted by (__hash, {', '.join(f'`{c}`' for c in self.order)}) into {self.buckets} buckets"
            )
        return self.spark.table(self.tables[run["folder"]])

    # ---- batches -----------------------------------------------------------------------------------------------------------

    def upsert(self, rows: DataFrame, batch_id: str, block_rows: int = BLOCK_ROWS) -> None:
        """Stores a batch as a run in place of the run of the same batch id."""
        kept = rows.where(" and ".join(f"`{c}` is not null" for c in self.required))
        block = Window.partitionBy(*self.key, "__block").orderBy(*self.order)
        marked = (
            kept.withColumn("__block", F.expr(f"`{self.order[0]}` div {block_rows}"))
            .withColumn("__head", F.row_number().over(block) == 1)
            .withColumn("__hash", F.when(F.col("__head"), F.xxhash64(*self.key)).otherwise(F.xxhash64(*self.key, *self.order)))
            .drop("__block")
        )
        self._write(marked.repartition(self.buckets, "__hash"), batch_id)

    def _write(self, marked: DataFrame, batch_id: str) -> None:
        """Rows that lie bucket by bucket already: one file a bucket."""
        folder, old = f"{self.path}/{uuid.uuid4().hex}", self.runs.get(batch_id)
        name = self.tables[folder] = f"run_{uuid.uuid4().hex}"
        marked.write.mode("overwrite").option("path", folder).bucketBy(self.buckets, "__hash").sortBy("__hash", *self.order).saveAsTable(name)
        self.runs[batch_id] = {"folder": folder, "schema": ", ".join(f"`{c}` {k}" for c, k in marked.dtypes)}
        self._write_manifest()
        if old:
            self._drop(old)

    def _drop(self, run: dict) -> None:
        if run["folder"] in self.tables:
            self.spark.sql(f"drop table if exists {self.tables.pop(run['folder'])}")
        self._delete(run["folder"])

    def close(self) -> None:
        """Drops every run and the folder."""
        for run in self.runs.values():
            self._drop(run)
        self.runs = {}
        self._delete(self.path)

    # ---- merging -----------------------------------------------------------------------------------------------------------

    def _ranked(self, batch_id: str) -> DataFrame:
        """A run with __first, whether a row is the first copy of its identifier in the run; found bucket by bucket."""
        rank = F.row_number().over(Window.partitionBy("__hash", "__head", *self.key).orderBy(*self.order))
        return self._table(batch_id).withColumn("__first", F.col("__head") & (rank == 1)).drop("__head")

    def _merged(self) -> DataFrame:
        """All rows with __first, whether a row is the first copy of its identifier in all runs.

        Two runs meet bucket by bucket, without a shuffle; a third one costs the shuffle of what has been merged, which compact() saves for good.
        """
        if not self.runs:
            raise ValueError("the store has no run")
        merged, *others = [self._ranked(b) for b in self.runs]
        for run in others:
            rest = [c for c in run.columns if c not in ("__hash", "__first")]
            left = merged.select(F.col("__hash").alias("__left"), F.struct(*rest, "__first").alias("a"))
            right = run.select(F.col("__hash").alias("__right"), F.struct(*rest, "__first").alias("b"))
            a, b = F.col("a"), F.col("b")
            # Inside a function, so that these columns ask for no further distribution of the rows.
            pairs = F.array(*[F.struct((a[c].eqNullSafe(b[c])).alias("same")) for c in self.key])
            equal = F.forall(pairs, lambda x: x.same) & a["__first"] & b["__first"]
            met = left.join(right.hint("merge"), (F.col("__left") == F.col("__right")) & equal, "full")
            earlier = F.struct(*[a[c] for c in self.order]) <= F.struct(*[b[c] for c in self.order])
            both = a.isNotNull() & b.isNotNull()
            judged = lambda side, wins: F.struct(*[side[c].alias(c) for c in rest], (side["__first"] & (~both | wins)).alias("__first"))
            pair = F.array(F.when(a.isNotNull(), judged(a, earlier)), F.when(b.isNotNull(), judged(b, ~earlier)))
            merged = met.select(F.coalesce("__left", "__right").alias("__hash"), F.explode(F.array_compact(pair)).alias("r")).select("__hash", "r.*")
        return merged

    def unique(self) -> DataFrame:
        """The first copy of each identifier."""
        return self._merged().where("__first").drop("__first", "__hash")

    def copies(self) -> DataFrame:
        """Every copy but the first."""
        return self._merged().where("not __first").drop("__first", "__hash")

    def compact(self, batch_id: str = "compacted") -> None:
        """Replaces all runs by one that holds the first copy of each identifier."""
        old = list(self.runs.values())
        survivors = self._merged().where("__first").withColumnRenamed("__first", "__head")
        if len(old) > 2:
            survivors = survivors.repartition(self.buckets, "__hash")
        self._write(survivors.select(*self._table(next(iter(self.runs))).columns), batch_id)
        self.runs = {batch_id: self.runs[batch_id]}
        self._write_manifest()
        for run in old:
            if run["folder"] != self.runs[batch_id]["folder"]:
                self._drop(run)
