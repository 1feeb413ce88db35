"""Stored tables that later jobs update: rows are merged by key.

Keys are hashed to buckets, and a bucket's rows are a set of Parquet files below ``data``. A merge reads only the buckets that the
new rows touch, aggregates old and new rows by key and writes those buckets anew; the others stay as they are. Which files make up
the table says the manifest, one small file per version that is written last: a merge that dies on the way leaves the table
as it was. The manifest also notes the last micro-batch of every stream, so a batch that is delivered again changes nothing.

One writer at a time, as a streaming query is. A bucket is rewritten by one task, so the number of buckets has to grow with
the table (``buckets``, fixed when the table is made); the driver handles one line per bucket. The newest ``keep`` versions stay
readable, older files are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.runtime import delete_path, scratch_path

OLD = "_old"
_BUCKET = "_bucket"
_MANIFEST = "bucket int, folder string, applied map<string, bigint>"

#: Old and new rows (told apart by ``OLD``) of the touched keys -> one row per key.
Merge = Callable[[DataFrame], DataFrame]


def by_rules(keys: list[str], rules: dict[str, Column]) -> Merge:
    """One aggregate per column; several new rows of a key are combined like any others."""
    return lambda rows: rows.groupBy(*keys).agg(*[c.alias(n) for n, c in rules.items()])


def largest_row(keys: list[str], columns: list[str], order: list[str]) -> Merge:
    """The whole row that is largest by ``order``; among equals the new one."""
    rest = [c for c in columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order, ~F.col(OLD)))
    return lambda rows: rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def first_text(name: str) -> Column:
    """The stored text, or where that is empty the new one."""
    filled = F.when(F.coalesce(name, F.lit("")) != "", F.col(name))
    return F.coalesce(F.max(F.when(F.col(OLD), filled)), F.max(F.when(~F.col(OLD), filled)), F.max(name))


@dataclass
class Version:
    number: int
    folders: dict[int, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class MergeTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 16, keep: int = 3):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.buckets, self.keep = buckets, keep

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _versions(self) -> DataFrame:
        return self.spark.read.schema(f"{_MANIFEST}, v long").json(f"{self.path}/manifest")

    def version(self) -> Version:
        try:
            newest = self._versions().agg(F.max("v")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None
        if newest is None:
            return Version(0)
        found = Version(newest)
        for r in self._versions().where(F.col("v") == newest).collect():  # a row per bucket
            if r["folder"] is not None:
                found.folders[r["bucket"]] = r["folder"]
            else:
                found.applied = dict(r["applied"] or {})
        return found

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        """The table as of now."""
        return self._rows(sorted(self.version().folders.values()))

    def lookup(self, **key) -> DataFrame:
        """The row of a whole key; reads that key's bucket only."""
        typed = [F.lit(key[k]).cast(self.schema[k].dataType).alias(k) for k in self.keys]
        bucket = self.spark.range(1).select(*typed).select(self._bucket()).first()[0]
        folder = self.version().folders.get(bucket)
        return self._rows([folder] if folder else []).where(_all_equal(self.keys, typed))

    def preview(self, batch: DataFrame, merge: Merge) -> tuple[DataFrame, DataFrame]:
        """The rows of the batch's keys as they are and as ``merge`` would leave them."""
        folders = self.version().folders
        keys = batch.select(*self.keys).distinct()
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # at most one row per bucket
        old = self._rows([folders[b] for b in touched if b in folders]).alias("o")
        same = _all_equal([f"o.{k}" for k in self.keys], [F.col(f"k.{k}") for k in self.keys])
        before = old.join(keys.alias("k"), same, "left_semi")
        both = before.withColumn(OLD, F.lit(True)).unionByName(batch.select(*self.schema.names).withColumn(OLD, F.lit(False)))
        return before, merge(both).select(*self.schema.names)

    def upsert(self, batch: DataFrame, merge: Merge, stream: str | None = None, batch_id: int | None = None) -> bool:
        """Merge ``batch`` into the table; False if that batch of that stream is in it already."""
        now = self.version()
        if stream is not None and now.applied.get(stream, -1) >= batch_id:
            return False
        staged = scratch_path(self.spark, "merge")
        batch.select(*self.schema.names).withColumn(_BUCKET, self._bucket()).write.parquet(staged)
        new = self.spark.read.schema(T.StructType(self.schema.fields + [T.StructField(_BUCKET, T.IntegerType())])).parquet(staged)
        touched = sorted(r[0] for r in new.select(_BUCKET).distinct().collect())  # at most one row per bucket
        after = Version(now.number + 1, dict(now.folders), dict(now.applied))
        if touched:
            old = self._rows([now.folders[b] for b in touched if b in now.folders])
            merged = merge(old.withColumn(OLD, F.lit(True)).unionByName(new.drop(_BUCKET).withColumn(OLD, F.lit(False))))
            folder = f"data/v{after.number:09d}"
            (merged.select(*self.schema.names).withColumn("bucket", self._bucket())
             .repartition("bucket").sortWithinPartitions("bucket", *self.keys)
             .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}"))
            for b in touched:
                after.folders[b] = f"{folder}/bucket={b}"
        if stream is not None:
            after.applied[stream] = batch_id
        self._commit(after)
        delete_path(self.spark, staged)
        self._clean(after.number - self.keep)
        return True

    def sink(self, merge: Merge, stream: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: merges every micro-batch once, however often it is delivered."""

        def save(batch: DataFrame, batch_id: int) -> None:
            if not self.upsert(batch, merge, stream, batch_id):
                batch.write.format("noop").mode("overwrite").save()  # its rows are known, but the stream's own state needs the run

        return save

    def _commit(self, v: Version) -> None:
        rows = [(b, f, None) for b, f in sorted(v.folders.items())] + [(-1, None, v.applied)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v={v.number}")

    def _clean(self, upto: int) -> None:
        """Delete the versions up to a number and the files that only they name."""
        if upto < 1:
            return
        rows = self._versions().where("folder IS NOT NULL").select("v", "folder").collect()  # keep + 1 versions at most
        living = {r["folder"] for r in rows if r["v"] > upto}
        for gone in {r["folder"] for r in rows if r["v"] <= upto} - living:
            delete_path(self.spark, f"{self.path}/{gone}")
        delete_path(self.spark, f"{self.path}/manifest/v={upto}")


def _all_equal(keys: list[str], values: list[Column]) -> Column:
    same = F.lit(True)
    for k, v in zip(keys, values):
        same = same & F.col(k).eqNullSafe(v)
    return same
