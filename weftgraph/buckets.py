"""Tables in hash buckets with snapshots: a change rewrites only the buckets it touches.

``data`` holds the files of each bucket as they were written, ``snapshots`` a small
list for each version: which folder has which bucket. A version is committed by
creating its list under the next number, which succeeds for one writer only. A
writer that comes second takes the new list over: if the other one touched none
of its buckets its files stay as they are, else it merges again. Readers see
whole versions, old ones too. Rows of a bucket are sorted by key, so look-ups of
keys read few row groups of the touched buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators import writes

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Other writers were first too many times."""


class BucketTable:
    """A table with a key, at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str | StructType, buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._files, self._options = jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Options
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._files.Path(self.path).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._files.Path(f"{self.path}/snapshots")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _snapshot(self, version: int | None = None) -> tuple[int, dict[str, str]]:
        """Number and folders (by bucket) of a version, by default the newest."""
        done = self.versions()
        version = (done[-1] if done else 0) if version is None else version
        if not version:
            return 0, {}
        rows = self.spark.read.text(f"{self.path}/snapshots/{version}.json", wholetext=True).first()
        return version, json.loads(rows.value)

    def _commit(self, version: int, folders: dict[str, str]) -> bool:
        """Whether this writer made the version."""
        draft, final = self._files.Path(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._files.Path(f"{self.path}/snapshots/{version}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        out.close()
        context = self._files.FileContext.getFileContext(draft.toUri() if draft.isAbsolute() and draft.toUri().getScheme() else self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._options, "Rename"), 0)
        try:
            context.rename(draft, final, none)  # fails where the version is there
            return True
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def _rows(self, folders: dict[str, str], buckets: Sequence[str] | None = None) -> DataFrame:
        paths = [f for b, f in sorted(folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._snapshot(version)[1])

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[str]:
        return [str(r.b) for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # ``buckets`` rows at most

    def merge(self, incoming: DataFrame, how: Merge, retries: int = 20, before_commit: Callable[[], None] | None = None) -> int:
        """Commits ``how``(rows of the touched buckets, incoming); returns the version. ``incoming`` is read again if a writer was first."""
        touched = self._touched(incoming)
        base, folders = self._snapshot()
        made: dict[str, str] | None = None
        for _ in range(retries):
            if not touched:
                return base
            if made is None:
                made = self._write(how(self._rows(folders, touched), incoming))
            after = {b: f for b, f in folders.items() if b not in touched} | made
            if before_commit is not None:
                before_commit()
            if self._commit(base + 1, after):
                return base + 1
            old = folders
            base, folders = self._snapshot()
            if any(folders.get(b) != old.get(b) for b in touched):
                made = None
        raise Conflict(self.path)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows by bucket, which is ``_bucket`` where they were dealt before; the folder of each."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        own = rows if "_bucket" in rows.columns else rows.select(*self.schema.names).withColumn("_bucket", self._bucket()).repartition("_bucket")
        own.sortWithinPartitions("_bucket", *self.keys).write.partitionBy("_bucket").parquet(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._files.Path(folder))]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def _met(self, old: DataFrame, new: DataFrame, best: Column) -> DataFrame:
        """Keys with their rows as ``_o`` (null: none) and ``best`` of the incoming ones as ``_n`` (null: none), in one shuffle by bucket.

        Aggregates by bucket and key need no other, as joins would. Null keys match nothing, so each old row with one stays by itself.
        """
        null = F.greatest(*(F.col(k).isNull() for k in self.keys), F.lit(False))
        names = self.schema.names
        own = old.select(*self.keys, F.struct(*names).alias("_o"), F.when(null, F.monotonically_increasing_id()).alias("_apart"))
        incoming = new.select(*self.keys, best.alias("_n"))
        both = own.unionByName(incoming, allowMissingColumns=True).withColumn("_bucket", self._bucket()).repartition("_bucket")
        return both.groupBy("_bucket", *self.keys, "_apart").agg(F.first("_o", ignorenulls=True).alias("_o"), F.max("_n").alias("_n"))

    def upsert(self, incoming: DataFrame, as_of: str, order: str | None = None, **options) -> int:
        """Incoming values win where they aren't null, as in ``writes.upsert``; old rows are one of each key."""

        def how(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = [order] if order else []
            rest += [c for c in new.columns if c not in (*self.keys, *rest)]
            # A row of keys alone has a mark, too.
            met = self._met(old, new, F.struct(*rest, F.lit(True).alias("_in")))
            is_new, now = F.col("_n").isNotNull(), F.lit(as_of).cast("timestamp")
            value = {c: F.coalesce(f"_n.{c}", f"_o.{c}") for c in self.schema.names if c in rest}
            value |= {k: F.col(k) for k in self.keys}
            marks = {"created_at": F.coalesce("_o.created_at", F.when(is_new & F.col("_o").isNull(), now)), "updated_at": F.when(is_new, now).otherwise(F.col("_o.updated_at")), "active": F.when(is_new, F.lit(True)).otherwise(F.col("_o.active"))}
            return met.select("_bucket", *(value.get(c, marks.get(c, F.col(f"_o.{c}"))).alias(c) for c in self.schema.names))

        return self.merge(incoming, how, **options)

    def delete(self, keys: DataFrame, **options) -> int:
        def how(old: DataFrame, new: DataFrame) -> DataFrame:
            met = self._met(old, new, F.lit(True))
            return met.where("_o is not null and _n is null").select("_bucket", "_o.*")

        return self.merge(keys, how, **options)

    def taken(self, incoming: DataFrame) -> DataFrame:
        """Keys that a plain insert would double: the key, ``n`` (incoming rows) and ``existing``; null keys count as broken.

        Only key columns of touched buckets are read.
        """
        counts = incoming.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))
        there = self._rows(self._snapshot()[1], self._touched(incoming)).select(*self.keys).withColumn("existing", F.lit(True))
        met = counts.join(there, self.keys, "left").withColumn("existing", F.coalesce("existing", F.lit(False)))
        broken = F.greatest(*(F.col(k).isNull() for k in self.keys), F.lit(False))
        return met.where((F.col("n") > 1) | F.col("existing") | broken)

    def insert(self, incoming: DataFrame, **options) -> int:
        """Adds rows; raises ``ValueError`` if a key would be there twice, in what the commit rests on."""

        def how(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.unionByName(new.select(*self.schema.names))
            if not writes.doubled_keys(both, self.keys).isEmpty():
                raise ValueError(f"doubled or null keys {self.keys}")
            return both

        return self.merge(incoming, how, **options)
