"""A keyed table kept as a log of changes: every batch writes what it changed, readers take the newest row.

Rows are dealt to buckets by the hash of their key. A batch writes one folder, partitioned by
kind (``delta`` or ``full``) and bucket, and a small manifest of what the folder holds. A read
takes, bucket by bucket, the last full batch and the deltas after it, and of each key the row
of the highest version. The first rows of a bucket are full. When the deltas of a bucket have grown to the size of its full rows,
the next batch that touches the bucket writes it in full: what is written stays in proportion
to what changes, and what is read in proportion to the buckets asked for.

A batch is known by its number. Repeating it overwrites its own folder and nothing else, and it
sees only earlier batches, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: deltas of a bucket that are read together at most, whatever their size
MOST_DELTAS = 32
DELTA, FULL = "delta", "full"
_MANIFEST = "kind string, bucket int, rows bigint"


@dataclass(frozen=True)
class Part:
    """What a batch wrote for a bucket."""

    batch: int
    kind: str
    bucket: int
    rows: int


@dataclass(frozen=True)
class ChangeLog:
    """The log under ``path`` of a table with the given key and version columns."""

    spark: SparkSession
    path: str
    key: str
    version: str
    buckets: int = BUCKETS
    most_deltas: int = MOST_DELTAS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of ``rows``; at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def parts(self, before: int | None = None) -> list[Part]:
        """The live parts, in the order of batches: of each bucket the last full one and what follows.

        The manifests hold a row per touched bucket and batch; of every bucket at most
        ``most_deltas`` + 1 rows are live.
        """
        numbers = [n for n in self.batches() if before is None or n < before]
        if not numbers:
            return []
        folders = [f"{self.path}/manifest/batch={n}" for n in numbers]
        listed = self.spark.read.schema(_MANIFEST + ", batch int").option("basePath", f"{self.path}/manifest").parquet(*folders)
        full = listed.where(F.col("kind") == FULL).groupBy("bucket").agg(F.max("batch").alias("_full"))
        live = listed.join(full, "bucket", "left").where(F.col("_full").isNull() | (F.col("batch") >= F.col("_full")))
        return sorted((Part(r.batch, r.kind, r.bucket, r.rows) for r in live.collect()), key=lambda p: (p.batch, p.bucket))

    def batches(self) -> list[int]:
        """The numbers of the finished batches; a manifest is written last."""
        if not self.exists(f"{self.path}/manifest"):
            return []
        folder = self._hadoop(f"{self.path}/manifest")
        files = folder.getFileSystem(self._configuration())
        done = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("batch=")]
        finished = [p for p in done if files.exists(self._hadoop(f"{p.toString()}/_SUCCESS"))]
        return sorted(int(p.getName().partition("=")[2]) for p in finished)

    def read(self, schema: StructType, parts: Sequence[Part] | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The newest row of every key, of all buckets or of some."""
        wanted = self.parts() if parts is None else parts
        if buckets is not None:
            chosen = set(buckets)
            wanted = [p for p in wanted if p.bucket in chosen]
        folders = [f"{self.path}/rows/batch={p.batch}/kind={p.kind}/bucket={p.bucket}" for p in wanted if p.rows]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*folders)
        others = [c for c in schema.names if c != self.key]
        newest = F.max_by(F.struct(*others), self.version).alias("_newest")
        return rows.groupBy(self.key).agg(newest).select(*[self.key if c == self.key else F.col(f"_newest.`{c}`") for c in schema.names])

    def append(self, rows: DataFrame, batch: int) -> list[Part]:
        """Writes the changed rows (one per key) of batch ``batch``; buckets that are due are written in full."""
        sizes = {r.b: r.n for r in rows.groupBy(self.bucket().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        live: dict[int, list[Part]] = {}
        for part in self.parts(before=batch):
            live.setdefault(part.bucket, []).append(part)
        due = [b for b, n in sizes.items() if self._due(live.get(b, []), n)]
        first = [b for b in sizes if b not in live]
        kind = F.when(self.bucket().isin(first), FULL).otherwise(DELTA) if first else F.lit(DELTA)
        marked = rows.withColumns({"kind": kind, "bucket": self.bucket()})
        if due:
            base = self.read(rows.schema, [p for b in due for p in live[b]]).join(rows.select(self.key), self.key, "left_anti")
            full = base.unionByName(rows.where(self.bucket().isin(due))).withColumns({"kind": F.lit(FULL), "bucket": self.bucket()})
            marked = marked.where(~F.col("bucket").isin(due)).unionByName(full)
        folder = f"{self.path}/rows/batch={batch}"
        marked.repartition("kind", "bucket").write.mode("overwrite").partitionBy("kind", "bucket").parquet(folder)
        if sizes:
            written = self.spark.read.schema(f"`{self.key}` {rows.schema[self.key].dataType.simpleString()}, kind string, bucket int").parquet(folder)
            counted = written.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("rows"))
        else:
            counted = self.spark.createDataFrame([], _MANIFEST)
        counted.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        return [p for p in self.parts() if p.batch == batch]

    def _due(self, live: list[Part], more: int) -> bool:
        full = sum(p.rows for p in live if p.kind == FULL)
        deltas = [p.rows for p in live if p.kind == DELTA]
        return bool(live) and (sum(deltas) + more >= full or len(deltas) >= self.most_deltas)

    def vacuum(self) -> list[int]:
        """Deletes the folders of batches that no read needs, also not if the last batch is repeated; returns their numbers.

        Not to be called while a reader still holds an older list of parts.
        """
        numbers = self.batches()
        if not numbers:
            return []
        live = {p.batch for p in [*self.parts(), *self.parts(before=numbers[-1])]}
        gone = [n for n in numbers[:-1] if n not in live]
        for number in gone:
            for folder in (f"{self.path}/rows/batch={number}", f"{self.path}/manifest/batch={number}"):
                place = self._hadoop(folder)
                place.getFileSystem(self._configuration()).delete(place, True)
        return gone

    def exists(self, path: str) -> bool:
        place = self._hadoop(path)
        return place.getFileSystem(self._configuration()).exists(place)

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _configuration(self):
        return self.spark._jsc.hadoopConfiguration()
