"""Crawled records as a stream of files, merged batch by batch into a keyed table that survives restarts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ingest import last_wins, merged
from ..sources.tables import shared_dir


class KeyedTable:
    """A Parquet table in buckets by the hash of its key, below a folder that all executors share.

    A write rewrites only the buckets it touches, under its own number; what
    counts is the last manifest, a small file that names the number of each
    bucket and is put in place by a rename.  A write that was cut short leaves no
    manifest and is done again; one whose manifest is there is not.  Files that
    neither of the last two manifests names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: object):
        return self._jvm.org.apache.hadoop.fs.Path("/".join(map(str, (self.path, *parts))))

    def _fs(self):
        return self._at("data").getFileSystem(self._conf)

    def committed(self) -> list[int]:
        """The numbers of the manifests, the last one at the end."""
        fs, folder = self._fs(), self._at("manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict[int, int]:
        """Bucket to the number of the write that last touched it; of the last manifest, or one before it."""
        done = self.committed()
        if not done:
            return {}
        fs = self._fs()
        stream = fs.open(self._at("manifests", f"{done[-1] if number is None else number}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): int(v) for b, v in json.loads(text).items()}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The table as the last manifest has it, or some of its buckets."""
        held = self.manifest()
        paths = [f"{self.path}/data/{v}/_bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def write(self, number: int, changes: DataFrame, digest: str, touched: str) -> None:
        """``changes`` (a key once) merged in as write ``number``; see ``operators.ingest.merged``."""
        if number in self.committed():
            return
        changes = changes.where(F.col(self.key).isNotNull())
        hit = sorted(r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect())  # at most the buckets
        held = self.manifest()
        if hit:
            new = merged(self.read(hit), changes, self.key, digest, touched, F.lit(number).cast("bigint"))
            placed = new.withColumn("_bucket", self.bucket()).repartition(min(len(hit), 200), "_bucket")
            placed.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{number}")
        self._commit(number, held | {b: number for b in hit})

    def _commit(self, number: int, manifest: dict[int, int]) -> None:
        fs = self._fs()
        fs.mkdirs(self._at("manifests"))
        draft = self._at("manifests", f"{number}.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        fs.rename(draft, self._at("manifests", f"{number}.json"))
        self._clean()

    def _clean(self) -> None:
        fs, done = self._fs(), self.committed()
        for old in done[:-2]:
            fs.delete(self._at("manifests", f"{old}.json"), False)
        used = {(v, b) for n in done[-2:] for b, v in self.manifest(n).items()}
        if not fs.exists(self._at("data")):
            return
        for write in fs.listStatus(self._at("data")):
            number = int(write.getPath().getName())
            if number > done[-1]:
                continue
            parts = [s.getPath() for s in fs.listStatus(write.getPath()) if s.getPath().getName().startswith("_bucket=")]
            gone = [p for p in parts if (number, int(p.getName().split("=")[1])) not in used]
            if len(gone) == len(parts):
                fs.delete(write.getPath(), True)
            else:
                for p in gone:
                    fs.delete(p, True)


def stream_upsert(spark: SparkSession, source: str, schema: StructType, key: str, digest: str, order: list[str], files_per_batch: int = 4, path: str | None = None, buckets: int = 64) -> DataFrame:
    """The table after all files of ``source`` have come in: ``key, digest, seen_batch`` (the last batch a key was in).

    Each micro-batch is reduced to the last record of a key and merged into the
    table below ``path``, where the stream's progress lies too: a later call with
    the same path takes up new files only, and one after a crash goes on where
    that one was cut short.  Without a path a new one in the shared folder is
    taken.  Runs until no file is left and stops.
    """
    path = path or f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    state = StructType().add(key, schema[key].dataType).add(digest, schema[digest].dataType).add("seen_batch", "long")
    target = KeyedTable(spark, f"{path}/table", key, state, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        new = last_wins(batch.where(F.col(key).isNotNull()).select(key, digest, *order), [key], [*order, digest]).select(key, digest)
        target.write(number, new, digest, "seen_batch")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return target.read()
