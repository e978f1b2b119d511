"""A table in buckets of its key, of which a commit writes only those that it touches.

Every bucket is a folder of the commit that wrote it last (`commit=.../bucket=...`); a version is a pointer that names the
commit of each bucket, so that all versions share what they have in common. A commit reads the touched buckets, joins them
with the changed keys bucket by bucket, and writes them under its own name before the pointer changes: a failed one leaves
nothing that a version names. Going back is a new pointer, for one bucket or for the whole table. The pointer is as long as
there are buckets (4,096 at most), however large the table is.

Defined results: a null key is a key of its own, in the bucket of the empty text; keys that nothing is known of are no
error; a bucket that a commit empties has no folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.operators.index import VersionedTable

MOST = 4096


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key: the first 32 bits of the MD5 of its text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


class BucketedTable(VersionedTable):
    """Rows by `key` in `buckets` buckets below a path."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 256):
        if not 1 <= buckets <= MOST:
            raise ValueError(f"a table has 1 to {MOST} buckets")
        super().__init__(spark, path)
        self.key, self.buckets = key, buckets

    def _known(self, version: int | None = None) -> dict:
        """Schema and commits by bucket of a version, by default the last one."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(self.path)
        return json.loads(self._folder(version or found[-1]))

    def _read(self, known: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(known["schema"])
        kept = sorted((c, int(b)) for b, c in known["commits"].items() if buckets is None or int(b) in set(buckets))
        paths = [f"{self.path}/commit={c}/bucket={b}" for c, b in kept]
        whole = T.StructType([*schema.fields, T.StructField("commit", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], whole).drop("commit")
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(*paths).drop("commit")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, with their bucket; of some buckets only, of which no other's files are read."""
        return self._read(self._known(version), buckets)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", bucket_of(F.col(self.key), self.buckets))

    def _written(self, rows: DataFrame) -> str:
        """Rows with their bucket as files of a new commit: those of a bucket together, a large one in several files."""
        commit = uuid.uuid4().hex
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/commit={commit}")
        return commit

    def _folders(self, commit: str, touched: list[int]) -> dict[str, str]:
        return {str(b): commit for b in touched if self._fs.exists(self._path(f"{self.path}/commit={commit}/bucket={b}"))}

    def write(self, df: DataFrame) -> int:
        """A first or wholly new version."""
        version = (self.versions() or [0])[-1] + 1
        commits = self._folders(self._written(self._bucketed(df)), list(range(self.buckets)))
        return self._point(version, json.dumps({"schema": json.loads(df.schema.json()), "commits": commits}))

    def commit(self, rows: DataFrame, keys: DataFrame) -> tuple[int, list[int]]:
        """The next version and the buckets that it wrote: all rows of `keys` give way to `rows`, whose keys are among them."""
        version = self.versions()[-1]
        known = self._known(version)
        gone = self._bucketed(keys.select(self.key).distinct())
        touched = sorted(r["bucket"] for r in gone.select("bucket").distinct().collect())  # a row per bucket
        if not touched:
            return version, []
        old = self._read(known, touched)
        same = (old["bucket"] == gone["bucket"]) & old[self.key].eqNullSafe(gone[self.key])
        names = [f["name"] for f in known["schema"]["fields"]]
        new = self._bucketed(rows.select(*names))
        commit = self._written(old.join(gone, same, "left_anti").select(*names, "bucket").unionByName(new))
        commits = {b: c for b, c in known["commits"].items() if int(b) not in set(touched)} | self._folders(commit, touched)
        return self._point(version + 1, json.dumps(known | {"commits": commits})), touched

    def rollback_bucket(self, bucket: int) -> int:
        """A new version in which one bucket is what it was in the version before the last; the others stay."""
        found = self.versions()
        if len(found) < 2:
            raise ValueError("no version to go back to")
        last, before = self._known(found[-1]), self._known(found[-2])
        commits = {b: c for b, c in last["commits"].items() if b != str(bucket)}
        if was := before["commits"].get(str(bucket)):
            commits[str(bucket)] = was
        return self._point(found[-1] + 1, json.dumps(last | {"commits": commits}))

    def vacuum(self, keep: int = 2) -> int:
        """Forget all versions but the last `keep`, and delete the buckets' folders that these don't name; how many went."""
        found = self.versions()
        if keep < 1 or not found:
            return 0
        named = {(c, b) for v in found[-keep:] for b, c in self._known(v)["commits"].items()}
        old = {(c, b) for v in found[:-keep] for b, c in self._known(v)["commits"].items()} - named
        for v in found[:-keep]:
            self._fs.delete(self._path(f"{self.path}/current-{v}"), False)
        for c, b in old:
            self._fs.delete(self._path(f"{self.path}/commit={c}/bucket={b}"), True)
        return len(old)
