"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the text without ASCII white space. A batch of new
documents is digested once, grouped by digest (partial aggregates first, so a digest that a third of the rows share is
one row per task before the shuffle), joined to the index by a sort-merge anti-join for which the index side needs no
shuffle, and the digests that are new are appended. Decisions are then joined to the batch's rows in a shuffle of its
own, in which adaptive execution may split the rows of a hot digest.

The index lies in a folder that driver and executors share: a folder of versions, each named by its number and its
buckets. Appending adds a file to each bucket; once buckets hold more than MAX_FILES files or twice PER_BUCKET digests,
the index is compacted: written anew as the next version, a sorted file to a bucket, with as many buckets as it then
needs. The version before is removed after that, so a run that is lost half-way leaves the old one in use.

Defined results: null text counts as empty, and empty texts are equal to each other; of equal texts the one with the
most code points stays, then the smallest doc_id (a null doc_id comes last); rows that repeat a doc_id with an equal
text share one decision; ingesting a batch a second time changes nothing and gives the same decisions; an empty batch
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import materialise, shared_dir, whole_text

#: Digests that a bucket is made for (48 bytes each), and files of a bucket after which the index is compacted.
PER_BUCKET, MAX_FILES = 4_000_000, 8
WHITE = " \t\n\x0b\x0c\r"
_COLUMNS = "digest BINARY, keep_id BIGINT, n_points BIGINT"


def normalised(column: str = "text") -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    return F.translate(whole_text(column), WHITE, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_points (code points of the original text) and the binary digest of each row."""
    return docs.select("doc_id", F.length(whole_text()).cast("long").alias("n_points"), F.unhex(F.sha2(normalised(), 256)).alias("digest"))


class DigestIndex:
    """A persistent index (digest, keep_id, n_points) of the texts seen so far, in a shared folder.

    `buckets` fixes the number of buckets; otherwise it follows the number of digests, and is no less than the session's
    shuffle partitions, so that joins with the index are as wide as others.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._name: str | None = None

    def _list(self, path: str) -> list:
        at = self._hadoop(path)
        return list(self._files.listStatus(at)) if self._files.exists(at) else []

    def version(self) -> tuple[int, int] | None:
        """Number and buckets of the version in use: the last one that was written to its end."""
        found = [m for s in self._list(self.path) if (m := re.fullmatch(r"v([0-9]+)-([0-9]+)", s.getPath().getName()))]
        whole = [(int(m[1]), int(m[2])) for m in found if self._files.exists(self._hadoop(f"{self.path}/{m[0]}/_SUCCESS"))]
        return max(whole, default=None)

    def _folder(self, version: tuple[int, int]) -> str:
        return f"{self.path}/v{version[0]}-{version[1]}"

    def _open(self, version: tuple[int, int]) -> str:
        """The name of a catalog table over a version's files."""
        self.close()
        self._name = f"bitloom_index_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {self._name} ({_COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {version[1]} BUCKETS LOCATION '{self._folder(version)}'")
        return self._name

    def close(self) -> None:
        """Takes the table's name from the catalog; the files stay."""
        if self._name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name}")
            self._name = None

    def table(self) -> DataFrame:
        """All digests of the index."""
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], _COLUMNS)
        return self.spark.table(self._open(version))

    def _needed(self, rows: int) -> int:
        return self.buckets or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PER_BUCKET))

    def _write(self, rows: DataFrame, version: tuple[int, int]) -> None:
        """Adds digests to a version, a sorted file to a bucket."""
        name = self._open(version)
        dealt = rows.select("digest", "keep_id", "n_points").repartition(version[1], "digest").sortWithinPartitions("digest")
        dealt.write.mode("append").insertInto(name)

    def compact(self, rows: int) -> None:
        """Writes the index of so many digests anew, a sorted file to a bucket and as many buckets as they need."""
        version = self.version()
        after = (version[0] + 1, self._needed(rows))
        self._files.delete(self._hadoop(self._folder(after)), True)
        self._write(self.spark.read.schema(_COLUMNS).parquet(self._folder(version)), after)
        self._files.delete(self._hadoop(self._folder(version)), True)
        self.close()

    def files(self) -> int:
        """Files of the version in use."""
        version = self.version()
        return sum(s.getPath().getName().endswith(".parquet") for s in self._list(self._folder(version))) if version else 0

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Decides on a batch and appends what is new: doc_id, keep_id, group_size, kept, text_sha256 of each row.

        group_size counts the batch's rows; keep_id is the document that stays, from an earlier batch if that had the
        text already.
        """
        batch = materialise(digests(docs), "digests")
        best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")))
        groups = batch.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        groups = materialise(groups.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("n_points"), "group_size"), "groups")
        version = self.version() or (1, self._needed(groups.count()))
        known = self.table()
        fresh = materialise(groups.join(known.hint("merge"), "digest", "left_anti"), "fresh-digests")
        self._write(fresh, version)
        known = self.table().select("digest", F.col("keep_id").alias("stays"))
        settled = materialise(groups.join(known.hint("merge"), "digest").select("digest", "stays", "group_size"), "settled")
        held = self.table().count()
        if self.files() > MAX_FILES * version[1] or self._needed(held) > 2 * version[1]:
            self.compact(held)
        self.close()
        # A hot digest's rows are split by adaptive execution: both sides are scans with an exchange of their own.
        joined = batch.alias("b").join(settled.alias("s").hint("merge"), "digest")
        return joined.select("b.doc_id", F.col("stays").alias("keep_id"), "group_size", F.col("b.doc_id").eqNullSafe(F.col("stays")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def drop(self) -> None:
        """Removes the index and its files."""
        self.close()
        self._files.delete(self._hadoop(self.path), True)


def exact_dedup(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Decisions on one batch against a fresh index, which goes again once they are written."""
    spark = docs.sparkSession
    index = DigestIndex(spark, f"{shared_dir(spark)}/bitloom/index-{uuid.uuid4().hex}", buckets)
    try:
        return materialise(index.ingest(docs), "decisions")
    finally:
        index.drop()
