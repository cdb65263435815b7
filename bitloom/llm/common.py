"""Shared folder, materialisation and Arrow helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset on a single machine, a folder of the application's own is used; on a cluster there is no folder
    that could be guessed, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


#: Narrow rows that make up a file where their number is known.
ROWS_PER_FILE = 50_000


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and a lost executor costs nothing.

    The files go when the application ends. rows: what the table has at most, if that is known; there are then no more
    files than so many rows need, as each costs its writer a few processes on a local file system.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    path = f"{shared_dir(spark)}/bitloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_bytes(column: str = "text") -> Column:
    """The whole text in UTF-8."""
    return whole_text(column).cast("binary")


_REMEMBERED: dict[object, object] = {}


def remembered(key: object, make: Callable[[], object]) -> object:
    """What this worker remembers between tasks under a key. It remembers one thing at a time: stages do not add up."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget() -> None:
    """Lets go of what this worker remembers."""
    _REMEMBERED.clear()


def per_row(df: DataFrame, schema: str, rows: Callable[[Iterator[tuple]], Iterator[tuple]], max_rows: int = 512, remembers: bool = False) -> DataFrame:
    """mapInArrow over tuples: `rows` gets an iterator of a partition's rows and yields output tuples.

    Input is taken in slices of max_rows, so that Python objects of one slice are held at a time. Tasks that do not say
    that they use `remembered` let go of what a worker remembers of earlier stages.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            forget()

        def flat():
            for batch in batches:
                for at in range(0, batch.num_rows, max_rows):
                    part = batch.slice(at, max_rows)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held = []
        for row in rows(flat()):
            held.append(row)
            if len(held) >= 2048:
                yield _batch(held, out)
                held = []
        if held:
            yield _batch(held, out)
        held = None
        pa.default_memory_pool().release_unused()  # workers serve many tasks

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Ids that are broadcast at most, 8 bytes each; beyond that the join is by sort and merge.
MAX_BROADCAST_IDS = 1_000_000


def keep_ids(docs: DataFrame, decisions: DataFrame, key: Column | None = None) -> DataFrame:
    """The rows of docs that are kept; decisions: a materialised table (doc_id, kept, key) with a row per row of docs.

    `key` tells rows of docs that share a doc_id (or have none) apart, as the column `key` of the decisions does: each is
    kept by its own decision, and of rows equal in both the one with the longest text stays. Without it a doc_id is kept
    if one of its decisions is, and of rows that repeat it one stays. The ids to drop and those that repeat are broadcast
    where they are few, so that texts are not shuffled; otherwise both sides are sorted by id. Keys are computed for
    repeated ids alone.
    """
    by_id = decisions.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    told = materialise(by_id.filter("NOT kept OR n > 1").select("doc_id", "kept"), "dropped-and-repeated-ids")
    dropped = told.filter("NOT kept").select(F.col("doc_id").alias("dropped_id"))
    repeated = told.filter("kept").select(F.col("doc_id").alias("repeated_id"))

    def dealt(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if side.count() <= MAX_BROADCAST_IDS else side.hint("merge")

    def held(rows: DataFrame, side: DataFrame, column: str, how: str) -> DataFrame:
        """Rows by whether their doc_id is in the table; aliases keep columns of any name in docs apart."""
        return rows.alias("_docs").join(side.alias("_ids"), F.col("_docs.doc_id").eqNullSafe(F.col(f"_ids.{column}")), how)

    rest = held(docs, dealt(dropped), "dropped_id", "left_anti")
    if repeated.isEmpty():
        return rest
    twice = dealt(repeated)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = held(rest, twice, "repeated_id", "left_semi").select(row, (F.lit(0) if key is None else key).alias("key"))
    longest = F.struct(F.length(whole_text("row.text")), F.xxhash64("row.text"))
    folded = keyed.groupBy(F.col("row.doc_id").alias("id"), "key").agg(F.max_by("row", longest).alias("row"))
    kept = decisions.filter("kept").select(F.col("doc_id").alias("kept_id"), (F.lit(0) if key is None else F.col("key")).alias("kept_key")).distinct()
    chosen = folded.join(kept.hint("merge"), F.col("id").eqNullSafe(F.col("kept_id")) & F.col("key").eqNullSafe(F.col("kept_key")), "left_semi")
    return held(rest, twice, "repeated_id", "left_anti").unionByName(chosen.select("row.*"))
