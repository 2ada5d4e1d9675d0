"""Shared helpers: session settings, scratch tables in the shared folder, files on any store, graph components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollmark.session import configure, ensure_checkpoint_dir
from rollmark.sources.files import filesystem

#: One Arrow batch holds at most so many bytes and rows, whatever the length of the texts.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: the package's own, and bounded Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind; later steps must read the tables."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables and files of one run, in a folder of its own under the shared checkpoint folder.

    A table that is written here cuts lineage: a lost executor costs its tasks, not the steps before.
    ``drop`` removes what later steps no longer read; ``clear`` removes the whole folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def write_file(uri: str, payload: bytes) -> None:
    """Write a file under another name and move it, so that a repeated task leaves one whole file."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex[:12]}"
    with store.open_output_stream(draft) as out:
        out.write(payload)
    store.move(draft, path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (``a``, ``b`` long): equal roots are connected.

    Each round lets every node point at its least neighbour, or stay if it is least itself, and
    contracts the edges by that. The order is another one each round (an exclusive-or with the
    round's constant), so chains shrink by a fraction a round as well, whatever their ids. Nodes
    without an edge left drop out; the pointers of the rounds are composed at the end.
    """
    constants = [0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x27BB2EE687B0B0FD]
    left = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges0")
    rounds: list[DataFrame] = []
    while not is_empty(left):
        key = F.lit(constants[len(rounds) % 5] ^ (len(rounds) << 7))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(key)).alias("m"))
        least = least.select(F.col("a").alias("node"), F.least("m", F.col("a").bitwiseXOR(key)).bitwiseXOR(key).alias("to"))
        least = scratch.table(least, f"points{len(rounds)}")
        rounds.append(least)
        moved = (
            left.join(least.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(least.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        left = scratch.table(moved, f"edges{len(rounds)}")
        scratch.drop(f"edges{len(rounds) - 1}")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0].select("node", F.col("to").alias("root"))
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("to").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
