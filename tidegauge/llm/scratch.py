"""Written intermediate tables in the shared folder of the cluster.

Every multi-step operator cuts its lineage by writing a step as Parquet below
``spark.checkpoint.dir``, which all executors share, so a lost executor costs a
re-read and never a re-run of earlier steps.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session. A local session that names none (as in tests) gets one; a cluster has to name it."""
    found = spark.conf.get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{KEY} has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


class Scratch:
    """A family of written tables of one run; ``keep`` tables outlive ``close``."""

    #: Roots of the runs whose results still lie in the shared folder.
    kept: set[str] = set()

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def path(self, name: str) -> str:
        """The place of a table or folder below the root; ``close`` deletes it as well."""
        self.kept.add(self.root)
        return self.paths.setdefault(name, f"{self.root}/{name}")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete written tables that no later step reads."""
        for name in names:
            delete(self.spark, self.path(name))
            self.paths.pop(name, None)

    def close(self, *keep: str) -> None:
        self.drop(*[x for x in list(self.paths) if x not in keep])
        if not self.paths:
            self.discard()

    def discard(self) -> None:
        """Delete all, kept results included."""
        delete(self.spark, self.root)
        self.kept.discard(self.root)


def delete(spark: SparkSession, uri: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(uri)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def steps(name: str):
    """Give an operator whose first argument is a DataFrame a ``scratch``, of which nothing stays if the operator fails."""

    def wrap(operator):
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **options):
            scratch = Scratch(docs.sparkSession, name)
            try:
                return operator(docs, *args, scratch=scratch, **options)
            except BaseException:
                scratch.discard()
                raise

        return run

    return wrap


def clean(spark: SparkSession) -> None:
    """Delete the results of all operators of this process, which their DataFrames read; for when none is needed any more."""
    for root in list(Scratch.kept):
        delete(spark, root)
        Scratch.kept.discard(root)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
