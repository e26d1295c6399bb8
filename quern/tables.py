"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .errors import EngineProblem
from .session import ship

_left: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a single machine (tests) where that is unset, one of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quern.shared.folder", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineProblem("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.shared.folder", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables of one job. A table can be read again after any executor is lost."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/quern/{name}-{uuid.uuid4().hex}", 0
        self.buckets: dict[str, str] = {}
        _left.append((spark, self.path))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, names: list[str], parts: int) -> tuple[DataFrame, int, str]:
        """A written table dealt by its columns, so that a join on them moves only the other side; as `counted`."""
        self.n += 1
        name, seen = f"t{self.n}", Observation()
        table = f"quern_{os.path.basename(self.path).replace('-', '_')}_{name}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.bucketBy(parts, *names).option("path", f"{self.path}/{name}").saveAsTable(table)
        self.buckets[name] = table
        return self.spark.table(table), seen.get["n"], name

    def counted(self, df: DataFrame) -> tuple[DataFrame, int, str]:
        """A written table, its number of rows (counted while it is written) and its name."""
        self.n += 1
        name, seen = f"t{self.n}", Observation()
        out = self.table(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return out, seen.get["n"], name

    def drop(self, *names: str) -> None:
        """Delete tables whose readers have all finished."""
        for name in names:
            if name in self.buckets:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.buckets.pop(name)}")
            delete(self.spark, f"{self.path}/{name}")


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended
            return
