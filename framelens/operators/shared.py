"""Tables in the shared folder, and joins that bear very frequent keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least one of so many parts of all rows. So at most this many keys are
#: hot, whatever the input's size: that is the bound of every table of hot keys that is broadcast.
HOT_PARTS = 1000


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared place that the session names; without one a temporary folder, in a single local process only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, into: str | None = None) -> DataFrame:
    """The same rows as a table in the shared folder: it ends the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = into or scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Shelf:
    """Intermediate tables of one run in the shared folder, each of which can go as soon as it is used up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self._paths = spark, scratch(spark), {}

    def put(self, df: DataFrame) -> DataFrame:
        """The same rows as a stored table."""
        path = f"{self.root}/{len(self._paths)}"
        out = stored(df, path)
        self._paths[len(self._paths)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for k, (table, path) in self._paths.items():
            if any(table is x for x in tables):
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
                self._paths[k] = (None, path)


def hot_join(left: DataFrame, right: DataFrame, keys: Sequence[str], total: int, n: str = "_n") -> DataFrame:
    """Inner equi-join of ``left`` with one row a key of ``right``, safe for keys with very many rows in ``left``.

    ``right[n]`` is the number of rows that the key has in ``left``; ``total`` is their sum. The keys with at
    least a ``HOT_PARTS``-th of all rows (``HOT_PARTS`` keys at most, so their broadcast is bounded) are joined
    where the rows are; the others, none of which can fill a task, are joined by a shuffle.
    """
    hot = right.filter(F.col(n) * HOT_PARTS >= F.lit(total))
    cold = right.filter(F.col(n) * HOT_PARTS < F.lit(total))
    near = left.join(F.broadcast(hot), list(keys))
    far = left.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(cold, list(keys))
    return near.unionByName(far)
