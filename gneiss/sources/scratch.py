"""Tables that a query writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master gets a temporary folder where that is unset: the executors of a cluster
    would each write to a folder of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables in the shared folder. They cut lineage, outlive lost executors and go when the driver ends or drop() is called."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        Scratch.made.append(self)
        self.spark, self.root = spark, f"{shared_dir(spark)}/gneiss-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.drop)

    def write(self, df: DataFrame) -> DataFrame:
        """Writes the frame and returns it as read back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes these tables, or all."""
        try:
            jvm = self.spark._jvm
            conf = self.spark._jsc.hadoopConfiguration()
            for p in [f._scratch_path for f in frames] or [self.root]:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone; what is left is only scratch
            if frames:
                raise

    @staticmethod
    def drop_since(n: int) -> None:
        """Deletes all tables of the scratches made after the first n, whose results are written."""
        for s in Scratch.made[n:]:
            s.drop()
            atexit.unregister(s.drop)
        del Scratch.made[n:]
