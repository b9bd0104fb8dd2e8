"""Written tables that cut a lineage, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for local sessions that name no folder (tests).
LOCAL_FOLDER = "/tmp/checkpoints/textrine"


class Scratch:
    """``keep`` writes a table and rereads it, so that a lost executor costs the step that runs; ``drop`` removes what is read no more."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = LOCAL_FOLDER
        self.spark, self.root, self.kept = spark, f"{base.rstrip('/')}/textrine-{name}-{uuid.uuid4().hex[:12]}", []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.kept):03d}-{name}"
        self.kept.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, folder: str = "") -> None:
        """All tables of this scratch go, or what is in one folder of it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}" if folder else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
