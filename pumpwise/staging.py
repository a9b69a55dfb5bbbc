"""Tables between steps in the folder that all executors share, and small files there, by Hadoop's file systems."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder set in the context or in spark.checkpoint.dir; a local master without one gets a temporary folder, a cluster an error."""
    sc = spark.sparkContext
    if folder := sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: values that a second run would give anew stay, and the lineage ends, whatever executor is lost."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Names, small texts, renaming and removal under a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._root = spark._jvm, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{name}" if name else self._root)

    def names(self, folder: str = "") -> list[str]:
        """What is in a folder, sorted; nothing if there is none."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a small file under another name and rename it: it is there whole or not at all.  False if the name is taken."""
        draft = self._path(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        if not self._fs.exists(self._path(name)) and self._fs.rename(draft, self._path(name)):
            return True
        self._fs.delete(draft, False)
        return False

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
