"""Small helpers shared by the operators: reading tables, checkpoints, bounded broadcasts, let-bindings."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words: space and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]+"
#: Most bytes of strings in a broadcast table.
MAX_BROADCAST_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def column(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(column(text).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for an empty text."""
    return F.array_remove(F.split(text, SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one set in the context or named in spark.checkpoint.dir.

    Where neither is set, a temporary folder serves a local master; on a cluster, whose machines do not see each
    other's disks, that is an error.
    """
    sc = spark.sparkContext
    if folder := sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage; survives the loss of executors."""
    folder, sc = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder, for loops: unlike a checkpoint a table has no estimate of its size left over from the plan that made it
    (such estimates multiply with every join of a loop), and those that later ones supersede are dropped."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{shared_folder(self.spark).rstrip('/')}/table-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop_all_but_last(self) -> None:
        """Drop the tables before the last one, which must not be read any more."""
        for name in self.paths[:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = self.paths[-1:]


def broadcast_up_to(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows and max_bytes of strings, else as it is, for a shuffled join.

    df should be cheap to read (a checkpoint, or a small table); its columns are numbers, strings and bytes.
    """
    wide = [F.octet_length(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(0)).cast("long")
    rows, bytes_ = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and bytes_ <= max_bytes else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_on_id(left: DataFrame, right: DataFrame, left_id: str, right_id: str, how: str) -> DataFrame:
    """Equi-join in which null ids match null ids."""
    return left.join(right, F.col(left_id).eqNullSafe(F.col(right_id)), how)


def by_characters(batch: pa.RecordBatch, text: int = 1, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose texts (column number text) have at most so many characters, or of one row."""
    sizes, at, size = pc.utf8_length(batch.column(text)).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > at and size + n > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)
