"""Price history over pulls: changes and daily summaries."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.staging import Files, staged


def price_changes(df: DataFrame, keys: list[str], order: list[str], price: str = "price") -> DataFrame:
    """previous and delta against the row before of the same keys; null for the first."""
    window = f"PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)}"
    return df.withColumn("previous", F.expr(f"lag({price}) OVER ({window})")).withColumn("delta", F.col(price) - F.col("previous"))


class LatestPrices:
    """The latest price of every key, bucketed by key, so that a pull is compared with it without moving it.

    Each pull makes a new version: an external bucketed table under root, then a numbered commit file renamed into place; the two
    newest versions stay.  A pull that fails before its commit leaves the state as it was, and can be applied again.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.root, self.keys, self.buckets, self.files = spark, root.rstrip("/"), list(keys), buckets, Files(spark, root)

    def _commits(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("_commits") if n.isdigit())

    def current(self) -> DataFrame | None:
        """keys and price of the newest version; None before the first pull."""
        if not (done := self._commits()):
            return None
        commit = json.loads(self.files.text(f"_commits/{done[-1]:012d}"))
        if not self.spark.catalog.tableExists(commit["table"]):  # another session's catalog
            columns = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(
                f"CREATE TABLE `{commit['table']}` ({commit['schema']}) USING parquet CLUSTERED BY ({columns}) SORTED BY ({columns}) "
                f"INTO {commit['buckets']} BUCKETS LOCATION '{self.root}/{commit['table']}'"
            )
        return self.spark.table(commit["table"])

    def changes(self, pull: DataFrame, order: list[str], price: str = "price") -> DataFrame:
        """The rows of a pull with previous and delta: against the row before of the same keys in the pull, of the first one against the state."""
        changed = price_changes(pull, self.keys, order, price).withColumn("__first", F.expr(f"row_number() OVER (PARTITION BY {', '.join(self.keys)} ORDER BY {', '.join(order)})") == 1)
        if (state := self.current()) is None:
            return changed.drop("__first")
        known = state.select(*self.keys, F.col("__price").alias("__known"))
        changed = changed.join(known.hint("merge"), self.keys, "left").withColumn("previous", F.when(F.col("__first"), F.col("__known")).otherwise(F.col("previous")))
        return changed.withColumn("delta", F.col(price) - F.col("previous")).select(*pull.columns, "previous", "delta")

    def apply(self, pull: DataFrame, order: list[str], price: str = "price") -> DataFrame:
        """changes() of the pull, written out, and the state moved on by it: the last price of each key.

        Pulls are applied in their order.  Rows with a null key are compared within their pull only and are not kept.
        """
        changed, state, number = staged(self.changes(pull, order, price)), self.current(), max(self._commits(), default=-1) + 1
        full = F.lit(True)
        for k in self.keys:
            full = full & F.col(k).isNotNull()
        last = pull.where(full).groupBy(*self.keys).agg(F.max_by(F.struct(F.col(price).alias("p")), F.struct(*order)).alias("__last"))
        if state is not None:
            last = state.hint("merge").join(last, self.keys, "full").withColumn("__price", F.when(F.col("__last").isNull(), F.col("__price")).otherwise(F.col("__last.p")))
        else:
            last = last.withColumn("__price", F.col("__last.p"))
        last, table = last.select(*self.keys, "__price"), f"latest_{uuid.uuid4().hex}"
        last.repartition(self.buckets, *self.keys).write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).format("parquet").option("path", f"{self.root}/{table}").saveAsTable(table)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in last.schema)
        if not self.files.put(f"_commits/{number:012d}", json.dumps({"table": table, "schema": schema, "buckets": self.buckets})):
            raise RuntimeError("another pull was applied meanwhile; apply this one again")
        for old in self._commits()[:-2]:
            gone = json.loads(self.files.text(f"_commits/{old:012d}"))["table"]
            self.files.drop(f"_commits/{old:012d}")
            self.spark.sql(f"DROP TABLE IF EXISTS `{gone}`")
            self.files.drop(gone)
        return changed


def daily_summary(df: DataFrame, keys: list[str], at: str, price: str = "price") -> DataFrame:
    """n, low, high per keys and day."""
    day = F.date_trunc("day", F.col(at)).cast("date")
    return df.groupBy(*keys, day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(price).alias("low"), F.max(price).alias("high"))


def append_snapshot(stations: DataFrame, pull_date: str, path: str) -> None:
    """One pull's prices in long form, in the folder of its date; a repeated pull replaces its own date only."""
    long = stations.select(
        "country", F.col("id").alias("station_id"), F.posexplode("prices").alias("price_ord", "p")
    ).select("country", "station_id", "price_ord", "p.*")
    long.write.mode("overwrite").parquet(f"{path.rstrip('/')}/pull_date={pull_date}")
