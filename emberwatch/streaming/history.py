"""As-of history of a stream of series: rows in hour folders, and fences that count them.

Every epoch appends its rows below ``rows/epoch=/dt=`` and, per service and hour, their number below ``fences``. Counts tell
which hours hold the rows just before and after a point in time, however long a series was silent, so a late row opens
these few folders by name and nothing is listed or searched. Fences of many epochs are folded into one sorted table.

An epoch reads what earlier epochs wrote and overwrites its own folders only, so a replayed epoch changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.plans.durable import durable
from emberwatch.sources.sinks import hour_partition

FOLD = 50  # epochs whose fences are folded into one table
FENCE = "service string, dt string, epoch int, rows long"
HOUR = ["service", "dt"]


@dataclass(frozen=True)
class History:
    spark: SparkSession
    path: str
    schema: T.StructType

    def fences(self, epoch: int) -> DataFrame:
        """Rows per service, hour and epoch, of the epochs before ``epoch``."""
        folded = (epoch - 1) // FOLD * FOLD if epoch else 0
        if epoch and epoch % FOLD == 0:
            self._fences(epoch, epoch - FOLD).sort("service", "dt").write.mode("overwrite").parquet(f"{self.path}/folded/upto={epoch}")
            folded = epoch
        return self._fences(epoch, folded)

    def _fences(self, epoch: int, folded: int) -> DataFrame:
        paths = [f"{self.path}/fences/epoch={e}" for e in range(folded, epoch)]
        paths += [f"{self.path}/folded/upto={folded}"] if folded else []
        read = self.spark.read.schema(FENCE)
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], FENCE)

    def rows(self, fences: DataFrame) -> DataFrame:
        """All rows of the (hour, epoch) folders that ``fences`` names; their number is bounded by those hours."""
        found = fences.select("epoch", "dt").distinct().collect()
        if not found:
            return self.spark.createDataFrame([], self.schema).withColumn("dt", F.lit(None).cast("string"))
        kinds = T.StructType([*self.schema.fields, T.StructField("epoch", T.IntegerType()), T.StructField("dt", T.StringType())])
        read = self.spark.read.schema(kinds).option("basePath", f"{self.path}/rows")
        return read.parquet(*sorted(f"{self.path}/rows/epoch={r['epoch']}/dt={r['dt']}" for r in found)).drop("epoch")

    def append(self, batch: DataFrame, epoch: int, fences: DataFrame) -> DataFrame:
        """Writes the rows of ``batch`` whose (service, timestamp) is new, once each; returns their fences."""
        dated = batch.dropDuplicates(["service", "timestamp"]).withColumn("dt", hour_partition(F.col("timestamp")))
        touched = dated.select(*HOUR).distinct()
        before = self.rows(fences.join(touched, HOUR, "left_semi")).select("service", "timestamp")
        fresh = dated.join(before, ["service", "timestamp"], "left_anti").select(*dated.columns)
        fresh.hint("rebalance", "dt").write.mode("overwrite").partitionBy("dt").parquet(f"{self.path}/rows/epoch={epoch}")
        own = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("dt", T.StringType())]))
        own = own.parquet(f"{self.path}/rows/epoch={epoch}").groupBy(*HOUR).agg(F.count(F.lit(1)).alias("rows"))
        own = own.select(*HOUR, F.lit(epoch).alias("epoch"), "rows")
        own.write.mode("overwrite").parquet(f"{self.path}/fences/epoch={epoch}")
        return self.spark.read.schema(FENCE).parquet(f"{self.path}/fences/epoch={epoch}")

    def around(self, epoch: int, fences: DataFrame, fresh: DataFrame, reach: int) -> DataFrame:
        """Rows of the hours with rows of ``epoch`` (``fresh`` has its fences) and of the hours that hold the ``reach``
        rows before and after them, with ``_new`` for those of ``epoch``."""
        services = fresh.select("service").distinct()
        both = durable(fences.join(services, "service", "left_semi").unionByName(fresh), "fences")
        hours = both.groupBy(*HOUR).agg(F.sum("rows").alias("rows"), F.max(F.col("epoch") == epoch).alias("touched"))
        # A row per service and hour: an hour is needed if the next touched one begins, or the last one ended, within reach.
        line = W.partitionBy("service").orderBy("dt")
        ends = F.sum("rows").over(line)
        hours = hours.withColumns({"ends": ends, "starts": ends - F.col("rows")})
        begun = F.min(F.when(F.col("touched"), F.col("starts"))).over(line.rowsBetween(0, W.unboundedFollowing))
        ended = F.max(F.when(F.col("touched"), F.col("ends"))).over(line.rowsBetween(W.unboundedPreceding, 0))
        needed = (F.col("ends") > begun - reach) | (F.col("starts") < ended + reach)
        needed = durable(hours.withColumn("needed", needed).where("needed").select(*HOUR), "hours")
        wanted = both.join(needed, HOUR, "left_semi")
        old = self.rows(wanted.where(F.col("epoch") < epoch)).withColumn("_new", F.lit(False))
        own = self.rows(wanted.where(F.col("epoch") == epoch)).withColumn("_new", F.lit(True))
        return old.unionByName(own).join(needed, HOUR, "left_semi").drop("dt")
