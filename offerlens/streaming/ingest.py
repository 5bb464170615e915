"""Offers as a stream: new files are read as they come, late repeats of an offer fall away, prices are kept per day.

An addition: batch runs and streams share the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.snapshots import OFFER_DAYS


def read_offers(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def without_repeats(offers: DataFrame, keys: list[str], at: str = "fetched_at", days: int = OFFER_DAYS) -> DataFrame:
    """First sighting of every key; state older than the offer window is dropped."""
    return offers.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(keys)


def daily_best(offers: DataFrame, item: str, price: str, at: str = "fetched_at", late: str = "1 day") -> DataFrame:
    """Least price and sightings per item and day."""
    return offers.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("day"), item).agg(F.min(price).alias("best_price"), F.count(F.lit(1)).alias("sightings"))


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").option("path", path).trigger(availableNow=True).start()
