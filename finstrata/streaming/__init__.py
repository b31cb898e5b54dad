"""Landing of bars as a file stream: each micro-batch replaces its tickers' bars from its first day on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from finstrata.sinks import replace_from_date

BARS_SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def bars_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(BARS_SCHEMA).json(path)


def store_bars(stream: DataFrame, read_stored: Callable[[], DataFrame], store: Callable[[DataFrame, int], None],
               checkpoint: str) -> StreamingQuery:
    """Runs what is available: *store* receives the merged table and the batch id, *read_stored* gives the table before."""
    def batch(df: DataFrame, batch_id: int) -> None:
        store(replace_from_date(read_stored(), df.dropDuplicates(["ticker", "date"]), "ticker"), batch_id)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
