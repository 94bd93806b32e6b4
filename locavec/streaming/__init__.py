"""Row-wise operators on a streaming DataFrame.

Canonicalization and the batch encoders are narrow, so they run unchanged on ``readStream`` input;
nothing else in the library keeps state, and no other streaming surface is offered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def run_once(spark: SparkSession, source: str, schema, transform, out: str, checkpoint: str | None = None) -> DataFrame:
    """Push every file now in ``source`` through ``transform`` and return what was written."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    q = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint or shared_dir(spark, "stream"))
        .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
