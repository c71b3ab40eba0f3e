"""The transaction-cleaning stage as a Structured Streaming job.

New monthly parts landing in a folder are cleaned (F1, month labels,
dates) and priced (stream-static left join against the price list reduced
to one row per service key) and appended to an output table.  The job is
stateless, so exactly-once output comes from the file sink plus the
stream checkpoint, which lives in the sink's own folder: a restarted
application finds it again, and two sinks never share one; ``availableNow`` processes what is there and stops,
``processingTime`` keeps it running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from clientele.operators.clean import clean_transactions
from clientele.operators.pricing import price_lookup


def cleaned_stream(spark: SparkSession, source: str, schema: StructType | str, pricelist: DataFrame,
                   label: str = "Month", years=("24", "25"), max_files_per_trigger: int = 64) -> DataFrame:
    """Streaming DataFrame: parts read as they arrive, cleaned and priced."""
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source))
    return price_lookup(clean_transactions(raw, label, years), pricelist)


def run_ingest(spark: SparkSession, source: str, schema: StructType | str, pricelist: DataFrame,
               sink: str, label: str = "Month", years=("24", "25"), available_now: bool = True,
               checkpoint: str | None = None):
    """Start the job writing Parquet to ``sink``; the stream checkpoint is the
    folder ``_stream_checkpoint`` in it (which readers skip) unless one is given.  With
    ``available_now`` the call returns after the backlog is processed."""
    ckpt = checkpoint or sink.rstrip("/") + "/_stream_checkpoint"
    q = (cleaned_stream(spark, source, schema, pricelist, label, years).writeStream
         .format("parquet").option("path", sink).option("checkpointLocation", ckpt).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    handle = q.start()
    if available_now:
        handle.awaitTermination()
    return handle
