"""Arrival-driven ingest (I1) and scheduled ingest (I2) with Structured Streaming.

The completion marker ``config.json`` is uploaded last. A clock source wakes a
micro-batch; the batch looks for markers whose path and modification time no published
run has taken, so every upload of a marker starts a run, also at the same
path. The batch job then takes everything under the prefix (the reference's triggered run
receives no parameters, S31).

What is done is recorded by the run itself: the commit that publishes a run also
names its markers, its registry and its summary, and sources are deleted after that. A query that is
restarted, whenever it was lost, neither repeats a published run nor loses its summary, and finishes the clean-up.
A marker that is uploaded while a run is under way has another modification time than the one the run
took: it is not deleted, and starts the next run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featurespark.sources.ingest import IngestOptions, finish_runs, pending_markers, run_ingest, unfinished_runs


def _clock(spark: SparkSession) -> DataFrame:
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()


def _every_batch(spark: SparkSession, job, checkpoint: str, available_now: bool, every: str):
    w = _clock(spark).writeStream.foreachBatch(lambda _batch, _epoch: job()).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()


def ingest_on_arrival(spark: SparkSession, opts: IngestOptions, checkpoint: str,
                      available_now: bool = False, every: str = "1 minute"):
    """Start the stream; returns the ``StreamingQuery``.

    ``available_now=True`` takes what has arrived and stops (tests, cron-style runs);
    otherwise the query looks every ``every``.
    """
    def job() -> None:
        if unfinished_runs(spark, opts):
            finish_runs(spark, opts)
        if pending_markers(spark, opts):
            run_ingest(spark, opts)

    return _every_batch(spark, job, checkpoint, available_now, every)


def scheduled_ingest(spark: SparkSession, opts: IngestOptions, checkpoint: str, every: str = "1 hour",
                     available_now: bool = False):
    """The same job on a fixed schedule (``rate(1 hour)``), over the whole prefix, marker or not."""
    return _every_batch(spark, lambda: run_ingest(spark, opts), checkpoint, available_now, every)
