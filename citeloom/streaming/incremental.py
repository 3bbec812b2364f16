"""Streaming forms: documents checked as they arrive, increments with resume, and a cache with expiry."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeloom import constants as K
from citeloom.functions import citations as C
from citeloom.functions import text as X
from citeloom.session import forget_at_exit, shared_dir


def run_available(stream: DataFrame, sink: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """What there is now, once: appended to a parquet sink, or handed to `each` batch by batch; a restart goes on where it ended."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(each) if each else w.format("parquet").option("path", sink)).start()
    q.awaitTermination()


def citation_stream(spark: SparkSession, path: str, index: DataFrame, reporters: Sequence[str] = tuple(K.REPORTERS), schema: str = "doc_id bigint, text string, collected_at timestamp_ntz") -> DataFrame:
    """Citations of arriving documents, resolved against a static index; stateless, so late rows are no matter."""
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern it may name a folder or a single file
    docs = spark.readStream.schema(schema).parquet(path).select("doc_id", "text")
    p = C.reporter_pattern(reporters)
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).alias("citation_string"))
    return found.join(index, "citation_string", "left").withColumn("resolved", F.col("case_id").isNotNull())


def first_seen(docs: DataFrame, time: str, delay: str = "7 days") -> DataFrame:
    """Arriving texts without repeats within the watermark, by hash."""
    return docs.withColumn("text_hash", X.text_hash(F.col("text"))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_hash"])


def window_counts(docs: DataFrame, time: str, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Documents per source and window; windows close when the watermark passes them."""
    return docs.withWatermark(time, delay).groupBy(F.window(time, width), "source").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "source", "n")


def resume(done_path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch handler that leaves out keys already in the sink and appends the rest."""

    def each(batch: DataFrame, _: int) -> None:
        try:
            batch = batch.join(batch.sparkSession.read.parquet(done_path).select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        work(batch.dropDuplicates([key])).write.mode("append").parquet(done_path)

    return each


def cached(requests: DataFrame, key: str, compute: Callable[[str], str], ttl_ms: int = 3_600_000) -> DataFrame:
    """(key, value, hit): `compute` once per key and lifetime; state expires by processing time."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hit = state.exists
        value = state.get[0] if hit else compute(k[0])
        n = sum(len(b) for b in batches)
        if not hit:
            state.update((value,))
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({key: [k[0]] * n, "value": [value] * n, "hit": [hit] + [True] * (n - 1)})

    return requests.groupBy(key).applyInPandasWithState(update, f"{key} string, value string, hit boolean", "value string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def checked_now(spark: SparkSession, path: str, index: DataFrame, reporters: Sequence[str] = tuple(K.REPORTERS)) -> DataFrame:
    """The stream of documents run to its present end, as a table."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    forget_at_exit(base)
    run_available(citation_stream(spark, path, index, reporters), f"{base}/out", f"{base}/state")
    return spark.read.schema("citation_string string, doc_id bigint, case_id bigint, case_name string, resolved boolean").parquet(f"{base}/out")
