"""Chat records of files as they arrive, each batch written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ChatConfig
from ..operators.dedupe import messages_key
from ..plans.chat import ORDER, file_arrays
from ..operators.filters import token_budget

FILES = "path string, suffix string, text string"


def stream_records(files: DataFrame, config: ChatConfig | None = None, watermark: str | None = None) -> DataFrame:
    """Records of a stream of files (path, suffix, text), within budget and cap, each exchange once.

    State is one hash for each exchange seen. With a watermark on `ts`, hashes older than it are let go.
    """
    config = config or ChatConfig()
    arrays = file_arrays(files, config)
    kept = F.slice(F.filter("records", lambda r: token_budget(r["record"]["messages"], config.min_tokens, config.max_tokens)), 1, config.file_cap)
    extra = ["ts"] if watermark else []
    each = arrays.select("path", *extra, F.explode(kept).alias("r")).select("path", *extra, "r.item_seq", "r.builder_seq", "r.sub_seq", "r.record.*")
    keyed = each.withColumn("exchange", messages_key(F.col("messages")))
    if watermark:
        return keyed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["exchange"])
    return keyed.dropDuplicates(["exchange"])


def run_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, config: ChatConfig | None = None) -> StreamingQuery:
    """Read files as JSON lines from a folder, write records by batch; a batch that is run again replaces itself."""
    files = spark.readStream.schema(FILES).json(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.drop("exchange").write.mode("overwrite").json(f"{out}/batch={number}")

    return stream_records(files, config).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["FILES", "ORDER", "run_stream", "stream_records"]
