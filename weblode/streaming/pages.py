"""Pages as a stream: the parse is stateless, so the same operators run on arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weblode.operators import documents
from weblode.operators.prompt import Query

PAGE = "page_id long, url string, html string"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def chunk_stream(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """Article chunks of arriving pages."""
    return documents.article_chunks(pages, keywords)


def write_documents(pages: DataFrame, q: Query, folder: str, checkpoint: str) -> StreamingQuery:
    """Parsed documents of each batch, one Parquet folder a batch; a batch that is run again overwrites its own."""

    def save(batch: DataFrame, number: int) -> None:
        documents.parsed_documents(batch, q).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return pages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
