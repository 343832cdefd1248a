"""Index files as a stream: an extension, batch builds being the rule.

Text files of index lines that arrive in a folder are parsed as they come; a book that
arrives again replaces its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import parse_index
from ..sources.readers import lines


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, strategy: str = "capitalize", once: bool = True) -> StreamingQuery:
    """Starts the stream; with once it stops when all present files are read."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"\.[^.]*$", "")
    arrived = files.select(name.alias("book_key"), F.col("value").alias("text"))

    def replace(batch: DataFrame, _: int) -> None:
        parsed = parse_index(lines(batch), strategy)
        parsed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_key").parquet(table)

    writer = arrived.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
