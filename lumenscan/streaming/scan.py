"""Scans of file streams. Line scans keep no state between files, so the batch plans run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenscan.catalog.tables import newest
from lumenscan.operators.metrics import loc
from lumenscan.operators.secrets import finding_rows, line_matches, scannable, selected
from lumenscan.operators.secrets import ScanOptions
from lumenscan.functions.paths import SECRET_IGNORED
from lumenscan.sources.files import lines


def file_stream(spark: SparkSession, folder: str, schema: str = "path string, content string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def loc_stream(files: DataFrame) -> DataFrame:
    """Lines of code of each file as it arrives."""
    return files.select("path", loc(F.col("content")).alias("x")).select("path", "x.*")


def secret_sink(files: DataFrame, folder: str, checkpoint: str, options: ScanOptions | None = None, rules_folder: str | None = None) -> StreamingQuery:
    """Secrets of each micro-batch, written as Parquet under the batch's id, so that a repeated batch overwrites itself. With a folder of
    published rules, each batch uses the version that is the newest when it starts."""
    options = options or ScanOptions()

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter(scannable(F.col("path"), options, SECRET_IGNORED)).withColumn("file_ord", F.monotonically_increasing_id())
        rules = newest(batch.sparkSession, rules_folder) if rules_folder else None
        found = selected(finding_rows(line_matches(lines(rows), rules)), options).drop("file_ord")
        found.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
