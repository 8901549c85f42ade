"""Encode labelled line files as they land in a directory.

The reference encodes a fixed list of files in one batch run. The same chain
(read lines -> path columns -> strip/parse -> encode -> attach sample codes ->
assemble) is stateless per row, so it also runs unchanged on a file stream:
each new file is encoded once, and the checkpoint makes a restarted query skip
files already done. The sample-code dimension is a static DataFrame joined to
the stream (broadcast when its size check passes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epiframe.operators.examples import encode_examples
from epiframe.sources.text import clean_lines, parse_fields, with_path_columns


def encode_stream(spark: SparkSession, path: str, sample_codes: DataFrame,
                  variant: str = "base", fields: int = 2, sample_id_col: str = "sample_id",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of encoded examples from text files under ``path``.

    ``sample_codes`` must be keyed by the sample name parsed from the path
    (``sample``), renamed to ``sample_id_col``.
    """
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = with_path_columns(reader.load(path))
    parsed = parse_fields(clean_lines(lines), fields)
    parsed = parsed.withColumnRenamed("sample", sample_id_col)
    return encode_examples(parsed, sample_codes, variant, key=sample_id_col)


def start_encode_stream(spark: SparkSession, path: str, sample_codes: DataFrame, out: str,
                        checkpoint: str, variant: str = "base", fields: int = 2,
                        available_now: bool = True):
    """Write encoded examples to Parquet partitioned by split/sample/label.

    ``checkpoint`` must be on shared storage (for example below
    ``spark.checkpoint.dir``). ``available_now`` processes what is there and stops.
    """
    df = encode_stream(spark, path, sample_codes, variant, fields)
    w = (df.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint)
         .partitionBy("split", "sample_id", "label").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
