"""The ledger as a sink of a stream: each batch once, and nothing invalid over what is valid or the other way round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.operators.ledger import remember


def _path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def ledger_sink(path: str, quarantine: str | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that merges units (``operators.ledger.ledger_units``) into the ledger at ``path``.

    What may not be merged goes to ``quarantine`` (by default beside the ledger), by
    batch. A batch that is done is noted in ``<path>.batches``, and does nothing when it
    comes again; one that failed midway is merged again, which changes nothing either, as a
    unit replaces only one of no more responses.
    """
    aside = quarantine or f"{path.rstrip('/')}.quarantine"

    def merge(units: DataFrame, batch: int) -> None:
        spark = units.sparkSession
        note = f"{path.rstrip('/')}.batches/batch={batch}"
        if _path_exists(spark, note):
            return
        refused = remember(spark, units, path)
        refused.write.mode("overwrite").parquet(f"{aside}/batch={batch}")
        spark.range(1).select(F.current_timestamp().alias("done")).write.mode("overwrite").parquet(note)

    return merge
