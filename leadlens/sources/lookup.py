"""A lead table laid out for lookups by id: no scan of the whole table, no shuffle of its rows.

``save_lookup`` writes a table bucketed and sorted by id, with a Parquet Bloom filter and page
index on the id.  A request of any size is joined with it on the buckets: only the request is
exchanged.  ``lookup`` decides by the number of distinct ids asked for, which it counts up to
``FEW`` and no further.  A few ids become a literal list in the scan, so that buckets without
any of them are not read at all (bucket pruning) and row groups without them are passed over
(min and max, Bloom filter); more are joined.

The number of buckets is a choice at writing time: rows / buckets is what one task of the join holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import lookup_ids

FEW = 100     # distinct ids up to which a request becomes literals; Spark prunes buckets for such lists


def save_lookup(df: DataFrame, table: str, path: str, buckets: int, id_col: str = "lead_id") -> DataFrame:
    """Write ``df`` as the external table ``table`` under ``path``; rows of one id share a bucket.

    The rows are exchanged once, so that each bucket is one sorted file."""
    df.repartition(buckets, id_col).write.mode("overwrite").format("parquet") \
        .option("path", path).option(f"parquet.bloom.filter.enabled#{id_col}", "true") \
        .option("parquet.bloom.filter.adaptive.enabled", "true") \
        .bucketBy(buckets, id_col).sortBy(id_col).saveAsTable(table)
    return df.sparkSession.table(table)


def few_ids(requests: DataFrame, id_col: str = "lead_id") -> list | None:
    """The distinct non-null ids asked for, or None if there are over FEW."""
    ids = [r[0] for r in requests.select(id_col).where(F.col(id_col).isNotNull()).distinct().limit(FEW + 1).collect()]
    return sorted(ids) if len(ids) <= FEW else None


def lookup(spark: SparkSession, table: str, requests: DataFrame, id_col: str = "lead_id") -> DataFrame:
    """Every distinct requested id with ``found`` and, where it exists, the lead's columns; a null id is not found."""
    leads = spark.table(table)
    ids = few_ids(requests, id_col)
    if ids is not None:
        leads = leads.where(F.col(id_col).isin(ids))
    return lookup_ids(leads, requests, id_col)
