"""Lookups on the bucketed table: equal to the plain join, without an exchange of the leads, reading few buckets."""

import os
import re
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from leadlens.operators.select import lookup_ids
from leadlens.sources import lookup as L
from leadlens.sources.leads import leads_view

from conftest import SF_SMALL

BUCKETS = 16


@pytest.fixture(scope="module")
def table(spark):
    name = f"leads_by_id_{uuid.uuid4().hex[:8]}"
    path = tempfile.mkdtemp(prefix="leadlens-lookup-")
    L.save_lookup(leads_view(spark, SF_SMALL), name, f"{path}/t", BUCKETS)
    yield name
    spark.sql(f"DROP TABLE {name}")


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("ids", [[], [1, 2, 3], [5, 5, 10 ** 9, None], list(range(-50, 600))])
def test_equals_the_plain_join(spark, table, ids):
    req = spark.createDataFrame([(i,) for i in ids], "lead_id long")
    got = L.lookup(spark, table, req)
    assert rows(got) == rows(lookup_ids(leads_view(spark, SF_SMALL), req))
    assert got.count() == len(set(ids))


def test_large_request_exchanges_the_request_only(spark, table):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(L.lookup(spark, table, spark.range(5000).select(F.col("id").alias("lead_id"))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = p.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
    depth = re.search(r"\w", lines[scan]).start()
    above = []          # operators between the scan of the leads and the join
    for line in reversed(lines[:scan]):
        at = re.search(r"\w", line).start()
        if at < depth:
            above.append(line)
            depth = at
        if "Join" in line:
            break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above), p


def test_few_ids_read_few_buckets(spark, table):
    req = spark.createDataFrame([(i,) for i in (3, 77, 1200)], "lead_id long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # the plan names the buckets of a bucketed join only
    try:
        p = plan(L.lookup(spark, table, req))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    picked = int(re.search(r"SelectedBucketsCount: (\d+) out of 16", p).group(1))
    assert 1 <= picked <= 3
    assert re.search(r"lead_id#\d+L IN \(3,77,1200\)", p)
    # the scan itself, as a broadcast join reads it, has the splits of those files only
    assert spark.table(table).where(F.col("lead_id").isin([3, 77, 1200])).rdd.getNumPartitions() <= 3


def test_bloom_filter_is_written(spark, table):
    import pyarrow.parquet as pq
    files = [f.replace("file://", "").replace("file:", "") for f in spark.table(table).inputFiles()]
    assert len(files) == BUCKETS
    ids = [v for f in files for v in pq.read_table(f, columns=["lead_id"])["lead_id"].to_pylist()]
    assert len(ids) == len(set(ids)) == 1500
    for f in files:
        if pq.read_metadata(f).num_rows:      # a file with a filter is larger than its column chunks and footer need
            meta = pq.read_metadata(f)
            chunks = sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups)
                         for c in range(meta.num_columns))
            assert os.path.getsize(f) > chunks + meta.serialized_size + 1000
