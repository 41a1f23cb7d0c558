"""Readers and writers: lead files, result tables, fitted models.

Everything goes through Spark's data sources so paths may live on any
cluster file system (the driver never opens a file itself).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S


def read_leads(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Lead file with a header, read with the explicit lead schema (no
    inference).  A UTF-8 byte-order mark at the start is skipped by the CSV
    reader.  A missing path raises."""
    if fmt == "csv":
        return spark.read.schema(S.LEADS_SCHEMA).option("header", True).option("encoding", "UTF-8") \
                         .option("mode", "FAILFAST").csv(path)
    if fmt == "parquet":
        return spark.read.schema(S.LEADS_SCHEMA).parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")


def read_new_leads(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Payloads of new leads (nine fields) with the payload schema."""
    return spark.read.schema(S.NEW_LEAD_SCHEMA).format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a result table (CSV with a header, or Parquet)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        w.format(fmt).save(path)


def write_leads(df: DataFrame, path: str, fmt: str = "csv", byte_order_mark: bool = True) -> None:
    """Lead file with the lead schema's columns.

    A CSV file starts with a UTF-8 byte-order mark, as spreadsheet programs want it: the mark is the
    first character of the header, so each part file has it."""
    first, *rest = [f.name for f in S.LEADS_SCHEMA.fields]
    mark = "\ufeff" if fmt == "csv" and byte_order_mark else ""
    write_table(df.select(df[first].alias(mark + first), *rest), path, fmt)


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def save_model(spark: SparkSession, path: str, preprocessor, model, metadata: dict) -> None:
    """Preprocessor constants (JSON), the model and the metadata record (JSON) under one folder.

    A Spark ML model has its own writer; a logistic model is its coefficients (JSON), a tree
    ensemble its node table."""
    kind = type(model).__name__
    _write_text(spark, preprocessor.to_json(), f"{path}/preprocessor")
    _write_text(spark, kind, f"{path}/kind")
    if kind == "LogisticModel":
        _write_text(spark, model.to_json(), f"{path}/model")
    elif kind in ("TreeEnsemble", "StoredTrees"):
        model.to_frame(spark).write.mode("overwrite").parquet(f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    meta = dict(metadata)
    meta["model_class"] = type(model).__name__
    _write_text(spark, json.dumps(meta, ensure_ascii=False, default=str), f"{path}/metadata")


def load_model(spark: SparkSession, path: str):
    """(preprocessor, model, metadata).  A missing model raises; missing
    metadata gives an empty dict."""
    from pyspark.errors import AnalysisException
    from pyspark.ml import classification as C
    from pyspark.ml.util import DefaultParamsReader

    from ..operators.logistic import LogisticModel
    from ..operators.preprocess import Preprocessor
    from ..operators.trees import StoredTrees, TreeEnsemble
    try:
        meta = json.loads(_read_text(spark, f"{path}/metadata"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        meta = {}
    pp = Preprocessor.from_json(_read_text(spark, f"{path}/preprocessor"))
    kind = _read_text(spark, f"{path}/kind")
    if kind == "LogisticModel":
        return pp, LogisticModel.from_json(_read_text(spark, f"{path}/model")), meta
    if kind == "TreeEnsemble":
        return pp, TreeEnsemble.from_frame(spark.read.parquet(f"{path}/model")), meta
    if kind == "StoredTrees":
        return pp, StoredTrees.from_frame(spark.read.parquet(f"{path}/model")), meta
    saved = DefaultParamsReader.loadMetadata(f"{path}/model", spark)["class"]   # the class that was saved
    return pp, getattr(C, saved.rpartition(".")[2]).load(f"{path}/model"), meta
