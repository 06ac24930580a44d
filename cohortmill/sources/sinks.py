"""Reports, manifests and training tables on disk."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.operators.export import Export

FORMATS = ("parquet", "csv")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {FORMATS}")
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))


def write_text_table(df: DataFrame, path: str) -> None:
    """Tab-separated with a header and no quotes, as the portal writes it."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option(
        "quote", "").option("emptyValue", "").csv(path)


def write_json_document(spark: SparkSession, document: dict, path: str) -> None:
    """One small document as a one-row text file."""
    text = json.dumps(document, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_issue_report(issues: DataFrame, path: str) -> None:
    """Issues as JSON lines with the UTC time of the report."""
    stamp = datetime.now(timezone.utc).isoformat(timespec="seconds")
    issues.withColumn("created_at", F.lit(stamp)).write.mode("overwrite").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    stamp = datetime.now(timezone.utc).isoformat(timespec="seconds")
    manifest.withColumn("created_at", F.lit(stamp)).coalesce(1).write.mode("overwrite").json(path)


def write_manifest_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A manifest as a folder: ``manifest`` as JSON with the UTC time, the tables behind it as parquet."""
    for name, table in tables.items():
        if name != "manifest":
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    write_manifest(tables["manifest"], f"{path}/manifest")


def read_manifest_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The tables that ``write_manifest_tables`` wrote; ``names`` defaults to those without sources."""
    names = names or ("features", "samples")
    return {"manifest": spark.read.json(f"{path}/manifest"), **{n: spark.read.parquet(f"{path}/{n}") for n in names}}


def write_export(export: Export, path: str, fmt: str = "parquet") -> None:
    """X and y for train and test, the selected features and the manifest in one folder."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {FORMATS}")
    spark = export.cells.sparkSession
    for name, test in (("train", False), ("test", True)):
        write_table(export.x(test), f"{path}/X_{name}.{fmt}", fmt)
        write_table(export.y(test), f"{path}/y_{name}.{fmt}", fmt)
    names = export.selected.select(F.col("feature_id").cast("string").alias("value"))
    names.orderBy("value").coalesce(1).write.mode("overwrite").text(f"{path}/selected_features")
    manifest = dict(export.manifest, export={"format": fmt, "tables": [
        f"X_train.{fmt}", f"X_test.{fmt}", f"y_train.{fmt}", f"y_test.{fmt}",
        "selected_features", "manifest"]})
    write_json_document(spark, manifest, f"{path}/manifest")
