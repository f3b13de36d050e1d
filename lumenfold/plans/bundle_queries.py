"""Queries over bundles: captures built from whole tables, written as bundles and read by the format `captures`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.plans import reports
from lumenfold.plans.registry import query
from lumenfold.plans.table_queries import AT, REPORT_DOCUMENTS_SQL, REPORT_META_SQL, REPORT_SQL, customer_captures, looked_into, meta_columns
from lumenfold.sources import bundles
from lumenfold.sources.tables import shared_dir
from lumenfold.streaming.captures import best_markdown, run_through


def _bundled(spark: SparkSession, sf_dir: str) -> str:
    """The folder of bundles with the captures of all customers."""
    path = f"{shared_dir(spark)}/lumenfold-{uuid.uuid4().hex}"
    for table, rows in zip(("captures", "dom_html", "net_bodies"), customer_captures(spark, sf_dir), strict=True):
        lines = rows.select(F.to_json(F.struct(F.lit(table).alias("table"), "*")).alias("value"), F.lit("report").alias("kind"))
        lines.write.partitionBy("kind").mode("append").text(path)
    bundles.register(spark)
    return path


def _table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.format("captures").options(table=table, kind="report").load(path)


@query(REPORT_META_SQL)
def bundle_report_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of bundles; the kind is a filter that the source takes."""
    path = _bundled(spark, sf_dir)
    captures = spark.read.format("captures").option("table", "captures").load(path).where("kind = 'report'")
    _, meta, _ = reports.reports(captures, _table(spark, path, "dom_html"), _table(spark, path, "net_bodies"), product="Maker")
    return meta_columns(meta)


@query(REPORT_SQL + "select doc_id::varchar as capture_id, md5(text) as digest, 'http://h/body?x' as url from r join f on c_custkey = doc_id join t using (c_custkey) where net")
def bundle_stream_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best Markdown of each capture from a stream of bundles."""
    arriving = spark.readStream.format("captures").options(table="net_bodies", settle=0).load(_bundled(spark, sf_dir))
    return run_through(best_markdown(arriving), "complete").select("capture_id", F.md5("markdown").alias("digest"), "url")


@query(REPORT_DOCUMENTS_SQL)
def bundle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written reports as a file for each capture, and what the files hold."""
    blocks, meta, _ = reports.reports(*customer_captures(spark, sf_dir), product="Maker", at=AT)
    path = f"{shared_dir(spark)}/lumenfold-{uuid.uuid4().hex}"
    bundles.register(spark)
    reports.report_json(blocks, meta).write.format("captures").option("fan", 2).mode("append").save(path)
    files = spark.read.format("captures").option("table", "documents").load(path)
    return looked_into(files.select(F.col("name").alias("capture_id"), "json"))
