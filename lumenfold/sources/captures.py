"""Typed readers of captured state at rest, and of the same folders as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.html_blocks import read_of, score_of
from lumenfold.operators.json_mining import MAP_SIZE, REPORT_SIZE, usable
from lumenfold.operators.quiz_html import counter_shown
from lumenfold.sources.schemas import SCHEMAS

def read(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """A captured table with its schema: Parquet, JSON lines, ORC or CSV (flat tables only)."""
    return spark.read.schema(SCHEMAS[table]).format(fmt).load(path)


def stream(spark: SparkSession, path: str, table: str, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """The same as a stream of arriving files."""
    return spark.readStream.schema(SCHEMAS[table]).option("maxFilesPerTrigger", files).format(fmt).load(path)


def bodies_for(bodies: DataFrame, kind: str) -> DataFrame:
    """The bodies that reports or maps are looked for in. The type is tested first, which a Parquet scan can push down."""
    return bodies.where(usable(F.col("resource_type"), F.col("body"), REPORT_SIZE if kind == "report" else MAP_SIZE))


def best_frames(dom_html: DataFrame) -> DataFrame:
    """Of each snapshot the frame with the most visible text, the first of equal ones; a null page has none."""
    scored = dom_html.withColumn("score", score_of(F.col("html")))
    top = F.struct("score", -F.col("frame_id"))
    return scored.groupBy("capture_id", "snap_seq").agg(F.max_by("html", top).alias("html"), F.max_by("frame_id", top).alias("frame_id"), F.max("score").alias("score"))


def best_read(dom_html: DataFrame) -> DataFrame:
    """The same with the frame's raw blocks (a JSON list, null where it can't be read) instead of its HTML, which is parsed once."""
    read = dom_html.select("capture_id", "snap_seq", "frame_id", read_of(F.col("html")).alias("r")).select("capture_id", "snap_seq", "frame_id", "r.score", "r.blocks")
    top = F.struct("score", -F.col("frame_id"))
    return read.groupBy("capture_id", "snap_seq").agg(F.max_by("blocks", top).alias("blocks"), F.max_by("frame_id", top).alias("frame_id"), F.max("score").alias("score"))


def best_map_frames(frags: DataFrame, links: DataFrame) -> DataFrame:
    """capture_id, frame_id, score: of each capture the frame with the most fragments that are no controls, links counting five times.

    Both tables have a frame_id; of equal frames the first counts; frames that score nothing are none.
    """
    points = frags.select("capture_id", "frame_id", (~F.coalesce("ui", F.lit(False))).cast("long").alias("n")).unionByName(links.select("capture_id", "frame_id", F.lit(5).cast("long").alias("n")))
    scored = points.groupBy("capture_id", "frame_id").agg(F.sum("n").alias("score")).where("score > 0")
    return scored.groupBy("capture_id").agg(F.max_by("frame_id", F.struct("score", -F.col("frame_id"))).alias("frame_id"), F.max("score").alias("score"))


def quiz_frames(dom_html: DataFrame) -> DataFrame:
    """capture_id, snap_seq, frame_id: of each snapshot the first frame that shows a counter."""
    return dom_html.where(counter_shown(F.col("html"))).groupBy("capture_id", "snap_seq").agg(F.min("frame_id").alias("frame_id"))


def links_of_paths(links: DataFrame) -> DataFrame:
    """Links that run sideways by 12 or more and are longer than 25; where the length of the path is unknown, the distance of its ends counts."""
    apart = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    length = F.coalesce("length", apart) if "length" in links.columns else apart
    return links.where((F.abs(F.col("ax") - F.col("bx")) >= 12) & (length > 25))
