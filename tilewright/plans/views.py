"""Slide-like tables derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.operators.tiles import ranked
from tilewright.session import table


def keypoints(spark: SparkSession, d: str) -> DataFrame:
    """(image, kp, x, y, response, descr): keypoints with descriptors, numbered within their image."""
    e = lambda k: F.element_at("embedding", k).cast("double")
    return table(spark, d, "embeddings").select(
        F.col("label").alias("image"),
        (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("kp"),
        (256 * (1 + e(1))).alias("x"),
        (256 * (1 + e(2))).alias("y"),
        e(3).alias("response"),
        F.col("embedding").cast("array<double>").alias("descr"),
    )


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """(image, x, y, v1, v2, v3): three bands of ten images 32 wide."""
    return table(spark, d, "events").select(
        (F.col("event_id") % 10).cast("int").alias("image"),
        F.expr("cast((event_id div 10) % 32 as int)").alias("x"),
        F.expr("cast((event_id div 10) div 32 as int)").alias("y"),
        F.expr("cast(floor(value) as int) % 256").alias("v1"),
        F.expr("cast(user_id % 256 as int)").alias("v2"),
        F.expr("cast(cast(regexp_extract(props, '([0-9]+)', 1) as bigint) * 37 % 256 as int)").alias("v3"),
    )


def transforms(spark: SparkSession, d: str) -> DataFrame:
    """(slide, a, b, tx, ty, m): a similarity transform of each slide, as suppliers are."""
    t = table(spark, d, "supplier").selectExpr(
        "cast(s_suppkey as int) as slide",
        "cos(0.1 * s_suppkey) * (1 + s_nationkey / 100.0D) as a",
        "sin(0.1 * s_suppkey) * (1 + s_nationkey / 100.0D) as b",
        "s_acctbal / 100 as tx",
        "10.0D * s_nationkey as ty",
    )
    return t.selectExpr("*", "array(a, -b, tx, b, a, ty, 0.0D, 0.0D, 1.0D) as m")


def all_transforms(spark: SparkSession, d: str) -> DataFrame:
    """(slide, a, b, tx, ty, m): a similarity transform of every slide of ``slide_levels``, by the suppliers in turn."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("turn"), "s_suppkey", "s_nationkey", "s_acctbal")  # keys are dense from 0
    n = s.count()
    p = table(spark, d, "part").select(F.col("p_partkey").alias("slide"), (F.col("p_partkey") % n).alias("turn"))
    t = p.join(s, "turn").selectExpr(
        "slide",
        "cos(0.1 * s_suppkey) * (1 + s_nationkey / 100.0D) as a",
        "sin(0.1 * s_suppkey) * (1 + s_nationkey / 100.0D) as b",
        "s_acctbal / 100 as tx",
        "10.0D * s_nationkey as ty",
    )
    return t.selectExpr("*", "array(a, -b, tx, b, a, ty, 0.0D, 0.0D, 1.0D) as m")


def points(spark: SparkSession, d: str) -> DataFrame:
    """(slide, x, y): points on slides."""
    return table(spark, d, "lineitem").selectExpr("cast(l_suppkey as int) as slide", "l_extendedprice / 100 as x", "20 * l_quantity as y")


def slide_levels(spark: SparkSession, d: str) -> DataFrame:
    """(slide, level, w, h): pyramids of five levels."""
    t = table(spark, d, "part").selectExpr("p_partkey as slide", "1000 + 100 * p_size as w0", "cast(1000 + p_partkey % 3000 as int) as h0")
    return t.selectExpr("slide", "explode(sequence(0, 4)) as level", "w0", "h0").selectExpr("slide", "level", "cast(floor(w0 / pow(2, level)) as int) as w", "cast(floor(h0 / pow(2, level)) as int) as h")


def channels(spark: SparkSession, d: str) -> DataFrame:
    """(slide, stack_idx, pos, name): channels of slides, which share names."""
    s = ranked(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey").select(F.col("s_suppkey").alias("slide"), F.col("place").cast("int").alias("stack_idx"))
    p = table(spark, d, "part").selectExpr("p_partkey as slide", "posexplode(split(p_name, ' ')) as (pos, name)")
    return s.join(p, "slide").select("slide", "stack_idx", "pos", "name")


#: The same views for DuckDB, as common table expressions by name.
SQL = {
    "keypoints": """keypoints AS (SELECT label AS image, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS kp,
      256 * (1 + embedding[1]::DOUBLE) AS x, 256 * (1 + embedding[2]::DOUBLE) AS y, embedding[3]::DOUBLE AS response, embedding::DOUBLE[] AS descr FROM embeddings)""",
    "pixels": """pixels AS (SELECT (event_id % 10)::INT AS image, ((event_id // 10) % 32)::INT AS x, ((event_id // 10) // 32)::INT AS y,
      floor(value)::INT % 256 AS v1, (user_id % 256)::INT AS v2, (regexp_extract(props, '([0-9]+)', 1)::BIGINT * 37 % 256)::INT AS v3 FROM events)""",
    "transforms": """transforms AS (SELECT s_suppkey::INT AS slide, cos(0.1 * s_suppkey) * (1 + s_nationkey / 100.0::DOUBLE) AS a,
      sin(0.1 * s_suppkey) * (1 + s_nationkey / 100.0::DOUBLE) AS b, s_acctbal / 100 AS tx, 10.0::DOUBLE * s_nationkey AS ty FROM supplier)""",
    "all_transforms": """transforms AS (SELECT p_partkey AS slide, cos(0.1 * s_suppkey) * (1 + s_nationkey / 100.0::DOUBLE) AS a,
      sin(0.1 * s_suppkey) * (1 + s_nationkey / 100.0::DOUBLE) AS b, s_acctbal / 100 AS tx, 10.0::DOUBLE * s_nationkey AS ty
      FROM part JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS turn FROM supplier) ON turn = p_partkey % (SELECT count(*) FROM supplier))""",
    "points": "points AS (SELECT l_suppkey::INT AS slide, l_extendedprice / 100 AS x, 20 * l_quantity AS y FROM lineitem)",
    "slide_levels": """slide_levels AS (SELECT slide, level, floor(w0 / pow(2, level))::INT AS w, floor(h0 / pow(2, level))::INT AS h FROM
      (SELECT p_partkey AS slide, 1000 + 100 * p_size AS w0, (1000 + p_partkey % 3000)::INT AS h0, unnest(range(0, 5))::INT AS level FROM part))""",
    "channels": """channels AS (SELECT s.slide, s.stack_idx, p.pos, p.name FROM
      (SELECT s_suppkey AS slide, (row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1)::INT AS stack_idx FROM supplier) s
      JOIN (SELECT p_partkey AS slide, unnest(string_split(p_name, ' ')) AS name, (generate_subscripts(string_split(p_name, ' '), 1) - 1)::INT AS pos FROM part) p USING (slide))""",
}


def with_views(names: str, query: str) -> str:
    """A query over the named views; further common table expressions may follow."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + (", " if query.lstrip()[:4] == "AND " else " ") + query.lstrip().removeprefix("AND ")
