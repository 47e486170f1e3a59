"""Pose, trace and cluster tables over the test tables, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitlake.functions.numbers import held
from gaitlake.operators.geometry import point

JOINTS = 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _t(by: str, order: str) -> F.Column:
    return (F.expr(f"row_number() over (partition by {by} order by {order})") - 1).cast("long")


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, frame, kp): 54 of the 64 numbers of an embedding as 18 joints."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), _t("label", "vec_id").alias("t"), F.col("vec_id").alias("frame"), "embedding")
    coordinate = lambda j, a: F.get("embedding", 3 * j + a).cast("double")
    return held(rows, kp=F.transform(F.sequence(F.lit(0), F.lit(JOINTS - 1)), lambda j: point(coordinate(j, 0), coordinate(j, 1), coordinate(j, 2)))).drop("embedding")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, v): the values of a user's events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), _t("user_id", "ts, event_id").alias("t"), F.col("value").alias("v"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cat, cluster, event_id): a user's event types as clusters 0 to 4."""
    kinds = ("click", "error", "purchase", "signup")
    cluster = F.lit(4)
    for k in reversed(range(len(kinds))):
        cluster = F.when(F.col("event_type") == kinds[k], k).otherwise(cluster)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cat"), cluster.alias("cluster"), "event_id")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cat, cluster): a nation's customers by market segment, 0 to 4: few categories, as regressions on occupancy have."""
    names = F.array(*(F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cat"), (F.array_position(names, F.col("c_mktsegment")) - 1).cast("int").alias("cluster"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, label, features): embeddings as double arrays."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", F.col("embedding").cast("array<double>").alias("features"))


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, label, x, y): the first two numbers of each embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


FRAMES = "fr as (select label id, cast(row_number() over (partition by label order by vec_id) - 1 as bigint) t, vec_id frame, embedding v from embeddings)"
POSE = FRAMES + """, pose as (select id, t, frame, joint, cast(v[3*joint+1] as double) x, cast(v[3*joint+2] as double) y, cast(v[3*joint+3] as double) z
from fr cross join range(0, 18) j(joint))"""
EGO = POSE + """, cen as (select p.id, p.t, p.joint, p.x-o.x x, p.y-o.y y, p.z-o.z z from pose p join pose o on o.id=p.id and o.t=p.t and o.joint=4),
yaw as (select id, t, cos(-atan2(y,x)) c, sin(-atan2(y,x)) s from cen where joint=3),
ego as (select id, t, joint, x*c-y*s x, x*s+y*c y, z from cen join yaw using (id, t))"""
TRACE = "tr as (select user_id id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) t, value v from events)"
CLUSTERS = "cl as (select user_id cat, case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end cluster, event_id from events)"
FEATURES = "ft as (select vec_id frame, label, list_transform(embedding, lambda e: e::double) f from embeddings)"
PLANE = "xy as (select vec_id frame, label, cast(embedding[1] as double) x, cast(embedding[2] as double) y from embeddings)"


def r(x: str, digits: int = 6) -> str:
    """SQL of ``rounded``."""
    scale = f"1e{digits}"
    return f"(case when isnan({x}) then {x} else floor(({x})*{scale}+0.5)/{scale} end)"
