"""Sources, sinks and the table operators as named queries with DuckDB oracles.

Queries over files write them from the test tables first, to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitlake.functions.numbers import rounded
from gaitlake.functions.shared import folder
from gaitlake.operators import density, recording, reduce, stats
from gaitlake.operators import motifs as mo
from gaitlake.plans import pose_queries as pq
from gaitlake.plans import views as v
from gaitlake.plans.registry import register
from gaitlake.sources import io

@register("meta_csv", "select c_custkey, c_mktsegment, cast(row_number() over (order by c_custkey) - 1 as int) id from customer")
def meta_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    v.table(spark, sf, "customer").select("c_custkey", "c_mktsegment").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").write.csv(path, header=True)
    return io.read_meta(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment", "id")


@register("pose_written_and_read", f"with {v.POSE} select cast(id as int) id, t, joint, {pq.R3} from pose")
def pose_written_and_read(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    io.write_pose(v.pose(spark, sf), path)
    return pq._long(io.read_pose(spark, path)).withColumn("id", F.col("id").cast("int"))


@register("pose_of_sessions", f"with {v.POSE} select cast(id + 100 as int) id, t, joint, {pq.R3} from pose")
def pose_of_sessions(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    io.write_pose(v.pose(spark, sf), path)
    ids = [r[0] for r in v.table(spark, sf, "embeddings").select("label").distinct().orderBy("label").collect()]  # sessions, a line each
    meta = spark.createDataFrame([(k + 100, f"{path}/id={k}") for k in ids], "id int, path string")
    return pq._long(io.pose_from_meta(spark, meta))


@register("features_written_and_read", f"with {v.FEATURES}, n as (select frame, label, unnest(f) val, unnest(range(len(f))) item from ft) select frame, label, 'f' || item as name, {v.r('val')} val from n")
def features_written_and_read(spark: SparkSession, sf: str) -> DataFrame:
    path, frames = folder(spark), v.features(spark, sf)
    io.write_features(frames.select("frame", "features"), [f"f{k}" for k in range(64)], path, sessions=frames.select("frame", "label"))
    held, labels, more = io.read_extended(spark, path, "sessions")
    names = F.array(*(F.lit(x) for x in labels))
    return held.join(more["sessions"], "frame").select("frame", "label", F.posexplode("features").alias("k", "val")).select("frame", "label", F.get(names, F.col("k")).alias("name"), rounded("val").alias("val"))


@register("ids_from_zero", f"with {v.TRACE} select cast(id - min(id) over () as bigint) id, t, v from tr")
def ids_from_zero(spark: SparkSession, sf: str) -> DataFrame:
    return io.shifted_ids(v.trace(spark, sf)).select(F.col("id").cast("long").alias("id"), "t", "v")


@register("cached_stage", f"with {v.TRACE} select id, t, v * 2 as v from tr")
def cached_stage(spark: SparkSession, sf: str) -> DataFrame:
    path, runs = f"{folder(spark)}/doubled", []

    def made() -> DataFrame:
        runs.append(1)
        return v.trace(spark, sf).select("id", "t", (F.col("v") * 2).alias("v"))

    io.stage(spark, path, made)
    out = io.stage(spark, path, made)
    if len(runs) != 1:
        raise RuntimeError("a finished stage was made again")
    return out


@register("behaviours_csv", f"with {pq.CELLS} select \"row\", col, cluster, case cluster when 1 then 2 when 2 then 1 else 0 end code from ws")
def behaviours_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    spark.createDataFrame([(1, "Walk"), (2, "Rear"), (3, "Walk"), (1, "Groom")], "Cluster int, Label string").coalesce(1).write.csv(path, header=True)
    return mo.labelled(pq._cells(spark, sf), io.read_behaviours(spark, path))


def _recording(spark: SparkSession, sf: str) -> recording.Recording:
    frames = v.features(spark, sf).select(F.col("label").alias("id"), "frame", "features")
    meta = frames.select("id").distinct().select("id", (F.col("id") % 3).alias("grp"))
    held, path = recording.Recording(frames, [f"f{k}" for k in range(64)], meta), folder(spark)
    held.save(path)
    return recording.Recording.load(spark, path)


@register("recording_shape", "select count(*) n_frames, cast(max(len(embedding)) as int) n_features from embeddings where label % 3 = 1 and vec_id % 2 = 0")
def recording_shape(spark: SparkSession, sf: str) -> DataFrame:
    return _recording(spark, sf).of(F.col("grp") == 1).every(2).shape()


@register("recording_meta_unique", "select distinct label % 3 grp from embeddings")
def recording_meta_unique(spark: SparkSession, sf: str) -> DataFrame:
    return _recording(spark, sf).meta_unique("grp")


@register("features_side_by_side", f"with {v.FEATURES} select frame, {v.r('f[1]')} a, {v.r('f[3]')} b, {v.r('f[4]')} c from ft")
def features_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda at, n: v.features(spark, sf).select("frame", F.slice("features", at, n).alias("features"))
    out, labels = recording.joined_features(part(1, 2), part(3, 2), ["f0", "f1"], ["f2", "f3"])
    place = {name: k for k, name in enumerate(labels)}
    return out.select("frame", *(rounded(F.col("features")[place[n]]).alias(a) for n, a in (("f0", "a"), ("f2", "b"), ("f3", "c"))))


@register("joints_reordered", f"with {v.POSE}, o(place, joint) as (values (0, 5), (1, 0), (2, 3)) select id, t, cast(o.place as int) joint, {pq.R3} from pose join o using (joint)")
def joints_reordered(spark: SparkSession, sf: str) -> DataFrame:
    return pq._long(recording.joints(v.pose(spark, sf), [5, 0, 3])).withColumn("joint", F.col("joint").cast("int"))


@register("labels_of_downsampled_frames", f"with {v.PLANE}, l as (select vec_id place, label picked from embeddings) select frame, picked from xy join l on l.place = frame // 4")
def labels_of_downsampled_frames(spark: SparkSession, sf: str) -> DataFrame:
    labels = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("place"), F.col("label").alias("picked"))
    return recording.zipped(v.plane(spark, sf), labels, 4).select("frame", "picked")


@register("first_appearance", "select label, min(vec_id) \"first\", row_number() over (order by min(vec_id)) place from embeddings group by label")
def first_appearance(spark: SparkSession, sf: str) -> DataFrame:
    return recording.first_appearance(v.plane(spark, sf))


@register("peak_frame", f"with {v.TRACE} select id, t, v from tr qualify row_number() over (partition by id order by v desc, t) = 1")
def peak_frame(spark: SparkSession, sf: str) -> DataFrame:
    return recording.peak(v.trace(spark, sf), "v")


SIZES = "sz as (select p_size, avg(abs(p_retailprice - 1400)) score from part group by p_size)"


@register("best_parameter", f"with {SIZES}, s as (select p_size, {v.r('score')} score from sz) select p_size, score, arg_min(p_size, score) over (order by p_size rows between unbounded preceding and current row) best from s")
def best_parameter(spark: SparkSession, sf: str) -> DataFrame:
    scores = v.table(spark, sf, "part").groupBy("p_size").agg(rounded(F.avg(F.abs(F.col("p_retailprice") - 1400))).alias("score"))
    return recording.best_so_far(scores, "p_size", "score")


@register("cosine_halves", f"""with {pq.CATS}, m as (select cat, list(freq order by cluster) f from fq where cat not in (3, 6) group by cat)
select case when a.cat < 70 then 'Baseline' else 'Lesion' end half, a.cat a, b.cat b, {v.r('list_dot_product(a.f, b.f)/(sqrt(list_dot_product(a.f, a.f))*sqrt(list_dot_product(b.f, b.f)))')} cos from m a join m b on a.cat < b.cat and (a.cat < 70) = (b.cat < 70)""")
def cosine_halves(spark: SparkSession, sf: str) -> DataFrame:
    shares = reduce.cluster_shares_by(v.clusters(spark, sf), "cat", clusters=5)
    rows = shares.groupBy("cat").agg(F.array_sort(F.collect_list(F.struct("cluster", "freq"))).alias("f")).select("cat", F.col("f.freq").alias("f"))
    return stats.cosine_halves(rows, "cat", "f", 70, [3, 6]).select("half", "a", "b", rounded("cosine").alias("cos"))


@register("scatter_by_segment", f"with {pq.CELLS}, p as (select frame, label, x, y, {pq.HIST} from xy) select frame, label, cluster, {v.r('x')} x, {v.r('y')} y from p join ws using (\"row\", col)")
def scatter_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    points = pq._density().cells(v.plane(spark, sf))
    return points.join(pq._cells(spark, sf), ["row", "col"]).select("frame", "label", "cluster", rounded("x").alias("x"), rounded("y").alias("y"))


@register("segment_borders", f"""with {pq.CELLS}, a as (select w.\"row\", w.col, w.cluster, w.\"row\" + r as r2, w.col + c as c2 from ws w, (values (-1, 0), (1, 0), (0, -1), (0, 1)) s(r, c) where w.cluster > 0)
select distinct a.\"row\", a.col, a.cluster from a left join ws o on o.\"row\" = r2 and o.col = c2 where coalesce(o.cluster, 0) <> a.cluster""")
def segment_borders(spark: SparkSession, sf: str) -> DataFrame:
    return recording.borders(pq._cells(spark, sf))


@register("rolling_window", f"with {v.TRACE}, n as (select *, count(*) over (partition by id) n from tr), o as (select n.id, n.t, k, greatest(0, least(n - 1, t + k - 3)) i from n, range(7) r(k)) select o.id, o.t, cast(k as int) step, tr.v from o join tr on tr.id = o.id and tr.t = o.i")
def rolling_window(spark: SparkSession, sf: str) -> DataFrame:
    return recording.rolling(v.trace(spark, sf), "v", 7).select("id", "t", F.posexplode("window").alias("step", "v"))


@register("frame_slices", "with c as (select label, min(vec_id) f from embeddings group by label) select label cluster, cast(k as int) step, f + k frame from c, range(5) r(k)")
def frame_slices(spark: SparkSession, sf: str) -> DataFrame:
    centres = v.plane(spark, sf).groupBy(F.col("label").alias("cluster")).agg(F.min("frame").alias("frame"))
    return mo.motif_frames(centres, 5, centred=False).select("cluster", "step", "frame")


@register("cluster_freq_from_data")
def cluster_freq_from_data(spark: SparkSession, sf: str) -> DataFrame:
    shed = density.Watershed(sigma=2.0, bins=50)
    labelled = shed.fit_predict(v.plane(spark, sf))
    return reduce.cluster_shares(labelled, clusters=int(shed.labels.max()) + 1)


@register("density_counts_smoothed", pq.SMOOTHED)
def density_counts_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    grid = pq._density(sigma=2.0).fit(v.plane(spark, sf), new=False)
    return spark.createDataFrame([(r, c, float(grid[r, c])) for r in range(50) for c in range(50)], "row int, col int, density double").withColumn("density", rounded("density", 5))
