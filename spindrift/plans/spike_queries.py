"""Queries on events as spikes: trains, labels, detection, joins in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import signed_log1p, signed_sqrt
from ..operators import detect, joins, labels, motion, trains
from ..session import ship
from ..sources.tables import event_spikes, table

QUERIES: dict = {}
ORACLE: dict = {}

S = "s AS (SELECT event_id AS spike_id, epoch_us(ts) // 3600 AS t, user_id AS label, event_type AS channel, value AS amplitude FROM events)"
#: Events are sparse, so an hour of theirs counts as a second of a recording.
SECOND = 1_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


@query(f"WITH {S} SELECT label, count(*) AS n, round((max(t) - min(t)) / 1e6, 6) AS duration_s, CASE WHEN max(t) > min(t) THEN round(count(*) / ((max(t) - min(t)) / 1e6), 6) END AS rate_hz FROM s GROUP BY label")
def unit_firing_rates(spark: SparkSession, d: str) -> DataFrame:
    return trains.unit_firing_rates(event_spikes(spark, d)).select("label", "n", r6(F.col("duration_s")).alias("duration_s"), r6(F.col("rate_hz")).alias("rate_hz"))


@query(f"""WITH {S}, g AS (SELECT label, t - lag(t) OVER (PARTITION BY label ORDER BY t, spike_id) AS gap FROM s)
SELECT label, round(coalesce(avg(CASE WHEN gap < 1000000 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 0.0), 6) AS viol_rate FROM g GROUP BY label""")
def isi_violations(spark, d):
    return trains.violations(event_spikes(spark, d), SECOND).select("label", r6(F.col("viol_rate")).alias("viol_rate"))


@query(f"""WITH {S}, g AS (SELECT spike_id, t - lag(t) OVER w AS prev, lead(t) OVER w - t AS next FROM s WINDOW w AS (PARTITION BY label ORDER BY t, spike_id))
SELECT spike_id, least(prev, next) AS isi FROM g""")
def spike_isis(spark, d):
    return trains.intervals(event_spikes(spark, d)).select("spike_id", "isi")


@query(f"""WITH {S}, g AS (SELECT t - lag(t) OVER (PARTITION BY label ORDER BY t, spike_id) AS gap FROM s)
SELECT CAST(least(gap // 500000, 49) AS BIGINT) AS bin, count(*) AS n FROM g WHERE gap BETWEEN 0 AND 25000000 GROUP BY 1""")
def isi_histogram(spark, d):
    return trains.interval_histogram(event_spikes(spark, d), 500_000, 50)


@query("""SELECT l_orderkey, l_partkey, l_linenumber, n, kept FROM (
  SELECT l_orderkey, l_partkey, l_linenumber, count(*) AS n, CASE WHEN row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey) = 1 THEN l_suppkey ELSE -1 END AS kept
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem) GROUP BY l_orderkey, l_partkey, l_linenumber, l_suppkey, l_shipdate)""")
def drop_doubles(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").distinct()
    keyed = rows.withColumn("key", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return labels.drop_doubles(keyed, "l_suppkey", "l_shipdate", "key").select("l_orderkey", "l_partkey", "l_linenumber", F.lit(1).cast("long").alias("n"), "kept")


@query(f"""WITH {S}, c AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS kept FROM s GROUP BY label HAVING count(*) >= 65)
SELECT spike_id, coalesce(kept, -1) AS kept FROM s LEFT JOIN c USING (label)""")
def decrumb_units(spark, d):
    return labels.decrumb(event_spikes(spark, d), 65).select("spike_id", F.col("kept").cast("long").alias("kept"))


@query(f"WITH {S} SELECT spike_id, dense_rank() OVER (ORDER BY label) - 1 AS flat FROM s")
def flatten_labels(spark, d):
    return labels.flatten(event_spikes(spark, d)).select("spike_id", F.col("flat").cast("long").alias("flat"))


@query(f"WITH {S} SELECT spike_id, CASE WHEN t BETWEEN 473452000000 AND 473752000000 THEN label ELSE -1 END AS kept FROM s")
def restrict_valid_times(spark, d):
    return labels.valid_times(event_spikes(spark, d), 473452 * SECOND, 473752 * SECOND).select("spike_id", "kept")


@query(f"WITH {S} SELECT spike_id, CASE WHEN t >= 473472000000 AND t < 473592000000 THEN label ELSE -1 END AS kept, t - 473472000000 AS t_rel FROM s")
def subset_time_range(spark, d):
    start = 473472 * SECOND
    return labels.time_range(event_spikes(spark, d), start, start + 120 * SECOND).select("spike_id", "kept", "t_rel")


@query(f"""WITH {S}, c AS (SELECT label, count(*) AS n FROM s GROUP BY label)
SELECT spike_id, CASE WHEN n BETWEEN 60 AND 75 THEN label ELSE -1 END AS kept FROM s JOIN c USING (label)""")
def spike_count_filter(spark, d):
    return labels.count_filter(event_spikes(spark, d), 60, 75).select("spike_id", "kept")


@query(f"WITH {S} SELECT spike_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(CAST(spike_id AS VARCHAR)), spike_id) <= 32 THEN label ELSE -1 END AS kept FROM s")
def cap_per_unit(spark, d):
    return labels.cap_per_unit(event_spikes(spark, d), 32).select("spike_id", "kept")


@query(f"""WITH {S}, a AS (SELECT spike_id, CASE WHEN spike_id % 2 = 0 THEN label ELSE -1 END AS x, CASE WHEN spike_id % 3 = 0 THEN label % 7 ELSE -1 END AS y FROM s)
SELECT spike_id, CASE WHEN x >= 0 THEN x WHEN y >= 0 THEN y + (SELECT max(x) FROM a) + 1 ELSE -1 END AS label FROM a""")
def combine_labelings(spark, d):
    s = event_spikes(spark, d)
    a = s.select("spike_id", F.when(F.col("spike_id") % 2 == 0, F.col("label")).otherwise(-1).alias("label"))
    b = s.select("spike_id", F.when(F.col("spike_id") % 3 == 0, F.col("label") % 7).otherwise(-1).alias("label"))
    return labels.combine(a, b)


@query(f"WITH {S} SELECT (t - 473352000000) // 24000000 AS chunk, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY 1")
def time_chunks(spark, d):
    s = event_spikes(spark, d).withColumn("chunk", F.floor((F.col("t") - 473352 * SECOND) / (24 * SECOND)))
    return s.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"""WITH {S}, h AS (SELECT t, unnest(range((t - 5000000) // 60000000, (t + 5000000) // 60000000 + 1)) AS chunk FROM s)
SELECT chunk, count(*) AS n, CAST(sum(CASE WHEN t // 60000000 = chunk THEN 1 ELSE 0 END) AS BIGINT) AS n_core FROM h GROUP BY chunk""")
def chunk_halo_counts(spark, d):
    h = detect.with_halo(event_spikes(spark, d), 60 * SECOND, 5 * SECOND)
    return h.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("core").cast("long")).alias("n_core"))


@query(f"""WITH {S}, w AS (SELECT *, max(amplitude) OVER (PARTITION BY label ORDER BY t, spike_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b,
  max(amplitude) OVER (PARTITION BY label ORDER BY t, spike_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM s)
SELECT spike_id, label, amplitude FROM w WHERE amplitude > 20 AND amplitude > b AND amplitude >= a""")
def local_maxima(spark, d):
    return detect.local_maxima(event_spikes(spark, d), 3, 20.0, ["label"], ["t", "spike_id"], "amplitude").select("spike_id", "label", "amplitude")


@query(f"""WITH {S}, w AS (SELECT *, max(amplitude) OVER (PARTITION BY label ORDER BY t, spike_id ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b,
  max(amplitude) OVER (PARTITION BY label ORDER BY t, spike_id ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS a FROM s),
p AS (SELECT * FROM w WHERE amplitude > 5 AND amplitude > b AND amplitude >= a)
SELECT spike_id, label, amplitude FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.label = p.label AND abs(q.t - p.t) <= 60000000
  AND (q.amplitude > p.amplitude OR (q.amplitude = p.amplitude AND (q.t < p.t OR (q.t = p.t AND q.spike_id < p.spike_id)))))""")
def peak_dedup_window(spark, d):
    peaks = detect.local_maxima(event_spikes(spark, d), 1, 5.0, ["label"], ["t", "spike_id"], "amplitude")
    return detect.suppress(peaks, 60 * SECOND, "t", "amplitude", ["label"]).select("spike_id", "label", "amplitude")


@query(f"""WITH {S}, ch AS (SELECT CAST(dense_rank() OVER (ORDER BY channel) - 1 AS INT) AS c, channel AS name FROM (SELECT DISTINCT channel FROM s)),
p AS (SELECT spike_id, t, c, amplitude FROM s JOIN ch ON s.channel = ch.name WHERE amplitude > 30)
SELECT spike_id, c AS channel, amplitude FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE abs(q.c - p.c) <= 1 AND abs(q.t - p.t) <= 2000000
  AND (q.amplitude > p.amplitude OR (q.amplitude = p.amplitude AND (q.c < p.c OR (q.c = p.c AND q.t < p.t)))))""")
def nms_time_channel(spark, d):
    s = event_spikes(spark, d)
    ch = s.select(F.col("channel").alias("name")).distinct().withColumn("c", F.dense_rank().over(Window.orderBy("name")) - 1)
    neighbours = ch.select(F.col("c").alias("channel")).withColumn("neighbor", F.explode(F.array(F.col("channel") - 1, F.col("channel"), F.col("channel") + 1)))
    peaks = s.where("amplitude > 30").join(F.broadcast(ch), s["channel"] == ch["name"]).select("spike_id", "t", F.col("c").alias("channel"), "amplitude")
    return detect.detect_and_deduplicate(peaks, neighbours, 2 * SECOND, value="amplitude").select("spike_id", "channel", "amplitude")


@query(f"""WITH {S}, w AS (SELECT spike_id, amplitude - lag(amplitude, 1) OVER w AS d2, lag(amplitude, 1) OVER w - lag(amplitude, 2) OVER w AS d1,
  lead(amplitude, 1) OVER w - amplitude AS d3, lead(amplitude, 2) OVER w - lead(amplitude, 1) OVER w AS d4 FROM s WINDOW w AS (PARTITION BY label ORDER BY t, spike_id))
SELECT spike_id, round(d1 * d2 - d2 * d3 + d3 * d4, 6) AS vexity FROM w WHERE d1 IS NOT NULL AND d4 IS NOT NULL""")
def convexity(spark, d):
    out = detect.convexity(event_spikes(spark, d), 2, ["label"], ["t", "spike_id"], "amplitude")
    return out.select("spike_id", r6(F.col("vexity")).alias("vexity"))


_ISL = f"""WITH {S}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY label ORDER BY t, spike_id) <= 5000000 THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY label ORDER BY t, spike_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g),
z AS (SELECT *, count(*) OVER (PARTITION BY label, island) AS island_size FROM i) """


@query(_ISL + "SELECT spike_id, label, island, island_size FROM z")
def isi_islands(spark, d):
    return trains.islands(event_spikes(spark, d), 5 * SECOND).select("spike_id", "label", "island", "island_size")


@query(_ISL + "SELECT spike_id, row_number() OVER (PARTITION BY label, island ORDER BY amplitude DESC, t, spike_id) = 2 AS dropped FROM z WHERE island_size = 2")
def isi_dedup_pairs(spark, d):
    return trains.duplicate_pairs(event_spikes(spark, d), 5 * SECOND, "amplitude").select("spike_id", "dropped")


@query()
def isi_dedup_greedy(spark, d):
    ship(spark)
    return trains.deduplicate(event_spikes(spark, d), 5 * SECOND, "amplitude").select("spike_id", "label", "kept")


@query(f"""WITH {S}, b AS (SELECT DISTINCT label, t // 60000000 AS m FROM s)
SELECT x.label, y.m - x.m AS lag, count(*) AS n FROM b x JOIN b y ON x.label = y.label AND y.m - x.m BETWEEN -50 AND 50 AND y.m <> x.m GROUP BY 1, 2""")
def correlogram(spark, d):
    return trains.correlogram(event_spikes(spark, d), 60 * SECOND, 50)


@query(f"""WITH {S}, c AS (SELECT label, t // 24000000 AS b, sqrt(count(*)) AS r FROM s GROUP BY 1, 2),
n AS (SELECT CAST(max(t) // 24000000 - min(t) // 24000000 + 1 AS DOUBLE) AS bins FROM s),
o AS (SELECT label, sum(r) AS s1, sum(r * r) AS q FROM c GROUP BY label),
p AS (SELECT x.label AS i, y.label AS j, sum(x.r * y.r) AS p FROM c x JOIN c y ON x.b = y.b AND x.label < y.label GROUP BY 1, 2)
SELECT a.label AS i, e.label AS j, round((bins * coalesce(p, 0) - a.s1 * e.s1) / nullif(sqrt((bins * a.q - a.s1 * a.s1) * (bins * e.q - e.s1 * e.s1)), 0), 6) AS corr
FROM o a JOIN o e ON a.label < e.label LEFT JOIN p ON p.i = a.label AND p.j = e.label, n""")
def firing_corr(spark, d):
    """All pairs of units, those without a common bin too."""
    return trains.rate_correlations(event_spikes(spark, d), 24 * SECOND).select("i", "j", r6(F.col("corr")).alias("corr"))


@query(f"""WITH {S}, a AS (SELECT spike_id AS a_id, t AS ta FROM s WHERE channel = 'purchase'), b AS (SELECT spike_id AS b_id, t AS tb, label FROM s WHERE channel = 'click'),
p AS (SELECT a_id, b_id, label, abs(tb - ta) AS dt, row_number() OVER (PARTITION BY a_id ORDER BY abs(tb - ta), b_id) AS r FROM a JOIN b ON abs(tb - ta) <= 1000000)
SELECT a.a_id, p.dt, p.b_id, p.label FROM a LEFT JOIN p ON p.a_id = a.a_id AND r = 1""")
def match_nearest_time(spark, d):
    s = event_spikes(spark, d)
    a = s.where("channel = 'purchase'").select(F.col("spike_id").alias("a_id"), F.col("t").alias("ta"))
    b = s.where("channel = 'click'").select(F.col("spike_id").alias("b_id"), F.col("t").alias("tb"), "label")
    return joins.closest_in_time(a, b, SECOND).select("a_id", "dt", "b_id", "label")


@query(f"""WITH {S}, a AS (SELECT spike_id AS a_id, t AS ta FROM s WHERE channel = 'purchase'), b AS (SELECT spike_id AS b_id, t AS tb FROM s WHERE channel = 'click'),
p AS (SELECT a_id, b_id, row_number() OVER (PARTITION BY a_id ORDER BY abs(tb - ta), b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY abs(tb - ta), a_id) AS rb FROM a JOIN b ON abs(tb - ta) <= 1000000),
m AS (SELECT a_id, b_id FROM p WHERE ra = 1 AND rb = 1)
SELECT a_id, b_id, 'TP' AS category FROM m UNION ALL SELECT a_id, NULL, 'FN' FROM a WHERE a_id NOT IN (SELECT a_id FROM m) UNION ALL SELECT NULL, b_id, 'FP' FROM b WHERE b_id NOT IN (SELECT b_id FROM m)""")
def ground_truth_categories(spark, d):
    s = event_spikes(spark, d)
    a = s.where("channel = 'purchase'").select(F.col("spike_id").alias("a_id"), F.col("t").alias("ta"))
    b = s.where("channel = 'click'").select(F.col("spike_id").alias("b_id"), F.col("t").alias("tb"))
    return joins.categories(a, b, SECOND)


@query(f"""WITH {S} SELECT spike_id, EXISTS (SELECT 1 FROM s q WHERE q.label = s.label AND q.spike_id <> s.spike_id AND abs(q.t - s.t) <= 10000000 AND abs(q.t - s.t) > 1000000 AND q.amplitude >= s.amplitude) AS cc_flag FROM s""")
def cc_flag(spark, d):
    return joins.possible_collisions(event_spikes(spark, d), 10 * SECOND, SECOND, by=["label"]).select("spike_id", "cc_flag")


@query(f"""WITH {S}, m AS (SELECT label, row_number() OVER (ORDER BY median(amplitude), label) - 1 AS by_depth FROM s GROUP BY label) SELECT spike_id, by_depth FROM s JOIN m USING (label)""")
def depth_reorder(spark, d):
    return labels.reorder_by_depth(event_spikes(spark, d), "amplitude").select("spike_id", F.col("by_depth").cast("long").alias("by_depth"))


@query(f"WITH {S} SELECT spike_id, round(sign(amplitude - 25) * ln(1 + abs(amplitude - 25) * 2), 6) AS slog, round(sign(amplitude - 25) * (sqrt(1 + abs(amplitude - 25) * 3) - 1), 6) AS sroot FROM s")
def signed_transforms(spark, d):
    x = F.col("amplitude") - 25
    return event_spikes(spark, d).select("spike_id", r6(signed_log1p(x, 2.0)).alias("slog"), r6(signed_sqrt(x, 3.0)).alias("sroot"))


@query(f"WITH {S} SELECT spike_id, CAST(round_even(-amplitude / 4, 0) AS BIGINT) AS shift, CAST(trunc(-amplitude / 4) AS BIGINT) AS whole FROM s")
def pitch_shifts(spark, d):
    return event_spikes(spark, d).select("spike_id", motion.pitch_shift(F.col("amplitude"), 4.0).alias("shift"), motion.pitch_shift(F.col("amplitude"), 4.0, "floor").alias("whole"))


@query(f"""WITH {S}, m AS (SELECT t // 24000000 AS k, avg(amplitude) AS disp FROM s GROUP BY 1)
SELECT spike_id, round(amplitude - disp, 6) AS z_reg FROM s JOIN m ON s.t // 24000000 = m.k""")
def motion_correct(spark, d):
    s = event_spikes(spark, d)
    field = s.groupBy(F.floor(F.col("t") / (24 * SECOND)).alias("t_bin")).agg(F.avg("amplitude").alias("disp"))
    return motion.correct(s, field, "t", "amplitude", 24 * SECOND).select("spike_id", r6(F.col("z_reg")).alias("z_reg"))


@query(f"""WITH {S}, c AS (SELECT * FROM s WHERE channel = 'click'), p AS (SELECT * FROM s WHERE channel = 'purchase')
SELECT p.spike_id, c.amplitude AS last_click FROM p ASOF LEFT JOIN (SELECT label, t, max(amplitude) AS amplitude FROM c GROUP BY label, t) c ON p.label = c.label AND p.t >= c.t""")
def as_of_join(spark, d):
    s = event_spikes(spark, d)
    clicks = s.where("channel = 'click'").groupBy("label", F.col("t").alias("tc")).agg(F.max("amplitude").alias("last_click"))
    left = s.where("channel = 'purchase'").select("spike_id", "label", "t")
    return joins.as_of(left, clicks, ["label"], "t", "tc", ["last_click"], "spike_id").select("spike_id", "last_click")


@query()
def peel_chunks(spark, d):
    ship(spark)
    s = event_spikes(spark, d).select("spike_id", "t", F.col("amplitude").alias("v"))
    fn = detect.subtract_peaks(40.0, 3, [0.25, 0.5, 1.0, 0.5, 0.25])
    return detect.peel(s, 60 * SECOND, 5 * SECOND, fn, "chunk long, spike_id long, t long, height double")


@query(f"""WITH {S}, e AS (SELECT t // 24000000 AS t_bin, channel, count(*) AS n, round(avg(amplitude), 6) AS mean FROM s GROUP BY GROUPING SETS ((t // 24000000, channel), (channel), ()))
SELECT t_bin, channel, n, mean FROM e""")
def activity_rollup(spark, d):
    s = event_spikes(spark, d).withColumn("t_bin", F.floor(F.col("t") / (24 * SECOND)))
    return s.rollup("channel", "t_bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("amplitude")).alias("mean")).select("t_bin", "channel", "n", "mean")
