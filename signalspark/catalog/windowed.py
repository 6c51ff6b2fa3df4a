"""Windows, window features and sequence sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.catalog import fixtures as X
from signalspark.catalog import query
from signalspark.functions import samples as N
from signalspark.layout import SeriesLayout, number_rows
from signalspark.operators import features, normalize, relate, sequences, stats, windows
from signalspark.operators.windows import Cutter
from signalspark.schema import SignalSchema

L, H, STEP = 10, 2, 3
TL, TH = 4, 1


def cutter(layout, length=L, horizon=H, step=STEP) -> Cutter:
    return Cutter(X.SCHEMA, length, horizon, step, layout)


def prepared(spark: SparkSession, sf: str, layout) -> DataFrame:
    """Subject-holdout rows, gaps filled and z-scored."""
    filled = normalize.fill_raw(X.held_out(spark, sf, layout), X.SCHEMA, layout)
    return normalize.normalize_global(filled, X.SCHEMA.physiology)


FILLED = X.filled_sql(X.HELD_OUT)
SCALED = X.scaled_sql(X.HELD_OUT)
FLAGSHIP_SQL = f"""WITH {X.filled_sql(X.TIMED)}, {X.windows_sql("filled", TL, TH, 1)}, feat AS (
  SELECT worker_id, split, s, avg(temp) FILTER (WHERE o < {TL}) AS temp_mean,
    stddev_pop(temp) FILTER (WHERE o < {TL}) AS temp_std,
    regr_slope(temp, o) FILTER (WHERE o < {TL}) AS temp_slope,
    max(distance_to_robot) FILTER (WHERE o = {TL - 1}) AS distance_last,
    max(robot_speed) FILTER (WHERE o = {TL - 1}) AS speed_last,
    max(y_stress) FILTER (WHERE o = {TL + TH - 1}) AS y
  FROM cell GROUP BY 1, 2, 3)
SELECT split, CAST(count(*) AS BIGINT) AS windows, CAST(sum(y) AS BIGINT) AS positives,
  round(avg(temp_mean), 6) + 0.0 AS temp_mean, round(avg(temp_std), 6) + 0.0 AS temp_std,
  round(avg(temp_slope), 6) + 0.0 AS temp_slope,
  round(avg(distance_last / greatest(speed_last, 0.001::DOUBLE)), 6) + 0.0 AS ttc_proxy,
  round(avg(distance_last), 6) + 0.0 AS distance_last, round(avg(speed_last), 6) + 0.0 AS speed_last
FROM feat GROUP BY split"""


@query(FLAGSHIP_SQL)
def flagship_window_features(spark: SparkSession, sf: str) -> DataFrame:
    """Load, time split, gap fill, windows with horizon label, moment features, summary per split."""
    layout = X.layout_of(spark, sf)
    rows = normalize.fill_raw(X.timed(spark, sf, layout), X.SCHEMA, layout)
    cut = cutter(layout, TL, TH, 1)
    frame = cut.frame
    table = cut.cut(
        rows,
        [
            F.avg("temp").over(frame).alias("temp_mean"),
            F.stddev_pop("temp").over(frame).alias("temp_std"),
            features._slope(cut, "temp").alias("temp_slope"),
            *[v.alias(k) for k, v in features._motion(cut).items()],
            cut.label("y_stress").alias("y"),
        ],
    )
    means = ["temp_mean", "temp_std", "temp_slope", "ttc_proxy", "distance_last", "speed_last"]
    return table.groupBy("split").agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("y").cast("long").alias("positives"),
        *[X.r6(F.avg(c)).alias(c) for c in means],
    )


@query(
    f"""WITH {X.HELD_OUT}, {X.windows_sql("seg", L, H, STEP)}
SELECT worker_id, split, CAST(min(start_idx) AS INTEGER) AS start_idx,
  CAST(max(time_idx) FILTER (WHERE o = {L - 1}) AS INTEGER) AS end_idx,
  CAST(max(time_idx) FILTER (WHERE o = {L + H - 1}) AS INTEGER) AS label_time_idx,
  max(y_stress) FILTER (WHERE o = {L + H - 1}) AS y_stress,
  round(max(y_comfort_proxy) FILTER (WHERE o = {L + H - 1}), 6) + 0.0 AS y_comfort
FROM cell GROUP BY worker_id, split, s"""
)
def window_meta(spark: SparkSession, sf: str) -> DataFrame:
    layout = X.layout_of(spark, sf)
    meta = windows.window_meta(X.held_out(spark, sf, layout), cutter(layout))
    return meta.withColumn("y_comfort", X.r6("y_comfort"))


@query(
    f"""WITH {FILLED}, {X.windows_sql("filled", L, H, STEP)}
SELECT worker_id, split, CAST(start_idx AS INTEGER) AS start_idx, CAST(o AS INTEGER) AS step,
  round(ecg, 6) + 0.0 AS ecg, round(eda, 6) + 0.0 AS eda, round(temp, 6) + 0.0 AS temp,
  round(distance_to_robot, 6) + 0.0 AS distance_to_robot, round(robot_speed, 6) + 0.0 AS robot_speed,
  CAST(hazard_zone AS DOUBLE) AS hazard_zone
FROM cell WHERE o < {L}"""
)
def window_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Window arrays, unfolded to one row per step for comparison."""
    layout = X.layout_of(spark, sf)
    rows = normalize.fill_raw(X.held_out(spark, sf, layout), X.SCHEMA, layout)
    table = windows.window_table(rows, cutter(layout))
    channels = X.SCHEMA.channels(rows.columns)
    cells = table.select("worker_id", "split", "start_idx", F.posexplode(F.arrays_zip(*channels)).alias("step", "c"))
    return cells.select("worker_id", "split", "start_idx", "step", *[X.r6(f"c.{c}").alias(c) for c in channels])


@query(
    f"""WITH {X.HELD_OUT}, {X.windows_sql("seg", L, H, STEP)}
SELECT split, y_stress, CAST(count(*) AS BIGINT) AS windows FROM cell WHERE o = {L + H - 1} GROUP BY 1, 2"""
)
def window_balance(spark: SparkSession, sf: str) -> DataFrame:
    layout = X.layout_of(spark, sf)
    return windows.balance(windows.window_meta(X.held_out(spark, sf, layout), cutter(layout)))


@query(
    f"""WITH {X.TIMED}, m AS (SELECT min(c) AS shortest FROM (
  SELECT count(*) AS c FROM seg GROUP BY worker_id, split))
SELECT CAST(shortest AS BIGINT) AS shortest,
  CAST(CASE WHEN shortest <= 60 THEN greatest(4, shortest - 6) ELSE 60 END AS BIGINT) AS window_length FROM m"""
)
def window_length_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The configured length of 60 with a horizon of 5, shrunk to what the shortest part allows."""
    layout = X.layout_of(spark, sf)
    return windows.length_fit(X.timed(spark, sf, layout), "worker_id", 60, 5)


# The comparison finds peaks as runs of equal values that are higher than both neighbours inside the window.
def _peaks_sql(source: str, value: str, out: str, extra: str = "") -> str:
    key = "worker_id, split, s"
    return f"""{out}_run AS (
  SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY o) AS run FROM (
    SELECT *, CASE WHEN {value} = lag({value}) OVER (PARTITION BY {key} ORDER BY o) THEN 0 ELSE 1 END AS fresh
    FROM {source})
), {out}_top AS (
  SELECT {key}, run, min(o) AS a, max(o) AS b, min({value}) AS h FROM {out}_run GROUP BY {key}, run
), {out} AS (
  SELECT {key}, (a + b) // 2 AS p, h FROM (
    SELECT *, lag(h) OVER (PARTITION BY {key} ORDER BY a) AS below,
      lead(h) OVER (PARTITION BY {key} ORDER BY a) AS beyond FROM {out}_top)
  WHERE below < h AND beyond < h {extra}
)"""


def beat_sql(hz: float) -> str:
    return f"""{_peaks_sql("cells", "ecg", "beat")}, {heart_sql(hz)}"""


def heart_sql(hz: float) -> str:
    key = "worker_id, split, s"
    return f"""gap AS (
  SELECT {key}, p, (p - lag(p) OVER (PARTITION BY {key} ORDER BY p)) / {hz}::DOUBLE AS g FROM beat
), jump AS (
  SELECT {key}, g, (g - lag(g) OVER (PARTITION BY {key} ORDER BY p)) * 1000 AS d FROM gap
), heart AS (
  SELECT {key}, 60.0::DOUBLE / greatest(avg(g), 0.000001::DOUBLE) AS meanHR, sqrt(avg(d * d)) AS RMSSD,
    stddev_pop(g * 1000) AS SDNN, avg(CASE WHEN abs(d) > 50 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0.0::DOUBLE END)
      AS pNN50
  FROM jump GROUP BY {key} HAVING count(*) >= 3
)"""


def skin_sql(length: int, hz: float, threshold: float, distance: int) -> str:
    key = "worker_id, split, s"
    kernel = max(3, int(min(length - 1, hz * 2)))
    back, ahead = kernel // 2, (kernel - 1) // 2
    return f"""tone AS (
  SELECT {key}, o, eda, sum(eda) OVER (PARTITION BY {key} ORDER BY o
    ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING) / {kernel} AS tonic FROM cells
), phase AS (SELECT *, round(eda - tonic, 9) AS phasic FROM tone),
{_peaks_sql("phase", "phasic", "resp", f"AND h >= {threshold}")}, place AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY h DESC, p DESC) AS r FROM resp
), kept AS (
  SELECT {key}, r, [p] AS ps, [h] AS hs FROM place WHERE r = 1
  UNION ALL
  SELECT k.worker_id, k.split, k.s, k.r + 1,
    CASE WHEN len(list_filter(k.ps, lambda q: abs(q - n.p) < {distance})) = 0 THEN list_append(k.ps, n.p) ELSE k.ps END,
    CASE WHEN len(list_filter(k.ps, lambda q: abs(q - n.p) < {distance})) = 0 THEN list_append(k.hs, n.h) ELSE k.hs END
  FROM kept k JOIN place n ON n.worker_id = k.worker_id AND n.split = k.split AND n.s = k.s AND n.r = k.r + 1
), scr AS (
  SELECT {key}, CAST(len(ps) AS DOUBLE) AS scr_count, list_avg(hs) AS scr_mean_amp FROM kept
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY r DESC) = 1
), skin AS (SELECT {key}, avg(tonic) AS scl_mean, var_pop(tonic) AS scl_var FROM tone GROUP BY {key})"""


HZ = 4.0
FEATURES_SQL = f"""WITH RECURSIVE {SCALED}, {X.windows_sql("scaled", L, H, STEP)},
cells AS (SELECT * FROM cell WHERE o < {L}), {beat_sql(HZ)}, {skin_sql(L, HZ, 0.05, 3)}, rest AS (
  SELECT worker_id, split, s, min(start_idx) AS start_idx, avg(temp) AS temp_mean, stddev_pop(temp) AS temp_std,
    regr_slope(temp, o) AS temp_slope, max(distance_to_robot) FILTER (WHERE o = {L - 1}) AS distance_last,
    max(robot_speed) FILTER (WHERE o = {L - 1}) AS speed_last FROM cells GROUP BY worker_id, split, s)
SELECT worker_id, split, CAST(start_idx AS INTEGER) AS start_idx, {", ".join(
    f"round({c}, 6) + 0.0 AS {c}" for c in ("meanHR", "RMSSD", "SDNN", "pNN50", "scl_mean", "scl_var"))},
  coalesce(scr_count, 0.0::DOUBLE) AS scr_count, round(coalesce(scr_mean_amp, 0.0::DOUBLE), 6) + 0.0 AS scr_mean_amp,
  round(temp_mean, 6) + 0.0 AS temp_mean, round(temp_std, 6) + 0.0 AS temp_std,
  round(temp_slope, 6) + 0.0 AS temp_slope,
  round(distance_last / greatest(speed_last, 0.001::DOUBLE), 6) + 0.0 AS ttc_proxy,
  round(distance_last, 6) + 0.0 AS distance_last, round(speed_last, 6) + 0.0 AS speed_last
FROM rest LEFT JOIN heart USING (worker_id, split, s) LEFT JOIN scr USING (worker_id, split, s)
  LEFT JOIN skin USING (worker_id, split, s)"""


@query(FEATURES_SQL)
def window_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """Heart, skin, temperature and motion features of every window."""
    layout = X.layout_of(spark, sf)
    table = features.feature_table(prepared(spark, sf, layout), cutter(layout), HZ, frequency=False)
    names = features.feature_names(table)
    return table.select("worker_id", "split", "start_idx", *[X.r6(c).alias(c) for c in names])


def thinned_sql(source: str, out: str, distance: int) -> str:
    """``out``: the peaks p of ``source`` that are left when taller ones, then later ones, close their neighbourhood."""
    key = "worker_id, split, s"
    free = f"len(list_filter(k.ps, lambda q: abs(q - n.p) < {distance})) = 0"
    return f"""{out}_place AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY h DESC, p DESC) AS r FROM {source}
), {out}_kept AS (
  SELECT {key}, r, [p] AS ps FROM {out}_place WHERE r = 1
  UNION ALL
  SELECT k.worker_id, k.split, k.s, k.r + 1, CASE WHEN {free} THEN list_append(k.ps, n.p) ELSE k.ps END
  FROM {out}_kept k JOIN {out}_place n ON n.worker_id = k.worker_id AND n.split = k.split AND n.s = k.s AND n.r = k.r + 1
), {out} AS (
  SELECT {key}, unnest(ps) AS p FROM (
    SELECT * FROM {out}_kept QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY r DESC) = 1)
)"""


# Long windows on the lines of each supplier: kernels of 256 samples, beats 38 and skin responses 200 samples apart. The
# comparison rounds samples to nine digits before it looks for responses, so their mean height is compared to four.
LONG_L, LONG_H, LONG_STEP, LONG_HZ, LONG_APART = 300, 5, 100, 128.0, 200
LONG = SignalSchema(physiology=("ecg", "eda", "temp", "resp", "accel"), context=())
LONG_SQL = f"""WITH RECURSIVE seg AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS worker_id, 'all' AS split, l_extendedprice AS ecg,
    l_extendedprice / 7000 AS eda, l_discount * 10 + l_quantity / 100 AS temp, l_quantity AS resp, l_tax * 7 AS accel,
    row_number() OVER w - 1 AS pos, row_number() OVER w - 1 AS time_idx, count(*) OVER (PARTITION BY l_suppkey) AS seg_n
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)
), {X.windows_sql("seg", LONG_L, LONG_H, LONG_STEP)}, cells AS (SELECT * FROM cell WHERE o < {LONG_L}),
{_peaks_sql("cells", "ecg", "top")}, {thinned_sql("top", "beat", int(0.3 * LONG_HZ))},
{heart_sql(LONG_HZ)},
{skin_sql(LONG_L, LONG_HZ, 0.05, LONG_APART)}, rest AS (
  SELECT worker_id, split, s, min(start_idx) AS start_idx, avg(temp) AS temp_mean, stddev_pop(temp) AS temp_std,
    regr_slope(temp, o) AS temp_slope, avg(resp) AS resp_mean, stddev_pop(resp) AS resp_std, avg(accel) AS accel_mean,
    stddev_pop(accel) AS accel_std FROM cells GROUP BY worker_id, split, s)
SELECT worker_id, CAST(start_idx AS INTEGER) AS start_idx, {", ".join(
    f"round({c}, 6) + 0.0 AS {c}" for c in (
        "meanHR", "RMSSD", "SDNN", "pNN50", "scl_mean", "scl_var", "temp_mean", "temp_std", "temp_slope", "resp_mean",
        "resp_std", "accel_mean", "accel_std"))},
  coalesce(scr_count, 0.0::DOUBLE) AS scr_count, round(coalesce(scr_mean_amp, 0.0::DOUBLE), 4) + 0.0 AS scr_mean_amp
FROM rest LEFT JOIN heart USING (worker_id, split, s) LEFT JOIN scr USING (worker_id, split, s)
  LEFT JOIN skin USING (worker_id, split, s)"""


def supplier_series(spark: SparkSession, sf: str, columns: dict) -> tuple[DataFrame, SeriesLayout]:
    """The lines of each supplier in order, as one series, with the given signal columns."""
    lines = X.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("worker_id"),
        F.lit("all").alias("split"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        *[v.alias(k) for k, v in columns.items()],
        F.lit(0.0).alias("y_stress"),
        F.lit(0.0).alias("y_comfort_proxy"),
    )
    layout = SeriesLayout.fit(lines, "worker_id", "l_orderkey")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = number_rows(lines, ["worker_id"], order, layout, "_seg_pos", "_seg_n")
    return rows.withColumn("time_idx", F.col("_seg_pos").cast("int")), layout


@query(LONG_SQL)
def long_window_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of long windows, breath and motion channels included."""
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    columns = {"ecg": price, "eda": price / 7000, "temp": F.col("l_discount") * 10 + quantity / 100}
    rows, layout = supplier_series(spark, sf, columns | {"resp": quantity, "accel": F.col("l_tax") * 7})
    cut = Cutter(LONG, LONG_L, LONG_H, LONG_STEP, layout)
    table = features.feature_table(rows, cut, LONG_HZ, frequency=False, scr_distance=LONG_APART)
    names = [c for c in features.feature_names(table) if c not in ("distance_last", "speed_last")]
    rounded = {c: X.r6(c) for c in names} | {"scr_mean_amp": F.round("scr_mean_amp", 4) + F.lit(0.0)}
    return table.select("worker_id", "start_idx", *[v.alias(c) for c, v in rounded.items()])


# Beat spectrum on longer series: the lines of each supplier, with the price as the signal.
SL, SH, SSTEP = 80, 2, 40
SPECTRUM_SQL = f"""WITH seg AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS worker_id, 'all' AS split, l_extendedprice AS ecg,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1
      AS time_idx, count(*) OVER (PARTITION BY l_suppkey) AS seg_n FROM lineitem
), {X.windows_sql("seg", SL, SH, SSTEP)}, cells AS (SELECT * FROM cell WHERE o < {SL}), {beat_sql(HZ)}, q AS (
  SELECT worker_id, split, s, g, row_number() OVER (PARTITION BY worker_id, split, s ORDER BY p) - 2 AS k,
    count(g) OVER (PARTITION BY worker_id, split, s) AS n,
    avg(g) OVER (PARTITION BY worker_id, split, s) AS centre FROM gap
), t AS (
  SELECT *, 0.5 - 0.5 * cos(2 * pi() * k / n) AS w FROM q WHERE g IS NOT NULL AND n >= 8
), f AS (
  SELECT worker_id, split, s, n, m, 2 * (pow(sum((g - centre) * w * cos(2 * pi() * m * k / n)), 2)
    + pow(sum((g - centre) * w * sin(2 * pi() * m * k / n)), 2)) / (4 * sum(w * w)) AS psd
  FROM t, (SELECT unnest(range(1, 33)) AS m) GROUP BY 1, 2, 3, 4, 5
), band AS (
  SELECT worker_id, split, s, CASE WHEN m * 4.0::DOUBLE / n < 0.15 THEN 'LF' ELSE 'HF' END AS band, m, psd, n FROM f
  WHERE m * 4.0::DOUBLE / n >= 0.04 AND m * 4.0::DOUBLE / n < 0.40
), area AS (
  SELECT worker_id, split, s, band, sum(coalesce(a, 0)) AS v FROM (
    SELECT *, (psd + lag(psd) OVER (PARTITION BY worker_id, split, s, band ORDER BY m)) / 2 * 4.0::DOUBLE / n AS a
    FROM band) GROUP BY 1, 2, 3, 4
), two AS (SELECT worker_id, split, s, max(v) FILTER (WHERE band = 'LF') AS lf,
  max(v) FILTER (WHERE band = 'HF') AS hf FROM area GROUP BY 1, 2, 3)
SELECT w.worker_id, CAST(w.start_idx AS INTEGER) AS start_idx, round(lf, 6) + 0.0 AS "LF", round(hf, 6) + 0.0 AS "HF",
  CASE WHEN hf > 0 THEN round(lf / hf, 6) + 0.0 END AS "LF_HF"
FROM win w LEFT JOIN two USING (worker_id, split, s)"""


@query(SPECTRUM_SQL)
def beat_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    rows, layout = supplier_series(spark, sf, {"ecg": F.col("l_extendedprice")})
    cut = cutter(layout, SL, SH, SSTEP)
    sampled = cut.take(rows, cut.marks(), {"_ecg": cut.run("ecg")})
    signals = N.window_signals(F.col("_ecg"), F.col("_ecg"), SL, HZ, True, 0.05, 3)
    spectrum = sampled.select("worker_id", "start_idx", signals.alias("_s")).select("worker_id", "start_idx", "_s.*")
    return spectrum.select("worker_id", "start_idx", *[X.r6(c).alias(c) for c in ("LF", "HF", "LF_HF")])


@query(
    f"""WITH {FILLED}, {X.windows_sql("filled", L, H, STEP)}
SELECT worker_id, split, CAST(start_idx AS INTEGER) AS start_idx, CAST(o AS INTEGER) AS step,
  CASE WHEN o < {L} THEN round(ecg, 6) + 0.0 END AS ecg, round(distance_to_robot, 6) + 0.0 AS distance_to_robot,
  task_phase, CASE WHEN o >= {L} THEN y_stress END AS target FROM cell"""
)
def sequence_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Encoder and decoder parts, unfolded: signals end with the encoder, targets start with the decoder."""
    layout = X.layout_of(spark, sf)
    rows = normalize.fill_raw(X.held_out(spark, sf, layout), X.SCHEMA, layout)
    table = sequences.sequence_set(rows, cutter(layout), "y_stress", use_profiles=False)

    def joined(c: str):
        return F.concat(f"enc_{c}", f"dec_{c}").alias(c)

    blank = F.array_repeat(F.lit(None).cast("double"), L)
    cells = table.select(
        "worker_id",
        "split",
        "start_idx",
        F.posexplode(
            F.arrays_zip(
                F.concat("enc_ecg", F.array_repeat(F.lit(None).cast("double"), H)).alias("ecg"),
                joined("distance_to_robot"),
                joined("task_phase"),
                F.concat(blank, "dec_target").alias("target"),
            )
        ).alias("step", "c"),
    )
    return cells.select(
        "worker_id",
        "split",
        "start_idx",
        "step",
        X.r6("c.ecg").alias("ecg"),
        X.r6("c.distance_to_robot").alias("distance_to_robot"),
        F.col("c.task_phase").alias("task_phase"),
        F.col("c.target").alias("target"),
    )


@query(
    f"""WITH {X.HELD_OUT}, {X.windows_sql("seg", L, H, STEP)}, w AS (
  SELECT worker_id, split, s, max(y_stress) FILTER (WHERE o = {L + H - 1}) AS y FROM cell GROUP BY 1, 2, 3)
SELECT split, CAST(count(*) AS BIGINT) AS windows, CAST(count(DISTINCT worker_id) AS BIGINT) AS last_windows,
  CAST(sum(y) AS BIGINT) AS positives, CAST(count(*) - sum(y) AS BIGINT) AS negatives FROM w GROUP BY split"""
)
def sequence_set_sizes(spark: SparkSession, sf: str) -> DataFrame:
    layout = X.layout_of(spark, sf)
    meta = windows.window_meta(X.held_out(spark, sf, layout), cutter(layout))
    return sequences.set_sizes(meta, "worker_id", "y_stress")


@query(
    f"""WITH {X.HELD_OUT}, {X.windows_sql("seg", L, H, STEP)}
SELECT worker_id, split, CAST(max(start_idx) AS INTEGER) AS start_idx FROM win GROUP BY worker_id, split"""
)
def last_window_per_series(spark: SparkSession, sf: str) -> DataFrame:
    layout = X.layout_of(spark, sf)
    meta = windows.window_meta(X.held_out(spark, sf, layout), cutter(layout))
    return sequences.last_per_series(meta, "worker_id").select("worker_id", "split", "start_idx")


@query(
    f"""WITH {X.HELD_OUT}, t AS (SELECT * FROM seg WHERE split = 'train' ORDER BY worker_id, time_idx LIMIT 1)
SELECT worker_id, CAST(pos // 2 AS INTEGER) AS time_idx, split, CAST(experience_level AS VARCHAR) AS experience_level,
  task_phase, y_stress, CASE WHEN ecg IS NOT NULL THEN round(ecg, 6) + 0.0 END AS ecg,
  round(robot_speed, 6) + 0.0 AS robot_speed FROM seg WHERE pos % 2 = 0
UNION ALL
SELECT s.worker_id, 0, 'train', CAST(t.experience_level AS VARCHAR), t.task_phase, 0.0, 0.0,
  round(t.robot_speed, 6) + 0.0 FROM (SELECT DISTINCT worker_id FROM seg WHERE split <> 'train') s, t"""
)
def sequence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Row stride with a new index, text categories, and a neutral training row per unseen worker."""
    rows = X.held_out(spark, sf, X.layout_of(spark, sf))
    slim = rows.drop("user_id", "event_id", "_at", "value")
    padded = sequences.pad_unseen(sequences.reindex(slim, X.SCHEMA, 2), X.SCHEMA, "y_stress")
    columns = ["worker_id", "time_idx", "split", "experience_level", "task_phase", "y_stress"]
    return padded.select(*columns, X.r6("ecg").alias("ecg"), X.r6("robot_speed").alias("robot_speed"))


@query(
    f"""WITH {X.HELD_OUT}, v AS (SELECT task_phase, dense_rank() OVER (ORDER BY task_phase) - 1 AS code FROM (
  SELECT DISTINCT task_phase FROM seg WHERE split = 'train')), w AS (
  SELECT worker_id, dense_rank() OVER (ORDER BY worker_id) - 1 AS code FROM (
    SELECT DISTINCT worker_id FROM seg WHERE split = 'train'))
SELECT event_id, CAST(v.code AS DOUBLE) AS task_phase_code,
  CAST(coalesce(w.code, (SELECT count(*) FROM w)) AS DOUBLE) AS worker_id_code
FROM seg JOIN v USING (task_phase) LEFT JOIN w USING (worker_id)"""
)
def category_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Indices fitted on training; unseen workers share the extra slot."""
    u = F.col("user_id") % 10
    rows = X.raw_signals(spark, sf).withColumn("split", F.when(u < 7, "train").otherwise("rest"))
    coded = sequences.index_categories(rows, ["task_phase", "worker_id"])
    return coded.select("event_id", "task_phase_code", "worker_id_code")


CELLS = ("ecg", "eda", "temp", "distance_to_robot", "robot_speed")


@query(
    f"""WITH {X.HELD_OUT} SELECT split, CAST(count(*) AS BIGINT) AS rows, {len(CELLS)}::BIGINT AS columns,
  CAST({" + ".join(f"count(*) - count({c})" for c in CELLS)} AS BIGINT) AS nan_count, 0::BIGINT AS inf_count,
  round(({" + ".join(f"count({c})" for c in CELLS)})::DOUBLE / (count(*) * {len(CELLS)}), 6) + 0.0 AS finite_ratio
FROM seg GROUP BY split"""
)
def matrix_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.held_out(spark, sf, X.layout_of(spark, sf))
    table = stats.matrix_stats(rows, CELLS)
    return table.withColumn("finite_ratio", X.r6("finite_ratio"))


@query(
    f"""WITH {X.HELD_OUT}, {X.windows_sql("seg", L, H, STEP)}, p AS (
  SELECT worker_id, avg(eda) AS mu FROM seg WHERE split = 'train' GROUP BY 1)
SELECT w.worker_id, w.split, CAST(start_idx AS INTEGER) AS start_idx,
  round(coalesce(mu, 0.0::DOUBLE), 6) + 0.0 AS profile_baseline_mu_eda FROM win w LEFT JOIN p USING (worker_id)"""
)
def profile_features(spark: SparkSession, sf: str) -> DataFrame:
    """Profile columns on windows; 0 for workers that training never saw."""
    layout = X.layout_of(spark, sf)
    rows = X.held_out(spark, sf, layout)
    static = rows.where("split = 'train'").groupBy("worker_id").agg(F.avg("eda").alias("baseline_mu_eda"))
    table = relate.append_profiles(windows.window_meta(rows, cutter(layout)), static)
    return table.select(
        "worker_id", "split", "start_idx", X.r6("profile_baseline_mu_eda").alias("profile_baseline_mu_eda")
    )
