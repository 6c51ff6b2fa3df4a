"""Per-worker baselines fitted on training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.functions import scalar as S
from signalspark.layout import SeriesLayout, add_block
from signalspark.operators import relate
from signalspark.schema import SignalSchema


def _safe(df: DataFrame, safe_col: str | None) -> Column:
    """Rows to fit on; a missing flag counts as safe."""
    if not safe_col or safe_col not in df.columns:
        return F.lit(True)
    return F.coalesce(S.number(F.col(safe_col).cast("double")), F.lit(1.0)) != 0


def global_baselines(df: DataFrame, columns: Sequence[str], safe_col: str | None = None) -> DataFrame:
    """One row of mean and sample deviation over safe rows; (0, 1) without values."""
    safe = _safe(df, safe_col)
    out = []
    for c in columns:
        x = F.when(safe, S.number(F.col(c)))
        out.append(F.coalesce(F.avg(x), F.lit(0.0)).alias(f"baseline_mu_{c}"))
        out.append(F.coalesce(F.stddev_samp(x) + 1e-6, F.lit(1.0)).alias(f"baseline_sigma_{c}"))
    return df.agg(*out)


def worker_baselines(
    df: DataFrame,
    columns: Sequence[str],
    alpha: float,
    worker: str,
    pos: str,
    layout: SeriesLayout,
    safe_col: str | None = None,
) -> DataFrame:
    """Exponential mean and deviation per worker over its safe rows (all rows if none is safe), in time order.

    The moving average is a weighted sum, ``alpha * (1 - alpha)^(rows after)``, with the first value keeping
    the rest of the weight. So it merges: blocks reduce to (count, weighted sums), and a block's share shrinks
    by the rows that follow it. Workers without values fall back to the overall baseline.
    """
    overall = global_baselines(df, columns, safe_col)
    rows = add_block(df, layout, pos).withColumn("_safe", _safe(df, safe_col))
    later = Window.partitionBy(worker, "_block").orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, -1)
    variants = {"safe": F.col("_safe"), "any": F.lit(True)} if safe_col else {"any": F.lit(True)}
    keep = 1.0 - alpha
    values = {f"{v}_{c}": F.when(use, S.number(F.col(c))) for v, use in variants.items() for c in columns}
    known = rows.withColumns({f"_x_{k}": x for k, x in values.items()})
    weighted = known.withColumns({f"_after_{k}": F.count(f"_x_{k}").over(later) for k in values})

    def weight(k: str) -> Column:
        return F.lit(alpha) * F.pow(F.lit(keep), F.col(f"_after_{k}"))

    def present(k: str, what: Column) -> Column:
        return F.when(F.col(f"_x_{k}").isNotNull(), what)

    blocks = weighted.groupBy(worker, "_block").agg(
        F.max("_safe").alias("_safe"),
        *[F.count(f"_x_{k}").alias(f"_k_{k}") for k in values],
        *[F.sum(weight(k) * F.col(f"_x_{k}")).alias(f"_s_{k}") for k in values],
        *[F.sum(weight(k) * F.col(f"_x_{k}") * F.col(f"_x_{k}")).alias(f"_q_{k}") for k in values],
        *[F.min_by(F.col(f"_x_{k}"), present(k, F.col(pos))).alias(f"_first_{k}") for k in values],
    )
    following = Window.partitionBy(worker).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    faded = blocks.withColumns(
        {f"_fade_{k}": F.pow(F.lit(keep), F.coalesce(F.sum(f"_k_{k}").over(following), F.lit(0))) for k in values}
    )
    sums = faded.groupBy(worker).agg(
        F.max("_safe").alias("_any_safe"),
        *[F.sum(f"_k_{k}").alias(f"_n_{k}") for k in values],
        *[F.sum(F.col(f"_s_{k}") * F.col(f"_fade_{k}")).alias(f"_s_{k}") for k in values],
        *[F.sum(F.col(f"_q_{k}") * F.col(f"_fade_{k}")).alias(f"_q_{k}") for k in values],
        *[F.min_by(f"_first_{k}", present_block(k)).alias(f"_first_{k}") for k in values],
    )

    def mean(k: str, part: str, first: Column) -> Column:
        return F.col(f"_{part}_{k}") + F.pow(F.lit(keep), F.col(f"_n_{k}")) * first

    out = []
    for c in columns:
        mus, sigmas = {}, {}
        for v in variants:
            k = f"{v}_{c}"
            first = F.col(f"_first_{k}")
            mus[v] = mean(k, "s", first)
            spread = F.sqrt(F.greatest(mean(k, "q", first * first) - mus[v] * mus[v], F.lit(1e-6)))
            sigmas[v] = F.when(first.isNotNull(), spread)
        mu, sigma = mus["any"], sigmas["any"]
        if safe_col:
            mu = F.when(F.col("_any_safe"), mus["safe"]).otherwise(mu)
            sigma = F.when(F.col("_any_safe"), sigmas["safe"]).otherwise(sigma)
        out += [mu.alias(f"baseline_mu_{c}"), sigma.alias(f"baseline_sigma_{c}")]
    own = sums.select(worker, *out)
    names = [c for c in own.columns if c != worker]
    return relate.baselines_or_global(own.select(worker), own, overall, names, worker)


def present_block(k: str) -> Column:
    return F.when(F.col(f"_k_{k}") > 0, F.col("_block"))


def worker_attributes(df: DataFrame, schema: SignalSchema, pos: str) -> DataFrame:
    """Specialisation and experience (1 to 5) of each worker's first row."""
    source = next((c for c in (schema.specialization, "specialization_id") if c in df.columns), None)
    bucket = S.stable_bucket(F.col(schema.worker), 5)
    specialization = F.col(source).cast("int") if source else bucket
    experience = F.col(schema.experience).cast("int") if schema.experience in df.columns else bucket + 1
    first = F.min_by(F.struct(specialization.alias("s"), experience.alias("e")), F.col(pos))
    return df.groupBy(schema.worker).agg(first.alias("_f")).select(
        schema.worker,
        F.col("_f.s").alias("specialization_id"),
        F.least(F.greatest(F.col("_f.e"), F.lit(1)), F.lit(5)).alias("experience_level"),
    )


def profile_table(
    df: DataFrame,
    schema: SignalSchema,
    alpha: float,
    layout: SeriesLayout,
    safe_col: str | None = None,
    pos: str = "_seg_pos",
) -> DataFrame:
    """Attributes and baselines, one row per training worker."""
    train = df.where(F.col("split") == "train")
    stats = worker_baselines(train, schema.physiology, alpha, schema.worker, pos, layout, safe_col)
    return worker_attributes(train, schema, pos).join(stats, schema.worker)


def zscore(df: DataFrame, own: DataFrame, overall: DataFrame, columns: Sequence[str], worker: str) -> DataFrame:
    """z-score against the worker's baseline, or the overall one for unknown workers."""
    names = [f"baseline_{s}_{c}" for c in columns for s in ("mu", "sigma")]
    rows = relate.baselines_or_global(df.drop(*names), own, overall, names, worker)
    sigma = {f"baseline_sigma_{c}": F.col(f"baseline_sigma_{c}") for c in columns}
    rows = rows.withColumns({n: F.when(s == 0, F.lit(1e-6)).otherwise(s) for n, s in sigma.items()})
    return rows.withColumns(
        {c: (F.col(c) - F.col(f"baseline_mu_{c}")) / F.col(f"baseline_sigma_{c}") for c in columns}
    )
