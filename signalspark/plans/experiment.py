"""Load, split, normalise, window, train, evaluate, compare and write, from one configuration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark import sinks
from signalspark.functions import scalar as S
from signalspark.layout import SeriesLayout
from signalspark.operators import (
    clean,
    compare,
    evaluate,
    features,
    models,
    normalize,
    profiles,
    relate,
    sequences,
    split,
    stats,
    windows,
)
from signalspark.operators.windows import Cutter
from signalspark.schema import SignalSchema
from signalspark.session import materialize
from signalspark.sources import router

TREES, SEQUENCE = "trees", "sequence"


@dataclass
class Prepared:
    """Split, filled and normalised rows with the window geometry fitted to them."""

    rows: DataFrame
    static: DataFrame | None
    cutter: Cutter
    manifest: DataFrame


@dataclass
class Outcome:
    metrics: DataFrame
    comparison: DataFrame
    balance: DataFrame
    reports: DataFrame
    ablation: DataFrame | None
    results: DataFrame


def assign(df: DataFrame, schema: SignalSchema, cfg: Mapping, layout: SeriesLayout, order=None) -> DataFrame:
    """The configured split: by time, or by subject with five, one and two subjects unless listed."""
    rule = cfg.get("split", {})
    if str(rule.get("mode", "time")).lower() != "subject_holdout":
        shares = (float(rule.get(f"{s}_ratio", d)) for s, d in (("train", 0.7), ("val", 0.15), ("test", 0.15)))
        return split.by_time(df, schema, *shares, layout, order)
    subjects = [str(s) for s in cfg.get("dataset", {}).get("subjects") or []]
    defaults = {"train": subjects[:5], "val": subjects[5:6], "test": subjects[6:8]}
    groups = {s: rule.get(f"{s}_subjects") or d for s, d in defaults.items()}
    if not any(groups.values()):
        raise ValueError("a subject holdout needs dataset.subjects or explicit subject lists")
    table = split.check_assignment(df, schema, split.assignment_table(df.sparkSession, schema, groups))
    return split.by_subject(df, schema, table, layout, order)


def prepare(frame: DataFrame, schema: SignalSchema, cfg: Mapping, assignment: DataFrame | None = None) -> Prepared:
    """Typed frame to normalised rows. Statistics come from training rows only."""
    layout = SeriesLayout.fit(frame, schema.worker, schema.time_idx)
    if assignment is None:
        placed = assign(frame, schema, cfg, layout)
    else:
        table = split.check_assignment(frame, schema, assignment)
        placed = split.by_subject(frame, schema, table, layout)
    # Statistics, profiles, windows and sinks all start from these rows.
    filled = materialize(normalize.fill_raw(placed, schema, layout), "filled")
    scaled = normalize.normalize(filled, schema, cfg, layout)
    profile_cfg = cfg.get("profiles", {})
    use_static = bool(profile_cfg.get("use_static_meta", False))
    static = None
    if bool(profile_cfg.get("enabled", True)) and use_static:
        fit = cfg.get("profile", {})
        table = profiles.profile_table(
            filled, schema, float(fit.get("ema_alpha", 0.1)), layout, fit.get("safe_col") or None
        )
        named = {"specialization_id": schema.specialization, "experience_level": schema.experience}
        static = materialize(table.withColumnsRenamed(named), "profiles")
    rows = relate.attach_static(
        scaled, static, schema.physiology, use_static, schema.worker, schema.specialization, schema.experience
    )
    if normalize.mode_of(cfg) == "online":
        # Global scaling is a projection over the filled rows; the online one is worth keeping.
        rows = materialize(rows, "rows")
    rows = clean.require_finite(rows, [*schema.signals, schema.hazard], "split")
    task = cfg.get("task", {})
    horizon = int(task.get("horizon_steps", 5))
    shortest = windows.shortest_series(filled, schema.worker)
    length = windows.fitted_length(shortest, int(task.get("window_length", 60)), horizon)
    geometry = Cutter(schema, length, horizon, int(task.get("window_step", 1)), layout)
    return Prepared(rows, static, geometry, split.manifest(filled, schema))


def features_of(prepared: Prepared, cfg: Mapping) -> DataFrame:
    feature_cfg, task = cfg.get("features", {}), cfg.get("task", {})
    hz = S.effective_rate(float(task.get("sampling_rate_hz", 1.0)), cfg.get("dataset", {}).get("downsample_factor"))
    eda = feature_cfg.get("eda", {})
    return features.feature_table(
        prepared.rows,
        prepared.cutter,
        hz,
        bool(feature_cfg.get("hrv", {}).get("include_freq_domain", True)),
        float(eda.get("scr_threshold", 0.05)),
        int(eda.get("min_scr_distance", 3)),
    )


def threshold_rule(cfg: Mapping) -> dict:
    """``thresholding`` wins over the model's own settings."""
    own, shared = cfg.get("xgboost", {}), cfg.get("thresholding", {})
    return {
        "policy": str(shared.get("policy", own.get("threshold_policy", "f1"))).lower(),
        "target_recall": float(shared.get("target_recall", own.get("target_recall", 0.7))),
        "target_precision": float(shared.get("target_precision", own.get("target_precision", 0.7))),
        "min_pred_rate": float(shared.get("min_pred_rate", 0.02)),
        "max_pred_rate": float(shared.get("max_pred_rate", 0.98)),
        "allow_pathological": bool(shared.get("allow_pathological", False)),
    }


def judge(scored: DataFrame, cfg: Mapping, model: str) -> DataFrame:
    """Threshold from validation rows, metrics on test rows, in long form. Scores are computed once."""
    scored = materialize(scored.where(F.col("split") != "train").select("split", "y", "p"), "scored")
    val, test = (
        clean.require_rows(scored.where(F.col("split") == s).select("y", "p"), f"scoring {s} windows")
        for s in ("val", "test")
    )
    chosen = evaluate.select_threshold(val, **threshold_rule(cfg)).first()["threshold"]
    metrics = evaluate.classification_metrics(test, chosen)
    extra = evaluate.run_diagnostics(val, test, chosen)
    return compare.long_metrics(metrics, model, "stress").unionByName(compare.long_metrics(extra, model, "stress"))


def run_trees(
    table: DataFrame, static: DataFrame | None, schema: SignalSchema, cfg: Mapping, model: str = TREES
) -> tuple[DataFrame, dict[str, models.Fitted]]:
    """Both targets with boosted trees: profile columns, training medians, fit, calibrate, judge."""
    full = relate.append_profiles(table, static, schema.worker)
    names = features.feature_names(full, schema.worker)
    ready = normalize.impute_medians(full, normalize.train_medians(full, names))
    params = cfg.get("xgboost", {})
    stress = models.fit_boosted(ready, names, "y_stress", "classification", params)
    comfort = models.fit_boosted(ready, names, "y_comfort", "regression", params)
    out = judge(stress.score(ready).withColumnRenamed("y_stress", "y"), cfg, model)
    scored = comfort.score(ready.where("split = 'test'")).select(F.col("y_comfort").alias("y"), "p")
    out = out.unionByName(compare.long_metrics(evaluate.regression_metrics(scored), model, "comfort"))
    return out, {"stress": stress, "comfort": comfort}


def run_sequence(prepared: Prepared, cfg: Mapping, model: str = SEQUENCE) -> DataFrame:
    """Both targets with the sequence forecaster, on rows thinned by the window step."""
    base = prepared.cutter
    schema = base.schema
    step = max(1, base.step)
    cutter = Cutter(schema, base.length, base.horizon, 1, base.layout)
    params = cfg.get("tft", {})
    use_profiles = bool(cfg.get("profiles", {}).get("enabled", True))
    thinned = sequences.reindex(prepared.rows, schema, step)
    out = None
    for target, task, name in (
        (schema.stress, "classification", "stress"),
        (schema.comfort, "regression", "comfort"),
    ):
        examples = sequences.sequence_set(thinned, cutter, target, use_profiles)
        fitted = models.fit_sequence_model(examples, task, params)
        scored = models.score_sequences(fitted, examples, task)
        if task == "classification":
            part = judge(scored, cfg, model)
        else:
            test = scored.where("split = 'test'").select("y", "p")
            part = compare.long_metrics(evaluate.regression_metrics(test), model, name)
        out = part if out is None else out.unionByName(part)
    return out


def run(
    spark: SparkSession,
    cfg: Mapping,
    frame: DataFrame | None = None,
    out: str | None = None,
    assignment: DataFrame | None = None,
) -> Outcome:
    """The whole experiment. A model that fails is reported and leaves the rest of the run intact."""
    schema = SignalSchema.from_config(cfg)
    raw = router.load(spark, cfg, schema) if frame is None else frame
    prepared = prepare(clean.typed_projection(raw, schema, **clean.time_axis(raw, schema)), schema, cfg, assignment)
    table = materialize(features_of(prepared, cfg), "features")
    balance = windows.require_windows(materialize(windows.balance(table), "balance"))
    switches = cfg.get("models", {})
    errors: list[tuple[str, str | None]] = []
    parts: list[DataFrame] = []
    fitted: dict[str, models.Fitted] = {}
    profiles_on = bool(cfg.get("profiles", {}).get("enabled", True))

    def attempt(model: str, work) -> DataFrame | None:
        try:
            done = work()
            # Metric tables are a handful of rows; keeping them ends the model's lineage.
            done = spark.createDataFrame(done.collect(), compare.LONG)
        except Exception as error:  # noqa: BLE001
            errors.append((model, str(error)))
            return None
        errors.append((model, None))
        parts.append(done)
        return done

    def trees() -> DataFrame:
        metrics, found = run_trees(table, prepared.static if profiles_on else None, schema, cfg)
        fitted.update(found)
        return metrics

    on = attempt(TREES, trees) if switches.get("run_xgb", True) else None
    if switches.get("run_tft", True):
        attempt(SEQUENCE, lambda: run_sequence(prepared, cfg))
    ablation = None
    if on is not None and prepared.static is not None:
        off_model = f"{TREES}_profiles_off"
        off = attempt(off_model, lambda: run_trees(table, None, schema, cfg, off_model)[0])
        if off is not None:
            ablation = compare.results_table(on.unionByName(off), ["auroc", "rmse"])
    empty = spark.createDataFrame([], compare.LONG)
    metrics = relate.union_all(empty, *parts)
    names = ["auroc", "auprc", "f1", "precision", "recall", "brier", "ece", "mae", "rmse", "r2"]
    outcome = Outcome(
        metrics,
        compare.winners(metrics, TREES, SEQUENCE),
        balance,
        spark.createDataFrame(errors, "model string, error string"),
        ablation,
        compare.results_table(metrics, names),
    )
    if out:
        write(prepared, table, outcome, fitted, spark, out)
    return outcome


def write(prepared: Prepared, table: DataFrame, outcome: Outcome, fitted, spark: SparkSession, out: str) -> None:
    schema = prepared.cutter.schema
    sinks.write_windows(windows.window_table(prepared.rows, prepared.cutter), f"{out}/windows")
    sinks.write_meta(table, f"{out}/meta", schema.worker)
    sinks.write_manifest(prepared.manifest, f"{out}/splits")
    sinks.write_frame(prepared.rows, f"{out}/flat")
    sinks.write_metrics(outcome.metrics, f"{out}/metrics")
    numeric = [c for c, t in prepared.rows.dtypes if t in ("double", "int") and not c.startswith("_")]
    sinks.write_metrics(stats.numeric_stats(prepared.rows, numeric), f"{out}/numeric_stats")
    profile = stats.profile_columns(prepared.rows, schema)
    sinks.write_metrics(stats.profile_stats(prepared.rows, profile), f"{out}/profile_stats")
    names = features.feature_names(table, schema.worker)
    sinks.write_metrics(stats.numeric_stats(table, names), f"{out}/feature_stats")
    sinks.write_metrics(stats.matrix_stats(table, names), f"{out}/matrix_stats")
    for target, model in fitted.items():
        sinks.write_model(model, spark, f"{out}/models/{target}")
        sinks.write_metrics(models.importance_table(spark, model, 15), f"{out}/importance/{target}")


def run_balanced(spark: SparkSession, cfg: Mapping, frame: DataFrame | None = None, out: str | None = None):
    """Assign subjects to balanced splits, check class coverage, then run and accept or reject the outcome."""
    schema = SignalSchema.from_config(cfg)
    raw = router.load(spark, cfg, schema) if frame is None else frame
    typed = clean.typed_projection(raw, schema, **clean.time_axis(raw, schema))
    rule = cfg.get("split", {})
    least = [int(rule.get(f"min_{s}_positive_windows", 20)) for s in ("val", "test")]
    load = split.worker_load(typed, schema)
    shares = [float(rule.get(f"{s}_ratio", d)) for s, d in (("train", 0.7), ("val", 0.15))]
    chosen = split.balanced_holdout(load, schema, *shares, *least)
    chosen = materialize(chosen, "assignment")
    lacking = split.uncovered(typed.join(chosen, schema.worker), schema, *least).first()
    if lacking:
        raise ValueError(f"{lacking['split']} lacks a class or enough positives")
    outcome = run(spark, cfg, raw, out, chosen)
    problem = compare.acceptance(outcome.balance, outcome.reports).first()
    if problem:
        raise RuntimeError(problem["reason"])
    return outcome
