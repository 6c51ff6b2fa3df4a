"""CSV readers. Values stay text; the typed projection coerces them, so no inference pass is needed."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.functions import scalar as S
from signalspark.layout import SeriesLayout, number_rows
from signalspark.operators import clean, sample
from signalspark.schema import SignalSchema
from signalspark.session import materialize

SOURCE_ORDER = ("_file", "_block_start", "_line")


def _with_order(df: DataFrame) -> DataFrame:
    """Where a row came from: file, split of the file, and rank within the split."""
    return df.select(
        *df.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block_start"),
        F.monotonically_increasing_id().alias("_line"),
    )


def header_names(line: str) -> list[str]:
    """Column names of a header line; blank and repeated ones are told apart by their place."""
    names, seen = next(csv.reader([line])), set()
    for i, name in enumerate(names):
        names[i] = name if name else f"_c{i}"
        names[i] += str(i) if names[i] in seen else ""
        seen.add(names[i])
    return names


def _fields(names: Sequence[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def scan(spark: SparkSession, path: str, with_order: bool = False) -> DataFrame:
    """All CSV files below a folder, unioned by name; files of different columns may mix.

    Each file's first line is found in the tasks and joined to its rows by the file's path; the driver sees the
    distinct header lines only, however many files there are. Rows are parsed under their own header. Files without a
    data row are left out, lines without anything are skipped. With ``with_order`` a row says where it came from and
    which columns its file has; the metadata of ``_columns`` lists the distinct sets.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    lines = _with_order(lines).where(F.trim("value") != "")
    at = F.struct("_block_start", "_line")
    first = lines.groupBy("_file").agg(F.min_by("value", at).alias("_header"), F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = materialize(first.where("_n > 1").drop("_n"), "csv-headers")
    headers = [r["_header"] for r in first.select("_header").distinct().orderBy("_header").collect()]
    if not headers:
        raise FileNotFoundError(f"no CSV rows below {path}")
    sets = [header_names(h) for h in headers]
    rows = lines.join(first, "_file").where(at != F.col("_first"))
    own = [F.col("_header") == h for h in headers]
    parsed = {
        f"_row{k}": F.when(here, F.from_csv("value", _fields(names)))
        for k, (here, names) in enumerate(zip(own, sets, strict=True))
    }
    rows = rows.withColumns(parsed)
    columns = {}
    for k, names in enumerate(sets):
        for name in names:
            columns.setdefault(name, []).append(F.col(f"_row{k}").getField(name))
    out = [F.coalesce(*values).alias(name) for name, values in columns.items()]
    if not with_order:
        return rows.select(*out)
    which = F.coalesce(*[F.when(here, F.array(*map(F.lit, names))) for here, names in zip(own, sets, strict=True)])
    return rows.select(*out, *SOURCE_ORDER, which.alias("_columns", metadata={"sets": json.dumps(sets)}))


def read_file(
    spark: SparkSession, path: str | list[str], with_order: bool = False, encoding: str = "utf-8"
) -> DataFrame:
    df = spark.read.option("header", True).option("encoding", encoding).csv(path)
    return _with_order(df) if with_order else df


def generic(spark: SparkSession, path: str, schema: SignalSchema, with_order: bool = False) -> DataFrame:
    """A single file as it is; a folder unioned, with one unnamed worker where no file names any."""
    if path.endswith(".csv"):
        return read_file(spark, path, with_order)
    df = scan(spark, path, with_order)
    return df if schema.worker in df.columns else df.withColumn(schema.worker, F.lit("0"))


def participants_overview(spark: SparkSession, path: str) -> DataFrame:
    """Availability matrix in a one-byte code page; only ids and dashes in it matter, which all of them share."""
    df = read_file(spark, path, encoding="iso-8859-1")
    return df.withColumn("ID", S.strip(F.col("ID")))


def with_file_time(df: DataFrame, schema: SignalSchema) -> DataFrame:
    """Time columns of scanned rows, for the files that lack them: rows are counted in their file, from 0.

    A missing timestamp is the time index where the file has one. Rows are counted only if some file needs it.
    """
    sets = json.loads(df.schema["_columns"].metadata["sets"]) if "_columns" in df.columns else [df.columns]

    def stated(name: str):
        if name not in df.columns:
            return F.lit(False)
        return F.array_contains("_columns", name) if "_columns" in df.columns else F.lit(True)

    def given(name: str):
        return F.when(stated(name), F.col(name)) if name in df.columns else F.lit(None).cast("string")

    columns = list(df.columns)
    if not all(schema.time_idx in names for names in sets):
        # Splits of a file come in any order, so their place in the file comes first.
        layout = SeriesLayout.fit(df, "_file", "_block_start")
        df = number_rows(df, ["_file"], ["_block_start", "_line"], layout, pos="_row", total="_rows").drop("_rows")
        counted = F.col("_row").cast("string")
    else:
        counted = F.lit(None).cast("string")
    index = F.coalesce(given(schema.time_idx), F.when(~stated(schema.time_idx), counted))
    stamp = F.coalesce(given(schema.timestamp), F.when(~stated(schema.timestamp), index))
    out = df.withColumns({"_index": index, "_stamp": stamp})
    out = out.withColumns({schema.time_idx: F.col("_index"), schema.timestamp: F.col("_stamp")})
    return out.select(*columns, *[c for c in (schema.time_idx, schema.timestamp) if c not in columns])


def subject_exports(df: DataFrame, schema: SignalSchema, include_amusement: bool = False) -> DataFrame:
    """Per-subject exports, scanned with source order, to labelled rows.

    The file name is the worker where no column is. A file's protocol is numeric if any of its values is; that
    is decided per file by an aggregate, so no file has to sit in one task.
    """
    stem = F.regexp_extract(F.col("_file"), r"([^/]+)\.csv$", 1)
    worker = F.coalesce(F.col(schema.worker), stem) if schema.worker in df.columns else stem
    df = with_file_time(df.withColumn(schema.worker, S.subject_id(worker)), schema)
    if schema.protocol not in df.columns:
        if not {schema.stress, schema.comfort} <= set(df.columns):
            raise ValueError(f"exports need '{schema.protocol}' or both targets")
        df = df.withColumn(schema.protocol, F.lit("unknown"))
    else:
        code = S.number(F.col(schema.protocol), text=True)
        per_file = df.groupBy("_file").agg(F.max(code.isNotNull()).alias("_numeric"))
        df = df.join(per_file, "_file")
        numeric = S.protocol_columns(code, include_amusement, names=False)
        named = S.protocol_columns(F.lower(F.col(schema.protocol)), include_amusement, names=True)
        own = {
            part: clean.as_number(df, column) if column in df.columns else F.lit(None).cast("double")
            for part, column in (("stress", schema.stress), ("comfort", schema.comfort))
        }
        given = F.col(schema.protocol).isNotNull() | F.col("_numeric")

        def pick(part: str):
            recoded = F.when(F.col("_numeric"), numeric[part]).otherwise(named[part])
            return recoded if part == "name" else F.when(given, recoded).otherwise(own[part])

        df = df.withColumns(
            {schema.stress: pick("stress"), schema.comfort: pick("comfort"), "_name": pick("name")}
        )
        df = df.withColumn(schema.protocol, F.coalesce("_name", F.lit("unknown"))).drop("_name", "_numeric")
    return clean.has_targets(df, schema)


def subject_dataset(
    df: DataFrame,
    schema: SignalSchema,
    layout: SeriesLayout,
    subjects: Sequence[str] | None = None,
    max_rows: int | None = None,
    downsample: int | None = None,
) -> DataFrame:
    """Labelled subject rows thinned by stride, then by an even cap, with context defaults.

    The subject filter comes first: it picks whole series, so it commutes with the thinning and saves work.
    """
    if subjects:
        wanted = {s.strip() for s in subjects}
        normal = [f"S{s[1:] if s[:1] in 'sS' else s}" for s in wanted]
        df = clean.require_rows(clean.allow(df, schema.worker, normal), "the subject filter")
    order = [c for c in (schema.time_idx, *SOURCE_ORDER) if c in df.columns]
    df = df.withColumn(schema.time_idx, clean.as_number(df, schema.time_idx).cast("int"))
    df = sample.stride(df, [schema.worker], order, downsample or 1, layout)
    df = sample.cap(df, [schema.worker], order, max_rows, layout)
    defaults = {c: F.lit(0.0) for c in schema.context} | {schema.hazard: F.lit(0), schema.phase: F.lit("default")}
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def subject_folders(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted ``S<digits>`` folders, and the wanted ids that no folder has."""
    folder = F.regexp_extract(F.lower(F.col("_file")), r"/(s\d+)/", 1)
    tagged = df.withColumn("subject", S.strict_subject_id(F.when(folder != "", folder)))
    asked = df.sparkSession.createDataFrame([(w,) for w in wanted], "raw string").select(
        S.strict_subject_id(F.col("raw")).alias("subject")
    )
    rows = tagged.join(F.broadcast(asked.distinct()), "subject", "left_semi")
    lost = asked.distinct().join(tagged.select("subject").distinct(), "subject", "left_anti")
    return rows, lost
