"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of the hashes of the k-word grams in every window of w grams the least is kept. A shared span of w + k - 1 words
holds a whole window of grams, whose least hash both sides keep: no such span is missed. Benchmark windows have
13 words, so k = 5 and w = 9; a shorter item is one window of its own length m, with k = min(5, m) and
w = m - k + 1.

Fingerprints of documents and items are joined; each joined place is extended: only the windows of words around
it are compared with the items' windows, word for word. The documents' fingerprints need no exchange while
Spark finds the benchmark's table small enough to send along; beyond that both are shuffled by fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import query, stored, table

WINDOW = 13
GRAM = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; none for null."""
    found = F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(WORD), 0)
    return F.coalesce(found, F.array().cast("array<string>"))


def _folded(df: DataFrame, source: str, out: str, span: int, join) -> DataFrame:
    """Adds ``out``: the combination of each run of ``span`` neighbours of the array ``source``, by doubling.

    Every step is a column of its own, which the next one uses twice: the optimiser computes it once.
    """
    have, now = 1, source
    while have < span:
        step = min(have, span - have)
        size = F.greatest(F.size(now) - step, F.lit(0))
        df = df.withColumn(f"{out}_{have + step}", F.zip_with(F.slice(now, 1, size), F.slice(now, step + 1, size), join))
        have, now = have + step, f"{out}_{have + step}"
    return df.withColumn(out, F.col(now))


def with_grams(df: DataFrame, words: str, kind: int) -> DataFrame:
    """Adds ``_grams_<kind>``: a hash for each gram of windows of ``kind`` words.

    Doubling may join runs that overlap (5 words from two runs of 4): equal grams still have equal hashes.
    """
    hashed = df.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    return _folded(hashed, "_hashes", f"_grams_{kind}", min(GRAM, kind), lambda a, b: F.xxhash64(a, b))


def winnowed(df: DataFrame, words: str, kinds: list[int]) -> DataFrame:
    """Adds ``prints``: array<struct<kind, print>> of the distinct least gram hashes of all windows."""
    keep = df.columns
    for kind in kinds:
        df = with_grams(df, words, kind)
        df = _folded(df, f"_grams_{kind}", f"_least_{kind}", kind - min(GRAM, kind) + 1, lambda a, b: F.least(a, b))
    parts = [
        F.expr(f"transform(array_distinct(_least_{kind}), p -> struct({kind} as kind, p as print))") for kind in kinds
    ]
    return df.select(*keep, F.concat(*parts).alias("prints"))


def _spread(array) -> Column:
    """Explodes a computed array. The outer form, as Spark would put a filter with a copy of all its steps in front
    of the other one; the null row of an empty array finds no partner in the joins that follow."""
    return F.explode_outer(array)


def item_windows(items: DataFrame, item: str, text: str, window: int = WINDOW) -> DataFrame:
    """(item_id, kind, words): each item's windows as word arrays; an item under the window's length is one."""
    words = items.select(F.col(item).alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    kind = F.least(F.size("w"), F.lit(window))
    spread = words.withColumn("kind", kind).withColumn("s", F.explode(F.expr("sequence(1, size(w) - kind + 1)")))
    return spread.select("item_id", "kind", F.slice("w", F.col("s"), F.col("kind")).alias("words"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, hits, item_ids) for every row of ``docs``.

    ``hits`` are the matching windows (start and length in words), ``n_hit`` the words they cover, ``item_ids`` the
    items with a matching window, in order. Null and empty texts have no words; items without words match
    nothing, repeated rows get the same answer, and rows without an id are told apart by their text.
    """
    windows = stored(item_windows(items, item, item_text), "item-windows")
    # At most WINDOW whole numbers.
    kinds = sorted(r["kind"] for r in windows.select("kind").distinct().collect())
    base = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    words = base.withColumn("w", words_of(F.col("_text")))
    if not kinds:
        return words.select(
            "doc_id",
            "text_hash",
            F.size("w").cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_hit"),
            F.array().cast("array<struct<s:int,kind:int>>").alias("hits"),
            F.array().cast("array<string>").alias("item_ids"),
        )
    sized = words.select("doc_id", "text_hash", "w").withColumn("n_words", F.size("w").cast("long"))
    printed = stored(winnowed(sized, "w", kinds).drop("w"), "document-prints")
    item_prints = [winnowed(windows.where(F.col("kind") == k), "words", [k]).select(_spread("prints").alias("p")) for k in kinds]
    known = item_prints[0]
    for more in item_prints[1:]:
        known = known.union(more)
    known = stored(known.select("p.kind", "p.print").distinct(), "item-prints")
    met = printed.select("doc_id", "text_hash", F.explode("prints").alias("p")).select("doc_id", "text_hash", "p.*")
    met = met.join(known, ["kind", "print"]).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("kind", "print")).alias("met")
    )
    met = stored(met, "met-prints").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "met")
    same = base["doc_id"].eqNullSafe(met["_doc"]) & (base["text_hash"] == met["_hash"])
    near = base.join(met, same).select("doc_id", "text_hash", "met", words_of(F.col("_text")).alias("w"))
    starts = []
    for kind in kinds:
        near = with_grams(near, "w", kind).withColumn(
            f"_met_{kind}", F.expr(f"transform(filter(met, p -> p.kind = {kind}), p -> p.print)")
        )
        reach = kind - min(GRAM, kind)
        # A gram at i may belong to the windows that start at i - reach to i.
        starts.append(
            f"transform(array_distinct(flatten(transform(filter(transform(_grams_{kind}, (g, i) -> "
            f"if(array_contains(_met_{kind}, g), i + 1, 0)), i -> i > 0), i -> sequence(greatest(1, i - {reach}), "
            f"least(i, size(w) - {kind - 1}))))), s -> struct(s as s, {kind} as kind))"
        )
    spread = near.select("doc_id", "text_hash", "w", _spread(F.expr(f"concat({', '.join(starts)})")).alias("at"))
    spread = spread.select("doc_id", "text_hash", "at", F.expr("array_join(slice(w, at.s, at.kind), ' ')").alias("window"))
    having = windows.groupBy(F.array_join("words", " ").alias("window"), "kind").agg(
        F.collect_set(F.col("item_id").cast("string")).alias("items")
    )
    having = stored(having, "window-items")
    found = spread.join(having, (spread["window"] == having["window"]) & (spread["at.kind"] == having["kind"]))
    hits = found.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("at")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    covered = F.expr(
        "aggregate(hits, struct(0 as upto, 0L as n), (a, h) -> struct(greatest(a.upto, h.s + h.kind - 1) as upto, "
        "a.n + greatest(0, h.s + h.kind - 1 - greatest(a.upto, h.s - 1)) as n), a -> a.n)"
    )
    hits = hits.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "hits", "item_ids", covered.alias("n_hit"))
    rows = printed.select("doc_id", "text_hash", "n_words")
    same = rows["doc_id"].eqNullSafe(hits["_doc"]) & (rows["text_hash"] == hits["_hash"])
    return rows.join(hits, same, "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "hits",
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least a twentieth of the words, and one, lie in shared windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


OP1_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
it AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s
    FROM iw WHERE len(w) > 0)),
kinds AS (SELECT DISTINCT k FROM it),
dg AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, kinds WHERE len(w) >= k)),
found AS (SELECT doc_id, s, dg.k, item_id FROM dg JOIN it ON dg.k = it.k AND dg.g = it.g),
words AS (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS at FROM (SELECT DISTINCT doc_id, s, k FROM found)),
hit AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""


@query(OP1_SQL)
def op1_winnowing(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )
