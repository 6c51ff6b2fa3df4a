"""Ranked lexical search over a length-stratified index.

Documents with the same length normaliser m form a stratum. A term's postings are kept by its count tf within the
stratum, so the impact of (tf, m) is worked out once for all documents that share it. A stratum is cut into blocks
of bounded size, of which Spark holds one a row; however many documents share an m, a task sees one block at a time.

For a set of query items each stratum has a bound: the best that a document with the largest counts seen in one of
its blocks could score. An item visits strata from the highest bound down, more of them in each round, and leaves
out those whose bound is under the score of its last place so far. A round is told to the tasks as two bounds per
item, between which a block's own bound must lie; so blocks are read where they are and never shuffled. Nothing is
lost: the results are those of scoring all documents.

Query items are handled in blocks of about ``QUERY_BYTES`` of terms, which bounds what is sent to every task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.common import query, release, stored, table, text_slices

#: Terms: runs of digits, letters and all beyond ASCII. On UTF-8 bytes, after lower-casing A-Z.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Postings of one block; a document of more is a block of its own.
BLOCK_POSTINGS = 1 << 17
#: Bytes of query terms that are searched for together.
QUERY_BYTES = 1 << 20
#: Cells of items x documents, and postings, that are scored at once.
CELLS = 1 << 21
#: Strata that an item visits in the first round; each further round reaches this many times as far.
FIRST_STRATA = 16
#: Stands for a document without an id, which comes first among equal scores.
NO_ID = -(1 << 63)

BLOCK_SCHEMA = (
    "m long, doc_ids array<long>, terms array<binary>, sizes array<int>, max_tf array<int>, "
    "run_term array<int>, run_tf array<int>, run_size array<int>, docs array<int>"
)


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n, terms, tfs): each text's terms with repeats, the distinct ones and their counts."""
    for batch in batches:
        ids, at = batch.column(0), 0
        for raws in text_slices(batch.column(1)):
            counts = [Counter(TERM.findall(raw.lower())) for raw in raws]
            ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
            terms = pa.array(chain.from_iterable(counts), pa.binary())
            tfs = pa.array(np.fromiter(chain.from_iterable(c.values() for c in counts), np.int32, int(ends[-1])))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, len(raws)),
                    pa.array([c.total() for c in counts], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), terms),
                    pa.ListArray.from_arrays(pa.array(ends), tfs),
                ],
                names=["id", "n", "terms", "tfs"],
            )
            at += len(raws)
    release()


@dataclass(frozen=True)
class Index:
    """``blocks`` as in BLOCK_SCHEMA; ``documents`` with a term, and all their ``words`` with repeats."""

    blocks: DataFrame
    documents: int
    words: int


def _block(m: int, rows: list[tuple]) -> list:
    """One block's columns: postings by term, then by tf."""
    terms = pa.concat_arrays([t for _, t, _ in rows]).dictionary_encode()
    code = terms.indices.to_numpy(zero_copy_only=False)
    tf = np.concatenate([f for _, _, f in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for _, _, f in rows])
    order = np.lexsort((doc, tf, code))
    code, tf, doc = code[order], tf[order], doc[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])])
    sizes = np.bincount(code, minlength=len(terms.dictionary))
    largest = tf[np.cumsum(sizes) - 1]
    runs = np.diff(np.r_[first, len(code)])
    ids = [NO_ID if d is None else d for d, _, _ in rows]
    return [m, ids, terms.dictionary, sizes, largest, code[first], tf[first], runs, doc]


def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, part, id, terms, tfs) in the order of (m, part) to blocks of about BLOCK_POSTINGS postings."""
    schema = pa.schema(
        [("m", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary()))]
        + [(c, pa.list_(pa.int32())) for c in ("sizes", "max_tf", "run_term", "run_tf", "run_size", "docs")]
    )

    def packed(key, rows):
        block = _block(key[0], rows)
        columns = [pa.array([block[0]], pa.int64())]
        for values, field in zip(block[1:], list(schema)[1:], strict=True):
            flat = values if isinstance(values, pa.Array) else pa.array(values, field.type.value_type)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    key, rows, held = None, [], 0
    for batch in batches:
        ms, parts, ids = (batch.column(i).to_pylist() for i in range(3))
        terms, tfs = batch.column(3), batch.column(4)
        for i, now in enumerate(zip(ms, parts, strict=True)):
            size = len(terms[i])
            if rows and (now != key or held + size > BLOCK_POSTINGS):
                yield packed(key, rows)
                rows, held = [], 0
            key = now
            rows.append((ids[i], terms[i].values, tfs[i].values.to_numpy(zero_copy_only=False)))
            held += size
    if rows:
        yield packed(key, rows)
    release()


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> Index:
    """Index of all rows of ``docs``; ``doc`` is a whole number.

    A null or empty text, or one without terms, is in no stratum. Rows that repeat are documents of their own. No
    other column is read. An empty table gives an index without blocks. Texts of any length are whole; two numbers
    reach the driver.
    """
    rows = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(term_counts, "id long, n long, terms array<binary>, tfs array<int>").where("n > 0")
    counted = stored(counted.withColumn("row", F.monotonically_increasing_id()), "term-counts")
    whole = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("words")).first()
    n, words = whole["n"], whole["words"] or 0
    # 90 * n * N may pass 64 bits, so it is multiplied as a decimal.
    m = f"10 + (90 * cast(n as decimal(20, 0)) * cast({n} as decimal(15, 0))) div cast({max(words, 1)} as decimal(20, 0))"
    placed = counted.withColumn("m", F.expr(m).cast("long"))
    parts = placed.groupBy("m").agg(F.ceil(F.sum(F.size("terms")) / BLOCK_POSTINGS).alias("parts"))
    cut = placed.join(stored(parts, "strata"), "m").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    ordered = cut.select("m", "part", "id", "terms", "tfs").repartition("m", "part").sortWithinPartitions("m", "part")
    return Index(stored(ordered.mapInArrow(cut_blocks, BLOCK_SCHEMA), "blocks"), n, words)


@dataclass(frozen=True)
class QueryBlock:
    """Items and their terms as numbers: pair p says that item ``item[p]`` holds term ``term[p]``, by item."""

    numbers: list[int]
    vocabulary: pa.Array
    item: np.ndarray
    term: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(rows: list) -> QueryBlock:
        vocabulary = sorted({bytes(t) for r in rows for t in r["terms"]})
        place = {t: k for k, t in enumerate(vocabulary)}
        item = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
        term = np.fromiter((place[bytes(t)] for r in rows for t in r["terms"]), np.int64, len(item))
        numbers = [r["number"] for r in rows]
        return QueryBlock(numbers, pa.array(vocabulary, pa.binary()), item, term, np.zeros(len(vocabulary), np.int64))

    def places(self, terms: pa.Array) -> np.ndarray:
        """Number of each term in the vocabulary, or -1."""
        return pc.fill_null(pc.index_in(terms, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """Impact of each count in stratum m, worked out once per distinct count."""
    counts, at = np.unique(tf.astype(np.int64), return_inverse=True)
    return (1_000_000_000 * counts // (1000 * counts + 8 * m))[at]


def document_frequencies(index: Index, asked: QueryBlock) -> np.ndarray:
    """Documents holding each term of the vocabulary; a number per term and task is summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.vocabulary), np.int64)
        for batch in batches:
            at = asked.places(batch.column(0).flatten())
            np.add.at(total, at[at >= 0], batch.column(1).flatten().to_numpy(zero_copy_only=False)[at >= 0])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["term", "n"])

    df = np.zeros(len(asked.vocabulary), np.int64)
    counted = index.blocks.select("terms", "sizes").mapInArrow(count, "term long, n long")
    for row in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[row["term"]] = row["n"]
    return df


def block_bounds(asked: QueryBlock, m: int, places: np.ndarray, max_tf: np.ndarray) -> np.ndarray:
    """What a document of the block could score for each item at most."""
    best = np.zeros(len(asked.vocabulary), np.int64)
    known = places >= 0
    best[places[known]] = asked.weights[places[known]] * impacts(max_tf[known], m)
    bounds = np.zeros(len(asked.numbers), np.int64)
    np.add.at(bounds, asked.item, best[asked.term])
    return bounds


def _row_values(batch: pa.RecordBatch, i: int, name: str) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def stratum_bounds(index: Index, asked: QueryBlock) -> DataFrame:
    """(m, item, bound) of all strata in which an item may score above 0."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, m in enumerate(batch.column("m").to_pylist()):
                own = block_bounds(asked, m, asked.places(batch.column("terms")[i].values), _row_values(batch, i, "max_tf"))
                best[m] = np.maximum(best[m], own) if m in best else own
                if len(best) * len(own) >= CELLS:
                    yield from told(best)
                    best = {}
        yield from told(best)

    def told(best: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for m, own in best.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), m)), pa.array(some), pa.array(own[some])], names=["m", "item", "bound"]
            )

    found = index.blocks.select("m", "terms", "max_tf").mapInArrow(bound, "m long, item long, bound long")
    return found.groupBy("m", "item").agg(F.max("bound").alias("bound"))


class _Leaders:
    """The best ``top`` documents of each item that a task has met."""

    def __init__(self, top: int, floor: np.ndarray):
        self.top, self.floor, self.found = top, floor.copy(), {}

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        some = np.flatnonzero(scores >= max(1, self.floor[item]))
        if len(some) > self.top:
            least = np.partition(scores[some], -self.top)[-self.top]
            some = some[scores[some] >= least]
        if not len(some):
            return
        old = self.found.get(item)
        scores, ids = scores[some], ids[some]
        if old is not None:
            scores, ids = np.r_[old[0], scores], np.r_[old[1], ids]
        order = np.lexsort((ids, -scores))[: self.top]
        self.found[item] = scores[order], ids[order]
        if len(order) == self.top:
            self.floor[item] = max(self.floor[item], scores[order[-1]])


def score_blocks(asked: QueryBlock, floor: np.ndarray, low: np.ndarray, high: np.ndarray, top: int) -> Callable:
    """Scores the items that visit a block against its documents; each task returns its best ones per item.

    An item visits the blocks whose bound is at least ``low``, under ``high``, and not under its last place's score.
    """
    pairs = np.searchsorted(asked.item, np.arange(len(asked.numbers) + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = _Leaders(top, floor)
        for batch in batches:
            for i, m in enumerate(batch.column("m").to_pylist()):
                places = asked.places(batch.column("terms")[i].values)
                bounds = block_bounds(asked, m, places, _row_values(batch, i, "max_tf"))
                visit = np.flatnonzero((bounds >= np.maximum(low, leaders.floor)) & (bounds < high))
                if not len(visit):
                    continue
                ids, docs = _row_values(batch, i, "doc_ids"), _row_values(batch, i, "docs")
                run_place = places[_row_values(batch, i, "run_term")]
                gain = np.where(run_place >= 0, asked.weights[run_place], 0) * impacts(_row_values(batch, i, "run_tf"), m)
                gain = np.repeat(gain, _row_values(batch, i, "run_size"))
                sizes = _row_values(batch, i, "sizes")
                own = np.full(len(asked.vocabulary), -1)
                own[places[places >= 0]] = np.flatnonzero(places >= 0)
                starts = np.r_[0, np.cumsum(sizes)]
                # Items go together as far as their cells and postings fit in CELLS, one at least.
                cost = np.array([len(ids) + sizes[own[t][own[t] >= 0]].sum() for t in (asked.term[pairs[v] : pairs[v + 1]] for v in visit)])
                for some in np.split(visit, np.flatnonzero(np.diff(np.cumsum(cost) // CELLS)) + 1):
                    held = [own[asked.term[pairs[v] : pairs[v + 1]]] for v in some]
                    line = np.repeat(np.arange(len(some)), [len(h) for h in held])
                    term = np.concatenate(held)
                    line, term = line[term >= 0], term[term >= 0]
                    length = sizes[term]
                    ends = np.cumsum(length)
                    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[term] - (ends - length), length)
                    scores = np.zeros(len(some) * len(ids), np.int64)
                    np.add.at(scores, np.repeat(line * len(ids), length) + docs[at], gain[at])
                    for item, row in zip(some.tolist(), scores.reshape(len(some), len(ids)), strict=True):
                        leaders.add(item, row, ids)
        for item, (scores, ids) in leaders.found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(scores)], names=["item", "doc_id", "score"]
            )
        release()

    return score


def _search_block(index: Index, asked: QueryBlock, top: int) -> DataFrame:
    """(number, doc_id, score, place) of the best documents of a block's items."""
    spark = index.blocks.sparkSession
    df = document_frequencies(index, asked)
    weights = np.floor(1000 * np.log((2 * index.documents + 2) / (2 * df + 1))).astype(np.int64)
    asked = QueryBlock(asked.numbers, asked.vocabulary, asked.item, asked.term, np.where(df > 0, weights, 0))
    ranked = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    bounds = stored(stratum_bounds(index, asked).withColumn("place", F.row_number().over(ranked)), "stratum-bounds")
    furthest = bounds.agg(F.max("place")).first()[0] or 0
    best = spark.createDataFrame([], "item long, doc_id long, score long, place int")
    floor, high, reached = np.zeros(len(asked.numbers), np.int64), np.full(len(asked.numbers), np.iinfo(np.int64).max), 0
    while reached < furthest:
        reach = min(furthest, max(FIRST_STRATA, reached * FIRST_STRATA))
        # At most one number per item of the block; an item with no stratum at this place visits all that are left.
        low = np.ones(len(asked.numbers), np.int64)
        if reach < furthest:
            for row in bounds.where(F.col("place") == reach).collect():
                low[row["item"]] = row["bound"]
        scored = score_blocks(asked, floor, low, high, top)
        found = index.blocks.mapInArrow(scored, "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        both = best.select("item", "doc_id", "score").unionByName(found)
        best = stored(both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top), "leaders")
        # At most one number per item of the block.
        for row in best.where(F.col("place") == top).collect():
            floor[row["item"]] = row["score"]
        high, reached = low, reach
        if (floor >= high).all():
            break
    names = spark.createDataFrame([(k, n) for k, n in enumerate(asked.numbers)], "item long, number long")
    return best.join(F.broadcast(names), "item").select("number", "doc_id", "score", "place")


def search(index: Index, items: DataFrame, item: str = "item_id", text: str = "text", top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0, highest first.

    Equal scores go by doc_id, one without id first. Rows of one item_id are one item with the terms of all; a null
    item_id is an item as well. An item without text or terms, or whose terms no document holds, has no rows, and so
    has every item on an empty index. Other columns are not read.
    """
    asked = items.select(F.col(item).alias("item_id"), F.col(text).alias("text"))
    listed = asked.mapInArrow(term_counts, f"id {asked.schema['item_id'].dataType.simpleString()}, n long, terms array<binary>, tfs array<int>")
    each = listed.select("id", F.explode("terms").alias("term")).groupBy("id").agg(F.collect_set("term").alias("terms"))
    each = stored(each.withColumn("number", F.monotonically_increasing_id()), "items")
    size = each.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t) + 16))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    found = None
    for k in range(blocks):
        mine = each.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == k).select("number", "terms").collect()
        if mine:
            own = _search_block(index, QueryBlock.of(mine), top)
            found = own if found is None else found.unionByName(own)
    if found is None:
        return each.where("false").selectExpr("id as item_id", "1 as rank", "0L as doc_id", "0L as score")
    named = found.join(each.select("number", "id"), "number")
    doc = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return named.select(F.col("id").alias("item_id"), F.col("place").alias("rank"), doc.alias("doc_id"), "score")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
whole AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
v AS (
  SELECT t, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, whole GROUP BY t, n),
m AS (SELECT doc_id, 100 - 90 + ((90 * len(w)::BIGINT * n) // l) AS m FROM d, whole WHERE len(w) > 0),
s AS (
  SELECT item_id, doc_id, sum(v.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM i JOIN p ON p.t = i.t JOIN v ON v.t = i.t JOIN m USING (doc_id) GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@query(OP11_SQL)
def op11_stratified_search(spark, sf_dir):
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
