"""N-gram Jaccard join with rare-first prefix filtering.

A document is the set of its word shingles, as 64-bit hashes; documents with one set are one *class* from the
start. Blocks of documents ask a sharded table (``blocks.ask``) in how many documents each of their shingles
occurs. A shingle of one document can't be matched; such shingles come first in the rare-first order. So a class
whose own shingles fill its prefix is done, and only the others go on, with their list of shared shingles:

* *prefix*: similar classes share a shingle among the first ``n - ceil(t n) + 1`` of the rare-first order;
* *length*: a class can't reach the threshold with one of less than ``t`` times its size;
* *position*: what follows the shared prefix shingle in both must still hold the overlap that is needed;
* *suffix*: shared shingles are tallied by hash, and the sum of the smaller tallies bounds the overlap; so do the
  parities of finer tallies: each that differs stands for a shingle that only one of the two has.

Pairs that pass are verified once, by the lists of shared shingles (all that two classes can have in common is
in them). Only components are asked for, so pairs are not enumerated within them: each class is compared with a few
heads of its prefix lists, the links found are closed to components, and this is repeated with other heads while the
pairs across components are many and fall. Then all of these that are left are compared. A large group of copies so
costs a few comparisons per copy, and no link between different components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from signalspark.llm import blocks as B
from signalspark.llm.common import query, release, stored, table
from signalspark.llm.components import connected

WORDS = 5
#: Similar from 75 of 100 on.
PERCENT = 75
BINS = 16
#: 64-bit words of parities.
PARITY_WORDS = 4
#: 64-bit words of parities in the comparison of all pairs left, where rows are few.
WIDE_WORDS = 32
#: Tokens before its own that a row of that comparison knows.
TOKENS_BEFORE = 16
#: Heads of one token's list in one round.
HEADS = 4
#: Bytes of text for each shingle, about; only the layout of the exchange depends on it.
SHINGLE_BYTES = 6

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text in ascending order, and the size of each set."""
    import pandas as pd

    split = [text.translate(_LOWER).split() for text in texts]
    sizes = np.array([len(words) for words in split], np.int64)
    flat = np.array([w for words in split for w in words], dtype=object)
    codes, distinct = pd.factorize(flat)
    hashes = pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False) if len(flat) else np.zeros(0, np.uint64)
    words = _mix(hashes.astype(np.uint64))[codes]
    # Shingle starts: all full windows, and the first word of a shorter text, whose window is the whole text.
    begins = np.cumsum(sizes) - sizes
    windows = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(texts)), windows)
    start = begins[owner] + np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]
    length = np.minimum(width, sizes[owner])
    value = np.zeros(len(owner), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        value = np.where(length > k, (value ^ padded[start + k]) * _MULTIPLIER + np.uint64(k + 1), value)
    value = _mix(value + length.astype(np.uint64))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[fresh], np.bincount(owner[fresh], minlength=len(texts))


def _class_ids(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set, from two sums over its mixed members and its size."""
    ends = np.cumsum(sizes)
    zero = np.zeros(1, np.uint64)
    total = np.concatenate([zero, np.cumsum(_mix(values ^ _MULTIPLIER), dtype=np.uint64)])
    other = np.concatenate([zero, np.cumsum(_mix(values + _MULTIPLIER), dtype=np.uint64)])
    sums, more = total[ends] - total[ends - sizes], other[ends] - other[ends - sizes]
    return _mix(sums ^ _mix(more + sizes.astype(np.uint64))).view(np.int64)


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap with any set that reaches the threshold."""
    return -(-n * percent // 100)


def _block_keys(width: int, key_bits: int) -> B.KeysOf:
    """A block's distinct shingles, cut to the bits that tell them apart, and the number of its sets with each."""
    drop = np.uint64(64 - key_bits)

    def keys_of(texts, ids):
        keys, counts = np.unique(shingle_sets(texts, width)[0] >> drop, return_counts=True)
        return keys, counts.astype(np.uint64)

    return keys_of


def _add_counts(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    starts = B.first_of_equals(keys)
    sums = np.add.reduceat(numbers, starts) if len(keys) else numbers
    sizes = np.diff(np.append(starts, len(keys)))
    return np.repeat(np.minimum(sums, np.uint64(0xFFFFFFFF)).astype(np.uint32), sizes)


SETS = "doc_id long, n_shingles long, class long, shared binary"


def _rare_first(width: int, key_bits: int, percent: int):
    """Rows of all documents of a block; those with a prefix to match carry their shared shingles, rarest first."""
    drop = np.uint64(64 - key_bits)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts = B.open_block(row["ids"], row["sizes"], row["texts"])
                values, sizes = shingle_sets(texts, width)
                counts = B.read_answers(row["answers"])[B.places(values >> drop)]
                owner = np.repeat(np.arange(len(texts)), sizes)
                at = np.flatnonzero(counts > 1)
                at = at[np.lexsort((values[at], counts[at], owner[at]))]
                many = np.bincount(owner[at], minlength=len(texts))
                ends = np.cumsum(many)
                alone = sizes - many
                goes_on = (many > 0) & (alone < sizes - _least_overlap(sizes, percent) + 1)
                classes = _class_ids(values, sizes)
                shared = [None] * len(texts)
                for k in np.flatnonzero(goes_on).tolist():
                    shared[k] = values[at[ends[k] - many[k] : ends[k]]].tobytes()
                yield pa.record_batch(
                    {
                        "doc_id": pa.array([None if i == B.NO_ID else i for i in ids.tolist()], pa.int64()),
                        "n_shingles": pa.array(sizes, pa.int64()),
                        "class": pa.array(classes, pa.int64()),
                        "shared": pa.array(shared, pa.binary()),
                    }
                )
        release()

    return run


PREFIX = "token long, class long, n long, alone long, place long, bins array<int>, " + ", ".join(
    f"odd{k} long" for k in range(PARITY_WORDS)
)


def _parities(own: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """Whether the number of members is odd, for 64 x ``words`` bins by hash, as 64-bit words."""
    bins = np.bincount((own >> np.uint64(8)) % np.uint64(64 * words), minlength=64 * words)
    return np.packbits((bins & 1).astype(np.uint8)).view(np.int64)


def _wide_parities(batches):
    """(class, wide) of each set: the parities of many bins, which few but similar sets pass."""
    for batch in batches:
        own = [_parities(np.frombuffer(raw.as_py(), np.uint64), WIDE_WORDS) for raw in batch.column("shared")]
        wide = pa.array([words.tolist() for words in own], pa.list_(pa.int64()))
        yield pa.record_batch({"class": batch.column("class"), "wide": wide})
    release()


def _least_sum(x: str, y: str, percent: int) -> Column:
    """What two sets that reach the threshold have in common at least."""
    return F.ceil((F.col(f"{x}.n") + F.col(f"{y}.n")) * percent / (100.0 + percent) - 1e-9)


def _prefixes(percent: int):
    """(token, class, n, alone, place, tallies) of each prefix shingle; place counts the shingles before it in the
    order, alone those of them that no other document has."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, own = row["n"], np.frombuffer(row["shared"], np.uint64)
                alone = n - len(own)
                length = n - int(_least_overlap(np.int64(n), percent)) + 1 - alone
                tokens = own[:length].view(np.int64)
                bins = np.bincount((own & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS).tolist()
                m = len(tokens)
                yield pa.record_batch(
                    {
                        "token": pa.array(tokens, pa.int64()),
                        "class": pa.array([row["class"]] * m, pa.int64()),
                        "n": pa.array([n] * m, pa.int64()),
                        "alone": pa.array([alone] * m, pa.int64()),
                        "place": pa.array(np.arange(alone, alone + m), pa.int64()),
                        "bins": pa.array([bins] * m, pa.list_(pa.int32())),
                    }
                    | {f"odd{k}": pa.array([word] * m, pa.int64()) for k, word in enumerate(_parities(own).tolist())}
                )
        release()

    return run


def _possible(x: str, y: str, percent: int) -> Column:
    """The length, positional and suffix filters for two prefix rows with one token."""
    nx, ny, px, py, ax, ay = (F.col(f"{s}.{c}") for c in ("n", "place", "alone") for s in (x, y))
    need = _least_sum(x, y, percent)
    length = (100 * F.least(nx, ny)) >= percent * F.greatest(nx, ny)
    # Both lists are in one order, so what they share besides the token comes before it in both or after it.
    position = F.least(px - ax, py - ay) + 1 + F.least(nx - px - 1, ny - py - 1) >= need
    apart = sum((F.bit_count(F.col(f"{x}.odd{k}").bitwiseXOR(F.col(f"{y}.odd{k}"))) for k in range(PARITY_WORDS)), F.lit(0))
    parity = (nx - ax) + (ny - ay) - apart >= 2 * need
    smaller = F.zip_with(F.col(f"{x}.bins"), F.col(f"{y}.bins"), lambda a, b: F.least(a, b))
    suffix = F.aggregate(smaller, F.lit(0), lambda total, one: total + one) >= need
    return length & position & parity & suffix


def _to_heads(placed: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of a class and a head of one of its tokens, of different components, that pass the filters.

    In even turns the heads of a token are the first classes of its list in HEADS orders, drawn anew each turn; a class
    asks one of them for each token. The orders are those of all tokens, so that lists of one membership have the same
    heads and a class of a large group meets HEADS others, not one for each token. In odd turns the head is the class
    with the fewest shingles rarer than the token: the middle of a group of near copies, to which those copies are
    similar that have changed too much to be similar to most.
    """
    names = ["class", "component", "n", "alone", "place", "bins", *(f"odd{k}" for k in range(PARITY_WORDS))]
    part = F.pmod(F.col("token"), F.lit(HEADS))
    drawn = F.xxhash64("class", part, F.lit(turn))
    order = F.struct(F.col("place") if turn % 2 else F.lit(0).cast("long"), drawn)
    first = F.min(F.struct(order.alias("order"), *names)).alias("h")
    heads = placed.groupBy("token").agg(first).select("token", *[f"h.{c}" for c in names])
    x, y = placed.alias("x"), heads.alias("y")
    apart = F.col("x.component") != F.col("y.component")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & _possible("x", "y", percent))
    return pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))


def _across(prefix: DataFrame, links: DataFrame | None) -> DataFrame:
    """The prefix rows of tokens that several components have, with the component that the links give the class."""
    placed = prefix.withColumn("component", F.col("class"))
    if links is not None:
        named = stored(connected(links), "components").select(F.col("node").alias("class"), F.col("component").alias("found"))
        placed = prefix.join(named, "class", "left").withColumn("component", F.coalesce("found", "class")).drop("found")
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return stored(placed.join(mixed.select("token"), "token", "left_semi"), "across")


def _pairs_left(across: DataFrame) -> tuple[int, float]:
    """Rows, and pairs of rows with one token and different components (one row reaches the driver)."""
    cells = across.groupBy("token", "component").agg(F.count(F.lit(1)).cast("double").alias("n"))
    lists = cells.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
    row = lists.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("within")) / 2)).first()
    return int(row[0] or 0), row[1] or 0.0


def _all_left(across: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of all classes of different components that share a token and pass the filters.

    Similar classes pass at every token that they share, so a pair is left out where both rows know of an earlier one:
    it comes once or a few times, not once for each token. Many bins of parities leave few pairs but those that link.
    """
    before = Window.partitionBy("class").orderBy("place").rowsBetween(-TOKENS_BEFORE, -1)
    wide = sets.join(across.select("class").distinct(), "class", "left_semi").select("class", "shared")
    wide = wide.mapInArrow(_wide_parities, "class long, wide array<long>")
    rows = across.withColumn("before", F.collect_list("token").over(before)).join(wide, "class")
    rows = stored(rows, "pairs-left")
    x, y = rows.alias("x"), rows.alias("y")
    apart = F.col("x.component") < F.col("y.component")
    odd = F.zip_with("x.wide", "y.wide", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differ = F.aggregate(odd, F.lit(0), lambda total, one: total + one)
    shared = sum(F.col(f"{s}.n") - F.col(f"{s}.alone") for s in ("x", "y"))
    near = shared - differ >= 2 * _least_sum("x", "y", percent)
    fresh = ~F.arrays_overlap("x.before", "y.before")
    same = F.col("x.token") == F.col("y.token")
    pairs = x.join(y, same & apart & _possible("x", "y", percent) & fresh & near)
    return pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))


def _links(prefix: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join exactly the classes which all links together join.

    Rounds of heads go on while the pairs left are more than the rows and, once both kinds of heads were asked, the
    round before took off a fifth of them; every pair left then is compared.
    """
    across, links, turn = _across(prefix, None), None, 0
    rows, left = _pairs_left(across)
    while turn == 0 or (left > rows and (turn == 1 or left <= 0.8 * before)):
        found = _verified(_to_heads(across, percent, turn), sets, percent)
        links = stored(found if links is None else links.unionByName(found), "head-links")
        across, before, turn = _across(prefix, links), left, turn + 1
        rows, left = _pairs_left(across)
    rest = _all_left(across, sets, percent)
    return stored(links.unionByName(_verified(rest, sets, percent)).distinct(), "links")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold; each distinct pair is looked at once."""

    @arrow_udf("long")
    def common(xs: pa.Array, ys: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(xs, ys, strict=True):
            one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            found.append(len(np.intersect1d(one, two, assume_unique=True)))
        return pa.array(found, pa.int64())

    x = sets.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("x"))
    y = sets.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("y"))
    both = pairs.select("a", "b").distinct().join(x, "a").join(y, "b")
    sized = both.withColumn("common", common("x", "y")).select("a", "b", "n_a", "n_b", "common")
    return sized.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_name: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row; components are named by their smallest document.

    Null, empty and blank texts have no shingles and stay alone; so do rows without an id, whose component is
    null. Rows with equal texts are in one component. ``n_links`` counts the links found between different sets,
    enough to connect the component.
    """
    stock = B.to_blocks(docs, id_name, text)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    expected = max(1, total // SHINGLE_BYTES)
    key_bits = min(64, expected.bit_length() + 21)
    keys_of = _block_keys(width, key_bits)
    step = (1 << key_bits) / max(B.LEAST_RANGES, -(-expected // B.RANGE_KEYS))
    cuts = np.array([int(step * k) for k in range(1, round((1 << key_bits) / step))], np.uint64)  # hashes are even
    answers = B.ask(stock, keys_of, _add_counts, cuts, "shingle-counts")
    rows = stored(
        stock.join(answers, "block_id", "left").mapInArrow(_rare_first(width, key_bits, percent), SETS), "shingle-sets"
    )
    heads = rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("head"))
    going = rows.where("shared is not null").groupBy("class")
    sets = stored(going.agg(F.first("n_shingles").alias("n"), F.first("shared").alias("shared")), "shared-sets")
    prefix = stored(sets.mapInArrow(_prefixes(percent), PREFIX), "prefixes")
    links = _links(prefix, sets, percent)
    joined = connected(links).select(F.col("node").alias("class"), "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    classes = heads.join(joined, "class", "left").join(degree, "class", "left")
    classes = classes.withColumn("component", F.coalesce("component", "class"))
    least = classes.groupBy("component").agg(F.min("head").alias("component_id"))
    known = stored(classes.join(least, "component").select("class", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    named_rows = rows.drop("shared").join(known, "class", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return named_rows.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


OP4_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sized AS (SELECT doc_id, len(s) AS n FROM sets),
flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sized UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a)
SELECT doc_id, n AS n_shingles, min(reach.b) AS component_id FROM sized JOIN reach ON reach.a = doc_id
GROUP BY doc_id, n
"""


@query(OP4_SQL)
def op4_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
