"""Sharding by a k-d tree over metadata.

Every row has a point of metadata that follows from its text alone, so equal texts have one point and stay
together. A cell is split at the weighted median (weights are bytes) along the dimension in which it is widest,
until the cells reach the target size; cells are shards. Medians are found by three rounds of weighted histograms
with a fixed number of bins, pre-aggregated in the tasks: the first over the dimension's value, the others, inside
the median's bin, over the upper and lower half of a hash of the text, so that a value shared by any number of rows
can be cut too. A text whose copies alone exceed the target is dealt by document instead; there are at most as many
such texts as shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.common import query, stored, table

SHARDS = 16
BINS = 1 << 16
#: Bits of the hash that orders the rows of one value.
TIE_BITS = 30
#: Texts whose copies hold this part of a shard are placed first.
HEAVY = 64
#: Rows numbered in one task.
PIECE_ROWS = 200_000
DIMENSIONS = ("d_size", "d_letters", "d_lines", "d_words", "d_digits")


@dataclass(frozen=True)
class Split:
    """Rows of ``cell`` with (dimension, hash) below (value, hash) go left, the others right."""

    cell: int
    dimension: str
    value: int
    hash: int


def metadata(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, text_key, dimensions): each dimension a whole number from 0 to BINS - 1.

    A null text counts as the empty one. The dimensions are the logarithms of the size, of the bytes per line and of
    the bytes per word, and the shares of bytes beyond ASCII and of digits.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc).alias("doc_id"), raw.alias("_t")).select(
        "doc_id",
        (F.octet_length("_t") + 1).cast("long").alias("size"),
        F.crc32(F.col("_t").cast("binary")).alias("text_crc32"),
        F.xxhash64("_t").alias("text_key"),
        F.char_length("_t").alias("_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", "\n", "")) + 1).alias("_lines"),
        (F.char_length("_t") - F.char_length(F.translate("_t", " \t\r\n", "")) + 1).alias("_words"),
        (F.char_length("_t") - F.char_length(F.translate("_t", "0123456789", ""))).alias("_digits"),
    )
    scaled = {
        "d_size": F.log2("size") / 48,
        "d_letters": (F.col("size") - F.col("_chars") - 1) / F.col("size") / 0.75,
        "d_lines": F.log2(F.col("size") / F.col("_lines") + 1) / 48,
        "d_words": F.log2(F.col("size") / F.col("_words") + 1) / 48,
        "d_digits": F.col("_digits") / F.col("size"),
    }
    limits = {
        name: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(value * BINS))).cast("int")
        for name, value in scaled.items()
    }
    return base.withColumns(limits).drop("_chars", "_lines", "_words", "_digits")


def _below(split: Split) -> Column:
    dimension = F.col(split.dimension)
    return (dimension < split.value) | (dimension == split.value) & (F.col("tie") < split.hash)


def _placed(rows: DataFrame, splits: list[Split]) -> DataFrame:
    """Adds ``cell``: 1 for the root, 2c and 2c + 1 for the halves of c."""
    at = {split.cell: split for split in splits}

    def inside(cell: int) -> Column:
        if cell not in at:
            return F.lit(cell)
        return F.when(_below(at[cell]), inside(2 * cell)).otherwise(inside(2 * cell + 1))

    return rows.withColumn("cell", inside(1))


def _median_bins(sums: DataFrame, goals: dict[int, float]) -> dict:
    """For each cell the first bin whose running weight reaches the cell's goal, or the last one.

    A cell has at most BINS rows of sums, however many rows and texts it holds.
    """
    goal = F.coalesce(*[F.when(F.col("cell") == cell, F.lit(value)) for cell, value in goals.items()])
    order = Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.withColumn("upto", F.sum("w").over(order))
    rank = F.struct((F.col("upto") < goal).alias("short"), F.when(F.col("upto") < goal, -F.col("bin")).otherwise(F.col("bin")))
    return {r["cell"]: r for r in running.groupBy("cell").agg(F.min_by(F.struct("bin", "upto", "w"), rank).alias("m")).select("cell", "m.*").collect()}


def split_level(rows: DataFrame, splits: list[Split], cells: list[int]) -> list[Split]:
    """One split for each of the cells. What reaches the driver is a few numbers per cell.

    The median is found digit by digit: the dimension's value, then the upper and the lower half of the hash of the
    rows that share it.
    """
    placed = _placed(rows, splits).where(F.col("cell").isin(cells))
    bounds = placed.groupBy("cell").agg(
        F.sum("size").alias("all"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
    )
    widest, goals = {}, {}
    for row in bounds.collect():
        # Ties go to the dimension listed first.
        widest[row["cell"]] = max(DIMENSIONS, key=lambda d, row=row: row[f"hi_{d}"] - row[f"lo_{d}"])
        goals[row["cell"]] = row["all"] / 2
    if not widest:
        return []
    value = F.coalesce(*[F.when(F.col("cell") == cell, F.col(dimension)) for cell, dimension in widest.items()])
    upper, lower = F.shiftright("tie", TIE_BITS // 2), F.col("tie").bitwiseAND((1 << TIE_BITS // 2) - 1)
    inside, found = placed, []
    for digit in (value, upper, lower):
        level = _median_bins(inside.groupBy("cell", digit.alias("bin")).agg(F.sum("size").alias("w")), goals)
        found.append(level)
        inside = inside.where(digit == F.coalesce(*[F.when(F.col("cell") == c, F.lit(r["bin"])) for c, r in level.items()]))
        # What is still wanted of the chosen bin's weight.
        goals = {c: goals[c] - (r["upto"] - r["w"]) for c, r in level.items()}
    out = []
    for cell, dimension in widest.items():
        value_bin, high, low = (level[cell]["bin"] for level in found)
        # Cut before or after the last digit's bin, whichever comes nearer to half.
        after = goals[cell] > found[-1][cell]["w"] / 2
        out.append(Split(cell, dimension, value_bin, (high << TIE_BITS // 2) + low + int(after)))
    return out


def kd_shards(docs: DataFrame, doc: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: shards of near equal bytes, slots gapless from 0.

    ``shards`` is a power of two: each level halves the bytes of every cell. Repeated rows count each time; an
    empty table gives an empty result.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    rows = stored(metadata(docs, doc, text), "shard-metadata")
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    target = (total or 0) / shards
    copies = rows.groupBy("text_key", "text_crc32", "size").agg(F.sum("size").alias("w"))
    # Fewer than HEAVY x shards texts are this heavy, and fewer than ``shards`` exceed the target.
    heavy = copies.where(F.col("w") > target / HEAVY).select("text_key", "w").collect() if target else []
    large = [r["text_key"] for r in heavy if r["w"] > target]
    whole = [r["text_key"] for r in heavy if r["w"] <= target]
    if whole:
        # At the origin of every dimension a heavy text isn't cut off at the side of a median that falls into it.
        at_origin = F.col("text_key").isin(whole)
        rows = rows.withColumns({d: F.when(at_origin, F.lit(0)).otherwise(F.col(d)) for d in DIMENSIONS})
    own = F.pmod(F.xxhash64("text_key", "text_crc32"), F.lit(1 << TIE_BITS)).cast("int")
    alone = F.pmod(F.xxhash64("doc_id"), F.lit(1 << TIE_BITS)).cast("int")
    rows = rows.withColumn("tie", F.when(F.col("text_key").isin(large), alone).otherwise(own) if large else own)
    splits: list[Split] = []
    cells = [1]
    while len(cells) < shards:
        splits += split_level(rows, splits, cells)
        cells = [half for cell in cells for half in (2 * cell, 2 * cell + 1)]
    placed = _placed(rows, splits).withColumn("shard", (F.col("cell") - shards).cast("int"))
    pieces = max(16, -(-(count or 0) // (shards * PIECE_ROWS)))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(pieces)).cast("int"))
    placed = stored(placed, "sharded")
    sizes = placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_key")
    numbered = placed.withColumn("local", F.row_number().over(local) - 1).join(offsets, ["shard", "piece"])
    return numbered.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("local") + F.col("offset")).cast("long").alias("slot")
    )


@query()
def op9_kd_shards(spark, sf_dir):
    placed = kd_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
