"""A training corpus from ``documents``: rules, near duplicates, benchmark passages, secrets, token pieces.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents``; the last adds
the encoded text. Extra columns pass through. Rows of one doc_id are one document: they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm.common import stored, table
from signalspark.llm.decontaminate import contamination, is_contaminated
from signalspark.llm.fertility import with_rules
from signalspark.llm.jaccard import near_duplicates
from signalspark.llm.pieces import with_pieces
from signalspark.llm.secrets import find_secrets, redacted


#: Bytes of an Arrow batch, in which whole texts go to Python. Batches of Spark's 64 MB are held, copied and answered
#: as a whole by the executor and by its workers.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def _small_batches(spark: SparkSession) -> None:
    """For the rest of the session, as a stage's Python runs when its rows are asked for."""
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def _held(docs: DataFrame) -> dict[str, str]:
    """Plain numbered names of the columns but the text: the rows hold the text once while a stage works on it, and no
    column of the documents meets one that the stage adds."""
    return {name: "text" if name == "text" else f"_column{k}" for k, name in enumerate(docs.columns)}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of their script."""
    _small_batches(spark)
    held = _held(docs)
    judged = with_rules(docs.select([F.col(name).alias(new) for name, new in held.items()]))
    return judged.where("kept").select([F.col(new).alias(name) for name, new in held.items()])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component of near duplicates; documents without words or id stay."""
    _small_batches(spark)
    groups = near_duplicates(docs)
    extra = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(stored(extra, "near-duplicates"), "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    spoiled = found.where(is_contaminated(F.col("n_words"), F.col("n_hit")))
    spoiled = stored(spoiled.select(F.col("doc_id").alias("_doc"), "text_hash").distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(spoiled["_doc"]) & (F.xxhash64(docs["text"]) == spoiled["text_hash"])
    return docs.join(spoiled, same, "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are replaced by a mark, and n_chars follows the text."""
    held = _held(docs)
    clean = redacted(find_secrets(docs.select([F.col(name).alias(new) for name, new in held.items()])))
    columns = [
        F.length("text").cast("long").alias(name) if name == "n_chars" else F.col(new).alias(name)
        for name, new in held.items()
    ]
    return clean.select(columns)


def token_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``piece_ids``, their number, and whether decoding them gives the text again."""
    _small_batches(spark)
    return with_pieces(docs).withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding and decoding", token_pieces),
]

#: Tokeniser fertility and the Markov models are beyond SQL; tests/llm checks the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs
