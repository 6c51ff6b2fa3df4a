"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

A text's features are its words and pairs of neighbouring words, hashed to BUCKETS; runs of letters, of digits and
of each other sign are words, and letters are folded to lower case after a sign for their case was noted. A
feature's value is its share of the text, so the score is a sparse dot product of shares and weights.

Training runs in rounds over a bounded sample: each partition starts from the common state of the previous
round, makes one pass of updates, and the states are averaged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from signalspark.llm.common import Memo, drawn, query, release, stored, table, text_slices

BUCKETS = 1 << 18
#: The classifier is fitted on about so many labelled documents, spread over the labels by a hash of the id.
TRAINING_DOCS = 12_000
#: Of each label come at least about so many, or all it has.
LEAST_DOCS = 1_000
PARTITIONS = 4
ROUNDS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
#: Shares are multiplied by this, so that frequent features move the score within a few updates.
SCALE = 8.0
PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")

_memo = Memo()


def _hash(text: str) -> int:
    value = 0xCBF29CE484222325
    for byte in text.encode("utf-8", "replace"):
        value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def _codes(word: bytes) -> bytes:
    """Hashes of the parts of a word between spaces, in order."""
    out = []
    for part in PARTS.findall(word.decode("utf-8", "replace")):
        if part.isalpha():
            case = "U" if len(part) > 1 and part.isupper() else "l"
            out += [_hash(case + part.lower()), _hash("case:" + case)] if case == "U" else [_hash(case + part.lower())]
        else:
            out.append(_hash("#" if part.isdigit() else part[:8]))
    return np.array(out, np.uint64).tobytes()


def features(text: bytes) -> np.ndarray:
    """Buckets of all n-grams of a text, repeated ones too."""
    _memo.trim()
    words = text.split()
    new = [word for word in set(words) if word not in _memo]
    _memo.learn(new, [_codes(word) for word in new])
    one = np.frombuffer(b"".join(map(_memo.__getitem__, words)), np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ one[1:]
    two ^= two >> np.uint64(29)
    same = one[1:] == one[:-1]
    repeats = np.full(int(same.sum()), _hash("same"), np.uint64)
    every = np.concatenate([one, two, repeats])
    return ((every ^ (every >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def _shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(features(text), return_counts=True)
    return found, SCALE * counts / max(counts.sum(), 1)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    pull = np.sign(z) * L1 - z
    return np.where(np.abs(z) <= L1, 0.0, pull / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learn(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """One pass of updates, in place. The last bucket is the intercept's."""
    for at, value, label in rows:
        at, value = np.append(at, BUCKETS), np.append(value, 1.0)
        w = _weights(z[at], n[at])
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g


def fit(examples: DataFrame, text: str = "text", label: str = "label", doc: str | None = None) -> np.ndarray:
    """Weights (BUCKETS and the intercept) from labelled rows.

    Rows are dealt to the partitions by ``doc``, so that copies of one text are spread; without it by their text.
    Repeated rows are learned from each time. What reaches the driver is one state per partition and round. Without
    rows, or from an empty table, all weights are 0: every score is one half.
    """
    chosen = examples.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.xxhash64(doc or text).alias("deal"))
    ready = stored(chosen.repartition(PARTITIONS, "deal").select("text", "label"), "quality-examples")
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for turn in range(ROUNDS):
        sent = (z.astype(np.float32), n.astype(np.float32))

        def learn(batches, sent=sent, turn=turn):
            own_z, own_n = (x.astype(np.float64) for x in sent)
            rows = []
            for batch in batches:
                for raw, label in zip(batch.column(0).cast(pa.large_binary()), batch.column(1), strict=True):
                    rows.append((*_shares(raw.as_py() or b""), label.as_py()))
            _memo.clear()
            np.random.default_rng(turn).shuffle(rows)
            _learn(own_z, own_n, rows)
            if rows:
                yield pa.record_batch(
                    {
                        "rows": pa.array([len(rows)], pa.int64()),
                        "z": pa.array([own_z.astype(np.float32).tobytes()], pa.binary()),
                        "n": pa.array([own_n.astype(np.float32).tobytes()], pa.binary()),
                    }
                )

        states = ready.mapInArrow(learn, "rows long, z binary, n binary").collect()
        if not states:
            break
        total = sum(s["rows"] for s in states)
        z = sum(np.frombuffer(s["z"], np.float32).astype(np.float64) * s["rows"] for s in states) / total
        n = sum(np.frombuffer(s["n"], np.float32).astype(np.float64) * s["rows"] for s in states) / total
    return _weights(z, n).astype(np.float32)


def examples_of(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, bound: int = TRAINING_DOCS) -> DataFrame:
    """(doc, text, label) of about ``bound`` labelled documents; rows without a label or text are left out.

    The chosen labels are at most about ``bound`` rows of two numbers, so they are sent to the documents' tasks and
    the texts of the other documents stay where they are.
    """
    labelled = labels.where(F.col(label).isNotNull()).select(F.col(doc).alias("_doc"), F.col(label).alias("label"))
    some = drawn(labelled.where("_doc is not null"), "_doc", bound, "label", LEAST_DOCS)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("_doc"), F.col(text).alias("text"))
    return texts.join(F.broadcast(some), "_doc").select(F.col("_doc").alias("doc"), "text", "label")


def quality_score(text: Column, weights: np.ndarray) -> Column:
    """Probability of label 1; null and empty texts have the intercept's.

    Texts of any length are scored whole, repeated rows alike; an empty table stays empty.
    """

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for raw in (raw for held in text_slices(texts) for raw in held):
                at = features(raw)
                dot = SCALE * float(weights[at].sum(dtype=np.float64)) / max(len(at), 1) + float(weights[BUCKETS])
                out.append(1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, dot)))))
            yield pa.array(out, pa.float64())
        _memo.clear()
        release()

    return run(text)


@query()
def op3_quality_ftrl(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    weights = fit(examples_of(docs, labels.where(~held_out), "doc_id", "text", "quality"), doc="doc")
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_score(F.col("text"), weights).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
