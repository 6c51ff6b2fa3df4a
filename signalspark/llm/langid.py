"""Language identification by mixture inference.

Each language has a smoothed model of character n-grams of words. A document is a mixture: every word comes from
one of the languages of a set, in unknown proportions. Expectation-maximisation finds the proportions from the
words' n-gram likelihoods. Sets grow by the languages in the order of their share in the full mixture; the set
with the best likelihood less a penalty per language (half the logarithm of the number of words, times
``PENALTY``) is taken. A document's set stops growing only when no larger one can be better: no proportions have a
likelihood above that of the full mixture plus ``n log(max g)``, where ``g`` are the mean ratios of a language's
likelihood of a word to the mixture's (by Jensen's inequality).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from signalspark.llm.common import Memo, drawn, query, release, table, text_slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: The models are fitted on about so many distinct labelled texts, spread over the table by hash, and at least on
#: about LEAST_DOCS of each language, or all it has.
TRAINING_DOCS = 6_000
LEAST_DOCS = 100
ROUNDS = 8
PENALTY = 2.0

#: Scores of words (as bytes of float32) by the key of the fitted model; one model at a time.
_memos: dict[int, Memo] = {}


def _letters(part: bytes) -> bytes:
    """The letters of a word in lower case, UTF-8; empty without any."""
    return "".join(c for c in part.decode("utf-8", "replace").lower() if c.isalpha()).encode()


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of bytes of the words (framed by borders), and the word it belongs to."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    for n in ORDERS:
        if len(data) < n:
            continue
        key = np.full(len(data) - n + 1, np.uint64(n))
        for k in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + data[k : len(data) - n + 1 + k] + np.uint64(1)
        key ^= key >> np.uint64(32)
        inside = owner[: len(key)] == owner[n - 1 :]
        buckets.append((key[inside] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[: len(key)][inside])
    return np.concatenate(buckets or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n): n-gram counts by language, added up in the tasks before they are exchanged."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            at = 0
            for held in text_slices(batch.column(0)):
                for language, raw in zip(langs[at : at + len(held)], held, strict=True):
                    words = [w for w in map(_letters, raw.split()) if w]
                    if words:
                        got = np.bincount(_grams(words)[0], minlength=BUCKETS)
                        sums[language] = sums.get(language, 0) + got
                at += len(held)
        for language, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.record_batch(
                {"lang": pa.array([language] * len(used), pa.string()), "bucket": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())}
            )

    counted = docs.select(text, lang).mapInArrow(count, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", bound: int = TRAINING_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (BUCKETS x languages), from about ``bound`` distinct labelled texts.

    Rows without a language or text are left out; copies of a text count once. At most BUCKETS numbers per language
    reach the driver. An empty table gives no languages, and then every text is ``und``.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = gram_counts(drawn(labelled.select(text, lang), text, bound, lang, LEAST_DOCS), text, lang).collect()
    languages = sorted({r["lang"] for r in rows})
    counts = np.zeros((BUCKETS, len(languages)))
    for r in rows:
        counts[r["bucket"], languages.index(r["lang"])] = r["n"]
    smooth = counts + 0.1
    return languages, np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32)


def _word_scores(words: list[bytes], logs: np.ndarray, key: int) -> np.ndarray:
    """Log-likelihood of each word (repeated ones too) in each language, by a memo of distinct words."""
    if key not in _memos:
        _memos.clear()
    memo = _memos.setdefault(key, Memo())
    memo.trim()
    new = [w for w in set(words) if w not in memo]
    if new:
        spelled = [_letters(w) for w in new]
        buckets, owner = _grams(spelled)
        scores = np.zeros((len(new), logs.shape[1]))
        for k in range(logs.shape[1]):
            scores[:, k] = np.bincount(owner, weights=logs[buckets, k], minlength=len(new))
        scores[[not s for s in spelled]] = np.nan  # no letters: no evidence
        memo.learn(new, [row.tobytes() for row in scores.astype(np.float32)])
    return np.frombuffer(b"".join(map(memo.__getitem__, words)), np.float32).reshape(len(words), logs.shape[1])


def mixtures(scores: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (count x languages, zero outside the chosen set) and words per document.

    ``scores`` are the words' log-likelihoods, ``owner`` their documents in ascending order.
    """
    size = scores.shape[1]
    n_words = np.bincount(owner, minlength=count)
    best = np.zeros((count, size))
    has = np.flatnonzero(n_words)
    if not len(has):
        return best, n_words
    top = scores.max(axis=1, keepdims=True)
    odds = np.exp(np.maximum(scores - top, -60.0))

    def run(docs: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS):
        """Proportions, log-likelihoods and highest mean ratios of some documents, each on its own."""
        chosen = np.zeros(count, bool)
        chosen[docs] = True
        own = odds if len(docs) == len(has) else odds[chosen[owner]]
        sizes = n_words[docs]
        at, starts = np.repeat(np.arange(len(docs)), sizes), np.cumsum(sizes) - sizes
        theta = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            weighted = theta[at] * own
            weighted /= np.maximum(weighted.sum(axis=1, keepdims=True), 1e-30)
            theta = np.add.reduceat(weighted, starts, axis=0) / sizes[:, None]
        mixed = np.maximum((theta[at] * own).sum(axis=1), 1e-30)
        ratios = np.add.reduceat(own / mixed[:, None], starts, axis=0) / sizes[:, None]
        return theta, np.bincount(at, weights=np.log(mixed), minlength=len(docs)), ratios.max(axis=1)

    full, full_fit, ratio = run(has, np.ones((len(has), size)))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    n = n_words[has]
    limit = full_fit + n * np.log(ratio) + 1e-6  # and what rounding may add
    cost = PENALTY * 0.5 * np.log(np.maximum(n, 2))
    value, going = np.full(len(has), -np.inf), np.arange(len(has))
    for k in range(1, size + 1):
        if k == size:
            theta, fit = full[going], full_fit[going]
        else:
            theta, fit, _ = run(has[going], (rank[going] < k).astype(np.float64), ROUNDS if k > 1 else 0)
        penalised = fit - cost[going] * k
        better = penalised > value[going]
        best[has[going[better]]], value[going[better]] = theta[better], penalised[better]
        going = going[limit[going] - cost[going] * (k + 1) > value[going]]
        if not len(going):
            break
    return best, n_words


def identify(texts: list[bytes], languages: list[str], logs: np.ndarray, key: int) -> list[tuple[str, float, list[float]]]:
    split = [text.split() for text in texts]
    words = list(chain.from_iterable(split))
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    scores = _word_scores(words, logs, key) if words else np.zeros((0, len(languages)), np.float32)
    spelled = ~np.isnan(scores[:, 0]) if len(languages) else np.zeros(0, bool)
    shares, n = mixtures(scores[spelled], owner[spelled], len(texts)) if len(languages) else (np.zeros((len(texts), 0)), np.zeros(len(texts)))
    out = []
    for own, many in zip(shares, n, strict=True):
        if not many:
            out.append(("und", 0.0, [0.0] * len(languages)))
        else:
            k = int(own.argmax())
            out.append((languages[k], min(1.0, float(own[k])), own.tolist()))
    return out


def language(text: Column, languages: list[str], logs: np.ndarray) -> Column:
    """struct<lang, score, shares>: the main language, its proportion, and the proportions by language.

    Null texts and texts without a letter are ``und`` with score 0. Texts of any length are judged whole, and each on
    its own: repeated rows get one result, an empty table stays empty.
    """
    key = hash(logs.tobytes())

    @arrow_udf("struct<lang:string,score:double,shares:array<double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("lang", "score", "shares")
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("shares", pa.list_(pa.float64()))])
        for texts in batches:
            got = [one for held in text_slices(texts) for one in identify(held, languages, logs, key)]
            yield pa.array([dict(zip(names, one, strict=True)) for one in got], kind)
        _memos.clear()
        release()

    return run(text)


@query()
def op2_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    languages, logs = fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language(F.col("text"), languages, logs).alias("_l"))
    return found.select(
        "doc_id", "held_out", F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"), F.col("_l.shares").alias("shares")
    )
