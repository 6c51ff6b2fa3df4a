"""Quality rules: base text rules, and how well public vocabularies fit a text (tokeniser fertility).

A text is measured by each vocabulary: characters per token, the share of tokens that stand for single bytes of
characters the vocabulary lacks, and the entropy of its tokens in bits. Words are encoded once and remembered
within a bound of bytes until the task ends. Rejection bands belong to the script that most of the text's words are written in.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from signalspark.llm.common import Memo, query, release, table, text_slices, unused
from signalspark.llm.token_counts import vocabulary_path

#: Any of the public vocabulary files; each adds its own measures, and a text is rejected if one of them is.
VOCABULARIES = ("byte_bpe_multi_50k.tiktoken",)
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

# First code points of blocks and the script of their letters; what lies between belongs to the entry before.
SCRIPT_STARTS = [
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x700, "other"), (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
_STARTS = [s for s, _ in SCRIPT_STARTS]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS} | {"none"})


#: n tokens have log2(n) bits of entropy at most. The lower limits hold in full from so many tokens on; a shorter text
#: must reach the same share of the bits that it can have. The mean of the characters of n tokens strays by about
#: 1 / sqrt(n) of itself; that much is allowed below its lower limit.
FULL_TOKENS = 100


@dataclass(frozen=True)
class Band:
    """Accepted ranges, for texts of every length."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: tuple[float, float]


#: By script, for byte-level vocabularies. Han, kana and Thai write words without spaces and have few characters
#: per token; vocabularies of Western text fall back to bytes outside Latin, Greek and Cyrillic.
BANDS = {
    "latin": Band((1.8, 12.0), 0.10, (4.6, 16.0)),
    "greek": Band((0.8, 12.0), 0.50, (4.0, 16.0)),
    "cyrillic": Band((1.1, 12.0), 0.50, (4.5, 16.0)),
    "none": Band((0.8, 20.0), 0.50, (3.0, 16.0)),
}
OTHER_BAND = Band((0.3, 12.0), 0.98, (3.0, 16.0))

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIT = "vocabulary string, n_tokens bigint, chars_per_token double, byte_share double, entropy double"
MEASURES = (
    "struct<" + ",".join(f"{name}:bigint" for name in BASE) + ",script:string,fit:array<struct<"
    + FIT.replace(" ", ":").replace(",:", ",") + ">>>"
)
ARROW_MEASURES = pa.struct(
    [(name, pa.int64()) for name in BASE]
    + [
        ("script", pa.string()),
        (
            "fit",
            pa.list_(
                pa.struct(
                    [("vocabulary", pa.string()), ("n_tokens", pa.int64())]
                    + [(name, pa.float64()) for name in ("chars_per_token", "byte_share", "entropy")]
                )
            ),
        ),
    ]
)

FIT_NAMES = [field.split()[0] for field in FIT.split(", ")]

_encoders: dict[str, _Words] = {}
_scripts = Memo()


def script_of(word: str) -> str:
    """Script of the first letter of a word; none without a letter."""
    for c in word:
        if c.isalpha():
            at = bisect.bisect_right(_STARTS, ord(c)) - 1
            return SCRIPT_STARTS[at][1] if at >= 0 else "other"
    return "none"


class _Words:
    """Token ids of words in one vocabulary."""

    def __init__(self, name: str):
        path = vocabulary_path(name)
        self.memo = Memo()
        if name.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = library.get_piece_size()
            self.is_byte = np.array([library.is_byte(i) for i in range(self.size)])
            self.encode = lambda words: library.encode(words, num_threads=1)
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            library = tiktoken.Encoding(
                name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
            self.size = max(ranks.values()) + 1
            self.is_byte = np.zeros(self.size, bool)
            self.is_byte[[r for token, r in ranks.items() if len(token) == 1 and token[0] >= 0x80]] = True
            self.encode = lambda words: [library.encode_ordinary(" " + w) for w in words]
        self.code = np.uint16 if self.size <= 1 << 16 else np.uint32

    def learn(self, words: set[bytes]) -> None:
        self.memo.trim()
        new = [w for w in words if w not in self.memo]
        ids = self.encode([w.decode("utf-8", "replace") for w in new])
        self.memo.learn(new, [np.array(i, self.code).tobytes() for i in ids])

    def fit(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        ids = np.frombuffer(b"".join(map(self.memo.__getitem__, words)), self.code)
        if not len(ids):
            return 0, 0.0, 0.0, 0.0
        counts = np.bincount(ids)
        used = np.flatnonzero(counts)
        own = counts[used]
        share = float(own[self.is_byte[used]].sum()) / len(ids)
        entropy = math.log2(len(ids)) - float((own * np.log2(own)).sum()) / len(ids)
        return len(ids), chars / len(ids), share, max(entropy, 0.0)


def _encoder(name: str) -> _Words:
    if name not in _encoders:
        _encoders[name] = _Words(name)
    return _encoders[name]


def repeated_words(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in a run of ``window`` words found twice or more in it.

    Runs get exact numbers by doubling: a run of 2n words is a pair of runs of n words.
    """
    numbers: dict[bytes, int] = {}
    flat = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words], np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    covered = np.zeros(len(flat), bool)
    if len(flat) < window:
        return np.zeros(len(texts), np.int64)
    code, span = flat, 1
    while span < window:
        pair = code[:-span] * (int(code.max()) + 1) + code[span:]
        code = np.unique(pair, return_inverse=True)[1]
        span *= 2
    whole = owner[: len(code)] == owner[window - 1 : window - 1 + len(code)]
    at = np.flatnonzero(whole)
    keys = owner[at] * (int(code.max()) + 1) + code[at]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = at[counts[inverse] > 1]
    for k in range(window):
        covered[starts + k] = True
    return np.bincount(owner[covered], minlength=len(texts))


def measure_texts(texts: list[bytes], vocabularies=VOCABULARIES) -> list[dict]:
    split = [text.split() for text in texts]
    distinct = set(chain.from_iterable(split))
    encoders = [_encoder(name) for name in vocabularies]
    for encoder in encoders:
        encoder.learn(distinct)
    _scripts.trim()
    new = [w for w in distinct if w not in _scripts]
    _scripts.learn(new, [script_of(w.decode("utf-8", "replace")) for w in new])
    out = []
    for text, words, repeats in zip(texts, split, repeated_words(split).tolist(), strict=True):
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        joined = b"".join(words)
        chars = len(joined.decode("utf-8", "replace"))
        lines = [line for line in text.split(b"\n") if line.split()]
        seen = Counter(map(_scripts.__getitem__, words))
        seen.pop("none", None)
        out.append(
            {
                "n_words": len(words),
                "word_chars": chars,
                "n_symbols": symbols,
                "n_dup_lines": len(lines) - len(set(lines)),
                "n_repeat_words": repeats,
                "script": min(seen, key=lambda s: (-seen[s], s), default="none"),
                "fit": [
                    dict(zip(FIT_NAMES, (name, *encoder.fit(words, chars)), strict=True))
                    for name, encoder in zip(vocabularies, encoders, strict=True)
                ],
            }
        )
    return out


def measured(text: Column, vocabularies=VOCABULARIES) -> Column:
    """The measures of a text as a struct; a null text is measured as the empty one."""

    @arrow_udf(MEASURES)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([m for held in text_slices(texts) for m in measure_texts(held, vocabularies)], ARROW_MEASURES)
        for memo in (_scripts, *[encoder.memo for encoder in _encoders.values()]):
            memo.clear()
        release()

    return measure(text)


def in_band(script: Column, fit: Column, bands: dict[str, Band] = BANDS, other: Band = OTHER_BAND) -> Column:
    """Whether one vocabulary's measures lie in the band of the text's script."""

    n = F.greatest(fit["n_tokens"], F.lit(1)).cast("double")
    part, strays = F.least(F.lit(1.0), F.log2(n) / math.log2(FULL_TOKENS)), 1 / F.sqrt(n)

    def inside(band: Band) -> Column:
        (few, many), (low, high) = band.chars_per_token, band.entropy
        return (
            fit["chars_per_token"].between(few * (1 - strays), F.lit(many))
            & (fit["byte_share"] <= band.byte_share)
            & fit["entropy"].between(low * part, F.lit(high))
        )

    verdict = F.when(script.isNull(), F.lit(True))
    for name, band in bands.items():
        verdict = verdict.when(script == name, inside(band))
    return verdict.otherwise(inside(other))


def with_rules(docs: DataFrame, text: str = "text", vocabularies=VOCABULARIES, bands: dict[str, Band] = BANDS) -> DataFrame:
    """Adds the base measures, ``script``, ``fit``, ``base_failed`` and ``kept``; columns of these names are replaced.

    Null and empty texts have no words, so they fail the base rules. Rows are judged one by one: repeated rows get
    the same verdict, an empty table stays empty. Texts of any length are measured whole.
    """
    # The measures stand alone in a projection, so that the optimiser doesn't call Python once per field.
    held = unused(docs, "_m")
    got = docs.withColumn(held, measured(F.col(text), vocabularies))
    got = got.withColumns({name: F.col(held)[name] for name in (*BASE, "script", "fit")}).drop(held)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fits = F.forall("fit", lambda one: in_band(F.col("script"), one, bands))
    return got.withColumn("base_failed", failed).withColumn("kept", ~failed & fits)


@query()
def op8_tokenizer_fertility(spark, sf_dir):
    docs = with_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fit = F.col("fit")[0]
    return docs.select(
        "doc_id",
        *BASE,
        "base_failed",
        "kept",
        "script",
        *[fit[name].alias(name) for name in ("n_tokens", "chars_per_token", "byte_share", "entropy")],
    )
