"""Token counts: lengths only, encoded in byte-balanced batches of Arrow functions.

White space separates the tokens of the word tokenizer: its pattern drops it, no special string holds any, and
neither its normaliser nor its lower-casing looks across it. ASCII white space is thus a safe boundary, at which
texts of any length are split; each distinct part is encoded once per batch (and kept while the task's memo, bounded
by bytes, lasts), and a text's count is the sum over its parts.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from signalspark.llm.common import Memo, query, release, table, text_slices

VOCABULARY = "word_bpe_49k.json"
#: Bytes of the text parts that a worker remembers until a task ends.
MEMO_BYTES = 64 << 20
#: Bytes of new text parts that go to the encoder in one call.
CALL_BYTES = 1 << 18

_tokenizers: dict[str, object] = {}
_memos: dict[str, Memo] = {}


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer's file; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load_tokenizer(name: str):
    if name not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary_path(name))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _tokenizers[name] = tokenizer
    return _tokenizers[name]


def encode_lengths(parts: list[bytes], name: str) -> list[int]:
    """Lengths of the encoded parts, in calls of at most CALL_BYTES (or one longer part)."""
    tokenizer, lengths, held, size = load_tokenizer(name), [], [], 0
    for part in [*parts, None]:
        if held and (part is None or size + len(part) > CALL_BYTES):
            lengths += [len(e) for e in tokenizer.encode_batch_fast(held, add_special_tokens=False)]
            held, size = [], 0
        if part is not None:
            held.append(part.decode("utf-8", "replace"))
            size += len(part)
    return lengths


def count_texts(texts: list[bytes], name: str = VOCABULARY) -> list[int]:
    """Tokens of each UTF-8 text."""
    memo = _memos.setdefault(name, Memo(MEMO_BYTES))
    memo.trim()
    split = [text.split() for text in texts]
    new = list({part for parts in split for part in parts if part not in memo})
    memo.learn(new, encode_lengths(new, name))
    return [sum(map(memo.__getitem__, parts)) for parts in split]


def token_counter(name: str = VOCABULARY) -> Callable:
    """An Arrow function from texts to token counts; a null text has none."""

    @arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([n for held in text_slices(texts) for n in count_texts(held, name)], pa.int64())
        _memos.clear()
        release()

    return count


def with_token_counts(
    docs: DataFrame, text: str = "text", name: str = VOCABULARY, limit: int = 2048, out: str = "n_tokens"
) -> DataFrame:
    """Adds the token count and ``over_limit``; columns of these names are replaced.

    Null and empty texts have 0 tokens and are never over the limit. Rows are kept as they are, repeated ones too; an
    empty table stays empty. Texts of any length are counted whole; special strings inside a text count as the
    library's default has it.
    """
    counted = docs.withColumn(out, token_counter(name)(F.col(text)))
    return counted.withColumn("over_limit", F.col(out) > limit)


@query()
def op6_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return with_token_counts(sized).select("doc_id", "n_bytes", "n_tokens", "over_limit")
