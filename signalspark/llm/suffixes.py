"""Suffix-array deduplication of repeated byte strings, over sampled suffixes.

A byte is removed if a 50-byte string that covers it also starts in a document with a smaller id. Sorting a
suffix for every byte would move at least 13 bytes per byte of text, so the suffixes that are sorted are sampled
by content, in a way that misses nothing:

1. *Leading tokens.* Each 50-byte string has one leading token, the least of the hashes of its 24-byte substrings:
   equal strings have equal ones. A document's distinct leading tokens are about a fourteenth of its bytes.
2. *Sampled splitters.* The tokens of all blocks of texts are range-partitioned at splitters sampled from them.
   A range is sorted locally, by token and then document, and neighbours are compared: a token in one document
   only can't lead a repeated string. (Equal tokens are in one range, so nothing crosses its borders.)
3. *Comparison of runs.* Neighbouring 50-byte strings with one shared leading token form a run. Runs are dealt by a
   hash of their bytes, with their bytes: all but the first document of each group of equals mark the run's strings.
4. *Comparison of strings.* Of the strings of the runs that are left, hashes are dealt first; those with a hash of two
   documents or more are dealt again with their bytes, and marked likewise.
   Nothing is missed: the smallest document of a string has it in a run that no smaller document has, so it takes
   part here, and every other document meets it here or was marked with a whole run.

Hashes only find candidates and place them: what is removed was compared byte for byte, and different runs or
strings of one hash are groups of their own.

A range sees a token, run or string once per block, with the smallest document of the block, however many documents
share it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm import blocks as B
from signalspark.llm.common import query, release, stored, table

SPAN = 50
TOKEN = 24
_FACTOR = 0x9E3779B97F4A7C15
#: Texts of a block are hashed so many bytes at a time.
CHUNK_BYTES = 1 << 19


def _place(ids: np.ndarray) -> np.ndarray:
    """Document ids as unsigned numbers in their order, with a bit to spare."""
    return (ids + B.ID_SHIFT).astype(np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_FACTOR, n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _rolling(data: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the substrings of each width, from those of powers of two.

    A string of m + n bytes combines two hashes. Widths must ascend; nothing is kept longer than it is needed.
    """
    hashes = _mix(data.astype(np.uint64) + np.uint64(1))
    made: list[np.ndarray | None] = [None] * len(widths)
    have = [0] * len(widths)
    step = 1
    while step <= max(widths):
        for k, width in enumerate(widths):
            if width & step:  # the next piece stands before what there is
                rest = made[k]
                size = len(data) - have[k] - step + 1
                made[k] = hashes[:size] if rest is None else hashes[:size] * _power(have[k]) + rest[step : step + size]
                have[k] += step
        half = hashes[:-step] if step < len(hashes) else hashes[:0]
        hashes = half * _power(step) + hashes[step : step + len(half)]
        step *= 2
    return made


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each window of values, by doubling."""
    span, low = 1, values
    while span * 2 <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = window - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _chunks(texts: list[bytes]):
    """Runs of texts of about CHUNK_BYTES: the first one's number, their bytes and sizes."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK_BYTES):
            size += len(texts[stop])
            stop += 1
        yield at, np.frombuffer(b"".join(texts[at:stop]), np.uint8), np.array([len(t) for t in texts[at:stop]], np.int64)
        at = stop


def strings_of(texts: list[bytes], span: int):
    """Yields, for runs of texts, (owner, start, hash) of all their span-byte strings."""
    for at, data, sizes in _chunks(texts):
        if len(data) >= span:
            strings = _rolling(data, (span,))[0]
            owner = np.repeat(np.arange(len(sizes)), sizes)[: len(strings)]
            start = np.arange(len(strings)) - (np.cumsum(sizes) - sizes)[owner]
            whole = start + span <= sizes[owner]
            yield owner[whole] + at, start[whole], _mix(strings[whole])


def leads_of(texts: list[bytes], span: int, token: int):
    """Yields, for runs of texts, (owner, start, count, leading token) of each stretch of neighbouring span-byte
    strings of one text that have one leading token."""
    for at, data, sizes in _chunks(texts):
        if len(data) < span:
            continue
        lead = _least(_mix(_rolling(data, (token,))[0]), span - token + 1)
        ends = np.cumsum(sizes)
        fresh = np.ones(len(lead), bool)
        np.not_equal(lead[1:], lead[:-1], out=fresh[1:])
        # Strings of a text end where the next text's would begin: neither these nor those across are its own.
        begins, lasts = ends - sizes, ends - span + 1
        fresh[begins[begins < len(lead)]] = True
        fresh[lasts[(lasts >= 0) & (lasts < len(lead))]] = True
        first = np.flatnonzero(fresh)
        owner = np.searchsorted(ends, first, "right")
        start = first - begins[owner]
        own = start + span <= sizes[owner]
        count = np.diff(np.append(first, len(lead)))
        yield owner[own] + at, start[own], count[own], lead[first[own]]


def _first_documents(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order; for each its smallest document, doubled, plus 1 if the key has several."""
    if not len(keys):
        return keys.astype(np.uint64), np.zeros(0, np.uint64)
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    starts = B.first_of_equals(keys)
    several = np.maximum.reduceat(docs, starts) != docs[starts]
    return keys[starts], (_place(docs[starts]) << np.uint64(1)) | several.astype(np.uint64)


def _token_keys(span: int, token: int, drop: np.uint64) -> B.KeysOf:
    def keys_of(texts, ids):
        keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for owner, _, _, lead in leads_of(texts, span, token):
            keys.append(lead >> drop)
            docs.append(ids[owner])
        return _first_documents(np.concatenate(keys), np.concatenate(docs))

    return keys_of


def _shared(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """1 for tokens of two documents or more."""
    starts = B.first_of_equals(keys)
    if not len(keys):
        return np.zeros(0, np.uint32)
    low, high = np.minimum.reduceat(numbers >> np.uint64(1), starts), np.maximum.reduceat(numbers >> np.uint64(1), starts)
    several = np.bitwise_or.reduceat(numbers & np.uint64(1), starts) > 0
    return np.repeat(((low != high) | several).astype(np.uint32), np.diff(np.append(starts, len(keys))))


def _seen_before(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """1 where another block has a smaller document with the string."""
    starts = B.first_of_equals(keys)
    if not len(keys):
        return np.zeros(0, np.uint32)
    docs = numbers >> np.uint64(1)
    low = np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.append(starts, len(keys))))
    return (low < docs).astype(np.uint32)


class _Pieces:
    """Byte strings of a block under their hashes. Which of them are equal, their bytes say."""

    def __init__(self, hashes: np.ndarray, docs: np.ndarray, rows: np.ndarray):
        order, fresh = B.equal_rows(hashes, rows)
        starts = np.flatnonzero(fresh)
        self.docs, self.group = docs, np.empty(len(docs), np.int64)
        self.group[order] = np.cumsum(fresh) - 1
        self.picked = order[starts]
        self.hashes, self.rows = hashes[self.picked], rows[self.picked]
        own = docs[order]
        self.low = np.minimum.reduceat(own, starts) if len(starts) else own
        self.high = np.maximum.reduceat(own, starts) if len(starts) else own

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        several = (self.low != self.high).astype(np.uint64)
        return self.hashes, (_place(self.low) << np.uint64(1)) | several, self.rows

    def repeated(self, before: np.ndarray) -> np.ndarray:
        """Which of the pieces a smaller document has, here or in another block."""
        return before.astype(bool)[self.group] | (self.low[self.group] < self.docs)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of numbers."""
    value = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        value = _mix((value ^ column) * np.uint64(_FACTOR) + np.uint64(1))
    return value


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of texts, and where each begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes


class _Runs:
    """The runs of a block: neighbouring strings with one shared leading token, at most span of them."""

    def __init__(self, texts, ids, span, token, drop, hash_drop, shared: np.ndarray):
        none = np.zeros(0, np.int64)
        parts = zip((none, none, none, np.zeros(0, np.uint64)), *leads_of(texts, span, token), strict=True)
        owner, start, sizes, lead = (np.concatenate(c) for c in parts)
        hit = shared.astype(bool)[B.places(lead >> drop)]
        owner, start, sizes = owner[hit], start[hit], sizes[hit]
        # A longer stretch is several runs: span strings cover 2 span - 1 bytes.
        many = -(-sizes // span)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.owner, self.start = np.repeat(owner, many), np.repeat(start, many) + nth * span
        self.sizes = np.minimum(np.repeat(sizes, many) - nth * span, span)
        data, begins = _joined(texts)
        rows = B.byte_rows(data, begins[self.owner] + self.start, self.sizes + span - 1, 2 * span - 1)
        self.pieces = _Pieces(row_hashes(rows) >> hash_drop, ids[self.owner], rows)

    def packed(self, which: np.ndarray) -> bytes:
        """Owner, start and size of the chosen runs."""
        numbers = np.stack([np.diff(self.owner[which], prepend=0), self.start[which], self.sizes[which]]).astype(np.uint32)
        planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(3, numbers.shape[1], 4)
        return B.squeeze(planes.transpose(0, 2, 1).tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(B.unsqueeze(data), np.uint8)
    planes = np.ascontiguousarray(planes.reshape(3, 4, len(planes) // 12).transpose(0, 2, 1))
    owner, start, size = planes.reshape(-1).view(np.uint32).reshape(3, -1).astype(np.int64)
    return np.cumsum(owner), start, size


class _Strings:
    """The span-byte strings of the runs that no smaller document has whole."""

    def __init__(self, texts, ids, span, hash_drop, left: bytes):
        owner, start, sizes = _unpacked(left)
        held = [texts[o][a : a + n + span - 1] for o, a, n in zip(owner.tolist(), start.tolist(), sizes.tolist(), strict=True)]
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        run, at, string = (np.concatenate(c) for c in zip(empty, *strings_of(held, span), strict=True))
        self.span, self.hashes = span, string >> hash_drop
        self.owner, self.start = owner[run], start[run] + at
        self.docs = ids[self.owner]
        self.data, begins = _joined(held)
        self.at = begins[run] + at

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return _first_documents(self.hashes, self.docs)

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, _Pieces]:
        """Which strings have a hash of several documents, and these with their bytes."""
        hit = np.flatnonzero(shared.astype(bool)[B.places(self.hashes)])
        rows = B.byte_rows(self.data, self.at[hit], np.full(len(hit), self.span), self.span)
        return hit, _Pieces(self.hashes[hit], self.docs[hit], rows)

    def marked(self, shared: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, start) of the strings that also start in a smaller document."""
        hit, pieces = self.candidates(shared)
        hit = hit[pieces.repeated(seen)]
        return self.owner[hit], self.start[hit]


def _spans(texts: list[bytes], owner: np.ndarray, start: np.ndarray, span: int):
    """For each text its maximal removed runs [start, end)."""
    if not len(owner):
        return [[] for _ in texts]
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    opens = np.ones(len(owner), bool)
    opens[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + span)
    firsts = np.flatnonzero(opens)
    lasts = np.append(firsts[1:], len(owner)) - 1
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    for o, a, b in zip(owner[firsts].tolist(), start[firsts].tolist(), start[lasts].tolist(), strict=True):
        runs[o].append((a, b + span))
    return runs


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<int>, ends array<int>, kept binary, kept_sha256 string"


def repeated_spans(
    docs: DataFrame,
    id_name: str = "doc_id",
    text: str = "text",
    span: int = SPAN,
    token: int = TOKEN,
    with_kept: bool = True,
) -> DataFrame:
    """A row per document: sizes, removed byte runs, the kept bytes (if wanted) and their SHA-256.

    Null and empty texts, and texts under ``span`` bytes, lose nothing. Rows of one id are one document and don't
    remove each other's bytes; rows without an id come after all others. An empty table stays empty; a text above a
    block's size is a block of its own, in one task's memory. Candidates are found by hashes of as many bits as the
    input's size asks for, and compared byte for byte.
    """
    stock = B.to_blocks(docs, id_name, text)
    total = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    # As many bits more than the number of keys has that chance matches cost little: they are only looked at once more.
    drop = np.uint64(64 - min(64, max(1, total // 14).bit_length() + 21))
    string_drop = np.uint64(64 - min(64, max(1, total).bit_length() + 24))
    token_keys = _token_keys(span, token, drop)
    cuts = B.splitters(stock, token_keys, max(1, 2 * total // (span - token + 2)))
    shared = B.ask(stock, token_keys, _shared, cuts, "shared-tokens")
    paired = stock.join(shared, "block_id", "left")

    def runs_of(row) -> _Runs:
        ids, texts = B.open_block(row["ids"], row["sizes"], row["texts"])
        return _Runs(texts, ids, span, token, drop, string_drop, B.read_answers(row["answers"]))

    def strings_in(row) -> tuple[np.ndarray, list[bytes], _Strings]:
        ids, texts = B.open_block(row["ids"], row["sizes"], row["texts"])
        return ids, texts, _Strings(texts, ids, span, string_drop, row["left_runs"])

    def sort_out(batches):
        for batch in batches:
            for row in batch.to_pylist():
                runs = runs_of(row)
                done = runs.pieces.repeated(B.read_answers(row["seen_runs"]))
                yield pa.record_batch(
                    {
                        "block_id": pa.array([row["block_id"]], pa.int64()),
                        "seen_runs": pa.array([runs.packed(done)], pa.binary()),
                        "left_runs": pa.array([runs.packed(~done)], pa.binary()),
                        "n_left": pa.array([int(runs.sizes[~done].sum())], pa.int64()),
                    }
                )
        release()

    def even_cuts(keys: int) -> np.ndarray:
        ranges = max(B.LEAST_RANGES, keys // B.RANGE_KEYS)
        width = 64 - int(string_drop)
        return np.array([(k << width) // ranges for k in range(1, ranges)], np.uint64)

    def with_answers(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
        return blocks.join(answers.select("block_id", F.col("answers").alias(name)), "block_id", "left")

    # How many runs are taken to be shared decides the number of ranges, nothing else. The strings left are counted.
    seen_runs = B.ask_rows(paired, lambda row: runs_of(row).pieces.keys(), _seen_before, even_cuts(total // 14), "seen-runs")
    kinds = "block_id long, seen_runs binary, left_runs binary, n_left long"
    runs = stored(with_answers(paired, seen_runs, "seen_runs").mapInArrow(sort_out, kinds), "runs")
    left_cuts = even_cuts(int(runs.agg(F.sum("n_left")).first()[0] or 0))
    sorted_out = stock.join(runs.drop("n_left"), "block_id")
    hashes = B.ask_rows(sorted_out, lambda row: strings_in(row)[2].keys(), _shared, left_cuts, "shared-strings")
    sorted_out = with_answers(sorted_out, hashes, "shared_strings")

    def candidates(row):
        return strings_in(row)[2].candidates(B.read_answers(row["shared_strings"]))[1].keys()

    seen = B.ask_rows(sorted_out, candidates, _seen_before, left_cuts, "seen-strings")

    def remove(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts, found = strings_in(row)
                owner, start = found.marked(B.read_answers(row["shared_strings"]), B.read_answers(row["seen_strings"]))
                run, first, sizes = _unpacked(row["seen_runs"])
                within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                owner = np.concatenate([owner, np.repeat(run, sizes)])
                start = np.concatenate([start, np.repeat(first, sizes) + within])
                runs = _spans(texts, owner, start, span)
                kept = []
                for raw, own in zip(texts, runs, strict=True):
                    edges = [0, *(e for run in own for e in run), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.record_batch(
                    {
                        "doc_id": pa.array([None if i == B.NO_ID else i for i in ids.tolist()], pa.int64()),
                        "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                        "n_removed": pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()),
                        "n_spans": pa.array([len(r) for r in runs], pa.int64()),
                        "starts": pa.array([[a for a, _ in r] for r in runs], pa.list_(pa.int32())),
                        "ends": pa.array([[b for _, b in r] for r in runs], pa.list_(pa.int32())),
                        "kept": pa.array(kept if with_kept else [None] * len(kept), pa.binary()),
                        "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    }
                )

    return with_answers(sorted_out, seen, "seen_strings").mapInArrow(remove, RESULT)


@query()
def op7_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_spans(docs, with_kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
