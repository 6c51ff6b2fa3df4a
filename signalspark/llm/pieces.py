"""SentencePiece encoding and decoding by suffix-array matching.

No piece holds a word mark after another character, so a text falls into chunks (marks, then other characters)
that are encoded on their own. For the chunks of a batch that the worker doesn't know yet:

1. their text is concatenated and indexed by a suffix array (to the length of the longest piece);
2. every piece is binary-searched in it, one character at a time, for its range of occurrences;
3. the occurrences are edges (start, end, piece), sorted by the offset of their end in the chunk;
4. the edges are relaxed in that order: the last piece of each prefix is the piece whose edge starts at a prefix
   whose own last piece can stand before it, that is, no merge of the byte-pair rules crosses the border between
   the two. Exactly one edge into each position passes, and following them back gives the merges' result.

The answers equal the library's for byte-pair models; see ``_Pieces.by_merging`` for runs of word marks, whose
pieces share one score, which leaves their order to the merge loop.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from signalspark.llm.common import Memo, query, release, table, text_slices, unused
from signalspark.llm.token_counts import vocabulary_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bytes of chunks and their ids that start a new memo; the one before is kept beside it, and what is met again moves
#: over. Chunks are held as strings of up to four bytes a character.
MEMO_BYTES = 32 << 20
#: Characters of new chunks that are indexed together.
INDEX_CHARS = 1 << 20
#: Bytes of text whose new chunks are learned together.
BATCH_BYTES = 1 << 22

_models: dict[str, _Pieces] = {}


class _Pieces:
    """Tables of a byte-pair model, as a worker keeps them."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = library.get_piece_size()
        self.texts = [library.id_to_piece(i) for i in range(count)]
        plain = [
            i
            for i in range(count)
            if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))
        ]
        self.bytes = {int(self.texts[i][3:-1], 16): i for i in range(count) if library.is_byte(i)}
        self.ids = {self.texts[i]: i for i in plain}
        self.unknown = count  # stands for a character without a piece until its bytes take its place
        # Merge order: the higher score first.
        order = sorted((i for i in plain if len(self.texts[i]) > 1), key=lambda i: (-library.get_score(i), i))
        self.rank = np.full(count + 1, -1, np.int64)
        self.rank[order] = np.arange(len(order))
        self.rank_of = {self.texts[i]: int(self.rank[i]) for i in order}
        self.longest = max(map(len, self.ids))
        self.left = np.full(count + 1, -1, np.int64)
        self.right = np.full(count + 1, -1, np.int64)
        reached = [i for i in plain if len(self.texts[i]) == 1 or self._split(i)]
        pairs = {}
        for i in order:
            piece = self.texts[i]
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * (count + 1) + b] = int(self.rank[i])
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        # Symbols: 0 is a border or a character without a piece.
        self.alphabet = np.array(sorted(ord(self.texts[i]) for i in plain if len(self.texts[i]) == 1), np.uint32)
        self.match_ids = np.array(reached, np.int64)
        self.match_len = np.array([len(self.texts[i]) for i in reached], np.int64)
        self.match_syms = np.zeros((len(reached), self.longest), np.int64)
        for row, i in enumerate(reached):
            points = np.array([ord(c) for c in self.texts[i]], np.uint32)
            self.match_syms[row, : len(points)] = self._symbols(points)
        self.mark_sizes = {n for n in range(1, self.longest + 1) if MARK * n in self.ids}
        self.lengths = np.ones(count + 1, np.int64)
        self.lengths[self.match_ids] = self.match_len
        self.code = np.uint16 if count < 1 << 16 else np.uint32
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [byte_of.get(i, t.replace(MARK, " ").encode("utf-8")) for i, t in enumerate(self.texts)]
        #: Chunk to its ids, as bytes of the type ``code``.
        self.memo, self.older = Memo(MEMO_BYTES), Memo(MEMO_BYTES)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0)

    def by_merging(self, text: str) -> list[str]:
        """The merge loop itself, for a short string: best rank first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = min(
                ((self.rank_of.get(a + b, 1 << 40), at) for at, (a, b) in enumerate(zip(parts, parts[1:], strict=False))),
                default=(1 << 40, 0),
            )
            if best[0] == 1 << 40:
                return parts
            at = best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _split(self, i: int) -> bool:
        """Notes the last merge that makes piece i; false where the merges never make it."""
        parts = list(self.texts[i])
        while len(parts) > 1:
            ranked = [(self.rank_of.get(a + b, 1 << 40), at) for at, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, at = min(ranked)
            if rank == 1 << 40:
                return False
            if len(parts) == 2:
                self.left[i], self.right[i] = self.ids[parts[0]], self.ids[parts[1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def can_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of pieces a and b.

        Going back in time from the finished pieces, the pair at the border is one part of each, alive until it
        was merged away from the border; the later made part is undone first. A crossing merge of rank r happens
        if r comes before the end of the left part, and not after that of the right one (the leftmost goes first).
        """
        good = np.ones(len(a), bool)
        live = np.flatnonzero((a < self.unknown) & (b < self.unknown))
        x, y = a[live], b[live]
        end_x = np.full(len(live), 1 << 41)
        end_y = np.full(len(live), 1 << 41)
        while len(live):
            keys = x * (self.unknown + 1) + y
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], 1 << 42)
            crossed = (rank < end_x) & (rank <= end_y)
            good[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~crossed & ((rx >= 0) | (ry >= 0))
            undo_x = rx > ry
            end_x = np.where(undo_x, rx, end_x)[on]
            end_y = np.where(undo_x, end_y, ry)[on]
            x, y = np.where(undo_x, self.right[x], x)[on], np.where(undo_x, y, self.left[y])[on]
            live = live[on]
        return good

    def occurrences(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and match rows of all pieces in the text, by a suffix array and binary search.

        Suffixes are sorted by as many characters as fit a number. Those in the range of a longer piece's head are
        sorted on, by the next characters, until no piece is longer; no other suffix needs a deeper order.
        """
        present = np.unique(sym)
        code = np.full(len(self.alphabet) + 1, -1, np.int64)
        code[present[present > 0]] = np.arange(1, 1 + np.count_nonzero(present))
        code[0] = 0
        width = int(len(present) + 1).bit_length()
        padded = np.concatenate([code[sym], np.zeros(2 * self.longest + 62, np.int64)])
        wanted = code[self.match_syms]
        rows = np.flatnonzero((wanted >= 0).all(axis=1))
        wanted = np.concatenate([wanted, np.zeros((len(wanted), 62), np.int64)], axis=1)
        suffixes, group = np.arange(len(sym)), np.zeros(len(sym), np.int64)
        own = np.zeros(len(rows), np.int64)  # the group of suffixes that share a piece's head so far
        done, groups = 0, 1
        found_starts, found_rows = [], []
        while len(rows) and len(suffixes):
            per_word = (62 - groups.bit_length()) // width
            keys, heads = group, own
            for k in range(done, done + per_word):
                keys = (keys << width) | padded[suffixes + k]
                heads = (heads << width) | wanted[rows, k]
            order = np.argsort(keys)
            keys, suffixes = keys[order], suffixes[order]
            rest = np.maximum(done + per_word - self.match_len[rows], 0) * width  # bits that the piece leaves open
            low = np.searchsorted(keys, heads, "left")
            high = np.searchsorted(keys, heads + (np.int64(1) << rest), "left")
            ends = self.match_len[rows] <= done + per_word
            counts = (high - low)[ends]
            found_rows.append(np.repeat(rows[ends], counts))
            inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            found_starts.append(suffixes[np.repeat(low[ends], counts) + inside])
            deeper = ~ends & (high > low)
            rows = rows[deeper]
            begins, own = np.unique(low[deeper], return_inverse=True)
            sizes = np.zeros(len(suffixes), np.int64)
            sizes[low[deeper]] = (high - low)[deeper]
            sizes, groups, done = sizes[begins], max(len(begins), 1), done + per_word
            group = np.repeat(np.arange(len(begins)), sizes)
            inside = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            suffixes = suffixes[np.repeat(begins, sizes) + inside]
        if not found_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_starts), np.concatenate(found_rows)

    def relax(self, chunks: list[str]) -> list[bytes]:
        """Piece ids of each chunk, as bytes of the type ``code``."""
        joined = "\0".join(chunks) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(c) for c in chunks], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        sym = self._symbols(points)
        sym[begins + sizes] = 0
        start, row = self.occurrences(sym)
        piece, length = self.match_ids[row], self.match_len[row]
        owner = np.repeat(np.arange(len(chunks)), sizes + 1)
        loose = np.flatnonzero(sym == 0)
        loose = loose[loose < (begins + sizes)[owner[loose]]]
        start = np.concatenate([start, loose])
        piece = np.concatenate([piece, np.full(len(loose), self.unknown)])
        length = np.concatenate([length, np.ones(len(loose), np.int64)])
        offset = start + length - begins[owner[start]]
        by_end = np.argsort(offset, kind="stable")
        start, piece, length, offset = start[by_end], piece[by_end], length[by_end], offset[by_end]
        last = np.full(len(points) + 1, -1, np.int64)  # last piece of the prefix that ends before this place
        bounds = np.searchsorted(offset, np.arange(1, int(sizes.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            s, p = start[lo:hi], piece[lo:hi]
            opening = offset[lo:hi] == length[lo:hi]
            fits = opening.copy()
            before = last[s]
            fits[~opening] = (before[~opening] >= 0) & self.can_follow(np.maximum(before[~opening], 0), p[~opening])
            last[s[fits] + length[lo:hi][fits]] = p[fits]
        who, at = np.arange(len(chunks)), begins + sizes
        owners, taken, steps = [], [], []
        while len(who):  # back from the ends, all chunks at once
            more = at > begins[who]
            at, who = at[more], who[more]
            owners.append(who)
            taken.append(last[at])
            steps.append(np.full(len(who), -len(steps)))
            at = at - self.lengths[taken[-1]]
        owner, ids = np.concatenate(owners), np.concatenate(taken)
        order = np.lexsort((np.concatenate(steps), owner))
        ids, counts = ids[order], np.bincount(owner, minlength=len(chunks))
        ends = np.cumsum(counts)
        strange = np.bincount(owner[order], weights=ids == self.unknown, minlength=len(chunks)) > 0
        raw, wide = ids.astype(self.code).tobytes(), np.dtype(self.code).itemsize
        found = [raw[a * wide : b * wide] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        for k in np.flatnonzero(strange).tolist():
            found[k] = self._with_bytes(chunks[k], ids[ends[k] - counts[k] : ends[k]].tolist())
        return found

    def learn(self, chunks: list[str]) -> None:
        """Put new chunks into the memo; runs of marks follow from the chunk after them."""
        runs = [c for c in chunks if MARK * 2 in c]
        plain = {c for c in chunks if MARK * 2 not in c} | {MARK + c.lstrip(MARK) for c in runs}
        held: list[str] = []
        size = 0
        for chunk in [*sorted(plain - self.memo.keys(), key=len), None]:
            if held and (chunk is None or size + len(chunk) > INDEX_CHARS):
                self.memo.learn(held, self.relax(held))
                held, size = [], 0
            if chunk is not None:
                held.append(chunk)
                size += len(chunk) + 1
        self.memo.learn(runs, [self._marks_first(chunk) for chunk in runs])

    def _marks_first(self, chunk: str) -> bytes:
        """A run of marks and what follows it.

        Pieces of marks alone have the lowest score: whatever can merge with the last mark does so first. So the
        run without its last mark is merged on its own unless the rest leaves that mark alone.
        """
        body = chunk.lstrip(MARK)
        run = len(chunk) - len(body)
        ids: list[int] = []
        if body:
            ids = np.frombuffer(self.memo[MARK + body], self.code).tolist()
            if ids[0] == self.ids[MARK]:
                ids = ids[1:]
            else:
                run -= 1
        # Equal scores: merges go from left to right, each new piece at the left end growing first.
        return np.array(self._mark_run(run) + ids, self.code).tobytes()

    def _mark_run(self, run: int) -> list[int]:
        parts = [1] * run
        at = 0
        while at + 1 < len(parts):
            if parts[at] + parts[at + 1] in self.mark_sizes:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                at = max(at - 1, 0)
            else:
                at += 1
        return [self.ids[MARK * n] for n in parts]

    def _with_bytes(self, text: str, ids: list[int]) -> bytes:
        """Bytes in place of the characters that have no piece."""
        out: list[int] = []
        at = 0
        for i in ids:
            if i == self.unknown:
                out += [self.bytes[b] for b in text[at].encode("utf-8")]
                at += 1
            else:
                out.append(i)
                at += len(self.texts[i])
        return np.array(out, self.code).tobytes()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The piece ids of each UTF-8 text."""
        if self.memo.bytes > MEMO_BYTES:
            self.memo, self.older = Memo(MEMO_BYTES), self.memo
        split = [
            CHUNK.findall(MARK + text.decode("utf-8", "replace").replace(" ", MARK)) if text else [] for text in texts
        ]
        new = set(chain.from_iterable(split)) - self.memo.keys()
        again = new & self.older.keys()
        self.memo.learn(list(again), [self.older[c] for c in again])
        self.learn(list(new - again))
        known = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(known, chunks)), self.code) for chunks in split]

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; the mark in front of the first word goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def pieces(model: str = MODEL) -> _Pieces:
    if model not in _models:
        _models[model] = _Pieces(vocabulary_path(model))
    return _models[model]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(one) for one in ids])]).astype(np.int32)
    values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encoded(text: Column, model: str = MODEL) -> Column:
    """array<int> of the piece ids of a text, without begin and end; empty for null and empty texts."""

    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ids = [one for held in text_slices(texts, BATCH_BYTES) for one in pieces(model).encode(held)]
        lists = _lists(ids)
        del ids
        release()
        return lists

    return encode(text)


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text of an array of piece ids; null stays null.

    A text round-trips unless it holds the word mark itself, which comes back as a space.
    """

    @arrow_udf("string")
    def decode(arrays: pa.Array) -> pa.Array:
        own = pieces(model)
        return pa.array([own.decode(a.values.to_pylist()) if a.is_valid else None for a in arrays], pa.string())

    return decode(ids)


def coded(text: Column, model: str = MODEL) -> Column:
    """struct<ids, round_trip>: the piece ids of a text, and whether decoding them gives the text again.

    The word mark itself comes back as a space, which counts as the same text; so does null as the empty one. One
    function does both: chained ones would be run together, and the first of them twice.
    """

    @arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def code(texts: pa.Array) -> pa.Array:
        own = pieces(model)
        ids, same = [], []
        for held in text_slices(texts, BATCH_BYTES):
            got = own.encode(held)
            ids += got
            same += [
                own.decode(one.tolist()) == raw.decode("utf-8", "replace").replace(MARK, " ")
                for one, raw in zip(got, held, strict=True)
            ]
        lists = _lists(ids)
        del ids
        release()
        return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "round_trip"])

    return code(text)


def with_pieces(
    docs: DataFrame, text: str = "text", model: str = MODEL, out: str = "piece_ids", check: str = "round_trip"
) -> DataFrame:
    """Adds the piece ids and whether they decode to the text; columns of these names are replaced.

    Rows are kept as they are, repeated ones too; null and empty texts have no pieces, an empty table stays empty.
    Texts of any length are encoded whole.
    """
    held = unused(docs, "_coded")
    got = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (out, check)], coded(F.col(text), model).alias(held))
    return got.withColumns({out: F.col(held)["ids"], check: F.col(held)["round_trip"]}).drop(held)


@query()
def op5_sentencepiece(spark, sf_dir):
    """Every document's piece ids, and whether decoding them gives the text again."""
    docs = with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")
