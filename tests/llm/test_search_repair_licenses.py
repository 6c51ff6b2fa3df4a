"""Ranked search, conversation repair and license scans against brute force, on awkward rows and small blocks."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from functools import cache

import pytest

from signalspark.llm import conversations, licenses, ranked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rowset(df):
    return Counter(tuple(r) for r in df.collect())


# Ranked search.


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, top=10):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, words = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = Counter()
    for item, own in asked.items():
        scores = []
        for d, c in counted:
            m = 10 + 90 * c.total() * n // words
            gains = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c]
            if sum(gains) > 0:
                scores.append((-sum(gains), d is not None, d, sum(gains)))
        for rank, (_, _, d, score) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top], 1):
            out[item, rank, d, score] += 1
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in {"BLOCK_POSTINGS": 50, "QUERY_BYTES": 300, "CELLS": 64, "FIRST_STRATA": 2}.items():
        monkeypatch.setattr(ranked, name, value)


def corpus(rng, count):
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 8, 8, 8, 40, 200]))) for _ in range(count)]
    return texts + [None, "", " .,- ", "ÜN ün\x00été", "A a; A-b_c", " ".join(vocabulary * 30), texts[0], texts[0]]


DOCS = "doc_id long, text string, term string, m string, items string"


def test_search_equals_brute_force(texts_spark, small_blocks):
    rng = random.Random(4)
    docs = list(enumerate(corpus(rng, 120))) + [(None, "w1 w2 w3"), (3, "w1 w1 w1"), (3, "w1 w1 w1")]
    items = [(k, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(12))) for k in range(15)]
    items += [(None, "w1 a"), (90, None), (91, "nowhere"), (92, "été A"), (93, "w1"), (93, "w2 w2"), (93, "w2 w2")]
    frame = texts_spark.createDataFrame([(*d, "x", "x", "x") for d in docs], DOCS).repartition(3)
    asked = texts_spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, number string")
    assert rowset(ranked.search(ranked.build_index(frame), asked)) == brute_search(docs, items)


def test_search_with_many_equal_scores(texts_spark, small_blocks):
    docs = [(k, "same words here") for k in range(300)] + [(k, f"other {k}") for k in range(300, 420)]
    items = [("a", "same words"), ("b", "other 301 302")]
    got = ranked.search(ranked.build_index(texts_spark.createDataFrame(docs, "doc_id long, text string")), texts_spark.createDataFrame(items, "item_id string, text string"), top=25)
    assert rowset(got) == brute_search(docs, items, 25)


def test_search_of_nothing(texts_spark):
    none = texts_spark.createDataFrame([], "doc_id long, text string")
    items = texts_spark.createDataFrame([(1, "a b")], "item_id long, text string")
    one = texts_spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ranked.search(ranked.build_index(none), items).count() == 0
    assert ranked.search(ranked.build_index(one), items.where("false")).count() == 0


# Conversation repair.


def brute_repair(rows):
    """Rows in order: counts, cost, audit and digest."""
    marked, seen = [], set()
    for role, text in rows:
        words = re.sub("[\x20\x09-\x0d]+", "", text)
        kind = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        if words:
            seen.add((role, text))
        marked.append((role, text, kind))
    after = {"0s": "S", "0u": "U", "Su": "U", "Ua": "A", "Au": "U"}
    forced = {"0": "U", "S": "U", "U": "A", "A": "U"}
    named = {"U": "user", "A": "assistant"}

    @cache
    def best(i, q, inserted):
        found = []
        if i == len(marked):
            if q in "0A":
                found.append((0, "", ()))
        else:
            role, text, kind = marked[i]
            extra = 3 * (kind == "truncated")
            c, a, r = best(i + 1, q, 0)
            found.append((c + 4, "D" + a, r))
            if kind not in ("blank", "duplicate"):
                if q + role[:1] in after:
                    c, a, r = best(i + 1, after[q + role[:1]], 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}", *r)))
                c, a, r = best(i + 1, forced[q], 0)
                found.append((c + extra + 3, "R" + a, (f"{named[forced[q]]}:{text}", *r)))
        if inserted < 3:
            c, a, r = best(i, forced[q], inserted + 1)
            found.append((c + 3, "I" + a, (named[forced[q]] + ":", *r)))
        return min(found, default=(10**9, "", ()))

    cost, audit, out = best(0, "0", 0)
    kinds = Counter(k for _, _, k in marked)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, digest


def brute_conversations(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = Counter()
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = {t for known, t, _, _ in own if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv, gaps, *brute_repair([r[2:] for r in own])] += 1
    return out


def repaired(df, **sizes):
    mended = conversations.repair(df, **sizes)
    digest = conversations.digests(mended.edits).withColumnRenamed("conv", "_conv")
    both = mended.conversations
    both = both.join(digest, both["conv"].eqNullSafe(digest["_conv"]))
    names = ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return mended, rowset(both.select(*names))


def talk(rng, count):
    roles = ["user", "assistant", "system", "User", "", "tool", "uncle", "sage"]
    out = []
    for _ in range(count):
        text = rng.choice(["", " \n", "Yes.", "cut off", "why?", f"n{rng.randrange(10**6)}.", f"n{rng.randrange(10**6)}"])
        out.append((rng.choices(roles, [9, 9, 2, 1, 1, 1, 1, 1])[0], text))
    return out


ROWS = "conv long, turn long, role string, text string, chunk string, at string"


@pytest.mark.parametrize(("chunk_rows", "fixups"), [(4096, 6), (5, 6), (3, 0), (1, 1)])
def test_repair_equals_brute_force(texts_spark, chunk_rows, fixups):
    rng = random.Random(chunk_rows)
    rows = [(conv, turn, *r) for conv in range(60) for turn, r in enumerate(talk(rng, rng.randrange(1, 12)))]
    rows += [(None, turn, *r) for turn, r in enumerate(talk(rng, 30))]
    rows += [(100, k, *r) for k, r in enumerate(talk(rng, 40))]
    rows += [(101, k, "user", "same.") for k in range(40)] + [(101, 99, "assistant", "end.")]  # all but one deleted
    rows += [(102, k, "user", f"cut {k}") for k in range(40)]  # differences between vectors are handed on
    rows += [(103, None, None, None), (103, None, "user", "a."), (103, 7, "assistant", None), (104, None, "assistant", "b.")]
    rows += [(105, 5, "user", "tie."), (105, 5, "assistant", "tie!"), (105, 9, "user", "x" * 50_000), (105, -4, "system", "s.")]
    df = texts_spark.createDataFrame([(*r, "x", "x") for r in rows], ROWS).repartition(3)
    mended, got = repaired(df, chunk_rows=chunk_rows, fixups=fixups)
    assert got == brute_conversations(rows)
    by = defaultdict(list)
    for r in mended.rows().collect():
        by[r.conv].append((r.at, r.seq, r.role, r.text))
    for conv, *_, audit, digest in got:
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in sorted(by[conv])).encode()).hexdigest() == digest
        assert len(by[conv]) == len(audit) - audit.count("D")


def test_repair_of_nothing(texts_spark):
    mended, got = repaired(texts_spark.createDataFrame([], ROWS))
    assert not got and mended.rows().count() == 0


# License scans.


def brute_licenses(docs, templates):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))

    def pairs(own):
        return set(zip(own, own[1:], strict=False))

    out = Counter()
    for doc, text in docs:
        text, every = text or "", words(text or "")
        base = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(every)) if every[i : i + len(phrase.split())] == phrase.split()]
        blocks, part = [], []
        for line in [*text.split("\n"), ""]:
            blocks.append(words(line))
            if not blocks[-1]:
                blocks.append(part)
                part = []
            part = part + words(line)
        found = set()
        for own in blocks:
            for label, template in templates:
                t = pairs(words(template))
                if t and 4 * len(t & pairs(own)) >= 3 * len(t):
                    found.add((label, round(len(t & pairs(own)) / len(t), 9)))
        out[doc, len(every), tuple(sorted(base)), tuple(sorted(found))] += 1
    return out


def test_licenses_equal_brute_force(texts_spark):
    rng = random.Random(8)
    bits = [t for _, t in licenses.TEMPLATES] + list(licenses.PHRASES)
    docs = []
    for k in range(150):
        text = ""
        for _ in range(rng.randrange(6)):
            own = rng.choice(bits).split()
            own = [w for w in own if rng.random() < 0.95] if rng.random() < 0.6 else own
            text += rng.choice(["\n", " ", "\n\n", "\n--\n", " filler words, "]) + rng.choice(["\n", " ", " ", " "]).join(own)
        docs.append((k, text))
    docs += [(200, None), (201, ""), (202, " \n\n "), (203, "cc by"), (203, "cc by"), (None, "CC-BY all rights reserved"), (204, "cc cc by by")]
    docs += [(205, "filler " * 30_000 + "Released under the MIT License " + "words\n" * 30_000), (206, "ßé cc by 中文")]
    frame = texts_spark.createDataFrame([(*d, "x", "x") for d in docs], "doc_id long, text string, row string, blocks string")
    got = Counter()
    for r in licenses.find_licenses(frame.repartition(3)).collect():
        base = tuple(sorted((b["at"], b["label"]) for b in r.base))
        best = {(f["label"], round(f["share"], 9)) for f in r.found}
        got[r.id, r.n_words, base, tuple(sorted(best))] += 1
    assert got == brute_licenses(docs, licenses.TEMPLATES)
    assert licenses.find_licenses(frame.where("false")).count() == 0
    short = licenses.find_licenses(frame, templates=[("one", "word"), ("none", "")])
    assert all(not r.found for r in short.collect())


def test_too_many_templates():
    with pytest.raises(ValueError):
        licenses.Vocabulary([("long", "word " * licenses.TEMPLATE_BYTES)])
