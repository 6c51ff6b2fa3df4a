"""The text operators against brute force, the libraries and SQL, with nulls, empty tables and repeated rows."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from signalspark.llm import blocks, decontaminate, fertility, jaccard, langid, pieces, quality, queries, secrets, shards, suffixes
from signalspark.llm import token_counts
from signalspark.llm.common import drawn
from signalspark.llm.components import connected

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "benchmark", "labels", "conversations")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, piece_ids string"
QUERIES, SQL = queries.load()


def words(rng, count):
    return [rng.choice("the of and thing word tree house river stone light green seven".split()) + rng.choice(["", "s", "er"]) for _ in range(count)]


@pytest.fixture(scope="module")
def awkward(texts_spark):
    """Nulls, blanks, one very long text, repeated rows, copies, near copies and clashing column names."""
    rng = random.Random(5)
    base = words(rng, 200)
    near = base[:100] + ["changed"] + base[101:]
    texts = [None, "", "  \n\t ", "one two three", "ONE two three", " ".join(base), " ".join(base), " ".join(near)]
    texts += [" ".join(words(rng, 60)) for _ in range(6)] + ["x" * 30_000, " ".join(words(rng, 4_000)), "ünï çödé 中文 🙂 " * 20]
    rows = [(i, t, "en" if i % 3 else None, "s", 0, "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[5], (None, " ".join(base), None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return texts_spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(texts_spark):
    return texts_spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(texts_spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](texts_spark, SF).select(columns).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want.fetchall()))


def test_token_counts_equal_the_library(awkward):
    got = token_counts.with_token_counts(awkward).select("text", "n_tokens").collect()
    library = token_counts.load_tokenizer(token_counts.VOCABULARY)
    for row in got:
        assert row.n_tokens == len(library.encode(row.text or "", add_special_tokens=False))


def test_token_counts_of_special_strings():
    rng = random.Random(1)
    bits = ["a", "É", " ", "\n", "<|endoftext|>", "<|startoftext|>", "'s", "Σ", "中文", "1", "!!", "\x1c", "́", " "]
    texts = ["".join(rng.choices(bits, k=rng.randrange(25))) for _ in range(500)]
    library = token_counts.load_tokenizer(token_counts.VOCABULARY)
    want = [len(library.encode(t, add_special_tokens=False)) for t in texts]
    assert token_counts.count_texts([t.encode() for t in texts]) == want


def test_pieces_equal_the_library_and_decode(awkward):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path(pieces.MODEL))
    rows = pieces.with_pieces(awkward.select("doc_id", "text")).withColumn("back", pieces.decoded(F.col("piece_ids"))).collect()
    for row in rows:
        assert row.piece_ids == library.encode(row.text or "")
        assert row.back == (row.text or "")
    rng = random.Random(2)
    bits = ["a", " ", "\n", "  ", "the", "ing", "中", "🙂", "▁", "\x00", "0", "ation", "ß", "    "]
    texts = ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(400)]
    got = pieces.pieces().encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == library.encode(texts)


def brute_components(rows):
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = [x for x in re.split("[\x20\x09-\x0d]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
        sets[k] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = defaultdict(lambda: 1 << 60)
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(k)] = min(least[root(k)], doc)
    return sets, [None if d is None else d if not sets[k] else least[root(k)] for k, (d, _) in enumerate(rows)]


def test_jaccard_components(awkward, empty):
    rows = texts_of(awkward)
    sets, component = brute_components(rows)
    want = Counter((d, len(sets[k]), component[k]) for k, (d, _) in enumerate(rows))
    got = jaccard.near_duplicates(awkward).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == want
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_chains_and_large_groups(texts_spark):
    """Texts that are linked only through others, and many near copies that don't all link with the first."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(120):
        own = list(base)
        for k in rng.sample(range(120), rng.randrange(0, 6)):
            own[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    for k in range(30):  # a chain
        texts.append(" ".join(f"c{i}" for i in range(5 * k, 5 * k + 80)))
    docs = texts_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    want = brute_components(list(enumerate(texts)))[1]
    assert [got[k] for k in range(len(texts))] == want


def test_jaccard_pairs_of_a_group_of_near_copies(texts_spark, monkeypatch):
    """Near copies of which some are similar only to the least changed ones: no pair comes again for each token."""
    rng = random.Random(4)
    texts = []
    for _ in range(300):
        own = [f"w{i}" for i in range(150)]
        for k in rng.sample(range(150), rng.randrange(6)):
            own[k] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    made, verified = [], jaccard._verified

    def counted(pairs, *more):
        made.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(jaccard, "_verified", counted)
    docs = texts_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute_components(list(enumerate(texts)))[1]
    assert made[-1] < 2 * len(texts), made


def test_connected_components(texts_spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.component for r in connected(texts_spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert connected(texts_spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(rows):
    last = 1 << 61
    rows = [(last if d is None else d, t.encode()) for d, t in rows]
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((None if d == last else d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeated_bytes(awkward, empty):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = suffixes.repeated_spans(awkward, with_kept=False).select(*columns).collect()
    assert Counter(map(tuple, got)) == brute_spans(texts_of(awkward))
    assert suffixes.repeated_spans(empty).count() == 0


def colliding_strings(of_run):
    """Two 50-byte texts with one leading token whose string hashes (or run hashes) agree in the 32 bits that are kept
    of 150 bytes of text, and differ."""
    import numpy as np

    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    heads = [bytes(h) for h in letters[rng.integers(0, 26, (20_000, 24))]]
    tokens = suffixes._mix(suffixes._rolling(np.frombuffer(b"".join(heads), np.uint8), (24,))[0][::24])
    head, token = heads[int(tokens.argmin())], tokens.min()
    texts = [head + bytes(t) for t in letters[rng.integers(0, 26, (400_000, 26))]]
    lead = np.concatenate([part[3] for part in suffixes.leads_of(texts, 50, 24)])
    if of_run:
        data = np.frombuffer(b"".join(texts), np.uint8)
        keys = suffixes.row_hashes(blocks.byte_rows(data, np.arange(len(texts)) * 50, np.full(len(texts), 50), 99))
    else:
        keys = np.concatenate([part[2] for part in suffixes.strings_of(texts, 50)])
    seen = {}
    for o, (own, key) in enumerate(zip(lead.tolist(), (keys >> np.uint64(32)).tolist(), strict=True)):
        if own == token and texts[seen.setdefault(key, o)] != texts[o]:
            return texts[seen[key]].decode(), texts[o].decode()
    raise AssertionError(f"no match among {len(keys)} strings")


@pytest.mark.parametrize("of_run", [False, True])
def test_repeated_bytes_of_equal_hashes_are_compared(texts_spark, of_run):
    one, other = colliding_strings(of_run)
    rows = [(1, one), (2, other), (3, other)]
    docs = texts_spark.createDataFrame(rows, "doc_id long, text string")
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = suffixes.repeated_spans(docs.coalesce(1), with_kept=False).select(*columns).collect()
    assert Counter(map(tuple, got)) == brute_spans(rows)
    apart = suffixes.repeated_spans(docs.repartition(3, "doc_id"), with_kept=False).select(*columns).collect()
    assert Counter(map(tuple, apart)) == brute_spans(rows)


def test_repeated_bytes_of_the_test_table(texts_spark):
    docs = texts_spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op7_suffix_dedup"](texts_spark, SF).collect()
    assert Counter(map(tuple, got)) == brute_spans(texts_of(docs))


def test_decontamination_with_short_items(texts_spark, awkward, empty):
    items = [(1, "three"), (2, "TWO three"), (3, None), (4, "..."), (5, "one two"), (6, "changed")]
    bench = texts_spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(awkward, bench).collect() if r.doc_id is not None}
    assert got[3].item_ids == ["1", "2", "5"] and got[3].n_hit == 3 and got[4].n_hit == 3
    assert got[7].item_ids == ["6"] and got[7].n_hit == 1
    assert got[0].n_words == 0 and got[0].n_hit == 0
    assert decontaminate.contamination(awkward, bench).count() == awkward.count()
    assert decontaminate.contamination(empty, bench).count() == 0
    nothing = texts_spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.contamination(awkward, nothing).collect())


def brute_base(text):
    found = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_scan(texts_spark, empty):
    key, rare = "AKIA" + "QZ7" * 6, "f3a9" * 8
    texts = [None, "", f"🙂 {key} {key}", f"PassWord = '{rare}' x", "secret:token:abcdefgh", "token=token=abc123", f"{rare}g{rare}", "api_key: short"]
    texts += ["xK9vQ2mZ7pR4tW8yB3nL6cD1 and the ordinary words of a text", "ordinary words only of some length"]
    docs = texts_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = [("ordinary_words_of_texts", False), ("the_length_of_words", False)] * 20
    noise = [("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=40)), True) for i in range(200)]
    ratios = secrets.fit_models(texts_spark.createDataFrame(plain + noise, "token string, is_random boolean"))
    rows = secrets.redacted(secrets.find_secrets(docs.withColumn("hex", F.lit("clash")), ratios=ratios).withColumn("old", F.col("text"))).collect()
    for row in rows:
        got = sorted((x.s, k, x.e) for k, kind in enumerate(secrets.KINDS[:3]) for x in row[kind])
        assert got == brute_base(texts[row.doc_id] or "")
        assert all(x.t == texts[row.doc_id][x.s : x.e] for kind in secrets.KINDS for x in row[kind])
    by_id = {r.doc_id: r for r in rows}
    assert [x.t for x in by_id[8].markov] == ["xK9vQ2mZ7pR4tW8yB3nL6cD1"]
    assert by_id[8].text == "[SECRET] and the ordinary words of a text" and by_id[9].text == texts[9]
    assert by_id[2].text == "🙂 [SECRET] [SECRET]" and by_id[0].text is None
    assert secrets.find_secrets(empty, ratios=ratios).count() == 0


def test_secrets_of_very_long_texts(texts_spark):
    """A run of 10^5 characters, thousands of matches, texts without spaces and beyond the basic plane; clashing columns."""
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    ratios = secrets.fit_models(
        texts_spark.createDataFrame(
            [("ordinary_words_of_texts", False)] * 20 + [("".join(rng.choices(letters, k=40)), True) for _ in range(200)],
            "token string, is_random boolean",
        )
    )
    run = "".join(rng.choices(letters, k=100_000))
    many = "".join(f"ü🙂{'🙂' * rng.randrange(3)} token={rng.randrange(10**7, 10**8)} " for _ in range(3_000))
    texts = [run, many, "🙂" * 5_000 + " AKIA" + "QZ7" * 6 + "🙂" * 2_047, "中" * 30_000]
    docs = texts_spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], "doc_id long, text string, _every string, _upto string, _blocks string")
    found = secrets.find_secrets(docs, ratios=ratios)
    for row in secrets.redacted(found.withColumn("old", F.col("text"))).collect():
        text = texts[row.doc_id]
        assert sorted((x.s, k, x.e) for k, kind in enumerate(secrets.KINDS[:3]) for x in row[kind]) == brute_base(text)
        spans = sorted((x.s, x.e) for kind in secrets.KINDS for x in row[kind])
        want, at = "", 0
        for s, e in spans:
            want += text[at:s] + "[SECRET]" if s >= at else ""
            at = max(at, e)
        assert row.text == want + text[at:] and (row._every, row._upto, row._blocks) == ("a", "b", "c")
        for x in row.markov:
            codes = [secrets.ALPHABET.index(c) for c in x.t]
            ratio = sum(ratios[a * len(secrets.ALPHABET) + b] for a, b in zip(codes, codes[1:]))
            assert ratio >= secrets.LEAST_SUM - 0.01 * len(codes) and ratio >= (secrets.LEAST_MEAN - 0.01) * (len(codes) - 1)


def test_secret_ratios_by_brute_force(texts_spark):
    """A run is a span if and only if the models' ratio says so."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    labelled = [("the_ordinary_words_of_some_texts", False)] * 30 + [("".join(rng.choices(letters, k=40)), True) for _ in range(300)]
    ratios = secrets.fit_models(texts_spark.createDataFrame(labelled, "token string, is_random boolean"))
    runs = ["".join(rng.choices(letters, k=rng.randrange(16, 60))) for _ in range(200)]
    runs += ["_".join(rng.choices("the ordinary words of some texts".split(), k=rng.randrange(4, 9))) for _ in range(200)]
    runs += [a[:12] + b[:12] for a, b in zip(runs[:200], runs[200:])]
    docs = texts_spark.createDataFrame([(i, f"({r})") for i, r in enumerate(runs)], "doc_id long, text string")
    got = {r.doc_id: [(x.s, x.e) for x in r.markov] for r in secrets.find_secrets(docs, ratios=ratios).collect()}
    ratios, verdicts = [round(r, 5) for r in ratios], Counter()
    for i, run in enumerate(runs):
        codes = [secrets.ALPHABET.index(c) for c in run]
        ratio = sum(ratios[a * len(secrets.ALPHABET) + b] for a, b in zip(codes, codes[1:]))
        want = len(run) >= 16 and ratio >= secrets.LEAST_SUM and ratio >= secrets.LEAST_MEAN * (len(run) - 1)
        assert got[i] == ([(1, 1 + len(run))] if want else [])
        verdicts[want, i // 200] += 1
    assert verdicts[True, 0] > 150 and verdicts[True, 1] == 0


def test_rules_judge_short_texts(texts_spark):
    """Characters per token, byte share and entropy count at every length."""
    rng = random.Random(8)
    clean = ["The river runs past the old stone house and the green fields where seven people met in the light of the morning sun"]
    clean += ["A short note says that every member of the group should bring one book and read a part of it to all the others"]
    garbled = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=5)) for _ in range(24)) for _ in range(3)]
    garbled += ["a b " * 15, " ".join(["word"] * 22)]
    docs = texts_spark.createDataFrame([(i, t, "clash") for i, t in enumerate(clean + garbled)], "doc_id long, text string, _m string")
    rows = {r.doc_id: r for r in fertility.with_rules(docs).collect()}
    assert all(r.fit[0].n_tokens < 130 and r._m == "clash" for r in rows.values())
    assert [rows[i].kept for i in range(len(rows))] == [True] * len(clean) + [False] * len(garbled)


def test_quality_of_many_copies(texts_spark, awkward, empty):
    """A text that most rows share is dealt to all partitions; awkward rows get scores, copies the same one."""
    rows = [(i, "the same copied text of many rows" if i % 3 else f"own text {i}", i % 2) for i in range(300)]
    examples = texts_spark.createDataFrame(rows, "doc long, text string, label int")
    weights = quality.fit(examples, doc="doc")
    got = awkward.select("doc_id", "text", quality.quality_score(F.col("text"), weights).alias("s")).collect()
    by_text = defaultdict(set)
    for r in got:
        assert 0 <= r.s <= 1
        by_text[r.text or ""].add(r.s)
    assert len(got) == awkward.count() and all(len(s) == 1 for s in by_text.values())
    assert empty.select(quality.quality_score(F.col("text"), weights)).count() == 0


def test_quality_rules(awkward, empty):
    rows = fertility.with_rules(awkward).collect()
    assert len(rows) == awkward.count()
    for row in rows:
        w = (row.text or "").encode().split()
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(8)}
        assert (row.n_words, row.n_repeat_words) == (len(w), len(hit))
        assert row.word_chars == len(b"".join(w).decode())
        assert row.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (row.base_failed and row.kept)
    assert fertility.with_rules(empty).count() == 0


def test_shards_hold_near_equal_bytes(texts_spark, awkward, empty):
    docs = texts_spark.read.parquet(f"{SF}/documents.parquet")
    many = docs.unionByName(docs.limit(60).withColumn("text", F.lit("copy " * 60)), allowMissingColumns=True)
    rows = shards.kd_shards(many, shards=4).toPandas()
    sums = rows.groupby("shard")["size"].sum()
    assert sums.max() < 1.15 * sums.min() and len(rows) == many.count()
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert (rows.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
    assert shards.kd_shards(awkward, shards=4).count() == awkward.count()
    assert shards.kd_shards(empty).count() == 0


def test_language_of_held_out_texts(texts_spark, awkward, empty):
    truth = {r.doc_id: r.lang for r in texts_spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op2_language_mixture"](texts_spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.95 * len(rows) and rows
    languages, logs = langid.fit(awkward)
    got = awkward.select("text", langid.language(F.col("text"), languages, logs).alias("l")).collect()
    assert all(r.l.lang == "und" and r.l.score == 0 for r in got if not (r.text or "").strip())
    assert all(0 <= r.l.score <= 1 for r in got)
    assert langid.fit(empty)[0] == []


def test_training_sample_of_very_many_rows(texts_spark):
    """A bound under a millionth of the rows still draws, copies count once, and a rare language is kept."""
    texts = texts_spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "the one copied text").otherwise(F.concat(F.lit("words of text "), F.col("id").cast("string"))).alias("text"),
        F.when(F.col("id") == 4, "xx").otherwise("en").alias("lang"),
    )
    some = drawn(texts, "text", 300, "lang", 20).collect()
    assert 200 < len(some) < 400 and len({r.text for r in some}) == len(some) and "xx" in {r.lang for r in some}
    assert langid.fit(texts, bound=1)[0] == ["en", "xx"]
    many = texts_spark.range(3_000_000).select("id", F.concat(F.lit("words of text "), F.col("id").cast("string")).alias("text"))
    labels = many.select("id", (F.col("id") == 7).cast("int").alias("label"))
    got = Counter(r.label for r in quality.examples_of(many, labels, "id", "text", "label", 2).collect())
    assert 800 < got[0] < 1_200 and got[1] == 1
    assert secrets.corpus_samples(many, "text", 2).count() > 0
    with pytest.raises(ValueError):
        drawn(texts, "text", 0)
    assert drawn(texts.limit(0), "text", 10).count() == 0


def test_mixture_of_two_languages():
    scores = __import__("numpy").array([[0.0, -9.0, -9.0]] * 30 + [[-9.0, 0.0, -9.0]] * 10)
    shares, n = langid.mixtures(scores, __import__("numpy").zeros(40, int), 1)
    assert n[0] == 40 and abs(shares[0][0] - 0.75) < 0.01 and abs(shares[0][1] - 0.25) < 0.01 and shares[0][2] == 0


def test_mixtures_do_not_depend_on_their_neighbours():
    import numpy as np

    # The second language by share gains little, the third one much: one more language is worth it only with both.
    three = np.array([[0.0, -9.0, -9.0]] * 60 + [[-3.5, 0.0, -9.0]] * 6 + [[-30.0, -30.0, 0.0]] * 2)
    mixed = np.array([[0.0, -9.0, -9.0]] * 30 + [[-9.0, 0.0, -9.0]] * 30)
    plain = np.array([[0.0, -9.0, -9.0]] * 50)
    alone = langid.mixtures(three, np.zeros(68, int), 1)[0][0]
    both = langid.mixtures(np.concatenate([plain, three, mixed]), np.repeat([0, 2, 3], [50, 68, 60]), 5)[0]
    assert alone[2] > 0 and (both[2] == alone).all() and (both[0] == [1, 0, 0]).all() and not both[[1, 4]].any()


def test_mixture_of_seven_languages():
    import numpy as np

    scores = np.where(np.eye(7, dtype=bool), 0.0, -9.0).repeat(30, axis=0)
    shares, _ = langid.mixtures(scores, np.zeros(210, int), 1)
    assert (abs(shares[0] - 1 / 7) < 0.01).all()


def test_quality_of_held_out_texts(texts_spark):
    truth = {r.doc_id: r.quality for r in texts_spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op3_quality_ftrl"](texts_spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.85 * len(rows)
    nothing = quality.fit(texts_spark.createDataFrame([], "text string, label int"))
    one = texts_spark.createDataFrame([(None,), ("",), ("words",)], "text string")
    assert [r.s for r in one.select(quality.quality_score(F.col("text"), nothing).alias("s")).collect()] == [0.5] * 3


def test_pipeline_against_its_parts(texts_spark):
    import corpus_pipeline

    out = {r.doc_id: r for r in corpus_pipeline.run(texts_spark, SF).collect()}
    docs = texts_spark.read.parquet(f"{SF}/documents.parquet")
    kept = [r for r in fertility.with_rules(docs).where("kept").select(*docs.columns).collect()]
    component = brute_components([(r.doc_id, r.text or "") for r in kept])[1]
    left = {r.doc_id: r for r, c in zip(kept, component, strict=True) if c == r.doc_id}
    spoiled = {r.doc_id for r in QUERIES["op1_winnowing"](texts_spark, SF).where("contaminated").collect()}
    assert set(out) == set(left) - spoiled
    for doc, row in out.items():
        assert row.round_trip and row.n_chars == len(row.text)
        if row.text != left[doc].text:
            assert "[SECRET]" in row.text


def test_pipeline_stages_on_awkward_rows(texts_spark, awkward, empty):
    import corpus_pipeline

    for docs in (awkward, empty):
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(texts_spark, docs, SF)
            assert out.columns[: len(docs.columns)] == docs.columns or at == len(corpus_pipeline.STAGES) - 1
            assert out.count() <= docs.count()


def test_pipeline_sends_texts_in_small_batches(texts_spark, monkeypatch):
    """Long texts go to Python a few at a time, whatever the rows of a batch may be."""
    import corpus_pipeline
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("long")
    def together(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    monkeypatch.setattr(corpus_pipeline, "with_rules", lambda docs: docs.withColumn("kept", together("text") < (4 << 20)))
    docs = texts_spark.range(2_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1_000).alias("text"))
    try:
        assert corpus_pipeline.quality_rules(texts_spark, docs, SF).count() == 2_000
    finally:
        texts_spark.conf.unset(corpus_pipeline.BATCH_SETTING)


def test_pipeline_secret_scan_holds_texts_once(texts_spark):
    import corpus_pipeline

    docs = texts_spark.createDataFrame([(1, "token=abc123def", "a"), (2, None, None)], "doc_id long, text string, hex string")
    out = corpus_pipeline.without_secrets(texts_spark, docs.withColumn("n_chars", F.length("text").cast("long")), SF)
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "[SECRET]", "a", 8), (2, None, None, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct(doc_id" not in plan and "_row" not in plan
