"""Secret scans in DataFrame functions only: base patterns, and character Markov models.

Two first-order Markov models over the characters of identifiers, one of random strings and one of ordinary
words, are trained from labelled samples. A run of identifier characters is a secret if the log-likelihood ratio of
its transitions, random against ordinary, is high enough in sum and on average.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.common import drawn, query, table, unused

# Fixed patterns of the base scan: kind, pattern, shortest match, regex group whose length counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Runs that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Log-likelihood ratio of a secret: in all, and per transition.
LEAST_SUM = 15.0
LEAST_MEAN = 0.8
#: The models are fitted on the labelled strings of about so many distinct texts, spread over the table by hash.
TRAINING_DOCS = 20_000
#: Share of the uniform distribution in the random strings' model, and of it in the words' one: both give every
#: transition a chance.
UNIFORM_RANDOM = 0.5
UNIFORM_WORDS = 0.002
#: Code points of the blocks that a text is cut into before parts of it are taken, as a power of two.
BLOCK_BITS = 11


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def _running(values: Column, count: Column, fold) -> Column:
    """Running folds of an array of ``count`` numbers, by doubling: each round reaches twice as far back.

    Time is n log n. An array that grows by one element a step would be copied at each.
    """

    def further(done: Column, turn: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), turn)
        return F.transform(done, lambda v, i: F.when(i >= reach, fold(v, F.get(done, i - reach))).otherwise(v))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(count)) - 1), values, further)


def spans_of(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: start, end (code points, end exclusive) and string of the pattern's matches, from the left.

    The text between matches, from splitting at the same pattern, gives their places: a match ends after all gaps
    and matches up to its own. Only texts with a match are split.
    """
    found = df.withColumn(out, F.coalesce(_matches(F.col(text), pattern), F.array().cast("array<string>")))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(out)), out, lambda gap, t: gap + F.length(t))
    ends = _running(steps, F.size(out), lambda a, b: a + b)
    spans = F.zip_with(ends, out, lambda e, t: F.struct((e - F.length(t)).alias("s"), e.alias("e"), t.alias("t")))
    empty = F.array().cast("array<struct<s:int,e:int,t:string>>")
    return found.withColumn(out, F.when(F.size(out) > 0, spans).otherwise(empty))


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds the base scan's arrays ``assign``, ``access`` and ``hex``; a null text has no matches."""
    hexes = rf"[0-9a-f]{{{LEAST['hex']},}}"  # a run is matched whole, so short ones may be left out here
    access = rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}"
    df = spans_of(df, text, hexes, "hex")
    df = spans_of(df, text, access, "access")
    # A short value is matched too, as the match takes its text from later ones; then it is dropped.
    df = spans_of(df, text, ASSIGN, "assign")
    value = lambda x: F.length(F.regexp_extract(x["t"], ASSIGN, 2)) >= LEAST["assign"]
    return df.withColumn("assign", F.filter("assign", value))


def transitions(tokens: DataFrame, token: str, label: str) -> DataFrame:
    """(label, a, b, n): how often character b follows a, as places in ALPHABET from 1."""
    coded = tokens.select(label, F.expr(f"transform(split({token}, ''), c -> instr('{ALPHABET}', c))").alias("c"))
    pairs = coded.select(label, F.explode_outer(F.expr("zip_with(c, slice(c, 2, size(c)), (a, b) -> struct(a, b))")).alias("p"))
    return pairs.where("p.a > 0 and p.b > 0").groupBy(label, "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def fit_models(labelled: DataFrame, token: str = "token", label: str = "is_random") -> list[float]:
    """Log-likelihood ratios of all transitions, from labelled strings.

    At most two numbers per pair of ALPHABET's characters reach the driver.
    """
    size = len(ALPHABET)
    counts = {True: {}, False: {}}
    for row in transitions(labelled, token, label).collect():
        counts[bool(row[label])][row["a"], row["b"]] = row["n"]
    uniform = {True: UNIFORM_RANDOM, False: UNIFORM_WORDS}
    logs = {}
    for kind, seen in counts.items():
        totals = [0] * (size + 1)
        for (a, _), n in seen.items():
            totals[a] += n
        for a in range(1, size + 1):
            for b in range(1, size + 1):
                own = seen.get((a, b), 0) / totals[a] if totals[a] else 1 / size
                logs[kind, a, b] = math.log((1 - uniform[kind]) * own + uniform[kind] / size)
    return [logs[True, a, b] - logs[False, a, b] for a in range(1, size + 1) for b in range(1, size + 1)]


def corpus_samples(docs: DataFrame, text: str, bound: int = TRAINING_DOCS) -> DataFrame:
    """(token, is_random): labelled strings from about ``bound`` distinct texts, chosen by a hash.

    Keys and hex runs of the base scan, and assigned values with letters and digits, are random strings; the words
    of the same texts outside of them are ordinary.
    """
    some = drawn(docs.select(text).where(F.col(text).isNotNull()), text, bound)
    found = base_spans(some, text)
    values = F.transform("assign", lambda x: F.regexp_extract(x["t"], ASSIGN, 2))
    random = F.array_distinct(
        F.concat(
            F.filter(values, lambda v: (F.length(v) >= 12) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")),
            F.transform("access", lambda x: x["t"]),
            F.transform("hex", lambda x: x["t"]),
        )
    )
    secrets = found.select(F.explode_outer(random).alias("token")).where("token is not null")
    words = _matches(F.col(text), r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_-]{3,}(?![A-Za-z0-9+/_=-])")
    ordinary = some.select(F.explode_outer(words).alias("token")).where("token is not null")
    return secrets.withColumn("is_random", F.lit(True)).unionByName(ordinary.withColumn("is_random", F.lit(False)))


def find_secrets(docs: DataFrame, text: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """Adds ``assign``, ``access``, ``hex`` and ``markov``: arrays of spans (s, e, t) of each kind.

    A null or empty text has none, an empty table stays empty. Rows are scanned one by one, so repeated rows get the
    same spans. Columns of these names are replaced. Time is nearly linear in a text's length and in its matches.
    ``ratios`` are those of ``fit_models``; without them the models are fitted on the documents' own labelled strings.
    """
    if ratios is None:
        ratios = fit_models(corpus_samples(docs, text))
    size = len(ALPHABET)
    # A constant: the optimiser folds it into one array.
    table_of = F.split(F.lit(",".join(f"{r:.5f}" for r in ratios)), ",").cast("array<double>")
    df = spans_of(base_spans(docs, text), text, CANDIDATE, "markov")

    def summed(codes: Column) -> Column:
        one = F.size(codes) - 1
        pairs = F.zip_with(F.slice(codes, F.lit(1), one), F.slice(codes, F.lit(2), one), lambda a, b: a * size + b)
        return F.aggregate(pairs, F.lit(0.0), lambda total, at: total + F.get(table_of, at))

    # A run is cut into characters once; each then has its place in the alphabet, from 0.
    codes = F.transform(
        "markov",
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["t"].alias("t"),
            F.transform(F.split(x["t"], ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1).alias("c"),
        ),
    )
    judged = F.transform(
        codes, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), summed(x["c"]).alias("ratio"))
    )
    likely = F.filter(
        judged, lambda x: (x["ratio"] >= LEAST_SUM) & (x["ratio"] >= LEAST_MEAN * (F.length(x["t"]) - 1))
    )
    plain = F.transform(likely, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t")))
    return df.withColumn("markov", plain)


def joined_spans(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by start and then kind, comma-joined."""
    entries = [
        F.expr(f"transform({kind}, x -> struct(x.s as s, {at} as k, x.e as e))")
        for at, kind in enumerate(kinds)
    ]
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    ordered = F.array_sort(F.concat(*entries))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.expr(names)[x["k"]], x["s"], x["e"])), ",")


def redacted(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span by ``mark``, overlapping ones together; needs the columns of ``find_secrets``.

    What stays is taken from blocks of the text, as reaching a place in a long string takes a walk from its start.
    Texts without a span stay as they are, null too.
    """
    every, upto, blocks = (unused(df, name) for name in ("_every", "_upto", "_blocks"))
    spans = F.array_sort(F.concat(*[F.expr(f"transform({k}, x -> struct(x.s as s, x.e as e))") for k in KINDS]))
    found = df.withColumn(every, spans)
    some = F.size(every) > 0
    # How far the spans before each one reach, and all of them.
    reached = _running(F.transform(every, lambda x: x["e"]), F.size(every), F.greatest)
    found = found.withColumn(upto, F.when(some, F.concat(F.array(F.lit(0)), reached)))
    found = found.withColumn(blocks, F.when(some, _matches(F.col(text), f"(?s).{{1,{1 << BLOCK_BITS}}}")))

    def part(a: Column, b: Column) -> Column:
        first = F.shiftright(a, BLOCK_BITS)
        held = F.slice(blocks, first + 1, F.shiftright(b, BLOCK_BITS) - first + 1)
        return F.substr(F.array_join(held, ""), a.bitwiseAND((1 << BLOCK_BITS) - 1) + 1, b - a)

    starts = F.zip_with(every, F.slice(upto, F.lit(1), F.size(every)), lambda x, a: F.struct(a.alias("a"), x["s"].alias("s")))
    opens = F.filter(starts, lambda x: x["s"] >= x["a"])
    pieces = F.transform(opens, lambda x: F.concat(part(x["a"], x["s"]), F.lit(mark)))
    clean = F.array_join(F.concat(pieces, F.array(part(F.element_at(upto, -1), F.length(text)))), "")
    return found.withColumn(text, F.when(some, clean).otherwise(F.col(text))).drop(every, upto, blocks)


@query()
def op10_markov_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # The spans are told apart from the text before they are joined, once.
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(joined_spans(KINDS[:3]), 256).alias("base_sha256"),
        joined_spans(KINDS).alias("spans"),
    )
