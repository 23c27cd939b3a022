"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Three patterns (the base) give assigned values, access keys and hexadecimal keys. Other long tokens that mix letters
with digits or cases are scored by two first-order Markov models over characters: one learned from the values the base
found, one from the tokens the base left alone that do not mix. A token whose mean log-likelihood ratio for a
transition is high enough is reported as ``markov``. Only DataFrame functions are used.

The models are learned from a bounded sample of documents (``train_documents``); every whole text is scanned.
Places count code points, ends are exclusive.

Defined results: null and empty texts have no spans. Repeated rows get the same result each. A token that overlaps a
base span is not reported again. Without any base value to learn from, the random model is uniform.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_array

#: The base patterns.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: What a text with an assignment must contain in lower case.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
LEAST = 16
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,}"
#: Least log-likelihood ratio of a token for each of its transitions, in nats.
LEAST_RATIO = 0.7
TRAIN_DOCUMENTS = 20_000
SMOOTHING = 20.0
#: One transition counts so many nats at most: a few unseen characters do not make a token random.
MOST_EACH = 2.0

SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def matches(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Spans of all non-overlapping matches from the left; those with a shorter value are dropped."""
    pieces = F.split(text, pattern, -1)
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    steps = F.zip_with(
        F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("before"), whole.alias("whole")),
        value,
        lambda a, v: F.struct(F.length(a["before"]).alias("gap"), F.length(a["whole"]).alias("size"), v.alias("value")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        span = F.struct(
            (acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"),
            (acc["at"] + x["gap"] + x["size"]).alias("stop"), x["value"].alias("value"),
        )
        kept = F.when(F.length(x["value"]) >= least, F.array(span)).otherwise(F.array().cast(SPAN))
        return F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.concat(acc["out"], kept).alias("out"))

    return F.aggregate(steps, start, add, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """Spans of the three patterns. A text without a pattern's literal part is not searched for it."""
    none, low = F.array().cast(SPAN), F.lower(text)
    hint = F.lit(False)
    for word in ASSIGN_HINTS:
        hint = hint | low.contains(word)
    return F.concat(
        F.when(hint, matches(text, ASSIGN, 0, 2, 8)).otherwise(none),
        F.when(text.contains("AKIA"), matches(text, ACCESS, 1)).otherwise(none),
        F.when(text.rlike(HEX), matches(text, HEX, 2)).otherwise(none),
    )


def mixed(token: Column) -> Column:
    """Letters with digits, or cases that change several times: only such tokens can be reported."""
    return (token.rlike("[0-9]") & token.rlike("[A-Za-z]")) | token.rlike("[a-z].*[A-Z].*[a-z].*[A-Z]")


def transitions(tokens: Column) -> Column:
    """Array of the transitions of a token, each as one number; characters outside the alphabet are left out."""
    n = len(ALPHABET)
    return F.transform(
        F.sequence(F.lit(1), F.length(tokens) - 1),
        lambda i: (F.instr(F.lit(ALPHABET), F.substring(tokens, i, F.lit(1))) - 1) * n
        + F.instr(F.lit(ALPHABET), F.substring(tokens, i + 1, F.lit(1))) - 1,
    )


def sample(docs: DataFrame, limit: int = TRAIN_DOCUMENTS) -> DataFrame:
    """About ``limit`` documents chosen by a hash of the text, all of them if there are no more."""
    share = docs.agg((F.lit(float(limit)) / F.greatest(F.count("*"), F.lit(1))).alias("s"))
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    return docs.filter(chance < share.scalar())


def labelled(docs: DataFrame, limit: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(random, token): the labelled samples. Each class has its own sample, so that neither shrinks as it gets rarer.

    Random strings are the values that the three patterns label, from about ``limit`` of the documents that have any; ordinary ones are
    the other identifiers, from about ``limit`` documents.
    """
    texts = docs.select("text").filter(F.col("text").isNotNull())
    marked = texts.select("text", base_spans(F.col("text")).alias("base")).filter(F.size("base") > 0)
    random = sample(marked, limit).select(F.lit(True).alias("random"), F.explode("base.value").alias("token"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = F.filter(F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0)), lambda t: ~mixed(t))
    others = sample(texts, limit).select(F.lit(False).alias("random"), F.explode(ordinary).alias("token"))
    return random.unionByName(others)


def learn(docs: DataFrame, limit: int = TRAIN_DOCUMENTS) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for every pair of characters, in one list."""
    out = labelled(docs, limit)
    # equal tokens are added up first; the tokens of one kind then weigh as often as they occur
    out = out.groupBy("random", "token").agg(F.count("*").alias("n")).filter(F.length("token") > 1)
    cells = out.select("random", "n", F.explode(transitions(F.col("token"))).alias("cell")).groupBy("random", "cell").agg(F.sum("n").alias("n"))
    size = len(ALPHABET)
    counts = {kind: [0.0] * size * size for kind in (True, False)}
    for row in cells.collect():  # at most two for each pair of characters
        if 0 <= row.cell < size * size:
            counts[row.random][row.cell] += row.n
    random, ordinary = (chances(counts[kind], size) for kind in (True, False))
    # samples of random strings show some alphabets only; half of the model is the even distribution
    ratios = (math.log(0.5 * r + 0.5 / size) - math.log(o) for r, o in zip(random, ordinary, strict=True))
    return [min(MOST_EACH, max(-MOST_EACH, x)) for x in ratios]


def chances(counts: list[float], size: int) -> list[float]:
    """P(b | a) of a first-order model, smoothed by P(b): rare first characters fall back on it."""
    total = sum(counts) + 0.5 * size
    single = [(sum(counts[b::size]) + 0.5) / total for b in range(size)]
    out = []
    for a in range(size):
        row = counts[a * size : (a + 1) * size]
        out += [(n + SMOOTHING * p) / (sum(row) + SMOOTHING) for n, p in zip(row, single, strict=True)]
    return out


def scan(docs: DataFrame, ratios: list[float] | None = None, limit: int = TRAIN_DOCUMENTS, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """(doc_id, spans) of every document; a span has start, kind (place in ``KINDS``), stop and value, sorted by start."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    weights = number_array(learn(docs, limit) if ratios is None else ratios)
    out = docs.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    likely = F.when(F.col("text").rlike(TOKEN), matches(F.col("text"), TOKEN, 3)).otherwise(F.array().cast(SPAN))
    out = out.select("doc_id", "base", likely.alias("tokens"))

    def random_looking(x: Column) -> Column:
        token = x["value"]
        ratio = F.aggregate(transitions(token), F.lit(0.0), lambda s, c: s + F.get(weights, c)) / (F.length(token) - 1)
        apart = ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
        return mixed(token) & apart & (ratio >= least_ratio)

    found = F.filter("tokens", random_looking)
    return out.select("doc_id", F.sort_array(F.concat("base", found)).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts and the written form of the spans of ``scan``."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    names = F.array(*map(F.lit, KINDS))
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    written = lambda some: F.array_join(F.transform(some, text), ",")
    return spans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
