"""Operators over pairs, lines and sources, and the classifiers."""

import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.llm import decontaminate, langid, linededup, mixing, neardup, toxicity
from wardlake.llm.graph import components
from wardlake.llm.queries import QUERIES

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# --- near duplicates


def linked(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def expected(rows, size=4):
    return {i: (n, c, c == i) for i, (n, c) in brute.near_duplicates(rows, size).items()}


def test_near_duplicates_equal_brute_force(spark, texts):
    assert linked(QUERIES["op4_neardup"](spark, FOLDER)) == expected(texts)


def test_rows_with_one_id_are_one_document(spark, prose):
    x, y, z = (prose(60) for _ in range(3))
    rows = [(1, x), (5, x), (5, y), (7, y), (7, None), (8, ""), (9, z), (None, z), (None, y), (9, " "), (11, z)]
    got = {(r.doc_id, r.n_shingles > 0): (r.component_id, r.kept) for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        (1, True): (1, True), (5, True): (1, False), (7, True): (1, False), (7, False): (1, False), (8, False): (8, True),
        (9, True): (9, True), (9, False): (9, True), (11, True): (9, False), (None, True): (got[None, True][0], False),
    }


def test_chains_and_groups_of_near_copies(spark, prose):
    base, rows = prose(150).split(), []
    rng = np.random.default_rng(2)
    for i in range(700):  # more than a block, edits from none to many, so that some chain and some do not link
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 9)):
            words[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1].upper()) for i in range(0, 700, 7)] + [(2000, "one"), (2001, "ONE"), (2002, "two words"), (2003, None), (2004, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert linked(neardup.link(df)) == expected(rows)
    assert linked(neardup.link(df, 5)) == expected(rows, 5)


def test_blocks_of_a_large_bucket_lose_nothing(spark):
    bands = spark.createDataFrame([(0, 1, bytes([i])) for i in range(30)] + [(0, 2, b"a"), (0, 2, b"b"), (1, 3, b"x")], "band int, key long, class binary")
    seen = defaultdict(list)
    for r in neardup.units_of(bands, block=7).collect():
        seen[r.key, r.i, r.j].append((r.block, r["class"]))
    pairs = {(a, b) for (_, i, j), m in seen.items() for x, a in m for y, b in m if a < b and (i == j or x != y)}
    every = [bytes([i]) for i in range(30)]
    assert pairs == {(a, b) for a in every for b in every if a < b} | {(b"a", b"b")}


def test_posterior_bound_is_monotone_and_safe():
    least = neardup.least_matches()
    assert list(least) == sorted(least) and least[-1] < 0.8 * neardup.HASHES
    # a pair at the threshold is lost with about the chosen probability
    rng = np.random.default_rng(1)
    draws = rng.binomial(neardup.BATCH, 0.8, (200_000, len(least))).cumsum(axis=1)
    assert (draws < np.array(least)).any(axis=1).mean() < 20 * neardup.MISS


def test_signatures_estimate_similarity(prose):
    words = prose(400).split()
    one, two = neardup.shingles(" ".join(words)), neardup.shingles(" ".join(words[:360] + prose(40).split()))
    real = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    assert abs((neardup.signature(one) == neardup.signature(two)).mean() - real) < 0.12


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = neardup.link(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.kept for r in rows if r.n_shingles == 0)
    assert [r.kept for r in rows if r.doc_id == 6] == [True, True]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert neardup.link(odd.limit(0)).count() == 0


# --- lines


def test_line_dedup_equals_brute_force(spark, texts, prose):
    shared = [prose(12) for _ in range(12)]
    rows = list(texts)
    for i in range(12):  # runs that overlap, start inside one another and repeat within a document
        rows.append((1000 + i, "\n".join([prose(6), *shared[i % 5 : i % 5 + 2 + i % 6], "", prose(5), *(shared[2:5] * 2), " "])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for least in (1, 10, 40):
        got = {r.doc_id: (r.deduped.text, r.deduped.n_lines, r.deduped.n_removed) for r in linededup.dedup(df, least).collect()}
        for (i, _), want in zip(rows, brute.line_dedup(rows, least), strict=True):
            assert got[i] == want, i


def test_a_short_line_in_many_documents_stays_once(spark, prose):
    short = {n: " ".join(f"w{n}x{k}" for k in range(n)) for n in (2, 3, 5, 9, 20)}
    rows = [(i, "\n".join(x for n in sorted(short) for x in (short[n], f"{i} {n} {prose(12)}"))) for i in range(60)]
    got = {r.doc_id: r.deduped for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for n, line in short.items():
        assert [i for i in range(60) if line in got[i].text.split("\n")] == [0], n
    assert all((d.n_lines, d.n_removed) == (10, 5 if i else 0) for i, d in got.items())


def test_single_words_go_without_a_floor(spark):
    rows = [(1, "one\ntwo\none"), (2, "two"), (3, "three\n \none"), (4, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.deduped.text for r in linededup.dedup(docs).collect()} == {1: "one\ntwo", 2: "", 3: "three\n ", 4: "one two"}
    assert {r.doc_id: r.deduped.n_removed for r in linededup.dedup(docs, 2).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_lines_of_odd_rows(spark, odd):
    rows = linededup.dedup(odd, 1).collect()
    assert len(rows) == odd.count()
    twins = [r.deduped for r in rows if r.doc_id == 6]
    assert twins[0] == twins[1]
    assert all(r.deduped.n_lines == 0 and r.deduped.text == r.text for r in rows if not (r.text or "").strip())
    assert linededup.dedup(odd.limit(0)).count() == 0


# --- benchmark


def plain_finds(index, text):
    """Items that a document holds, by scoring all entries in every passage; the verification is written out anew."""
    words, width = decontaminate.words_of(text), 2 * decontaminate.ENTRY
    by_item = defaultdict(list)
    for start in range(0, max(1, len(words) - decontaminate.ENTRY), decontaminate.ENTRY):
        scores = Counter()
        for w in set(words[start : start + width]):
            t = index.terms.get(w)
            if t is not None:
                for e, x in zip(index.entries[t], index.weights[t], strict=True):
                    scores[index.item_of[e], e] += x
        for item in {i for (i, _), s in scores.items() if s >= decontaminate.LEAST_SHARE - 1e-9}:
            by_item[item].append(start)
    grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}
    for item, starts in by_item.items():
        item_id, question, answer = index.items[item]
        reach = len(question) + len(answer)
        regions = []
        for start in starts:
            end = min(start + width, len(words))
            if regions and start - reach <= regions[-1][1]:
                regions[-1][1] = end + reach
            else:
                regions.append([max(0, start - reach), end + reach])
        for low, high in regions:
            region = words[low:high]
            share = lambda part: 1.0 if not part else (
                any(region[i : i + len(part)] == part for i in range(len(region))) if len(part) < 5 else len(grams(part) & grams(region)) / len(grams(part)))
            if share(question) >= 0.8 and share(answer) >= 0.8:
                yield item_id
                break


def test_finds_equal_a_scan_of_all_pairs(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    index = decontaminate.Index(sorted(items, key=str))
    want = {(i, j) for i, text in texts for j in plain_finds(index, text)}
    for i, text in texts:  # items that stand whole, without any index
        there = decontaminate.shingle_set(decontaminate.words_of(text))
        for j, item in items:
            own = decontaminate.shingle_set(decontaminate.words_of(item))
            assert len(own & there) < 0.95 * len(own) or (i, j) in want
    got = {(r.doc_id, r.item_id) for r in QUERIES["op3_decontaminate"](spark, FOLDER).collect()}
    assert want and want == got


def test_finds_do_not_depend_on_the_number_of_blocks(spark, documents):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    size = sum(len(r.text or "") for r in items.collect())
    found = []
    for blocks in (1, 2, 7):
        assert decontaminate.indexes(items, -(-size // blocks)).count() == blocks
        rows = decontaminate.contaminated(documents, items, -(-size // blocks)).collect()
        found.append(sorted((r.doc_id, r.item_id, round(r.share, 9), r.question_overlap, r.answer_overlap, r.first_word) for r in rows))
    assert found[0] and found[0] == found[1] == found[2]


def test_promising_passages_are_those_of_some_block(prose, monkeypatch):
    rng = np.random.default_rng(9)
    index = decontaminate.Index([(i, prose(int(rng.integers(8, 60)))) for i in range(120)])
    width = decontaminate.ENTRY
    for _ in range(10):
        ids = rng.integers(0, len(index.terms) + 30, width * 6)
        ids = np.minimum(ids, len(index.terms))
        want = []
        for k in range(5):
            best = Counter()
            for t in set(ids[k * width : (k + 2) * width].tolist()) - {len(index.terms)}:
                for block, x in index.block_most[t].items():
                    best[block] += x
            if best and max(best.values()) >= decontaminate.LEAST_SHARE:
                want.append(k)
        assert index.promising(ids, 5).tolist() == want


def test_block_max_wand_equals_scoring_everything(prose):
    rng = np.random.default_rng(4)
    index = decontaminate.Index([(i, prose(int(rng.integers(8, 60)))) for i in range(300)])
    for _ in range(40):
        terms = sorted(set(rng.integers(0, len(index.terms), 200).tolist()))
        for least in (0.05, 0.15, 0.3):
            scores = Counter()
            for t in terms:
                for e, x in zip(index.entries[t], index.weights[t], strict=True):
                    scores[e] += x
            want = {e for e, s in scores.items() if s >= least}
            assert {e for e, _ in index.search(terms, least)} == want


def test_question_and_answer_must_both_stand(spark, prose):
    question, answer, long = prose(30), prose(9), prose(150)
    items = spark.createDataFrame([(1, f"{question}? Answer: {answer}"), (2, long), (3, None), (4, "")], "item_id long, text string")
    docs = [
        (1, f"{prose(300)} {question.upper()}, {answer} {prose(200)}"), (2, f"{prose(50)} {question} {prose(50)}"),
        (3, f"{prose(700)} {long}"), (4, answer), (5, None), (6, prose(500)),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1), (3, 2)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, block_chars=40).collect()} == got


def test_benchmark_of_odd_rows(spark, odd):
    items = odd.select("doc_id", "text").withColumnRenamed("doc_id", "item_id")
    rows = decontaminate.contaminated(odd, items).collect()
    assert Counter(r.doc_id for r in rows if r.item_id == 6) == {6: 4}  # two equal rows, two equal items
    assert decontaminate.contaminated(odd.limit(0), items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0


# --- mixing


def shares(rows):
    words = Counter()
    for r in rows:
        words[r.source] += r.n_words
    return {s: n / words.total() for s, n in words.items()}, words


def test_mixture_meets_entropy_and_budget(spark):
    skewed = [(i, "big" if i % 10 else f"s{i % 40}", "w " * (1 + i % 30)) for i in range(6000)]
    df = spark.createDataFrame(skewed, "doc_id long, source string, text string")
    total = sum(1 + i % 30 for i in range(6000))
    out = [(r.source, r.doc_id, r.mixed) for r in mixing.mix(df, entropy_share=0.6, most_passes=50).collect()]
    words = Counter()
    for s, _, m in out:
        words[s] += m.n_words
    assert abs(words.total() - total) < 0.01 * total
    p = np.array([n / words.total() for n in words.values()])
    assert -(p * np.log(p)).sum() == pytest.approx(0.6 * math.log(len(p)), abs=0.01)
    turns = defaultdict(set)
    for _, i, m in out:
        assert m.turn not in turns[i]
        turns[i].add(m.turn)
    assert all(t == set(range(len(t))) for t in turns.values())  # whole passes first
    assert all(0 <= m.place <= 1 for _, _, m in out)
    first = Counter(s for s, _, m in out if m.place < 0.5)
    assert first["big"] / sum(first.values()) == pytest.approx(Counter(s for s, *_ in out)["big"] / len(out), abs=0.05)


def plain_mixture(rows, entropy_share, most_passes, budget=None):
    """Words that each source gets: the power is found by trying very many."""
    total = Counter()
    for s, n in rows:
        total[s] += n
    total = {s: n for s, n in total.items() if n}
    whole = sum(total.values())
    budget = whole if budget is None else budget

    def share(a):
        raised = {s: (n / whole) ** a for s, n in total.items()}
        return {s: x / sum(raised.values()) for s, x in raised.items()}

    def holds(a):
        p = share(a)
        entropy = -sum(x * math.log(x) for x in p.values())
        return entropy >= entropy_share * math.log(len(total)) - 1e-12, max(p[s] * budget / total[s] for s in p) <= max(most_passes, budget / whole) + 1e-9

    powers = [i / 4000 for i in range(4001)]
    flat = max([a for a in powers if holds(a)[0]], default=0.0)
    power = min([a for a in powers if a >= flat and holds(a)[1]], default=1.0)
    return {s: x * budget for s, x in share(power).items()}


@pytest.mark.parametrize("entropy_share, most_passes, budget", [(0.95, 4.0, None), (0.6, 50.0, None), (1.0, 3.0, None), (0.0, 4.0, 2500), (0.9, 2.0, 30_000)])
def test_every_source_gets_its_words(spark, entropy_share, most_passes, budget):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a"] * 12 + ["b"] * 3 + ["c"]), "w " * rng.randint(0, 40)) for i in range(1500)]
    rows += [(9000, "giant", "x " * 3000)] + [(9001, "equal", "y y y")] * 200 + [(9002, None, "z " * 50)] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    longest = defaultdict(int)
    for _, s, t in rows:
        longest[s] = max(longest[s], len(t.split()))
    got = Counter()
    for r in mixing.mix(df, budget=budget, entropy_share=entropy_share, most_passes=most_passes).collect():
        got[r.source] += r.mixed.n_words
    want = plain_mixture([(s, len(t.split())) for _, s, t in rows], entropy_share, most_passes, budget)
    for s, n in want.items():
        assert 0.998 * n - 1 <= got[s] < 1.002 * n + longest[s] + 1, s


def test_long_and_repeated_rows_are_not_lost(spark):
    short = [(i, "a", "w " * 10) for i in range(100)]
    for other, longest in (([(500, "b", "x " * 3000)], 3000), ([(500, "b", "y " * 10)] * 300, 10)):
        rows = mixing.mix(spark.createDataFrame(short + other, "doc_id long, source string, text string"), budget=2000).collect()
        words = Counter()
        for r in rows:
            words[r.source] += r.mixed.n_words
        assert words["b"] > 0 and words["a"] > 0
        assert 2000 <= words.total() < 2000 + 10 + longest


def test_repetition_limit(spark):
    skewed = [(i, "big" if i % 50 else "small", "w w w") for i in range(3000)]
    df = spark.createDataFrame(skewed, "doc_id long, source string, text string")
    out = mixing.mix(df, entropy_share=1.0, most_passes=3.0).collect()
    taken = Counter(r.doc_id for r in out)
    assert max(taken.values()) == 3
    natural = mixing.mix(df, entropy_share=0.0).collect()
    assert Counter(r.doc_id for r in natural) == {i: 1 for i in range(3000)}
    half = mixing.mix(df, budget=3000 * 1.5, entropy_share=0.0).collect()
    assert sum(r.mixed.n_words for r in half) == pytest.approx(4500, rel=0.02) and len({r.doc_id for r in half}) == len(half)


def test_mixture_of_odd_rows(spark, odd):
    rows = mixing.mix(odd).collect()
    ids = {r.doc_id for r in odd.collect()}
    assert rows and {r.doc_id for r in rows} <= ids
    assert {r.doc_id for r in mixing.mix(odd, entropy_share=0.0).collect()} == ids
    assert mixing.mix(odd.limit(0)).count() == 0


# --- language


def test_held_out_languages(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op10_language"](spark, LARGER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97
    assert sum(r.rejected for r in rows) < 0.01 * len(rows)


def test_long_texts_far_from_all_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang", "text")
    (model,) = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    scripts = {
        "Cyrillic": range(0x430, 0x450), "Greek": range(0x3B1, 0x3CA), "Arabic": range(0x627, 0x64B), "CJK": range(0x4E00, 0x9000),
        "consonants": [ord(c) for c in "bcdfghjklmnpqrstvwxz"], "base64": [ord(c) for c in letters + letters.upper() + "0123456789+/"],
    }
    for name, points in scripts.items():
        for n in (30, 100, 300, 1000, 5000):
            for _ in range(5):
                text = " ".join("".join(map(chr, rng.choices(list(points), k=rng.randint(3, 9)))) for _ in range(n))
                assert model.best(text)[2], (name, n)
    kept = [(model.best(r.text)[2], len(r.text.split())) for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()]
    assert not any(rejected for rejected, n in kept if n >= 20)
    assert sum(rejected for rejected, _ in kept) <= 2


def test_the_floor_grows_with_the_text():
    floors = [langid.floor(n) for n in range(1, 4000)]
    assert all(0 < b - a < 0.02 for a, b in zip(floors, floors[1:], strict=False)) and floors[-1] < langid.FLOOR_SHARE


def test_parts_of_the_languages_give_the_same_answer(spark, documents):
    many = documents.withColumn("lang", F.concat("lang", F.pmod(F.col("doc_id"), F.lit(3)).cast("string")))
    (one,), parts = langid.fit(many), langid.fit(many, together=3)
    assert len(parts) > 2 and sorted(x for p in parts for x in p.languages) == one.languages and len(set(one.languages)) == 12
    rows = many.select(langid.predict(F.col("text"), [one]).alias("a"), langid.predict(F.col("text"), parts).alias("b")).collect()
    assert all(r.a.lang_pred == r.b.lang_pred and r.a.rejected == r.b.rejected and abs(r.a.score - r.b.score) < 1e-5 for r in rows)


def test_language_of_odd_rows(spark, odd, documents):
    models = langid.fit(documents.select("lang", "text"))
    rows = odd.select("doc_id", "text", langid.predict(odd["text"], models).alias("p")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.p.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert 0 <= r.p.score <= 1 and (r.p.rejected or r.p.lang_pred != "und")
    nothing = langid.identify(odd.filter("lang = 'none'"))
    assert nothing.count() == 0
    unlearned = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}


def test_long_texts_are_counted_whole():
    text = "das ist ein Satz " * 200_000
    assert langid.counts(text).sum() > 3 * langid.CHUNK
    assert langid.counts("12 34") is None and langid.counts(None) is None


# --- toxicity


def test_held_out_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    c = Counter(held)
    assert c[1, 1] / (c[1, 1] + c[0, 1]) > 0.75 and c[1, 1] / (c[1, 1] + c[1, 0]) > 0.9


def test_toxicity_of_odd_rows(spark, odd):
    labels = odd.selectExpr("doc_id", "quality AS toxic")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.score(odd.limit(0), labels).count() == 0


def test_features_see_disguise_and_address():
    lexicon = {"idiot": 5.0}
    names = dict(zip(toxicity.FEATURES, toxicity.features("You are an IDIOT!! such an id1ot, soooo bad", lexicon, {"idio"}), strict=True))
    assert names["hits_near_you"] > 0 and names["disguised_hits"] == 1 and names["stretched"] > 0 and names["shouted"] > 0
    assert toxicity.features(None, lexicon, {"idio"}) == toxicity.features("", lexicon, {"idio"})
