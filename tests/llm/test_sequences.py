"""Packing, periodic runs and the manifest: round trips, brute force, SQL (in test_pipeline.py) and odd rows."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlake.llm import merkle, packing, periodicity
from wardlake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.CLOSING]


def check_packing(rows, want, window=packing.WINDOW):
    """``rows``: pieces; ``want``: a Counter of (doc_id, ids). Every id lies in one piece, sequences have no gap and no padding."""
    pieces = Counter()
    for r in rows:
        ids = list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))
        assert len(ids) == r.length > 0
        pieces[(r.doc_id, r.start, tuple(ids), r.doc_tokens)] += 1
    expected = Counter()
    for (doc_id, ids), times in want.items():
        # repeated documents are cut in different places: compare id by id
        for k, x in enumerate(ids):
            expected[(doc_id, k, x, len(ids))] += times
    got = Counter()
    for (doc_id, start, ids, n), times in pieces.items():
        for k, x in enumerate(ids):
            got[(doc_id, start + k, x, n)] += times
    assert got == expected
    inside = defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, r.length))
    assert sorted(inside) == list(range(len(inside)))
    sizes = []
    for k in sorted(inside):
        at = 0
        for offset, length in sorted(inside[k]):
            assert offset == at
            at += length
        sizes.append(at)
    total = sum(sizes)
    assert sizes == [window] * (total // window) + [1 << b for b in range(40, -1, -1) if (total % window) >> b & 1]


def test_packing_round_trip(spark, documents, texts, tokenizer):
    rows = packing.pack(documents.repartition(5)).collect()
    check_packing(rows, Counter((i, tuple(ids_of(tokenizer, t))) for i, t in texts))


def test_packing_small_windows_and_odd_rows(spark, odd, tokenizer):
    for parts, window in ((1, 16), (7, 16), (3, 4096)):
        rows = packing.pack(odd.repartition(parts), window=window).collect()
        check_packing(rows, Counter((r.doc_id, tuple(ids_of(tokenizer, r.text))) for r in odd.collect()), window)
    assert packing.pack(odd.limit(0)).count() == 0


def test_sequences_hold_the_pieces(spark, documents):
    pieces = packing.pack(documents.repartition(4), window=256)
    flat = defaultdict(list)
    for r in pieces.collect():
        flat[r.sequence_id].append((r.offset, r.ids))
    got = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
    assert got == {k: b"".join(x for _, x in sorted(v)) for k, v in flat.items()}


def test_packing_digests(spark):
    rows = QUERIES["op11_packing"](spark, FOLDER).collect()
    ids = {(r.doc_id, r.start): r.ids for r in packing.pack(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in rows} == {k: zlib.crc32(v) for k, v in ids.items()}


_tokenisers = []


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZ9é's.,<|>_ \t\n\x0b\x1c\x85\xa0̸́ſİΣ endoftext"), st.characters(codec="utf-8")), max_size=40))
def test_words_are_tokenised_as_in_the_whole_text(text):
    if not _tokenisers:  # few slots, so that words meet in them
        _tokenisers.append(packing.Tokeniser(packing.vocabulary_path(), 11))
    if len(_tokenisers[0].count) > 1500:
        _tokenisers[0]._forget()
    for told in (text, f"<|endoftext|>{text}'s,", text.replace("s", "<|startoftext|>.")):
        want = _tokenisers[0].words.tokenizer.encode(told, add_special_tokens=False).ids
        got, cuts = _tokenisers[0].ids([told, None, told])
        assert list(struct.unpack(f"<{2 * len(want)}I", got)) == want * 2 and cuts == [0, len(want), len(want), 2 * len(want)]


# --- periodic runs


def slow_runs(words):
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def slow_digest(doc_id, text, plant=True):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    listed = "".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()
    return len(runs), *best, milli, sha(listed), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        texts = []
        for _ in range(rng.randint(1, 30)):
            n, kinds = rng.randint(0, 160), rng.choice([1, 2, 3, 40])
            words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
            if n > 40 and rng.random() < 0.6:  # a planted repetition, sometimes inside another
                p, at = rng.randint(1, n // 3), rng.randint(0, n // 3)
                for i in range(at, min(n, at + rng.randint(3, 7) * p + rng.randint(0, p))):
                    words[i] = words[at + (i - at) % p]
            texts.append(words)
        assert periodicity.runs_of(texts) == [slow_runs(t) for t in texts]


def test_extensions_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(4)
    for kinds in (1, 2, 5):
        words = np.concatenate(([90], rng.integers(0, kinds, 700), [91], np.tile(rng.integers(0, kinds, 13), 40), [92]))
        x, y = rng.integers(1, 500, 300), rng.integers(500, len(words) - 1, 300)
        grammar = periodicity.Grammar(words.astype(np.int64))
        for step in (1, -1):
            want = []
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                n = 0
                while 0 <= a + step * n and b + step * n < len(words) and words[a + step * n] == words[b + step * n]:
                    n += 1
                want.append(n)
            assert grammar.extensions(x, y, step).tolist() == want


def test_long_texts_cross_the_steps_of_the_grid(monkeypatch):
    rng = random.Random(6)
    words = [b"%d" % rng.randrange(9) for _ in range(900)]
    words[300:800] = (words[300:420] * 5)[:500]
    want = periodicity.runs_of([words])
    monkeypatch.setattr(periodicity, "GRID", 64)
    monkeypatch.setattr(periodicity, "_grid", (periodicity._grid[0][:0], periodicity._grid[1][:0]))
    assert periodicity.runs_of([words]) == want == [slow_runs(words)]


def test_periodic_query_equals_brute_force(spark):
    rows = QUERIES["op12_periodic_runs"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    short = [r for r in rows if len(texts[r.doc_id].split()) < 1200]
    assert len(short) > 150 and len(rows) == len(texts) and any(r.n_runs for r in short)
    for r in short:
        assert tuple(r)[1:] == slow_digest(r.doc_id, texts[r.doc_id]), r.doc_id


def test_ties_between_runs(spark):
    once, twice = " ".join("abcdefgh" * 3), " ".join("ijklmnop" * 3)
    rows = [(1, f"{once} x {twice}"), (1, f"{once} x {twice}"), (2, " ".join("ab" * 30) + " y " + " ".join("abc" * 30)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = periodicity.digest(periodicity.collapse(docs)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *slow_digest(i, t, plant=False))) for i, t in rows)


def test_periodic_takes_odd_rows(spark, odd):
    odd = odd.withColumn("periodic", F.lit(1))
    out = periodicity.collapse(odd)
    assert sorted(out.columns) == sorted(odd.columns)
    rows = {r.text: r.periodic for r in out.collect()}
    assert rows[None].n_words == rows[""].n_words == 0 and rows["word"].text == "word"
    long = next(v for k, v in rows.items() if k and k.startswith("long"))
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 1)] and long.text == "long end"
    assert periodicity.digest(periodicity.collapse(odd.limit(0))).count() == 0


# --- manifest


def slow_manifest(rows, fanout=16):
    """Rows (doc_id, source, lang, n_chars, text) to {(doc_id, leaf)}: subroot, root, proof, in plain Python."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    null_first = lambda v: (v is not None, v if not isinstance(v, str) else v.encode()) if v is not None else (False,)

    def tree(hashes):
        proofs, level, at = [""] * len(hashes), hashes, list(range(len(hashes)))
        while len(level) > 1:
            runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            for d, k in enumerate(at):
                proofs[d] += "".join(h for j, h in enumerate(runs[k // fanout]) if j != k % fanout)
            level, at = [sha("".join(r)) for r in runs], [k // fanout for k in at]
        return level[0], proofs

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], sha("".join(map(field, r)))))
    out, tops = [], []
    for source in sorted(groups, key=null_first):
        leaves = sorted(groups[source], key=lambda x: (null_first(x[0]), x[1]))
        top, proofs = tree([h for _, h in leaves])
        tops.append(top)
        out.append([(i, h, top, p) for (i, h), p in zip(leaves, proofs, strict=True)])
    root, above = tree(tops)
    return sorted(((i, h, top, root, sha(p + above[k])) for k, part in enumerate(out) for i, h, top, p in part), key=str)


def manifest_rows(df):
    rows = merkle.verify(merkle.manifest(df)).collect()
    assert all(r.verified and r.folded_root == r.root for r in rows)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in rows), key=str)


@pytest.mark.parametrize("n", [1, 17, 700])
def test_manifest_equals_brute_force(spark, n):
    rng = random.Random(n)
    sources = [None, "a", "é", "z"] + [f"s{i}" for i in range(40)]
    rows = [(i, "a" if rng.random() < 0.4 else rng.choice(sources), None if i % 7 == 0 else "en", i, f"Text {i % 50}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifest_rows(df) == slow_manifest(rows)


def test_manifest_takes_odd_rows(spark, odd):
    df = odd.withColumn("n_chars", F.length("text").cast("long"))
    for c in ("idx", "size", "tree", "leaf", "root", "path", "digest", "left", "sibling"):
        df = df.withColumn(c, F.lit("x"))
    rows = [tuple(r) for r in df.select(*merkle.FIELDS).collect()]
    assert manifest_rows(df) == slow_manifest(rows)
    assert merkle.verify(merkle.manifest(df.limit(0))).count() == 0


def test_tampering_is_found(spark, documents):
    rows = merkle.verify(merkle.manifest(documents, merkle.tampering(F.col("doc_id"), F.col("text")))).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    changed = {i for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in t)}
    assert {r.doc_id for r in rows if not r.verified} == changed and len(changed) > 10
