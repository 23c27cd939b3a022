"""The pipeline: order, effect of every stage, and the registered queries against SQL."""

import brute
import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from wardlake.llm import decontaminate
from wardlake.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, documents, tmp_path):
    docs = documents
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        rows = sorted((i, r.text) for i, r in before.items())
        if n < 4:
            assert docs.columns == documents.columns
            assert len({r.doc_id for r in after}) == len(after)
        if name == "language":
            gone = before.keys() - {r.doc_id for r in after}
            assert {i for i, t in rows if not any(c.isalpha() for c in t or "")} <= gone and len(gone) < 0.02 * len(rows) + 1
        elif name == "line_dedup":
            want = {i: w for (i, _), w in zip(rows, brute.line_dedup(rows, corpus_pipeline.LEAST_WORDS), strict=True)}
            assert {r.doc_id: r.text for r in after} == {i: t for i, (t, lines, gone) in want.items() if not lines or gone < lines}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "near_duplicates":
            want = brute.near_duplicates(rows, corpus_pipeline.SHINGLE)
            assert {r.doc_id for r in after} == {i for i, (_, c) in want.items() if c == i}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            index = decontaminate.Index(items)
            assert {r.doc_id for r in after} == {i for i, t in rows if not list(index.finds(t))}
        else:
            assert {r.doc_id for r in after} <= before.keys() and all(0 <= r.place <= 1 for r in after)


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "text", "turn", "block", "place"} <= set(out.columns) and out.count() > 100


def test_stages_take_odd_rows(spark, odd, tmp_path):
    """Nulls, ties, repeated rows, and columns named like what the stages make inside or add."""
    more = ("turn", "block", "place", "n_words", "deduped", "mixed", "copies", "rejected")
    wide = odd.withColumns({c: F.lit(f"my {c}") for c in more}).withColumn("n_chars", F.length("text").cast("long"))
    prose = [(100 + i, f"the quick brown fox number {i} jumps over the lazy dog of farmer {i * i} and sleeps in the sun", "en", "s") for i in range(30)]
    prose += [(130, prose[0][1], "en", "s"), (131, prose[1][1], "en", None), (131, prose[1][1], "en", None)]
    docs = spark.createDataFrame(prose, "doc_id long, text string, lang string, source string").unionByName(wide, allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for n, rows in enumerate((docs, docs.drop("n_chars"), docs.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            before = rows
            rows = stage(spark, rows, str(tmp_path))
            if name == "mixture":
                assert sorted(rows.columns) == sorted([c for c in before.columns if c not in more[:4]] + list(more[:4]))
                assert rows.schema["turn"].dataType.typeName() == "integer" and rows.schema["mixed"].dataType.typeName() == "string"
            else:
                assert rows.schema.names == before.schema.names and [f.dataType for f in rows.schema] == [f.dataType for f in before.schema]
            rows.write.parquet(str(tmp_path / f"{name}-{n}"))
            rows = spark.read.parquet(str(tmp_path / f"{name}-{n}"))
        kept = {r.doc_id for r in rows.collect()}
        assert not kept & {0, 1, 2, 130} and not any(r.text is None for r in rows.collect())
        if n < 2:
            assert {100, 101} <= kept and 131 not in kept


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    df = QUERIES[key](spark, FOLDER)
    result = con.execute(ORACLES[key])
    names = [c[0] for c in result.description]
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in df.columns) for r in result.fetchall()]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
