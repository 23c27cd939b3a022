"""A training corpus from raw documents, in five stages.

Every stage reads what the one before kept, and writes what it keeps; the last adds the mixture's columns.

Defined results, in every stage: rows are judged by their text, so a null or empty text has no language and goes in the first stage; a null
id is an id of its own and joins nothing; a null source is a source. Rows with one id are one document: they are
dropped together. Rows equal in all columns share their fate in all but the last stage, where each has a place of its own. An empty table stays empty.
Columns besides ``doc_id``, ``text``, ``source`` and ``lang`` pass through whatever their names, ``n_chars`` follows the text if there is such
a column; only in the last stage do ``n_words``, ``turn``, ``block`` and ``place`` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import decontaminate, langid, linededup, mixing, neardup
from wardlake.llm.common import cut, table

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5
#: Words of a repeated run of lines that goes; in a corpus, equal lines of one or two words are headings and list marks.
LEAST_WORDS = 3


def _aside(docs: DataFrame, name: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with a column of this name renamed, and the new name of each column."""
    names = {c: f"__aside_{c}" if c.lower() == name else c for c in docs.columns}
    return docs.withColumnsRenamed({c: n for c, n in names.items() if c != n}), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or too far from every language centroid, go."""
    models = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    told = docs.withColumn("__language", langid.predict(F.col("text"), models))
    return told.filter(~F.col("__language.rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing else is left."""
    rows, names = _aside(docs, "deduped")
    out = linededup.dedup(rows, LEAST_WORDS)
    out = out.filter((F.col("deduped.n_lines") == 0) | (F.col("deduped.n_removed") < F.col("deduped.n_lines")))
    new = {"text": F.col("deduped.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("deduped.text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(names[c])).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    copies = cut(neardup.link(docs, SHINGLE).filter(~F.col("kept")).select(F.col("doc_id").alias("__copy")).distinct(), "copies")
    return docs.join(copies, docs["doc_id"].eqNullSafe(copies["__copy"]), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, question and answer, go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    found = cut(found.select(F.col("doc_id").alias("__found")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__found"]), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for, with its place in the mixture."""
    rows, names = _aside(docs, "mixed")
    new = ("n_words", "turn", "block", "place")
    kept = [F.col(names[c]).alias(c) for c in docs.columns if c.lower() not in new]
    return mixing.mix(rows).select(*kept, *[f"mixed.{c}" for c in new])


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

# language centroids, band hashes and seeded permutations have no SQL form; tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
