"""The registered queries of this package and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, linededup, merkle, mixing, neardup, packing, periodicity, quality, secrets, toxicity, urlfilter
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES["op9_quality"] = op9_quality


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    out = licenses.scan(table(spark, folder, "documents"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


QUERIES["op2_licenses"] = op2_licenses


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES["op5_toxicity"] = op5_toxicity


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, folder, "documents")))


QUERIES["op6_secrets"] = op6_secrets


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


QUERIES["op10_language"] = op10_language


def op4_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.link(table(spark, folder, "documents"))


QUERIES["op4_neardup"] = op4_neardup


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES["op3_decontaminate"] = op3_decontaminate


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "mixed.n_words", "mixed.turn", "mixed.block", "mixed.place")


QUERIES["op7_mixing"] = op7_mixing


def op8_linededup(spark: SparkSession, folder: str) -> DataFrame:
    out = linededup.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    left = F.sha2(F.coalesce("deduped.text", F.lit("")), 256).alias("text_sha256")
    return out.select("doc_id", "deduped.n_lines", "deduped.n_removed", "deduped.removed", left)


QUERIES["op8_linededup"] = op8_linededup


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES["op11_packing"] = op11_packing


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # through a generator, so that the planted text is a column of its own and not written into all that reads it
    docs = docs.select("doc_id", F.explode(F.array(periodicity.planted(F.col("doc_id"), F.col("text")))).alias("text"))
    return periodicity.digest(periodicity.collapse(docs))


QUERIES["op12_periodic_runs"] = op12_periodic_runs


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return merkle.verify(merkle.manifest(docs, merkle.tampering(F.col("doc_id"), F.col("text"))))


def _merkle_sql(source_levels: int = 8, top_levels: int = 6) -> str:
    """Every level written out, for 16**8 documents of a source; a finished tree passes its root on unchanged."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    siblings = "coalesce(string_agg(h, '') OVER (PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN {}), '')"
    before, after = siblings.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), siblings.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
    parts = [
        f"""checks AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS crc FROM documents)""",
        """texts AS (SELECT *, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS told
  FROM checks)""",
        f"rows_0 AS (SELECT doc_id, source, {leaf('text')} AS h, {leaf('told')} AS claimed FROM texts)",
        "trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM rows_0 GROUP BY source)",
        """leaves AS (SELECT doc_id, tree, n, h, claimed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, claimed) - 1 AS idx
  FROM rows_0 JOIN trees ON rows_0.source IS NOT DISTINCT FROM trees.source)""",
        "s_n0 AS (SELECT tree, idx, n, h FROM leaves)",
    ]

    def climb(name: str, levels: int) -> None:
        for k in range(levels):
            parts.append(f"{name}_r{k} AS (SELECT tree, idx, n, h, {before} AS l, {after} AS r FROM {name}_n{k})")
            parts.append(
                f"{name}_n{k + 1} AS (SELECT tree, idx // 16 AS idx, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(h || r) ELSE h END AS h"
                f" FROM {name}_r{k} WHERE idx % 16 = 0)"
            )

    def follow(name: str, levels: int, rows: str, idx: str) -> str:
        for k in range(levels):
            parts.append(
                f"{name}_p{k} AS (SELECT p.* EXCLUDE (proof, folded), p.proof || r.l || r.r AS proof,"
                f" CASE WHEN r.n > 1 THEN sha256(r.l || p.folded || r.r) ELSE p.folded END AS folded"
                f" FROM {rows} p JOIN {name}_r{k} r ON r.tree = p.{'tree' if name == 's' else 'top'} AND r.idx = p.{idx} // {16**k})"
            )
            rows = f"{name}_p{k}"
        return rows

    climb("s", source_levels)
    parts.append(f"t_n0 AS (SELECT 0 AS tree, tree AS idx, count(*) OVER () AS n, h FROM s_n{source_levels})")
    climb("t", top_levels)
    parts.append("start AS (SELECT doc_id, tree, 0 AS top, idx, h AS leaf, '' AS proof, claimed AS folded FROM leaves)")
    rows = follow("t", top_levels, follow("s", source_levels, "start", "idx"), "tree")
    return f"""WITH {', '.join(parts)}
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = t.h AS verified
FROM {rows} p JOIN s_n{source_levels} s ON s.tree = p.tree CROSS JOIN t_n{top_levels} t"""


QUERIES["op13_merkle"] = op13_merkle
ORACLES["op13_merkle"] = _merkle_sql()


# --- URL filters: captures are the pages, fetched on a day that follows from the page's hash; the dated list entries
# follow from the hosts and paths of the pages themselves, so captures and lists both grow with the table

_FIRST_DAY = "2024-01-01"


def _digits(text: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("int")


def page_captures(pages: DataFrame) -> DataFrame:
    day = F.date_add(F.lit(_FIRST_DAY).cast("date"), F.pmod(_digits(F.col("page_id").cast("string"), 1), F.lit(365)))
    return pages.select("page_id", "url", day.alias("fetched_on"))


def page_lists(pages: DataFrame) -> DataFrame:
    """A third of the hosts is listed for a while, some twice; a tenth of the first path parts; some hosts are allowed."""
    urls = pages.select(F.explode(urlfilter.url_keys(F.col("url"))).alias("k")).select("k.kind", "k.value").distinct()
    day = lambda at, span: F.pmod(_digits(F.col("value"), at), F.lit(span))
    start, length = day(1, 200), day(5, 120) + 10
    kind = F.pmod(_digits(F.col("value"), 9), F.lit(30))
    dated = lambda name, effect, n, action: F.struct(
        F.lit(name).alias("list"), F.lit(effect).alias("effect"), n.alias("day"), F.lit(action).alias("action")
    )
    none = F.array().cast("array<struct<list:string,effect:string,day:int,action:string>>")
    entries = (
        F.when((F.col("kind") == "domain") & (kind < 5), F.array(dated("spam", "block", start, "add"), dated("spam", "block", start + length, "remove")))
        .when((F.col("kind") == "domain") & (kind < 10), F.array(
            dated("adult", "block", start, "add"), dated("adult", "block", start + length, "remove"),
            dated("adult", "block", start + length + 20, "add")))
        .when((F.col("kind") == "domain") & (kind < 12), F.array(dated("trusted", "allow", start, "add")))
        .when((F.col("kind") == "prefix") & (kind < 3), F.array(dated("paths", "block", start, "add"), dated("paths", "block", start + length, "remove")))
        .when((F.col("kind") == "url") & (kind < 2), F.array(dated("urls", "block", start, "add")))
        .otherwise(none)
    )
    rows = urls.select("kind", "value", F.explode(entries).alias("e"))
    listed = F.date_add(F.lit(_FIRST_DAY).cast("date"), F.col("e.day")).alias("listed_on")
    return rows.select("e.list", "e.effect", "kind", "value", listed, "e.action")


def op1_urlfilter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    out = urlfilter.evaluate(page_captures(pages), page_lists(pages))
    text = lambda c: F.col(c).cast("string").alias(c)
    return out.select("page_id", "url", text("fetched_on"), "blocked", "allowed", "lists", text("since"))


QUERIES["op1_urlfilter"] = op1_urlfilter
ORACLES["op1_urlfilter"] = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + (('0x' || substr(md5(page_id::VARCHAR), 1, 4))::INT % 365) AS fetched_on FROM pages),
parts AS (
  SELECT DISTINCT url, host, host || CASE WHEN path = '' THEN '/' ELSE path END AS plain FROM (
    SELECT url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#@]+)', 1)), '.') AS host,
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path
    FROM pages WHERE url IS NOT NULL) WHERE host <> ''),
url_keys AS (
  SELECT url, 'domain' AS kind, array_to_string(string_split(host, '.')[i:], '.') AS value
  FROM parts, unnest(generate_series(1, len(string_split(host, '.')))) AS g(i)
  UNION ALL
  SELECT url, 'prefix', array_to_string(string_split(plain, '/')[1:i], '/') || '/'
  FROM parts, unnest(generate_series(1, len(string_split(plain, '/')) - 1)) AS g(i)
  UNION ALL SELECT url, 'url', plain FROM parts),
numbers AS (
  SELECT kind, value, ('0x' || substr(md5(value), 1, 4))::INT % 200 AS s, ('0x' || substr(md5(value), 5, 4))::INT % 120 + 10 AS l,
         ('0x' || substr(md5(value), 9, 4))::INT % 30 AS k
  FROM (SELECT DISTINCT kind, value FROM url_keys)),
entries AS (
  SELECT 'spam' AS list, 'block' AS effect, kind, value, s AS day, 'add' AS action FROM numbers WHERE kind = 'domain' AND k < 5
  UNION ALL SELECT 'spam', 'block', kind, value, s + l, 'remove' FROM numbers WHERE kind = 'domain' AND k < 5
  UNION ALL SELECT 'adult', 'block', kind, value, s, 'add' FROM numbers WHERE kind = 'domain' AND k >= 5 AND k < 10
  UNION ALL SELECT 'adult', 'block', kind, value, s + l, 'remove' FROM numbers WHERE kind = 'domain' AND k >= 5 AND k < 10
  UNION ALL SELECT 'adult', 'block', kind, value, s + l + 20, 'add' FROM numbers WHERE kind = 'domain' AND k >= 5 AND k < 10
  UNION ALL SELECT 'trusted', 'allow', kind, value, s, 'add' FROM numbers WHERE kind = 'domain' AND k >= 10 AND k < 12
  UNION ALL SELECT 'paths', 'block', kind, value, s, 'add' FROM numbers WHERE kind = 'prefix' AND k < 3
  UNION ALL SELECT 'paths', 'block', kind, value, s + l, 'remove' FROM numbers WHERE kind = 'prefix' AND k < 3
  UNION ALL SELECT 'urls', 'block', kind, value, s, 'add' FROM numbers WHERE kind = 'url' AND k < 2),
states AS (
  SELECT c.url, c.fetched_on, e.list, e.effect, e.kind, e.value, DATE '2024-01-01' + e.day AS listed_on, e.action,
         row_number() OVER (PARTITION BY c.url, c.fetched_on, e.list, e.effect, e.kind, e.value ORDER BY e.day DESC) AS latest
  FROM (SELECT DISTINCT url, fetched_on FROM captures) c JOIN url_keys u ON u.url = c.url
  JOIN entries e ON e.kind = u.kind AND e.value = u.value AND DATE '2024-01-01' + e.day <= c.fetched_on),
verdicts AS (
  SELECT url, fetched_on, bool_or(effect = 'block') AS blocking, bool_or(effect = 'allow') AS allowed,
         string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(listed_on) FILTER (effect = 'block') AS since
  FROM states WHERE latest = 1 AND action = 'add' GROUP BY url, fetched_on)
SELECT page_id, c.url, strftime(c.fetched_on, '%Y-%m-%d') AS fetched_on, coalesce(blocking, false) AND NOT coalesce(allowed, false) AS blocked,
       coalesce(allowed, false) AS allowed, coalesce(lists, '') AS lists, strftime(since, '%Y-%m-%d') AS since
FROM captures c LEFT JOIN verdicts v ON v.url = c.url AND v.fetched_on = c.fetched_on
"""
