"""Merkle manifest of a dataset: one tree for each source, one over the sources, proofs for all documents.

Leaves are numbered inside their source by a range sort and prefix sums over partition counts, so no source is gathered. On
every level each node meets by equality what the nodes of its run sent to its index, computed by ``FANOUT`` slot offsets: its
siblings; the rows in slot zero then emit the parents. Downwards, each node's siblings are put before those of its
parent, and a document's path is folded from its leaf.

Defined results: a null in a field is written as ``-``, a null source is a source of its own and comes first, null ids come first in it.
Leaves with equal id are ordered by their digest; rows that are wholly equal are separate, interchangeable leaves. An empty
table has no rows. Columns that are not among ``FIELDS`` take no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii, offsets

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def written(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[written(columns[c]) for c in FIELDS]), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """``rows`` with ``idx``, their place in their group by ``order``, ``size``, the group's rows, and ``group_no``, its rank.

    Rows are sorted by ranges; a group over many ranges is many counts, never one task. ``group`` must not be empty.
    """
    sort = [F.col(c).asc_nulls_first() for c in group + order]
    parted = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    # the id's upper bits are the partition, its lower bits the place in it
    place = F.monotonically_increasing_id()
    parted = cut(parted.withColumn("__at", place), label)
    parted = parted.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    counts = parted.groupBy("__part", *group).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    counts = cut(counts, f"{label}-counts")
    sizes = counts.groupBy(*group).agg(F.sum("__n").alias("size"))
    sizes = cut(_ranked(sizes, group, label), f"{label}-sizes")
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__before", F.coalesce(before, F.lit(0)))
    counts = _null_safe(counts, sizes, group).select("__part", *group, "size", "group_no", "__before", "__first")
    out = _null_safe(parted, counts, ["__part", *group])
    idx = F.col("__before") + F.col("__at") - F.col("__first")
    return out.select(*rows.columns, idx.alias("idx"), "size", "group_no")


def _ranked(groups: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Distinct groups with their rank, by ranges and the counts of these."""
    sort = [F.col(c).asc_nulls_first() for c in keys]
    rows = cut(groups.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()), f"{label}-groups")
    rows = rows.withColumn("part", F.shiftright("__at", 33))
    starts = offsets(rows.groupBy("part").agg(F.count("*").alias("n")))
    rank = F.col("before") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(starts), "part").withColumn("group_no", rank).drop("part", "before", "__at")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, nulls being equal; the keys of ``right`` go."""
    other = right.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [left[c].eqNullSafe(other[f"__r{i}"]) for i, c in enumerate(keys)]
    return left.join(other, on).drop(*[f"__r{i}" for i in range(len(keys))])


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digests: Column) -> Column:
    """Concatenated hex text of an array of digests."""
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, idx, size, digest, ...) with ``left`` and ``right``: the digests of a node's run before and after it."""
    run = F.col("idx") - F.col("idx") % FANOUT
    slots = F.filter(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda d: run + (F.col("idx") + d) % FANOUT), lambda s: s < F.col("size"))
    sent = nodes.select("tree", F.col("idx").alias("sibling"), F.col("digest").alias("given"), F.explode(slots).alias("idx"))
    own = [F.first(c).alias(c) for c in nodes.columns if c not in ("tree", "idx")]
    # grouped as it was joined, so the siblings are shuffled once
    found = nodes.join(sent, ["tree", "idx"]).groupBy("tree", "idx").agg(*own, F.sort_array(F.collect_list(F.struct("sibling", "given"))).alias("run"))
    side = lambda keep: F.transform(F.filter("run", keep), lambda s: s["given"])
    left, right = side(lambda s: s["sibling"] < F.col("idx")), side(lambda s: s["sibling"] > F.col("idx"))
    return found.select(*nodes.columns, left.alias("left"), right.alias("right"))


def parents(rows: DataFrame, sizes: Callable[[Column], Column]) -> DataFrame:
    """Slot-zero rows of a level emit the next one."""
    whole = F.concat(F.array("digest"), F.col("right"))
    zero = rows.filter(F.col("idx") % FANOUT == 0)
    return zero.select("tree", F.floor(F.col("idx") / FANOUT).alias("idx"), sizes(F.col("size")).alias("size"), _digest(_hex(whole)).alias("digest"))


def _up(size: Column) -> Column:
    return F.floor((size + (FANOUT - 1)) / FANOUT)


def forest(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, rows with siblings each, and the tops (tree, level, digest). Further columns stay on the lowest level."""
    levels, tops, level = [], None, 0
    while True:
        top = nodes.filter("size = 1").select("tree", F.lit(level).alias("level"), "digest")
        tops = top if tops is None else tops.unionByName(top)
        open_nodes = nodes.filter("size > 1")
        if open_nodes.isEmpty():
            return levels, tops
        rows = cut(with_siblings(open_nodes), f"{label}-level")
        levels.append(rows)
        nodes = cut(parents(rows, _up), f"{label}-nodes")
        level += 1


def paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, label: str) -> DataFrame:
    """``leaves`` with ``path``, the siblings on each level from the leaf upwards, and the rest of ``tops``.

    ``tops`` has tree, level, path and more; its path goes on above the tree.
    """
    more = [c for c in tops.columns if c not in ("tree", "level", "path")]
    at = lambda level: tops.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), "path", *more)
    above = at(len(levels))
    for level in range(len(levels) - 1, -1, -1):
        rows = levels[level].withColumn("up", F.floor(F.col("idx") / FANOUT))
        rows = rows.join(above.withColumnRenamed("idx", "up"), ["tree", "up"])
        rows = rows.withColumn("path", F.concat(F.array(F.struct("left", "right")), F.col("path"))).drop("left", "right", "up")
        if not level:  # not written: what follows folds the paths where they are joined
            alone = leaves.filter("size = 1").join(at(0).drop("idx"), "tree")
            return rows.unionByName(alone)
        above = cut(rows.select("tree", "idx", "path", *more).unionByName(at(level)), f"{label}-paths")
    return leaves.join(at(0).drop("idx"), "tree")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda at, step: F.sha2(F.concat(_hex(step["left"]), at, _hex(step["right"])), 256))


def proof(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(_hex(step["left"]), _hex(step["right"]))), "")


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, claimed, subroot, root, path) of every row of ``docs`` (``FIELDS``).

    ``claimed`` is the leaf with ``tampered_text`` in place of the text, where that differs; it takes no part in the tree. ``path`` holds the digests
    of a leaf's siblings, an entry (left, right) for each level.
    """
    own = {c: F.col(c) for c in FIELDS}
    claimed = leaf_of(own) if tampered_text is None else leaf_of(own | {"text": tampered_text})
    rows = docs.select("doc_id", "source", F.unhex(leaf_of(own)).alias("digest"), F.unhex(claimed).alias("claimed"))
    rows = rows.withColumn("claimed", F.when(F.col("claimed") != F.col("digest"), F.col("claimed")))
    leaves = numbered(rows, ["source"], ["doc_id", "digest", "claimed"], "merkle-leaves")
    leaves = cut(leaves.select("doc_id", "digest", "claimed", F.col("group_no").alias("tree"), "idx", "size"), "merkle-numbered")
    levels, subroots = forest(leaves, "merkle")
    subroots = cut(subroots, "merkle-subroots")

    n_sources = subroots.count()
    sources = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_sources).cast("long").alias("size"), "digest")
    top_levels, top = forest(sources, "merkle-top")
    empty = F.array().cast("array<struct<left:array<binary>,right:array<binary>>>")
    top = top.select("tree", "level", empty.alias("path"), F.lower(F.hex("digest")).alias("root"))
    above = paths(sources, top_levels, top, "merkle-top").select(F.col("idx").alias("tree"), "path", "root")
    tops = cut(subroots.select("tree", "level", F.lower(F.hex("digest")).alias("subroot")).join(above, "tree"), "merkle-tops")

    hexed = lambda c: F.lower(F.hex(c))
    return paths(leaves, levels, tops, "merkle").select(
        "doc_id", hexed("digest").alias("leaf"), hexed(F.coalesce("claimed", "digest")).alias("claimed"), "subroot", "root", "path"
    )


def verify(rows: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with proof_sha256, folded_root and verified instead of claimed and path."""
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.col("claimed"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampering(doc_id: Column, text: Column) -> Column:
    """The text in lower case (A-Z) where 5 divides the crc32 of the id; a null id is left alone."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, lower_ascii(text)).otherwise(text)
