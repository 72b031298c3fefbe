"""Merkle manifest of a dataset: a content-addressed DAG and proofs by descent.

Rows are leaves, ordered inside their group; every ``FANOUT`` consecutive nodes
become one until a group has one node, its subroot.  The subroots, ordered by
group, become the root in the same way.  The DAG is stored as records of a
node's digest and its children's digests, one table a level.  Leaf requests
descend from the root: the digits of a leaf's rank choose a child at each
level, the other children of the run are collected as one segment of the path.
Requests that share a prefix of digits descend as one row; they part at the
level where their digits do.  A path is reversed at the end, so that a proof
goes from the leaf to the root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domus.llm.common import ASCII_UPPER, cut, drop

FANOUT = 16
_PATH = "array<struct<left: string, right: string>>"


def digest(c: Column) -> Column:
    """Lowercase hex SHA-256 of a text in UTF-8."""
    return F.sha2(c, 256)


def value_text(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    v = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(F.concat(*[value_text(v) for v in values]))


def group_key(c: Column) -> Column:
    """A text without nulls that sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit(""))


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def at_level(level: int) -> Column:
    """How many nodes the group has at a level, from its number of leaves ``m``."""
    width = FANOUT ** level
    return F.expr(f"(m + {width - 1}L) div {width}L")


def height_of(m: int) -> int:
    level = 0
    while -(-m // FANOUT ** level) > 1:
        level += 1
    return level


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``i``, the rank in group ``g`` from 0, and ``m``, the group's size.

    The rows are range-partitioned by (g, order), so a large group lies in many
    partitions; counts by (partition, group) give each its first rank.  Equal
    rows are dealt by their place in the input, so they may lie in several
    partitions, too; which of them comes first changes nothing.
    """
    keys = ["g", *order]
    placed = cut(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie")
                 .sortWithinPartitions(*keys, "_tie").drop("_tie").withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id()), f"{name}-placed")
    pieces = placed.groupBy("g", "_pid").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy("g")  # a row for each partition that the group lies in
    before = w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("g", "_pid", "_first", F.sum("_n").over(w).alias("m"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = cut(placed.join(pieces, ["g", "_pid"]).withColumn("i", F.col("_before") + F.col("_mid") - F.col("_first"))
              .drop("_pid", "_mid", "_first", "_before"), f"{name}-ranked")
    drop(placed)
    return out


@dataclass
class Tree:
    """Leaves (g, i, m, digest, ...), records (g, i, m, digest, children) of the levels
    from 1, and tops (g, m, digest), one row a group."""
    leaves: DataFrame
    levels: list[DataFrame] = field(default_factory=list)
    tops: DataFrame | None = None

    def records(self, level: int) -> DataFrame:
        """(digest, children) of a level, equal nodes once: what the DAG stores."""
        return self.levels[level - 1].select("digest", "children").dropDuplicates(["digest"])


def build_tree(leaves: DataFrame, name: str) -> Tree:
    """``leaves`` (g, i, m, digest binary): every ``FANOUT`` consecutive nodes of a
    group become one until one is left."""
    tree = Tree(leaves)
    largest = leaves.agg(F.max("m")).first()[0] or 0
    nodes, tops = leaves.select("g", "i", "m", "digest"), []
    for level in range(height_of(largest)):
        tops.append(nodes.where(at_level(level) == 1))
        run = F.array_sort(F.collect_list(F.struct("i", "digest")))
        up = nodes.where(at_level(level) > 1).groupBy("g", "m", F.expr(f"i div {FANOUT}L").alias("up")).agg(run.alias("run")) \
            .select("g", F.col("up").alias("i"), "m", F.col("run.digest").alias("children"))
        text = F.concat_ws("", F.transform("children", hexed))
        nodes = cut(up.withColumn("digest", F.unhex(digest(text))), f"{name}-level{level + 1}")
        tree.levels.append(nodes)
    tops.append(nodes.where(at_level(len(tree.levels)) == 1))
    # a group ends at one level only; below that it has more nodes, above it none
    tree.tops = tops[0].select("g", "m", "digest")
    for t in tops[1:]:
        tree.tops = tree.tops.union(t.select("g", "m", "digest"))
    return tree


def descend(tree: Tree, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (g, i, ...) with ``digest``, ``path`` and the columns of ``starts``.

    ``starts`` (g, m, digest, path, ...) has the top node of every group and the
    path that led there.  A level's rows are the prefixes that requests share;
    each meets its record by digest and is dealt to the prefixes one digit
    longer.  Requests themselves join at the last level only.
    """
    carried = [c for c in starts.columns if c not in ("g", "m", "digest", "path")]
    top = len(tree.levels)
    prefixes = {}
    below = requests.select("g", "i")
    for level in range(1, top + 1):
        below = below.select("g", F.expr(f"i div {FANOUT}L").alias("i")).distinct()
        prefixes[level] = below
    state = None
    done = []
    for level in range(top, 0, -1):
        size = at_level(level)
        entering = starts.where((size == 1) & (at_level(level - 1) > 1)).select("g", F.lit(0).cast("long").alias("i"), "digest", "path", *carried)
        state = entering if state is None else state.union(entering)
        opened = state.join(tree.records(level), "digest").select("g", F.col("i").alias("up"), "children", "path", *carried)
        wanted = requests if level == 1 else prefixes[level - 1]
        at = F.expr(f"int(i % {FANOUT}L)")
        side = lambda first, length: F.concat_ws("", F.transform(F.slice("children", first, length), hexed))
        segment = F.struct(side(F.lit(1), at).alias("left"), side(at + 2, F.lit(FANOUT)).alias("right"))
        # requests that repeat a rank are dealt each; a rank beyond the run is no leaf
        state = opened.join(wanted.withColumn("up", F.expr(f"i div {FANOUT}L")), ["g", "up"]).where(at < F.size("children")) \
            .withColumn("digest", F.get("children", at)).withColumn("path", F.concat("path", F.array(segment))) \
            .drop("up", "children")
        state = state.select("g", "i", "digest", "path", *carried, *[c for c in wanted.columns if c not in ("g", "i")])
    single = starts.where(F.col("m") == 1).select("g", F.lit(0).cast("long").alias("i"), "digest", "path", *carried) \
        .join(requests, ["g", "i"])
    done = [state] if state is not None else []
    out = single
    for d in done:
        out = d.select(single.columns).union(out)
    return out


def proof_of(path: Column) -> Column:
    """Siblings from the leaf to the root, each level's left to right."""
    return F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(F.reverse(path), leaf, lambda d, s: digest(F.concat(s["left"], d, s["right"])))


def manifest(rows: DataFrame, group: Column, order: Column, values: Sequence[Column], **carried: Column) -> tuple[Tree, Tree]:
    """Trees of the groups' leaves and of their subroots.

    ``values`` make a leaf's digest.  Leaves ascend by ``order`` (nulls first),
    ties by digest; rows that are equal in all of that are leaves each.
    ``carried`` columns stay with the leaves.
    """
    leaves = cut(rows.select(group_key(group).alias("g"), order.alias("o"), F.unhex(leaf_digest(*values)).alias("digest"),
                             *[c.alias(name) for name, c in carried.items()]), "merkle-leaves")
    tree = build_tree(ranked(leaves, ["o", "digest"], "merkle"), "merkle")
    drop(leaves)
    subroots = tree.tops.select(F.lit("").alias("g"), F.col("g").alias("o"), "digest")
    return tree, build_tree(ranked(subroots, ["o"], "merkle-groups"), "merkle-groups")


def prove(tree: Tree, groups: Tree, requests: DataFrame) -> DataFrame:
    """``requests`` (g, i, ...) with leaf, subroot, root (hex) and path."""
    empty = F.from_json(F.lit("[]"), _PATH)
    root = groups.tops.select("g", "m", "digest", empty.alias("path"), hexed(F.col("digest")).alias("root"))
    wanted = groups.leaves.select("g", "i", F.col("o").alias("group"))
    found = descend(groups, root, wanted).select(F.col("group").alias("g"), "digest", "path", "root")
    sizes = tree.tops.select("g", "m")
    starts = cut(found.join(sizes, "g").withColumn("subroot", hexed(F.col("digest"))), "merkle-starts")
    return descend(tree, starts, requests).withColumn("leaf", hexed(F.col("digest"))).drop("digest")


def tampered(doc_id: Column) -> Column:
    """Whether a document's text is changed before it is held against its proof."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def verify_documents(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source",
                     value_cols: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified) of every row.

    The manifest covers the rows as they are; a claim's leaf comes from the row
    whose text has A-Z lower-cased if 5 divides the CRC-32 of its id, else from
    the row as it is.  Its root is folded from the claim and the proof's
    siblings.  Null ids come first in their group and are not tampered with, a
    null group is the first one, nulls in any value make the leaf's ``-``.
    Rows that repeat an id are leaves each, ordered by digest.  No rows give no
    rows.  Columns other than the named ones are not read.
    """
    value = [F.col(c) for c in value_cols]
    lowered = [F.translate(c, ASCII_UPPER, ASCII_UPPER.lower()) if name == "text" else c for c, name in zip(value, value_cols)]
    claim = F.when(tampered(F.col(id_col)), F.unhex(leaf_digest(*lowered)))
    rows = docs.select(*{id_col, group_col, *value_cols})
    tree, groups = manifest(rows, F.col(group_col), F.col(id_col).cast("long"), value, claim=claim)
    requests = tree.leaves.select("g", "i", F.col("o").alias("doc_id"), "claim")
    out = prove(tree, groups, requests)
    folded = fold(F.coalesce(hexed(F.col("claim")), F.col("leaf")), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", "path", folded.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
