"""Embedding near-duplicates by NN-descent.

Random hyperplanes start a neighbour graph, rounds of neighbours-of-neighbours
joins refine it.  A list whose neighbours all pass the threshold is saturated;
it is enlarged to the whole component that the threshold edges connect, which
is compared exactly, block against block.  An audit compares a sample with all
vectors; below the wanted recall, of links or of a linked vector's links, the
graph gets more starting tables, and in the end all vectors are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domus.llm.common import connected_components, cut, drop

MARGIN = 1e-4  # what single precision may be off by


def unit_rows(col: pa.Array) -> list[bytes | None]:
    """Unit vectors in double precision as bytes; None for vectors that link with
    nothing (null, zero, or with null or non-finite components)."""
    out: list[bytes | None] = []
    for v in col.to_pylist():
        x = None if v is None or None in v else np.array(v, np.float64)
        if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
            out.append(None)
            continue
        x = x / np.abs(x).max()
        out.append((x / np.linalg.norm(x)).tobytes())
    return out


def _stack(col, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), -1)


def _groups(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the rows of each distinct key."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    yield from np.split(order, np.flatnonzero(new))


_PAIRS = "a long, b long, sim float"


def _pairs_table(found: list[tuple]) -> pa.Table:
    a, b, s = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "sim": s.astype(np.float32)})


def _starting_pairs(classes: DataFrame, n: int, threshold: float, k: int, miss: float, seed: int,
                    rows: int = 48, hot: int = 512) -> DataFrame:
    """Nearest of each vector in its cells, over tables of random hyperplanes; a
    pair at the threshold shares no cell at a chance of ``miss``.  A cell of
    more than ``hot`` vectors is dealt into parts by a hash that differs by table."""
    bits = max(1, math.ceil(math.log2(max(2.0, n / rows))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    tables = max(2, math.ceil(math.log(miss) / math.log(1 - same)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            unit, dim = b.column("single").to_pylist(), np.array([len(x) // 4 for x in b.column("single").to_pylist()])
            cells = np.zeros((len(unit), tables), np.int64)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((d, tables * bits)).astype(np.float32)
                x = np.frombuffer(b"".join(unit[i] for i in at), np.float32).reshape(len(at), d)
                sign = (x @ planes[d] > 0).reshape(len(at), tables, bits)
                cells[at] = sign @ (1 << np.arange(bits)) + (int(d) << bits)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("single"),
                                              pa.array(list(cells), pa.list_(pa.int64()))],
                                             names=["node", "single", "cells"])

    coded = cut(classes.select("node", "single").mapInArrow(code, "node long, single binary, cells array<long>"), "nn-cells")
    spread = coded.select("node", "single", F.posexplode("cells")).toDF("node", "single", "table", "cell")
    hot_cells = cut(spread.groupBy("table", "cell").count().where(F.col("count") > hot)
                    .select("table", "cell", F.ceil(F.col("count") / hot).alias("salts")), "nn-hot")
    dealt = spread.join(hot_cells, ["table", "cell"], "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("node", "table"), F.col("salts")), F.lit(0)))
    per_task = max(64, 8 * rows)
    dealt = dealt.withColumn("job", F.pmod(F.xxhash64("table", "cell", "salt"), F.lit(max(1, n * tables // per_task)).cast("long")))

    def nearest(t: pa.Table) -> pa.Table:
        node, single = t["node"].to_numpy(), t["single"].to_pylist()
        found = []
        for at in _groups(t["table"].to_numpy(), t["cell"].to_numpy(), t["salt"].to_numpy()):
            if len(at) > 1:
                x = np.frombuffer(b"".join(single[i] for i in at), np.float32).reshape(len(at), -1)
                s = x @ x.T
                np.fill_diagonal(s, -2)
                m = min(k, len(at) - 1)
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                found.append((np.repeat(node[at], m), node[at][top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        return _pairs_table(found)

    return dealt.select("node", "single", "table", "cell", "salt", "job").groupBy("job").applyInArrow(nearest, _PAIRS)


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """(a, near array<struct<sim, b>>): the k best of each vector's pairs."""
    from pyspark.sql import Window
    both = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("a", "b", "sim")


def _refine(lists: DataFrame, classes: DataFrame, n: int, k: int) -> DataFrame:
    """One round: all pairs among each vector's neighbours and reverse neighbours
    that would enter either list.  A vector keeps its k best reverse
    neighbours here; what that leaves out, the components' comparison finds."""
    worst = lists.groupBy("a").agg(F.min("sim").alias("kth"), F.count("*").alias("held")) \
        .select(F.col("a").alias("b"), F.when(F.col("held") >= k, F.col("kth")).otherwise(F.lit(-2.0)).alias("kth"))
    reverse = _lists(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"), k)
    around = lists.select("a", "b").union(reverse.select("a", "b")).distinct()
    vecs = classes.select(F.col("node").alias("b"), "single")
    rows = around.join(vecs, "b").join(worst, "b", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0))) \
        .withColumn("job", F.pmod(F.xxhash64("a"), F.lit(max(1, n // 64)).cast("long")))

    def join(t: pa.Table) -> pa.Table:
        a, b, kth = t["a"].to_numpy(), t["b"].to_numpy(), t["kth"].to_numpy()
        single, found = t["single"].to_pylist(), []
        for at in _groups(a):
            if len({len(single[i]) for i in at}) > 1 or len(at) < 2:
                continue
            x = np.frombuffer(b"".join(single[i] for i in at), np.float32).reshape(len(at), -1)
            s = x @ x.T
            i, j = np.nonzero(s > kth[at][:, None])
            keep = i != j
            found.append((b[at][i[keep]], b[at][j[keep]], s[i[keep], j[keep]]))
        return _pairs_table(found)

    return rows.select("job", "a", "b", "kth", "single").groupBy("job").applyInArrow(join, _PAIRS)


def _within(labels: DataFrame, classes: DataFrame, threshold: float, rows: int = 256) -> tuple[DataFrame, DataFrame]:
    """Exact comparison inside each component, block against block: (node, links)
    counted over all members, and (src, dst) links that span what is connected."""
    placed = labels.withColumnRenamed("id", "node").join(classes.select("node", "m", "unit"), "node")
    sizes = labels.groupBy("component").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    member = placed.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    jobs = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(512).cast("long"))) \
        .otherwise(F.xxhash64("component", "x", "y"))
    member = member.withColumn("job", jobs).withColumn("small", F.col("blocks") == 1)

    def compare(t: pa.Table) -> pa.Table:
        node, m, unit = t["node"].to_numpy(), t["m"].to_numpy(), t["unit"].to_pylist()
        own, x, y = t["own"].to_numpy(), t["x"].to_numpy(), t["y"].to_numpy()
        out_n, out_l, src, dst = [], [], [], []
        for at in _groups(t["component"].to_numpy(), x, y):
            left, right = at[own[at] == x[at[0]]], at[own[at] == y[at[0]]]
            v = lambda rows: np.frombuffer(b"".join(unit[i] for i in rows), np.float64).reshape(len(rows), -1)
            if not len(left) or not len(right):
                continue
            near = v(left) @ v(right).T >= threshold
            near &= node[left][:, None] != node[right][None, :]
            out_n.append(node[left])
            out_l.append(near @ m[right])
            if x[at[0]] != y[at[0]]:
                out_n.append(node[right])
                out_l.append(near.T @ m[left])
            root = dict(zip(node[at].tolist(), node[at].tolist()))
            for i, j in zip(*np.nonzero(near)):
                p, q = int(node[left[i]]), int(node[right[j]])
                while root[p] != p:
                    root[p] = root[root[p]]
                    p = root[p]
                while root[q] != q:
                    root[q] = root[root[q]]
                    q = root[q]
                if p != q:
                    root[max(p, q)] = min(p, q)
                    src.append(int(node[left[i]]))
                    dst.append(int(node[right[j]]))
        n = np.concatenate(out_n) if out_n else np.empty(0, np.int64)
        links = np.concatenate(out_l) if out_l else np.empty(0, np.int64)
        pad = [None] * len(src)
        return pa.table({"node": pa.array([*n.tolist(), *pad], pa.int64()), "links": pa.array([*links.tolist(), *pad], pa.int64()),
                         "src": pa.array([*[None] * len(n), *src], pa.int64()),
                         "dst": pa.array([*[None] * len(n), *dst], pa.int64())})

    done = cut(member.select("component", "node", "m", "unit", "own", "x", "y", "job", "small").groupBy("small", "job")
               .applyInArrow(compare, "node long, links long, src long, dst long"), "nn-within")
    counts = done.where(F.col("node").isNotNull()).groupBy("node").agg(F.sum("links").alias("links"))
    return counts, done.where(F.col("src").isNotNull()).select("src", "dst")


def _audit(classes: DataFrame, threshold: float, sample: int) -> DataFrame:
    """(src, dst): true links of the ``sample`` vectors with the least hash, by
    comparing them with every vector.  The sample is all that is sent to tasks."""
    picked = classes.orderBy(F.xxhash64("node"), "node").limit(sample).select("node", "unit").collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r.unit) for r in picked}:
        own = [r for r in picked if len(r.unit) == d]
        by_dim[d] = (np.array([r.node for r in own]), np.frombuffer(b"".join(bytes(r.unit) for r in own), np.float64).reshape(len(own), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, unit = b.column("node").to_numpy(), b.column("unit").to_pylist()
            src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for d, (ids, q) in by_dim.items():
                at = np.array([i for i, u in enumerate(unit) if len(u) == d], np.int64)
                if len(at):
                    x = np.frombuffer(b"".join(unit[i] for i in at), np.float64).reshape(len(at), -1)
                    i, j = np.nonzero(x @ q.T >= threshold)
                    keep = node[at[i]] != ids[j]
                    src.append(ids[j[keep]])
                    dst.append(node[at[i[keep]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    return classes.select("node", "unit").mapInArrow(run, "src long, dst long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                 k: int = 8, rounds: int = 3, recall: float = 0.99, sample: int = 256, miss: float = 0.001,
                 seed: int = 7, tries: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: how many other rows'
    vectors have cosine >= ``threshold``, the smallest id reachable by such
    links, and whether the row has that id.

    Equal vectors are one node with a weight from the start.  Null, zero and
    empty vectors and those with null or non-finite components link with
    nothing, as do vectors of different lengths with each other.  Rows with a
    null id link with nothing and are kept.  Rows that repeat an id count as
    vectors each.  Refinement ends when a round adds less than a thousandth to
    the threshold edges, or after ``rounds``.  If the audit still falls short of
    ``recall`` after ``tries``, all vectors of a length are compared with each
    other, block against block.  Other columns are not read.
    """
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unit_rows(b.column("v"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(u, pa.binary())], names=["id", "unit"])

    rows = cut(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
               .mapInArrow(units, "id long, unit binary").withColumn(
                   "key", F.when(F.col("id").isNotNull() & F.col("unit").isNotNull(), F.sha2("unit", 256))), "nn-rows")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [np.frombuffer(u, np.float64).astype(np.float32).tobytes() for u in b.column("unit").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "rep", "m", "unit")), pa.array(s, pa.binary())],
                                             names=["key", "rep", "m", "unit", "single"])

    classes = cut(rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("id").alias("rep"), F.count("*").alias("m"), F.first("unit").alias("unit"))
        .mapInArrow(single, "key string, rep long, m long, unit binary, single binary")
        .withColumn("node", F.monotonically_increasing_id()), "nn-classes")
    n = classes.count()
    edges = cut(_audit(classes, threshold, sample), "nn-audit") if n else classes.selectExpr("node src", "node dst").limit(0)
    sampled = edges.count()
    linked = max(1, edges.select("src").distinct().count())
    known = edges.limit(0)
    for attempt in range(tries):
        lists = cut(_lists(_starting_pairs(classes, max(n, 1), threshold, k, miss, seed + attempt), k), "nn-lists")
        close = lists.where(F.col("sim") >= threshold - MARGIN).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        n_edges = close.count()
        for _ in range(rounds if n > k else 0):
            found = _refine(lists, classes, n, k)
            better = cut(_lists(lists.union(found), k), "nn-lists")
            close = better.where(F.col("sim") >= threshold - MARGIN).select(F.col("a").alias("src"), F.col("b").alias("dst"))
            drop(lists)
            lists, before, n_edges = better, n_edges, close.count()
            if n_edges - before <= before / 1000:
                break
        known = known.union(close)  # of all attempts
        labels = connected_components(known, "nn")
        seen = edges.join(labels.toDF("src", "cs"), "src").join(labels.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst")
        each = edges.groupBy("src").agg(F.count("*").alias("n")).join(
            seen.groupBy("src").agg(F.count("*").alias("s")), "src", "left").agg(
            F.sum("s").alias("s"), F.sum(F.coalesce("s", F.lit(0)) / F.col("n")).alias("share")).first()
        whole = (each.s or 0) >= recall * sampled and (each.share or 0) >= recall * linked if sampled else True
        if whole:
            break
    if not whole:  # what the tables can't find is left to a comparison of all with all
        labels = classes.select(F.col("node").alias("id"), F.octet_length("unit").cast("long").alias("component"))
        counts, links = _within(labels, classes, threshold, rows=2048)
        return _named(rows, classes, counts, links)
    # the audit's own links are true ones, too
    labels = connected_components(labels.select(F.col("id").alias("src"), F.col("component").alias("dst")).union(edges), "nn")
    counts, links = _within(labels, classes, threshold)
    return _named(rows, classes, counts, links)


def _named(rows: DataFrame, classes: DataFrame, counts: DataFrame, links: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of all rows from the exact links of the distinct vectors."""
    final = connected_components(links, "nn-final")
    named = classes.select("node", "key", "rep", "m").join(final.withColumnRenamed("id", "node"), "node", "left") \
        .withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = cut(named.join(lowest, "component").select(
        "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), "nn-ids")
    out = rows.select("id", "key").join(ids, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
