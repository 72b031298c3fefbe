"""Approximate nearest neighbours on robust-pruned directed graphs.

Distinct vectors are dealt into shards.  Each shard's graph grows in batches:
a greedy search from the shard's entry proposes the neighbours of a new node,
pruning keeps the near ones that no kept one is closer to by a relaxed
factor, and a kept neighbour gets an edge back.  A second pass searches and
prunes every node anew on the whole graph.  Queries run a beam search in every
shard; the best of all shards are merged.  A sample of the queries is compared
with all vectors; short of the wanted recall, the beam doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domus.llm.common import cut, drop
from domus.llm.vectors import unit_rows


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int,
                trail: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ids and similarities (rows of ``width``, -1 and -inf where there are fewer) that a
    greedy search holds when all of them are opened, for every row of ``q``; with
    ``trail`` also the nodes that it opened on its way."""
    n, m = len(x), len(q)
    width = min(width, n)
    ids = np.full((m, width), -1, np.int64)
    sims = np.full((m, width), -np.inf, np.float32)
    opened = np.ones((m, width), bool)
    seen = np.zeros((m, n), bool)
    first = q @ x[entries].T
    top = np.argsort(-first, axis=1, kind="stable")[:, :width]
    k = top.shape[1]
    ids[:, :k], sims[:, :k], opened[:, :k] = entries[top], np.take_along_axis(first, top, 1), False
    seen[:, entries] = True
    visited: list[np.ndarray] = []
    active = np.arange(m)
    while len(active):
        waiting = np.where(opened[active], -np.inf, sims[active])
        at = waiting.argmax(1)
        go = waiting[np.arange(len(active)), at] > -np.inf
        active, at = active[go], at[go]
        if not len(active):
            break
        node = ids[active, at]
        opened[active, at] = True
        if trail:
            step = np.full(m, -1, np.int64)
            step[active] = node
            visited.append(step)
        near = graph[node]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        row, col = np.nonzero(fresh)
        if not len(row):
            continue
        who, found = active[row], near[row, col]
        seen[who, found] = True
        score = np.full(near.shape, -np.inf, np.float32)
        score[row, col] = np.einsum("ij,ij->i", q[who], x[found])
        all_sims = np.concatenate([sims[active], score], 1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), best, 1)
        sims[active] = np.take_along_axis(all_sims, best, 1)
        opened[active] = np.take_along_axis(np.concatenate([opened[active], ~fresh], 1), best, 1)
    return np.where(sims > -np.inf, ids, -1), sims, np.stack(visited, 1) if visited else None


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float,
                 cells: int = 1 << 22) -> np.ndarray:
    """At most ``degree`` of each node's candidates (-1: none): the nearest, then the
    nearest that no kept one is ``relax`` times closer to than the node is.  Holds
    vectors of about ``cells`` numbers at a time."""
    step = max(1, cells // (candidates.shape[1] * x.shape[1]))
    return np.concatenate([_prune(x, nodes[a:a + step], candidates[a:a + step], degree, relax)
                           for a in range(0, len(nodes), step)])


def _prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    c = np.where(candidates == nodes[:, None], -1, candidates)
    c = np.sort(c, axis=1)  # equal ids stand together; one of them stays
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    v = x[c]
    own = np.einsum("bcd,bd->bc", v, x[nodes])
    own[c < 0] = -np.inf
    order = np.argsort(-own, axis=1, kind="stable")
    order = order[:, :max(1, int((c >= 0).sum(1).max(initial=0)))]
    c, own = np.take_along_axis(c, order, 1), np.take_along_axis(own, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    alive = c >= 0
    far = np.where(alive, np.maximum(2 - 2 * own, 0), np.inf)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for r in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        out[some, r] = c[some, pick[some]]
        between = np.maximum(2 - 2 * np.einsum("bcd,bd->bc", v, v[rows, pick]), 0)
        alive &= ~((relax * relax * between <= far) & some[:, None])
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = 24, width: int = 48, relax: float = 1.2, batch: int = 256,
                seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) of unit rows ``x``: out-neighbours, -1 where there are fewer, and
    the nodes where a search starts.  Every node can be reached from an entry."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    entry = np.array([int((x @ x.mean(0)).argmax())])
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != entry[0]]

    def link_back(nodes: np.ndarray) -> None:
        """An edge back from every out-neighbour, pruned where there are too many."""
        src = np.repeat(nodes, degree)
        dst = graph[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        new = ~(graph[dst] == src[:, None]).any(1)
        src, dst = src[new], dst[new]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads, start, count = np.unique(dst, return_index=True, return_counts=True)
        held = (graph[heads] >= 0).sum(1)
        slot = np.arange(len(dst)) - np.repeat(start, count) + np.repeat(held, count)
        room = np.repeat(held + count <= degree, count)
        graph[dst[room], slot[room]] = src[room]
        full = np.flatnonzero(held + count > degree)
        full = full[np.argsort(-count[full], kind="stable")]
        while len(full):  # long lists first, few at a time
            take = max(1, (1 << 17) // (degree + int(count[full[0]])))
            some, full = full[:take], full[take:]
            c = np.full((len(some), degree + int(count[some].max())), -1, np.int64)
            c[:, :degree] = graph[heads[some]]
            for i, f in enumerate(some):
                c[i, degree:degree + count[f]] = src[start[f]:start[f] + count[f]]
            graph[heads[some]] = robust_prune(x, heads[some], c, degree, relax)

    def place(nodes: np.ndarray) -> None:
        ids, _, trail = beam_search(x, graph, entry, x[nodes], width, trail=True)
        c = [ids, graph[nodes]] + ([trail] if trail is not None else [])
        graph[nodes] = robust_prune(x, nodes, np.concatenate(c, 1), degree, relax)
        link_back(nodes)

    done = 0
    while done < len(order):  # doubling, so that early nodes find one another
        size = min(batch, max(1, done))
        place(order[done:done + size])
        done += size
    for a in range(0, n, batch):
        place(np.arange(a, min(n, a + batch)))
    return graph, np.concatenate([entry, _unreached(graph, entry)])


def _unreached(graph: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Further entries: the first node that none before reaches, and so on."""
    reached = np.zeros(len(graph), bool)
    more = []

    def spread(front: np.ndarray) -> None:
        reached[front] = True
        while len(front):
            near = np.unique(graph[front])
            near = near[near >= 0]
            front = near[~reached[near]]
            reached[front] = True

    spread(entry)
    while not reached.all():
        more.append(int((~reached).argmax()))
        spread(np.array(more[-1:]))
    return np.array(more, np.int64)


def _stack(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of ``a`` with the same row of ``b``, in double precision; first scaled
    by their largest entries, so that no square is lost."""
    a, b = (v / np.abs(v).max(1, keepdims=True) for v in (a, b))
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def usable(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (key, vec, ids) with their k + 1 smallest ids, more of which no
    result can hold, and queries (query_id, key, vec)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [u is not None for u in unit_rows(b.column("v"))]
            vec = [np.array(v, np.float64).tobytes() if ok else None for v, ok in zip(b.column("v").to_pylist(), good)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("q"), pa.array(vec, pa.binary())], names=["id", "q", "vec"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                     F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull())
    rows = cut(rows.mapInArrow(run, "id long, q boolean, vec binary").where(F.col("vec").isNotNull())
               .withColumn("key", F.sha2("vec", 256)).groupBy("key", "id")
               .agg(F.max("q").alias("q"), F.first("vec").alias("vec")), "ann-rows")
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    few = rows.select("key", "id").withColumn("r", place).where(F.col("r") <= k + 1) \
        .groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    one = rows.groupBy("key").agg(F.min("id").alias("id")).join(rows.select("key", "id", "vec"), ["key", "id"]).drop("id")
    return one.join(few, "key"), rows.where("q").select(F.col("id").alias("query_id"), "key", "vec")


def build_index(classes: DataFrame, n: int, shard_rows: int, **how) -> DataFrame:
    """(dim, shard, pos, ids, vec, near, entry): the graphs of all shards, a node a row."""
    shards = max(1, -(-n // shard_rows))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")  # the same graph if the task runs again
        graph, entries = build_graph(_unit(_stack(t["vec"])), **how)
        entry = np.zeros(len(t), bool)
        entry[entries] = True
        near = pa.array([g[g >= 0] for g in graph], pa.list_(pa.int32()))
        return pa.table({"dim": t["dim"], "shard": t["shard"], "pos": pa.array(np.arange(len(t)), pa.int32()), "ids": t["ids"],
                         "vec": t["vec"], "near": near, "entry": pa.array(entry)})

    return classes.withColumn("dim", (F.octet_length("vec") / 8).cast("int")) \
        .withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards).cast("long")).cast("int")) \
        .select("dim", "shard", "key", "ids", "vec").groupBy("dim", "shard").applyInArrow(
            build, "dim int, shard int, pos int, ids array<long>, vec binary, near array<int>, entry boolean")


def search_index(index: DataFrame, queries: DataFrame, n: int, n_queries: int, k: int, width: int, shard_rows: int,
                 query_rows: int = 4096, at_once: int = 256) -> DataFrame:
    """(query_id, key, rank, id, score): the k best that a beam of ``width`` finds in all
    shards.  Queries are dealt into blocks; a block and a shard are one bounded group."""
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_rows))
    sides = queries.withColumn("dim", (F.octet_length("vec") / 8).cast("int")) \
        .withColumn("block", F.pmod(F.xxhash64("key", "query_id"), F.lit(blocks).cast("long")).cast("int")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    nodes = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "key": [], "id": [], "score": []}
        if len(nodes) and len(queries):
            nodes = nodes.sort_by("pos")
            vec, ids = _stack(nodes["vec"]), nodes["ids"].to_pylist()
            x = _unit(vec)
            lists = nodes["near"].to_pylist()
            graph = np.full((len(x), max(1, max(map(len, lists)))), -1, np.int64)
            for g, near in zip(graph, lists):
                g[:len(near)] = near
            entries = np.flatnonzero(nodes["entry"].to_numpy())
            q, qid, keys = _stack(queries["vec"]), queries["query_id"].to_pylist(), queries["key"].to_pylist()
            for a in range(0, len(q), at_once):
                part = q[a:a + at_once]
                found, sims, _ = beam_search(x, graph, entries, _unit(part), width)
                # k + 1 vectors hold k ids other than the query's; single precision may
                # have changed the order of those that are as near as the last of them
                m = min(k + 1, found.shape[1])
                last = -np.partition(-sims, m - 1, axis=1)[:, m - 1]
                row, col = np.nonzero((found >= 0) & (sims >= last[:, None] - 1e-5))
                score = cosines(part[row], vec[found[row, col]])
                hits: list[list] = [[] for _ in part]
                for r, node, s in zip(row, found[row, col], score):
                    hits[r].extend((-s, i) for i in ids[node] if i != qid[a + r])
                for r, h in enumerate(hits):
                    for s, i in sorted(h)[:k]:
                        for name, value in zip(out, (qid[a + r], keys[a + r], i, -s)):
                            out[name].append(value)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "key": pa.array(out["key"], pa.string()),
                         "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    by = ["dim", "shard", "block"]
    found = nodes.groupBy(*by).cogroup(sides.select(*by, "query_id", "key", "vec").groupBy(*by)).applyInArrow(
        search, "query_id long, key string, id long, score double")
    return _merge(found, k)


def _merge(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "key", "rank", "id", "score")


def exact_search(classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same for a few queries (all of them reach every task) by comparison with all vectors."""
    few = [(r.query_id, r.key, np.frombuffer(r.vec, np.float64)) for r in queries.collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            vecs, ids = [np.frombuffer(v, np.float64) for v in b.column("vec").to_pylist()], b.column("ids").to_pylist()
            dims = np.array([len(v) for v in vecs])
            for d in set(dims.tolist()):
                at = np.flatnonzero(dims == d)
                x = np.stack([vecs[i] for i in at])
                asked = [f for f in few if len(f[2]) == d]
                if not asked:
                    continue
                rough = _unit(x).astype(np.float64) @ _unit(np.stack([f[2] for f in asked])).T.astype(np.float64)
                for (qid, key, q), s in zip(asked, rough.T):
                    m = min(k + 1, len(s))  # k + 1 vectors, and those that may tie with the last of them
                    near = np.flatnonzero(s >= -np.partition(-s, m - 1)[m - 1] - 1e-5)
                    exactly = cosines(np.broadcast_to(q, x[near].shape), x[near])
                    hits = sorted((-t, i) for j, t in zip(near, exactly) for i in ids[at[j]] if i != qid)[:k]
                    out += [(qid, key, i, -t) for t, i in hits]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
                zip(*out) if out else [()] * 4, (pa.int64(), pa.string(), pa.int64(), pa.float64()))],
                names=["query_id", "key", "id", "score"])

    return _merge(classes.select("ids", "vec").mapInArrow(run, "query_id long, key string, id long, score double"), k)


def nearest_neighbours(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
                       recall: float = 0.95, sample: int = 128, width: int = 48, shard_rows: int = 4096, degree: int = 24,
                       relax: float = 1.2) -> DataFrame:
    """(query_id, rank, id, score, recall): the ``k`` rows of largest cosine found for
    each query row, ties to the smaller id.

    ``recall`` is the share of the exact neighbours found of ``sample`` queries
    (those with the least hash); below the wanted share the beam doubles, until
    it holds whole shards and so all vectors.  Null ids, and vectors that are
    null, zero, empty or hold null or non-finite components take no part;
    vectors of another length are no candidates.  A query never returns rows of
    its own id.  Rows that repeat id and vector count once; an id with several
    vectors is several candidates, and several queries.  Equal vectors are one
    node, so copies make no hub.  No rows or no queries give no rows.  Other
    columns are not read.
    """
    classes, queries = usable(df, id_col, vec_col, is_query, k)
    classes, queries = cut(classes, "ann-classes"), cut(queries, "ann-queries")
    n, n_queries = classes.count(), queries.count()
    index = cut(build_index(classes, n, shard_rows, degree=degree, relax=relax), "ann-index")
    few = cut(queries.orderBy(F.xxhash64("query_id", "key"), "query_id", "key").limit(sample), "ann-sample")
    exact = cut(exact_search(classes, few, k), "ann-exact")
    wanted = exact.count()
    while True:
        found = cut(search_index(index, queries, n, n_queries, k, width, shard_rows), "ann-found")
        hits = found.select("query_id", "key", "id").join(exact, ["query_id", "key", "id"]).count()
        share = hits / wanted if wanted else 1.0
        if share >= recall or width >= 2 * shard_rows:
            break
        width *= 2
        drop(found)
    drop(classes, few, exact, index)
    return found.select("query_id", "rank", "id", "score", F.lit(share).alias("recall"))
