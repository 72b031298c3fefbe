"""Merkle manifest, whitening and the graph index against plain versions."""
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from domus.llm import graph_index, merkle, whitening
from domus.llm import queries as Q

SF = "/root/testdata/sf0.001"


# ---- Merkle manifest

def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_merkle(rows):
    """[(doc_id, leaf, subroot, root, proof hash, folded root)] of (doc_id, source, lang, n_chars, text)."""
    def leaf(r):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def climb(nodes):
        """Top of a tree, and for each leaf its [(left, right)] upwards."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[a:a + 16] for a in range(0, len(nodes), 16)]
            for i, p in enumerate(at):
                run = runs[p // 16]
                paths[i].append(("".join(run[:p % 16]), "".join(run[p % 16 + 1:])))
            at = [p // 16 for p in at]
            nodes = [H("".join(r)) for r in runs]
        return nodes[0], paths

    def bad(r):
        return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0

    def lowered(t):
        return t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own])))
    root, upper = climb([t[1] for t in trees])
    out = []
    for (own, subroot, paths), above in zip(trees, upper):
        for r, path in zip(own, paths):
            f = leaf((*r[:4], lowered(r[4]))) if bad(r) else leaf(r)
            for left, right in path + above:
                f = H(left + f + right)
            proof = H("".join(a + b for a, b in path + above))
            out.append((r[0], leaf(r), subroot, root, proof, f, f == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, i long, m long, digest string, path string"


def merkle_rows(spark, rows):
    df = spark.createDataFrame([(*r, *("x", 1, 2, "y", "z")) for r in rows], SCHEMA).repartition(3)
    return merkle.verify_documents(df).select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof_of(F.col("path"))),
                                              "folded_root", "verified")


def test_merkle_odd_rows(spark):
    rows = [(d, s, None if d % 7 == 0 else "en", d * 3, f"Text {d} É\nB" * (d % 4)) for s, n in
            ((None, 3), ("", 1), ("a", 17), ("é", 16), ("b", 1), ("big", 273)) for d in range(n)]
    rows += [(None, None, None, None, None), (None, "a", "de", None, ""), (5, "a", "en", 15, "another FIVE"),
             *[(7, "same", "en", 3, "Same ROW")] * 40, (8, "long", None, 1, "Ab " * 60000)]
    rows += [(1000 + i, f"s{i}", "en", 1, "One") for i in range(20)]  # more than one run of sources
    key = lambda r: (str(r[0]), *r[1:])
    got = sorted((tuple(r) for r in merkle_rows(spark, rows).collect()), key=key)
    want = sorted(plain_merkle(rows), key=key)
    assert got == want
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("rows", [[], [(3, "a", "en", 1, "X")], [(None, None, None, None, None)]])
def test_merkle_small(spark, rows):
    assert [tuple(r) for r in merkle_rows(spark, rows).collect()] == plain_merkle(rows) if rows else \
        merkle_rows(spark, rows).collect() == []


def test_merkle_proves_some_rows_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tree, groups = merkle.manifest(docs, F.col("source"), F.col("doc_id"), [F.col("doc_id"), F.col("text")])
    some = tree.leaves.where("o % 9 = 0").select("g", "i", "o", "digest").withColumnRenamed("digest", "want").union(
        tree.leaves.limit(1).select("g", F.lit(10 ** 9).cast("long"), "o", "digest"))  # no such leaf
    out = merkle.prove(tree, groups, some).withColumn("up", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(out) == docs.where("doc_id % 9 = 0").count()
    assert all(r.up == r.root and bytes(r.want).hex() == r.leaf for r in out)


# ---- whitening

def eigen(x):
    z = x - x.mean(0)
    e, c = np.linalg.eigh(z.T @ z / len(x))
    return z, e[::-1], c[:, ::-1]


def frame(spark, vectors, ids=None):
    floats = [None if v is None else [None if c is None else float(c) for c in v] for v in vectors]
    rows = [(i, v, 1.5, "x") for i, v in zip(ids or range(len(vectors)), floats)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x double, component string").repartition(3)


def test_whitening_of_the_table(spark):
    rows = Q.op12_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r.vec_id for r in table]
    x = np.floor(1024 * np.array([r.embedding for r in table], float)) + 100000
    z, e, c = eigen(x)
    got, dev = np.zeros((len(x), 8)), {}
    at = {d: i for i, d in enumerate(ids)}
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        dev[r.vec_id] = r.deviation
        assert r.n == len(x) and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10 and r.identity_error < 1e-10
    want = z @ c[:, :8] / np.sqrt(e[:8])
    assert len(rows) == 8 * len(x)
    assert all(min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-9 for k in range(8))
    total = [int(t) for t in x.sum(0)]
    assert dev == {d: sum((len(x) * int(a) - t) ** 2 for a, t in zip(v, total)) for d, v in zip(ids, x)}


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = rng.standard_normal((60, 5)).round(3).tolist()
    good += [good[0]] * 30  # copies count
    odd = [None, [], [1.0, None, 0, 0, 0], [math.nan] * 5, [math.inf, 0, 0, 0, 0], [1.0, 2.0]]
    out = whitening.whiten(frame(spark, good + odd, [*range(89), None, *range(200, 206)])).collect()
    assert len(out) == 90 * 5 and sum(r.vec_id is None for r in out) == 5
    x = np.floor(1024 * np.array(good, np.float32).astype(float)) + 100000
    _, e, _ = eigen(x)
    assert np.allclose([r.explained for r in out[:5]], e / e.sum(), rtol=1e-9)
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 3)).collect() == []
    assert whitening.whiten(frame(spark, odd[:5])).collect() == []
    assert whitening.whiten(frame(spark, good).limit(0)).collect() == []
    far = whitening.whiten(frame(spark, [[1e9, 0.0], [-1e9, 0.0], [1e9, 2e9]])).collect()  # beyond 64 bits
    xs = [[int(1024 * np.float32(a)) + 100000 for a in v] for v in ([1e9, 0.0], [-1e9, 0.0], [1e9, 2e9])]
    s = [sum(v[j] for v in xs) for j in range(2)]
    assert {r.vec_id: int(r.deviation) for r in far} == {i: sum((3 * a - t) ** 2 for a, t in zip(v, s)) for i, v in enumerate(xs)}


@pytest.mark.parametrize("values", [[5.0] * 4 + [1.0] * 8, [3.0, 2.0] + [0.0] * 10, [1e4, 1e2, 1.0] + [1e-3] * 9,
                                    list(0.5 ** np.arange(12)), [7.0] * 12])
def test_bidiagonalisation_finds_equal_and_missing_values(values):
    rng = np.random.default_rng(2)
    u, v = (np.linalg.qr(rng.standard_normal((n, 12)))[0] for n in (50, 12))
    z = u * values @ v.T
    vectors, found, steps = whitening.bidiagonalise(lambda q: z.T @ (z @ q), 12, float((z ** 2).sum()), 4)
    assert np.allclose(found[:4], values[:4], rtol=1e-9, atol=2e-8 * values[0])
    for k in range(4):
        if values[k]:
            assert np.linalg.norm(z.T @ (z @ vectors[:, k]) - values[k] ** 2 * vectors[:, k]) < 1e-11 * values[0] ** 2
    assert np.allclose(vectors[:, :4].T @ vectors[:, :4], np.eye(4), atol=1e-12)


def test_bidiagonalisation_ends_early_where_nothing_can_be_missing():
    z = np.diag(0.3 ** np.arange(40.0)) @ np.linalg.qr(np.random.default_rng(1).standard_normal((40, 40)))[0]
    _, found, steps = whitening.bidiagonalise(lambda q: z.T @ (z @ q), 40, float((z ** 2).sum()), 4)
    assert steps < 40 and np.allclose(found[:4], 0.3 ** np.arange(4.0))


# ---- graph index

def plain_nearest(rows, k, step):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v
          and np.isfinite(v).all() and any(v)]
    ok = list({(i, v.tobytes()): (i, v) for i, v in ok}.values())
    out = {}
    for i, v in ok:
        if i % step == 0:
            s = [(-graph_index.cosines(v[None], w[None])[0], j) for j, w in ok if j != i and len(w) == len(v)]
            out.setdefault(i, []).append([(j, -t) for t, j in sorted(s)[:k]])
    return out


def test_index_on_odd_rows_and_copies(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 6)).astype(np.float32)
    vecs = [*base.tolist(), *([base[0].tolist()] * 120), *(2 * base[:20]).tolist(), None, [], [0.0] * 6, [1.0, None, 0, 0, 0, 0],
            [math.nan] * 6, [math.inf] * 6, [1.0, 2.0], [2.0, 1.0], (base[1] + 1e-4).tolist(), base[2].tolist(), base[3].tolist()]
    ids = [*range(len(vecs) - 2), None, 3]
    df = frame(spark, vecs, ids)
    got = {}
    for r in graph_index.nearest_neighbours(df, F.col("vec_id") % 10 == 0, shard_rows=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
        assert r.recall >= 0.95
    stored = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in zip(ids, vecs)]
    want = plain_nearest(stored, 5, 10)
    assert set(got) == set(want)
    same = 0
    for q, (best,) in want.items():
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, len(best) + 1))
        same += sum((i, s) in best for _, i, s in found)
    assert same >= 0.95 * sum(len(b) for b, in want.values())
    assert [i for _, i, _ in sorted(got[0])] == [j for j, _ in want[0][0]]  # copies, smallest ids first


def test_index_empty_and_alone(spark):
    df = frame(spark, [[1.0, 0.0]])
    assert graph_index.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert graph_index.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect() == []
    two = frame(spark, [[1.0, 0.0], [0.5, 0.5]])
    assert [(r.query_id, r["rank"], r.id) for r in graph_index.nearest_neighbours(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert graph_index.nearest_neighbours(two, F.col("vec_id") > 50).collect() == []


def test_beam_doubles_until_the_recall_is_reached(spark):
    x = np.random.default_rng(3).standard_normal((400, 32)).tolist()
    r = graph_index.nearest_neighbours(frame(spark, x), F.col("vec_id") % 4 == 0, width=1, degree=3, recall=1.0).first()
    assert r.recall == 1.0


def test_graph_reaches_every_node_and_prunes():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 8)).astype(np.float32)
    x[:100] = x[0] + 1e-6 * rng.standard_normal((100, 8))  # near copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, entries = graph_index.build_graph(x, degree=8, width=20)
    assert len(graph_index._unreached(graph, entries)) == 0
    assert not (graph == np.arange(500)[:, None]).any()
    assert all(len(set(g[g >= 0])) == (g >= 0).sum() for g in graph)
    line = np.array([[1, 0], [0.999, 0.0447], [0.995, 0.0999], [0, 1]], np.float32)
    kept = graph_index.robust_prune(line, np.array([0]), np.array([[1, 2, 3, 1]]), 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]  # 1 stands for 2, but is not enough closer to 3


def test_registered_index_finds_nearly_all(spark):
    rows = Q.op13_ann(spark, SF).collect()
    table = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = plain_nearest(table, 5, 50)
    hit = sum(r.vec_id in {i for i, _ in want[r.query_id][0]} for r in rows)
    assert len(rows) == 5 * len(want) and hit >= 0.95 * len(rows)
