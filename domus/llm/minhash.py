"""Near-duplicate documents by bottom-k sketches and exact verification.

A document's word shingles are hashed once; its sketch keeps the k smallest
hashes.  Inverted lists of the retained values bring documents together that
can overlap enough, an estimate on the sketch of the union filters the pairs,
and the exact Jaccard index of the full sets decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domus.llm.common import connected_components, cut, drop, shuffle_partitions, text_or_empty

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept for those seen lately."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 63-bit hashes of the distinct ``width``-word shingles of a text, A-Z
    lower-cased, words between ASCII white space; fewer words are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(width, len(w)), np.uint64)
    for i in range(min(width, len(w))):
        h = _mix((h ^ w[i:i + n]) + _STEP)
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketch_share(k: int, num: int, den: int, sigmas: float) -> int:
    """Retained values that two linked documents with more than k shingles share
    at least: the threshold's share of a sketch less ``sigmas`` standard deviations."""
    j = num / den
    return max(1, math.floor(k * j - sigmas * math.sqrt(k * j * (1 - j))))


def estimate_ok(a: np.ndarray, b: np.ndarray, na: int, nb: int, k: int, num: int, den: int, sigmas: float) -> bool:
    """False if the sketch of the union says that a and b can't link."""
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:][both[1:] == both[:-1]]
    if na <= k and nb <= k:
        return den * len(same) >= num * (na + nb - len(same))
    union = np.unique(both)[:k]  # the k smallest of the union are in one of the sketches
    shared = np.searchsorted(same, union[-1], "right")
    j = num / den
    return shared >= len(union) * j - sigmas * math.sqrt(len(union) * j * (1 - j))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(doc_id, n, set_key, sketch) of every row with a document id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_key(s) for s in sets], pa.binary()),
                 pa.array([s[:k] for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "n", "set_key", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, set_key binary, sketch array<long>")


class IdFilter:
    """Bloom filter of ids: bits are set for four places of each id's hash.

    It holds sixteen bits an id, but ``most_bits`` at most (8 MB): that bound
    makes it safe to send to every task.  Beyond it the filter lets more rows
    pass that the join after it then leaves out; it never holds back an id.
    """

    places, most_bits = 4, 1 << 26

    def __init__(self, ids: DataFrame, col: str):
        n = ids.count()
        self.mask = min(self.most_bits, 1 << max(13, (16 * n).bit_length())) - 1
        h = F.xxhash64(col)
        at = [(h.bitwiseAND(self.mask) + i * F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long")))
              .bitwiseAND(self.mask) for i in range(self.places)]
        words = ids.select(F.explode(F.array(*at)).alias("at")).groupBy(F.shiftright("at", 5).alias("word")) \
            .agg(F.bit_or(F.expr("shiftleft(1L, int(at & 31))")).alias("bits")).toArrow()
        self.words = np.zeros((self.mask + 1) >> 5, np.uint32)
        self.words[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Which of these xxhash64 values of ids may be of an id inside."""
        h = hashes.view(np.uint64)
        step, mask = (h >> np.uint64(32)) | np.uint64(1), np.uint64(self.mask)
        ok = np.ones(len(h), bool)
        for i in range(self.places):
            at = ((h & mask) + np.uint64(i) * step) & mask
            ok &= (self.words[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & 1 == 1
        return ok


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, shingles binary) for ``wanted`` (node, rep, set_key).  Texts of other
    documents are left out where they are read, so only wanted sets are shuffled."""
    inside = docs.sparkSession.sparkContext.broadcast(IdFilter(wanted, "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(inside.value.may_hold(b.column("h").to_numpy())))
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), pa.array([set_key(s) for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "set_key", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("rep"), text_or_empty(text_col).alias("text")) \
        .where(F.col("rep").isNotNull()).select("rep", "text", F.xxhash64("rep").alias("h"))
    # an id may repeat with another text, so the key of the set joins, too
    return rows.mapInArrow(run, "rep long, set_key binary, shingles binary").join(wanted, ["rep", "set_key"]) \
        .select("node", "shingles").dropDuplicates(["node"])


def _filter_pairs(pairs: DataFrame, classes: DataFrame, k: int, num: int, den: int, sigmas: float) -> DataFrame:
    """Pairs (a, b) that sizes and union sketches don't rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [estimate_ok(np.asarray(x.values), np.asarray(y.values), m, n, k, num, den, sigmas)
                    for x, y, m, n in zip(b.column("sa"), b.column("sb"), b.column("na").to_pylist(),
                                          b.column("nb").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]) \
                .filter(pa.array(keep, pa.bool_()))

    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias("n" + c),
                                    F.col("sketch").alias("s" + c))
    sized = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    return pairs.join(side("a"), "a").join(side("b"), "b").where(sized) \
        .select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _blocks(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (left, right) of the two blocks that each list of a job compares."""
    value, own, x, y = (t[c].to_numpy() for c in ("value", "own", "x", "y"))
    order = np.lexsort((y, x, value))
    new = np.zeros(len(order), bool)
    for c in (value, x, y):
        new[1:] |= c[order][1:] != c[order][:-1]
    for at in np.split(order, np.flatnonzero(new)):
        left = at[own[at] == x[at[0]]]
        right = left if x[at[0]] == y[at[0]] else at[own[at] == y[at[0]]]
        if len(left) and len(right):
            yield left, right


def _may_link(n: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of left x right are in different components and of sizes that allow a link."""
    m, o = n[left][:, None], n[right][None, :]
    return (comp[left][:, None] != comp[right][None, :]) & (np.minimum(m, o) * den >= np.maximum(m, o) * num)


def _common(flat: np.ndarray, cuts: np.ndarray, left: np.ndarray, right: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of left x right, from products of incidence
    matrices of at most ``cells`` cells each."""
    at = left if right is left else np.concatenate([left, right])
    vals = np.concatenate([flat[cuts[i]:cuts[i + 1]] for i in at])
    _, which, count = np.unique(vals, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[which] > 1)
    col = (np.cumsum(count > 1) - 1)[which[shared]]
    row = np.repeat(np.arange(len(at)), cuts[at + 1] - cuts[at])[shared]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    out = np.zeros((len(left), len(right)), np.int64)
    width = max(1, cells // len(at))
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [first, first + width])
        has = np.zeros((len(at), width), np.float32)
        has[row[a:b], col[a:b] - first] = 1
        out += (has[:len(left)] @ has[-len(right):].T).astype(np.int64)
    return out


def _block_pairs(rest: DataFrame, num: int, den: int, rows: int, shingles: int) -> DataFrame:
    """``rest`` with (own, x, y): each member in its block ``own``, once for every
    pair x <= y of blocks of its list that it takes part in.

    A list of at most ``rows`` members and ``shingles`` shingles is one block.
    In a longer one a component that fills half a block has blocks of its own;
    the others are dealt by size class (sizes in ratio of the threshold), then
    by component.  Two blocks meet unless both lie in the same component or no
    size in one is within the threshold of a size in the other."""
    def parts(count: str, total: str):
        return F.ceil(F.greatest(F.col(count) / rows, F.col(total) / shingles)).cast("long")

    size_class = F.floor(F.log("n") / math.log(den / num)).cast("long") if num < den else F.col("n")
    groups = rest.withColumn("class", size_class).groupBy("value", "component", "class") \
        .agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    lists = rest.groupBy("value").agg(F.count("*").alias("c"), F.sum("n").alias("s")) \
        .withColumn("blocks", parts("c", "s")).select("value", "blocks")
    lists = cut(lists, "near-blocks")
    groups = cut(groups.join(lists.where("blocks > 1").select("value"), "value"), "near-groups")
    large = groups.groupBy("value", "component").agg(F.sum("c").alias("c"), F.sum("s").alias("s")) \
        .where((F.col("c") * 2 >= rows) | (F.col("s") * 2 >= shingles)) \
        .select("value", "component", parts("c", "s").alias("large"))
    small = groups.join(large, ["value", "component"], "left_anti").groupBy("value", "class") \
        .agg(F.sum("c").alias("c"), F.sum("s").alias("s")).select("value", "class", parts("c", "s").alias("small"))
    dealt = rest.withColumn("class", size_class).join(lists, "value") \
        .join(large, ["value", "component"], "left").join(small, ["value", "class"], "left")
    own = F.when(F.col("blocks") <= 1, F.lit(0).cast("long")) \
        .when(F.col("large").isNotNull(),
              F.xxhash64(F.lit("component"), "component", F.pmod(F.xxhash64("node"), "large"))) \
        .otherwise(F.xxhash64(F.lit("class"), "class", F.pmod(F.xxhash64("component"), "small")))
    dealt = cut(dealt.withColumn("own", own).drop("class", "blocks", "large", "small"), "near-dealt")
    drop(groups)
    block = dealt.groupBy("value", "own").agg(F.min("n").alias("lo"), F.max("n").alias("hi"),
                                              F.min("component").alias("c1"), F.max("component").alias("c2"))
    side = lambda c: block.select("value", *[F.col(f).alias(c + f) for f in ("own", "lo", "hi", "c1", "c2")])
    apart = ~((F.col("ac1") == F.col("ac2")) & (F.col("bc1") == F.col("bc2")) & (F.col("ac1") == F.col("bc1")))
    sized = (F.col("ahi") * den >= F.col("blo") * num) & (F.col("bhi") * den >= F.col("alo") * num)
    pairs = side("a").join(side("b"), "value").where((F.col("aown") <= F.col("bown")) & apart & sized) \
        .select("value", F.col("aown").alias("x"), F.col("bown").alias("y"))
    ends = cut(pairs.select("value", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("own")), "near-meet")
    return dealt.join(ends, ["value", "own"])


def _across(rest: DataFrame, classes: DataFrame, k: int, num: int, den: int, sigmas: float, rows: int,
            shingles: int = 1 << 20) -> DataFrame:
    """(value, own, x, y, node, n, component): list members that may link with a
    member in another component, by the sketch of their union.  ``rest`` has
    value, node, n, component, posted.  A list is cut into blocks
    (``_block_pairs``); each task holds two blocks of a list and returns
    members, not pairs, so a list that many unlike documents share (a passage)
    is compared whole without a row for each pair.  A pair counts in the list
    of its least common posted value only."""
    def run(t: pa.Table) -> pa.Table:
        n, comp, value = (t[c].to_numpy() for c in ("n", "component", "value"))
        sketch, posted = t["sketch"].combine_chunks(), t["posted"].combine_chunks()
        flat, cuts = sketch.values.to_numpy(), sketch.offsets.to_numpy()
        names, at = posted.values.to_numpy(), posted.offsets.to_numpy()
        # both sketches of a pair hold all values up to the lesser of their ends, so what
        # they share there is a share of the union's sketch up to that value
        ends = np.where(n <= k, np.iinfo(np.int64).max, flat[cuts[1:] - 1])
        keep = [np.empty(0, np.int64)]
        for left, right in _blocks(t):
            ok = _may_link(n, comp, left, right, num, den)
            if not ok.any():
                continue
            common = _common(flat, cuts, left, right)
            held = lambda some, limits: np.stack([
                np.searchsorted(flat[cuts[r]:cuts[r + 1]], limits, "right") for r in some])
            union = held(left, ends[right]) + held(right, ends[left]).T - common
            whole, share = (n[left][:, None] <= k) & (n[right][None, :] <= k), num / den
            slack = np.where(whole, 1e-6, sigmas * np.sqrt(union * share * (1 - share)))
            ok &= common >= union * share - slack
            if ok.any():
                pair = left if right is left else np.concatenate([left, right])
                lesser = [v[v < value[left[0]]] for v in (names[at[i]:at[i + 1]] for i in pair)]
                i = np.arange(len(left))
                j = i if right is left else np.arange(len(left), len(pair))
                ok &= _common(np.concatenate(lesser), np.append(0, np.cumsum([len(v) for v in lesser])), i, j) == 0
            keep += [left[ok.any(1)], right[ok.any(0)]]
        keep = np.concatenate(keep)
        cols = ("value", "own", "x", "y", "node", "n", "component")
        return t.select(cols).take(pa.array(np.unique(keep)))

    member = _block_pairs(rest, num, den, rows, shingles)
    jobs = shuffle_partitions(rest.sparkSession) * 8
    member = member.join(classes.select("node", "sketch"), "node") \
        .withColumn("job", F.pmod(F.xxhash64("value", "x", "y"), F.lit(jobs).cast("long")))
    return member.groupBy("job").applyInArrow(
        run, "value long, own long, x long, y long, node long, n long, component long")


def _verify_blocks(met: DataFrame, sets: DataFrame, num: int, den: int, shingles: int = 1 << 22) -> DataFrame:
    """(src, dst): links by the full sets inside the block pairs of ``_across``;
    of each block pair the links that span what it connects."""
    def run(t: pa.Table) -> pa.Table:
        n, node, comp = (t[c].to_numpy() for c in ("n", "node", "component"))
        sizes = np.array([len(x.as_buffer()) // 8 for x in t["shingles"]], np.int64)
        flat = np.frombuffer(b"".join(t["shingles"].to_pylist()), np.int64)
        cuts = np.append(0, np.cumsum(sizes))
        src: list[int] = []
        dst: list[int] = []
        for left, right in _blocks(t):
            ok = _may_link(n, comp, left, right, num, den)
            if not ok.any():
                continue
            common = _common(flat, cuts, left, right)
            ok &= den * common >= num * (n[left][:, None] + n[right][None, :] - common)
            root: dict[int, int] = {}

            def top(p: int) -> int:
                while root.get(p, p) != p:
                    p = root[p]
                return p

            for i, j in zip(*np.nonzero(ok)):
                p, q = top(int(node[left[i]])), top(int(node[right[j]]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    src.append(int(node[left[i]]))
                    dst.append(int(node[right[j]]))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    total = met.agg(F.sum("n")).first()[0] or 0
    jobs = max(shuffle_partitions(met.sparkSession), total // shingles)
    return met.join(sets, "node").withColumn("job", F.pmod(F.xxhash64("value", "x", "y"), F.lit(jobs).cast("long"))) \
        .groupBy("job").applyInArrow(run, "src long, dst long")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("xa"), b.column("xb")):
                s, t = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                both = np.concatenate([s, t])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(den * same >= num * (len(both) - same))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]) \
                .filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias("x" + c))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb") \
        .mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80, k: int = 64, sigmas: float = 4.0, block_rows: int = 1024) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents link with 100 * intersection >= ``percent`` * union of their
    distinct ``width``-word shingles; component_id is the smallest id reachable.
    Equal sets are one class from the start, so copies meet in an aggregate.
    Each class is posted under its rarest retained values only, as many as
    any partner must share one of; frequent shingles come last, so a common
    phrase makes no long list.  The members of a list are first compared with
    two of it (the smallest and the largest class).  What then is in
    one component needs no more links; only pairs across components are left,
    and all of those are compared, blocks of about ``block_rows`` against each
    other.  Blocks of one component, or of sizes too unlike, don't meet.
    Sketches may miss a pair only where sets are larger than ``k``, at a
    chance of ``sigmas`` standard deviations; no list or group is cut short.

    Null and empty texts have no shingles and link with nothing; rows with a
    null id link with nothing and are kept (their component_id is null).  Rows
    that repeat an id are compared each.  Other columns are not read.
    """
    num, den = percent, 100
    rows = cut(sketches(docs, id_col, text_col, width, k), "near-rows")
    some = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = cut(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"),
                                              F.first("sketch").alias("sketch"))
                  .withColumn("node", F.monotonically_increasing_id()), "near-classes")
    posts = classes.select("node", F.explode("sketch").alias("value"))
    common = cut(posts.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "near-common")
    shared = posts.join(common, "value").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))
    held = F.least(F.col("n"), F.lit(k))
    sizes = classes.select("node", "n").where("n > 0")
    whole = F.ceil(F.col("n") * num / den)  # exact where both sketches hold whole sets
    least = F.when(F.col("n") * den <= k * num, whole).otherwise(
        F.least(whole, F.lit(sketch_share(k, num, den, sigmas))))
    prefix = held - least + 1 - (held - F.size("values"))  # values that no other class holds come first
    lists = cut(shared.join(sizes, "node").withColumn("take", prefix.cast("int")).where("take > 0")
                .select("node", "n", F.explode(F.slice("values", F.lit(1), F.col("take"))).alias("v"))
                .select("node", "n", F.col("v.value").alias("value")), "near-lists")
    hubs = cut(lists.groupBy("value").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"),
               "near-hubs")
    met = lists.join(hubs, "value")
    first = cut(met.select(F.col("lo").alias("a"), F.col("node").alias("b"))
                .union(met.select(F.col("node").alias("a"), F.col("hi").alias("b"))).where("a <> b")
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")

    def with_sets(sets: DataFrame | None, nodes: DataFrame, name: str) -> DataFrame:
        """``sets`` and those of the ``nodes`` that it lacks; texts are read only if some are lacking."""
        nodes = nodes.distinct() if sets is None else nodes.distinct().join(sets, "node", "left_anti")
        wanted = cut(classes.select("node", "rep", "set_key").join(nodes, "node"), f"{name}-wanted")
        if sets is None or wanted.limit(1).count():
            new = cut(full_sets(docs, wanted, id_col, text_col, width), f"{name}-sets")
            written.append(new)
            sets = new if sets is None else sets.union(new)
        drop(wanted)
        return sets

    written: list[DataFrame] = []
    close = cut(_filter_pairs(first, classes, k, num, den, sigmas), "near1-close")
    sets = with_sets(None, close.select(F.col("a").alias("node")).union(close.select("b")), "near1")
    links = cut(_verify(close, sets, num, den).toDF("src", "dst"), "near1-links")
    drop(close)
    labels = connected_components(links, "near1")
    placed = cut(lists.join(labels.withColumnRenamed("id", "node"), "node", "left")
                 .select("value", "node", "n", F.coalesce("component", "node").alias("component")), "near-placed")
    mixed = placed.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")) \
        .where("x < y").select("value")
    posted = lists.groupBy("node").agg(F.collect_list("value").alias("posted"))
    rest = cut(placed.join(mixed, "value").join(hubs, "value").where("node <> lo and node <> hi")
               .select("value", "node", "n", "component").join(posted, "node"), "near-rest")
    across = cut(_across(rest, classes, k, num, den, sigmas, block_rows), "near-across")
    sets = with_sets(sets, across.select("node"), "near2")
    more = cut(_verify_blocks(across, sets, num, den), "near2-links")
    drop(*written)
    if more.limit(1).count():
        labels = connected_components(links.union(more), "near2")
    drop(common, lists, hubs, first, placed, rest, across)
    named = classes.select("node", "set_key", "rep").join(labels.withColumnRenamed("id", "node"), "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = cut(named.join(lowest, "component").select("set_key", "component_id"), "near-ids")
    out = rows.drop("sketch").join(ids, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), component).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the
    smallest id; rows that repeat an id stay or go together."""
    kept = near_duplicates(docs, id_col, text_col, **how).where("kept").select(F.col("doc_id").alias("_near_id"))
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_near_id"]), "left_semi")
