"""Removal of repeated passages by sharded suffix arrays.

A shard is a stretch of documents.  Anchors, the least gram hash of every
window of ``length`` bytes, mark what can repeat at all: equal windows have
equal anchors at equal places.  Where an anchor repeats inside a shard, the
shard sorts the suffixes around it (Larsson-Sadakane refinement) and takes
common prefixes from Kasai's pass; windows with a common prefix of ``length``
repeat.  Anchors that several shards hold are merged across shards by a search
for the ends of the match that narrows down in two steps: stretches of windows
whose shared core is unique anywhere hold no repeat, stretches that are
equal as a whole hold nothing else, and only the few in between, where a match
begins or ends, are resolved window by window.  Every step counts fingerprints
in aggregates that combine inside the tasks, so no group of copies meets in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domus.llm.bpe import in_stretches
from domus.llm.common import cut, drop, text_or_empty

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for i, b in enumerate((BASE, inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hash of the gram that starts at each byte."""
    up, down = powers(len(data))
    total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up))
    h = (total[gram:] - total[:-gram]) * down[:len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    op, size = (np.minimum if least else np.maximum), 1
    while 2 * size <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, position, first, last) of the anchors of texts that end at ``ends``:
    the windows that start from first to last have this least gram, of equal
    ones the first."""
    span = length - gram + 1
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    h = gram_hashes(data, gram)
    starts = np.append(0, ends[:-1])
    inside = np.zeros(len(data) - length + 1, bool)  # windows within one text
    for a, b in zip(starts, ends):
        if b - a >= length:
            inside[a:b - length + 1] = True
    m = sliding(h, span, True)
    s = np.flatnonzero(inside)
    if not len(s):
        return none, none, none, none
    # the place of the least gram: search from each window's start among gram positions with that hash
    shown = sliding(np.concatenate([np.zeros(span - 1, np.uint64), np.where(inside, m, 0), np.zeros(span - 1, np.uint64)]),
                    span, False)[:len(h)]
    at = np.flatnonzero(shown == h)  # grams that are the least of some window
    first = np.searchsorted(at, s)
    owner = at[np.minimum(first, len(at) - 1)]
    wrong = np.flatnonzero(h[owner] != m[s])
    while len(wrong):  # a later gram is less
        first[wrong] += 1
        owner[wrong] = at[first[wrong]]
        wrong = wrong[h[owner[wrong]] != m[s[wrong]]]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (s[1:] != s[:-1] + 1)))
    last = np.append(new[1:], len(s)) - 1
    return h[owner[new]].view(np.int64), owner[new], s[new], s[last]


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes by their first ``depth`` bytes at least, by
    Larsson-Sadakane refinement: only groups that are still equal are sorted
    again, by the rank of what follows, twice as far each time."""
    n = len(data)
    padded = np.append(data, np.zeros(8, np.uint8))
    key = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.append(True, k[1:] != k[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    h = 8
    while h < depth:
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        pos = order[slots]
        after = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        both = rank[pos] * (n + 1) + after
        by = np.argsort(both, kind="stable")
        pos, both = pos[by], both[by]
        order[slots] = pos
        fresh = np.append(True, both[1:] != both[:-1])
        new[slots] = fresh
        heads = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[pos] = heads
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, cap: int, lanes: int = 2048) -> np.ndarray:
    """Common prefix, up to ``cap``, of each suffix in ``order`` with the one before
    it.  Kasai's pass in text order, where a prefix is at least one less than
    its left neighbour's, run over many stretches of the text at a time.
    Suffixes of one rank are equal beyond ``cap``; as they are not ordered
    further, they say nothing about their right neighbours."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = np.ndarray((n,), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    stretch = -(-n // lanes)
    starts = np.arange(0, n, stretch)
    have, tied = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
    out = np.zeros(n, np.int64)
    for t in range(stretch):
        i = starts + t
        live = i < n
        i, have, tied, starts = i[live], have[live], tied[live], starts[live]
        j = before[i]
        have = np.where((j >= 0) & ~tied, np.maximum(have - 1, 0), 0)
        tied = (j >= 0) & (rank[i] == rank[j])
        have[tied] = cap
        go = np.flatnonzero((j >= 0) & (have < cap))
        while len(go):
            a, b = i[go] + have[go], j[go] + have[go]
            ok = np.maximum(a, b) < n
            go, a, b = go[ok], a[ok], b[ok]
            x = words[a] ^ words[b]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            same = np.minimum(same, n - np.maximum(a, b))
            have[go] += same
            go = go[(same == 8) & (have[go] < cap)]
        have = np.minimum(have, cap)
        out[i] = have
    return out[order]


def repeats_in_shard(data: np.ndarray, ends: np.ndarray, h: np.ndarray, p: np.ndarray, length: int, gram: int,
                     text_at: np.ndarray) -> np.ndarray:
    """Starts of windows that repeat in the shard, found by its suffix array over
    the stretches around anchors that the shard holds twice."""
    _, which, n = np.unique(h, return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[which] > 1)
    if not len(some):
        return np.empty(0, np.int64)
    begin = np.append(0, ends[:-1])
    t = text_at[some]
    lo, hi = np.maximum(begin[t], p[some] - (length - gram)), np.minimum(ends[t], p[some] + length)
    by = np.argsort(lo, kind="stable")
    lo, hi, t = lo[by], hi[by], t[by]
    reach = np.maximum.accumulate(hi)
    first = np.append(True, (lo[1:] > reach[:-1]) | (t[1:] != t[:-1]))
    lo = lo[first]
    hi = np.append(reach[np.flatnonzero(first)[1:] - 1], reach[-1])
    sizes = hi - lo
    back = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    left = np.repeat(hi, sizes) - back  # bytes to the end of the stretch
    order, rank = suffix_array(data[back], length)
    prefix = common_prefixes(data[back], order, rank, length)
    group = np.cumsum(prefix < length)
    whole = left[order] >= length  # others run into the next stretch
    members = np.bincount(group[whole], minlength=group[-1] + 1)
    return np.sort(back[order[whole & (members[group] > 1)]])


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.append(True, np.diff(starts) > 1))
    return list(zip(starts[new].tolist(), starts[np.append(new[1:], len(starts)) - 1].tolist()))


_RANGE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_ANCHOR = pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("d"), text_or_empty(text_col).alias("text")) \
        .withColumn("k", F.xxhash64("text"))


def _shards(rows: DataFrame, length: int, gram: int, shard_bytes: int, step: int) -> DataFrame:
    """(d, k, shard, inside, anchors) of every document of at least ``length`` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, table in enumerate(in_stretches(batches, shard_bytes)):
            texts = [t.encode() for t in table["text"].to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes)
            del texts
            found: list[tuple[np.ndarray, ...]] = []
            at = 0
            while at < len(data):  # hash a few texts, or a part of a long one, at a time
                t = int(np.searchsorted(ends, at, "right"))
                if ends[t] - at > 2 * step:
                    stop = at + step
                    piece = data[at:stop + length - 1]
                    cuts = np.array([len(piece)])
                else:
                    u = max(t, int(np.searchsorted(ends, at + step, "right")) - 1)
                    stop = int(ends[u])
                    piece, cuts = data[at:stop], ends[t:u + 1] - at
                h, p, lo, hi = anchors(piece, cuts, length, gram)
                found.append((h, p + at, lo + at, hi + at))
                at = stop
            h, p, lo, hi = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 4
            text_at = np.searchsorted(ends, lo, "right")
            _, once = np.unique(p, return_index=True)
            inside = repeats_in_shard(data, ends, h[once], p[once], length, gram, text_at[once])
            inside_at = np.searchsorted(ends, inside, "right")
            begin = ends - sizes
            a_cut = np.searchsorted(text_at, np.arange(len(sizes) + 1))
            i_cut = np.searchsorted(inside_at, np.arange(len(sizes) + 1))
            keep = np.flatnonzero(sizes >= length)
            spans = [[{"a": a, "b": b} for a, b in runs(inside[i_cut[t]:i_cut[t + 1]] - begin[t])] for t in keep]
            n = a_cut[keep + 1] - a_cut[keep]
            own = np.concatenate([np.arange(a_cut[t], a_cut[t + 1]) for t in keep]) if len(keep) else np.empty(0, np.int64)
            base = begin[text_at[own]] if len(own) else own
            items = pa.StructArray.from_arrays([pa.array(h[own]), pa.array(p[own] - base), pa.array(lo[own] - base),
                                                pa.array(hi[own] - base)], names=["h", "p", "lo", "hi"])
            offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(table["d"].chunks).take(pa.array(keep)),
                 pa.concat_arrays(table["k"].chunks).take(pa.array(keep)),
                 pa.array(np.full(len(keep), (part << 24) + i, np.int64)), pa.array(spans, _RANGE),
                 pa.ListArray.from_arrays(offsets, items)], names=["d", "k", "shard", "inside", "anchors"])

    return rows.mapInArrow(run, "d long, k long, shard long, inside array<struct<a: long, b: long>>, "
                                "anchors array<struct<h: long, p: long, lo: long, hi: long>>")


def _join_docs(rows: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    right = lists.withColumnsRenamed({"d": "_d", "k": "_k"})
    return rows.join(right, rows["d"].eqNullSafe(right["_d"]) & (rows["k"] == right["_k"]), how).drop("_d", "_k")


def _stretches(rows: DataFrame, lists: DataFrame, length: int, chunk: int) -> DataFrame:
    """(d, k, a, b, core, full): for each anchor the stretches of at most ``chunk``
    window starts a..b on a grid that hangs on the anchor.  core: fingerprint of the bytes
    that all windows of the grid cell share; full: of all bytes of the cell, null
    if the text ends inside."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, k, text, items in zip(*(batch.column(c).to_pylist() for c in ("d", "k", "text", "items"))):
                raw = text.encode()
                for it in items:
                    p, lo, hi = it["p"], it["lo"], it["hi"]
                    for c in range((p - hi) // chunk, (p - lo) // chunk + 1):
                        last = p - c * chunk
                        first = last - chunk + 1
                        full = xxhash.xxh3_128_digest(raw[first:last + length]) if first >= 0 and last + length <= len(raw) else None
                        # cells of other places about an anchor must not meet: c is part of the key
                        core = xxhash.xxh3_128_digest(raw[last:first + length], seed=c)
                        out.append((d, k, max(first, lo), min(last, hi), core, full))
                    if len(out) > 100_000:
                        yield as_batch(out)
                        out = []
            yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                          names=["d", "k", "a", "b", "core", "full"])

    return _join_docs(rows, lists).select("d", "k", "text", "items").mapInArrow(
        run, "d long, k long, a long, b long, core binary, full binary")


def _windows(rows: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """(d, k, s, fp, w): fingerprint of every listed window, w its weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, k, text, items in zip(*(batch.column(c).to_pylist() for c in ("d", "k", "text", "items"))):
                raw = text.encode()
                out += [(d, k, s, xxhash.xxh3_128_digest(raw[s:s + length]), it["w"])
                        for it in items for s in range(it["a"], it["b"] + 1)]
                if len(out) > 100_000:
                    yield as_batch(out)
                    out = []
            yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["d", "k", "s", "fp", "w"])

    return _join_docs(rows, lists).select("d", "k", "text", "items").mapInArrow(
        run, "d long, k long, s long, fp binary, w int")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                     gram: int = 128, shard_bytes: int = 12 << 20, chunk: int = 32, step: int = 1 << 20) -> DataFrame:
    """(d, k, a, b): runs of window starts that repeat, by document id and content key."""
    rows = _keyed(docs, id_col, text_col)
    shards = cut(_shards(rows.where(F.octet_length("text") >= length), length, gram, shard_bytes, step), "suffix-shards")
    anchor = shards.select("d", "k", "shard", F.explode("anchors").alias("x")).select("d", "k", "shard", "x.*")
    across = cut(anchor.groupBy("h").agg(F.min("shard").alias("s0"), F.max("shard").alias("s1")).where("s0 < s1").select("h"),
                 "suffix-across")
    # a long text is hashed in pieces, and an anchor next to a cut owns windows on both sides of it
    owned = anchor.join(across, "h").groupBy("d", "k", "p").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lists = owned.groupBy("d", "k").agg(F.collect_list(F.struct("p", "lo", "hi")).alias("items"))
    lists = cut(lists, "suffix-lists")
    cells = cut(_stretches(rows, lists, length, chunk).withColumn("t", F.monotonically_increasing_id()),
                "suffix-cells")
    cores = cut(cells.groupBy("core").agg(F.count("*").alias("n_core")).where("n_core > 1"), "suffix-cores")
    fulls = cut(cells.where(F.col("full").isNotNull()).groupBy("core", "full").agg(
        F.count("*").alias("n_full"), F.min("t").alias("rep")).where("n_full > 1"), "suffix-fulls")
    known = cut(cells.join(cores, "core").join(fulls, ["core", "full"], "left").drop("core", "full"), "suffix-known")
    inside = cut(shards.select("d", "k", F.explode("inside").alias("x")).select("d", "k", "x.a", "x.b"), "suffix-inside")
    drop(shards, across, lists, cells, cores, fulls)
    equal = F.col("n_full").isNotNull()
    whole = known.where(equal).select("d", "k", "a", "b")
    search = known.where(~equal | ((F.col("t") == F.col("rep")) & (F.col("n_core") > F.col("n_full")))) \
        .select("d", "k", F.struct("a", "b", F.when(equal, 2).otherwise(1).alias("w")).alias("item")) \
        .groupBy("d", "k").agg(F.collect_set("item").alias("items"))
    search = cut(search, "suffix-search")
    fps = cut(_windows(rows, search, length), "suffix-windows")
    twice = cut(fps.groupBy("fp").agg(F.sum("w").alias("n")).where("n > 1").select("fp"), "suffix-twice")
    ends = fps.join(twice, "fp").select("d", "k", F.col("s").alias("a"), F.col("s").alias("b"))
    ends = cut(ends, "suffix-ends")
    drop(search, fps, twice)
    return inside.union(whole).union(ends)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every text's UTF-8 bytes without
    those that a ``length``-byte string covers which starts anywhere else, too.

    Matches never cross documents; overlapping ones count, and all are judged
    on the input.  Null texts count as empty, texts shorter than ``length`` stay whole.
    Rows with a null id are documents like others; rows that repeat id and
    text are copies of each other.  ``kept`` is binary, as a cut may split a
    character.  Other columns are not read.
    """
    rows = _keyed(docs, id_col, text_col)
    found = repeated_windows(docs, id_col, text_col, length, **how)
    lists = found.groupBy("d", "k").agg(F.collect_list(F.struct("a", "b")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, items in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist()):
                raw = text.encode()
                if not items:
                    out.append((len(raw), 0, 0, raw))
                    continue
                gone = np.zeros(len(raw) + 1, np.int64)
                a, b = (np.array([it[c] for it in items], np.int64) for c in "ab")
                np.add.at(gone, a, 1)
                np.add.at(gone, b + length, -1)
                mask = np.cumsum(gone)[:-1] > 0
                out.append((len(raw), int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()),
                            np.frombuffer(raw, np.uint8)[~mask].tobytes()))
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), *(pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _join_docs(rows, lists, "left").select("d", "text", "items").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
