"""Best-fit packing of token sequences with certified bin counts.

Documents are cut into pieces, whole pieces fill a sequence of their own.  The
rest is dealt into parts that each run best-fit decreasing.  Lower bounds by
dual feasible functions certify a part whose bin count can't be beaten.  Parts
with gaps give the documents of their unfilled bins back; those are dealt anew
into fewer parts that run best-fit decreasing again, until the bin count of
the whole table meets its own lower bound or a round saves no bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domus.llm.bpe import in_stretches, load
from domus.llm.common import cut, drop, text_or_empty


def pieces(docs: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text",
           capacity: int = 2048, end_id: int = 0, stretch_bytes: int = 16 << 20, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and
    the id that ends it, cut into pieces of ``capacity`` ids if it is longer.

    Null and empty texts are the end id alone.  Null ids and repeated rows are
    documents like others.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path if isinstance(path, str) else path())
        for table in in_stretches(batches, stretch_bytes):
            flat, bounds = bpe.encode(table["text"].to_pylist())
            out: list[tuple] = []
            for i, doc in enumerate(table["doc_id"].to_pylist()):
                ids = np.append(flat[bounds[i]:bounds[i + 1]], end_id).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    out.append((doc, p, at, len(part), zlib.crc32(part.tobytes()), *([part] if with_ids else [])))
            cols = list(zip(*out))
            kinds = [table["doc_id"].type, pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                     *([pa.list_(pa.int32())] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                           + (", ids array<int>" if with_ids else ""))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Least number of bins for counts[n] pieces of each length n: the largest
    bound over the dual feasible functions u(e), which take lengths above
    capacity - e as whole bins, drop those below e and keep the rest, and the
    rounding functions that map a length to its share of whole parts 1/k."""
    n = np.arange(len(counts))
    best = -(-int((counts * n).sum()) // capacity)
    many = np.append(np.cumsum(counts[::-1])[::-1], 0)
    mass = np.append(0, np.cumsum(counts * n))
    for e in range(1, capacity // 2 + 1):
        whole = many[capacity - e + 1] if capacity - e + 1 <= len(counts) else 0
        middle = mass[min(capacity - e + 1, len(counts))] - mass[min(e, len(counts))]
        best = max(best, int(whole) + -(-int(middle) // capacity))
    for k in range(2, 21):
        scaled = (k + 1) * n
        value = np.where(scaled % capacity == 0, n * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, each into the fullest bin that holds it."""
    out = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, 0  # a bit for each room that some bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        out[i] = b
        if room > n:
            by_room[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return out


def pack(items: DataFrame, capacity: int = 2048, part_rows: int = 4096, rounds: int = 6, slack: int = 0) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid, length), length from 1 to ``capacity``.

    Rounds: each part of about ``part_rows`` items runs best-fit decreasing.
    Bins with at most ``slack`` free places are final.  A part whose bins meet
    its own lower bound is certified; so is the table when all bins, final and
    open, meet the bound of all lengths, and the rounds end.  Otherwise the
    open bins' items are dealt into parts anew, by another hash.  ``uid`` is
    unique.  Only the counts of each length (``capacity`` numbers at most) and
    of bins reach the driver.  An empty table gives no rows.
    """
    def run_round(part: pa.Table) -> pa.Table:
        uid, length = part["uid"].to_numpy(), part["length"].to_numpy()
        order = np.argsort(uid)
        uid, length = uid[order], length[order]
        bins = best_fit_decreasing(length, capacity)
        fill = np.bincount(bins, weights=length).astype(np.int64)
        counts = np.bincount(length, minlength=capacity + 1)
        by_bin = np.lexsort((uid, bins))
        size = length[by_bin]
        first = np.append(True, bins[by_bin][1:] != bins[by_bin][:-1])
        before = np.cumsum(size) - size
        offset = np.empty(len(uid), np.int64)
        offset[by_bin] = before - np.maximum.accumulate(np.where(first, before, 0))
        seq = (np.int64(part["part"][0].as_py()) << 24) | bins
        return pa.table({"uid": uid, "length": length, "sequence_id": seq, "offset": offset,
                         "room": capacity - fill[bins],
                         "certified": np.full(len(uid), len(fill) == lower_bound(counts, capacity))})

    counts = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    least = lower_bound(counts, capacity)
    done = items.where(F.col("length") == capacity).select(
        "uid", (F.lit(1).cast("long") * F.shiftleft(F.lit(1).cast("long"), 62) + F.col("uid")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    left, n_left, final_bins = items.where(F.col("length") < capacity), int(counts[:capacity].sum()), int(counts[capacity])
    bins_before = None
    for r in range(rounds):
        if not n_left:
            break
        parts = max(1, -(-n_left // part_rows))
        dealt = left.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(r)), F.lit(parts)))
        packed = cut(dealt.groupBy("part").applyInArrow(
            run_round, "uid long, length long, sequence_id long, offset long, room long, certified boolean")
            .withColumn("sequence_id", F.col("sequence_id") + F.shiftleft(F.lit(r).cast("long"), 52)), f"pack-{r}")
        full = F.col("room") <= slack
        closed, opened, rest = packed.agg(F.count(F.when(full & (F.col("offset") == 0), 1)),
                                          F.count(F.when(~full & (F.col("offset") == 0), 1)),
                                          F.count(F.when(~full, 1))).first()
        bins = final_bins + closed + opened
        if bins <= least or r == rounds - 1 or parts == 1 or (bins_before is not None and bins >= bins_before):
            if bins_before is None or bins <= bins_before:
                done = done.union(packed.select("uid", "sequence_id", "offset"))
            else:  # the last deal was better
                done = done.union(previous.select("uid", "sequence_id", "offset"))
                drop(packed)
            break
        done = done.union(packed.where(full).select("uid", "sequence_id", "offset"))
        previous, left = packed.where(~full), packed.where(~full).select("uid", "length")
        n_left, final_bins, bins_before = rest, final_bins + closed, bins
    return done


def pack_documents(docs: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = 2048, end_id: int = 0, with_ids: bool = False, **how) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every
    piece of every document and its place, see ``pieces`` and ``pack``."""
    cuts = cut(pieces(docs, path, id_col, text_col, capacity, end_id, with_ids=with_ids)
               .withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    return cuts.join(pack(cuts.select("uid", "length"), capacity, **how), "uid").drop("uid")
