"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows gives the examples.  Every word of a text
counts, in examples and queries alike: its weight is its TF-IDF, document
frequencies from all documents, times one more than its chi-square statistic
in the examples, so that words which tell the classes apart count more and no
word counts nothing.  Examples stand in an index cut into blocks, each with the
largest weight of every term.  A query multiplies its common words, which many
examples hold, with all examples; the k-th of those scores and the blocks'
bounds leave the blocks that can hold a neighbour, so the neighbours are
exact.  Their distance-weighted votes, calibrated on the examples with each
left out, are the score; the neighbours are its evidence.

Words travel as 64-bit hashes.  Only the examples' words reach the driver and
the broadcast index; examples are bounded in number and in characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domus.llm.common import cut, drop, text_or_empty
from domus.llm.minhash import _STEP, _mix

WORD, NO_WORD = re.compile(r"[^\W_]+"), re.compile(r"[\W_]")


@dataclass(frozen=True)
class Settings:
    max_examples: int = 8192  # labelled rows that the model may be fit on, those with the least hash
    max_chars: int = 1 << 26  # and all characters of their texts; the row that passes this and those after it are no examples
    neighbours: int = 25
    block: int = 64


Vector = tuple[np.ndarray, np.ndarray]  # terms, weights


def as_vector(v: dict[int, float] | Vector) -> Vector:
    return (np.array(list(v), np.int64), np.array(list(v.values()), float)) if isinstance(v, dict) else v


class BlockMaxIndex:
    """Examples as unit vectors over the terms, in blocks with term maxima."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[dict[int, float] | Vector], n_terms: int,
                 block: int, k: int):
        vectors = [as_vector(v) for v in vectors]
        # examples with the same heaviest terms stand together, so that block maxima are tight
        heavy = np.full((len(vectors), 3), -1, np.int64)
        for row, (t, w) in zip(heavy, vectors):
            top = t[np.argsort(-w, kind="stable")[:3]]
            row[:len(top)] = top
        order = np.lexsort((ids, *heavy.T[::-1]))
        self.ids, self.labels, self.block, self.k, self.n_terms = ids[order], labels[order], block, k, n_terms
        # rows and weights by term, made one after the other as they are large
        terms = np.concatenate([np.empty(0, np.int32), *(vectors[i][0].astype(np.int32) for i in order)])
        by = np.argsort(terms, kind="stable").astype(np.int32)
        cuts = np.append(0, np.cumsum(np.bincount(terms, minlength=n_terms)))
        del terms
        rows = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[i][0]) for i in order])[by]
        self.lists = cuts, rows, np.concatenate([np.empty(0), *(vectors[i][1] for i in order)])[by]
        self.matrix = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "matrix": None, "column": None, "tops": None}  # each worker makes its own from the lists

    def _build(self) -> None:
        """The common terms' matrix, and every block's largest weight by other term."""
        cuts, rows, weights = self.lists
        # words that more than a 16th of the examples hold stand in a matrix, which many
        # queries multiply at once; it has at most 16 cells for each of their postings
        held = np.diff(cuts)
        common = np.flatnonzero(held > max(1, len(self.ids) // 16))
        self.column = np.full(self.n_terms, -1, np.int64)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), len(self.ids)))
        for c, t in enumerate(common):
            at = slice(cuts[t], cuts[t + 1])
            self.matrix[c, rows[at]] = weights[at]
        other = np.repeat(self.column < 0, held)
        terms, blocks = np.repeat(np.arange(self.n_terms, dtype=np.int32), held)[other], rows[other] // self.block
        new = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1]))) if len(terms) else terms
        top = np.maximum.reduceat(weights[other], new) if len(new) else np.empty(0)
        self.tops = np.searchsorted(terms[new], np.arange(self.n_terms + 1)), blocks[new], top

    @staticmethod
    def _add(lists: tuple[np.ndarray, ...], t: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
        """Sums of ``w`` times the listed weights of the terms ``t``."""
        cuts, place, weight = lists
        n = cuts[t + 1] - cuts[t]
        at = np.repeat(cuts[t] - (np.cumsum(n) - n), n)
        if not len(at):
            return np.zeros(size)
        at += np.arange(len(at))
        add = np.repeat(w, n)
        add *= weight[at]
        return np.bincount(place[at], add, size)

    def nearest_of(self, queries: list[Vector], skips: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of several queries; their common words are multiplied together."""
        if not len(self.ids):
            return [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        if self.matrix is None:
            self._build()
        weight = np.zeros((len(queries), len(self.matrix)))
        for row, (t, w) in zip(weight, queries):
            c = self.column[t]
            row[c[c >= 0]] = w[c >= 0]
        return [self._nearest(*q, *more) for q, *more in zip(queries, weight @ self.matrix, skips or [None] * len(queries))]

    def nearest(self, query: dict[int, float] | Vector, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples other than ``skip``, ties to the smaller id."""
        return self.nearest_of([as_vector(query)], [skip])[0]

    def _nearest(self, t: np.ndarray, w: np.ndarray, common: np.ndarray, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """``common``: what the query's common words add to each example's score."""
        n, k = len(self.ids), self.k + (skip is not None)
        rare = self.column[t] < 0
        t, w = t[rare], w[rare]
        starts = np.arange(0, n, self.block)
        bounds = np.maximum.reduceat(common, starts) + self._add(self.tops, t, w, len(starts))
        # the k-th of what common words add alone is no more than the k-th score
        least = np.partition(common, n - k)[n - k] if n > k else 0.0
        keep = np.repeat((bounds > 0) & (bounds + 1e-9 >= least), self.block)[:n]
        scores = common + self._add(self.lists, t, w, n)
        rows = np.flatnonzero((scores > 0) & keep)
        return self._best(rows, scores[rows].round(12), skip)

    def _best(self, rows: np.ndarray, sims: np.ndarray, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        if skip is not None:
            other = self.ids[rows] != skip
            rows, sims = rows[other], sims[other]
        if len(rows) > self.k:
            near = sims >= np.partition(sims, len(sims) - self.k)[len(sims) - self.k]
            rows, sims = rows[near], sims[near]
        top = np.lexsort((self.ids[rows], -sims))[:self.k]
        return rows[top], sims[top]

    def vote(self, rows: np.ndarray, sims: np.ndarray, prior: float) -> float:
        """Share of toxic neighbours, near ones counting more, drawn to ``prior``."""
        w = 1.0 / (1.05 - np.minimum(sims, 1.0))
        return float((w @ self.labels[rows] + prior) / (w.sum() + 1.0))


@dataclass
class Model:
    words: np.ndarray      # hashes of the examples' words, ascending
    weight: np.ndarray     # IDF times chi-square and one
    index: BlockMaxIndex
    prior: float           # share of toxic rows among all examples
    background: float      # the same among examples without any word

    def vectors(self, counted: list[Vector]) -> Iterator[tuple[Vector, np.ndarray]]:
        """For the words and counts of each text, terms and weights, not scaled to unit
        length, and which words have one."""
        words, counts = (np.concatenate(x) for x in zip(*counted))
        at = np.searchsorted(self.words, words)
        held = at < len(self.words)
        held[held] = self.words[at[held]] == words[held]
        at = at[held]
        weights = (1.0 + np.log(counts[held])) * self.weight[at]
        ends = np.append(0, np.cumsum(held))[np.cumsum([0, *(len(w) for w, _ in counted)])]
        first = 0
        for (w, _), i, j in zip(counted, ends, ends[1:]):
            yield (at[i:j], weights[i:j]), held[first:first + len(w)]
            first += len(w)


def calibrated(votes: np.ndarray, slope: float, shift: float) -> np.ndarray:
    v = np.clip(votes, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(slope * np.log(v / (1 - v)) + shift)))


def platt(votes: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve from votes to labels, lightly held to (1, 0)."""
    v = np.clip(votes, 1e-6, 1 - 1e-6)
    x = np.stack([np.log(v / (1 - v)), np.ones(len(v))], 1)
    theta, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - labels) + (theta - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), grad)
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


_PIECE = 1 << 16  # characters whose words are hashed together
_in_word = np.full(0x110000, 2, np.uint8)  # by code point; 2: not looked up yet


def _word_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word among the code points of lower-cased text."""
    inside = _in_word[points]
    for c in np.unique(points[inside == 2]).tolist():
        _in_word[c] = WORD.match(chr(c)) is not None
    inside = _in_word[points]
    edges = np.flatnonzero(np.diff(inside, prepend=np.uint8(0), append=np.uint8(0)))
    starts, sizes = edges[::2], np.diff(edges)[::2]
    if not len(starts):
        return starts, np.empty(0, np.int64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1], dtype=np.uint64) - np.repeat(first.astype(np.uint64), sizes)
    # a sum of 64 mixed bits for each letter in its place
    letters = points[inside.view(bool)].astype(np.uint64)
    return starts, np.add.reduceat(_mix((place << np.uint64(21) | letters) * _STEP), first).view(np.int64)


def _counted(texts: list[str]) -> list[Vector]:
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    starts, hashes = _word_hashes(points)
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    for i, j in zip(np.append(0, ends), ends):
        hashes[i:j].sort()
    new = np.append(hashes[1:] != hashes[:-1], True)  # a word's last place in its text
    new[ends[ends > 0] - 1] = True
    last = np.flatnonzero(new[:len(hashes)])
    words, counts = hashes[last], np.diff(last, prepend=-1)
    ends = np.searchsorted(last, ends)
    return [(words[i:j], counts[i:j]) for i, j in zip(np.append(0, ends), ends)]


def word_counts(texts: list[str]) -> list[Vector]:
    """Hashes of each text's distinct words, ascending, and how often each stands there."""
    out, some, size = [], [], 0
    for t in map(str.lower, texts):
        if len(t) > _PIECE:  # cut where words end
            cuts = [0]
            while end := NO_WORD.search(t, cuts[-1] + _PIECE):
                cuts.append(end.start())
            parts = [_counted([t[i:j]])[0] for i, j in zip(cuts, [*cuts[1:], len(t)])]
            words, place = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([c for _, c in parts]), len(words)).astype(np.int64)
            out += [*(_counted(some) if some else []), (words, counts)]
            some, size = [], 0
            continue
        some.append(t)
        size += len(t)
        if size > _PIECE:
            out += _counted(some)
            some, size = [], 0
    return out + (_counted(some) if some else [])


def _texts(column: pa.Array, rows: int = 64) -> Iterator[list[str]]:
    """The texts of a column, some at a time."""
    for first in range(0, len(column), rows):
        yield column.slice(first, rows).to_pylist()


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from an array for each row."""
    ends = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def document_frequencies(docs: DataFrame, text_col: str, held_words: int = 1 << 20) -> DataFrame:
    """(word, df) of every word's hash; counts combine in the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for texts in _texts(b.column("text")):
                some = [w for w, _ in word_counts(texts)]
                held += some
                size += sum(map(len, some))
                if size > held_words:
                    yield as_batch(held)
                    held, size = [], 0
        yield as_batch(held)

    def as_batch(held: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "word long, n long") \
        .groupBy("word").agg(F.sum("n").alias("df"))


def labelled_examples(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, toxic, words, counts) of the examples."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_examples), "toxic-sample")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")) \
        .join(F.broadcast(sample), "doc_id")
    first = cut(text.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxic-texts")
    upto = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # max_examples rows at most
    within = first.select("doc_id", upto.alias("upto")).where(F.col("upto") <= s.max_chars).select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [c for texts in _texts(b.column("text")) for c in word_counts(texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"), _lists([w for w, _ in found], pa.int64()),
                 _lists([c for _, c in found], pa.int32())], names=["doc_id", "toxic", "words", "counts"])

    out = cut(first.join(F.broadcast(within), "doc_id").select("doc_id", "toxic", "text")
              .mapInArrow(run, "doc_id long, toxic int, words array<long>, counts array<int>"), "toxic-examples")
    drop(sample, first)
    return out


def leave_one_out(examples: DataFrame, shared: Broadcast) -> list[tuple[float, int]]:
    """(vote, toxic) of every example that has words, by the others; a Spark job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            votes, ids = [], b.column("doc_id").to_pylist()
            for first in range(0, len(b), 64):
                some = [(w.values.to_numpy(), c.values.to_numpy())
                        for w, c in zip(b.column("words").slice(first, 64), b.column("counts").slice(first, 64))]
                queries = [(t, w / np.sqrt(w @ w)) for (t, w), _ in m.vectors(some)]
                for near, sims in m.index.nearest_of(queries, ids[first:first + 64]):
                    votes.append(m.index.vote(near, sims, m.prior) if len(near) else m.prior)
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), b.column("toxic")], names=["vote", "toxic"])

    rows = examples.where(F.size("words") > 0).select("doc_id", "toxic", "words", "counts") \
        .repartition(32, "doc_id").mapInArrow(run, "vote double, toxic int").collect()  # max_examples rows at most
    return sorted((r.vote, r.toxic) for r in rows)


def _model(examples: DataFrame, dfs: DataFrame, n_docs: int, prior: float, s: Settings) -> Model:
    """The examples' index and their words' weights, made on the driver."""
    seen = dfs.join(examples.select(F.explode("words").alias("word")).distinct(), "word").toArrow().sort_by("word")
    words, df = seen["word"].to_numpy(), seen["df"].to_numpy()
    rows = examples.orderBy("doc_id").toArrow()
    ids, y = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy().astype(float)
    sizes = pa.compute.list_value_length(rows["words"]).to_numpy()
    flat = np.searchsorted(words, pa.compute.list_flatten(rows["words"]).to_numpy()).astype(np.int32)
    counts = pa.compute.list_flatten(rows["counts"]).to_numpy()
    del seen, rows
    total, toxic = len(y), y.sum()
    held, bad = (np.bincount(flat, w, len(words)) for w in (None, np.repeat(y, sizes)))
    p = held / total
    spread = p * (1 - p) * (1 / toxic + 1 / (total - toxic))
    chi = np.where(spread > 0, (bad / toxic - (held - bad) / (total - toxic)) ** 2 / np.where(spread > 0, spread, 1.0), 0.0)
    weight = idf(df, n_docs) * (1.0 + chi)
    full, vectors, cuts = np.flatnonzero(sizes), [], np.append(0, np.cumsum(sizes))
    for i in full:
        t = flat[cuts[i]:cuts[i + 1]]
        w = (1.0 + np.log(counts[cuts[i]:cuts[i + 1]])) * weight[t]
        vectors.append((t, w / np.sqrt(w @ w)))
    index = BlockMaxIndex(ids[full], y[full], vectors, len(words), s.block, s.neighbours)
    return Model(words, weight, index, prior, (y[sizes == 0].sum() + prior) / ((sizes == 0).sum() + 1.0))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
        text_col: str = "text") -> tuple[Broadcast, tuple[float, float], DataFrame, int]:
    """The model (sent to the tasks once), slope and shift of its calibration, the
    (word, df) of all words, and the number of documents.

    ``labels`` (doc_id, toxic 0 or 1): rows with a null are left out, of an
    id's several labels the largest holds, of its several texts the least.  Of
    the labelled rows that aren't held out, those with the least hash of their
    id are the examples, at most ``max_examples`` and ``max_chars``: that
    bounds what reaches the driver, and the index sent to every task.
    """
    s, send = settings, docs.sparkSession.sparkContext.broadcast
    examples = labelled_examples(docs, labels, s, id_col, text_col)
    dfs = cut(document_frequencies(docs, text_col), "toxic-df")
    n_docs = docs.count()
    total, toxic = examples.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior, none = (toxic + 0.5) / (total + 1.0), np.empty(0, np.int64)
    if toxic in (0, total):
        index = BlockMaxIndex(none, np.empty(0), [], 0, s.block, s.neighbours)
        return send(Model(none, np.empty(0), index, prior, prior)), (1.0, 0.0), dfs, n_docs
    shared = send(_model(examples, dfs, n_docs, prior, s))
    votes = leave_one_out(examples, shared)
    line = platt(np.array([v for v, _ in votes]), np.array([float(t) for _, t in votes])) if votes else (1.0, 0.0)
    drop(examples)
    return shared, line, dfs, n_docs


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log((n_docs + 1) / (df + 1)) + 1.0


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, content, score, evidence array<struct<doc_id, cosine, toxic>>) of
    every row; content is xxhash64 of the text.

    Null and empty texts, and texts that share no word with any example, score
    the share of toxic rows among the examples without words.  Without
    labels, or with one class only, every row scores the prior.  Null ids and
    repeated rows are scored like others; other columns are not read.
    """
    shared, line, dfs, n_docs = fit(docs, labels, settings, id_col, text_col)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours, with the weights of the words that examples hold; the others
        only lengthen the query's vector, so they change no neighbour."""
        m, none = shared.value, np.empty(0, np.int64)
        for b in batches:
            near, dots, squares, others, often = [], [], [], [], []
            for texts in _texts(b.column("text")):
                some, queries = [], []
                counted = word_counts(texts)
                for (words, counts), ((t, w), held) in zip(counted, m.vectors(counted)):
                    square = float(w @ w)
                    squares.append(square)
                    some.append((words[~held], counts[~held]))
                    queries.append((t, w / np.sqrt(square) if len(t) else w))
                for (rows, sims), (words, counts) in zip(m.index.nearest_of(queries), some):
                    near.append(rows)
                    dots.append(sims)
                    others.append(words if len(rows) else none)
                    often.append(counts if len(rows) else none)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("content"), _lists(near, pa.int32()), _lists(dots, pa.float64()),
                 pa.array(squares, pa.float64()), _lists(others, pa.int64()), _lists(often, pa.int32())],
                names=["doc_id", "content", "near", "sims", "square", "others", "often"])

    found = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("content"),
                            text_or_empty(text_col).alias("text"))
                .mapInArrow(search, "doc_id long, content long, near array<int>, sims array<double>, square double, "
                                    "others array<long>, often array<int>")
                .withColumn("row", F.monotonically_increasing_id()), "toxic-found")
    weight = (F.log("often") + 1) * (F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1)
    rest = found.select("row", F.inline(F.arrays_zip("others", "often"))).join(dfs, F.col("others") == F.col("word")) \
        .groupBy("row").agg(F.sum(weight * weight).alias("rest"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            sizes = pa.compute.list_value_length(b.column("near")).to_numpy()
            each = np.repeat(np.arange(len(b)), sizes)
            rows = b.column("near").flatten().to_numpy()
            square, more = b.column("square").to_numpy(), b.column("rest").to_numpy()
            shorter = np.sqrt(np.divide(square, square + more, out=np.ones(len(b)), where=square > 0))
            cosines = b.column("sims").flatten().to_numpy() * shorter[each]
            w = 1.0 / (1.05 - np.minimum(cosines, 1.0))
            votes = (np.bincount(each, w * m.index.labels[rows], len(b)) + m.prior) / (np.bincount(each, w, len(b)) + 1.0)
            scores = np.where(sizes > 0, calibrated(votes, *line), m.background)
            evidence = pa.StructArray.from_arrays(
                [pa.array(m.index.ids[rows], pa.int64()), pa.array(cosines), pa.array(m.index.labels[rows].astype(np.int32))],
                names=["doc_id", "cosine", "toxic"])
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("content"), pa.array(scores),
                                              pa.ListArray.from_arrays(ends, evidence)], names=["doc_id", "content", "score", "evidence"])

    return found.drop("others", "often").join(rest, "row", "left").withColumn("rest", F.coalesce("rest", F.lit(0.0))) \
        .select("doc_id", "content", "near", "sims", "square", "rest").mapInArrow(
            vote, "doc_id long, content long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, settings: Settings = Settings(),
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score at least ``threshold``."""
    bad = score_toxicity(docs, labels, settings, id_col, text_col).where(F.col("score") >= threshold) \
        .select(F.col("doc_id").alias("_tox_d"), F.col("content").alias("_tox_c"))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["_tox_d"])
                     & (F.xxhash64(text_or_empty(text_col)) == bad["_tox_c"]), "left_anti")
