"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a stretch of a partition lie in one symbol array.  An
index maps each mergeable pair to all its positions there.  Active ranks are
taken in ascending order; all positions of a rank are merged at once, and the
pairs that arise beside them are added to the lists of their own ranks.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domus.llm.common import text_or_empty

NOT_WHITE = "\x1c\x1d\x1e\x1f"  # str.split takes these as white space, the tokenizer doesn't
WHITE = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE:
    visible Latin-1 characters for themselves, the rest in order from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Numbers(dict):
    """Numbers strings in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def gather(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows of (flat, bounds) in this order, one after the other, and their sizes."""
    sizes = bounds[rows + 1] - bounds[rows]
    ends = np.cumsum(sizes)
    at = np.repeat(bounds[rows] - (ends - sizes), sizes)
    return flat[at + np.arange(len(at))], sizes


class WordBpe:
    """A word-level BPE vocabulary file: NFC, lower case, words by a pattern,
    byte symbols, a suffix on a word's last symbol."""

    cache_limit = 500_000  # cached chunks per worker; the cache is emptied beyond

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, (split, _) = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        vocab, merges = model["vocab"], model["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        suffix, chars = model["end_of_word_suffix"], byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = self.left.astype(np.int64) * len(self.tokens) + self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.by_key], np.iinfo(np.int64).max)
        self.ranks = np.append(self.by_key, -1)
        self.forget()

    def forget(self) -> None:
        """Empty the cache: chunk to number, and the ids of each number in a row."""
        self.known = Numbers()
        self.flat = np.empty(0, np.int32)
        self.bounds = np.zeros(1, np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 if it is not mergeable."""
        key = a.astype(np.int64) * len(self.tokens) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the bounds of each."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        n, ends = len(flat), np.cumsum(sizes)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(raw) + 1, np.int64)
        sym = np.append(self.inner[flat], np.int32(-2))
        ends_at = ends[sizes > 0] - 1
        sym[ends_at] = self.last[flat[ends_at]]
        nxt = np.arange(1, n + 2, dtype=np.int64)
        nxt[ends_at] = n
        nxt[n] = n
        prv = np.arange(-1, n, dtype=np.int64)
        prv[ends_at[:-1] + 1] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Add the pairs that start at these positions to the lists of their ranks."""
            right = nxt[at]
            at, right = at[right < n], right[right < n]
            ranks = self.rank_of(sym[at], sym[right])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            firsts = [0, *cuts.tolist()]
            for i, j, r in zip(firsts, [*firsts[1:], len(at)], ranks[firsts].tolist()):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(active, r)

        note(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.left[rank], self.right[rank]
            right = nxt[at]
            live = (sym[at] == a) & (sym[right] == b)
            at, right = at[live], right[live]
            if a == b and len(at) > 1:  # of a row of equal symbols, every second pair
                chained = np.append(False, right[:-1] == at[1:])
                pos = np.arange(len(at))
                start = np.maximum.accumulate(np.where(chained, 0, pos))
                keep = (pos - start) % 2 == 0
                at, right = at[keep], right[keep]
            if not len(at):
                continue
            after = nxt[right]
            sym[at], sym[right] = self.merged[rank], -1
            nxt[at] = after
            inside = after < n
            prv[after[inside]] = at[inside]
            before = prv[at]
            note(np.concatenate([before[before >= 0], at]))
        alive = sym[:n] >= 0
        return sym[:n][alive], np.append(0, np.append(0, np.cumsum(alive))[ends])

    def chunk_words(self, chunk: str) -> list[str]:
        """Words of a chunk without white space.  Final sigma is folded like any
        other, as case mapping goes character by character."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
        else:
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return self.words.findall(chunk.lower())

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in NOT_WHITE):
            return [c for c in WHITE.split(text) if c]
        return text.split()

    def pieces(self, text: str) -> list[str]:
        """Chunks between white space, special tokens apart."""
        if self.special_at is None or "<|" not in text or not self.special_at.search(text):
            return self.chunks(text)
        out: list[str] = []
        last = 0
        for m in self.special_at.finditer(text):
            out += self.chunks(text[last:m.start()])
            out.append(m[0])
            last = m.end()
        return out + self.chunks(text[last:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text."""
        if len(self.known) > self.cache_limit:
            self.forget()
        old, number = len(self.known), self.known.__getitem__
        rows = [np.fromiter(map(number, self.pieces(t)), np.int32) for t in texts]
        words, parts = Numbers(), []
        word = words.__getitem__
        for c in islice(self.known, old, None):
            parts.append([word(w) for w in ([c] if c in self.special else self.chunk_words(c))])
        flat, bounds = self.encode_words(list(words))
        for t, i in self.special.items():
            if t in words:  # stands for itself, whatever its characters encode to
                w = words[t]
                flat = np.concatenate([flat[:bounds[w]], np.array([i], np.int32), flat[bounds[w + 1]:]])
                bounds[w + 1:] += 1 - (bounds[w + 1] - bounds[w])
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        flat, sizes = gather(flat, bounds, np.fromiter(chain.from_iterable(parts), np.int64, counts.sum()))
        upto = np.append(0, np.cumsum(sizes))[np.cumsum(counts)] if len(counts) else np.empty(0, np.int64)
        self.bounds = np.append(self.bounds, self.bounds[-1] + upto)
        self.flat = np.append(self.flat, flat)
        out, sizes = gather(self.flat, self.bounds, np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64))
        upto = np.append(0, np.cumsum(sizes))
        return out, upto[np.append(0, np.cumsum([len(r) for r in rows], dtype=np.int64))]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space, special tokens as they are."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def in_stretches(batches: Iterator[pa.RecordBatch], text_bytes: int) -> Iterator[pa.Table]:
    """Input batches joined or sliced into tables of about ``text_bytes`` of their
    column ``text`` (a longer text stands alone)."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        lens = pc.binary_length(b.column("text"))
        start = 0
        for i, n in enumerate(lens.to_pylist()):
            if size and size + n > text_bytes:
                if i > start:
                    held.append(b.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def encode_decode(docs: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text",
                  stretch_bytes: int = 16 << 20, output_ids: int = 1 << 19) -> DataFrame:
    """(doc_id, ids array<int>, decoded): the ids of every whole text and the
    text that the ids decode to.

    ``path`` (or a function that gives it on the executor) names the
    vocabulary file.  Each task encodes stretches of about ``stretch_bytes``
    of text together, so its pairs are indexed once; results leave in batches
    of about ``output_ids`` ids.  Null and empty texts give no ids and the empty
    text; null ids of documents and repeated rows are kept; other columns are
    not read; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path if isinstance(path, str) else path())
        for table in in_stretches(batches, stretch_bytes):
            flat, bounds = bpe.encode(table["text"].to_pylist())
            doc_ids, start = table["doc_id"], 0
            while start < len(doc_ids):
                stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + output_ids, "right")) - 1)
                at = bounds[start:stop + 1]
                ids = flat[at[0]:at[-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(doc_ids.slice(start, stop - start).chunks),
                     pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(ids)),
                     pa.array([bpe.decode(flat[i:j]) for i, j in zip(at, at[1:])], pa.string())],
                    names=["doc_id", "ids", "decoded"])
                start = stop

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
