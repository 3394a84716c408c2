"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document is contaminated by a benchmark item when some passage of it is within
``floor((1 - similarity) * words)`` word edits of the item. Texts are lower-cased runs of
letters and digits, so case and punctuation do not count.

For each item length, the windows of that many words of every document are embedded with the
CGK random walk (Chakraborty, Goldenberg & Koucky, 2016): at step j the embedding notes the
word under a cursor, and a random bit of (j, word) moves the cursor on or not, so that a few
edits between two texts become a few differing places of the embeddings. A hash is made of a
few sampled places; a window and an item that agree in one of many hashes are candidates, and
each is verified with the exact edit distance to any passage around the window.

Before embedding, a window is passed over when it holds fewer word pairs (words next to each
other) of the items of its size than any passage within the allowed edits must hold: an edit
takes at most two pairs of an item away. Pairs that repeat the pair before them are also left out
of a second count, of which an edit takes at most three, so that a word written over and over
does not pass for a passage. Both conditions are exact and lose no match.

The benchmark is the query set. It is dealt into blocks of bounded text; each block's index is
broadcast and all documents are searched in one pass a block, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\W_]+")
_CHUNK_WORDS = 400_000
_CHUNK_WINDOWS = 10_000
#: Stands behind the last word; words outside the benchmark are 0, its words are odd.
_END = np.uint64(2)


@dataclass(frozen=True)
class Search:
    """``embeddings`` walks of ``hashes`` hashes of ``places`` sampled places each.

    Measured on items with all the edits that ``similarity`` allows, put into other text,
    the passages found are 0.95 of all; with half the edits, nearly all.
    """

    similarity: float = 0.8
    min_item_words: int = 5
    embeddings: int = 16
    hashes: int = 24
    places: int = 2
    block_chars: int = 4_000_000
    seed: int = 7


def _steps(size: int) -> int:
    """How long the walks over ``size`` words are: the cursor moves on at every other step,
    and places later than this would mostly be past the end."""
    return 2 * size - size // 4


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class Index:
    """What is broadcast of one block of items: words, and the hashes of each item length."""

    def __init__(self, items: list[tuple[object, str | None]], search: Search):
        self.search = search
        told = [(key, w) for key, text in items
                if len(w := words_of(text)) >= search.min_item_words]
        self.keys = [key for key, _ in told]
        spread = Counter(w for _, words in told for w in set(words))
        self.number = {w: k + 1 for k, w in enumerate(sorted(spread))}
        self.symbol = np.zeros(len(spread) + 1, np.uint64)
        for w, k in self.number.items():
            self.symbol[k] = xxhash.xxh64_intdigest(w, search.seed) | 1
        self.items = [np.array([self.number[w] for w in words]) for _, words in told]
        self.edits = [int((1 - search.similarity) * len(x) + 1e-9) for x in self.items]
        self.slack = max(self.edits, default=0)
        self.base = len(spread) + 1
        self.pairs = np.unique(np.concatenate(
            [self._codes(x) for x in self.items] or [np.zeros(0, np.int64)]))
        by_length = defaultdict(list)
        for k, x in enumerate(self.items):
            by_length[len(x)].append(k)
        self.lengths = {}
        for m, members in sorted(by_length.items()):
            grid = np.stack([self.items[k] for k in members]).reshape(-1)
            starts = np.arange(len(members)) * m
            self.lengths[m] = {
                "members": np.array(members), "least": m - 1 - 2 * self.edits[members[0]],
                "least_new": m - 1 - 3 * self.edits[members[0]]
                - max(int((self._codes(self.items[k])[1:] == self._codes(self.items[k])[:-1]).sum())
                      for k in members),}
        longest = max(by_length, default=0)
        self.odd = np.random.default_rng(search.seed).integers(
            0, 1 << 63, (search.embeddings, _steps(longest)), dtype=np.uint64) \
            * np.uint64(2) + np.uint64(1)
        for group in self.lengths.values():
            group["pairs"] = np.isin(self.pairs, np.concatenate(
                [self._codes(self.items[k]) for k in group["members"]]))
        self.places = {m: np.random.default_rng((search.seed, m)).integers(
            0, _steps(m), (search.embeddings, search.hashes, search.places)) for m in by_length}
        sizes = np.array([len(x) for x in self.items], np.int64)
        grid = np.concatenate(self.items or [np.zeros(0, np.int64)])
        hashes = self.embed(self.symbol[grid], np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(hashes, axis=None, kind="stable")
        self.known_hashes = hashes.reshape(-1)[order]
        self.known_items = order // max(1, hashes.shape[1])
        self.masks = []
        for x in self.items:
            masks: dict[int, int] = defaultdict(int)
            for p, w in enumerate(x.tolist()):
                masks[w] |= 1 << p
            self.masks.append(dict(masks))
        self.distinct = [set(x.tolist()) for x in self.items]

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for each pair of neighbours; zero where one is not of the benchmark."""
        first, second = ids[:-1], ids[1:]
        return np.where((first > 0) & (second > 0), first * self.base + second, 0)

    def embed(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The hashes of the windows of ``sizes`` symbols at ``starts``: one row a window.

        A hash also names its column and the window's size, so that only hashes of one kind
        and items of the same size can be equal.
        """
        s = self.search
        out = np.zeros((len(starts), s.embeddings * s.hashes), np.uint64)
        column = np.arange(s.hashes, dtype=np.uint64)
        if not len(starts):
            return out
        walk = np.zeros((len(starts), _steps(int(sizes.max()))), np.uint64)
        for e in range(s.embeddings):
            at = np.zeros(len(starts), np.int64)
            for j in range(walk.shape[1]):
                here = np.where(at < sizes, symbols[np.minimum(starts + at, len(symbols) - 1)], _END)
                walk[:, j] = here
                at += ((here * self.odd[e, j]) >> np.uint64(63)).astype(np.int64)
            for m in np.unique(sizes).tolist():
                rows = np.nonzero(sizes == m)[0]
                mixed = np.broadcast_to(column + np.uint64(m * 10_007 + e * s.hashes),
                                        (len(rows), s.hashes))
                for p in range(s.places):
                    mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) \
                        ^ walk[rows[:, None], self.places[m][e, :, p][None, :]]
                out[rows, e * s.hashes:(e + 1) * s.hashes] = mixed * np.uint64(0xC2B2AE3D27D4EB4F)
        return out

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window start, item) of the windows of ``ids`` that meet an item in a hash.

        In ``ids`` 0 is any other word and -1 ends a document.
        """
        codes = self._codes(ids)
        at = np.nonzero(codes)[0]
        place = np.minimum(np.searchsorted(self.pairs, codes[at]), len(self.pairs) - 1)
        met = self.pairs[place] == codes[at]
        at, place = at[met], place[met]
        new = codes[at] != codes[at - 1]
        ends = np.nonzero(ids < 0)[0]
        symbols = self.symbol[np.maximum(ids, 0)]
        found, sizes = [], []
        for m, group in self.lengths.items():
            own = group["pairs"][place]
            p, p_new, least = at[own], at[own & new], group["least"]
            if len(p) < least:
                continue
            # where ``least`` pairs lie within one window, the starts of all windows around them
            high = p[:len(p) - least + 1]
            low = p[least - 1:] - (m - 2)
            fits = low <= high
            spans = (high - low + 1)[fits]
            starts = np.unique(np.repeat(low[fits] - np.cumsum(spans) + spans, spans)
                               + np.arange(spans.sum()))
            starts = starts[starts >= 0]
            starts = starts[ends[np.searchsorted(ends, starts)] > starts + m - 2]
            held = np.searchsorted(p_new, starts + m - 1) - np.searchsorted(p_new, starts)
            starts = starts[held >= group["least_new"]]
            found.append(starts)
            sizes.append(np.full(len(starts), m))
        if not found:
            return
        starts, sizes = np.concatenate(found), np.concatenate(sizes)
        for k in range(0, len(starts), _CHUNK_WINDOWS):
            some, size = starts[k:k + _CHUNK_WINDOWS], sizes[k:k + _CHUNK_WINDOWS]
            seen = self.embed(symbols, some, size)
            low = np.searchsorted(self.known_hashes, seen)
            met = self.known_hashes[np.minimum(low, len(self.known_hashes) - 1)] == seen
            pairs = set()
            for w, c in zip(*np.nonzero(met)):
                x, value = low[w, c], seen[w, c]
                while x < len(self.known_hashes) and self.known_hashes[x] == value:
                    pairs.add((int(some[w]), int(self.known_items[x])))
                    x += 1
            yield from sorted(pairs)

    def distance(self, item: int, window: list[int]) -> tuple[int, int]:
        """The least edit distance of the item to any passage of ``window``, and its end.

        Myers' bit-vector recurrence with a free start, over whole words.
        """
        m, masks = len(self.items[item]), self.masks[item]
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, end = m, 0
        for k, w in enumerate(window):
            eq = masks.get(w, 0)
            x = eq | minus
            d = ((((x & plus) + plus) ^ plus) | x) & full
            up, down = (minus | ~(d | plus)) & full, plus & d
            score += bool(up & top) - bool(down & top)
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = (down | ~(d | up)) & full, up & d
            if score < best:
                best, end = score, k + 1
        return best, end

    def hits(self, texts: list[str | None]) -> dict[tuple[int, int], tuple[int, int]]:
        """(text number, item number) -> (edits, place of the passage's end in words)."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if not self.items:
            return found
        parts: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        gap, size = np.array([0] * self.slack + [-1]), 0

        def settle() -> None:
            ids = np.concatenate(parts)
            begins = np.array([b for _, b in owners])
            done: dict[tuple[int, int], int] = {}
            for start, item in self.candidates(ids):
                owner = int(np.searchsorted(begins, start, "right")) - 1
                text, begin = owners[owner]
                low = max(begin, start - self.edits[item])
                high = start + len(self.items[item]) + self.edits[item]
                window = ids[low:high].tolist()
                if -1 in window:
                    window = window[:window.index(-1)]
                if (key := (text, item)) in done and done[key] == 0:
                    continue
                # each edit takes one word of the item away at most
                if len(self.distinct[item].intersection(window)) \
                        < len(self.distinct[item]) - self.edits[item]:
                    continue
                edits, end = self.distance(item, window)
                if edits <= self.edits[item] and edits < done.get(key, 1 << 30):
                    done[key] = edits
                    found[key] = (edits, low + end - begin)
            parts.clear()
            owners.clear()

        number = self.number.get
        for k, text in enumerate(texts):
            if words := words_of(text):
                owners.append((k, size))
                parts += [np.fromiter((number(w, 0) for w in words), np.int64, len(words)), gap]
                size += len(words) + len(gap)
                if size > _CHUNK_WORDS:
                    settle()
                    size = 0
        if parts:
            settle()
        return found


def benchmark_blocks(benchmark: DataFrame, search: Search, item_id: str, text: str):
    """The items in blocks of about ``block_chars`` characters, each small enough to broadcast.

    Items are dealt by a hash of their text; a block is read back on its own.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")) \
        .where(F.length("text") > 0)
    n_chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-n_chars // search.block_chars)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        yield Index(sorted(((r["item_id"], r["text"]) for r in rows),
                           key=lambda x: (x[1], str(x[0]))), search)


def contaminated(docs: DataFrame, benchmark: DataFrame, search: Search = Search(),
                 id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, item_words, last_word: one row a document and item it holds.

    ``last_word`` is the place in the document where the closest passage ends. Null and empty
    texts hold nothing; items under ``min_item_words`` words name no passage and are not
    searched; equal items are each reported. Repeated rows give repeated results. An empty
    benchmark or table gives no rows. Other columns are not used.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    key_type = benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {key_type}, " \
             "edits int, item_words int, last_word int"
    out = spark.createDataFrame([], schema)
    for index in benchmark_blocks(benchmark, search, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            keys = pa.array(held.keys)
            for batch in batches:
                found = sorted(held.hits(batch.column(1).to_pylist()).items())
                items = [item for (_, item), _ in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([t for (t, _), _ in found], pa.int64())),
                    keys.take(pa.array(items, pa.int64())),
                    pa.array([e for _, (e, _) in found], pa.int32()),
                    pa.array([len(held.items[k]) for k in items], pa.int32()),
                    pa.array([p for _, (_, p) in found], pa.int32())],
                    names=["doc_id", "item_id", "edits", "item_words", "last_word"])

        out = out.unionByName(narrow.mapInArrow(run, schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, search: Search = Search(),
                   text: str = "text", item_id: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no benchmark item."""
    spark = docs.sparkSession
    at = docs.columns.index(text)
    for index in benchmark_blocks(benchmark, search, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {t for t, _ in shared.value.hits(batch.column(at).to_pylist())}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)],
                                            pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
