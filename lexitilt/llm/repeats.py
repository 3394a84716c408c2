"""Repeated byte strings across a corpus, by a radix sort of suffixes that stops at a depth.

Suffixes are ordered only through their first ``depth`` bytes, most significant digit first; a
suffix alone in its bucket leaves the sort, and those still together after the last digit are the
starts of exactly the strings of ``depth`` bytes that occur twice or more.

A record a suffix would be many times the text, so suffixes go through the first passes in runs:

1. The first digit is a landmark: of all grams (``gram`` bytes) within the suffix's depth, the one
   with the least hash, the leftmost of equals, and its distance. Equal strings have equal
   landmarks at equal distances, and neighbouring suffixes share theirs, some 85 of them at a
   depth of 200, so a run of suffixes is one record. Most runs are alone in their bucket here.
2. The second digit is all bytes that the run's suffixes cover. Runs still together are repeated
   throughout and leave the sort; one of them stays to meet runs that equal it in part.
3. A run's suffixes with a near and with a far landmark part: each such half shares more than half
   its depth, which is the third digit.
4. The bytes of the halves left are fetched once. Every ``PART`` suffixes of a half go by the bytes
   that all of them share; where all of a bucket's parts cover the same bytes, they are repeated.
5. What is left is ordered suffix by suffix through the whole depth.

Digits are hashes. Those that only tell apart have 64 bits; strings are called equal by 128: the
landmark's with that of the run, and those of passes 4 and 5. Buckets are counted with partial sums
before any exchange, and the rows of a bucket find its count by (digit, salt), so a passage that a
third of all documents hold is spread over ``SALTS`` tasks. Nothing is gathered but the spans of
one document. Steps that later ones read are written; see ``released``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitilt.llm.common import durable, released

DEPTH = 200
SALTS = 64
#: Suffixes that go together in pass 4, if the depth is large enough.
PART = 9
_BLOCK = 1 << 16
_PIECE = 1 << 20
_KEY = ["id_key", "text_key"]
_RNG = np.random.default_rng(12)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(0, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def gram_of(depth: int) -> int:
    """The landmark's bytes: a power of two, at most 32 and half the depth."""
    return min(32, 1 << (max(2, depth) // 2).bit_length() - 1)


def part_of(depth: int) -> int:
    """The distances that go together in pass 4."""
    return max(1, min(PART, depth // 4))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` neighbouring bytes."""
    h, size = _BYTES[data], 1
    for factor in _FACTORS[:gram.bit_length() - 1]:
        h = h[:-size] * factor + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    return h


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        total = (total ^ p) * _FACTORS[0]
        total ^= total >> np.uint64(31)
    return total


def runs_of(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """first, last, at, gram, whole, right, left: runs of starts with one landmark, its place and
    its hash, and hashes of all bytes the run covers, of those to the landmark's right and left.

    ``data``: the bytes of many texts, one after the other; ``ends``: where each of them ends.
    Read a block at a time; a run is cut where blocks meet, which changes digits and no result.
    """
    gram, half = gram_of(depth), (depth - gram_of(depth)) // 2
    starts = np.concatenate([np.arange(a, b - depth + 1) for a, b in
                             zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())]
                            or [np.zeros(0, np.int64)])
    found: list[tuple[np.ndarray, ...]] = []
    for k in range(0, len(starts), _BLOCK):
        own = starts[k:k + _BLOCK]
        base, stop = int(own[0]), int(own[-1]) + depth  # some bytes before, for what lies left
        low = max(0, base - depth)
        h = _gram_hashes(data[low:stop], gram)
        order = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_least(order, depth - gram + 1) & _LOW).astype(np.int64)[own - low]
        turn = np.flatnonzero((np.diff(at) != 0) | (np.diff(own) != 1)) + 1
        first, last = own[np.concatenate(([0], turn))], own[np.concatenate((turn, [len(own)])) - 1]
        place = at[np.concatenate(([0], turn))]
        inside = lambda x: h[np.clip(x, 0, len(h) - 1)]
        right = _mixed([inside(np.minimum(place + t, place + depth - half - gram))
                        for t in range(0, depth - half - gram + gram, gram)])
        left = _mixed([inside(np.minimum(place - half - 1 + t, place))
                       for t in range(0, half + 1 + gram, gram)])
        begin, end = first - low, last - low + depth - gram
        longest = int((end - begin).max())
        whole = _mixed([(place - begin).astype(np.uint64), (end - begin).astype(np.uint64),
                        *[inside(np.minimum(begin + t, end)) for t in range(0, longest + gram, gram)]])
        found.append((first, last, place + low, h[place].view(np.int64), whole.view(np.int64),
                      right.view(np.int64), left.view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 7
    return tuple(np.concatenate(x) for x in zip(*found))


def merged(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans [first, stop) as maximal runs in order."""
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order])
    fresh = np.concatenate(([True], first[1:] > stop[:-1]))
    return first[fresh], stop[np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(stop) - 1]))]


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id_key and text_key, which name a row (equal rows alike), id and text."""
    return docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("id_key"),
                       F.xxhash64(F.col(text)).alias("text_key"), F.col(id_col).alias("id"),
                       F.col(text).alias("text"))


def _salt() -> Column:
    return F.pmod("id_key", F.lit(SALTS)).cast("int")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch a few texts at a time, one if it is long; working memory follows."""
    ends = _bytes(batch["text"])[1]
    start = 0
    while start < len(batch):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _PIECE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's values, one after the other, and where each ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] \
        if len(column) else np.zeros(0, np.uint8)
    return data, (offsets[1:] - offsets[:1]).astype(np.int64)


def _texts(rows: DataFrame, depth: int) -> DataFrame:
    """The rows with texts of ``depth`` bytes or more, as bytes."""
    return rows.where(F.octet_length("text") >= depth) \
        .select(*_KEY, F.col("text").cast("binary").alias("text"))


def _landmarks(rows: DataFrame, depth: int) -> DataFrame:
    """id_key and gram of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            data, ends = _bytes(batch["text"])
            first, _, _, gram, *_ = runs_of(data, ends, depth)
            row = np.searchsorted(ends, first, side="right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch["id_key"].to_numpy()[row]), pa.array(gram)], ["id_key", "gram"])

    return _texts(rows, depth).select("id_key", "text").mapInArrow(run, "id_key long, gram long")


#: The digits of halves only tell apart within a landmark's bucket; 32 bits of them do.
_RUN = {**dict.fromkeys([*_KEY, "first", "last", "at", "gram", "whole"], np.int64),
        "right": np.int32, "left": np.int32, "n": np.int32}


def _runs(rows: DataFrame, depth: int) -> DataFrame:
    """A row a run that no other of its text equals (n 1) and one for those that do (n 2); and
    with n 0, the spans first to last that such equal runs of one text cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            data, ends = _bytes(batch["text"])
            first, last, at, gram, whole, right, left = runs_of(data, ends, depth)
            row = np.searchsorted(ends, first, side="right")
            own = whole ^ (row * np.int64(-7046029254386353131))
            _, kept, group, n = np.unique(own, return_index=True, return_inverse=True,
                                          return_counts=True)
            begin = np.concatenate(([0], ends[:-1]))[row]
            first, last, at = first - begin, last - begin, at - begin
            columns = [row[kept], first[kept], last[kept], at[kept], gram[kept], whole[kept],
                       right[kept], left[kept], np.minimum(n, 2)]
            again = n[group] > 1
            if again.any():  # texts stay apart: none is as long as the distance between them
                apart = int(ends.max()) + depth + 1
                a, b = merged(first[again] + row[again] * apart, last[again] + depth + row[again] * apart)
                of = a // apart
                no = np.zeros(len(a), np.int64)
                spread = batch["id_key"].to_numpy()[of] ^ a  # a key, so that they are dealt evenly
                more = [of, a - of * apart, b - of * apart, no, spread, no, no, no, no]
                columns = [np.concatenate(x) for x in zip(columns, more)]
            keys = [batch[c].to_numpy()[columns[0]] for c in _KEY]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(kind)) for x, kind in zip((*keys, *columns[1:]), _RUN.values())],
                list(_RUN))

    kinds = {np.int64: "long", np.int32: "int"}
    return _texts(rows, depth).mapInArrow(
        run, ", ".join(f"{c} {kinds[kind]}" for c, kind in _RUN.items()))


def _bit(salt: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), salt)


def _each_salt(buckets: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and a row for each salt whose bit is set in the column salts."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return buckets.select(*columns, "salts", salt) \
        .where(F.col("salts").bitwiseAND(_bit(F.col("salt"))) != 0).drop("salts")


def _buckets(rows: DataFrame, digit: Sequence[str], n: Column, subject: Column | None = None,
             ) -> DataFrame:
    """digit and salt of the rows in buckets of two or more, counted by ``n``, of which one at
    least is a ``subject``. One exchange: a bucket's salts are bits of one number."""
    subject = F.lit(True) if subject is None else subject
    buckets = rows.groupBy(*digit).agg(
        F.sum(n).alias("n"), F.bit_or(_bit(_salt())).alias("salts"),
        F.max(subject.cast("int")).alias("subject")).where("n >= 2 and subject = 1")
    return _each_salt(buckets, *digit)


def _slices(rows: DataFrame, ranges: DataFrame, depth: int) -> DataFrame:
    """``ranges`` (_KEY, first, last, at, alone) with the bytes that their suffixes cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(a, b, *r.values(), data[r["first"]:r["last"] + depth])
                    for a, b, data, wanted in zip(*[batch[c].to_pylist()
                                                    for c in (*_KEY, "text", "ranges")])
                    for r in wanted]  # first, last, at, alone
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*held) if held else [[]] * 7, (
                    *[pa.int64()] * 5, pa.bool_(), pa.binary()))],
                [*_KEY, "first", "last", "at", "alone", "bytes"])

    wanted = ranges.groupBy(*_KEY).agg(
        F.collect_list(F.struct("first", "last", "at", "alone")).alias("ranges"))
    return _texts(rows, depth).join(wanted, _KEY).mapInArrow(
        run, "id_key long, text_key long, first long, last long, at long, alone boolean, bytes binary")


def _long_pairs(digests: list[bytes]) -> list[np.ndarray]:
    words = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [words[:, 0], words[:, 1]]


def _parts(slices: DataFrame, depth: int) -> DataFrame:
    """The suffixes of a slice by distance from the landmark, ``PART`` distances together: slice
    (its first), first, last, core (a hash of the bytes that suffixes at all these distances
    share), c1 and c2 (a digest of the bytes that those in the slice cover)."""

    part = part_of(depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core_of, cover_of = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            keys, numbers, cores, covers = [], [], [], []
            for k, (first, last, at, data) in enumerate(zip(*[
                    batch[c].to_pylist() for c in ("first", "last", "at", "bytes")])):
                for group in range((at - last) // part, (at - first) // part + 1):
                    near = at - group * part  # the part's suffix nearest to the landmark
                    a, b = max(first, near - part + 1), min(last, near)
                    keys.append(k)
                    numbers.append((first, a, b))
                    cores.append(core_of(data[near - first:near - part + 1 + depth - first], group))
                    covers.append(cover_of(data[a - first:b + depth - first], (at - a) * depth + at - b))
            if keys:
                row = np.array(keys)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(batch[c].to_numpy()[row]) for c in _KEY],
                     *[pa.array(x) for x in np.array(numbers, np.int64).T],
                     pa.array(np.array(cores, np.uint64).view(np.int64)),
                     *[pa.array(x) for x in _long_pairs(covers)],
                     batch["alone"].take(pa.array(row))],
                    [*_KEY, "slice", "first", "last", "core", "c1", "c2", "alone"])

    return slices.mapInArrow(run, "id_key long, text_key long, slice long, first long, last long, "
                                  "core long, c1 long, c2 long, alone boolean")


def _suffixes(slices: DataFrame, open_: DataFrame, depth: int) -> DataFrame:
    """w1, w2, _KEY, first, alone: the digest through the whole depth of each suffix in
    ``open_`` (_KEY, slice, first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            keys, firsts, digests = [], [], []
            for k, (first, data, wanted) in enumerate(zip(*[batch[c].to_pylist()
                                                            for c in ("slice", "bytes", "wanted")])):
                for r in wanted:
                    span = range(r["first"] - first, r["last"] - first + 1)
                    digests += [digest(data[a:a + depth]) for a in span]
                    keys += [k] * len(span)
                    firsts += range(r["first"], r["last"] + 1)
            if keys:
                at = np.array(keys)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x) for x in _long_pairs(digests)],
                     *[pa.array(batch[c].to_numpy()[at]) for c in _KEY],
                     pa.array(np.array(firsts, np.int64)), batch["alone"].take(pa.array(at))],
                    ["w1", "w2", *_KEY, "first", "alone"])

    key = [*_KEY, "slice"]
    wanted = open_.groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("wanted"))
    return slices.select(*_KEY, F.col("first").alias("slice"), "alone", "bytes").join(wanted, key) \
        .mapInArrow(run, "w1 long, w2 long, id_key long, text_key long, first long, alone boolean")


def repeated_spans(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id_key, text_key, first, stop: spans whose union holds every byte of ``rows`` (see
    ``keyed``) covered by a string of ``depth`` bytes that occurs twice or more; spans may overlap
    and repeat."""
    half = (depth - gram_of(depth)) // 2
    stop = (F.col("last") + depth).alias("stop")
    # 1: landmarks
    marked = _buckets(_landmarks(rows, depth), ["gram"], F.lit(1)).withColumn("hit", F.lit(True))
    runs = _runs(rows, depth).withColumn("salt", _salt())
    runs = released(durable(runs.join(marked, ["gram", "salt"], "left").where("n = 0 or hit")
                            .drop("hit", "salt")))
    within = runs.where("n = 0").select(*_KEY, "first", F.col("last").alias("stop"))
    runs = runs.where("n > 0")
    # 2: all that a run covers
    place = F.struct(*_KEY, "first", "last", "at", "right", "left")
    distinct = released(durable(runs.groupBy("gram", "whole").agg(
        F.sum("n").alias("n"), F.bit_or(_bit(_salt())).alias("salts"), F.min(place).alias("p"))))
    again = _each_salt(distinct.where("n >= 2"), "gram", "whole")
    settled = runs.withColumn("salt", _salt()) \
        .join(again, ["gram", "whole", "salt"], "left_semi").select(*_KEY, "first", stop)
    # 3: halves of a run, by the distance of the landmark
    near_first = F.greatest(F.col("first"), F.col("at") - half)
    far_last = F.least(F.col("last"), F.col("at") - half - 1)
    halves = distinct.select("gram", (F.col("n") == 1).alias("alone"), "p.*").select(
        *_KEY, "at", "gram", "alone", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("right").alias("digit"),
                     near_first.alias("first"), F.col("last")),
            F.struct(F.lit(1).alias("side"), F.col("left").alias("digit"),
                     F.col("first"), far_last.alias("last")))).alias("h")) \
        .select(*_KEY, "at", "alone", "gram", "h.*").where("first <= last") \
        .withColumn("salt", _salt())
    open_halves = _buckets(halves, ["gram", "side", "digit"], F.lit(1), F.col("alone"))
    ranges = halves.join(open_halves, ["gram", "side", "digit", "salt"], "left_semi") \
        .select(*_KEY, "first", "last", "at", "alone")
    slices = released(durable(_slices(rows, ranges, depth)))
    # 4: parts of a half
    parts = _parts(slices, depth).withColumn("salt", _salt())
    alike = ((F.min("c1") == F.max("c1")) & (F.min("c2") == F.max("c2"))).alias("alike")
    buckets = parts.groupBy("core").agg(
        F.count("*").alias("n"), F.bit_or(_bit(F.col("salt"))).alias("salts"),
        F.max(F.col("alone").cast("int")).alias("subject"), alike) \
        .where("n >= 2 and subject = 1")
    met = released(durable(parts.drop("c1", "c2")
                           .join(_each_salt(buckets, "core", "alike"), ["core", "salt"])
                           .drop("core", "salt")))
    covered = met.where("alike and alone").select(*_KEY, "first", stop)
    # 5: suffix by suffix
    suffixes = _suffixes(slices, met.where("not alike"), depth)
    found = _buckets(suffixes, ["w1", "w2"], F.lit(1), F.col("alone"))
    single = suffixes.where("alone").withColumn("salt", _salt()) \
        .join(found, ["w1", "w2", "salt"], "left_semi") \
        .select(*_KEY, "first", (F.col("first") + depth).alias("stop"))
    return within.unionByName(settled).unionByName(covered).unionByName(single)


def without_repeats(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """id, n_bytes, spans (first and stop of each maximal removed run, in order) and kept (the
    bytes left, joined): a row a document.

    Texts are UTF-8 bytes, a null one none; strings do not cross documents. A byte goes if a
    string of ``depth`` bytes that covers it also starts elsewhere, in the same document or
    another, whether or not the two overlap; all is judged on the input. Texts shorter than
    ``depth`` stay. Copies lose all of it, the first too. Repeated rows are copies of each
    other; null ids are rows like any other; an empty table gives no rows; other columns are not
    used. A very long text is read in blocks, and needs memory for itself and its spans.
    """
    rows = keyed(docs, id_col, text)
    spans = released(durable(repeated_spans(rows, depth).groupBy(*_KEY).agg(
        F.collect_list(F.struct("first", "stop")).alias("spans"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, kept = [], []
            for body, spans in zip(batch["text"], batch["spans"].to_pylist()):
                data = body.as_buffer().to_pybytes()
                if not spans:
                    cut.append([])
                    kept.append(data)
                    continue
                first, stop = merged(np.array([s["first"] for s in spans], np.int64),
                                     np.array([s["stop"] for s in spans], np.int64))
                cut.append([{"first": a, "stop": b} for a, b in zip(first.tolist(), stop.tolist())])
                edges = zip([0, *stop.tolist()], [*first.tolist(), len(data)])
                kept.append(b"".join(data[a:b] for a, b in edges))
            if cut:
                kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], pa.array(cut, kind), pa.array(kept, pa.binary())],
                    ["id", "spans", "kept"])

    kind = docs.schema[id_col].dataType
    bodies = rows.select(*_KEY, F.col("id").cast("string").alias("id"),
                         F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return bodies.join(spans, _KEY, "left").select("id", "text", "spans").mapInArrow(
        run, "id string, spans array<struct<first: long, stop: long>>, kept binary") \
        .select(F.col("id").cast(kind).alias("id"), "spans", "kept")


def removed_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row a document (see
    ``without_repeats``)."""
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["first"])
    left = F.octet_length("kept").cast("long")
    return without_repeats(docs).select(
        F.col("id").alias("doc_id"), (left + cut).alias("n_bytes"), cut.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
