"""CSV with quoted line breaks, read by many tasks a file.

A line break ends a record unless it stands in quotes, which only the text before it tells. A
range of a file is read without that knowledge: each of its lines takes a reader that is at the
start of a record, or within quotes, to one of these two states, so a range is a map of two states,
and maps are put together. A first pass over the lines finds each range's map; the state at the
start of a range follows from the maps before it (the last that forgets where it came from, and the
swaps since). A second pass joins lines to records; what a range's first lines owe to the record of
the range before is put back to it. Records are then parsed by Spark's own CSV expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexitilt.sources.staging import materialize

#: How records are written; also the options of Spark's reader.
OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "multiLine": "true"}
START, QUOTED = 0, 1
#: From within quotes to the quote that ends them; a doubled one does not.
_TO_END = re.compile(r'(?:[^"]|"")*+"(?!")')


def state_after(line: str, state: int) -> int:
    """The state that ``line`` and the break after it lead to.

    A field that begins with a quote runs to the quote that ends it. Quotes anywhere else mean
    nothing, and what stands between an ending quote and the next comma belongs to the field.
    """
    if '"' not in line:
        return state
    at = 0
    while True:
        if state == QUOTED:
            ended = _TO_END.match(line, at)
            if ended is None:
                return QUOTED
            at = ended.end()
        elif line.startswith('"', at):
            state, at = QUOTED, at + 1
            continue
        state = START
        comma = line.find(",", at)
        if comma < 0:
            return START
        at = comma + 1


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, range (where it begins), line: in each split in the order of the file."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("line"))


def _runs(files: list, ranges: list) -> Iterator[tuple[int, int]]:
    start = 0
    for k in range(1, len(files) + 1):
        if k == len(files) or ranges[k] != ranges[start] or files[k] != files[start]:
            if k > start:
                yield start, k
            start = k


def range_maps(lines: DataFrame) -> DataFrame:
    """file, range, from_start, from_quoted: the states a range leads to; a row a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ends = None, (START, QUOTED)
        for batch in batches:
            files, ranges = batch["file"].to_pylist(), batch["range"].to_pylist()
            text, done = batch["line"].to_pylist(), []
            for a, b in _runs(files, ranges):
                if (files[a], ranges[a]) != name:
                    if name is not None:
                        done.append((*name, *ends))
                    name, ends = (files[a], ranges[a]), (START, QUOTED)
                for line in text[a:b]:
                    if '"' in line:
                        first = state_after(line, ends[0])
                        ends = first, first if ends[0] == ends[1] else state_after(line, ends[1])
            yield _batch(done)
        if name is not None:
            yield _batch([(*name, *ends)])

    def _batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]],
            ["file", "range", "from_start", "from_quoted"])

    return lines.mapInArrow(run, "file string, range long, from_start long, from_quoted long")


def range_states(maps: DataFrame) -> DataFrame:
    """file, range, state: in which state each range begins; one window over a file's ranges."""
    before = Window.partitionBy("file").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("range").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    swap = (F.col("from_start") == QUOTED) & (F.col("from_quoted") == START)
    marked = maps.withColumn("swaps", F.sum(swap.cast("long")).over(upto)).withColumn(
        "fixed", F.when(F.col("from_start") == F.col("from_quoted"),
                        (F.col("from_start") + F.col("swaps")) % 2))
    state = (F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(START))
             + F.coalesce(F.max("swaps").over(before), F.lit(0))) % 2
    return marked.select("file", "range", state.alias("state"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, range, place, record: the records of the files under ``path``, their line breaks in
    quotes kept; sorted by (file, range, place) they are in the order of the input. Empty lines
    outside quotes are no records."""
    lines = lines_of(spark, path)
    states = materialize(range_states(range_maps(lines)), "ranges")  # a row a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, held, place = None, START, [], 0
        rows: list[tuple] = []

        def close(open_: bool) -> None:
            """The lines held are a record; ``open_``: its end is in a later range."""
            nonlocal place
            rows.append((*name, place, "\n".join(held), open_))
            held.clear()
            place += 1

        for batch in batches:
            files, ranges = batch["file"].to_pylist(), batch["range"].to_pylist()
            text, first = batch["line"].to_pylist(), batch["state"].to_pylist()
            for a, b in _runs(files, ranges):
                if (files[a], ranges[a]) != name:
                    if held:
                        close(True)
                    name, state = (files[a], ranges[a]), first[a]
                    place = 1 if state == START else 0  # place 0 continues an earlier record
                for line in text[a:b]:
                    if state == START and line in ("", "\r"):
                        continue
                    held.append(line)
                    state = state_after(line, state)
                    if state == START:
                        close(False)
            yield _batch(rows)
            rows.clear()
        if held:
            close(True)
            yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                          ["file", "range", "place", "record", "open"])

    # a broadcast keeps the lines in order; its rows are splits, of which the driver lists as many
    found = lines.join(F.broadcast(states), ["file", "range"], "left").withColumn(
        "state", F.coalesce("state", F.raise_error(F.lit("other splits than before, read again"))))
    pieces = found.mapInArrow(
        run, "file string, range long, place long, record string, open boolean")
    whole = pieces.where("place > 0 and not open").drop("open")
    # at most two pieces a range: the end of an earlier record, and a beginning without an end
    parts = pieces.where("place = 0 or open")
    order = Window.partitionBy("file").orderBy("range", "place")
    owner = F.sum((F.col("place") > 0).cast("long")).over(order)
    joined = (parts.withColumn("owner", owner).groupBy("file", "owner")
              .agg(F.min(F.struct("range", "place")).alias("at"),
                   F.array_sort(F.collect_list(F.struct("range", "place", "record"))).alias("p"))
              .select("file", "at.range", "at.place",
                      F.concat_ws("\n", F.transform("p", lambda x: x["record"])).alias("record")))
    text = F.regexp_replace("record", "\r$", "")
    return whole.unionByName(joined).withColumn("record", text).where("record <> ''")


def read(spark: SparkSession, path: str, header: Sequence[str]) -> DataFrame:
    """The columns ``header`` as text, and file, range and place under the name ``_at``.

    Each file begins with a header, which is left out. The same rows as Spark's own reader of
    quoted line breaks gives, which reads a file in one task.
    """
    schema = ", ".join(f"c{k} string" for k in range(len(header)))
    found = records(spark, path).where("not (range = 0 and place = 1)")
    parsed = F.from_csv("record", schema, OPTIONS).alias("r")
    return found.select(parsed, F.struct("file", "range", "place").alias("_at")).select(
        *[F.col(f"r.c{k}").alias(name) for k, name in enumerate(header)], "_at")
