"""Mixing sources to target weights, natively.

The words of a source are one stream, packed into blocks of a fixed length. The output is
dealt in shards of a fixed number of slots. Each slot of a shard draws its source, so a
shard's source counts are a multinomial draw; a source's slots are numbered through the
shards, and slot k of a source with n blocks takes block ``permutation(k mod n)`` of pass
``k div n``, each pass under a pseudorandom permutation of its own. Blocks and slots then
meet in a join on (source, block).

A source never takes more slots than its target allows: what a draw gives beyond that is
left out, and what the draws left short is dealt in shards at the end. So each source comes
out within about half a block of its target, and no block is taken more often than
``max_repeats``, which the caps on targets promise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexitilt.llm.common import bound, durable, word_array

#: Draws are whole numbers below this.
RANGE = 1 << 40
ROUNDS = 12


@dataclass(frozen=True)
class Mix:
    """``weights`` go round the sources in code-point order, null last."""

    weights: tuple[int, ...] = (5, 2, 1)
    share_of_words: float = 1.5
    max_repeats: int = 2
    block_words: int = 64
    shard_blocks: int = 16_384
    slots_a_task: int = 50_000
    bucket_documents: int = 500
    bucket_group: int = 4_096
    seed: int = 20_011


def targets(sizes: dict[str | None, int], mix: Mix) -> list[dict]:
    """rank, source, words, target and block and slot numbers of each source.

    Targets share ``share_of_words`` of all words by weight; a target stops at
    ``max_repeats`` times its source's words and the excess is shared by the others.
    """
    rows = [{"source": s, "words": sizes[s]} for s in
            [*sorted(x for x in sizes if x is not None), *([None] if None in sizes else [])]]
    total = mix.share_of_words * sum(sizes.values())
    for k, r in enumerate(rows):
        r |= {"rank": k, "weight": mix.weights[k % len(mix.weights)],
              "cap": mix.max_repeats * r["words"], "capped": False}
    while free := [r for r in rows if not r["capped"]]:
        unit = (total - sum(r["cap"] for r in rows if r["capped"])) / sum(r["weight"] for r in free)
        over = [r for r in free if r["weight"] * unit > r["cap"]]
        for r in over:
            r["capped"] = True
        if not over:
            break
    for r in rows:
        r["target"] = float(r["cap"] if r["capped"] else r["weight"] * unit)
        r["blocks"] = -(-r["words"] // mix.block_words)
        exact = r["target"] * r["blocks"] / r["words"] if r["words"] else 0.0
        r["slots"] = min(mix.max_repeats * r["blocks"], int(exact + 0.5))
    return rows


def permuted(x: Column, n: Column, tweak: Column, seed: int) -> Column:
    """A keyed permutation of 0 .. n-1 applied to ``x``; ``tweak`` names the permutation.

    Swap-or-not (Hoang, Morris & Rogaway, 2012): a round pairs x with (K - x) mod n and a
    bit that depends on the pair alone says whether they change places; so every round,
    and the whole, is a permutation for any n.
    """

    def turn(x: Column, r: Column) -> Column:
        key = F.pmod(F.xxhash64(F.lit(seed), F.lit(1), r, tweak), n)

        def swapped(pair: Column) -> Column:
            bit = F.xxhash64(F.lit(seed), F.lit(2), r, tweak, F.greatest(x, pair))
            return F.when(bit.bitwiseAND(F.lit(1)) == 1, pair).otherwise(x)

        return bound(F.pmod(key - x, n), swapped)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x, turn)


def _by_rank(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values or [None]]),
                        (F.col("rank") + 1).cast("int"))


def slots(spark: SparkSession, plan: list[dict], mix: Mix) -> DataFrame:
    """shard, rank, k, epoch, block: every slot of the mix; k counts a source's slots."""
    wanted = [r["slots"] for r in plan]
    n = sum(wanted)
    empty = "shard long, rank long, low long, high long"
    if n == 0:
        return spark.createDataFrame([], empty).select(
            "shard", "rank", F.col("low").alias("k"), F.col("low").alias("epoch"),
            F.col("low").alias("block"))
    steps, reached = [], 0
    for w in wanted[:-1]:
        reached += w
        steps.append(reached * RANGE // n)
    thresholds = F.array(*[F.lit(v).cast("long") for v in steps]).cast("array<long>")
    drawn = spark.range(n).select(
        F.floor(F.col("id") / mix.shard_blocks).alias("shard"),
        F.pmod(F.xxhash64(F.lit(mix.seed), "id"), F.lit(RANGE)).alias("u"))
    drawn = drawn.select("shard", F.size(F.filter(thresholds, lambda t: t <= F.col("u")))
                         .cast("long").alias("rank"))
    counts = durable(drawn.groupBy("shard", "rank").agg(F.count("*").alias("n")))
    so_far = F.sum("n").over(Window.partitionBy("rank").orderBy("shard"))
    limit = _by_rank(wanted, "long")
    runs = counts.withColumn("high", so_far).select(
        "shard", "rank", F.least(F.col("high") - F.col("n"), limit).alias("low"),
        F.least("high", limit).alias("high"))
    got = {r["rank"]: r["n"] for r in counts.groupBy("rank").agg(F.sum("n").alias("n")).collect()}
    last = -(-n // mix.shard_blocks)
    short = [(last + j, r, low, min(low + mix.shard_blocks, w))
             for r, w in enumerate(wanted)
             for j, low in enumerate(range(min(w, got.get(r, 0)), w, mix.shard_blocks))]
    runs = runs.where("low < high").unionByName(spark.createDataFrame(short, empty))
    # runs are few, and each gives up to a shard of rows: deal them out by number before that
    each = runs.repartition(max(1, n // mix.slots_a_task), "shard", "rank").select(
        "shard", "rank", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("k"))
    each = each.withColumn("n", _by_rank([max(1, r["blocks"]) for r in plan], "long"))
    each = each.withColumns({"epoch": F.floor(F.col("k") / F.col("n")),
                             "at": F.col("k") % F.col("n")})
    each = each.withColumn("tweak", F.col("rank") * (mix.max_repeats + 1) + F.col("epoch"))
    return each.select("shard", "rank", "k", "epoch", permuted(
        F.col("at"), F.col("n"), F.col("tweak"), mix.seed).alias("block"))


def _rank_of(plan: list[dict]) -> Column:
    names = [r["source"] for r in plan if r["source"] is not None]
    place = F.array_position(F.array(*[F.lit(x) for x in names]).cast("array<string>"),
                             F.col("source")) - 1
    return F.when(F.col("source").isNull(), F.lit(len(names))).otherwise(place).cast("long")


def placed(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text: str = "text",
           source: str = "source", with_text: bool = False) -> tuple[DataFrame, list[dict]]:
    """Each document with rank, size and start, its place in its source's stream; the plan.

    A stream runs through buckets of documents. Bucket totals, one row for each source and
    bucket, give each bucket's start, in groups of buckets so that no task sees all of them;
    inside a bucket documents follow each other by id. A hot source is so spread over as many
    tasks as it has buckets.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.size(word_array(F.col(text))).cast("long").alias("size"),
        *([F.col(text).alias("text")] if with_text else []))
    sized = durable(narrow.select("doc_id", "source", "size"))
    if not with_text:
        narrow = sized
    by_source = sized.groupBy("source").agg(F.sum("size").alias("words"),
                                            F.count("*").alias("n")).collect()
    plan = targets({r["source"]: r["words"] for r in by_source}, mix)
    buckets = max(1, -(-sum(r["n"] for r in by_source) // mix.bucket_documents))
    cell = {"rank": _rank_of(plan), "bucket": F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets))}
    totals = sized.withColumns(cell).groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    totals = totals.withColumn("group", F.floor(F.col("bucket") / mix.bucket_group))
    group_totals = totals.groupBy("rank", "group").agg(F.sum("n").alias("n"))
    before = lambda keys, order: (
        F.sum("n").over(Window.partitionBy(*keys).orderBy(order)) - F.col("n"))
    group_bases = group_totals.select("rank", "group", before(["rank"], "group").alias("above"))
    bases = totals.withColumn("base", before(["rank", "group"], "bucket")) \
        .join(group_bases, ["rank", "group"]) \
        .select("rank", "bucket", (F.col("base") + F.col("above")).alias("base"))
    inner = Window.partitionBy("rank", "bucket").orderBy("doc_id", "size")
    here = F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    # bucket starts are joined last: the window's partitioning by (rank, bucket) serves both
    local = narrow.withColumns(cell).withColumn("here", here)
    at = local.join(bases, ["rank", "bucket"]).withColumn("start", F.col("base") + F.col("here"))
    return at.drop("base", "here", "bucket"), plan


def _pieces(at: DataFrame, mix: Mix) -> DataFrame:
    """The parts of documents that lie in one block each; documents without words have none."""
    b = mix.block_words
    last = F.floor((F.col("start") + F.col("size") - 1) / b)
    cut = at.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / b), last)))
    low = F.greatest(F.col("start"), F.col("block") * b)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    return cut.withColumn("n", high - low)


def _text_pieces(at: DataFrame, mix: Mix) -> DataFrame:
    """The same parts with their words: rank, block, piece (place, doc_id, text, n).

    A row's parts are cut before they become rows, so no row but its own holds a whole text.
    """
    b, start, end = mix.block_words, F.col("start"), F.col("start") + F.col("size")

    def part(words: Column, block: Column) -> Column:
        low, high = F.greatest(start, block * b), F.least(end, (block + 1) * b)
        text = F.slice(words, (low - start + 1).cast("int"), (high - low).cast("int"))
        return F.struct(block.alias("block"), F.struct(
            low.alias("place"), F.col("doc_id").alias("doc_id"),
            F.array_join(text, " ").alias("text"), (high - low).alias("n")).alias("piece"))

    blocks = F.sequence(F.floor(start / b), F.floor((end - 1) / b))
    parts = bound(word_array(F.col("text")), lambda ws: F.transform(
        blocks, lambda block: part(ws, block)))
    return at.where("size > 0").select("rank", F.explode(parts).alias("part")) \
        .select("rank", "part.block", "part.piece")


def taken_words(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text: str = "text",
                source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words the mix takes of each row.

    Null and empty texts have size 0 and nothing is taken of them. A null source is a source
    of its own, the last. Repeated rows are documents of their own. An empty table gives no
    rows. Other columns of ``docs`` are not used.
    """
    at, plan = placed(docs, mix, id_col, text, source)
    at = durable(at)
    uses = slots(docs.sparkSession, plan, mix).groupBy("rank", "block") \
        .agg(F.count("*").alias("times"))
    taken = (_pieces(at, mix).join(uses, ["rank", "block"], "left")
             .groupBy("doc_id", "source", "size", "rank", "start")
             .agg(F.sum(F.col("n") * F.coalesce("times", F.lit(0))).alias("taken")))
    none = at.where("size = 0").select("doc_id", "source", "size", "rank", "start",
                                       F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).select(
        "doc_id", "source", "size", _by_rank([r["words"] for r in plan], "long")
        .alias("source_size"), _by_rank([r["target"] for r in plan], "double").alias("target"),
        "taken")


def mixture(docs: DataFrame, mix: Mix = Mix(block_words=256), id_col: str = "doc_id",
            text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: shard, slot, source, epoch, block, doc_ids, n_words, text.

    One row a slot; ``slot`` counts a source's slots. ``text`` is the block's words parted
    by blanks and ``doc_ids`` the documents they come from, in order. Nulls, repeated rows
    and empty tables as in ``taken_words``.
    """
    at, plan = placed(docs, mix, id_col, text, source, with_text=True)
    blocks = _text_pieces(at, mix).groupBy("rank", "block").agg(
        F.sort_array(F.collect_list("piece")).alias("pieces"))
    names = [r["source"] for r in plan]
    return blocks.join(slots(docs.sparkSession, plan, mix), ["rank", "block"]).select(
        "shard", F.col("k").alias("slot"), _by_rank(names, "string").alias("source"),
        "epoch", "block", F.col("pieces.doc_id").alias("doc_ids"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_words"),
        F.array_join("pieces.text", " ").alias("text"))
