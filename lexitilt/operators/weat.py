"""Word-embedding association tests over ``WordVectors``.

The association of a word is its mean cosine to one attribute set minus its mean
cosine to the other. A cosine is a product of unit vectors, so the mean over a set
is the product with the sum of the set's unit vectors: each coordinate is visited
once per word instead of once per pair of words. The association does not depend
on how targets are split, so a permutation is a signed sum of numbers already at
hand.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv
from lexitilt.operators import permutations as permutations_
from lexitilt.operators.shaping import in_group_order, small_table
from lexitilt.operators.vectors import WordVectors
from lexitilt.sources.staging import materialize

ROLES = {"targets_a": "coverage_targets_a", "targets_b": "coverage_targets_b",
         "attributes_a": "coverage_attrs_a", "attributes_b": "coverage_attrs_b"}

Specs = Mapping[str, Mapping[str, Sequence[str]]]


def spec_words(specs: Specs) -> list[str]:
    return sorted({w for spec in specs.values() for words in spec.values() for w in words})


def spec_table(spark: SparkSession, specs: Specs = fv.WEAT_SPECS) -> DataFrame:
    """(test_name, role, ord, word), one row per listed word."""
    rows = [(test, role, i, word) for test, spec in specs.items()
            for role in ROLES for i, word in enumerate(spec[role])]
    return small_table(spark, ["test_name", "role", "ord", "word"], rows)


def listed_coordinates(vectors: WordVectors, specs: Specs = fv.WEAT_SPECS) -> DataFrame:
    """(keys, test_name, role, ord, word, ctx, weight) of the listed words in the
    vocabulary: a marker row with ctx NULL and weight 0 each, and their cells."""
    spec = F.broadcast(spec_table(vectors.words.sparkSession, specs))  # the given lists
    columns = [*vectors.keys, "word", "ctx", "weight"]
    kind = vectors.cells.schema["ctx"].dataType
    markers = vectors.words.select(
        *vectors.keys, "word", F.lit(None).cast(kind).alias("ctx"), F.lit(0.0).alias("weight"))
    return vectors.cells.select(*columns).unionByName(markers).join(spec, "word")


def _norms(coordinates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per listed word in a model's vocabulary: its vector's length."""
    return (coordinates.groupBy(*keys, "test_name", "role", "ord", "word")
            .agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")))


def _with_all_models(df: DataFrame, vectors: WordVectors, specs: Specs) -> DataFrame:
    """Every model and test, also those without any listed word."""
    keys = list(vectors.keys)
    models = (vectors.words.select(*keys).distinct()
              .withColumn("test_name", F.explode(F.array(*[F.lit(t) for t in sorted(specs)]))))
    return (models.join(df, [*keys, "test_name"], "left")
            .na.fill(0, list(ROLES.values())))


def _role_counts() -> list[Column]:
    return [F.count_if(F.col("role") == role).alias(name) for role, name in ROLES.items()]


def coverage(vectors: WordVectors, specs: Specs = fv.WEAT_SPECS) -> DataFrame:
    """Words present per model, test and role."""
    spec = F.broadcast(spec_table(vectors.words.sparkSession, specs))
    present = vectors.words.select(*vectors.keys, "word").join(spec, "word")
    counts = present.groupBy(*vectors.keys, "test_name").agg(*_role_counts())
    return _with_all_models(counts, vectors, specs)


def _listed_products(vectors: WordVectors, specs: Specs) -> DataFrame:
    """Every listed word in a vocabulary; for targets the sums of their cosines to
    both attribute sets (NULL where there is nothing to sum)."""
    keys = [*vectors.keys, "test_name"]
    coordinates = listed_coordinates(vectors, specs)
    norms = _norms(coordinates, vectors.keys)
    unit = (coordinates.filter(F.col("weight") != 0)
            .join(norms, [*keys, "role", "ord", "word"])
            .withColumn("unit", F.col("weight") / F.col("norm")))

    def attribute_sum(role: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("role") == role, F.col("unit"))), F.lit(0.0))

    # One row per coordinate; its list holds at most the listed target words.
    by_coordinate = (
        unit.groupBy(*keys, "ctx")
        .agg(attribute_sum("attributes_a").alias("a"), attribute_sum("attributes_b").alias("b"),
             F.collect_list(F.when(is_target(), F.struct("role", "ord", "word", "unit")))
             .alias("targets")))
    products = (
        by_coordinate.filter((F.col("a") != 0) | (F.col("b") != 0))
        .select(*keys, "a", "b", F.explode("targets").alias("t"))
        .groupBy(*keys, "t.role", "t.ord", "t.word")
        .agg(F.sum(F.col("t.unit") * F.col("a")).alias("to_a"),
             F.sum(F.col("t.unit") * F.col("b")).alias("to_b")))
    return norms.drop("norm").join(products, [*keys, "role", "ord", "word"], "left")


def is_target() -> Column:
    return F.col("role").isin("targets_a", "targets_b")


def associations(vectors: WordVectors, specs: Specs = fv.WEAT_SPECS) -> DataFrame:
    """Per model, test and target word: sums of cosines to both attribute sets.

    Columns to_a and to_b are sums; divided by the coverage they are means. A zero
    vector has cosine 0 with everything.
    """
    return (_listed_products(vectors, specs).filter(is_target())
            .na.fill(0.0, ["to_a", "to_b"]))


def scored_models(vectors: WordVectors, specs: Specs = fv.WEAT_SPECS,
                  min_coverage: int = 1) -> DataFrame:
    """One row per model and test: coverage, effect size, test statistic, and the
    targets' associations, first set first (a list no longer than the spec's).

    Statistics of a model are worked out in its row; they are NULL where a role has
    fewer than ``min_coverage`` words.
    """
    keys = [*vectors.keys, "test_name"]
    enough = reduce(lambda a, b: a & b, [F.col(c) >= min_coverage for c in ROLES.values()])
    rows = (
        _listed_products(vectors, specs).na.fill(0.0, ["to_a", "to_b"])
        .groupBy(*keys)
        .agg(*_role_counts(), F.array_sort(F.collect_list(F.when(
            is_target(), F.struct("role", "ord", "word", "to_a", "to_b")))).alias("_raw")))
    targets = F.transform("_raw", lambda t: F.struct(
        t["role"].alias("role"), t["ord"].alias("ord"), t["word"].alias("word"),
        (t["to_a"] / F.col("coverage_attrs_a") - t["to_b"] / F.col("coverage_attrs_b"))
        .alias("s")))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    def part(role: str) -> Column:
        return F.transform(F.filter("targets", lambda t: t["role"] == role), lambda t: t["s"])

    s = F.transform("targets", lambda t: t["s"])
    n_a, n_b = F.col("coverage_targets_a"), F.col("coverage_targets_b")
    squares = total(F.transform(s, lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))))
    deviation = F.nullif(F.sqrt(squares / (n_a + n_b - 1)), F.lit(0.0))
    scored = (
        rows.withColumn("targets", F.when(enough, targets))
        .withColumns({"_a": total(part("targets_a")), "_b": total(part("targets_b"))})
        .withColumn("_mean", (F.col("_a") + F.col("_b")) / (n_a + n_b))
        .withColumns({
            "effect_size": F.when(enough, (F.col("_a") / n_a - F.col("_b") / n_b) / deviation),
            "test_statistic": F.col("_a") - F.col("_b")})
        .drop("_raw", "_a", "_b", "_mean"))
    return _with_all_models(scored, vectors, specs)


def permutation_test(models: DataFrame, keys: Sequence[str], *, permutations: int = 1000,
                     seed: Column | int = 42, force_sampled: bool = False,
                     error: float | None = None) -> DataFrame:
    """Adds p_value: the share of splits that score at least as high as observed.

    Up to sixteen targets every split of the same sizes counts; above, or with
    ``force_sampled``, ``permutations`` hash-seeded random ones, or with ``error`` as many as it
    takes to know p to that error, ``permutations`` at most (columns draws and p_error tell). The
    observed split counts as one more on both sides.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    models = materialize(models, "scored")
    small = F.col("targets").isNull() | (F.size("targets") <= permutations_.EXACT_UP_TO)
    sampled = models if force_sampled else models.where(~small)
    if error is None:
        drawn = permutations_.sampled_counts(sampled, keys, 1, permutations, seed)
    else:
        drawn = permutations_.sequential_counts(
            sampled, keys, seed, error, most=permutations).withColumnRenamed("error", "p_error")
    if not force_sampled:
        exact = permutations_.exact_counts(models.where(small), keys)
        drawn = drawn.unionByName(exact if error is None
                                  else exact.withColumn("p_error", F.lit(0.0)))
    found = drawn.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        permutations_.p_value(F.col("reached"), F.col("splits")).alias("p_value"),
        *([F.col("splits").alias("draws"), "p_error"] if error is not None else []))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return models.join(found, same, "left").drop("targets", *[f"_{k}" for k in keys])


def run_weat(vectors: WordVectors, specs: Specs = fv.WEAT_SPECS, *, permutations: int = 1000,
             seed: int = 42, min_coverage: int = 1, force_sampled: bool = False,
             error: float | None = None) -> DataFrame:
    """All models and tests in one job: coverage, effect size, statistic, p-value.

    The random draws use the model's seed where models have one; see ``permutation_test``.
    """
    models = scored_models(vectors, specs, min_coverage)
    own_seed = F.col("seed") if "seed" in vectors.keys else F.lit(seed)
    return permutation_test(models, [*vectors.keys, "test_name"], permutations=permutations,
                            seed=own_seed, force_sampled=force_sampled, error=error)


# Summaries over results (group, seed, test_name, effect_size, p_value, coverage_*)

def _number(name: str) -> Column:
    return F.when(~F.isnan(name), F.col(name))


def weat_summary(results: DataFrame, by: Sequence[str] = ("test_name", "group")) -> DataFrame:
    """Mean and deviation over seeds; missing values are left out."""
    return results.groupBy(*by).agg(
        F.avg(_number("effect_size")).alias("effect_size_mean"),
        F.stddev_samp(_number("effect_size")).alias("effect_size_std"),
        F.avg(_number("p_value")).alias("p_value_mean"),
        *[F.avg(c).alias(c) for c in ROLES.values()])


def effects_by_seed(results: DataFrame,
                    groups: Sequence[str] = tuple(fv.GROUP_ORDER)) -> DataFrame:
    """Per test and seed the effect of each group, missing ones kept."""
    return results.groupBy("test_name", "seed").agg(*[
        F.avg(F.when(F.col("group") == g, _number("effect_size"))).alias(g) for g in groups])


def monotonicity(results: DataFrame,
                 groups: Sequence[str] = tuple(fv.GROUP_ORDER)) -> DataFrame:
    """Whether effects rise from group to group, over seeds that have every group."""
    wide = effects_by_seed(results, groups)
    complete = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in groups])

    def rising(columns: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b,
                      [F.col(x) < F.col(y) for x, y in zip(columns, columns[1:])])

    means = [f"{g}_mean" for g in groups]
    holds = F.coalesce(rising(means), F.lit(False))
    return (
        wide.groupBy("test_name")
        .agg(F.count_if(complete).alias("seed_runs"),
             *[F.avg(F.when(complete, F.col(g))).alias(m) for g, m in zip(groups, means)],
             F.avg(F.when(complete, rising(groups).cast("double"))).alias("seed_order_rate"))
        .withColumn("mean_order_holds", holds)
        .withColumn("interpretation",
                    F.when(F.col("seed_runs") == 0, "insufficient_seed_coverage")
                    .when(holds & (F.col("seed_order_rate") == 1), "supported")
                    .when(holds, "partially_supported")
                    .otherwise("not_supported"))
    )


def interpret(effect: Column, p_value: Column, level: float = 0.05) -> Column:
    missing = (effect.isNull() | F.isnan(effect) | p_value.isNull() | F.isnan(p_value))
    direction = (F.when(effect > 0, "male-career association")
                 .when(effect < 0, "female-career association")
                 .otherwise("no directional association"))
    strength = F.when(p_value < level, "statistically significant").otherwise(
        "not statistically significant")
    return (F.when(missing, "Insufficient vocabulary coverage.")
            .otherwise(F.concat_ws("; ", direction, strength)))


def coverage_matrix(summary: DataFrame) -> DataFrame:
    """Coverage of each role per group, in group order."""
    return in_group_order(summary.select("group", *ROLES.values()))
