from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv
from lexitilt.operators import permutations, vectors, weat

# Fixed values, published results: group, seed, coverage of both targets and both attributes,
# effect size, p-value; below them the means, deviations and mean p-values by group.
SEED_RESULTS = [
    ("entry", 7, 4, 5, 10, 8, 0.5676345667409747, 0.2125984251968504),
    ("entry", 17, 4, 5, 10, 8, 0.3750108001315317, 0.3228346456692913),
    ("entry", 29, 4, 5, 10, 8, 0.6700544005719129, 0.18110236220472442),
    ("mid", 7, 4, 4, 10, 7, 1.1033974656278878, 0.1267605633802817),
    ("mid", 17, 4, 4, 10, 7, 1.1166921005195096, 0.09859154929577464),
    ("mid", 29, 4, 4, 10, 7, 1.05495628706454, 0.08450704225352113),
    ("senior", 7, 4, 5, 10, 10, 0.8995075321634456, 0.11023622047244094),
    ("senior", 17, 4, 5, 10, 10, 0.7829230353157154, 0.11811023622047244),
    ("senior", 29, 4, 5, 10, 10, 0.929922100652787, 0.09448818897637795),
    ("leadership", 7, 5, 6, 10, 8, 0.1082773217267197, 0.4319654427645788),
    ("leadership", 17, 5, 6, 10, 8, -0.11022068301688688, 0.572354211663067),
    ("leadership", 29, 5, 6, 10, 8, 0.03778971884411815, 0.4773218142548596),
]
SUMMARY = {
    "entry": (0.5375665891481397, 0.14980234977328707, 0.2388451443569554),
    "mid": (1.0916819510706457, 0.03249257802548781, 0.10328638497652581),
    "senior": (0.8707842227106494, 0.07759479803397895, 0.10761154855643044),
    "leadership": (0.011948785851316987, 0.11151753172792209, 0.49388048956083513),
}
SCHEMA = ("group STRING, seed INT, coverage_targets_a INT, coverage_targets_b INT, "
          "coverage_attrs_a INT, coverage_attrs_b INT, effect_size DOUBLE, p_value DOUBLE")


def published(spark, rows=SEED_RESULTS):
    return spark.createDataFrame(rows, SCHEMA).withColumn("test_name", F.lit("gender_career_family"))


def test_summary_of_published_results(spark):
    rows = {r["group"]: r for r in weat.weat_summary(published(spark)).collect()}
    for group, expected in SUMMARY.items():
        r = rows[group]
        assert (r.effect_size_mean, r.effect_size_std, r.p_value_mean) == pytest.approx(expected)


def test_monotonicity_of_published_results(spark):
    row = weat.monotonicity(published(spark)).first()
    assert (row.seed_runs, row.mean_order_holds, row.seed_order_rate, row.interpretation) == (
        3, False, 0.0, "not_supported")
    assert row.entry_mean == pytest.approx(SUMMARY["entry"][0])


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_missing_group_means_insufficient(spark, missing):
    rows = [r if r[0] != "leadership" else (*r[:3], 0, *r[4:6], missing, missing) for r in SEED_RESULTS]
    row = weat.monotonicity(published(spark, rows)).first()
    assert (row.seed_runs, row.mean_order_holds, row.seed_order_rate, row.interpretation) == (
        0, False, None, "insufficient_seed_coverage")
    summary = {r["group"]: r for r in weat.weat_summary(published(spark, rows)).collect()}
    assert summary["leadership"].effect_size_mean is None and summary["leadership"].p_value_mean is None


@pytest.mark.parametrize("second,verdict", [
    ([.05, .15, .25, .35], "supported"), ([.05, .15, .25, .2], "partially_supported"),
    ([.9, .1, .1, .1], "not_supported")])
def test_monotonicity_verdicts(spark, second, verdict):
    rows = [(g, s, 1, 1, 1, 1, e, 0.1) for s, effects in ((1, [.1, .2, .3, .4]), (2, second))
            for g, e in zip(fv.GROUP_ORDER, effects)]
    assert weat.monotonicity(published(spark, rows)).first().interpretation == verdict


def test_published_p_values_are_exact_shares():
    for _, _, a, b, _, _, _, p in SEED_RESULTS:
        splits = len(list(combinations(range(a + b), a))) + 1
        assert p * splits == pytest.approx(round(p * splits), abs=1e-9)


def model_table(spark, n, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"{role}{i}" for role, k in zip("xyab", n) for i in range(k)]
    rows = [(g, s, w, rng.normal(size=dims).tolist()) for g in ("mid", "senior") for s in (7, 17) for w in words]
    spec = {"t": {role: [f"{c}{i}" for i in range(k + 1)]  # one word of each role is absent
                  for role, c, k in zip(weat.ROLES, "xyab", n)}}
    return spark.createDataFrame(rows, "group STRING, seed INT, word STRING, vector ARRAY<DOUBLE>"), spec


def brute(vectors_, n):
    unit = {w: v / np.linalg.norm(v) for w, v in vectors_.items()}
    s = {w: np.mean([unit[w] @ unit[f"a{i}"] for i in range(n[2])])
         - np.mean([unit[w] @ unit[f"b{i}"] for i in range(n[3])]) for w in unit if w[0] in "xy"}
    x, y = [s[f"x{i}"] for i in range(n[0])], [s[f"y{i}"] for i in range(n[1])]
    effect = (np.mean(x) - np.mean(y)) / np.std(x + y, ddof=1)
    observed, total, hits, count = sum(x) - sum(y), sum(x + y), 0, 0
    if n[0] + n[1] <= 16:
        for chosen in combinations(x + y, n[0]):
            hits += 2 * sum(chosen) - total >= observed - 1e-12
            count += 1
    return effect, observed, (hits + 1) / (count + 1)


def test_effect_and_exact_p_match_brute_force(spark):
    n = (3, 4, 3, 2)
    table, spec = model_table(spark, n)
    rows = weat.run_weat(vectors.from_dense(table), spec).collect()
    assert len(rows) == 4
    for r in rows:
        words = {v.word: np.array(v.vector) for v in table.collect() if (v["group"], v.seed) == (r["group"], r.seed)}
        effect, observed, p = brute(words, n)
        assert (r.coverage_targets_a, r.coverage_targets_b, r.coverage_attrs_a, r.coverage_attrs_b) == n
        assert (r.effect_size, r.test_statistic, r.p_value) == pytest.approx((effect, observed, p))


def test_swapping_sets_changes_the_sign(spark):
    table, spec = model_table(spark, (3, 3, 3, 2))
    t = spec["t"]
    other = {"t": {**t, "targets_a": t["targets_b"], "targets_b": t["targets_a"]}}
    turned = {"t": {**t, "attributes_a": t["attributes_b"], "attributes_b": t["attributes_a"]}}

    def effects(s):
        return {(r["group"], r.seed): r.effect_size for r in weat.run_weat(vectors.from_dense(table), s).collect()}

    base = effects(spec)
    for changed in (effects(other), effects(turned)):
        assert {k: -v for k, v in changed.items()} == pytest.approx(base)


def test_sampled_p_above_sixteen_targets(spark):
    n = (9, 9, 2, 2)
    table, spec = model_table(spark, n)
    rows = weat.run_weat(vectors.from_dense(table), spec, permutations=200).collect()
    again = weat.run_weat(vectors.from_dense(table.repartition(5)), spec, permutations=200).collect()
    for r in rows:
        assert 0 < r.p_value <= 1 and (r.p_value * 201) == pytest.approx(round(r.p_value * 201))
    assert {(r["group"], r.seed): r.p_value for r in rows} == pytest.approx(
        {(r["group"], r.seed): r.p_value for r in again})


def test_sampled_p_comes_near_the_exact_one(spark):
    table, spec = model_table(spark, (4, 4, 3, 3), seed=8)
    model = vectors.from_dense(table)
    exact = {(r["group"], r.seed): r.p_value for r in weat.run_weat(model, spec).collect()}
    sampled = weat.run_weat(model, spec, permutations=2000, force_sampled=True).collect()
    for r in sampled:
        assert r.p_value == pytest.approx(exact[r["group"], r.seed], abs=0.06)


def test_coverage_gate_and_zero_vectors(spark):
    table, spec = model_table(spark, (3, 3, 2, 2))
    model = vectors.from_dense(table)
    for r in weat.run_weat(model, spec, min_coverage=3).collect():
        assert r.effect_size is None and r.p_value is None and r.coverage_attrs_a == 2
    none = {"t": {**spec["t"], "targets_b": ["absent"]}}
    for r in weat.run_weat(model, none).collect():
        assert (r.coverage_targets_b, r.effect_size, r.p_value) == (0, None, None)
    zero = table.withColumn("vector", F.when(F.col("word") == "x0", F.transform("vector", lambda v: v * 0.0))
                            .otherwise(F.col("vector")))
    s = weat.associations(vectors.from_dense(zero), spec)
    assert {(r.to_a, r.to_b) for r in s.filter("word = 'x0'").collect()} == {(0.0, 0.0)}


def test_interpretation(spark):
    df = spark.createDataFrame([(0.5, 0.01), (-0.5, 0.2), (0.0, 0.2), (None, None), (float("nan"), 0.1)],
                               "e DOUBLE, p DOUBLE")
    assert [r[0] for r in df.select(weat.interpret(F.col("e"), F.col("p"))).collect()] == [
        "male-career association; statistically significant",
        "female-career association; not statistically significant",
        "no directional association; not statistically significant",
        "Insufficient vocabulary coverage.", "Insufficient vocabulary coverage."]


def plain_models(spark, sizes, seed=1):
    """(name, coverage_targets_a, test_statistic, targets) with ties among the scores."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, (n, a) in enumerate(sizes):
        s = rng.integers(-4, 5, n) / 8 if k % 2 else rng.normal(size=n)
        rows.append((f"m{k}", a, float(s[:a].sum() - s[a:].sum()),
                     [("targets_a" if i < a else "targets_b", i, f"w{i}", float(x))
                      for i, x in enumerate(s)]))
    return spark.createDataFrame(rows, "name STRING, coverage_targets_a BIGINT, test_statistic DOUBLE, "
                                 "targets ARRAY<STRUCT<role: STRING, ord: INT, word: STRING, s: DOUBLE>>")


def test_two_halves_count_what_all_splits_count(spark):
    sizes = [(n, a) for n in (2, 5, 8, 9, 12, 16) for a in (1, n // 2, n - 1)]
    models = plain_models(spark, sizes)
    got = {r.name: (r.reached, r.splits) for r in permutations.exact_counts(models, ["name"]).collect()}
    for r in models.collect():
        s = [t.s for t in r.targets]
        scores = [2 * sum(c) - sum(s) for c in combinations(s, r.coverage_targets_a)]
        assert got[r.name] == (sum(x >= r.test_statistic - 1e-12 for x in scores), len(scores))


def test_two_halves_of_sixteen(spark):
    plan = permutations.exact_counts(plain_models(spark, [(16, 8)]), ["name"])
    assert plan.collect()[0].splits == 12870


@pytest.mark.parametrize("block", [7, 100, 1000])
def test_blocks_of_draws_add_up(spark, block):
    models = plain_models(spark, [(20, 10), (17, 3), (6, 3)])
    whole = permutations.sampled_counts(models, ["name"], 1, 1000, F.lit(5), 1000)
    parts = permutations.sampled_counts(models, ["name"], 1, 1000, F.lit(5), block)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def test_many_draws_use_many_tasks(spark):
    models = plain_models(spark, [(20, 10)])
    rows = permutations.sampled_counts(models, ["name"], 1, 40_000, F.lit(5))
    assert rows.collect()[0].splits == 40_000
    assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().toString()


def test_draws_stop_where_p_is_known(spark):
    models = plain_models(spark, [(18, 9), (18, 9), (20, 4), (17, 8)], seed=4)
    got = {r.name: r for r in permutations.sequential_counts(
        models, ["name"], F.lit(3), 0.02, first=250, most=16_000).collect()}
    longer = {r.name: r for r in permutations.sampled_counts(
        models, ["name"], 1, 16_000, F.lit(3)).collect()}
    assert len(got) == 4 and len({r.splits for r in got.values()}) > 1
    for name, r in got.items():
        assert r.error <= 0.02 or r.splits == 16_000
        assert r.reached / r.splits == pytest.approx(longer[name].reached / 16_000, abs=0.03)


def test_association_test_with_an_error_bound(spark):
    table, spec = model_table(spark, (4, 4, 3, 3), seed=8)
    model = vectors.from_dense(table)
    exact = {(r["group"], r.seed): r.p_value for r in weat.run_weat(model, spec).collect()}
    rows = weat.run_weat(model, spec, permutations=20_000, force_sampled=True, error=0.02).collect()
    for r in rows:
        assert r.p_error <= 0.02 and r.p_value == pytest.approx(exact[r["group"], r.seed], abs=0.04)
