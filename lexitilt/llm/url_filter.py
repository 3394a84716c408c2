"""URL filters: longest-rule verdicts and, where no rule fits, a character language model.

Two variable-order Markov models of the characters of a URL are learnt, one from the URLs
that the rules allow and one from those they block. A character's probability after up to
``ORDER`` characters is smoothed by Witten-Bell interpolation down to a uniform floor, so a
long context counts as far as it has been seen and hands the rest on to the shorter one. A
URL's score is the mean over its characters of log P(allowed) - log P(blocked); it passes at
or above a threshold calibrated on labelled URLs that the models have not seen.

All of it is counts, joins and windows on the table of distinct character runs. A run that
makes up a thousandth of all places or more is scored by a broadcast (there are at most a
thousand of those); the rest, none of them frequent, by a shuffled join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitilt.llm.common import durable

ORDER = 4
START, END = "\x02", "\x03"
#: Characters that the uniform floor spreads over.
ALPHABET = 256
URLS_A_TASK = 4_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(after, r"^[^?#]*", 0)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits, the first of equals; null if none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        action = F.when(fits, rule.action).otherwise(action)
    return text, action


def character_runs(url: Column) -> Column:
    """Each character of ``url`` and an end mark, with the ORDER characters before it."""
    padded = F.concat(F.lit(START * ORDER), F.translate(url, UPPER, LOWER), F.lit(END))
    places = F.sequence(F.lit(1), F.length(url) + 1)
    return F.transform(places, lambda i: F.substring(padded, i, ORDER + 1))


def run_scores(runs: DataFrame) -> DataFrame:
    """run and score, log P(allowed) - log P(blocked) of its last character.

    ``runs``: run, allowed, blocked (counts in the training URLs); each run once.
    """
    floor = F.lit(1.0 / ALPHABET)
    below = None
    for order in range(ORDER + 1):
        here = runs.select(F.substring("run", ORDER + 1 - order, order + 1).alias("run"),
                           "allowed", "blocked")
        if order < ORDER:
            here = here.groupBy("run").agg(F.sum("allowed").alias("allowed"),
                                           F.sum("blocked").alias("blocked"))
        here = here.withColumns({"context": F.substring("run", 1, order),
                                 "shorter": F.substring("run", 2, order)})
        if below is not None:
            here = here.join(below, "shorter")
        else:
            here = here.withColumns({"p_allowed": floor, "p_blocked": floor})
        same = Window.partitionBy("context")
        for side in ("allowed", "blocked"):
            seen = F.sum(side).over(same)
            kinds = F.sum((F.col(side) > 0).cast("long")).over(same)
            here = here.withColumn(f"q_{side}", F.when(
                seen > 0, (F.col(side) + kinds * F.col(f"p_{side}")) / (seen + kinds))
                .otherwise(F.col(f"p_{side}")))
        below = here.select(F.col("run").alias("shorter"), F.col("q_allowed").alias("p_allowed"),
                            F.col("q_blocked").alias("p_blocked"))
    return below.select(F.col("shorter").alias("run"),
                        F.log(F.col("p_allowed") / F.col("p_blocked")).alias("score"))


def url_scores(urls: DataFrame) -> DataFrame:
    """url and score. ``urls``: url (not null, once each), n (its rows), action, training."""
    train = lambda action: F.when(
        F.col("training") & (F.col("action") == action), F.col("n")).otherwise(0)
    exploded = urls.select(
        "url", "n", train("allow").alias("allowed"), train("block").alias("blocked"),
        F.explode(character_runs(F.col("url"))).alias("run"))
    runs = durable(exploded.groupBy("run").agg(
        F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"),
        F.count("*").alias("places")))
    scored = durable(run_scores(runs.select("run", "allowed", "blocked"))
                     .join(runs.select("run", "places"), "run"))
    total = runs.agg(F.sum("places")).first()[0] or 0
    frequent = F.col("places") * 1000 >= total
    places = exploded.select("url", "run")
    hot = scored.where(frequent).select("run", F.col("score").alias("hot_score"))
    split = places.join(F.broadcast(hot), "run", "left")
    sums = lambda df: df.groupBy("url").agg(
        F.sum("score").alias("score"), F.count("*").alias("n"))
    common = sums(split.where(F.col("hot_score").isNotNull())
                  .select("url", F.col("hot_score").alias("score")))
    rare = sums(split.where(F.col("hot_score").isNull()).select("url", "run")
                .join(scored.where(~frequent).select("run", "score"), "run"))
    return common.unionByName(rare).groupBy("url").agg(
        (F.sum("score") / F.sum("n")).alias("score"))


def calibrated_threshold(scored: DataFrame) -> float:
    """The score that parts allowed from blocked URLs with the best balanced accuracy.

    ``scored``: score, action, n. Scores are put in bins of 0.01 between -20 and 20, so at
    most 4,001 rows are looked at; the lowest of equals wins. Without both actions: 0.
    """
    bins = scored.select(
        F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("score") * 100)))
        .alias("bin"), "action", "n")
    rows = bins.groupBy("bin").agg(
        F.sum(F.when(F.col("action") == "allow", F.col("n")).otherwise(0)).alias("allow"),
        F.sum(F.when(F.col("action") == "block", F.col("n")).otherwise(0)).alias("block")) \
        .orderBy("bin").collect()
    allowed, blocked = sum(r["allow"] for r in rows), sum(r["block"] for r in rows)
    if not allowed or not blocked:
        return 0.0
    best, threshold, passed, stopped = -1.0, 0.0, allowed, 0
    for r in rows:
        accuracy = passed / allowed + stopped / blocked
        if accuracy > best:
            best, threshold = accuracy, r["bin"] / 100
        passed -= r["allow"]
        stopped += r["block"]
    return threshold


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id",
                url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score; one row a page.

    A null or empty url has no characters to judge: its score is 0 and held against the
    threshold like any other. Where the rules allow none or block none of the training URLs,
    there are no two models and every page without a rule is allowed. Repeated rows count
    as often as they come; an empty table gives no rows; other columns are not used.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url")) \
        .withColumns({"host": host, "path": path})
    text, action = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": text, "action": action})
    fold = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 8), 16, 10).cast("long") % 5
    # distinct urls are few bytes but give dozens of rows each later: deal them out by number
    tasks = 1 + judged.count() // URLS_A_TASK
    urls = durable(judged.where(F.length("url") > 0).groupBy("url")
                   .agg(F.count("*").alias("n"), F.first("action").alias("action"))
                   .withColumn("training", fold > 0).repartition(tasks, "url"))
    seen = {r["action"] for r in urls.where("training").select("action").distinct().collect()}
    if not {"allow", "block"} <= seen:
        return judged.select("page_id", "host", "path", "rule",
                             F.coalesce("action", F.lit("allow")).alias("verdict"),
                             F.lit(0.0).alias("score"))
    scores = durable(url_scores(urls))
    held_out = urls.where(~F.col("training") & F.col("action").isNotNull())
    threshold = calibrated_threshold(held_out.join(scores, "url"))
    found = judged.join(scores, "url", "left").withColumn(
        "score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return found.select("page_id", "host", "path", "rule",
                        F.coalesce("action", by_model).alias("verdict"), "score")
