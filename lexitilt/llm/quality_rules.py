"""Quality rules: counted base rules, then divergence from language references.

A document's histogram of character classes and its histogram of common words are held
against the references of its language with the Jensen-Shannon distance (base 2, 0 to 1).
References are learnt from all documents of the language that the length guard lets in: the mean share of
each character class, and the share of each of the most frequent words among its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitilt.llm.common import blank_separated, bound, durable, word_array

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Character classes after the lower-case letters and separators, which are counted together
#: first; each is what is left over when the classes before it have been taken away.
CLASSES = {"upper": r"\p{Lu}+", "letter": r"\p{L}+", "digit": r"\p{Nd}+", "stop": r"[.,]+",
           "mark": r"[!?;:'\x22()-]+"}
N_CLASSES = len(CLASSES) + 3


@dataclass(frozen=True)
class Rules:
    """Thresholds and guards; a guard names the length below which a test is not made."""

    min_words: int = 10
    max_repeat_percent: int = 20
    common_words: int = 24
    min_reference_documents: int = 20
    min_chars: int = 300
    min_words_seen: int = 40
    max_class_distance: float = 0.26
    max_word_distance: float = 0.42


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in ``words``."""

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(
            F.sort_array(starts), first,
            lambda a, x: F.struct((a["n"] + F.least(F.lit(width), x - a["last"])).alias("n"),
                                  x.alias("last")),
            lambda a: a["n"])

    def among(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(
            windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bound(ordered, lambda s: covered(F.transform(F.filter(
            s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))

    def windows(hashes: Column) -> Column:
        """A hash a window: of two windows half as wide, and of one word more where that is odd."""

        def beside(a: Column, b: Column, places: int) -> Column:
            return F.zip_with(a, F.slice(b, F.lit(places + 1), F.size(b)), lambda x, y: F.xxhash64(x, y))

        def grown(held: Column, size: int, bits: str) -> Column:
            if not bits:
                return held
            if bits[0] == "0":
                return bound(beside(held, held, size), lambda x: grown(x, 2 * size, bits[1:]))
            return bound(beside(held, held, size), lambda x: bound(
                beside(x, hashes, 2 * size), lambda y: grown(y, 2 * size + 1, bits[1:])))

        return F.slice(grown(hashes, 1, f"{width:b}"[1:]), F.lit(1), F.size(hashes) - (width - 1))

    # each word is hashed once, however many windows hold it
    found = F.when(F.size(words) >= width, bound(
        F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: bound(
            windows(hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), among(h)))))
    return F.coalesce(found, F.lit(0).cast("long"))


def without(text: Column, chars: str) -> Column:
    """``text`` less each of ``chars``; a plain search for each costs less than a pattern."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def swept(text: Column) -> Column:
    """``text`` less lower-case letters and separators; the commonest letters are tried first."""
    return F.regexp_replace(text, r"[a-z\x20\x09-\x0D\p{Ll}]+", "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.coalesce(
        bound(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))), F.lit(0)).cast("long")


def with_base_metrics(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    ``joined``, the words in order with a blank between, and ``left_0``, the swept text.

    A null or empty text counts zero everywhere, and so fails the base rules.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    left = F.col("left_0")  # symbols are in it, and it is short
    counted = docs.withColumns({"words": word_array(t), "left_0": swept(t)}).withColumns({
        "n_words": F.size("words").cast("long"),
        "joined": F.array_join("words", " "),
        "n_symbols": (F.octet_length(left) - F.octet_length(without(left, SYMBOLS))).cast("long"),
        "n_dup_lines": duplicate_lines(t),
        "n_repeat_words": repeated_window_words(F.col("words")),
    }).withColumn("word_chars", F.length("joined") - F.greatest(F.col("n_words") - 1, F.lit(0))).drop("words")
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    return counted.withColumn(
        "base_failed", (n < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n))


def class_shares(df: DataFrame, text: str, word_chars: Column) -> DataFrame:
    """``df`` with ``n_chars_seen`` and ``classes``, the shares of the character classes:
    lower-case letters, separators, those of CLASSES, and the rest.

    ``word_chars`` is the number of characters that are not separators, ``left_0`` the swept text,
    if it is there already: the rarer classes are looked for in a short remainder.
    """
    kept = [c for c in df.columns if c != "left_0"]
    if "left_0" not in df.columns:
        df = df.withColumn("left_0", swept(F.coalesce(F.col(text), F.lit(""))))
    for k, pattern in enumerate(CLASSES.values()):
        df = df.withColumn(f"left_{k + 1}", F.regexp_replace(f"left_{k}", pattern, ""))
    last = len(CLASSES)
    n = F.coalesce(F.length(text), F.lit(0))
    size = [F.length(f"left_{k}") for k in range(last + 1)]
    spaces = n - word_chars
    parts = [n - size[0] - spaces, spaces,
             *[size[k] - size[k + 1] for k in range(last)], size[last]]
    return df.select(*kept, n.alias("n_chars_seen"), F.array(
        *[F.when(n > 0, p / n).otherwise(0.0) for p in parts]).alias("classes"))


def references(docs: DataFrame, rules: Rules, lang: str = "lang",
               text: str = "text") -> list[dict]:
    """One reference a language: mean class shares, common words and their shares.

    Learnt from every document that has a language, for each language with enough of them; a
    few dozen numbers a language come to the driver.
    """
    told = docs.where(F.col(lang).isNotNull() & (F.length(text) >= rules.min_chars))
    bare = F.length(F.replace(blank_separated(F.col(text)), F.lit(" "), F.lit("")))
    means = [F.avg(F.col("classes")[k]).alias(f"c{k}") for k in range(N_CLASSES)]
    by_class = (class_shares(told, text, bare).groupBy(lang)
                .agg(F.count("*").alias("n_docs"), *means)
                .where(F.col("n_docs") >= rules.min_reference_documents)
                .orderBy(F.desc("n_docs"), lang).collect())
    if not by_class:
        return []
    counted = durable(
        told.select(lang, F.explode(word_array(F.lower(text))).alias("word"))
        .groupBy(lang, "word").agg(F.count("*").alias("n")))
    known = {r[lang] for r in by_class}
    total = {r[lang]: r["n"] for r in counted.groupBy(lang).agg(F.sum("n").alias("n")).collect()}
    order = Window.partitionBy(lang).orderBy(F.desc("n"), F.asc("word"))
    top = (counted.withColumn("place", F.row_number().over(order))
           .where(F.col("place") <= rules.common_words).orderBy(lang, "place").collect())
    words: dict[str, list] = {}
    for x in top:
        if x[lang] in known:
            words.setdefault(x[lang], []).append(x)
    return [{
        "lang": r[lang], "classes": [r[f"c{k}"] for k in range(N_CLASSES)],
        "words": [x["word"] for x in words.get(r[lang], [])],
        "shares": [x["n"] / total[r[lang]] for x in words.get(r[lang], [])],
    } for r in by_class]


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of equal length."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def with_divergence(df: DataFrame, refs: list[dict], rules: Rules, lang: str = "lang",
                    text: str = "text") -> DataFrame:
    """``df`` with class_distance and word_distance to the reference of the language.

    Needs the columns of ``with_base_metrics``. Where the language is null, the nearest reference
    counts; a document of a language whose reference is too thin to be one is held against none.
    A distance is null where its length guard holds or where there is no reference.
    """
    df = class_shares(df, text, F.col("word_chars"))
    if not refs:
        return df.withColumns({"class_distance": F.lit(None).cast("double"),
                               "word_distance": F.lit(None).cast("double")}) \
            .drop("classes", "n_chars_seen")
    # the common words of any reference, each between blanks of its own, so that a word is counted
    # by what its removal takes
    common = sorted({w for r in refs for w in r["words"]})
    df = df.withColumn("spaced", F.concat(F.lit(" "), F.array_join(F.filter(
        F.split(F.lower("joined"), " "), lambda w: w.isin(common)), "  "), F.lit(" ")))
    known = F.array(*[F.struct(
        F.lit(r["lang"]).alias("lang"),
        F.array(*[F.lit(float(x)) for x in r["classes"]]).alias("classes"),
        F.array(*[F.lit(x) for x in r["words"]]).cast("array<string>").alias("words"),
        F.array(*[F.lit(float(x)) for x in [*r["shares"], 1 - sum(r["shares"])]]).alias("shares"),
    ) for r in refs])
    # one row a language, and one of all references for the rows without a language
    every = df.sparkSession.range(1).select(known.alias("every"))
    own = every.select(F.explode("every").alias("r")).select(
        F.col("r.lang").alias("own_lang"), F.array("r").alias("held")).unionByName(
        every.select(F.lit(None).cast("string").alias("own_lang"), F.col("every").alias("held")))
    df = df.join(F.broadcast(own), F.col(lang).eqNullSafe(F.col("own_lang")), "left")
    n = F.col("n_words")

    def times(word: Column) -> Column:
        around = F.concat(F.lit(" "), word, F.lit(" "))
        rest = F.replace(F.col("spaced"), around, F.lit(""))
        return (F.octet_length("spaced") - F.octet_length(rest)) / F.octet_length(around)

    def word_shares(r: Column) -> Column:
        return bound(F.transform(r["words"], lambda w: times(w) / n), lambda s: F.concat(
            s, F.array(F.greatest(
                F.lit(0.0), 1 - F.aggregate(s, F.lit(0.0), lambda a, x: a + x)))))

    nearest = lambda distance: F.array_min(F.transform(F.col("held"), distance))
    return df.withColumns({
        "class_distance": F.when(F.col("n_chars_seen") >= rules.min_chars, nearest(
            lambda r: js_distance(F.col("classes"), r["classes"]))),
        "word_distance": F.when(n >= rules.min_words_seen, nearest(
            lambda r: js_distance(word_shares(r), r["shares"]))),
    }).drop("classes", "n_chars_seen", "spaced", "held", "own_lang")


def apply_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id",
                text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: the base counts, both distances, base_failed and kept.

    Null and empty texts have no words, fail the base rules and are not kept. Repeated
    rows give repeated results. Rows without a language are held against the nearest
    reference, rows of a language with few long documents against none. An empty table gives no rows. Other columns of ``docs`` are not used.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"),
                         F.col(lang).cast("string").alias("lang"))
    held = with_divergence(with_base_metrics(narrow, rules), references(narrow, rules), rules)
    far = (F.coalesce(F.col("class_distance") > rules.max_class_distance, F.lit(False))
           | F.coalesce(F.col("word_distance") > rules.max_word_distance, F.lit(False)))
    return held.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.round("class_distance", 6).alias("class_distance"),
        F.round("word_distance", 6).alias("word_distance"),
        (~F.col("base_failed") & ~far).alias("kept"))
