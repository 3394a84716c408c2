"""Personal data as format-preserving pseudonyms, natively.

Validated numbers, dates and e-mail names in a text are replaced by a keyed permutation of
themselves within their own format: a card number by another card number with a right check
digit, a date by another real date, an address by one with letters for letters and digits for
digits. Equal values get equal pseudonyms in every document, whatever their punctuation, and
no two values share one.

Each value is a vector of whole numbers with a radix for each place. An alternating Feistel
network of ``ROUNDS`` rounds adds to one half, modulo the radices, a keystream that SHA-256
makes of the key, the kind, the round and the other half. Any round can be undone, so the whole
is a permutation of the vectors with the same radices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitilt.llm.common import bound

ROUNDS = 10
KINDS = ("email", "ip", "date", "phone", "national_id", "card")

#: How the kinds are written; what is found is then validated by value.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.)+[A-Za-z]{2,24}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![\d/-])",
    "phone": r"(?<![\d+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d|-\d)",
    "national_id": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
}
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
#: 1800-01-01 to 2199-12-31 are 400 whole years, 146,097 days: 189 x 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def feistel(values: Column, radices: Column, key: str, kind: str, *,
            undo: bool = False) -> Column:
    """``values`` permuted under ``key``; each place stays below its radix.

    A vector of one place is shifted by a keyed constant. ``undo`` gives back what the
    permutation was made of.
    """

    def permute(values: Column, radices: Column) -> Column:
        n = F.size(values)
        half = F.floor(n / 2).cast("int")

        def turn(now: Column, r: Column) -> Column:
            first = r % 2 == 0
            other = F.when(first, F.slice(now, half + 1, n - half)) \
                .otherwise(F.slice(now, F.lit(1), half))
            said = F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), n.cast("string"),
                               F.array_join(other.cast("array<string>"), ","))
            stream = F.concat(F.sha2(F.concat(said, F.lit("|0")), 256),
                              F.sha2(F.concat(said, F.lit("|1")), 256))

            def place(x: Column, i: Column, digest: Column) -> Column:
                j = F.when(first, i).otherwise(i - half)
                step = F.conv(F.substring(digest, j * 4 + 1, F.lit(4)), 16, 10).cast("int")
                moved = F.pmod(x - step if undo else x + step, F.get(radices, i))
                return F.when((i < half) == first, moved).otherwise(x)

            return bound(stream, lambda d: F.transform(now, lambda x, i: place(x, i, d)))

        rounds = [ROUNDS - 1 - r for r in range(ROUNDS)] if undo else list(range(ROUNDS))
        return F.aggregate(F.array(*[F.lit(r) for r in rounds]),
                           values.cast("array<int>"), turn)

    return bound(values, lambda v: bound(radices, lambda r: permute(v, r)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D+", "")


def _chars(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def _refilled(text: Column, pattern: str, filling: Column) -> Column:
    """``text`` with its characters of class ``pattern`` replaced in order by ``filling``."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        fits = c.rlike(pattern)
        return F.struct(
            F.concat(a["text"], F.when(fits, F.get(filling, a["i"])).otherwise(c)).alias("text"),
            (a["i"] + fits.cast("int")).alias("i"))

    return F.aggregate(_chars(text), start, step, lambda a: a["text"])


def _email(m: Column, key: str, undo: bool) -> Column:
    name = F.regexp_extract(m, "^[^@]*", 0)
    plain = F.regexp_replace(name, "[^A-Za-z0-9]+", "")

    def base(c: Column) -> Column:
        return F.when(c <= "9", F.lit(48)).when(c <= "Z", F.lit(65)).otherwise(F.lit(97))

    def new(cs: Column) -> Column:
        values = F.transform(cs, lambda c: F.ascii(c) - base(c))
        radices = F.transform(cs, lambda c: F.when(c <= "9", F.lit(10)).otherwise(F.lit(26)))
        out = feistel(values, radices, key, "email", undo=undo)
        letters = F.zip_with(out, cs, lambda v, c: F.char(v + base(c)))
        return bound(letters, lambda f: F.concat(
            _refilled(name, "[A-Za-z0-9]", f), F.substring(m, F.length(name) + 1, F.length(m))))

    return F.when(F.length(plain) > 0, bound(_chars(plain), new))


def _ip(m: Column, key: str, undo: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    whole = lambda v: F.forall(v, lambda x: x < 256)
    return bound(parts, lambda v: F.when(whole(v), F.array_join(feistel(
        v, F.array_repeat(F.lit(256), 4), key, "ip", undo=undo).cast("array<string>"), ".")))


def _date(m: Column, key: str, undo: bool) -> Column:
    d = _digits(m)
    part = lambda a, n: F.substring(d, a, n)
    year_first, days_first = m.rlike(r"^\d{4}"), F.contains(m, F.lit("."))
    iso = F.when(year_first, F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))) \
        .when(days_first, F.concat_ws("-", part(5, 4), part(3, 2), part(1, 2))) \
        .otherwise(F.concat_ws("-", part(5, 4), part(1, 2), part(3, 2)))
    first = F.to_date(F.lit(FIRST_DAY))
    day = F.datediff(iso.try_cast("date"), first)

    def new(n: Column) -> Column:
        values = F.array(F.floor(n / DAYS[1]).cast("int"), (n % DAYS[1]).cast("int"))
        out = feistel(values, F.array(*[F.lit(r) for r in DAYS]), key, "date", undo=undo)
        date = bound(out, lambda v: F.date_add(
            first, F.get(v, F.lit(0)) * DAYS[1] + F.get(v, F.lit(1))).cast("string"))
        digits = bound(date, lambda x: F.when(year_first, F.replace(x, F.lit("-"), F.lit("")))
                       .when(days_first, F.concat(F.substring(x, 9, 2), F.substring(x, 6, 2),
                                                  F.substring(x, 1, 4)))
                       .otherwise(F.concat(F.substring(x, 6, 2), F.substring(x, 9, 2),
                                           F.substring(x, 1, 4))))
        return bound(_chars(digits), lambda f: _refilled(m, r"\d", f))

    return bound(day, lambda n: F.when((n >= 0) & (n < DAYS[0] * DAYS[1]), new(n)))


def _phone(m: Column, key: str, undo: bool) -> Column:
    """Ten digits after the country code, each of which a phone number may be written with.

    Where area and exchange start with 2 or more, so do those of the pseudonym. All other
    numbers are permuted among themselves: their two first digits are one of 36 pairs.
    """
    d = _digits(m)
    code = F.substring(d, 1, F.length(d) - 10)
    digits = F.transform(_chars(F.substring(d, -10, 10)), lambda c: c.cast("int"))
    low = F.array(*[F.lit(2 if i in (0, 3) else 0) for i in range(10)])
    radices = F.array(*[F.lit(8 if i in (0, 3) else 10) for i in range(10)])
    at = lambda v, i: F.get(v, F.lit(i))

    def inside(v: Column) -> Column:
        out = feistel(F.zip_with(v, low, lambda x, y: x - y), radices, key, "phone", undo=undo)
        return F.zip_with(out, low, lambda x, y: x + y)

    def outside(v: Column) -> Column:
        area, exchange = at(v, 0), at(v, 3)
        pair = F.when(area < 2, 10 * area + exchange).otherwise(16 + 2 * area + exchange)
        values = F.array(pair, *[at(v, i) for i in range(10) if i not in (0, 3)])
        out = feistel(values, F.array(F.lit(36), *[F.lit(10)] * 8), key, "phone outside",
                      undo=undo)

        def apart(w: Column) -> Column:
            p, low_area = at(w, 0), at(w, 0) < 20
            first = F.when(low_area, F.floor(p / 10)).otherwise(F.floor((p - 16) / 2)).cast("int")
            fourth = F.when(low_area, p % 10).otherwise(p % 2)
            return F.array(first, at(w, 1), at(w, 2), fourth, *[at(w, i) for i in range(3, 9)])

        return bound(out, apart)

    planned = lambda v: (at(v, 0) >= 2) & (at(v, 3) >= 2)
    made = bound(digits, lambda v: F.when(planned(v), inside(v)).otherwise(outside(v)))
    return bound(F.concat(_chars(code), made.cast("array<string>")),
                 lambda f: _refilled(m, r"\d", f))


def _national_id(m: Column, key: str, undo: bool) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    part = lambda a, n: F.substring(m, a, n).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    out = feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "national_id",
                  undo=undo)
    at = lambda v, i: F.get(v, F.lit(i)) + 1
    return F.when(valid, bound(out, lambda v: F.concat_ws(
        "-", F.lpad((at(v, 0) + (at(v, 0) >= 666).cast("int")).cast("string"), 3, "0"),
        F.lpad(at(v, 1).cast("string"), 2, "0"), F.lpad(at(v, 2).cast("string"), 4, "0"))))


def check_digit(body: Column) -> Column:
    """The Luhn check digit of an array of digits."""
    doubled = F.transform(F.reverse(body), lambda d, i: F.when(
        i % 2 == 0, 2 * d - 9 * (d > 4).cast("int")).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return (10 - total % 10) % 10


def _card(m: Column, key: str, undo: bool) -> Column:
    """Thirteen to nineteen digits with a right check digit; the first digit stays."""
    digits = F.transform(_chars(_digits(m)), lambda c: c.cast("int"))

    def new(v: Column) -> Column:
        inner = F.slice(v, F.lit(2), F.size(v) - 2)
        out = feistel(inner, F.transform(inner, lambda x: F.lit(10)), key, "card", undo=undo)
        body = F.concat(F.slice(v, 1, 1), out)
        full = bound(body, lambda b: F.concat(b, F.array(check_digit(b))))
        return bound(full.cast("array<string>"), lambda f: _refilled(m, r"\d", f))

    def valid(v: Column) -> Column:
        return check_digit(F.slice(v, F.lit(1), F.size(v) - 1)) == F.element_at(v, -1)

    return bound(digits, lambda v: F.when(valid(v), new(v)))


_MAKERS = {"email": _email, "ip": _ip, "date": _date, "phone": _phone,
           "national_id": _national_id, "card": _card}


def kind_of(m: Column) -> Column:
    """Which pattern a found piece of text is of; patterns are tried in the order of KINDS."""
    out = F.when(F.contains(m, F.lit("@")), "email")
    for kind in KINDS[1:]:
        out = out.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out


def pseudonym(m: Column, key: str, *, undo: bool = False) -> Column:
    """The pseudonym of a found piece of text with its kind; null if it is not valid."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit("").alias("text")))

    def made(kind: Column) -> Column:
        text = F.lit(None).cast("string")
        for name, make in _MAKERS.items():
            text = F.when(kind == name, make(m, key, undo)).otherwise(text)
        return bound(text, lambda t: F.when(t.isNotNull(), F.struct(
            kind.alias("kind"), t.alias("text"))).otherwise(out))

    return bound(kind_of(m), made)


def pseudonymised(docs: DataFrame, key: str, text: str = "text", *, undo: bool = False,
                  kinds_as: str | None = "pii_kinds") -> DataFrame:
    """``docs`` with ``text`` made pseudonymous and, under the name ``kinds_as``, an array of the
    kinds replaced, one entry a value; None: without it. A null text stays null; texts without
    values stay as they are, very long ones are read whole. Other columns are kept, but for one
    of the name ``kinds_as``, which gives way. Repeated rows give repeated results."""
    t = F.col(f"row.`{text}`")
    has = t.rlike(r"\d[\d ./()-]*\d|@")
    found = F.when(has, F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    made = F.transform(F.coalesce(found, F.array().cast("array<string>")),
                       lambda m: F.struct(m.alias("was"), pseudonym(m, key, undo=undo).alias("new")))
    kept = [c for c in docs.columns if c not in (text, kinds_as)]
    # the row in one column, so that no name of its columns can clash with one made here
    held = docs.select(F.struct("*").alias("row")).withColumn("made", made)
    pieces = F.zip_with(F.split(t, ANY, -1), F.col("made"), lambda p, m: F.concat(
        p, F.coalesce(m["new"]["text"], m["was"], F.lit(""))))
    whole = F.when(F.exists("made", lambda m: m["new"].isNotNull()), F.array_join(pieces, "")) \
        .otherwise(t)
    kinds = F.filter(F.transform("made", lambda m: m["new"]["kind"]), lambda k: k.isNotNull())
    return held.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], whole.alias(text),
                       *([] if kinds_as is None else [kinds.alias(kinds_as)]))


def mask(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (pseudonymous), n_values and the number of values of each kind.

    A null text stays null, an empty one empty, with zero counts. Repeated rows give
    repeated results; an empty table gives no rows; other columns are not used.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    made = pseudonymised(narrow, key)
    count = lambda kind: F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long")
    return made.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_values"),
                       *[count(k).alias(f"n_{k}") for k in KINDS])
