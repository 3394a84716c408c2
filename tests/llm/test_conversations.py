import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexitilt.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
SEPARATORS = " \t\n\x0b\x0c\r"


def every_edit(rows, costs, insertions):
    """The least (cost, letters) over all edits with so many insertions at most."""
    n, best = len(rows) // 2, None
    ways = []
    for k in range(n):
        initial, fault = rows[2 * k], rows[2 * k + 1]
        extra = costs.truncated if fault == "t" else 0
        ways.append([("D", "", costs.delete)] + ([] if fault == "x" else [
            ("K", initial, extra), ("R", "u", extra + costs.rerole), ("R", "a", extra + costs.rerole)]))
    for chosen in itertools.product(*ways):
        for count in range(insertions + 1):
            for places in itertools.combinations_with_replacement(range(n + 1), count):
                for kinds in itertools.product("ua", repeat=count):
                    steps = []
                    for k in range(n + 1):
                        steps += [("I", q, costs.insert) for p, q in zip(places, kinds) if p == k]
                        steps += [chosen[k]] if k < n else []
                    if re.fullmatch("(s?(ua)+)?", "".join(s[1] for s in steps)):
                        found = sum(s[2] for s in steps), "".join(s[0] for s in steps)
                        best = found if best is None else min(best, found)
    return best


@pytest.mark.parametrize("costs", [cv.Costs(), cv.Costs(1, 3, 1, 2), cv.Costs(2, 2, 2, 1)])
def test_edits_against_all_edits(costs):
    draw = random.Random(3)
    for n in range(6):
        for _ in range(12):
            rows = "".join(draw.choice("suua-") + draw.choice("kkktx") for _ in range(n))
            assert cv.cheapest_edits(rows, costs) == every_edit(rows, costs, 2 if n > 3 else 3)


def test_long_conversation_keeps_its_letters():
    cost, letters = cv.cheapest_edits("sk" + "ukak" * 300 + "akuk")
    assert (cost, letters) == (2, "K" * 601 + "RR") or cost == 2
    assert cv.cheapest_edits("") == (0, "")


def brute(rows):
    """The contract, one conversation after the other."""
    talks = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        out = talks.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    result = []
    for conv, out in talks.items():
        digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        seen, shape, blank, duplicate, truncated = set(), "", 0, 0, 0
        for _, role, text in out:
            kept, fault = text.rstrip(SEPARATORS), "k"
            if not kept:
                fault, blank = "x", blank + 1
            elif (role, text) in seen:
                fault, duplicate = "x", duplicate + 1
            elif kept[-1] not in ".!?":
                fault, truncated = "t", truncated + 1
            seen.add((role, text))
            shape += (role[:1] if role[:1] in ("s", "u", "a") else "-") + fault
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
        turns = {t for t, _, _ in out if t is not None}
        cost, audit = cv.cheapest_edits(shape)
        lines, last, left = [], "", iter(out)
        for letter in audit:
            _, role, text = (0, "", "") if letter == "I" else next(left)
            if letter != "D":
                role = role if letter == "K" else "assistant" if last == "u" else "user"
                lines.append(f"{role}:{text}")
                last = role[0]
        result.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank,
                       duplicate, truncated, illegal, cost, audit,
                       hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(result, key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("clash") for c in ("there", "mark", "place", "audit", "hit", "copy")})
    got = sorted((tuple(r) for r in cv.repair(cv.damaged(df)).collect()), key=repr)
    assert got == brute(rows)
    return got


def test_random_conversations(spark):
    draw = random.Random(5)
    texts = ["Yes.", "No!", "cut off", "Why?", "", " \t\n", "Yes. \n", "…", "\x85", "a.\x0b"]
    rows = [(c, t, draw.choice(["user", "assistant", "assistant", "system", "tool", "student", ""]),
             draw.choice(texts)) for c in range(150) for t in range(draw.randrange(1, 9))]
    got = check(spark, rows)
    assert {"K", "R", "D"} <= set("".join(r[7] for r in got))


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x."), (1, None, "user", None),
            (1, None, "assistant", "null turn first."), (1, 3, "user", "b."), (1, 3, "user", "a."),
            (1, 3, "user", "a."), (1, 9, "assistant", "word " * 200_000 + "."), (2, 5, None, "r."),
            (3, 10 ** 12, "system", "only."), (4, -3, "user", "é!"), (4, 2, "assistant", "ß?")]
    check(spark, rows)


def test_one_long_conversation(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(1500)]
    got = check(spark, rows + [(8, 0, "user", "a."), (8, 1, "assistant", "b.")])
    assert got[0][3] > 10 and len(got) == 2


def test_all_rows_dropped(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = check(spark, [(gone, 0, "user", "a.")])
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    df = cv.repair(cv.damaged(spark.createDataFrame([], SCHEMA)))
    assert df.collect() == [] and df.columns[0] == "conv_id" and len(df.columns) == 9
