"""DuckDB SQL of the queries that SQL can express.

The other operators hash with functions that DuckDB lacks, search with random embeddings or
fit models; tests/llm holds them against brute force, round trips and held-out labels.
"""

from __future__ import annotations

from lexitilt.llm.quality_rules import Rules
from lexitilt.llm.url_filter import ALPHABET, LOWER, ORDER, RULES, UPPER

_SPLIT = r"'[\x20\x09-\x0D]+'"


def _quality_rules() -> str:
    r = Rules()
    classes = [r"\p{Lu}+", r"\p{L}+", r"\p{Nd}+", "[.,]+", "[!?;:''\"()-]+"]
    left = "regexp_replace(t, '[\\p{Ll}\\x20\\x09-\\x0D]+', '', 'g')"
    rests = [left]
    for pattern in classes:
        left = f"regexp_replace({left}, '{pattern}', '', 'g')"
        rests.append(left)
    sizes = ", ".join(f"length({x}) AS r{k}" for k, x in enumerate(rests))
    last = len(classes)
    shares = ["n - r0 - (n - word_chars)", "n - word_chars",
              *[f"r{k} - r{k + 1}" for k in range(last)], f"r{last}"]
    listed = ", ".join(f"CASE WHEN n > 0 THEN ({s})::DOUBLE / n ELSE 0.0 END" for s in shares)

    def js(p: str, q: str) -> str:
        part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
        return f"sqrt(greatest(sum({part(p, q)} + {part(q, p)}) / 2, 0))"

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN regexp_split_to_array(t, {_SPLIT}) IF x <> ''] AS ws FROM d),
places AS (SELECT rid, lang, length(t) AS chars, unnest(ws) AS word,
                  generate_subscripts(ws, 1) AS i FROM w),
windows AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' '
                   || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS win
            FROM places WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c
                              FROM windows WHERE win IS NOT NULL) WHERE c > 1),
repeats AS (SELECT rid, sum(least(5, coalesce(following - i, 5)))::BIGINT AS n_repeat_words
            FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS following FROM twice)
            GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
copies AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
           WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
base AS (SELECT w.rid, doc_id, lang, t, length(t) AS n, len(ws) AS n_words,
                length(array_to_string(ws, '')) AS word_chars,
                length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
                coalesce(n_dup_lines, 0) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words
         FROM w LEFT JOIN copies USING (rid) LEFT JOIN repeats USING (rid)),
sized AS (SELECT *, {sizes} FROM base),
shares AS (SELECT rid, lang, n, unnest([{listed}]) AS p, unnest(range({len(shares)})) AS k FROM sized),
known AS (SELECT lang FROM base WHERE lang IS NOT NULL AND n >= {r.min_chars} GROUP BY lang
          HAVING count(*) >= {r.min_reference_documents}),
class_refs AS (SELECT lang AS ref, k, avg(p) AS q FROM shares
               WHERE n >= {r.min_chars} AND lang IN (SELECT lang FROM known) GROUP BY lang, k),
counted AS (SELECT lang AS ref, lower(word) AS word, count(*) AS c FROM places
            WHERE chars >= {r.min_chars} AND lang IN (SELECT lang FROM known) GROUP BY ALL),
ranked AS (SELECT ref, word, c, sum(c) OVER (PARTITION BY ref) AS total,
                  row_number() OVER (PARTITION BY ref ORDER BY c DESC, word) AS place FROM counted),
word_refs AS (SELECT ref, word, place, c::DOUBLE / total AS q FROM ranked
              WHERE place <= {r.common_words}),
held AS (SELECT rid, n, n_words, known.lang AS ref FROM base, known
         WHERE base.lang = known.lang OR base.lang IS NULL),
class_each AS (SELECT rid, ref, {js('p', 'q')} AS distance FROM shares JOIN held USING (rid)
               JOIN class_refs USING (ref, k) WHERE held.n >= {r.min_chars} GROUP BY rid, ref),
seen AS (SELECT rid, lower(word) AS word, count(*) AS c FROM places GROUP BY ALL),
common AS (SELECT rid, ref, q, coalesce(c, 0)::DOUBLE / n_words AS p
           FROM held JOIN word_refs USING (ref) LEFT JOIN seen USING (rid, word)
           WHERE n_words >= {r.min_words_seen}),
with_rest AS (SELECT rid, ref, p, q FROM common UNION ALL
              SELECT rid, ref, greatest(0, 1 - sum(p)), 1 - sum(q) FROM common GROUP BY rid, ref),
word_each AS (SELECT rid, ref, {js('p', 'q')} AS distance FROM with_rest GROUP BY rid, ref),
class_least AS (SELECT rid, min(distance) AS class_distance FROM class_each GROUP BY rid),
word_least AS (SELECT rid, min(distance) AS word_distance FROM word_each GROUP BY rid),
judged AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words
                     AS base_failed
           FROM base LEFT JOIN class_least USING (rid) LEFT JOIN word_least USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
       NOT base_failed AND coalesce(class_distance <= {r.max_class_distance}, true)
       AND coalesce(word_distance <= {r.max_word_distance}, true) AS kept
FROM judged"""


def _url_filter() -> str:
    rule = action = "NULL"
    for x in sorted(reversed(RULES), key=lambda x: len(x.text)):
        fits = (f"(host = '{x.host}' OR ends_with(host, '.{x.host}')) "
                f"AND starts_with(path, '{x.path}')")
        rule = f"CASE WHEN {fits} THEN '{x.text}' ELSE {rule} END"
        action = f"CASE WHEN {fits} THEN '{x.action}' ELSE {action} END"
    levels, floor = [], f"(1.0::DOUBLE / {ALPHABET})"
    for order in range(ORDER + 1):
        if order:
            source = f"grams JOIN level{order - 1} below ON substr(grams.run, 2) = below.run"
            pa, pb = "below.p_a", "below.p_b"
        else:
            source, pa, pb = "grams", floor, floor
        q = lambda n, p: (
            f"CASE WHEN sum({n}) OVER c > 0 THEN ({n} + sum(CASE WHEN {n} > 0 THEN 1 ELSE 0 END) "
            f"OVER c * {p}) / (sum({n}) OVER c + sum(CASE WHEN {n} > 0 THEN 1 ELSE 0 END) OVER c) "
            f"ELSE {p} END")
        levels.append(f"""level{order} AS (
  WITH grams AS (SELECT right(run, {order + 1}) AS run, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b
                 FROM runs GROUP BY ALL)
  SELECT grams.run, {q('a', pa)} AS p_a, {q('b', pb)} AS p_b FROM {source}
  WINDOW c AS (PARTITION BY left(grams.run, {order})))""")
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0
                    THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}',
                  '{LOWER}') AS host,
                  regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''),
                  '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ruled AS (SELECT page_id, url, host, path, {rule} AS rule, {action} AS action FROM parsed),
urls AS (SELECT url, count(*) AS n, any_value(action) AS action,
                ('0x' || substr(md5(url), 1, 8))::BIGINT % 5 > 0 AS training
         FROM ruled WHERE length(url) > 0 GROUP BY url),
places AS (SELECT url, n, CASE WHEN training THEN action END AS label,
                  substr(repeat(chr(2), {ORDER}) || translate(url, '{UPPER}', '{LOWER}') || chr(3),
                         unnest(range(1, length(url) + 2)), {ORDER + 1}) AS run FROM urls),
runs AS (SELECT run, sum(CASE WHEN label = 'allow' THEN n ELSE 0 END) AS a,
                sum(CASE WHEN label = 'block' THEN n ELSE 0 END) AS b FROM places GROUP BY run),
{", ".join(levels)},
scores AS (SELECT url, sum(ln(p_a / p_b)) / count(*) AS score
           FROM places JOIN level{ORDER} USING (run) GROUP BY url),
bins AS (SELECT greatest(-2000, least(2000, floor(score * 100))) AS bin,
                sum(CASE WHEN action = 'allow' THEN n ELSE 0 END) AS a,
                sum(CASE WHEN action = 'block' THEN n ELSE 0 END) AS b
         FROM urls JOIN scores USING (url) WHERE NOT training AND action IS NOT NULL GROUP BY bin),
accuracy AS (SELECT bin, (sum(a) OVER () - coalesce(sum(a) OVER below, 0))::DOUBLE / sum(a) OVER ()
                    + coalesce(sum(b) OVER below, 0)::DOUBLE / sum(b) OVER () AS value
             FROM bins WINDOW below AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
threshold AS (SELECT bin / 100 AS t FROM accuracy ORDER BY value DESC, bin LIMIT 1)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN round(coalesce(score, 0), 6) >= t THEN 'allow' ELSE 'block' END)
       AS verdict, round(coalesce(score, 0), 6) AS score
FROM ruled LEFT JOIN scores USING (url), threshold"""


ORACLES: dict[str, str] = {
    "op1_quality_rules": _quality_rules(),
    "op3_url_filter": _url_filter(),
}
