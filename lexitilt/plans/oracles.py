"""The registered queries once more, as plain SQL for another engine.

Each statement is built from named common table expressions. The formulas are the
textbook ones - windows for duplicates, all pairs of words for associations - so
that they check the Spark plans, which take other ways.
"""

from __future__ import annotations

import re

from lexitilt.functions import fixed_values as fv
from lexitilt.operators.dedup import EXACT, TEMPLATE
from lexitilt.plans.queries import DIMENSIONS, LABEL_SPEC
from lexitilt.sources import derived

ORACLES: dict[str, str] = {}


# Expressions

def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(text_literal(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{fv.STRIP_PATTERN}', '', 'g')"


def key(x: str) -> str:
    return f"lower({strip(x)})"


def found(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, '{pattern}'" + (f", '{flags}')" if flags else ")")


def norm(x: str) -> str:
    value = f"lower(coalesce({x}, ''))"
    for old, new in fv.TOKEN_REPLACEMENTS.items():
        value = f"replace({value}, '{old}', '{new}')"
    value = f"replace(regexp_replace({value}, '{fv.URL_PATTERN}', ' ', 'g'), '&', ' and ')"
    return f"trim(regexp_replace({value}, '[^a-z0-9]+', ' ', 'g'))"


def without_numbers(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '\b[0-9]+\b', ' ', 'g'), ' +', ' ', 'g'))"


def lookup(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {text_literal(k)} THEN {text_literal(v)}" for k, v in table.items())
    return f"CASE {x} {cases} END"


def words_of(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, ' ') END"


def listed(tokens: str, words) -> str:
    return (f"len(regexp_extract_all('  ' || array_to_string({tokens}, '  ') || '  ', "
            f"' ({'|'.join(words)}) '))")


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def per_1000(x: str) -> str:
    return f"(1000.0 * {x} / nullif(token_total, 0))"


GROUPS = ", ".join(f"({i}, '{g}')" for i, g in enumerate(fv.GROUP_ORDER))
DATE_COLUMNS = ["listed_time", "closed_time"]
POSTING_COLUMNS = [
    "job_id", "company_id", "company_name", "title", "description", "skills_desc",
    "formatted_experience_level", "experience", "qualifications", "responsibilities",
    "preference", "listed_time", "closed_time"]

# Common table expressions, each after those it reads

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


cte("postings", derived.POSTINGS.format(documents="documents"))
cte("job_industries", derived.JOB_INDUSTRIES.format(documents="documents", labels="labels"))
cte("industries", derived.INDUSTRIES)
cte("companies", derived.COMPANIES.format(nation="nation"))
cte("group_names", f"SELECT * FROM (VALUES {GROUPS}) AS t(group_order, \"group\")")

cte("lookup", f"""
SELECT job_id, bool_or(coalesce({found(key('industry_name'), fv.TECH_INDUSTRY_PATTERN)}, false))
         AS is_tech_industry,
  coalesce(array_to_string(list_slice(list_sort(list(DISTINCT industry_name)
    FILTER (industry_name IS NOT NULL)), 1, 3), ' | '), '') AS industry_name
FROM job_industries LEFT JOIN industries USING (industry_id) GROUP BY job_id""")

cte("ruled", f"""
SELECT p.*, coalesce(l.is_tech_industry, false) AS is_tech_industry, l.industry_name,
  CASE WHEN {key('title')} = '' THEN 'missing_title'
    WHEN {found(key('title'), fv.NON_DIGITAL_ENGINEERING_PATTERN)} THEN 'non_digital_engineering'
    WHEN {found(key('title'), fv.OFF_TARGET_ROLE_PATTERN)} THEN 'off_target_business_role'
    WHEN {found(key('title'), fv.CORE_DIGITAL_TITLE_PATTERN)} THEN 'title_core'
    WHEN {found(key('title'), fv.TECH_LEADERSHIP_TITLE_PATTERN)} THEN 'title_leadership'
    WHEN {found(key('title'), fv.AMBIGUOUS_TECH_TITLE_PATTERN)} THEN
      CASE WHEN coalesce(l.is_tech_industry, false)
             OR {found(key('description'), fv.TECH_DESCRIPTION_PATTERN)}
        THEN 'ambiguous_title_supported' ELSE 'ambiguous_title_without_tech_context' END
    ELSE 'no_tech_scope_signal' END AS rule
FROM postings p LEFT JOIN lookup l USING (job_id)""")

cte("scoped", """
SELECT * EXCLUDE (rule),
  rule IN ('title_core', 'title_leadership', 'ambiguous_title_supported') AS scope_include,
  CASE WHEN rule IN ('title_core', 'title_leadership', 'ambiguous_title_supported',
                     'missing_title') THEN rule ELSE 'excluded' END AS scope_reason,
  CASE WHEN rule IN ('title_core', 'title_leadership', 'ambiguous_title_supported')
    THEN '' ELSE rule END AS scope_exclusion_reason,
  is_tech_industry AS is_broad_tech_company
FROM ruled""")

cte("labeled", f"""
SELECT *, formatted_experience_level AS raw_experience_level,
  coalesce(signal, level, 'mid') AS seniority_final,
  CASE WHEN signal IS NULL AND level IS NOT NULL THEN 'linkedin_primary'
    WHEN signal <> level THEN 'title_override' ELSE 'title_backfill' END AS seniority_source,
  CASE signal WHEN 'entry' THEN 'entry_title_signal' WHEN 'senior' THEN 'senior_title_signal'
    WHEN 'leadership' THEN 'leadership_title_signal' ELSE
      CASE WHEN level IS NOT NULL THEN 'linkedin_experience_level'
        ELSE 'default_mid_backfill' END END AS seniority_rule
FROM (SELECT *,
    CASE WHEN {found(key('title'), fv.ENTRY_TITLE_PATTERN)} THEN 'entry'
      WHEN {found(key('title'), fv.LEADERSHIP_TITLE_PATTERN)} THEN 'leadership'
      WHEN {found(key('title'), fv.SENIOR_TITLE_PATTERN)} THEN 'senior' END AS signal,
    {lookup(strip('formatted_experience_level'), fv.LEVEL_TO_SENIORITY)} AS level
  FROM scoped WHERE scope_include)""")


def text_columns(source: str) -> str:
    return f"""
SELECT *, sha1(concat(title_exact_norm, '||', description_exact_norm)) AS {EXACT},
  sha1(description_template_norm) AS {TEMPLATE},
  len({words_of('model_text')}) AS token_count
FROM (SELECT *, {without_numbers('description_exact_norm')} AS description_template_norm
  FROM (SELECT *, {norm('title')} AS title_exact_norm,
      {norm('description')} AS description_exact_norm,
      {norm("concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(skills_desc, ''))")}
        AS model_text,
      {strip("concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(skills_desc, ''))")}
        AS text_raw
    FROM {source}))"""


cte("all_text", text_columns("postings"))
cte("core_text", text_columns("labeled"))
cte("variant_text", text_columns(
    "(SELECT * FROM labeled WHERE seniority_source = 'linkedin_primary')"))


def flagged(source: str) -> str:
    return f"""
SELECT *, NOT (is_exact_duplicate OR is_template_duplicate) AS keep_for_model
FROM (SELECT *,
    row_number() OVER (PARTITION BY {EXACT} ORDER BY job_id) > 1 AS is_exact_duplicate,
    row_number() OVER (PARTITION BY {TEMPLATE} ORDER BY job_id) > 1 AS is_template_duplicate,
    CASE WHEN count(*) OVER (PARTITION BY {TEMPLATE}) > 1 THEN {TEMPLATE} ELSE '' END
      AS duplicate_group_id
  FROM {source})"""


cte("flagged", flagged("core_text"))
cte("variant_flagged", flagged("variant_text"))

_UNICODE_WORDS = (r"regexp_replace(regexp_replace({x}, '[^\pL\pN\pM\x00-\x7f]', ' ', 'g'), "
                  r"'[^\x00-\x7f]', 'Z', 'g')")  # letters of any script bound words


def embedding_text(x: str) -> str:
    value = _UNICODE_WORDS.format(x=f"lower({x})")
    value = f"regexp_replace({value}, '{fv.LEAKAGE_PATTERN}', ' ', 'g')"
    value = f"regexp_replace({value}, '{fv.BARE_URL_PATTERN}', ' ', 'g')"
    return f"trim(regexp_replace({value}, '[^a-z0-9.+#_-]+', ' ', 'g'))"


def _clean(x: str) -> str:
    value = f"regexp_replace(lower({x}), '{fv.BARE_URL_PATTERN}', ' ', 'g')"
    return f"trim(regexp_replace({value}, '[^a-z]+', ' ', 'g'))"


_ALL_PARTS = " || ' ' || ".join(
    f"coalesce({c}, '')" for c in ("description", "experience", "qualifications",
                                   "responsibilities"))
_TWO_PARTS = "coalesce(description, '') || ' ' || coalesce(responsibilities, '')"


def _years(pattern: str, part: int) -> str:
    return (f"TRY_CAST(nullif(regexp_extract({key('experience')}, '{pattern}', {part}), '') "
            "AS BIGINT)")


cte("synthetic", f"""
SELECT *, hi - lo AS span FROM (SELECT *, {_clean(_ALL_PARTS)} AS clean_text,
  {embedding_text(_TWO_PARTS)} AS embedding_text, {key('title')} AS t,
  coalesce({_years(fv.EXPERIENCE_RANGE_PATTERN, 1)}, {_years(fv.EXPERIENCE_SINGLE_PATTERN, 1)})
    AS lo,
  coalesce({_years(fv.EXPERIENCE_RANGE_PATTERN, 2)}, {_years(fv.EXPERIENCE_SINGLE_PATTERN, 1)})
    AS hi,
  {lookup("replace(" + key('qualifications') + ", ' ', '')", fv.DEGREE_LEVELS)} AS degree
FROM postings)""")

cte("hybrid", f"""
SELECT *, CASE
  WHEN {found('t', fv.EARLY_CAREER_PATTERN)} OR coalesce(lo <= 1, false) THEN 'entry'
  WHEN lo >= 2 AND ({found('t', fv.EXEC_TITLE_PATTERN)} OR {found('t', fv.DIRECTOR_PATTERN)}
    OR {found('clean_text', fv.LEADERSHIP_DUTY_PATTERN)}
    OR {found('clean_text', fv.MANAGER_PATTERN)} OR {found('t', fv.ARCHITECT_PATTERN)})
    THEN 'leadership'
  WHEN {found('t', fv.SENIOR_MARK_PATTERN)} OR {found('clean_text', fv.SENIOR_DUTY_PATTERN)}
    OR {found('clean_text', fv.SENIOR_MARK_PATTERN)} OR coalesce(lo >= 5, false) THEN 'senior'
  ELSE 'mid' END AS seniority
FROM synthetic""")

_IS_TECH = (f"({found('t', fv.TECH_TITLE_INCLUDE_PATTERN)} "
            f"AND NOT {found('t', fv.TECH_TITLE_EXCLUDE_PATTERN)})")
cte("tech", f"SELECT * FROM hybrid WHERE {_IS_TECH}")
cte("capped", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seniority, embedding_text
  ORDER BY job_id) AS copy FROM tech WHERE embedding_text <> '') WHERE copy <= 20""")

cte("shares", """
SELECT "group", coalesce(n, 0) AS rows, round(100.0 * coalesce(n, 0) / sum(n) OVER (), 2) AS pct
FROM group_names LEFT JOIN (SELECT seniority AS "group", count(*) AS n FROM tech GROUP BY 1)
  USING ("group")""")

# Corpora as (group, job_id, tokens)
cte("core_docs", f"""
SELECT seniority_final AS "group", job_id, {words_of('model_text')} AS tokens
FROM flagged WHERE keep_for_model""")
cte("synthetic_docs", f"""
SELECT seniority AS "group", job_id,
  regexp_extract_all(embedding_text, '{fv.TECH_TOKEN_PATTERN}') AS tokens FROM capped""")
cte("variant_docs", f"""
SELECT 'main|' || seniority_final AS "group", job_id, {words_of('model_text')} AS tokens
FROM flagged WHERE keep_for_model
UNION ALL
SELECT 'labeled_only|' || seniority_final, job_id, {words_of('model_text')}
FROM variant_flagged WHERE keep_for_model""")


def floor_of(docs: str, steps=fv.MIN_COUNT_STEPS) -> str:
    cases = " ".join(f"WHEN {docs} < {limit} THEN {value}" for limit, value in steps)
    return f"CASE {cases} ELSE {fv.MIN_COUNT_ABOVE} END"


def corpus_ctes(docs: str) -> dict[str, str]:
    """Places, frequencies, vocabulary and PPMI cells of one corpus."""
    return {
        "places": f"""
SELECT "group", job_id, len(tokens) AS size, unnest(tokens) AS word,
  unnest(range(1, len(tokens) + 1)) AS pos FROM {docs}""",
        "sizes": f"""
SELECT "group", count(*) AS documents, count(CASE WHEN len(tokens) > 0 THEN 1 END) AS docs,
  CAST(sum(len(tokens)) AS BIGINT) AS tokens, {floor_of('count(CASE WHEN len(tokens) > 0 THEN 1 END)')} AS floor
FROM {docs} GROUP BY 1""",
        "singles": """
SELECT "group", word, count(*) AS n,
  sum(least(pos - 1, 5) + least(size - pos, 5))::DOUBLE AS near FROM places GROUP BY 1, 2""",
        "totals": 'SELECT "group", sum(near) AS total FROM singles GROUP BY 1',
        "vocab": """
SELECT "group", word, n, near, total FROM singles JOIN sizes USING ("group")
  JOIN totals USING ("group") WHERE n >= floor""",
    }


def pair_ctes(words=None) -> dict[str, str]:
    limit = "" if words is None else f" AND a.word IN {in_list(words)}"
    only = "" if words is None else f" WHERE word IN {in_list(words)}"
    return {
        "steps": "SELECT unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS step",
        "looks": f"""
SELECT a."group", a.job_id, a.word, a.pos + step AS pos FROM places a CROSS JOIN steps
WHERE a.pos + step BETWEEN 1 AND size{limit}""",
        "pairs": """
SELECT a."group", a.word, b.word AS ctx, count(*)::DOUBLE AS n FROM looks a JOIN places b
  ON a."group" = b."group" AND a.job_id = b.job_id AND a.pos = b.pos GROUP BY 1, 2, 3""",
        "half": """
SELECT p."group", p.word, p.ctx, p.n * w.total / w.near AS ratio
FROM pairs p JOIN vocab w ON p."group" = w."group" AND p.word = w.word""",
        "sparse": """
SELECT h."group", h.word, h.ctx, ln(h.ratio / c.near) AS weight
FROM half h JOIN vocab c ON h."group" = c."group" AND h.ctx = c.word
WHERE h.ratio > c.near""",
        "sparse_words": f'SELECT "group", word, n FROM vocab{only}',
    }


def sign_bit() -> str:
    return ("((('0x' || substr(md5(seed || ':' || (i // 60) || ':' || ctx), 1, 15))::BIGINT "
            ">> (i % 60)::INT) & 1)")


def dense_ctes(seeds=fv.SEEDS, size: int = DIMENSIONS) -> dict[str, str]:
    bit = sign_bit()
    return {
        "seeds": "SELECT * FROM (VALUES " + ", ".join(f"({s})" for s in seeds) + ") AS t(seed)",
        "coordinates": f"SELECT CAST(unnest(range(0, {size})) AS INTEGER) AS i",
        "projected": f"""
SELECT "group", seed, word, i,
  sum(CASE WHEN {bit} = 1 THEN weight ELSE -weight END) / sqrt({size}) AS x
FROM sparse CROSS JOIN seeds CROSS JOIN coordinates GROUP BY 1, 2, 3, 4""",
        "dense": """
SELECT w."group", s.seed, w.word, w.n, c.i, coalesce(x, 0) AS x
FROM sparse_words w CROSS JOIN seeds s CROSS JOIN coordinates c
  LEFT JOIN projected p ON p."group" = w."group" AND p.seed = s.seed AND p.word = w.word
    AND p.i = c.i""",
    }


def weat_ctes(model_words: str, model_cells: str, specs, *, min_coverage: int = 1,
              sampled: int | None = None, default_seed: int = 42) -> dict[str, str]:
    """Test results from words (group, seed, word) and cells (group, seed, word, ctx,
    weight); models without a seed come with seed NULL."""
    rows = ", ".join(
        f"('{test}', '{role}', {i}, '{w}')" for test, spec in specs.items()
        for role, words in spec.items() for i, w in enumerate(words))
    permuted = (f"""
SELECT m.model, m.test_name, d.draw, sum(CASE WHEN rank <= k THEN s ELSE -s END) AS score
FROM (SELECT model, test_name, s, k, draw, row_number() OVER (PARTITION BY model, test_name, draw
        ORDER BY md5(coalesce(seed, {default_seed}) || ':' || draw || ':' || word)) AS rank
      FROM numbered CROSS JOIN (SELECT unnest(range(1, {sampled} + 1)) AS draw)) m
  JOIN (SELECT unnest(range(1, {sampled} + 1)) AS draw) d USING (draw)
GROUP BY 1, 2, 3""" if sampled else """
SELECT model, test_name, draw,
  sum(CASE WHEN (draw >> (i - 1)::INT) & 1 = 1 THEN s ELSE -s END) AS score
FROM numbered JOIN (SELECT unnest(range(0, 65536)) AS draw)
  ON draw < (1 << size::INT) AND bit_count(draw) = k
GROUP BY 1, 2, 3""")
    return {
        "spec": f"SELECT * FROM (VALUES {rows}) AS t(test_name, role, ord, word)",
        "model_words": model_words,
        "model_cells": model_cells,
        "w_words": """
SELECT "group", seed, concat("group", '/', seed) AS model, word FROM model_words""",
        "w_cells": """
SELECT concat("group", '/', seed) AS model, word, ctx, weight FROM model_cells
WHERE word IN (SELECT word FROM spec)""",
        "models": """
SELECT DISTINCT "group", seed, model, test_name FROM w_words
  CROSS JOIN (SELECT DISTINCT test_name FROM spec)""",
        "present": "SELECT w.model, w.seed, s.* FROM w_words w JOIN spec s USING (word)",
        "covered": """
SELECT m."group", m.seed, m.model, m.test_name,
  count(CASE WHEN role = 'targets_a' THEN 1 END) AS coverage_targets_a,
  count(CASE WHEN role = 'targets_b' THEN 1 END) AS coverage_targets_b,
  count(CASE WHEN role = 'attributes_a' THEN 1 END) AS coverage_attrs_a,
  count(CASE WHEN role = 'attributes_b' THEN 1 END) AS coverage_attrs_b
FROM models m LEFT JOIN present p USING (model, test_name) GROUP BY 1, 2, 3, 4""",
        "norms": """
SELECT model, word, sqrt(sum(weight * weight)) AS norm FROM w_cells GROUP BY 1, 2""",
        "dots": """
SELECT a.model, a.word, b.word AS other, sum(a.weight * b.weight) AS dot
FROM w_cells a JOIN w_cells b ON a.model = b.model AND a.ctx = b.ctx GROUP BY 1, 2, 3""",
        "cosines": """
SELECT p.model, p.seed, p.test_name, p.role, p.ord, p.word, q.role AS other_role,
  coalesce(d.dot / (n1.norm * n2.norm), 0) AS cosine
FROM present p JOIN present q ON p.model = q.model AND p.test_name = q.test_name
    AND p.role LIKE 'targets%' AND q.role LIKE 'attributes%'
  LEFT JOIN dots d ON d.model = p.model AND d.word = p.word AND d.other = q.word
  LEFT JOIN norms n1 ON n1.model = p.model AND n1.word = p.word
  LEFT JOIN norms n2 ON n2.model = q.model AND n2.word = q.word""",
        "to_attributes": """
SELECT model, seed, test_name, role, ord, word,
  coalesce(sum(cosine) FILTER (other_role = 'attributes_a'), 0) AS to_a,
  coalesce(sum(cosine) FILTER (other_role = 'attributes_b'), 0) AS to_b
FROM cosines GROUP BY 1, 2, 3, 4, 5, 6""",
        "s": f"""
SELECT a.*, to_a / coverage_attrs_a - to_b / coverage_attrs_b AS s, coverage_targets_a AS k
FROM to_attributes a JOIN covered USING (model, test_name)
WHERE least(coverage_targets_a, coverage_targets_b, coverage_attrs_a, coverage_attrs_b)
  >= {min_coverage}""",
        "numbered": """
SELECT model, seed, test_name, word, s, k,
  row_number() OVER (PARTITION BY model, test_name ORDER BY role, ord) AS i,
  count(*) OVER (PARTITION BY model, test_name) AS size FROM s""",
        "effects": """
SELECT model, test_name, (avg(s) FILTER (role = 'targets_a') - avg(s) FILTER (role = 'targets_b'))
    / nullif(stddev_samp(s), 0) AS effect_size,
  sum(CASE role WHEN 'targets_a' THEN s ELSE -s END) AS test_statistic
FROM s GROUP BY 1, 2""",
        "permuted": permuted,
        "p_values": """
SELECT model, test_name, (count(CASE WHEN score >= test_statistic - 1e-12 THEN 1 END) + 1) / (count(*) + 1)
  AS p_value FROM permuted JOIN effects USING (model, test_name) GROUP BY 1, 2""",
        "results": """
SELECT c."group", c.seed, c.test_name, coverage_targets_a, coverage_targets_b,
  coverage_attrs_a, coverage_attrs_b, effect_size, test_statistic, p_value
FROM covered c LEFT JOIN effects USING (model, test_name)
  LEFT JOIN p_values USING (model, test_name)""",
    }


SPEC_WORDS = sorted({w for s in fv.WEAT_SPECS.values() for ws in s.values() for w in ws})
SPEC_WORDS_SYNTHETIC = sorted(
    {w for s in fv.WEAT_SPECS_SYNTHETIC.values() for ws in s.values() for w in ws})

CORE = corpus_ctes("core_docs")
CORE_PAIRS = {**CORE, **pair_ctes(SPEC_WORDS)}
SPARSE_MODELS = ('SELECT "group", NULL::INTEGER AS seed, word FROM sparse_words',
                 'SELECT "group", NULL::INTEGER AS seed, word, ctx, weight FROM sparse')
DENSE_MODELS = ('SELECT DISTINCT "group", seed, word FROM dense',
                'SELECT "group", seed, word, i AS ctx, x AS weight FROM dense')
CORE_WEAT = {**CORE_PAIRS, **weat_ctes(*SPARSE_MODELS, fv.WEAT_SPECS)}
DENSE_WEAT = {**CORE_PAIRS, **dense_ctes(), **weat_ctes(*DENSE_MODELS, fv.WEAT_SPECS)}
VARIANT_WEAT = {**corpus_ctes("variant_docs"), **pair_ctes(SPEC_WORDS),
                **weat_ctes(*SPARSE_MODELS, fv.WEAT_SPECS)}
SYNTHETIC_WEAT = {**corpus_ctes("synthetic_docs"), **pair_ctes(SPEC_WORDS_SYNTHETIC),
                  **weat_ctes(*SPARSE_MODELS, fv.WEAT_SPECS_SYNTHETIC, min_coverage=3,
                              sampled=100)}
LABEL_MODELS = {
    "centroids": """
SELECT CASE vec_id % 4 WHEN 0 THEN 'entry' WHEN 1 THEN 'mid' WHEN 2 THEN 'senior'
    ELSE 'leadership' END AS "group",
  CASE (vec_id // 4) % 3 WHEN 0 THEN 7 WHEN 1 THEN 17 ELSE 29 END AS seed,
  CAST(label AS VARCHAR) AS word, ctx, avg(x::DOUBLE) AS weight
FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS ctx
      FROM embeddings) GROUP BY 1, 2, 3, 4""",
}
_CENTROIDS = ('SELECT DISTINCT "group", seed, word FROM centroids', "SELECT * FROM centroids")
LABEL_WEAT = {**LABEL_MODELS, **weat_ctes(*_CENTROIDS, LABEL_SPEC)}
LABEL_WEAT_SAMPLED = {**LABEL_MODELS, **weat_ctes(*_CENTROIDS, LABEL_SPEC, sampled=1000)}
LABEL_WEAT_BLOCKS = {**LABEL_MODELS, **weat_ctes(*_CENTROIDS, LABEL_SPEC, sampled=20_000)}


def oracle(name: str, body: str, extra: dict[str, str] | None = None) -> None:
    """Register a statement with just the expressions it reads."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(sql: str) -> None:
        for other in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql):
            if other in known and other not in needed:
                visit(known[other])
                needed.append(other)

    visit(body)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in needed)
    ORACLES[name] = f"WITH {parts}\n{body}" if needed else body


# Profiling

oracle("audit_summary", f"""
SELECT 'rows' AS metric, count(*) AS value FROM postings
UNION ALL SELECT 'columns', {len(POSTING_COLUMNS)}
UNION ALL SELECT 'duplicate_job_id_count', count(*) - count(DISTINCT job_id) FROM postings
UNION ALL SELECT 'description_empty_count', count(*) FROM postings
  WHERE {strip('description')} = ''""")

_RATES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r6(f'avg(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0 END)')} "
    "AS null_pct FROM postings" for c in POSTING_COLUMNS)
oracle("null_rates", _RATES)
oracle("top_null_rates",
       f'SELECT * FROM ({_RATES}) ORDER BY null_pct DESC, "column" LIMIT 12')

_DATES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) AS all_rows, "
    f"make_timestamp(min({c}) * 1000) AS \"min\", make_timestamp(max({c}) * 1000) AS \"max\" "
    "FROM postings" for c in DATE_COLUMNS)
oracle("date_coverage", f'SELECT "column", non_null, "min", "max" FROM ({_DATES})')
oracle("date_spans", f"""
SELECT "column", non_null, "min", "max", {r6('100.0 * non_null / all_rows')} AS coverage_pct,
  {r6('(epoch_us("max") - epoch_us("min")) / 86400e6')} AS span_days FROM ({_DATES})""")
oracle("length_quantiles", f"""
SELECT unnest({fv.TEXT_LENGTH_QUANTILES}::DOUBLE[]) AS quantile,
  round(unnest(quantile_cont(length(coalesce(description, '')), {fv.TEXT_LENGTH_QUANTILES})), 6)
    AS description_length FROM postings""")
oracle("join_coverage", f"""
SELECT *, {r6('100.0 * matched_rows / total_rows')} AS match_rate FROM (
  SELECT 'companies' AS "join", count(CASE WHEN company_id IN (SELECT company_id FROM companies) THEN 1 END)
    AS matched_rows, count(*) AS total_rows FROM postings
  UNION ALL SELECT 'job_industries', count(CASE WHEN job_id IN (SELECT job_id FROM job_industries) THEN 1 END),
    count(*) FROM postings)""")
oracle("level_distribution", """
SELECT coalesce(formatted_experience_level, 'MISSING') AS level, count(*) AS "count"
FROM postings GROUP BY 1""")
oracle("stratified_sample", """
SELECT job_id, title, company_name, formatted_experience_level,
  coalesce(formatted_experience_level, 'MISSING') AS experience_bucket FROM postings
QUALIFY row_number() OVER (PARTITION BY coalesce(formatted_experience_level, 'MISSING')
  ORDER BY md5('42:' || job_id), job_id) <= 5""")
oracle("noisy_labels", " UNION ALL ".join(f"""
(SELECT job_id, title, company_name, formatted_experience_level, '{name}' AS noise_bucket
FROM postings WHERE {found("coalesce(title, '')", pattern, 'i')}
  AND NOT coalesce(formatted_experience_level IN {in_list(levels)}, false)
ORDER BY job_id LIMIT 10)""" for name, (pattern, levels) in fv.NOISY_BUCKETS.items()))

# Scope

oracle("industry_lookup", "SELECT * FROM lookup")
oracle("scope_decisions", """
SELECT job_id, title, is_tech_industry, industry_name, scope_include, scope_reason,
  scope_exclusion_reason, is_broad_tech_company FROM scoped""")
oracle("scope_summary", """
SELECT 'rows_total' AS metric, count(*) AS value FROM scoped
UNION ALL SELECT 'rows_in_scope', count(CASE WHEN scope_include THEN 1 END) FROM scoped
UNION ALL SELECT 'rows_out_of_scope', count(CASE WHEN NOT scope_include THEN 1 END) FROM scoped
UNION ALL SELECT 'broad_tech_company_rows', count(CASE WHEN is_broad_tech_company THEN 1 END) FROM scoped""")
oracle("scope_breakdown", """
SELECT scope_include, scope_reason, scope_exclusion_reason, count(*) AS rows
FROM scoped GROUP BY 1, 2, 3""")
oracle("top_industries", """
SELECT coalesce(nullif(industry_name, ''), 'Missing') AS industry_name, count(*) AS rows
FROM scoped WHERE scope_include GROUP BY 1 ORDER BY rows DESC, 1 LIMIT 10""")
oracle("scope_audit_sample", """
SELECT scope_include, job_id, title, company_name, formatted_experience_level, industry_name,
  scope_reason, scope_exclusion_reason, '' AS manual_precision_note FROM scoped
QUALIFY row_number() OVER (PARTITION BY scope_include ORDER BY md5('42:' || job_id), job_id)
  <= 25""")

# Seniority

oracle("seniority_labels", """
SELECT job_id, raw_experience_level, seniority_final, seniority_source, seniority_rule
FROM labeled""")
oracle("override_review", """
SELECT job_id, title, raw_experience_level, seniority_final, seniority_rule, company_name
FROM labeled WHERE seniority_source = 'title_override'""")
oracle("seniority_source_counts", """
SELECT seniority_final, seniority_source, count(*) AS rows FROM labeled GROUP BY 1, 2""")
oracle("seniority_source_pivot", """
SELECT "group", count(CASE WHEN seniority_source = 'linkedin_primary' THEN 1 END) AS linkedin_primary,
  count(CASE WHEN seniority_source = 'title_backfill' THEN 1 END) AS title_backfill,
  count(CASE WHEN seniority_source = 'title_override' THEN 1 END) AS title_override
FROM group_names LEFT JOIN labeled ON seniority_final = "group" GROUP BY 1""")
oracle("seniority_distribution", """
SELECT "group", count(job_id) AS rows FROM group_names
LEFT JOIN labeled ON seniority_final = "group" GROUP BY 1""")
oracle("seniority_keep_pivot", """
SELECT "group", count(CASE WHEN keep_for_model THEN 1 END) AS kept, count(CASE WHEN NOT keep_for_model THEN 1 END) AS dropped
FROM group_names LEFT JOIN flagged ON seniority_final = "group" GROUP BY 1""")
oracle("experience_parsed", "SELECT job_id, lo, hi, span FROM synthetic")
oracle("degree_levels", "SELECT job_id, degree FROM synthetic")
oracle("title_filters", f"""
SELECT job_id, {_IS_TECH} AS is_tech,
  {found('t', fv.DATA_RESEARCH_TITLE_PATTERN)} AS is_data_research FROM synthetic""")
oracle("seniority_hybrid", "SELECT job_id, seniority FROM hybrid")

_POINTS = " + ".join(
    [f"CASE WHEN {found(x, pattern)} THEN {value} ELSE 0 END" for x, pattern, value in (
        ("t", fv.SENIOR_MARK_PATTERN, fv.SCORE_TITLE_SENIOR),
        ("t", fv.MANAGER_PATTERN, fv.SCORE_TITLE_MANAGER),
        ("clean_text", fv.SENIOR_DUTY_PATTERN, fv.SCORE_TEXT_DUTY),
        ("clean_text", fv.SENIOR_MARK_PATTERN, fv.SCORE_TEXT_SENIOR),
        ("clean_text", fv.MANAGER_PATTERN, fv.SCORE_TEXT_MANAGER),
        ("clean_text", fv.EARLY_CAREER_PATTERN, fv.SCORE_TEXT_EARLY))]
    + ["CASE " + " ".join(f"WHEN lo >= {y} THEN {p}" for y, p in fv.SCORE_YEARS) + " ELSE 0 END",
       "CASE degree " + " ".join(f"WHEN '{d}' THEN {p}" for d, p in fv.SCORE_DEGREES.items())
       + " ELSE 0 END"])
oracle("seniority_scored", f"""
SELECT job_id, CASE
  WHEN {found('t', fv.EXEC_TITLE_PATTERN)} AND NOT {found('t', fv.LOWERING_PATTERN)}
    THEN 'leadership'
  WHEN {found('t', fv.DIRECTOR_PATTERN)} AND lo >= 8 THEN 'leadership'
  WHEN {found('t', fv.EARLY_CAREER_PATTERN)} THEN 'entry'
  WHEN hi <= 1 THEN 'entry'
  WHEN {found('t', fv.LOWERING_PATTERN)} AND {found('t', fv.MANAGER_PATTERN)} THEN 'mid'
  WHEN score >= {fv.SCORE_SENIOR_FROM} THEN 'senior'
  WHEN score <= {fv.SCORE_ENTRY_UPTO} THEN 'entry' ELSE 'mid' END AS seniority
FROM (SELECT *, {_POINTS} AS score FROM synthetic)""")
oracle("tech_share", f"""
SELECT count(*) AS rows_total, count(CASE WHEN {_IS_TECH} THEN 1 END) AS rows_tech,
  round(100.0 * count(CASE WHEN {_IS_TECH} THEN 1 END) / count(*), 2) AS pct_tech FROM synthetic""")
oracle("seniority_shares", 'SELECT "group", rows, pct FROM shares')
oracle("seniority_guardrails", """
SELECT "group", min_pct::DOUBLE AS min_pct, max_pct::DOUBLE AS max_pct, pct
FROM shares JOIN (VALUES """ + ", ".join(
    f"('{g}', {lo}, {hi})" for g, (lo, hi) in fv.SHARE_GUARDRAILS.items()) + """
) AS t("group", min_pct, max_pct) USING ("group") WHERE NOT pct BETWEEN min_pct AND max_pct""")

# Text

oracle("text_normalised", """
SELECT job_id, title_exact_norm, description_exact_norm, description_template_norm
FROM all_text""")
oracle("model_text", "SELECT job_id, text_raw, model_text, token_count FROM all_text")
_NAN_TEXT = norm("concat_ws(' ', coalesce(title, 'nan'), coalesce(description, 'nan'), "
                 "coalesce(skills_desc, 'nan'))")
oracle("model_text_nan_parity", f"""
SELECT job_id, model_text, len({words_of('model_text')}) AS token_count
FROM (SELECT job_id, {_NAN_TEXT} AS model_text FROM postings)""")
oracle("text_fingerprints", f"SELECT job_id, {EXACT}, {TEMPLATE} FROM all_text")
oracle("clean_text_synthetic", "SELECT job_id, clean_text FROM synthetic")
oracle("embedding_text_synthetic", "SELECT job_id, embedding_text FROM synthetic")
oracle("mean_token_lengths", f"""
SELECT {r6(f"avg(len({words_of('clean_text')}))")} AS mean_clean_text_tokens,
  {r6(f"avg(len({words_of('embedding_text')}))")} AS mean_embedding_text_tokens
FROM synthetic""")
oracle("tokeniser_counts", f"""
SELECT job_id, len({words_of('embedding_text')}) AS whitespace_tokens,
  len(regexp_extract_all(embedding_text, '{fv.LETTER_TOKEN_PATTERN}')) AS letter_tokens,
  len(regexp_extract_all(embedding_text, '{fv.TECH_TOKEN_PATTERN}')) AS tech_tokens
FROM synthetic""")
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in fv.SYNTHETIC_COLUMNS.values())
oracle("complete_rows", f"""
SELECT count(*) AS initial_rows, count(CASE WHEN {_COMPLETE} THEN 1 END) AS complete_rows,
  count(*) - count(CASE WHEN {_COMPLETE} THEN 1 END) AS dropped_rows FROM postings""")

# Duplicates

oracle("dedup_flags", """
SELECT job_id, is_exact_duplicate, is_template_duplicate, duplicate_group_id, keep_for_model
FROM flagged""")


def _duplicates(source: str) -> str:
    return f"""
SELECT 'rows_total' AS metric, count(*) AS value FROM {source}
UNION ALL SELECT 'rows_kept_for_model', count(CASE WHEN keep_for_model THEN 1 END) FROM {source}
UNION ALL SELECT 'exact_duplicates', count(CASE WHEN is_exact_duplicate THEN 1 END) FROM {source}
UNION ALL SELECT 'template_duplicates', count(CASE WHEN is_template_duplicate THEN 1 END) FROM {source}"""


oracle("duplicate_summary", _duplicates("flagged"))
oracle("variant_duplicates", _duplicates("variant_flagged"))
oracle("kept_postings",
       "SELECT job_id, seniority_final, token_count FROM flagged WHERE keep_for_model")
oracle("capped_dedup", "SELECT job_id, seniority FROM capped")

# Corpus

oracle("corpus_stats", f"""
SELECT "group", docs, tokens, vocab_size, {r6('tokens / docs')} AS avg_doc_len,
  {floor_of('docs')} AS min_count,
  CASE WHEN vocab_size < {fv.SMALL_VOCABULARY}
    THEN greatest({floor_of('docs', fv.MIN_COUNT_STEPS_SYNTHETIC)} - 1, 1)
    ELSE {floor_of('docs', fv.MIN_COUNT_STEPS_SYNTHETIC)} END AS min_count_synthetic
FROM sizes JOIN (SELECT "group", count(*) AS vocab_size FROM singles GROUP BY 1)
  USING ("group")""", corpus_ctes("synthetic_docs"))
oracle("vocabulary", 'SELECT "group", word, n FROM vocab', CORE)
oracle("top_words", f"""
SELECT * FROM (SELECT "group", word, n,
    row_number() OVER (PARTITION BY "group" ORDER BY n DESC, word) AS rank
  FROM (SELECT seniority AS "group", unnest({words_of('embedding_text')}) AS word,
      count(*) AS n FROM tech GROUP BY 1, 2)) WHERE rank <= 15""")
oracle("group_profile", f"""
SELECT "group", word, n, row_number() OVER (ORDER BY n DESC, word) AS rank, distinct_words
FROM (SELECT *, count(*) OVER () AS distinct_words
  FROM (SELECT seniority AS "group", unnest({words_of('embedding_text')}) AS word,
      count(*) AS n FROM tech WHERE seniority = 'mid' GROUP BY 1, 2))
ORDER BY n DESC, word LIMIT 30""")
oracle("leakage_check", f"""
SELECT seniority AS "group", word,
  bool_or(list_contains({words_of('embedding_text')}, word)) AS present
FROM capped CROSS JOIN (SELECT unnest({fv.LEAKAGE_WORDS}) AS word) GROUP BY 1, 2""")
_METADATA = """
SELECT "group", seed, documents, docs AS sentences, tokens AS token_count, vocab_size,
  floor AS min_count
FROM sizes JOIN (SELECT "group", count(*) AS vocab_size FROM vocab GROUP BY 1) USING ("group")
  CROSS JOIN (VALUES (7), (17), (29)) AS t(seed)"""
oracle("training_metadata", _METADATA, CORE)
oracle("mean_metadata", f"""
SELECT "group", avg(documents) AS documents, avg(sentences) AS sentences,
  avg(token_count) AS token_count, avg(vocab_size) AS vocab_size, avg(min_count) AS min_count
FROM group_names LEFT JOIN ({_METADATA}) USING ("group") GROUP BY 1""", CORE)

# Vectors

oracle("ppmi_vectors", f'SELECT "group", word, ctx, {r6("weight")} AS weight FROM sparse',
       CORE_PAIRS)
oracle("ppmi_neighbours", f"""
SELECT "group", query, rank, word, {r6('score / query_norm')} AS similarity
FROM (SELECT c."group", q.word AS query, c.word, round(coalesce(dot, 0) / c.norm, 9) AS score,
    q.norm AS query_norm, row_number() OVER (PARTITION BY c."group", q.word
      ORDER BY round(coalesce(dot, 0) / c.norm, 9) DESC, c.word) AS rank
  FROM norms c JOIN norms q ON c."group" = q."group" AND c.word <> q.word
      AND q.word IN {in_list(fv.NEIGHBOUR_WORDS)}
    LEFT JOIN (SELECT a."group", a.word AS query, b.word, sum(a.weight * b.weight) AS dot
      FROM sparse a JOIN sparse b ON a."group" = b."group" AND a.ctx = b.ctx
        AND a.word IN {in_list(fv.NEIGHBOUR_WORDS)} GROUP BY 1, 2, 3) d
      ON d."group" = c."group" AND d.query = q.word AND d.word = c.word)
WHERE rank <= 10""", {**CORE, **pair_ctes(), "norms": """
SELECT "group", word, sqrt(sum(weight * weight)) AS norm FROM sparse GROUP BY 1, 2"""})
CORE_DENSE = {**CORE, **pair_ctes(), **dense_ctes(), "signs": f"""
SELECT seed, ctx, i, CASE WHEN {sign_bit()} = 1 THEN 1 ELSE -1 END AS sign
FROM (SELECT DISTINCT ctx FROM sparse) CROSS JOIN seeds CROSS JOIN coordinates""", "projected": f"""
SELECT "group", seed, word, i, sum(weight * sign) / sqrt({DIMENSIONS}) AS x
FROM sparse JOIN signs USING (ctx) GROUP BY 1, 2, 3, 4"""}
oracle("dense_vectors", f'SELECT "group", seed, word, n, i, {r6("x")} AS x FROM dense',
       {**CORE_PAIRS, **dense_ctes()})
oracle("dense_vocabulary", f"""
SELECT "group", seed, word, n, {r6("sqrt(sum(x * x))")} AS length,
  {r6("sum(x * (i + 1))")} AS moment
FROM dense GROUP BY 1, 2, 3, 4""", CORE_DENSE)


def _grams(source: str, columns: str) -> str:
    return f"""
SELECT DISTINCT {columns}, substr('<' || word || '>', i::INT, g::INT) AS gram
FROM {source} CROSS JOIN (SELECT unnest(range(3, 7)) AS g)
  CROSS JOIN LATERAL (SELECT unnest(range(1, length(word) + 4 - g)) AS i)"""


oracle("subword_ngrams", f"""
SELECT "group", gram, count(*) AS words, CAST(sum(n) AS BIGINT) AS n
FROM ({_grams('vocab', '"group", word, n')}) GROUP BY 1, 2""", CORE)
oracle("subword_vectors", f"""
SELECT "group", seed, word, i, {r6('avg(x)')} AS x FROM (
  SELECT "group", seed, word, i, x FROM dense WHERE word IN {in_list(SPEC_WORDS)}
  UNION ALL
  SELECT g."group", v.seed, g.word, v.i, v.x FROM grams g JOIN gram_vectors v
    ON g."group" = v."group" AND g.gram = v.gram) GROUP BY 1, 2, 3, 4""",
       {**CORE_DENSE,
        "all_grams": _grams("sparse_words", '"group", word'),
        "grams": f"SELECT * FROM all_grams WHERE word IN {in_list(SPEC_WORDS)}",
        "gram_vectors": """
SELECT g."group", d.seed, g.gram, d.i, sum(d.n * d.x) / sum(d.n) AS x
FROM all_grams g JOIN dense d ON g."group" = d."group" AND g.word = d.word
WHERE (g."group", g.gram) IN (SELECT "group", gram FROM grams) GROUP BY 1, 2, 3, 4"""})
# Association tests

_RESULTS = ", ".join(f"{r6(c)} AS {c}" for c in ("effect_size", "test_statistic", "p_value"))
_COVERAGE = ("coverage_targets_a, coverage_targets_b, coverage_attrs_a, coverage_attrs_b")
_SEEDED = f'SELECT "group", seed, test_name, {_COVERAGE}, {_RESULTS} FROM results'
_UNSEEDED = f'SELECT "group", test_name, {_COVERAGE}, {_RESULTS} FROM results'
oracle("weat_exact", _SEEDED, LABEL_WEAT)
oracle("weat_sampled", _SEEDED, LABEL_WEAT_SAMPLED)
oracle("weat_blocks", _SEEDED, LABEL_WEAT_BLOCKS)
oracle("weat_ppmi", _UNSEEDED, CORE_WEAT)
oracle("weat_associations", f"""
SELECT "group", test_name, role, word, {r6('to_a')} AS to_a, {r6('to_b')} AS to_b
FROM to_attributes JOIN models USING (model, test_name)""", CORE_WEAT)
oracle("weat_coverage", f"""
SELECT "group", {_COVERAGE} FROM group_names LEFT JOIN covered USING ("group")""", CORE_WEAT)
oracle("weat_seeds", _SEEDED, DENSE_WEAT)
oracle("weat_summary", f"""
SELECT test_name, "group", {r6('avg(effect_size)')} AS effect_size_mean,
  {r6('stddev_samp(effect_size)')} AS effect_size_std, {r6('avg(p_value)')} AS p_value_mean,
  {', '.join(f'{r6(f"avg({c})")} AS {c}' for c in _COVERAGE.split(', '))}
FROM results GROUP BY 1, 2""", DENSE_WEAT)

_BY_SEED = "SELECT test_name, seed, " + ", ".join(
    f"avg(effect_size) FILTER (\"group\" = '{g}') AS {g}" for g in fv.GROUP_ORDER
) + " FROM results GROUP BY 1, 2"
oracle("weat_trajectories", "SELECT test_name, seed, " + ", ".join(
    f"{r6(g)} AS {g}" for g in fv.GROUP_ORDER) + f" FROM ({_BY_SEED})", LABEL_WEAT)
_MEANS = ", ".join(f"avg({g}) FILTER (whole) AS {g}_mean" for g in fv.GROUP_ORDER)
_MONOTONICITY = ("SELECT test_name, seed_runs, " + ", ".join(
    f"{r6(f'{g}_mean')} AS {g}_mean" for g in fv.GROUP_ORDER) + f"""
  , {r6('seed_order_rate')} AS seed_order_rate, mean_order_holds,
  CASE WHEN seed_runs = 0 THEN 'insufficient_seed_coverage'
    WHEN mean_order_holds AND seed_order_rate = 1 THEN 'supported'
    WHEN mean_order_holds THEN 'partially_supported' ELSE 'not_supported' END AS interpretation
FROM (SELECT *, coalesce(entry_mean < mid_mean AND mid_mean < senior_mean
    AND senior_mean < leadership_mean, false) AS mean_order_holds
  FROM (SELECT test_name, count(CASE WHEN whole THEN 1 END) AS seed_runs, {_MEANS},
      avg(CASE WHEN entry < mid AND mid < senior AND senior < leadership THEN 1.0 ELSE 0 END)
        FILTER (whole) AS seed_order_rate
    FROM (SELECT *, entry + mid + senior + leadership IS NOT NULL AS whole FROM ({_BY_SEED}))
    GROUP BY 1))""")
oracle("weat_monotonicity", _MONOTONICITY, LABEL_WEAT)
oracle("weat_text_monotonicity", _MONOTONICITY, DENSE_WEAT)
oracle("weat_interpretation", f"""
SELECT *, CASE WHEN effect_size IS NULL OR p_value IS NULL
    THEN 'Insufficient vocabulary coverage.'
  ELSE concat(CASE WHEN effect_size > 0 THEN 'male-career association'
      WHEN effect_size < 0 THEN 'female-career association'
      ELSE 'no directional association' END, '; ',
    CASE WHEN p_value < 0.05 THEN 'statistically significant'
      ELSE 'not statistically significant' END) END AS interpretation
FROM ({_UNSEEDED})""", SYNTHETIC_WEAT)
oracle("weat_variant_compare", f"""
SELECT g."group", {r6("max(effect_size) FILTER (variant = 'main')")} AS main,
  {r6("max(effect_size) FILTER (variant = 'labeled_only')")} AS labeled_only
FROM group_names g LEFT JOIN (SELECT split_part("group", '|', 1) AS variant,
    split_part("group", '|', 2) AS "group", effect_size FROM results) r
  ON r."group" = g."group" GROUP BY 1""", VARIANT_WEAT)

# Lexicons and variants

_BIAS = ("CAST(sum(masculine_count) AS BIGINT) AS masculine_count, "
         "CAST(sum(feminine_count) AS BIGINT) AS feminine_count, "
         "CAST(sum(token_total) AS BIGINT) AS token_total")
_RATED = (f"{r6(per_1000('masculine_count'))} AS masculine_per_1000, "
          f"{r6(per_1000('feminine_count'))} AS feminine_per_1000, "
          f"{r6(per_1000('(masculine_count - feminine_count)'))} AS bias_score")
_CORE_COUNTS = f"""
SELECT seniority_final AS "group", seniority_source, keep_for_model,
  {listed('tokens', fv.MASCULINE_CODED_WORDS)} AS masculine_count,
  {listed('tokens', fv.FEMININE_CODED_WORDS)} AS feminine_count, len(tokens) AS token_total
FROM (SELECT *, {words_of('model_text')} AS tokens FROM flagged)"""
oracle("lexicon_bias", f"""
SELECT *, {_RATED} FROM (SELECT "group", {_BIAS} FROM ({_CORE_COUNTS}) WHERE keep_for_model
  GROUP BY 1)""")
oracle("lexicon_variants", f"""
SELECT *, {_RATED} FROM (
  SELECT 'nondedup' AS variant, "group", {_BIAS} FROM counts GROUP BY 2
  UNION ALL SELECT 'labeled_plus_backfilled', "group", {_BIAS} FROM counts
    WHERE keep_for_model GROUP BY 2
  UNION ALL SELECT 'labeled_only', "group", {_BIAS} FROM counts
    WHERE keep_for_model AND seniority_source = 'linkedin_primary' GROUP BY 2)""",
       {"counts": _CORE_COUNTS})
oracle("lexicon_bias_synthetic", f"""
SELECT *, {_RATED} FROM (SELECT seniority AS "group", {_BIAS} FROM (
  SELECT seniority, {listed('tokens', fv.MASCULINE_CODED_WORDS_LONG)} AS masculine_count,
    {listed('tokens', fv.FEMININE_CODED_WORDS_LONG)} AS feminine_count,
    len(tokens) AS token_total
  FROM (SELECT seniority, regexp_extract_all(embedding_text, '{fv.LETTER_TOKEN_PATTERN}')
    AS tokens FROM tech)) GROUP BY 1)""")
oracle("scope_benchmark", """
SELECT 'broad_tech_company_rows' AS metric, count(CASE WHEN is_broad_tech_company THEN 1 END) AS value FROM scoped
UNION ALL SELECT 'digital_tech_rows', count(CASE WHEN scope_include THEN 1 END) FROM scoped""")

#: Statements that hold every coordinate of a whole vocabulary at once: for small tables alone.
SMALL_ORACLES = {name: ORACLES.pop(name) for name in ("dense_vocabulary", "subword_vectors")}
