"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .licenses import SHINGLE, TEMPLATES, need, plain
from .mixing import MIX_WEIGHTS, MOST, OTHERS
from .quality import RULES, STOP_WORDS
from .substring import WINDOW

_SPACE = r"[\x20\x09-\x0D]+"


def _op5() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    tests = []
    for r in RULES:
        bad = " OR ".join([f"{r.measure} < {r.least}"] * (r.least is not None) + [f"{r.measure} > {r.most}"] * (r.most is not None))
        tests.append(f"CASE WHEN ({bad}) AND n_words >= {r.min_words} THEN '{r.name}' END")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{_SPACE}', '', 'g')) > 0) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS c FROM dup, range(0, 8) AS r(o) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.c, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(words, lambda x: rtrim(lower(x), '.,;:!?') IN ({stop}))) AS n_stop, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09]*$'))) AS n_ellipsis
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
r AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
  CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio, CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_ratio,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio, CASE WHEN n_lines > 0 THEN n_bullet / n_lines ELSE 0 END AS bullet_line_ratio,
  CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0 END AS ellipsis_line_ratio FROM m),
f AS (SELECT *, list_filter([{", ".join(tests)}], lambda x: x IS NOT NULL) AS failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept,
  array_to_string(failed, ',') AS failed_rules FROM f"""


def _op6(depth: int = 15) -> str:
    """A line goes if an equal one stands earlier; blank lines go between two that an equal pair precedes. Blocks of 2^k
    lines, for k up to `depth`, beyond any document's here, are ranked by the ranks of their halves."""
    levels = ["b0 AS MATERIALIZED (SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS source FROM (SELECT *, dense_rank() OVER (ORDER BY line) AS r FROM ln) WINDOW w AS (PARTITION BY r ORDER BY doc_id, i))"]
    for k in range(1, depth + 1):
        pairs = f"SELECT x.doc_id, x.i, dense_rank() OVER (ORDER BY x.r, y.r) AS r FROM b{k - 1} x JOIN b{k - 1} y ON y.doc_id = x.doc_id AND y.i = x.i + {1 << k - 1}"
        levels.append(f"b{k} AS MATERIALIZED (SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS source FROM ({pairs}) WINDOW w AS (PARTITION BY r ORDER BY doc_id, i))")
    deep = " UNION ALL ".join(f"SELECT doc_id, i, {1 << k} AS lines, source FROM b{k} WHERE nth > 1" for k in range(depth + 1))
    return rf"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln_no FROM documents),
ln AS (SELECT doc_id, line, ln_no, row_number() OVER (PARTITION BY doc_id ORDER BY ln_no) AS i FROM raw WHERE regexp_matches(line, '[^ 	-
]')),
{", ".join(levels)},
cut AS (SELECT doc_id, ln_no FROM b0 WHERE nth > 1 UNION
  SELECT p.doc_id, raw.ln_no FROM b1 p JOIN ln x ON x.doc_id = p.doc_id AND x.i = p.i JOIN ln y ON y.doc_id = p.doc_id AND y.i = p.i + 1 JOIN raw ON raw.doc_id = p.doc_id AND raw.ln_no > x.ln_no AND raw.ln_no < y.ln_no WHERE p.nth > 1),
isl AS (SELECT doc_id, min(ln_no) AS a, max(ln_no) AS b FROM (SELECT doc_id, ln_no, ln_no - row_number() OVER (PARTITION BY doc_id ORDER BY ln_no) AS g FROM cut) GROUP BY doc_id, g),
rn AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_runs, sum(b - a + 1) AS n FROM isl GROUP BY doc_id),
dp AS (SELECT doc_id, max(lines) AS longest_block, arg_max(source, lines * 1000000 - i) AS source_doc FROM ({deep}) GROUP BY doc_id),
kp AS (SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY raw.ln_no) AS body FROM raw ANTI JOIN cut ON cut.doc_id = raw.doc_id AND cut.ln_no = raw.ln_no GROUP BY raw.doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(rn.n, 0) AS BIGINT) AS n_removed,
  coalesce(rn.removed_runs, '') AS removed_runs, CAST(coalesce(dp.longest_block, 0) AS BIGINT) AS longest_block, dp.source_doc, sha256(coalesce(kp.body, '')) AS kept_sha256
FROM documents d LEFT JOIN rn ON rn.doc_id = d.doc_id LEFT JOIN dp ON dp.doc_id = d.doc_id LEFT JOIN kp ON kp.doc_id = d.doc_id"""


def _op3(window: int = WINDOW) -> str:
    """Every window of every document as text; all but the first of equal ones delete their words."""
    return rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + {window - 1}], ' ') AS body FROM (SELECT doc_id, words, unnest(range(1, len(words) - {window - 2})) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM later, range(0, {window}) AS t(o)),
pos AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
kept AS (SELECT pos.doc_id, count(gone.p) AS n, string_agg(word, ' ' ORDER BY pos.p) FILTER (gone.p IS NULL) AS body FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


def _op7() -> str:
    """All windows of all documents against all templates, by an inverted list of exact shingles."""
    rows = []
    for name, text in TEMPLATES.items():
        words = [w for w in map(plain, text.encode().split()) if w]
        width = min(SHINGLE, len(words))
        shingles = {b" ".join(words[i : i + width]).decode() for i in range(len(words) - width + 1)}
        stride = 1 << (len(shingles) - 1).bit_length()
        rows += [f"('{name}', {width}, {stride}, {len(shingles)}, {need(len(shingles))}, '{s}')" for s in sorted(shingles)]
    return rf"""
WITH t(license, width, stride, total, need, shingle) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: lower(regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'))), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, width, pos, array_to_string(words[pos + 1:pos + width], ' ') AS shingle FROM (SELECT doc_id, words, width, unnest(range(0, len(words) - width + 1)) AS pos FROM w, (SELECT DISTINCT width FROM t))),
h AS (SELECT doc_id, license, t.width, stride, total, need, pos, s.shingle FROM s JOIN t ON t.shingle = s.shingle AND t.width = s.width),
i AS (SELECT *, pos // stride AS win FROM h UNION ALL SELECT *, pos // stride - 1 FROM h WHERE pos >= stride),
c AS (SELECT doc_id, license, win, total, width, count(DISTINCT shingle) AS matched, min(pos) AS a, max(pos) AS b FROM i GROUP BY doc_id, license, win, total, width, need HAVING count(DISTINCT shingle) >= need),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY matched DESC, win) AS r, count(*) OVER (PARTITION BY doc_id, license) AS windows FROM c)
SELECT doc_id, license, matched, CAST(total AS BIGINT) AS total, CAST(a AS BIGINT) AS first_word, CAST(b + width - 1 AS BIGINT) AS last_word, windows FROM r WHERE r = 1"""


def mixing_sql(weights: dict[str, float], others: float, docs: str = "documents") -> str:
    """copies(doc_id, copy, mix_key, ...) of the rows of `docs`; one WITH body."""
    given = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in sorted(weights.items()))
    return f"""
mix_weighed AS (SELECT source, count(*) AS n, coalesce(any_value(g.w), {others}) AS w FROM {docs} LEFT JOIN (VALUES {given}) g(s, w) ON g.s = source GROUP BY source),
mix_rates AS (SELECT source, w / (SELECT sum(w) FROM mix_weighed) * (SELECT sum(n) FROM mix_weighed) * 1.0 / n AS rate FROM mix_weighed),
mix_split AS (SELECT source, CAST(greatest(ceil(rate / {MOST}), 1) AS INT) AS draws, rate / greatest(ceil(rate / {MOST}), 1) AS mean FROM mix_rates),
mix_cdf AS (SELECT source, draws, list_sum([exp(-mean) * list_product(list_prepend(1.0, list_transform(range(1, k + 1), lambda j: mean / j)))]) AS p, k
  FROM mix_split, range(0, 1800) AS r(k) WHERE k <= ceil(mean + 12 * sqrt(mean) + 20)),
mix_cum AS (SELECT source, draws, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM mix_cdf),
mix_table AS (SELECT source, any_value(draws) AS draws, list(c) AS cdf FROM mix_cum GROUP BY source),
mix_draw AS (SELECT d.*, CAST(list_sum(list_transform(range(1, t.draws + 1), lambda j: len(list_filter(cdf, lambda c: c <= CAST(('0x' || substr(md5('0:' || CASE WHEN t.draws = 1 THEN '' ELSE j || ':' END || d.doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0)))) AS BIGINT) AS times FROM {docs} d JOIN mix_table t ON t.source IS NOT DISTINCT FROM d.source),
copies AS (SELECT *, substr(md5('shuffle:0:' || doc_id || ':' || copy), 1, 15) AS mix_key FROM (SELECT *, unnest(range(0, times)) AS copy FROM mix_draw))"""


SQL: dict[str, str] = {
    "op1_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20""",
    "op3_substring_dedup": _op3(),
    "op6_line_dedup": _op6(),
    "op7_licenses": _op7(),
    "op10_mixing": f"WITH {mixing_sql(MIX_WEIGHTS, OTHERS).strip()} SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy, mix_key FROM copies",
    "op5_quality_rules": _op5(),
}
