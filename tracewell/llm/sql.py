"""DuckDB SQL with the results of the queries that SQL can express, on the same tables."""

from __future__ import annotations

from tracewell.llm.chat_format import CONTROLS, MARKS
from tracewell.llm.license_scan import TEMPLATES, WINDOW
from tracewell.llm.url_filter import DOUBLE_SUFFIXES

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def line_dedup(table: str = "documents", min_docs: int = 3, min_chars: int = 20) -> str:
    """Common table expressions ending in ``marked`` (doc_id, p, line, gone)."""
    return f"""
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p
  FROM {table}),
keyed AS (SELECT *, translate(trim(line, {BLANKS}), {UPPER}, {LOWER}) AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
marked AS (
  SELECT keyed.doc_id, p, line, common.key IS NOT NULL AND keyed.doc_id <> last AS gone FROM keyed LEFT JOIN common USING (key))"""


OP1 = f"""
WITH {line_dedup()}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def _rule(verdict: str, rule: str) -> str:
    host, _, rest = rule.partition("/")
    return f"({quoted(verdict)}, {quoted(rule)}, {quoted(host)}, {quoted('/' + rest)})"


def url_filter(rules: list[tuple[str, str]], z: float = 1.645, most_bad: float = 0.3) -> str:
    def weight(name: str, groups: str) -> str:
        return f"""{name}_rho AS (
  SELECT CASE WHEN sum(n) - count(*) > 0 THEN (sum(n * (y / n - prior) * (y / n - prior) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)) ELSE 0 END AS r
  FROM {groups} WHERE n > 0),
{name}_weight AS (SELECT (1 - rho) / rho AS k FROM (SELECT least(greatest(r, 1 / 1001.0), 1 / 3.0) AS rho FROM {name}_rho))"""

    pattern = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    doubles = ", ".join(map(quoted, DOUBLE_SUFFIXES))
    return f"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), {pattern}, 1), {UPPER}, {LOWER}) AS host, regexp_extract(coalesce(url, ''), {pattern}, 2) AS path FROM pages),
outcome AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
counted AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS y FROM parsed LEFT JOIN outcome USING (page_id) GROUP BY host),
labelled AS (SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM counted),
named AS (SELECT *, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS two, array_to_string(l[greatest(len(l) - 2, 1):], '.') AS three FROM labelled),
hosts AS (SELECT host, n, y, CASE WHEN two IN ({doubles}) THEN three ELSE two END AS domain, CASE WHEN two IN ({doubles}) THEN two ELSE l[-1] END AS suffix FROM named),
whole AS (SELECT (coalesce(sum(y), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS m FROM hosts),
suffixes AS (SELECT suffix, sum(n) AS n, sum(y) AS y, any_value(m) AS prior FROM hosts, whole GROUP BY suffix),
{weight("s", "suffixes")},
suffix_means AS (SELECT suffix, (y + k * prior) / (n + k) AS prior FROM suffixes, s_weight),
domains AS (SELECT domain, sum(n) AS n, sum(y) AS y, any_value(prior) AS prior FROM hosts JOIN suffix_means USING (suffix) GROUP BY domain),
{weight("d", "domains")},
domain_means AS (SELECT domain, (y + k * prior) / (n + k) AS prior FROM domains, d_weight),
host_priors AS (SELECT host, n, y, prior FROM hosts JOIN domain_means USING (domain)),
{weight("h", "host_priors")},
posterior AS (SELECT host, (y + k * prior) / (n + k) AS mean, n + k AS w FROM host_priors, h_weight),
own AS (SELECT host, CASE WHEN mean - {z} * sqrt(mean * (1 - mean) / (w + 1)) > {most_bad} THEN 'block' ELSE 'allow' END AS own FROM posterior),
rules (verdict, rule, rule_host, rule_path) AS (VALUES {", ".join(_rule(*r) for r in rules)}),
fitting AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, own) AS verdict FROM parsed JOIN own USING (host) LEFT JOIN fitting USING (host, path)"""


def decontaminate(table: str = "documents", size: int = 10) -> str:
    """Common table expressions ending in ``report`` (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {ALNUM})"
    return f"""
doc_words AS (SELECT doc_id, {words} AS w FROM {table}),
item_words AS (SELECT item_id, w, least(len(w), {size}) AS l FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS said FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM item_words)),
doc_windows AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS said
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM doc_words, (SELECT DISTINCT l FROM item_words))),
found AS (SELECT doc_id, i, l, item_id FROM doc_windows JOIN item_windows USING (l, said)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id),
report AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id))"""


OP5 = f"WITH {decontaminate()}\nSELECT * FROM report"


def jaccard_components(table: str = "documents") -> str:
    """Recursive common table expressions ending in ``grouped`` (doc_id, n_shingles, component_id)."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\\x20\\x09-\\x0D]+')"
    return f"""
sh_words AS (SELECT doc_id, {words} AS w FROM {table}),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM sh_words WHERE len(w) > 0)),
set_sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN set_sizes x ON x.doc_id = a JOIN set_sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach (a, b) AS (SELECT doc_id, doc_id FROM {table} UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
grouped AS (
  SELECT sh_words.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach.b) AS component_id
  FROM sh_words LEFT JOIN set_sizes USING (doc_id) JOIN reach ON reach.a = sh_words.doc_id GROUP BY sh_words.doc_id)"""


def chat_format(budget: int = 1024, history_turns: int = 2, history_tokens: int = 192) -> str:
    def escaped(x: str) -> str:
        out = f"replace({x}, chr(92), chr(92) || chr(92))"
        for control in CONTROLS:
            out = f"replace({out}, {quoted(control)}, {quoted(control[0])} || chr(92) || {quoted(control[1:])})"
        return out

    past = "\n".join(
        f"""UNION ALL SELECT a.c, b.chars FROM starts a JOIN numbered b ON a.c = b.c AND b.pos = a.pos - {k} AND a.before - b.before <= {history_tokens} AND (b.pos > 1 OR a.sys_chars IS NULL)"""
        for k in range(1, history_turns + 1)
    )
    return rf"""
WITH turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \x09-\x0D]')) + {MARKS} AS tok,
    length('<|' || {escaped("role")} || '|>' || chr(10) || {escaped("text")} || '<|end|>' || chr(10)) AS chars FROM turns),
numbered AS (
  SELECT *, row_number() OVER o AS pos, coalesce(sum(tok) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    first(CASE WHEN role = 'system' THEN tok END) OVER o AS sys_tok, first(CASE WHEN role = 'system' THEN chars END) OVER o AS sys_chars
  FROM sized WINDOW o AS (PARTITION BY c ORDER BY turn, role, text)),
strides AS (SELECT *, greatest(1, ({budget} - coalesce(sys_tok, 0) - {history_tokens}) // 2) AS stride FROM numbered),
placed AS (SELECT *, 2 * (before // stride) + (tok > stride)::INT AS win FROM strides),
starts AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY c, win ORDER BY pos) = 1),
parts AS (
  SELECT c, chars FROM placed UNION ALL SELECT c, sys_chars FROM starts WHERE pos > 1 AND sys_chars IS NOT NULL
  {past}),
total AS (SELECT c, sum(chars)::BIGINT AS formatted_chars FROM parts GROUP BY c),
said AS (
  SELECT c, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
  FROM numbered GROUP BY c)
SELECT c AS conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM said JOIN total USING (c)"""


def license_scan(least: float = 0.8) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {ALNUM})"
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH templates (t, license, text) AS (VALUES {values}),
template_words AS (SELECT t, license, {words} AS w FROM templates),
template_shingles AS (SELECT DISTINCT t, license, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM template_words)),
sizes AS (SELECT t, count(*) AS n FROM template_shingles GROUP BY t),
doc_words AS (SELECT doc_id, {words} AS w FROM documents),
doc_shingles AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM doc_words WHERE len(w) > 0)),
found AS (SELECT doc_id, i, s, license, t, n FROM doc_shingles JOIN template_shingles USING (s) JOIN sizes USING (t)),
shares AS (
  SELECT a.doc_id, a.license, a.t, a.i, count(DISTINCT b.s) / any_value(a.n) AS share
  FROM found a JOIN found b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i >= a.i - a.n - {WINDOW} AND b.i < a.i + a.n + {WINDOW} GROUP BY a.doc_id, a.license, a.t, a.i)
SELECT doc_id, license, round(max(share), 6) AS containment FROM shares WHERE share >= {least} GROUP BY doc_id, license"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    bit = "lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}))"


def conversation_repair() -> str:
    """A turn at a time for all conversations: of each state the least (cost, edits)."""
    kind = crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {kind} % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, rtrim(text, {BLANKS}) AS solid,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS init FROM damaged),
told AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(init) OVER (PARTITION BY conv_id ORDER BY pos) || init AS neighbours FROM placed),
steps(a, role, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserted(a, b, cost, edits) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')),
states(a) AS (VALUES (0), (1), (2), (3)),
moves AS (
  SELECT conv_id, pos, a, b, 'K' AS edit, (fault = 'truncated')::BIGINT AS cost FROM told JOIN steps ON init = steps.role WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, pos, a, b, 'R', 2 + (fault = 'truncated')::BIGINT FROM told, steps WHERE fault IN ('', 'truncated') AND steps.role <> 's'
  UNION ALL SELECT conv_id, pos, a, a, 'D', 3 FROM told, states),
walk(conv_id, pos, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'edits': ''}} FROM damaged
  UNION ALL
  SELECT w.conv_id, w.pos + 1, m.b, min({{'cost': w.best.cost + i.cost + m.cost, 'edits': w.best.edits || i.edits || m.edit}})
  FROM walk w JOIN inserted i ON i.a = w.state JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos + 1 AND m.a = i.b
  GROUP BY w.conv_id, w.pos, m.b),
lengths AS (SELECT conv_id, max(pos) AS n FROM told GROUP BY conv_id),
ended AS (
  SELECT w.conv_id, min({{'cost': w.best.cost + i.cost, 'edits': w.best.edits || i.edits}}) AS best
  FROM walk w JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.pos JOIN inserted i ON i.a = w.state WHERE i.b IN (0, 3) GROUP BY w.conv_id),
letters AS (SELECT conv_id, unnest(string_split(best.edits, '')) AS edit, generate_subscripts(string_split(best.edits, ''), 1) AS k FROM ended WHERE best.edits <> ''),
placed_letters AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS pos, count(*) FILTER (WHERE edit <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS nth FROM letters),
met AS (
  SELECT p.*, t.role, t.text, max((nth = 1 AND edit = 'K' AND t.init = 's')::BIGINT) OVER (PARTITION BY p.conv_id) AS headed
  FROM placed_letters p LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.pos = p.pos AND p.edit <> 'I' WHERE edit <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha
  FROM met GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE neighbours NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost, coalesce(e.best.edits, '') AS audit, coalesce(r.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""


def lm_scoring(prior: float = 100.0) -> str:
    """The bigram model by its definition, a logarithm for each token."""
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {crc32("coalesce(doc_id::VARCHAR, '')")} % 7 = 2 AS held_out, translate(coalesce(text, ''), {UPPER}, {LOWER}) AS text FROM documents),
listed AS (SELECT r, held_out, list_append(regexp_extract_all(text, '[^ \\t-\\r]+'), chr(10)) AS l FROM texts),
tokens AS (SELECT r, held_out, unnest(l) AS w, unnest(list_prepend(chr(9), l[:-2])) AS h FROM listed),
words AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
totals AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM words),
contexts AS (SELECT h, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY h),
pairs AS (SELECT h, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY h, w),
told AS (
  SELECT t.r, coalesce(words.c, 0) AS c, (coalesce(words.c, 0) + 1) / (n + v + 1) AS p, contexts.c AS context, coalesce(pairs.c, 0) AS pair
  FROM tokens t CROSS JOIN totals LEFT JOIN words USING (w) LEFT JOIN contexts USING (h) LEFT JOIN pairs ON pairs.h = t.h AND pairs.w = t.w),
sums AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, sum(log10(p)) AS base_score,
    sum(CASE WHEN context IS NULL THEN log10(p) ELSE log10((pair + {prior} * p) / (context + {prior})) END) AS score FROM told GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM texts JOIN sums USING (r), totals"""
