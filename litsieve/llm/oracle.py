"""The same results in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from litsieve.llm.mixing import _STEPS
from litsieve.llm.secret_ledger import BASE, RULES, Rule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _lowered(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    return f"regexp_extract_all({_lowered(f'coalesce({text}, chr(32))')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE: dict[str, str] = {}
ORACLE["op1_decontaminate"] = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS line
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, {_words('text')} AS w FROM documents),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS line
  FROM docs, (SELECT DISTINCT size FROM windows) AS s, unnest(range(1, len(w) - size + 2)) AS t(i)),
hits AS (SELECT doc_id, i, p.size, item FROM places AS p JOIN windows AS v ON p.line = v.line AND p.size = v.size),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + size)) AS t(k) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

ORACLE["op2_line_dedup"] = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, i, lines[i] AS line, {_lowered(f'trim(lines[i], {_SPACES})')} AS key
  FROM split, unnest(range(1, len(lines) + 1)) AS t(i)),
firsts AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT l.*, length(l.key) < 10 OR f.first = l.doc_id AS kept FROM lines AS l LEFT JOIN firsts AS f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) - count(*) FILTER (WHERE kept) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

ORACLE["op3_exact_dedup"] = """
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS own
  FROM documents),
marked AS (
  SELECT doc_id, own, first_value(doc_id) OVER (PARTITION BY own ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY own) AS group_size
  FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(own) AS text_sha256 FROM marked"""

ORACLE["op5_mix"] = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS most
  FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
targets AS (
  SELECT source, source_size, least(most, coalesce((max(level) FILTER (WHERE level <= most / weight) OVER ()) * weight, most)) AS target,
         ('0x' || substr(md5(coalesce('mix:' || source, 'mix-')), 1, 4))::INT / {float(_STEPS)}::DOUBLE AS u
  FROM levels),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS r FROM sized)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * CASE WHEN source_size > 0 THEN floor(u + target / source_size * (r + 1)) - floor(u + target / source_size * r)
                        ELSE 0 END AS BIGINT) AS taken
FROM ranked AS d JOIN targets AS t ON d.source IS NOT DISTINCT FROM t.source"""


def _spans(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{rule.name}' AS kind, {rank} AS rank, b AS start, b + length(found[i]) AS stop
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {rule.group}) AS value,
               string_split_regex(text, '{pattern}') AS gaps FROM docs) AS m, unnest(range(1, len(found) + 1)) AS t(i),
       LATERAL (SELECT list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                       + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS b) AS p
  WHERE length(value[i]) >= {rule.least}"""


_BASE = ", ".join(f"'{r.name}'" for r in BASE)
ORACLE["op10_secret_ledger"] = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({' UNION ALL '.join(_spans(r, i) for i, r in enumerate(RULES))}),
found AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{r.name}') AS n_{r.name}" for r in BASE)},
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank)
           FILTER (WHERE kind IN ({_BASE})) AS base
  FROM spans GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (doc_id)"""

ORACLE["op11_collocations"] = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex({_lowered("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM split, unnest(range(1, 5)) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(i)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM places GROUP BY lang, m, phrase HAVING count(*) >= 30),
long_ones AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
cuts AS (
  SELECT s.lang, s.phrase, s.f AS a, k, x.f AS l, y.f AS r, CAST(s.f::HUGEINT * 2000000 // (x.f + y.f) AS BIGINT) AS score
  FROM long_ones AS s, unnest(range(1, s.m)) AS t(k)
  JOIN counts AS x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:k], ' ')
  JOIN counts AS y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[k + 1:s.m], ' ')),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nr FROM cuts),
inside AS (
  SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(f) AS most
  FROM long_ones, unnest(range(2, m)) AS s(z), unnest(range(1, m - z + 2)) AS t(i) GROUP BY ALL),
kept AS (
  SELECT v.* FROM worst AS v LEFT JOIN inside AS i ON v.lang = i.lang AND v.phrase = i.phrase
  WHERE nr = 1 AND NOT coalesce(100::HUGEINT * most >= 80::HUGEINT * a, FALSE)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: CRC-32 by its shift register, a byte of the decimal id at a time.
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
  lambda r, c: list_reduce(list_prepend(xor(r, c), list_transform(range(8), lambda b: 0::UBIGINT)),
    lambda v, b: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))"""

ORACLE["op13_merkle"] = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, source, {_leaf('text')} AS leaf,
               CASE WHEN xor({_CRC}, 4294967295::UBIGINT) % 5 = 0 THEN {_leaf(_lowered('text'))} ELSE {_leaf('text')} END AS given
        FROM documents) AS d),
-- a group's tree from its leaves upward, then the tree over the groups
nodes AS (
  SELECT source, 0 AS level, pos, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM nodes) AS x WHERE n > 1 GROUP BY source, level, pos // 16),
subroots AS (
  SELECT source, max(level) AS height, arg_max(digest, level) AS subroot FROM nodes GROUP BY source),
groups AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place FROM subroots),
upper AS (
  SELECT 0 AS level, place AS pos, subroot AS digest FROM groups
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM upper) AS x WHERE n > 1 GROUP BY level, pos // 16),
peak AS (SELECT max(level) AS height, arg_max(digest, level) AS root FROM upper),
sides AS (
  SELECT a.source, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM nodes AS a JOIN nodes AS b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.pos // 16 = b.pos // 16
  GROUP BY a.source, a.level, a.pos),
upper_sides AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM upper AS a JOIN upper AS b ON a.level = b.level AND a.pos // 16 = b.pos // 16 GROUP BY a.level, a.pos),
walk AS (
  SELECT doc_id, leaf, l.source, height, place, subroot, 0 AS level, pos, '' AS siblings, given AS folded
  FROM leaves AS l JOIN groups AS g ON l.source IS NOT DISTINCT FROM g.source
  UNION ALL
  SELECT doc_id, leaf, w.source, height, place, subroot, w.level + 1, w.pos // 16, siblings || before || after, sha256(before || folded || after)
  FROM walk AS w JOIN sides AS s ON w.source IS NOT DISTINCT FROM s.source AND w.level = s.level AND w.pos = s.pos
  WHERE w.level < w.height),
climb AS (
  SELECT doc_id, leaf, subroot, place AS pos, 0 AS level, siblings, folded FROM walk WHERE level = height
  UNION ALL
  SELECT doc_id, leaf, subroot, c.pos // 16, c.level + 1, siblings || before || after, sha256(before || folded || after)
  FROM climb AS c JOIN upper_sides AS s ON c.level = s.level AND c.pos = s.pos WHERE c.level < (SELECT height FROM peak))
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM climb, peak WHERE level = height"""
