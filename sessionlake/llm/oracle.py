"""The same results in DuckDB SQL, where SQL can express the operator."""

from __future__ import annotations

from sessionlake.llm.mixing import MOST_COPIES, SEED, SHARE, WEIGHTS
from sessionlake.llm.quality import RULES, STOP_WORDS

#: White space of word splitting, for string functions and for patterns.
_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _rules() -> str:
    parts = []
    for _, part, whole, least, most in RULES:
        of = "1" if whole == "one" else whole
        parts += [f"1000 * {part} >= {least} * {of}"] if least is not None else []
        parts += [f"1000 * {part} <= {most} * {of}"] if most is not None else []
    return " AND ".join(parts)


_QUALITY = rf"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_WS}) <> '') AS lines,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
    len(coalesce(text, '')) - len(replace(coalesce(text, ''), '!', '')) AS n_exclaims
  FROM documents
), t AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM t
), p AS (
  SELECT doc_id, least(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3), 3) AS c FROM g WHERE n > 1
), r AS (
  SELECT doc_id, sum(c)::BIGINT AS n_repeat_words FROM p GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, n_exclaims,
    len(list_intersect(w, [{", ".join(f"'{x}'" for x in STOP_WORDS)}])) AS n_stop_words
  FROM d LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_rules()} AS kept
FROM f
"""

_MIX = f"""
WITH d AS (
  SELECT doc_id, len({_WORDS})::BIGINT AS size, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS src
  FROM documents
), s AS (
  SELECT src, sum(size)::BIGINT AS source_size,
    [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][(row_number() OVER (ORDER BY src = '', src) - 1) % {len(WEIGHTS)} + 1] AS w
  FROM d GROUP BY src
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, src) AS k,
    coalesce(sum({MOST_COPIES} * source_size) OVER (ORDER BY source_size / w, src
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(w) OVER (ORDER BY source_size / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    {SHARE} * (sum(source_size) OVER ())::DOUBLE AS total
  FROM s
), l AS (
  SELECT first(((total - stopped) / rest)::DOUBLE ORDER BY k) AS level FROM o
  WHERE {MOST_COPIES} * source_size > w * (total - stopped) / rest
), t AS (
  SELECT src, source_size, least({MOST_COPIES} * source_size::DOUBLE, w * level) AS target,
    ('0x' || substr(md5('{SEED}' || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM s, l
), e AS (
  SELECT doc_id, size, source_size, target, u,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e,
    row_number() OVER (PARTITION BY src ORDER BY size, doc_id) AS place
  FROM d JOIN t USING (src)
)
SELECT doc_id, size, source_size, target,
  ((floor(u + e * place) - floor(u + e * (place - 1))) * size)::BIGINT AS taken
FROM e
"""

_SQUARE = r"/?(?:SYS|INST|ANS|ROLE)|NEXT|:"
_ESCAPED = rf"regexp_replace(regexp_replace({{0}}, '\[(\\*)({_SQUARE})\]', '[\\\1\2]', 'g'), '<(\\*)(/?s)>', '<\\\1\2>', 'g')"
_MARKS = "CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE {named} END"

_CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS goes_on,
    {_ESCAPED.format("text")} AS body, {_ESCAPED.format("role")} AS name
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(len(body) + CASE WHEN goes_on THEN 6 ELSE {_MARKS.format(named="len(name) + 16")} END))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


#: The CRC-32 of a text, for tables joined with `crc`.
_CRC_TABLE = """SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps"""
_BYTES = """flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
    ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END))"""
_CRC = f"""xor(list_reduce(list_prepend(4294967295, {_BYTES}),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"""

_SPELLING = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents
), hashed AS (
  SELECT w, {_CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM runs, crc
), kept AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % len(w))::INT) || substr(w, (h % len(w))::INT + 2) ELSE w END AS word
  FROM hashed
), words AS (
  SELECT word, count(*) AS n FROM kept WHERE len(word) >= 7 GROUP BY word HAVING count(*) >= 2
), places AS (
  SELECT word, n, unnest(range(len(word))) AS i FROM words
), less AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM places
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS other_n
  FROM pairs GROUP BY word
), found AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN other_n >= 10 * words.n THEN other END AS form, CASE WHEN other_n >= 10 * words.n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain(word, last) AS (
  SELECT word, form FROM found WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, found.form FROM chain JOIN found ON found.word = chain.last WHERE found.form IS NOT NULL
), roots AS (
  SELECT chain.word, chain.last AS root FROM chain JOIN found ON found.word = chain.last WHERE found.form IS NULL
)
SELECT word, n, n_near, form, form_n, coalesce(root, word) AS root FROM found LEFT JOIN roots USING (word)
"""

#: Levels of the trees in SQL: enough for a million documents in a language.
_LEVELS = 20


def _told(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"


def _tree(name: str, leaves: str) -> str:
    """CTEs of a tree's levels from rows (t, pos, h), {name}_nodes (t, level, pos, h) and {name}_roots (t, h)."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT t, pos, h, count(*) OVER (PARTITION BY t) AS n FROM {leaves})"]
    for i in range(_LEVELS):
        parts.append(f"""{name}{i + 1} AS MATERIALIZED (SELECT t, pos // 2 AS pos,
      CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY {name}{i}.pos)) ELSE first(h) END AS h, (n + 1) // 2 AS n
    FROM {name}{i} GROUP BY t, pos // 2, n)""")
    levels = " UNION ALL ".join(f"SELECT t, {i} AS level, pos, h FROM {name}{i} WHERE n > 1" for i in range(_LEVELS))
    return ",\n  ".join([*parts, f"{name}_nodes AS MATERIALIZED ({levels})", f"{name}_roots AS (SELECT t, h FROM {name}{_LEVELS})"])


def _steps(name: str, leaves: str) -> str:
    """A CTE {name}_steps (t, pos, level, side): what stands beside each leaf's node, `R` or `L` before its digest."""
    return f"""{name}_steps AS (
    SELECT l.t, l.pos, m.level, CASE WHEN s.h IS NULL THEN '-' WHEN s.pos > m.pos THEN 'R' || s.h ELSE 'L' || s.h END AS side
    FROM {leaves} l JOIN {name}_nodes m ON m.t = l.t AND m.pos = l.pos >> m.level
    LEFT JOIN {name}_nodes s ON s.t = m.t AND s.level = m.level AND s.pos = xor(m.pos, 1))"""


_MERKLE = f"""
WITH crc AS ({_CRC_TABLE}), docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS t,
    {_told("doc_id")} || {_told("source")} || {_told("lang")} AS before, n_chars, {_told("text")} AS after,
    n_chars IS NOT NULL AND {_CRC.format("doc_id::VARCHAR")} % 7 = 0 AS tampered
  FROM documents, crc
), hashed AS (
  SELECT doc_id, t, sha256(before || {_told("n_chars")} || after) AS h,
    CASE WHEN tampered THEN sha256(before || {_told("(n_chars + 1)")} || after) END AS changed
  FROM docs
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM hashed
), {_tree("a", "leaves")}, tops AS MATERIALIZED (
  SELECT '' AS t, a_roots.t AS name, h, row_number() OVER (ORDER BY encode(a_roots.t)) - 1 AS pos FROM a_roots
), {_tree("b", "tops")}, {_steps("a", "leaves")}, {_steps("b", "tops")}, steps AS (
  SELECT t, pos, level, side FROM a_steps
  UNION ALL SELECT l.t, l.pos, {_LEVELS} + b.level, b.side FROM leaves l JOIN tops ON tops.name = l.t JOIN b_steps b ON b.pos = tops.pos
), paths AS (
  SELECT t, pos, list(side ORDER BY level) AS sides FROM steps GROUP BY t, pos
), folded AS (
  SELECT doc_id, l.h AS leaf, a.h AS subroot, b.h AS root,
    sha256(array_to_string(list_transform(coalesce(sides, []), lambda x: substr(x, 2)), '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(changed, l.h), coalesce(sides, [])), lambda a, x: CASE x[1]
      WHEN 'L' THEN sha256(substr(x, 2) || a) WHEN 'R' THEN sha256(a || substr(x, 2)) ELSE sha256(a) END) AS folded_root
  FROM leaves l LEFT JOIN paths p ON p.t = l.t AND p.pos = l.pos JOIN a_roots a ON a.t = l.t, b_roots b
)
SELECT *, folded_root = root AS verified FROM folded
"""

SQL: dict[str, str] = {
    "op4_chat_format": _CHAT, "op2_quality_rules": _QUALITY, "op8_source_mix": _MIX,
    "op11_spelling_variants": _SPELLING, "op13_merkle_manifest": _MERKLE,
}
