"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id,
         CASE WHEN len(w) = 0 THEN []
              WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 3),
                                 lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s
  FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), least AS (
  SELECT g, min(doc_id) AS home FROM grams GROUP BY g HAVING count(*) > 1
), shared AS (
  SELECT a.doc_id, a.n, a.g FROM grams a JOIN least USING (g)
), enough AS (
  SELECT * FROM shared WHERE doc_id IN
    (SELECT doc_id FROM shared GROUP BY doc_id HAVING 100 * count(*) >= 75 * min(n))
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM enough a JOIN enough b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
), links AS (
  SELECT a, b FROM pairs WHERE 100 * c >= 75 * (na + nb - c)
), reach AS (
  SELECT a, b FROM links
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
       least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, len(regexp_extract_all(text, '[\[<]\\*(?:/?INST\]|</?SYS>>|/?s>)')) AS controls FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + controls + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
                                          ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
), sums AS (
  SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto,
         sum(length(line) + 1) OVER (PARTITION BY doc_id) AS total
  FROM lines
), sized AS (
  SELECT doc_id, i, line, upto, upto - length(line) - 1 AS before, total FROM sums
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS ahead,
         count(*) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS behind
  FROM sized
), runs AS (
  SELECT doc_id, i AS start, ahead AS n FROM counted WHERE total - before >= 20
  UNION
  SELECT doc_id, i - behind + 1, behind FROM counted WHERE upto >= 20
), named AS (
  SELECT r.doc_id, r.start, r.n,
         array_to_string(list_slice(string_split(d.text, chr(10)), r.start, r.start + r.n - 1), chr(10)) AS body
  FROM runs r JOIN documents d USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n, body ORDER BY doc_id, start) AS copy FROM named
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS i FROM placed WHERE copy > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, g)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(place, ''), lambda x: ord(x)::BIGINT)),
         lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _edit(state: str, cost: str, letter: str, line: str, when: str) -> str:
    """A state of the repair after one more edit, out of reach unless ``when`` holds."""
    return (
        f"{{'cost': CASE WHEN {when} THEN {state}.cost + {cost} ELSE 1000000000 END, "
        f"'audit': {state}.audit || '{letter}', 'body': {state}.body{line}}}"
    )


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _row_edits(after: int) -> str:
    """The cheapest way into a state by the next row: it is kept, reroled or deleted."""
    own = f"s{after}"
    line, more = " || chr(10) || r.role || ':' || r.text", "(CASE WHEN r.cut THEN 3 ELSE 0 END)"
    options = [_edit(own, "4", "D", "", "true"), _edit(own, more, "K", line, "NOT r.gone AND r.initial = ''")]
    before = {1: ("s", [0]), 2: ("u", [0, 1, 3]), 3: ("a", [2])}
    if after in before:
        initial, states = before[after]
        for state in states:
            options.append(_edit(f"s{state}", more, "K", line, f"NOT r.gone AND r.initial = '{initial}'"))
            if initial != "s":
                role = {"u": "user", "a": "assistant"}[initial]
                new = f" || chr(10) || '{role}:' || r.text"
                options.append(_edit(f"s{state}", f"3 + {more}", "R", new, "NOT r.gone"))
    return _least(*options)


def _inserted(after: int, states: list[str], role: str) -> str:
    line = f" || chr(10) || '{role}:'"
    return _least(f"s{after}", *[_edit(s, "3", "I", line, "true") for s in states])


_FAR = "{'cost': 1000000000, 'audit': '', 'body': ''}"
_USER, _ASSISTANT = _inserted(2, ["s0", "s1", "s3"], "user"), _inserted(3, ["s2"], "assistant")

REPAIR = rf"""
WITH RECURSIVE placed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
  FROM conversations
), kinds AS (
  SELECT *, {_CRC32} % 20 AS kind FROM placed
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, substr(role, 1, 1) AS initial
  FROM damaged
), marked AS (
  SELECT *, blank OR again AS gone, NOT (blank OR again) AND open AS cut,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS step
  FROM numbered
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id
), moved AS (
  SELECT conv_id, 0::BIGINT AS i, {{'cost': 0, 'audit': '', 'body': ''}} AS s0, {_FAR} AS s1, {_FAR} AS s2, {_FAR} AS s3
  FROM faults
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, {_ASSISTANT} AS s3 FROM (
    SELECT conv_id, i, s0, s1, {_USER} AS s2, s3 FROM (
      SELECT m.conv_id, r.i, {_row_edits(0)} AS s0, {_row_edits(1)} AS s1, {_row_edits(2)} AS s2, {_row_edits(3)} AS s3
      FROM (SELECT conv_id, i, s0, s1, s2, {_ASSISTANT} AS s3
            FROM (SELECT conv_id, i, s0, s1, {_USER} AS s2, s3 FROM moved)) m
      JOIN marked r ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = m.i + 1
    )
  )
), done AS (
  SELECT f.*, {_least("s0", "s3")} AS best
  FROM faults f JOIN moved m ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = f.n
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(substr(best.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done d ON c.conv_id IS NOT DISTINCT FROM d.conv_id
"""

DIVERGENCE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce({_LOWER}, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents
), tokens AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counted AS (
  SELECT lang, source, term, count(*) AS c FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), shares AS (
  SELECT *, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p
  FROM grid
), wholes AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 2)) // (sum(sum(c)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM grid GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), typical AS (
  SELECT s.lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM shares s JOIN wholes USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', item, value FROM typical
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM ranked QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
"""

ORACLES = {
    "op2_ngram_jaccard_join": NGRAM_JOIN,
    "op6_chat_format": CHAT,
    "op9_line_dedup": LINE_DEDUP,
    "op10_decontamination": DECONTAMINATION,
    "op12_source_divergence": DIVERGENCE,
    "op13_conversation_repair": REPAIR,
}
