"""SQL equivalents for DuckDB, written from the definitions and not from the Spark code."""

from __future__ import annotations

from foliomill.llm.licenses import LICENSE_DIGESTS, known_texts
from foliomill.llm.quality_rules import MAX_REPEAT_PERCENT, MIN_GROUP, MIN_WORDS, SPREAD_FACTOR

_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _words(text: str) -> str:
    return _WORDS.format(text=text)


SUBSTRING = f"""
WITH words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n
    FROM (SELECT doc_id, {_words("text")} AS w FROM documents)
), windows AS (
    SELECT doc_id, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s
    FROM words
), later AS (
    SELECT doc_id, pos FROM (
        SELECT w.doc_id, w.pos, row_number() OVER (PARTITION BY s ORDER BY w.doc_id, w.pos) AS nth
        FROM windows w JOIN words USING (doc_id, pos) WHERE pos + 19 <= n
    ) WHERE nth > 1
), marked AS (
    SELECT w.doc_id, w.pos, word, max(l.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
    FROM words w LEFT JOIN later l USING (doc_id, pos)
), kept AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS t
    FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

NEAR = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
    FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
"""

_MEASURES = {
    "word_length": ("100 * word_chars // n_words", 150, True),
    "symbols": ("1000 * n_symbols // n_words", 100, False),
    "dup_lines": ("1000 * n_dup_lines // n_lines", 300, False),
    "repeats": ("1000 * n_repeat_words // n_words", 300, False),
}


def _bucket(v: str) -> str:
    return f"CASE WHEN {v} < 64 THEN {v} ELSE {v} // (1 << (length(bin({v})) - 6)) * (1 << (length(bin({v})) - 6)) END"


def _quality() -> str:
    values = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{k}' AS measure, {v} AS v, {slack} AS slack, {str(low).lower()} AS low FROM counts WHERE n_words > 0"
        for k, (v, slack, low) in _MEASURES.items()
    )
    ranked = lambda keys: f"""
        SELECT {keys}measure, min(b) FILTER (4 * upto >= total) AS q1, min(b) FILTER (4 * upto >= 3 * total) AS q3, max(total) AS total
        FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total
              FROM (SELECT {keys}measure, b, count(*) AS n FROM buckets GROUP BY ALL)) GROUP BY ALL"""  # noqa: E731
    return f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, {_words("text")} AS w FROM docs),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM w),
triples AS (
    SELECT doc_id, pos, n, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS t FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), hits AS (
    SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, t) AS c FROM triples WHERE pos + 2 <= n) WHERE c > 1
), repeated AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM hits) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), counts AS (
    SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM docs JOIN w USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
), vals AS ({values}),
buckets AS (SELECT *, {_bucket("v")} AS b FROM vals),
q2 AS ({ranked("lang, source, ")}), q1 AS ({ranked("lang, ")}), q0 AS ({ranked("")}),
verdicts AS (
    SELECT doc_id, bool_and(v <= hi + {SPREAD_FACTOR} * (hi - lo) + slack AND (NOT low OR v >= lo - {SPREAD_FACTOR} * (hi - lo) - slack)) AS inside
    FROM (
        SELECT v.*, CASE WHEN q2.total >= {MIN_GROUP} THEN q2.q1 WHEN q1.total >= {MIN_GROUP} THEN q1.q1 ELSE q0.q1 END AS lo,
            CASE WHEN q2.total >= {MIN_GROUP} THEN q2.q3 WHEN q1.total >= {MIN_GROUP} THEN q1.q3 ELSE q0.q3 END AS hi
        FROM vals v JOIN q2 USING (lang, source, measure) JOIN q1 USING (lang, measure) JOIN q0 USING (measure)
    ) GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed,
    NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AND coalesce(inside, false) AS kept
FROM counts LEFT JOIN verdicts USING (doc_id)
"""


#: The canonical form by its definition: every rule on every text.
_SPELLING = (
    (r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*$", ""),
    (r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$", ""),
    (r"[^\p{L}\p{N}]+", " "),
    (r"(^| )licence", r"\1license"),
    (r"(^| )sub license", r"\1sublicense"),
    (r"(^| )non commercial", r"\1noncommercial"),
    (r"(^| )merchantibility", r"\1merchantability"),
    (r"(^| )organisation", r"\1organization"),
    (r"(^| )favour", r"\1favor"),
    (r"(^| )creative commons ", r"\1cc "),
    (r"(^| )gnu general public license", r"\1gnu gpl"),
    (r"(^| )(version |ver |v)([0-9])", r"\1\3"),
    (r"^ +| +$", ""),
)


def _canonical(text: str) -> str:
    out = f"lower({text})"
    for pattern, replacement in _SPELLING:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return out


def _licenses() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in known_texts())
    digests = ", ".join(f"({quoted(k)}, {quoted(d)})" for k, d in LICENSE_DIGESTS)
    return f"""
WITH digests AS (SELECT sha256({_canonical("t")}) AS digest, k FROM (VALUES {rows}) v(k, t) UNION ALL SELECT d, k FROM (VALUES {digests}) v(k, d)),
known AS (SELECT digest, min(k) AS license_id FROM digests GROUP BY 1),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, sha256({_canonical("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)),
found AS (SELECT doc_id, list_sort(list(DISTINCT license_id)) AS notices FROM lines JOIN known USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({_canonical("text")}) AS text_digest FROM texts)
SELECT doc_id, text_digest, license_id, coalesce(notices, []::VARCHAR[]) AS notices
FROM whole LEFT JOIN known ON text_digest = digest LEFT JOIN found USING (doc_id)
"""


MERKLE = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, n_chars, crc,
         sha256(head || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS bad,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT *,  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
              lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS crc,
          coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
            || coalesce(octet_length(encode(source)) || ':' || source, '-')
            || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
          coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM documents)
),
nodes AS (
  SELECT lang, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n
),
subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
),
above AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY level, pos // 2, n
),
tree AS (
  SELECT coalesce('l' || lang, '') AS tree, level, pos, n, digest FROM nodes
  UNION ALL SELECT 'top', level, pos, n, digest FROM above
),
walk AS (
  SELECT doc_id, lang, 'l' AS stage, coalesce('l' || lang, '') AS tree, 0 AS level, pos, n, leaf, '' AS proof,
         CASE WHEN crc % 7 = 0 THEN bad ELSE leaf END AS own
  FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang,
         CASE WHEN w.n > 1 THEN w.stage ELSE 'top' END, CASE WHEN w.n > 1 THEN w.tree ELSE 'top' END,
         CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.pos // 2 ELSE r.pos END,
         CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE r.n END, w.leaf,
         CASE WHEN w.n > 1 THEN w.proof || coalesce(s.digest, '') ELSE w.proof END,
         CASE WHEN w.n = 1 THEN w.own WHEN w.pos % 2 = 0 THEN sha256(w.own || coalesce(s.digest, '')) ELSE sha256(s.digest || w.own) END
  FROM walk w
  LEFT JOIN tree s ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1)
  LEFT JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang
  WHERE w.n > 1 OR w.stage = 'l'
)
SELECT w.doc_id, w.leaf, r.subroot, a.digest AS root, sha256(w.proof) AS proof_sha256, w.own AS folded_root, w.own = a.digest AS verified
FROM walk w JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang JOIN above a ON a.n = 1
WHERE w.stage = 'top' AND w.n = 1
"""

BYTES = """
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT r, c, substr(h, 2 * c + 1, 512 + 398) AS h FROM (SELECT r, h, unnest(range(0, length(h) // 2, 256)) AS c FROM texts)
), places AS (
  SELECT r, c, h, unnest(range(0, least(256, length(h) // 2))) AS q FROM pieces
), windows AS (
  SELECT r, c + q AS p, substr(h, 2 * q + 1, 2) AS byte, CASE WHEN 2 * q + 400 <= length(h) THEN md5(substr(h, 2 * q + 1, 400)) END AS w FROM places
), marked AS (
  SELECT r, p, byte, w IS NOT NULL AND count(*) OVER (PARTITION BY w) > 1 AS again FROM windows
), covered AS (
  SELECT r, p, byte, max(again) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM marked
), spans AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM covered
), kept AS (
  SELECT r, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
         coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS left_over
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(left_over, ''))) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""


def _way(state: str, cost: str, letter: str, line: str | None = None, when: str = "true") -> str:
    """The way to a state, one edit longer."""
    left = f"{state}.o" if line is None else f"list_append({state}.o, {line})"
    key = f"lpad(({state}.k[:9]::BIGINT + {cost})::VARCHAR, 9, '0') || {state}.k[10:] || '{letter}'"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'k': {key}, 'o': {left}}} END"


def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


def _conversations() -> str:
    user, assistant, own = "'user:' || text", "'assistant:' || text", "role || ':' || text"
    delete = lambda k: _way(f"w.s{k}", "3", "D")
    rerole = lambda k, line: _way(f"w.s{k}", "2 + extra", "R", line, "stays")
    keep = lambda k, initial: _way(f"w.s{k}", "extra", "K", own, f"stays AND initial = '{initial}'")
    s0, s1, s3 = _least(delete(0)), _least(delete(1), keep(0, "s")), _least(delete(3), keep(2, "a"), rerole(2, assistant))
    s2 = _least(delete(2), *[keep(k, "u") for k in (0, 1, 3)], *[rerole(k, user) for k in (0, 1, 3)])
    i2 = _least("s2", *[_way(f"s{k}", "2", "I", "'user:'") for k in (0, 1, 3)])
    i3 = _least("s3", _way("i2", "2", "I", "'assistant:'"))
    return rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
),
dealt AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS fault
  FROM named
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM dealt
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid
  FROM hurt
),
judged AS (
  SELECT *, left(role, 1) AS initial, solid = '' AS blank,
         solid <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
  FROM placed
),
faults AS (SELECT *, NOT blank AND NOT duplicate AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated FROM judged),
steps AS (
  SELECT conv_id, pos, NOT (blank OR duplicate) AS stays, truncated::INT AS extra, initial, role, text,
         pos = max(pos) OVER (PARTITION BY conv_id) AS final FROM faults
),
-- a way is its cost in nine digits, its audit, and what it leaves; the least way of a state is the least text
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'k': '000000000', 'o': []::VARCHAR[]}} AS s0, NULL::STRUCT(k VARCHAR, o VARCHAR[]) AS s1,
         NULL::STRUCT(k VARCHAR, o VARCHAR[]) AS s2, NULL::STRUCT(k VARCHAR, o VARCHAR[]) AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, s.pos, {s0}, {s1}, {s2}, {s3}
  FROM (SELECT conv_id, pos, s0, s1, i2 AS s2, {i3} AS s3 FROM (SELECT *, {i2} AS i2 FROM walk)) w
  JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos + 1
),
ended AS (
  SELECT w.conv_id, {_least('s0', 's3')} AS best
  FROM (SELECT conv_id, pos, s0, s1, i2 AS s2, {i3} AS s3 FROM (SELECT *, {i2} AS i2 FROM walk)) w
  LEFT JOIN (SELECT conv_id, max(pos) AS n FROM steps GROUP BY conv_id) s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.pos = coalesce(s.n, 0)
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.k[:9]::BIGINT AS cost, best.k[10:] AS audit,
       sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLES = {
    "op4_substring_dedup": SUBSTRING,
    "op5_near_dedup": NEAR,
    "op8_quality_rules": _quality(),
    "op10_license_scan": _licenses(),
    "op11_merkle_manifest": MERKLE,
    "op12_suffix_array_dedup": BYTES,
    "op13_conversation_repair": _conversations(),
}
