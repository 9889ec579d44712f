"""DuckDB SQL for the queries that SQL can express.

None for the learned toxicity score, what tokenizers give, the aligned passages and the pipeline; their tests hold them
against plain versions.
"""

from __future__ import annotations

from . import licenses, warc
from .words import WORD_PATTERN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORD_PATTERN}')"


OP1 = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) n FROM sound),
links AS (
  SELECT a.vec_id a, b.vec_id b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) low FROM reach GROUP BY a), counts AS (SELECT a, count(*) n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT n_links, least(vec_id, coalesce(low, vec_id))::BIGINT component_id,
  vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.a LEFT JOIN counts ON vec_id = counts.a
"""

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words("text")} w FROM documents),
spread AS (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 4, 1) + 1 END)) i FROM w),
runs AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') r, count(*) n FROM spread GROUP BY ALL),
sizes AS (SELECT doc_id, sum(n) n FROM runs GROUP BY doc_id),
common AS (SELECT a.doc_id a, b.doc_id b, sum(least(a.n, b.n)) c FROM runs a JOIN runs b ON a.r = b.r AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) low FROM reach GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(low, doc_id))::BIGINT class_id, len(w)::BIGINT n_words, doc_id <= coalesce(low, doc_id) AS kept
FROM w LEFT JOIN low ON doc_id = a
"""


def _uuid(text: str) -> str:
    h = f"sha256({text})"
    return (
        f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-8' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-'"
        f" || substr({h}, 21, 12) || '>'"
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NUMBER = "CASE WHEN r[3] IN ('x', 'X') THEN ('0x' || r[4:-2])::BIGINT ELSE r[3:-2]::BIGINT END"


def _decoded(text: str) -> str:
    """Each piece between references with the character of the reference behind it."""
    letter = f"""CASE WHEN r IS NULL THEN '' WHEN r[2] <> '#' THEN coalesce(names[r], r)
      WHEN {_NUMBER} = 160 THEN ' ' WHEN {_NUMBER} BETWEEN 1 AND 55295 OR {_NUMBER} BETWEEN 57344 AND 1114111 THEN chr(({_NUMBER})::INTEGER) ELSE chr(65533) END"""
    pairs = f"list_zip(string_split_regex({text}, {_quoted(warc.REFERENCES)}), regexp_extract_all({text}, {_quoted(warc.REFERENCES)}))"
    return f"array_to_string(list_transform({pairs}, lambda z: z[1] || list_transform([z[2]], lambda r: {letter})[1]), '')"


_CRLF = "chr(13) || chr(10)"
_PLAIN = f"regexp_replace(html, {_quoted(warc.HIDDEN)}, '', 'g')"
_PLAIN = f"regexp_replace({_PLAIN}, {_quoted(warc.BLOCKS)}, chr(10), 'g')"
_PLAIN = _decoded(f"regexp_replace({_PLAIN}, '{warc.TAGS}', '', 'g')")
_PLAIN = rf"regexp_replace({_PLAIN}, '[ \t\f\r]{{2,}}|[\t\f\r]', ' ', 'g')"
_PLAIN = rf"trim(regexp_replace({_PLAIN}, '[ \n]*\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
_TITLE = rf"trim(regexp_replace({_decoded(f'regexp_extract(html, {_quoted(warc.TITLE)}, 1)')}, '[ \t\n\f\r]+', ' ', 'g'))"
_LINKS = (
    f"list_transform(regexp_extract_all(regexp_replace(html, {_quoted(warc.HIDDEN)}, '', 'g'), {_quoted(warc.LINKS)}, 1), lambda x: 'outlink: ' || "
    + _decoded(rf"regexp_replace(regexp_replace(x, {_quoted(warc.QUOTES)}, '', 'g'), '[ \t\n\f\r]+', '%20', 'g')")
    + " || ' L a/@href')"
)
OP3 = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') html FROM pages),
source AS (
  SELECT page_id, url, html, {_uuid("'response|' || coalesce(page_id::VARCHAR, 'NULL') || '|' || coalesce(url, 'NULL')")} refers_to,
    ['HTTP/1.1 200 OK', 'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || strlen(html)] heads, 'sha256:' || sha256(html) digest
  FROM p
), known AS (SELECT map([{", ".join(map(_quoted, warc.NAMED))}], [{", ".join(map(_quoted, warc.NAMED.values()))}]) AS names),
texts AS (SELECT *, {_PLAIN} plain, {_TITLE} title, {_LINKS} links FROM source, known),
records AS (
  SELECT page_id, 'conversion' AS type, 'text/plain; charset=utf-8' content_type, plain AS content, url, refers_to, heads, digest FROM texts
  UNION ALL
  SELECT page_id, 'metadata', 'application/warc-fields',
    array_to_string(list_concat(list_concat(['software: {warc.SOFTWARE}', 'source-payload-digest: ' || digest],
      list_transform(heads, lambda x: 'source-header: ' || x)), list_concat(CASE WHEN title <> '' THEN ['title: ' || title] ELSE [] END, links)),
      {_CRLF}) || {_CRLF}, url, refers_to, heads, digest
  FROM texts
)
SELECT page_id, type, {_uuid("type || '|' || refers_to")} record_id, refers_to, url target_uri, '{warc.DATE}' AS date, content_type,
  array_to_string(heads, chr(10)) source_headers, digest source_digest, 'sha256:' || sha256(content) block_digest,
  strlen(content)::BIGINT content_length, content
FROM records
"""

OP4 = f"""
WITH i AS (SELECT item_id, {words("text")} w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 9, 1) + 1 END)) s FROM i),
windows AS (SELECT DISTINCT item_id, w[s:s + 9] p FROM starts),
sizes AS (SELECT DISTINCT len(p) n FROM windows),
d AS (SELECT doc_id, {words("text")} w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) s FROM d, sizes),
found AS (SELECT doc_id, s, n, item_id FROM places JOIN windows ON w[s:s + n - 1] = p),
hit AS (SELECT doc_id, count(DISTINCT k) n FROM (SELECT doc_id, unnest(range(s, s + n)) k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) l FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n, 0)::BIGINT n_hit, coalesce(len(l), 0)::BIGINT n_items,
  sha256(coalesce(array_to_string(l, ','), '')) items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_HASH = "('0x' || substr(md5({}), 1, 13))::BIGINT"
OP6 = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) n FROM documents GROUP BY source),
rates AS (
  SELECT source, 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM sizes) * (SELECT sum(n)::BIGINT FROM sizes) / n rate FROM sizes
), draws AS (SELECT source, greatest(ceil(rate / 8.0), 1)::INTEGER draws, rate / greatest(ceil(rate / 8.0), 1)::INTEGER mean FROM rates),
cdf AS (
  SELECT source, mean, 0 k, exp(-mean) term, exp(-mean) c FROM draws
  UNION ALL SELECT source, mean, k + 1, term * mean / (k + 1), c + term * mean / (k + 1) FROM cdf WHERE k < 63
), lists AS (SELECT source, list(c ORDER BY k) cs FROM cdf GROUP BY source),
thrown AS (
  SELECT d.*, l.cs, unnest(range(1, w.draws + 1)) draw FROM documents d
  JOIN draws w ON d.source IS NOT DISTINCT FROM w.source JOIN lists l ON d.source IS NOT DISTINCT FROM l.source
), landed AS (
  SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cs, lambda c: c <= {_HASH.format("'mix|' || doc_id || '|' || draw")} / {float(1 << 52)!r}::DOUBLE))) n
  FROM thrown GROUP BY ALL
), copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n::BIGINT + 1))::INTEGER copy FROM landed)
SELECT *, {_HASH.format("'mix-order|' || doc_id || '|' || copy")} shuffle_key FROM copies
"""

_RULES = ",\n  ".join(f"({_quoted(r['keyword'])}, {r['tier']}, {_quoted(r['label'])}, {r['weight']!r}::DOUBLE, {_quoted(r['pattern'])})" for r in licenses.rules())
_BASE = " UNION ALL ".join(
    f"SELECT doc_id, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()!r})) low, '{label}' AS label FROM d"
    for p, label in licenses.BASE.items()
)
OP7 = f"""
WITH rules(keyword, tier, label, weight, pattern) AS (VALUES
  {_RULES}),
d AS (SELECT doc_id, {words("text")} w FROM documents),
base AS ({_BASE}),
spaced AS (SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' t FROM d),
asked AS (
  SELECT doc_id, tier, label, weight, regexp_split_to_array(t, pattern) parts, regexp_extract_all(t, pattern) found
  FROM spaced JOIN rules ON contains(t, keyword) WHERE len(regexp_extract_all(t, pattern)) > 0
), each AS (SELECT *, unnest(range(1, len(found) + 1)) k FROM asked),
spans AS (
  SELECT doc_id, tier, label, weight, list_sum(list_transform(parts[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: len(x))), 0) low, len(found[k]) n
  FROM each
), placed AS (SELECT *, low + n high, row_number() OVER (PARTITION BY doc_id ORDER BY low, n DESC, tier, label, weight) r FROM spans),
kept AS (
  SELECT * FROM placed a WHERE NOT EXISTS (SELECT 1 FROM placed b WHERE b.doc_id = a.doc_id AND b.r < a.r AND b.tier <= a.tier AND b.high >= a.high)
),
b AS (SELECT doc_id, count(*) n, min(low) first, max(low) last, list_sort(list(DISTINCT label)) l FROM base GROUP BY doc_id),
f AS (SELECT doc_id, list(DISTINCT label) l, max(weight) w FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT n_words, coalesce(b.n, 0)::BIGINT n_base, first::BIGINT first_word, last::BIGINT last_word,
  coalesce(array_to_string(b.l, ','), '') base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(f.l, [])))), ','), '') labels,
  greatest(CASE WHEN b.n > 0 THEN 0.6 ELSE 0.0 END, coalesce(f.w, 0.0))::DOUBLE score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id
"""

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) p FROM d),
strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) s FROM places),
again AS (SELECT doc_id, p FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
marked AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END fresh FROM again),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) g FROM marked),
runs AS (SELECT doc_id, g, min(p) low, max(p) + 100 high FROM grouped GROUP BY doc_id, g),
cut AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) before FROM runs),
kept AS (
  SELECT doc_id, sum(high - low) n, count(*) spans, max(high) last, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) k
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (len(h) // 2)::BIGINT n_bytes, coalesce(n, 0)::BIGINT n_removed, coalesce(spans, 0)::BIGINT n_spans,
  sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(last, 0) + 1))) kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_CRC = (
    "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: "
    "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
)


def _edit(way: str, cost: str, letter: str, line: str = "''", when: str = "true") -> str:
    """A way that goes on by an edit; NULL where there is none."""
    return f"CASE WHEN {way} IS NOT NULL AND {when} THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 't': {way}.t || {line}}} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_NL, _KEPT = "chr(10)", "chr(10) || r.role || ':' || r.text"
_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
# Inserts before a row: the four states after them, from those after the row before.
_OPEN = {
    "w0": "s0",
    "w1": "s1",
    "w2": _least("s2", *(_edit(s, "2", "I", _USER) for s in ("s0", "s1", "s3"))),
    "w3": _least("s3", _edit("s2", "2", "I", _ASSISTANT), *(_edit(s, "4", "II", f"{_USER} || {_ASSISTANT}") for s in ("s0", "s1"))),
}
_OPENED = ", ".join(f"{way} AS {name}" for name, way in _OPEN.items())
_USERS = ("o.w0", "o.w1", "o.w3")
_STEP = {
    "s0": _edit("o.w0", "3", "D"),
    "s1": _least(_edit("o.w1", "3", "D"), _edit("o.w0", "r.cut", "K", _KEPT, "r.initial = 's' AND NOT r.goes")),
    "s2": _least(
        _edit("o.w2", "3", "D"),
        *(_edit(w, "r.cut", "K", _KEPT, "r.initial = 'u' AND NOT r.goes") for w in _USERS),
        *(_edit(w, "2 + r.cut", "R", f"{_USER} || r.text", "NOT r.goes") for w in _USERS),
    ),
    "s3": _least(
        _edit("o.w3", "3", "D"),
        _edit("o.w2", "r.cut", "K", _KEPT, "r.initial = 'a' AND NOT r.goes"),
        _edit("o.w2", "2 + r.cut", "R", f"{_ASSISTANT} || r.text", "NOT r.goes"),
    ),
}
_WAY = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
OP11 = f"""
WITH RECURSIVE faults AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor({_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}, 4294967295) % 20 AS f
  FROM conversations
), after AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) copy
  FROM faults WHERE f <> 0
), ordered AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER w AS k, lag(left(role, 1)) OVER w AS before,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open
  FROM after WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))
), told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again FROM ordered
), rows AS (
  SELECT *, blank OR again AS goes, CASE WHEN open AND NOT blank AND NOT again THEN 1 ELSE 0 END AS cut FROM told
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut)::BIGINT AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
), ways AS (
  SELECT conv_id, 0::BIGINT AS k, n, {{'c': 0::BIGINT, 'a': '', 't': ''}}::{_WAY} AS s0, NULL::{_WAY} AS s1, NULL::{_WAY} AS s2, NULL::{_WAY} AS s3 FROM facts
  UNION ALL
  SELECT o.conv_id, o.k + 1, o.n, {", ".join(f"({step})::{_WAY}" for step in _STEP.values())}
  FROM (SELECT conv_id, k, n, {_OPENED} FROM ways WHERE k < n) o
  JOIN rows r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.k = o.k + 1
), best AS (SELECT conv_id, {_least("w0", "w3")} AS way FROM (SELECT conv_id, {_OPENED} FROM ways WHERE k = n))
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.c, 0)::BIGINT AS cost,
  coalesce(way.a, '') AS audit, sha256(coalesce(substr(way.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id AND f.n IS NOT NULL
"""

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": OP1,
    "op2_bagminhash": OP2,
    "op3_warc_derivatives": OP3,
    "op4_decontaminate": OP4,
    "op6_mix": OP6,
    "op7_licenses": OP7,
    "op8_suffix_dedup": OP8,
    "op11_conversation_repair": OP11,
}
