"""SQL twins of the queries, for DuckDB."""

from decision_lens.llm.rules import MEASURES, MIN_ROWS, SPREAD

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LONG = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS bucket FROM measures WHERE n_words > 0" for m in MEASURES)
_LEAST = "CASE o.measure " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in MEASURES.items()) + " END"
_PICK = {q: f"CASE WHEN o.rows >= {MIN_ROWS} THEN o.{q} WHEN l.rows >= {MIN_ROWS} THEN l.{q} ELSE a.{q} END" for q in ("q1", "q2", "q3")}


def _quartiles(keys: str) -> str:
    k = keys + ", " if keys else ""
    return f"""SELECT {k}measure, max(rows) AS rows, min(CASE WHEN 4 * upto >= rows THEN bucket END) AS q1,
        min(CASE WHEN 4 * upto >= 2 * rows THEN bucket END) AS q2, min(CASE WHEN 4 * upto >= 3 * rows THEN bucket END) AS q3
      FROM (SELECT {k}measure, bucket, sum(count(*)) OVER (PARTITION BY {k}measure ORDER BY bucket) AS upto,
                   sum(count(*)) OVER (PARTITION BY {k}measure) AS rows FROM long GROUP BY {k}measure, bucket) GROUP BY {k}measure"""


RULES = rf"""
WITH words AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
base AS MATERIALIZED (SELECT doc_id, lang, source, w, len(w)::BIGINT AS n_words,
    coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS capitals,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM words),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 4], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
measures AS MATERIALIZED (SELECT doc_id, lang, source, n_words, word_chars, n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    1000 * n_symbols // greatest(word_chars, 1) AS symbol_share, 1000 * capitals // greatest(word_chars, 1) AS capital_share,
    1000 * (len(lines) - len(list_distinct(lines))) // greatest(len(lines), 1) AS dup_line_share,
    1000 * coalesce(n, 0) // greatest(n_words, 1) AS repeat_share,
    least(10 * word_chars // greatest(n_words, 1), 1000) AS word_length,
    n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed FROM base LEFT JOIN repeats USING (doc_id)),
long AS ({_LONG}),
o AS ({_quartiles("lang, source")}), l AS ({_quartiles("lang")}), a AS ({_quartiles("")}),
ends AS (SELECT o.lang, o.source, o.measure,
    {_PICK["q2"]} + {SPREAD} * greatest({_PICK["q3"]} - {_PICK["q2"]}, {_LEAST}) AS hi,
    {_PICK["q2"]} - {SPREAD} * greatest({_PICK["q2"]} - {_PICK["q1"]}, {_LEAST}) AS lo
  FROM o JOIN l ON o.measure = l.measure AND o.lang IS NOT DISTINCT FROM l.lang JOIN a ON a.measure = o.measure),
verdict AS (SELECT doc_id, bool_or(CASE e.measure
    {" ".join(f"WHEN '{m}' THEN m.{m} > e.hi" + (f" OR m.{m} < e.lo" if m == "word_length" else "") for m in MEASURES)} END) AS beyond
  FROM measures m JOIN ends e ON m.lang IS NOT DISTINCT FROM e.lang AND m.source IS NOT DISTINCT FROM e.source GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(beyond, false) AS kept
FROM measures LEFT JOIN verdict USING (doc_id)"""

ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECON = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {ALNUM} AS w FROM documents), b AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, g)),
marked AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit
           FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(s, {10 * i + 1}, 10))::BIGINT >> {35 - 5 * j} & 31)::INTEGER + 1, 1)"
    for i in range(4) for j in range(8))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to FROM q"""

BLOCKS_SQL = {"op2_quality_rules": RULES, "op5_decontamination": DECON, "op8_warc_revisits": WARC}

SPACED_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
NEAR = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {SPACED_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 80 * (any_value(nx.n) + any_value(ny.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
BLOCKS_SQL["op10_superminhash_groups"] = NEAR

_ESCAPED = "length({0}) + length({0}) - length(replace(replace({0}, chr(92), ''), '<', ''))"
CHAT = rf"""
WITH raw AS (SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
    (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (SELECT *, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) + 3 AS tokens, 19 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")} AS chars,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM raw),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) - tokens AS place FROM t),
head AS (SELECT conv_id, arg_min(tokens, i) AS tokens FROM t WHERE role = 'system' GROUP BY conv_id),
roomy AS (SELECT p.*, 768 - CASE WHEN 2 * h.tokens <= 768 THEN h.tokens ELSE 0 END AS room, 2 * h.tokens <= 768 AS leads
  FROM placed p LEFT JOIN head h ON h.conv_id IS NOT DISTINCT FROM p.conv_id),
cells AS (SELECT *, place // room AS cell, min(place) OVER (PARTITION BY conv_id, place // room) AS first FROM roomy),
w AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY cell, place > first AND place + tokens - first > room) AS win FROM cells),
own AS (SELECT conv_id, win, min(place) AS first, max(place + tokens) AS stop, sum(chars) AS chars FROM w GROUP BY ALL),
past AS (SELECT w.conv_id, w.win + 1 AS win, sum(w.chars) AS chars, list(place) AS places FROM w JOIN own ON own.win = w.win AND own.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE stop - place <= 256 GROUP BY ALL),
lead_turn AS (SELECT conv_id, min(place) AS place, arg_min(chars, place) AS chars FROM w WHERE role = 'system' AND leads GROUP BY conv_id),
sizes AS (SELECT o.conv_id, sum(o.chars + coalesce(p.chars, 0) + CASE WHEN l.place < o.first AND NOT list_contains(coalesce(p.places, []), l.place) THEN l.chars ELSE 0 END)::BIGINT AS formatted_chars
  FROM own o LEFT JOIN past p ON p.win = o.win AND p.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN lead_turn l ON l.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY ALL),
said AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS taught FROM t GROUP BY conv_id)
SELECT s.conv_id, n_turns, turns_sha256, length(taught)::BIGINT AS loss_chars, sha256(taught) AS loss_sha256, formatted_chars
FROM said s JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM s.conv_id"""
BLOCKS_SQL["op6_chat_windows"] = CHAT

REPEATS = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
parts AS (SELECT doc_id, n, unnest(range(0, n, 512)) AS off, h FROM d),
cut AS MATERIALIZED (SELECT doc_id, n, off, substr(h, 2 * off + 1, 1124) AS piece FROM parts),
w AS MATERIALIZED (SELECT doc_id, off + i AS p, hash(substr(piece, 2 * i + 1, 100)) AS g
                   FROM (SELECT doc_id, n, off, piece, unnest(range(0, least(512, n - 49 - off))) AS i FROM cut)),
first AS (SELECT g, min(doc_id) AS f FROM w GROUP BY g),
starts AS (SELECT doc_id, p FROM w JOIN first USING (g) WHERE f < doc_id),
fresh AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM starts),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM fresh),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS after FROM spans),
rest AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS head, max(b) AS last
         FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN rest USING (doc_id)"""
BLOCKS_SQL["op9_suffix_dedup"] = REPEATS

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""
_VISIBLE = r"[^\x20\x09-\x0D]"
REPAIR = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, (SELECT unnest([0, 1]) AS copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM t),
j AS MATERIALIZED (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    CASE WHEN NOT regexp_matches(text, '{_VISIBLE}') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM seen),
closure(st, ins, st2) AS (VALUES ('e', '', 'e'), ('s', '', 's'), ('u', '', 'u'), ('a', '', 'a'), ('e', 'I', 'u'), ('e', 'II', 'a'), ('s', 'I', 'u'), ('s', 'II', 'a'), ('u', 'I', 'a'), ('a', 'I', 'u')),
step(st, op, k, st2) AS (VALUES ('e', 'D', NULL, 'e'), ('s', 'D', NULL, 's'), ('u', 'D', NULL, 'u'), ('a', 'D', NULL, 'a'),
    ('e', 'K', 's', 's'), ('e', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('a', 'K', 'u', 'u'), ('u', 'K', 'a', 'a'),
    ('e', 'R', NULL, 'u'), ('s', 'R', NULL, 'u'), ('a', 'R', NULL, 'u'), ('u', 'R', NULL, 'a')),
walk AS (SELECT conv_id, n, 0 AS i, c.st2 AS st, {{'cost': 2 * length(c.ins), 'audit': c.ins}} AS best FROM (SELECT DISTINCT conv_id, n FROM j), closure c WHERE c.st = 'e'
  UNION ALL
  SELECT w.conv_id, w.n, w.i + 1, c.st2, min({{'cost': w.best.cost + 2 * length(c.ins) + CASE s.op WHEN 'D' THEN 3 ELSE CASE s.op WHEN 'R' THEN 2 ELSE 0 END + (j.fault = 'truncated')::BIGINT END,
      'audit': w.best.audit || s.op || c.ins}})
  FROM walk w JOIN j ON j.i = w.i + 1 AND j.conv_id IS NOT DISTINCT FROM w.conv_id JOIN step s ON s.st = w.st AND (s.k IS NULL OR s.k = j.k)
    AND (s.op = 'D' OR j.fault NOT IN ('blank', 'duplicate')) JOIN closure c ON c.st = s.st2 GROUP BY w.conv_id, w.n, w.i, c.st2),
found AS MATERIALIZED (SELECT conv_id, min(best) AS best FROM walk WHERE i = n AND st IN ('e', 'a') GROUP BY conv_id),
ops AS (SELECT conv_id, p, substr(best.audit, p, 1) AS op, length(replace(substr(best.audit, 1, p), 'I', '')) AS i, length(replace(substr(best.audit, p), 'D', '')) AS rest
        FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS p FROM found)),
lines AS (SELECT o.conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN j.role WHEN rest % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE j.text END, chr(10) ORDER BY p)) AS h
          FROM ops o JOIN j ON j.conv_id IS NOT DISTINCT FROM o.conv_id AND j.i = greatest(o.i, 1) WHERE op <> 'D' GROUP BY o.conv_id),
pairs AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY i) || k AS pair FROM j),
counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM a.conv_id"""
BLOCKS_SQL["op11_turn_repair"] = REPAIR

NEGATIVES = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) QUALIFY rank <= 5"""
BLOCKS_SQL["op12_hard_negatives"] = NEGATIVES
