"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from oddledger.llm.templates import UNITS

OP9 = r"""
WITH RECURSIVE tokens AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
        END AS s
    FROM tokens
), sizes AS (
    SELECT doc_id, len(s) AS n FROM sets
), items AS (
    SELECT doc_id, unnest(s) AS g FROM sets
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM items x JOIN items y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), near AS (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * c >= {num} * (p.n + q.n - c)
), links AS (
    SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reach AS (
    SELECT doc_id AS start, doc_id AS node FROM documents
    UNION
    SELECT reach.start, links.b FROM reach JOIN links ON links.a = reach.node
), smallest AS (
    SELECT start, min(node) AS c FROM reach GROUP BY 1
)
SELECT d.doc_id, z.n AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d JOIN sizes z ON z.doc_id = d.doc_id JOIN smallest m ON m.start = d.doc_id
"""

_UNITS = "|".join(UNITS)
_BARE = r"""trim(regexp_replace(translate({0}, '.,;:!?"()[]{{}}', ''), '[\x20\x09-\x0D]+', ' ', 'g'))"""
_WITHIN = r"'([^.!?:\x20\x09-\x0D][ ]+)\p{Lu}\p{Ll}\p{L}*'"
_EVERY = r"'(^|[\x20\x09-\x0D])\p{Lu}\p{Ll}\p{L}*'"


def _template(pattern: str, times: int) -> str:
    named = "coalesce(text, '')"
    for _ in range(times):
        named = rf"regexp_replace({named}, {pattern}, '\1<name>', 'g')"
    numbered = f"regexp_replace(lower({named}), '[0-9][0-9.,:/-]*', '<num>', 'g')"
    united = rf"regexp_replace({numbered}, '<num>([ ]?)({_UNITS})([^\p{{L}}]|$)', '<num>\1<unit>\3', 'g')"
    return _BARE.format(united)


_RAW = _BARE.format("lower(coalesce(text, ''))")
_SPLIT = f"""string_split({_RAW}, ' ') AS r, string_split({_template(_WITHIN, 2)}, ' ') AS w,
           string_split({_template(_EVERY, 1)}, ' ') AS e"""
_LITERAL = """len(list_filter({0}[pos:pos + k - 1],
            lambda x: NOT (contains(x, '<num>') OR x IN ('<name>', '<unit>')))) >= least(4, k)"""

# a window is read by its raw words (0), with names within sentences (1), with names everywhere (2)
OP5 = f"""
WITH docs AS (
    SELECT DISTINCT doc_id, text, {_SPLIT} FROM documents
), items AS (
    SELECT * FROM (SELECT DISTINCT item_id, {_SPLIT} FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL)
    WHERE w[1] <> ''
), placed AS (
    SELECT *, least(8, len(w)) AS k, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS pos FROM items
), windows AS (
    SELECT item_id, k, pos - 1 AS ipos, 0 AS reading, array_to_string(r[pos:pos + k - 1], ' ') AS g, len(w) AS n
    FROM placed WHERE NOT {_LITERAL.format("w")}
    UNION ALL
    SELECT item_id, k, pos - 1, 1, array_to_string(w[pos:pos + k - 1], ' '), len(w) FROM placed WHERE {_LITERAL.format("w")}
    UNION ALL
    SELECT item_id, k, pos - 1, 2, array_to_string(e[pos:pos + k - 1], ' '), len(w) FROM placed WHERE {_LITERAL.format("e")}
), sizes AS (
    SELECT DISTINCT k FROM windows
), firsts AS (
    SELECT DISTINCT split_part(g, ' ', 1) AS first FROM windows
), total AS (
    SELECT item_id, count(DISTINCT ipos) AS all_, count(DISTINCT ipos) FILTER (reading > 0) AS free FROM windows GROUP BY 1
), spread AS (
    SELECT doc_id, text, r, w, e, k, unnest(range(1, len(w) - k + 2)) AS pos FROM docs, sizes WHERE len(w) >= k
), own AS (
    SELECT doc_id, text, len(w) AS n, k, pos - 1 AS dpos, false AS free, array_to_string(r[pos:pos + k - 1], ' ') AS g FROM spread
    WHERE r[pos] IN (SELECT first FROM firsts)
    UNION ALL
    SELECT doc_id, text, len(w), k, pos - 1, true, array_to_string(w[pos:pos + k - 1], ' ') FROM spread
    WHERE w[pos] IN (SELECT first FROM firsts)
    UNION ALL
    SELECT doc_id, text, len(w), k, pos - 1, true, array_to_string(e[pos:pos + k - 1], ' ') FROM spread
    WHERE e[pos] IN (SELECT first FROM firsts) AND e[pos:pos + k - 1] <> w[pos:pos + k - 1]
), hits AS (
    SELECT DISTINCT doc_id, text, item_id, o.k, reading, dpos - ipos AS shift, ipos
    FROM own o JOIN windows i ON o.g = i.g AND o.k = i.k AND o.free = (i.reading > 0) WHERE i.n >= 5 OR i.n = o.n
), spots AS (
    SELECT DISTINCT doc_id, text, item_id, k, reading, shift, unnest(range(ipos, ipos + k)) AS i FROM hits WHERE reading > 0
), slots AS (
    SELECT DISTINCT s.doc_id, s.text, s.item_id, s.k, reading, shift,
           CASE reading WHEN 2 THEN i.e[s.i + 1] ELSE i.w[s.i + 1] END AS kind, i.r[s.i + 1] AS a, d.r[s.i + shift + 1] AS b
    FROM spots s JOIN items i USING (item_id)
    JOIN docs d ON d.doc_id IS NOT DISTINCT FROM s.doc_id AND d.text IS NOT DISTINCT FROM s.text
), checked AS (
    SELECT doc_id, text, item_id, k, reading, shift, count(*) AS pairs, count(DISTINCT (kind, a)) AS f,
           count(DISTINCT (kind, b)) AS t, count(*) FILTER (a <> b) AS changed
    FROM slots WHERE contains(kind, '<num>') OR kind IN ('<name>', '<unit>') GROUP BY ALL
), agreeing AS (
    SELECT h.*, coalesce(c.changed, 0) AS changed FROM hits h
    LEFT JOIN checked c ON c.doc_id IS NOT DISTINCT FROM h.doc_id AND c.text = h.text AND c.item_id = h.item_id
        AND c.k = h.k AND c.reading = h.reading AND c.shift = h.shift
    WHERE coalesce(c.pairs = c.f AND c.pairs = c.t, true)
), counted AS (
    SELECT doc_id, text, item_id, count(DISTINCT ipos) AS of_all, count(DISTINCT ipos) FILTER (reading > 0) AS of_free,
           coalesce(min(changed) FILTER (reading > 0), 0) AS changed
    FROM agreeing GROUP BY ALL
), found AS (
    SELECT doc_id, text, item_id, changed, CASE WHEN free > 0 AND of_free >= 0.5 * free THEN of_free / free ELSE of_all / all_ END AS share
    FROM counted JOIN total USING (item_id) WHERE (free > 0 AND of_free >= 0.5 * free) OR of_all >= 0.5 * all_
), best AS (
    SELECT doc_id, text, count(*) AS items, arg_min(item_id, (-share, item_id)) AS item_id,
           arg_min(changed, (-share, item_id)) AS changed
    FROM found GROUP BY ALL
)
SELECT d.doc_id, b.items IS NOT NULL AS contaminated, coalesce(b.items, 0) AS items, b.item_id,
       coalesce(b.changed, 0) AS changed
FROM documents d LEFT JOIN best b ON d.doc_id IS NOT DISTINCT FROM b.doc_id AND d.text = b.text
"""

OP10 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), q AS (
    SELECT *, max(page_id) OVER (PARTITION BY html) AS owner FROM p
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM owner AND owner IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM q
"""

OP12 = r"""
WITH rows AS (
    SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
), split AS (
    SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rows
), keyed AS (
    SELECT *, translate(
        trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM split
), frequent AS (
    SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= {chars}
    GROUP BY 1 HAVING count(DISTINCT doc_id) >= {documents}
), marked AS (
    SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.owner AS gone
    FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""

OP13 = r"""
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(
        list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), texts AS (
    SELECT row_number() OVER () AS rid, doc_id, text, true AS own FROM documents
    UNION ALL SELECT NULL, NULL, text, false FROM benchmark
), words AS (
    SELECT rid, doc_id, own, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM texts
), used AS (
    SELECT rid, own, unnest(w) AS f FROM words
), hexed AS (
    SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM used)
), hashed AS (
    SELECT f, xor(4294967295, list_reduce(
        list_prepend(4294967295, [('0x' || h[2 * i - 1:2 * i])::BIGINT FOR i IN range(1, len(h) // 2 + 1)]),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
    FROM hexed, crc
), counts AS (
    SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t
    FROM used JOIN hashed USING (f) GROUP BY 1
), sums AS (
    SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM counts
), gains AS (
    SELECT bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (a.s + 10000) / ((c.s + 1)::DOUBLE * (a.t + 10000)))) AS gain
    FROM counts c, sums a
), weights AS (
    SELECT rid, sum(gain)::BIGINT AS weight FROM used JOIN hashed USING (f) JOIN gains USING (bucket)
    WHERE own GROUP BY 1
), scored AS (
    SELECT rid, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln(
               (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
               / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN weights USING (rid) WHERE own
), able AS (
    SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank,
           10 * count(*) OVER () // 100 AS drawn
    FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank
FROM scored LEFT JOIN able USING (rid)
"""

SQL = {
    "op12_lines": OP12.format(chars=40, documents=5),
    "op13_importance": OP13,
    "op5_templates": OP5,
    "op10_archive": OP10,
    "op9_minhash": OP9.replace("{num}", "85"),
}
