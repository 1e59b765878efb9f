"""SQL for the queries that SQL can express."""

OP2_WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p), g AS (SELECT x, n, min(page_id) AS least FROM d GROUP BY 1, 2)
SELECT page_id, CAST(d.n AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(d.x, 1 + 10 * CAST(floor(i / 8) AS INT), 10) AS UBIGINT) >> CAST(35 - 5 * (i % 8) AS UBIGINT)) & 31 AS INT), 1)), '') AS payload_digest,
 CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM d JOIN g ON d.x = g.x AND d.n = g.n"""

OP6_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT unnest(['<|im_start|>', '<|im_end|>', '<|endoftext|>', '<|startoftext|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>']) AS k),
x AS (SELECT conv_id, turn, role, text, (SELECT sum((length(text) - length(replace(text, k, ''))) / length(k) + (length(role) - length(replace(role, k, ''))) / length(k)) FROM k) + length(text) - length(replace(text, '\', '')) + length(role) - length(replace(replace(role, '\', ''), chr(10), '')) AS extra FROM c),
f AS (SELECT *, 12 + length(role) + 1 + length(text) + 10 + 1 + extra AS size FROM x), s AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars FROM s GROUP BY 1"""

OP9_QUALITY = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, t, w, len(w) AS n, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM w), z AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS z FROM i), y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, z) AS c FROM z),
r AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, i + unnest(range(8)) AS p FROM y WHERE c > 1) q GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS spaces, length(t) AS n, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words,
 length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS stutter,
 len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*•][ \t]'))) AS bullets, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS ellipses
 FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN r ON w.doc_id = r.doc_id),
v AS (SELECT doc_id, n_words, n - spaces AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 10 * n_symbols > 3 * n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR (stutter > 20 AND 2 * stutter > n_words) OR (up > 2 * low AND up > 20)
 OR n - spaces > 20 * n_words OR 2 * (n - spaces) < 3 * n_words OR 2 * digits > n - spaces OR (n_lines >= 10 AND 10 * bullets > 9 * n_lines) OR (n_lines >= 10 AND 10 * ellipses > 3 * n_lines) AS bad FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM v"""

OP13_SEARCH = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS big_n, sum(len(w)) AS big_l FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
v AS (SELECT DISTINCT t FROM i), o AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d), f AS (SELECT doc_id, n, t, count(*) AS tf FROM o JOIN v USING (t) GROUP BY 1, 2, 3), g AS (SELECT t, count(*) AS df FROM f GROUP BY 1),
c AS (SELECT doc_id, f.t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // CAST(big_l AS BIGINT)))) AS gain FROM f JOIN g ON f.t = g.t, s),
r AS (SELECT item_id, doc_id, sum(gain) AS score FROM i JOIN c ON i.t = c.t GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 10"""

ORACLE_SQL = {"op2_warc": OP2_WARC, "op6_chat": OP6_CHAT, "op9_quality": OP9_QUALITY, "op13_search": OP13_SEARCH}
