"""DuckDB SQL for the corpus queries that SQL can express."""

ORACLES = {
    "op3_exact_dedup": r"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha AS text_sha256
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents) WINDOW g AS (PARTITION BY sha)
    """,
    "op4_line_dedup": r"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
                   FROM documents WHERE text IS NOT NULL),
             k AS (SELECT *, nullif(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '') AS key FROM l),
             bad AS (SELECT key FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT source) >= 5),
             m AS (SELECT k.*, k.key IS NOT NULL AND k.key IN (SELECT key FROM bad) AS gone FROM k),
             r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS left_text
                   FROM m GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256
        FROM documents d LEFT JOIN r USING (doc_id)
    """,
    "op5_quality_rules": r"""
        WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
             w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
             b AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                          length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w),
             ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
             dl AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
             u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
             g AS (SELECT doc_id, i, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS gram FROM u
                   WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
             t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g WHERE n = 8),
             rw AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM t, range(8) r(o) WHERE times > 1 GROUP BY doc_id),
             m AS (SELECT b.*, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                          b.n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * b.n_words AS base_failed
                   FROM b LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id)),
             h AS (SELECT host, count(*)::DOUBLE AS n, (count(*) FILTER (base_failed))::DOUBLE AS f FROM m WHERE host IS NOT NULL GROUP BY host),
             s AS (SELECT sum(n) AS n, sum(f) / sum(n) AS mean, count(*) AS h, sum(f * f / n) AS s2 FROM h),
             p AS (SELECT greatest(mean, 1e-6) * wt AS a, greatest(1 - mean, 1e-6) * wt AS b FROM (SELECT mean,
                       CASE WHEN h > 1 AND mean > 0 AND mean < 1 THEN least(greatest(mean * (1 - mean) / greatest(s2 / n - mean * mean - mean * (1 - mean) * h / n, 1e-9) - 1, 1.0), 10000.0) ELSE 1.0 END AS wt FROM s)),
             r AS (SELECT host, n, a, b, (f + a) / (n + a + b) AS rate FROM h, p),
             v AS (SELECT host FROM r WHERE rate - 2 * sqrt(rate * (1 - rate) / (n + a + b + 1)) > 0.6)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host NOT IN (SELECT host FROM v), true) AS kept FROM m
    """,
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(i) WHERE len(ws) > 0),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r AS (SELECT doc_id, doc_id AS top FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.top)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id)
        JOIN (SELECT doc_id, min(top) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
    """,
    "op11_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
             o AS (SELECT *, regexp_replace(text, '([\[<])(\\*(?:(?:/?(?:INST|SYS|ROLE)|[:+])\]|/?s>))', '\1\\\2', 'g') AS safe,
                          regexp_replace(role, '([\[<])(\\*(?:(?:/?(?:INST|SYS|ROLE)|[:+])\]|/?s>))', '\1\\\2', 'g') AS safe_role,
                          lag(role) OVER w IS NOT DISTINCT FROM role AND lag(role) OVER w IS NOT NULL AS joins
                   FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
             p AS (SELECT *, CASE WHEN joins THEN 3 ELSE CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE length(safe_role) + 18 END END AS marks FROM o)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(safe) + marks)::BIGINT AS formatted_chars
        FROM p GROUP BY conv_id
    """,
    "op12_phrase_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
             p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
             t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
             f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM w, range(1, 6) s(m), unnest(range(1, greatest(len(ws) - m + 2, 1))) g(i)) GROUP BY ALL HAVING count(*) >= 100),
             k AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
             b AS (SELECT DISTINCT x.lang, array_to_string(x.ws[i:i + m2 - 1], ' ') AS phrase, x.a AS longer FROM k x, range(2, 5) s(m2), unnest(range(1, greatest(x.m - m2 + 2, 1))) g(i) WHERE m2 < x.m),
             c AS (SELECT k.lang, k.phrase, k.a, l.f AS l, r.f AS r, t.n, (1000 * k.a * t.n) // (l.f * r.f) AS score, i
                   FROM k JOIN t USING (lang), unnest(range(1, k.m)) g(i) JOIN f l ON l.lang = k.lang AND l.m = i AND l.phrase = array_to_string(k.ws[:i], ' ')
                   JOIN f r ON r.lang = k.lang AND r.m = k.m - i AND r.phrase = array_to_string(k.ws[i + 1:], ' ')),
             s AS (SELECT * FROM c WHERE NOT EXISTS (FROM b WHERE b.lang = c.lang AND b.phrase = c.phrase AND 100 * b.longer >= 100 * c.a)
                   QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM s QUALIFY rank <= 2000
    """,
    "op13_merkle_manifest": r"""
        WITH RECURSIVE
             f AS (SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                          coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
             l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                          sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS changed FROM f),
             r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
                   FROM l WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
             t AS (SELECT tree, 0 AS lvl, i, n, leaf AS node FROM r UNION ALL
                   SELECT tree, lvl + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, lvl, i // 2),
             s AS (SELECT tree AS i, node, count(*) OVER () AS n FROM t WHERE n = 1),
             u AS (SELECT 0 AS lvl, i, n, node FROM s UNION ALL SELECT lvl + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 2),
             h AS (SELECT tree, max(lvl) AS h FROM t GROUP BY tree),
             w AS (SELECT r.tree, r.i, x.lvl, x.node, r.i >> x.lvl AS at FROM r JOIN h USING (tree), unnest(range(h)) v(k) LEFT JOIN t x ON x.tree = r.tree AND x.lvl = k AND x.i = xor(r.i >> k, 1) WHERE x.node IS NOT NULL
                   UNION ALL SELECT r.tree, r.i, h + x.lvl, x.node, r.tree >> x.lvl FROM r JOIN h USING (tree) JOIN u x ON x.i = xor(r.tree >> x.lvl, 1) WHERE x.n > 1),
             p AS (SELECT tree, i, sha256(string_agg(node, '' ORDER BY lvl)) AS proof FROM w GROUP BY tree, i),
             b AS (SELECT k, list_reduce(list_prepend(k::BIGINT, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) g(k)),
             crcs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                             lambda x, y: xor(x >> 8, list_extract(crc_table, (xor(x, y) & 255) + 1))), 4294967295) AS crc
                      FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), (SELECT list(v ORDER BY k) AS crc_table FROM b)),
             c AS (SELECT r.*, h.h + (SELECT max(lvl) FROM u) AS top, CASE WHEN doc_id IS NOT NULL AND n_changed THEN changed ELSE leaf END AS tried
                   FROM (SELECT *, doc_id IN (SELECT doc_id FROM crcs WHERE crc % 7 = 0) AS n_changed FROM r) r JOIN h USING (tree)),
             z AS (SELECT tree, i, 0 AS lvl, top, tried AS node FROM c UNION ALL
                   SELECT z.tree, z.i, z.lvl + 1, z.top, sha256(CASE WHEN w.node IS NULL THEN z.node WHEN w.at % 2 = 1 THEN w.node || z.node ELSE z.node || w.node END)
                   FROM z LEFT JOIN w ON w.tree = z.tree AND w.i = z.i AND w.lvl = z.lvl WHERE z.lvl < z.top)
        SELECT c.doc_id, c.leaf, s.node AS subroot, g.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, z.node AS folded_root, z.node = g.node AS verified
        FROM c JOIN s ON s.i = c.tree JOIN z ON z.tree = c.tree AND z.i = c.i AND z.lvl = z.top LEFT JOIN p ON p.tree = c.tree AND p.i = c.i, (SELECT node FROM u WHERE n = 1) g
    """,
}
