"""The queries that SQL can express, as DuckDB statements over the same tables."""

from __future__ import annotations

import string

from oreline.llm.rules import URL_RULES

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NEXT = ", ".join(f"lead(word, {n}) OVER o" for n in range(1, 10))
_RULES = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in URL_RULES)

LLM_ORACLES = {
    "op1_minhash": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        l AS (
            SELECT doc_id, n, i, list(word) OVER (PARTITION BY doc_id ORDER BY i
                   ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS l
            FROM (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w)),
        s AS (SELECT DISTINCT doc_id, array_to_string(l, ' ') AS s FROM l WHERE len(l) = 3 OR (n < 3 AND i = 1)),
        z AS (SELECT doc_id, count(*) AS z FROM s GROUP BY 1),
        e AS (
            SELECT p.a, p.b FROM (
                SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
                FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2) p
            JOIN z x ON x.doc_id = p.a JOIN z y ON y.doc_id = p.b
            WHERE 100 * k >= 85 * (x.z + y.z - k)),
        g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b),
        m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
        SELECT doc_id, coalesce(z.z, 0) AS n_shingles, least(doc_id, coalesce(m.b, doc_id)) AS component_id,
               doc_id = least(doc_id, coalesce(m.b, doc_id)) AS kept
        FROM documents LEFT JOIN z USING (doc_id) LEFT JOIN m ON m.a = doc_id""",
    "op2_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
        n AS (SELECT doc_id, t, octet_length(t) AS n FROM d),
        p AS (SELECT doc_id, unnest(range(0, n - 99)) AS p, n.t FROM n WHERE n >= 100),
        k AS (SELECT doc_id, p, hash(t[p + 1 : p + 100]) AS h, t[p + 1 : p + 100] AS k FROM p),
        f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h, k ORDER BY doc_id, p) AS r FROM k),
        x AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 AS far FROM f WHERE r > 1),
        y AS (SELECT doc_id, p, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM x),
        s AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM y GROUP BY 1, 2),
        c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s),
        g AS (
            SELECT doc_id, string_agg(hex(t[since + 1 : a]), '' ORDER BY a) AS head,
                   max(b) AS last, sum(b - a) AS gone, count(*) AS runs
            FROM c JOIN n USING (doc_id) GROUP BY 1)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(head, '') || hex(t[coalesce(last, 0) + 1 : n]))) AS kept_sha256
        FROM n LEFT JOIN g USING (doc_id)""",
    "op3_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM n JOIN g USING (t)""",
    "op4_url_filters": f"""
        WITH u AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        p AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (
            SELECT rule, verdict, substr(rule, 1, instr(rule, '/') - 1) AS h, substr(rule, instr(rule, '/')) AS q
            FROM (VALUES {_RULES}) v(rule, verdict)),
        b AS (
            SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
            FROM (SELECT DISTINCT host, path FROM p) k
            JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY 1, 2)
        SELECT page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
        FROM p LEFT JOIN b ON b.host = p.host AND b.path = p.path""",
    "op8_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_TERM}') AS w FROM documents),
        i AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_TERM}') AS w FROM benchmark),
        q AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s
              FROM i WHERE len(w) > 0),
        k AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM q),
        z AS (SELECT DISTINCT n FROM k),
        l AS (
            SELECT doc_id, i, left_over, [word, {_NEXT}] AS l
            FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS left_over FROM d)
            WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT doc_id, i, n, array_to_string(l[1 : n], ' ') AS k FROM l JOIN z ON left_over - i + 1 >= n),
        h AS (SELECT doc_id, i, n, item_id FROM g JOIN k USING (n, k)),
        t AS (
            SELECT doc_id, count(DISTINCT word_no) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS word_no FROM h) GROUP BY 1),
        m AS (
            SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
            FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op12_ranked_search": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_TERM}') AS w FROM documents),
        n AS (SELECT u, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
        s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
        t AS (SELECT u, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT u, unnest(w) AS term FROM d) GROUP BY 1, 2),
        f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
        g AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s),
        m AS (SELECT u, doc_id, 75 + (25 * n * docs) // words AS m FROM n, s),
        q AS (
            SELECT item_id, term, count(*) AS k FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_TERM}')) AS term FROM benchmark)
            GROUP BY 1, 2),
        r AS (
            SELECT item_id, doc_id, u, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM q JOIN t USING (term) JOIN g USING (term) JOIN m USING (u) GROUP BY 1, 2, 3)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
        WHERE rank <= 20""",
    "op13_phrases": rf"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
        g AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
            FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
        f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
        u AS (
            SELECT lang, k, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS x, array_to_string(w[cut + 1 : k], ' ') AS y
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
        s AS (
            SELECT u.lang, u.phrase, a, l.f AS l, r.f AS r, n, cut,
                   CAST((1000 * a::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS BIGINT) AS score
            FROM u JOIN f l ON l.lang = u.lang AND l.phrase = x JOIN f r ON r.lang = u.lang AND r.phrase = y
            JOIN t ON t.lang = u.lang),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s) WHERE o = 1),
        i AS (
            SELECT lang, array_to_string(w[p : p + m - 1], ' ') AS phrase, max(a) AS most
            FROM (SELECT *, unnest(range(1, k - m + 2)) AS p FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k >= 3))
            GROUP BY 1, 2),
        o AS (
            SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
            FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
            WHERE most IS NULL OR 100 * most < 100 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000""",
}
