"""SQL for an independent engine of those queries that SQL can express."""

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(\"text\", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = rf"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce("text", ''), '{_SPACE}', ' ', 'g') AS norm FROM documents),
    g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)"""

#: Links by an exact self join of the shingles; components by following links until nothing is new.
NEAR = rf"""
    WITH RECURSIVE t AS (SELECT doc_id, {_LOWER} AS t FROM documents),
    w AS (SELECT doc_id, {_WORDS} AS w FROM t),
    s AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
    n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, s FROM s),
    x AS (SELECT doc_id, n_shingles, unnest(s) AS g FROM n),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        HAVING 100 * count(*) >= 80 * (any_value(a.n_shingles) + any_value(b.n_shingles) - count(*))),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
    SELECT n.doc_id, n_shingles, min(b) AS component_id, n.doc_id = min(b) AS kept FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n_shingles"""

#: Certified cutoffs: the binomial tail is summed term by term; as it grows with k, the fixed sequence is a filter.
QUALITY = rf"""
    WITH t AS (SELECT doc_id, lang, coalesce("text", '') AS t FROM documents),
    w AS (SELECT doc_id, lang, t, {_WORDS} AS w FROM t),
    g AS (SELECT doc_id, i, unnest([w[i], w[i + 1], w[i + 2]]) AS x, unnest([i, i + 1, i + 2]) AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
    r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, pos, count(DISTINCT i) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1 GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    c AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(floor(10000 * n_symbols / greatest(word_chars, 1)) AS INTEGER) AS junk_score FROM c),
    b AS (SELECT lang, junk_score AS s, sum(quality) AS good, sum(1 - quality) AS junk FROM f JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1) GROUP BY ALL),
    k AS (SELECT lang, s, CAST(sum(good) OVER d AS BIGINT) AS k, CAST(sum(junk) OVER d AS BIGINT) AS j, CAST(sum(good) OVER (PARTITION BY lang) AS BIGINT) AS n, coalesce(lag(s) OVER (PARTITION BY lang ORDER BY s), 0) AS below FROM b WINDOW d AS (PARTITION BY lang ORDER BY s DESC)),
    p AS (SELECT *, list_sum(list_transform(range(0, least(k, n) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.03) + (n - i) * ln(0.97)))) AS p FROM k WHERE n > 0),
    o AS (SELECT lang, CAST(greatest(1, (s + below + 1) // 2) AS INTEGER) AS cutoff, row_number() OVER (PARTITION BY lang ORDER BY j - 10 * k DESC, s DESC) AS place FROM p WHERE s > 0 AND j > 10 * k AND p <= 0.05 / (SELECT count(DISTINCT lang) FROM b))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, junk_score, cutoff, NOT base_failed AND coalesce(junk_score < cutoff, true) AS kept
    FROM f LEFT JOIN o ON o.lang IS NOT DISTINCT FROM f.lang AND place = 1"""

ORACLE_SQL = {"op5_quality_rules": QUALITY, "op7_exact_dedup": EXACT, "op9_minhash_near_dedup": NEAR}
