"""DuckDB SQL of those operators that SQL can express."""

#: Words of each piece, numbered; occurrences of one, two and three words; cuts; phrases in longer ones.
OP11 = r"""
WITH split AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'
    ) AS parts
    FROM documents
), piece AS (
    SELECT lang, list_filter(regexp_split_to_array(part, '[\x20\x09]+'), lambda w: w <> '') AS w
    FROM (SELECT lang, unnest(parts) AS part FROM split)
), place AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece
), f1 AS (
    SELECT lang, w[i] AS w1, count(*) AS f FROM place GROUP BY ALL
), f2 AS (
    SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM place WHERE i < len(w) GROUP BY ALL
), f3 AS (
    SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM place WHERE i + 1 < len(w)
    GROUP BY ALL HAVING count(*) >= 10
), size AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang
), cut AS (
    SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.f AS a, x.f AS l, y.f AS r
    FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
    WHERE c.f >= 10 AND NOT EXISTS (
        SELECT 1 FROM f3 h WHERE h.lang = c.lang AND h.w1 = c.w1 AND h.w2 = c.w2 AND 100 * h.f >= 50 * c.f)
      AND NOT EXISTS (
        SELECT 1 FROM f3 h WHERE h.lang = c.lang AND h.w2 = c.w1 AND h.w3 = c.w2 AND 100 * h.f >= 50 * c.f)
    UNION ALL
    SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.f, x.f, y.f
    FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1
    JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
    UNION ALL
    SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.f, x.f, y.f
    FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2
    JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3
), scored AS (
    SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cut
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN size USING (lang)
QUALIFY rank <= 2000
"""

#: Terms of documents and items, weights, impacts; every document is scored for every item.
OP13 = r"""
WITH term AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), tf AS (
    SELECT doc_id, term, count(*) AS tf FROM term GROUP BY ALL
), len AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), total AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len
), weight AS (
    SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
    FROM tf, total GROUP BY term, docs
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN len USING (doc_id) JOIN weight USING (term), total
    GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50
"""

ORACLES: dict[str, str] = {"op11_collocations": OP11, "op13_lexical_search": OP13}
