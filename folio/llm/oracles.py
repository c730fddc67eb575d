"""SQL of the corpus operators that SQL can express."""

_INTEGERS = """
    e AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
          WHERE embedding IS NOT NULL AND label_rule AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)"""


def _assigned(n: int) -> str:
    """a{n}: nearest entry of codebook b{n} for each part, ties to the lower index."""
    return f"""
    a{n} AS (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
             FROM (SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM c JOIN b{n} b ON c.part = b.part AND c.pos = b.pos GROUP BY 1, 2, 3) q GROUP BY 1, 2)"""


def _moved(n: int) -> str:
    """b{n + 1}: each entry's parts' floored mean; unused entries stay."""
    return f"""
    b{n + 1} AS (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN
             (SELECT a.part, a.entry, c.pos, CAST(floor(sum(c.x) / count(*)) AS BIGINT) AS x FROM a{n} a JOIN c ON a.vec_id = c.vec_id AND a.part = c.part GROUP BY 1, 2, 3) m
             ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"""


VECTOR_CODES = f"""
    WITH {_INTEGERS.replace("label_rule", "true")},
    f AS (SELECT vec_id, unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS i, len(v) // 16 AS k FROM e),
    c AS (SELECT vec_id, i // k AS part, i % k AS pos, x FROM f),
    s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT 64),
    b0 AS (SELECT c.part, s.entry, c.pos, c.x FROM c JOIN s ON c.vec_id = s.vec_id), {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
    sha AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b2),
    o AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
    SELECT o.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN e ON o.vec_id = e.vec_id CROSS JOIN sha"""

HARD_NEGATIVES = f"""
    WITH {_INTEGERS.replace("label_rule", "label IS NOT NULL")},
    r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(v AS DOUBLE[]) AS v FROM e),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank, s.id AS negative_id,
           p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    QUALIFY rank <= 3"""

MINHASH = r"""
    WITH RECURSIVE w AS (SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in generate_series(1, len(w) - 2)]) END AS s FROM w),
    g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
          GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
    t AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT t.u, p.v FROM t JOIN p ON t.v = p.u),
    c AS (SELECT u, min(v) AS component_id FROM t GROUP BY u)
    SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.u"""
