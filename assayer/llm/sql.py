"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from assayer.llm.secret_scan import BASE, RULES


def secret_scan(rules: tuple = RULES, base: int = len(BASE)) -> str:
    """Every rule on every text: matches from the pattern, places from the lengths of what stands before them."""
    found = " UNION ALL ".join(
        f"""
        SELECT doc_id, rid, {rank} AS rank, '{rule.kind}' AS kind,
            regexp_extract_all(t, '{_quoted(rule.pattern)}', 0) AS whole,
            regexp_extract_all(t, '{_quoted(rule.pattern)}', {rule.group}) AS deciding, {rule.least} AS least,
            list_transform(string_split_regex(t, '{_quoted(rule.pattern)}'), lambda x: length(x)) AS gaps
        FROM texts WHERE regexp_matches(t, '{_quoted(rule.pattern)}')"""
        for rank, rule in enumerate(rules)
    )
    counts = ", ".join(
        f"CAST(count(*) FILTER (kind = '{rule.kind}') AS BIGINT) AS n_{rule.kind}" for rule in rules[:base]
    )
    return f"""
    WITH texts AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
        found AS ({found}),
        matches AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found),
        placed AS (
            SELECT rid, rank, kind, length(deciding[i]) >= least AS fits, length(whole[i]) AS size,
                list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(whole[1 : i - 1], lambda x: length(x))), 0) AS start
            FROM matches),
        spans AS (
            SELECT rid, rank, kind, start, concat(kind, ':', start::BIGINT, ':', (start + size)::BIGINT) AS s FROM placed WHERE fits),
        listed AS (
            SELECT rid, {counts},
                coalesce(string_agg(s, ',' ORDER BY start, rank) FILTER (rank < {base}), '') AS base,
                string_agg(s, ',' ORDER BY start, rank) AS spans
            FROM spans GROUP BY rid)
    SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in rules[:base])},
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM texts LEFT JOIN listed USING (rid)
    """


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def vector_codes(rounds: int = 4, entries: int = 256) -> str:
    """Plain Lloyd rounds: every part against every entry, each time."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        near{k} AS MATERIALIZED (
            SELECT r.rid, r.p, min((r.n + b.n - 2 * list_inner_product(r.v, b.v))::BIGINT * {entries} + b.e) AS m
            FROM parts r JOIN book{k} b USING (p) GROUP BY r.rid, r.p),
        code{k} AS MATERIALIZED (SELECT rid, p, m % {entries} AS e, m // {entries} AS d FROM near{k})""")
        if k < rounds:
            steps.append(f"""
        mean{k} AS MATERIALIZED (
            SELECT p, e, list(s ORDER BY i) AS v FROM (
                SELECT c.p, c.e, t.i, floor(sum(r.v[t.i]) / count(*))::DOUBLE AS s
                FROM code{k} c JOIN parts r USING (rid, p), shape, unnest(range(1, w + 1)) AS t(i) GROUP BY c.p, c.e, t.i)
            GROUP BY p, e),
        book{k + 1} AS MATERIALIZED (
            SELECT p, e, v, list_inner_product(v, v) AS n FROM (
                SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (p, e)))""")
    last = rounds
    return f"""
    WITH kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q, row_number() OVER () AS rid
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        shape AS MATERIALIZED (SELECT max(len(q)) // 4 AS w FROM kept),
        parts AS MATERIALIZED (
            SELECT rid, p, v, list_inner_product(v, v) AS n FROM (
                SELECT rid, p, q[p * w + 1 : p * w + w] AS v FROM kept, shape, range(4) AS t(p))),
        first AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
        book0 AS MATERIALIZED (SELECT p, e, v, n FROM parts JOIN first USING (rid)),
        {",".join(steps)},
        digest AS (
            SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS s
            FROM book{last}),
        rows AS (
            SELECT rid, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
            FROM code{last} GROUP BY rid)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
    FROM kept JOIN rows USING (rid), digest
    """


HARD_NEGATIVES = """
    WITH used AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
            FROM used a JOIN used r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM positives JOIN scored s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
    QUALIFY row_number() OVER w <= 5
"""
