"""Checking SQL of the queries that SQL can express on whole tables, by plain comparison of everything."""

from __future__ import annotations


def vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Product codes: every part against every entry, in each round. Vectors of one length, a multiple of ``parts``."""
    width = f"len(v) // {parts}"
    steps = []

    def near(k: int) -> str:
        return f"""near_{k} AS MATERIALIZED (
            SELECT x.vec_id, x.p, min({{'d': x.vv + e.vv - 2 * list_inner_product(x.v, e.v), 'entry': e.entry}}) AS best
            FROM parts x JOIN book_{k} e ON x.p = e.p GROUP BY x.vec_id, x.p)"""

    for k in range(rounds):
        steps.append(near(k))
        steps.append(f"""mean_{k} AS (
            SELECT p, entry, list(m ORDER BY i) AS v FROM (
                SELECT n.p, n.best.entry AS entry, i, floor(sum(x.v[i]) / count(*)) AS m
                FROM near_{k} n JOIN parts x ON x.vec_id = n.vec_id AND x.p = n.p, unnest(range(1, len(x.v) + 1)) AS u(i)
                GROUP BY n.p, n.best.entry, i) GROUP BY p, entry),
        book_{k + 1} AS MATERIALIZED (
            SELECT p, entry, v, list_inner_product(v, v) AS vv FROM (
                SELECT b.p, b.entry, coalesce(m.v, b.v) AS v
                FROM book_{k} b LEFT JOIN mean_{k} m ON b.p = m.p AND b.entry = m.entry))""")
    return f"""
        WITH whole AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        parts AS MATERIALIZED (
            SELECT vec_id, p, v, list_inner_product(v, v) AS vv FROM (
                SELECT vec_id, p, v[p * ({width}) + 1 : (p + 1) * ({width})] AS v FROM whole, unnest(range(0, {parts})) AS u(p))),
        book_0 AS MATERIALIZED (
            SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, v, vv FROM parts
            QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}),
        {", ".join(steps)},
        {near(rounds)},
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
            FROM near_{rounds} GROUP BY vec_id),
        digest AS (
            SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY p, entry)) AS s
            FROM book_{rounds})
        SELECT w.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY w.label)::BIGINT AS label_error,
               d.s AS codebooks_sha256
        FROM whole w JOIN coded c ON w.vec_id = c.vec_id, digest d"""


# The reflected polynomial of the usual 32-bit cyclic checksum.
CRC_POLYNOMIAL = 3988292384

PREFIX_TRIE_SQL = f"""
    WITH steps AS (
        SELECT list(c ORDER BY n) AS t FROM (
            SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor({CRC_POLYNOMIAL}, c >> 1) ELSE c >> 1 END, n) AS c
            FROM unnest(range(0, 256)) AS u(n))),
    placed AS (
        SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list(said ORDER BY place) AS turns FROM placed GROUP BY conv_id),
    heads AS (
        SELECT conv_id, turns,
               xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                               lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT),
                   4294967295::BIGINT) % 6 AS h
        FROM own, steps),
    made AS (
        SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
        FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
    nodes AS MATERIALIZED (
        SELECT turns[1:d] AS prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               list(conv_id ORDER BY conv_id) FILTER (len(turns) = d) AS ends
        FROM made, unnest(range(0, len(turns) + 1)) AS u(d) GROUP BY prefix, d),
    families AS (
        SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    sized AS MATERIALIZED (
        SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM nodes n LEFT JOIN families f ON n.prefix = f.prefix),
    sums AS (
        SELECT prefix[1:d] AS prefix, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
               sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[depth].text) END)::BIGINT AS saved_tokens
        FROM sized, unnest(range(0, depth + 1)) AS u(d) GROUP BY ALL)
    SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, t.n_leaves, t.saved_tokens,
           sha256(coalesce(array_to_string(s.ends, ','), '')) AS ends_sha256
    FROM sized s JOIN sums t ON s.prefix = t.prefix LEFT JOIN nodes p ON s.depth > 0 AND p.prefix = s.prefix[1:s.depth - 1]"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

DECONTAMINATION_SQL = f"""
    WITH items AS (
        SELECT item_id, w, least(len(w), 10) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL)
        WHERE len(w) > 0),
    windows AS MATERIALIZED (
        SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS said
        FROM items, unnest(range(1, len(w) - size + 2)) AS u(k)),
    docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    places AS (
        SELECT r, s.size, k, array_to_string(w[k : k + s.size - 1], ' ') AS said
        FROM docs, (SELECT DISTINCT size FROM items) s, unnest(range(1, greatest(len(w) - s.size + 2, 1))) AS u(k)),
    met AS MATERIALIZED (
        SELECT p.r, p.k, p.size, x.item_id FROM places p JOIN windows x ON p.size = x.size AND p.said = x.said),
    hit AS (SELECT r, count(DISTINCT k + i) AS n_hit FROM met, unnest(range(0, size)) AS u(i) GROUP BY r),
    owners AS (
        SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
           sha256(coalesce(o.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
    FROM docs d LEFT JOIN hit h ON d.r = h.r LEFT JOIN owners o ON d.r = o.r"""
