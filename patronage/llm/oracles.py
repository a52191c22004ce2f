"""SQL that states the results of those training-data queries that SQL can express."""

from __future__ import annotations

from patronage.llm.slice_codes import ENTRIES, PARTS, ROUNDS, SCALE

_NEAREST = """
    SELECT vec_id, label, p, v, e, gap FROM (
        SELECT x.vec_id, x.label, x.p, x.v, y.e,
               CAST(list_inner_product(x.v, x.v) + list_inner_product(y.v, y.v) - 2 * list_inner_product(x.v, y.v) AS BIGINT) AS gap
        FROM parts x JOIN book{k} y ON x.p = y.p)
    QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY gap, e) = 1"""

_NEXT = """
    SELECT p, e, list(floor(total / n) ORDER BY j) AS v
    FROM (SELECT p, e, j, sum(x) AS total, count(*) AS n
          FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM near{k}) GROUP BY p, e, j)
    GROUP BY p, e
    UNION ALL
    SELECT p, e, v FROM book{k} WHERE (p, e) NOT IN (SELECT (p, e) FROM near{k})"""


def _slice_codes() -> str:
    steps = [
        f"""kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""parts AS MATERIALIZED (
    SELECT vec_id, label, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS v
    FROM kept, (SELECT unnest(range({PARTS})) AS p))""",
        f"""book0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts
    WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"near{k} AS MATERIALIZED ({_NEAREST.format(k=k)})")
        if k < ROUNDS:
            steps.append(f"book{k + 1} AS MATERIALIZED ({_NEXT.format(k=k)})")
    steps += [
        f"""digest AS (
    SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256
    FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM book{ROUNDS}))""",
        f"""coded AS (
    SELECT vec_id, label, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(gap) AS BIGINT) AS error
    FROM near{ROUNDS} GROUP BY vec_id, label)""",
    ]
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest"""


_TENSOR_MINHASH = r"""WITH RECURSIVE split AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(words) < 2 THEN words
        ELSE list_distinct(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) END AS shingles
    FROM split),
rows AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS MATERIALIZED (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS common
        FROM rows x JOIN rows y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
        GROUP BY x.doc_id, y.doc_id)
    WHERE 100 * common >= 80 * (n + m - common)),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON doc_id = a"""

ORACLES: dict[str, str] = {
    "op11_slice_codes": _slice_codes(),
    "op12_tensor_minhash": _TENSOR_MINHASH,
}
