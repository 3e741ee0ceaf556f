"""DuckDB SQL for the corpus queries that SQL can express, by other routes than the operators'."""

from __future__ import annotations

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(text: str) -> str:
    values = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in FIELDS]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values) + ")"


# CRC-32 of the decimal id, bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _tree(name: str, first: str, by: str) -> str:
    return f"""{name} AS (
  {first}
  UNION ALL
  SELECT {by}, level + 1, place // 8, CAST(any_value((n + 7) // 8) AS BIGINT), sha256(string_agg(node, '' ORDER BY place))
  FROM {name} WHERE n > 1 GROUP BY {by}, level, place // 8
)"""


MERKLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, lang, {_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS told
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), {_tree("lower_tree", "SELECT lang, 0 AS level, place, n, leaf AS node FROM placed", "lang")}, subroots AS MATERIALIZED (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top, count(*) OVER () AS n FROM lower_tree WHERE n = 1
), {_tree("upper_tree", "SELECT 0 AS g, 0 AS level, top AS place, n, subroot AS node FROM subroots", "g")}, root AS (
  SELECT node AS root FROM upper_tree WHERE n = 1
), steps AS (
  SELECT p.id, s.level, string_agg(s.node, '' ORDER BY s.place) FILTER (s.place < p.place // CAST(power(8, s.level) AS BIGINT)) AS before,
    string_agg(s.node, '' ORDER BY s.place) FILTER (s.place > p.place // CAST(power(8, s.level) AS BIGINT)) AS after
  FROM placed p JOIN lower_tree s ON p.lang IS NOT DISTINCT FROM s.lang AND s.n > 1 AND s.place // 8 = p.place // CAST(power(8, s.level + 1) AS BIGINT)
  GROUP BY p.id, s.level
  UNION ALL
  SELECT p.id, 1000 + s.level, string_agg(s.node, '' ORDER BY s.place) FILTER (s.place < r.top // CAST(power(8, s.level) AS BIGINT)),
    string_agg(s.node, '' ORDER BY s.place) FILTER (s.place > r.top // CAST(power(8, s.level) AS BIGINT))
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang JOIN upper_tree s ON s.n > 1 AND s.place // 8 = r.top // CAST(power(8, s.level + 1) AS BIGINT)
  GROUP BY p.id, s.level, r.top
), paths AS (
  SELECT id, string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY level) AS proof, list(coalesce(before, '') || '|' || coalesce(after, '') ORDER BY level) AS path
  FROM steps GROUP BY id
), folded AS (
  SELECT p.*, r.subroot, root.root, sha256(coalesce(t.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(p.told, p.leaf), coalesce(t.path, [])), lambda node, step: sha256(split_part(step, '|', 1) || node || split_part(step, '|', 2))) AS folded_root
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang CROSS JOIN root LEFT JOIN paths t ON t.id = p.id
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

HARD_NEGATIVES = """
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM taken a JOIN taken b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE label <> anchor_label AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
