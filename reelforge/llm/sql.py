"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from reelforge.llm import sort_means as sort_means_of
from reelforge.llm import vector_codes as vector_codes_of
from reelforge.llm.secrets import RULES
from reelforge.llm.whole_vectors import limit_of

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, hex,
        list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
            lambda s: substr('{_B32}', ((('0x' || substr(hex, 5 * g + 1, 5))::BIGINT >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
        max(page_id) OVER (PARTITION BY hex) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM b
"""


def secrets() -> str:
    """Each rule's matches are fenced by two control characters; positions follow from the lengths of what lies between."""
    parts = []
    for k, r in enumerate(RULES):
        whole = f"{r.head}(?:{r.good}|{r.short})" if r.short else r.head + r.good
        good, whole = (x.replace("'", "''") for x in (r.head + r.good, whole))
        parts.append(f"""
SELECT doc_id, {k} AS k, '{r.name}' AS kind, pos AS s, pos + length(m) AS e FROM (
  SELECT doc_id, i, m, sum(CASE WHEN i = 1 THEN length(piece) ELSE length(piece) - 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)
         - (CASE WHEN i = 1 THEN length(piece) ELSE length(piece) - 1 END) AS pos FROM (
    SELECT doc_id, i, piece, CASE WHEN i > 1 THEN split_part(piece, chr(2), 1) END AS m FROM (
      SELECT doc_id, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(t, '{whole}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS pieces FROM d))))
WHERE i > 1 AND regexp_full_match(m, '{good}')""")
    base = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in RULES if r.base)
    names = ", ".join(f"'{r.name}'" for r in RULES if r.base)
    zero = ", ".join(f"coalesce(n_{r.name}, 0)::BIGINT AS n_{r.name}" for r in RULES if r.base)
    listed = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {base}, {listed} FILTER (kind IN ({names})) AS base, {listed} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""

#: Cosine links of all pairs and their components; vectors that can link with nothing stand alone.
EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), fine AS (
  SELECT rn, vec_id, e FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.rn AS a, b.rn AS b, b.vec_id FROM fine a JOIN fine b
  ON a.rn <> b.rn AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(rn, vec_id, a) AS (
  SELECT rn, vec_id, rn FROM fine
  UNION
  SELECT r.rn, p.vec_id, p.b FROM reach r JOIN pairs p ON p.a = r.a
), component AS (SELECT rn, min(vec_id) AS c FROM reach GROUP BY rn),
linked AS (SELECT a AS rn, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id,
  vec_id IS NOT DISTINCT FROM coalesce(c, vec_id) AS kept
FROM v LEFT JOIN linked USING (rn) LEFT JOIN component USING (rn)
"""

_FLOOR_MEAN = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"


def _apart(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))::BIGINT"


def _whole(scale: int, length: int) -> str:
    top = limit_of(length)
    return f"list_transform(embedding, lambda x: greatest(least(floor({scale} * x::DOUBLE), {top}), -{top})::BIGINT)"


_FINITE = "len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"


def sort_means() -> str:
    """Each round compares every vector with every centroid."""
    k, rounds, d = sort_means_of.K, sort_means_of.ROUNDS, sort_means_of.COMPONENTS
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, {_whole(sort_means_of.SCALE, d)} AS e FROM embeddings WHERE len(embedding) = {d} AND {_FINITE}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) - 1 AS k, e FROM v
  ORDER BY sha256('2:' || vec_id) NULLS LAST, e LIMIT {k}
)"""]
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT rn, min({_apart('v.e', 'c.e')}::HUGEINT * {k} + k) AS m FROM v, c{t} c GROUP BY rn
)""")
        if t < rounds:
            steps.append(f"""
c{t + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(n.e, c.e) AS e FROM c{t} c LEFT JOIN (
    SELECT k, list(x ORDER BY i) AS e FROM (
      SELECT k, i, {_FLOOR_MEAN} AS x FROM (
        SELECT (m % {k})::BIGINT AS k, unnest(range(1, {d + 1})) AS i, unnest(e) AS x FROM a{t} JOIN v USING (rn)) GROUP BY k, i) GROUP BY k
  ) n USING (k)
)""")
    return ",".join(steps) + f"""
SELECT vec_id, (m % {k})::INT AS cluster, (m // {k})::BIGINT AS distance,
  (sum(m // {k}) OVER (PARTITION BY m % {k}))::BIGINT AS cluster_inertia, (sum(m // {k}) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rn) JOIN c{rounds} c ON c.k = m % {k}
"""


def vector_codes() -> str:
    """Each round makes all sums anew; for vectors whose length the number of parts divides."""
    parts, entries, rounds = vector_codes_of.PARTS, vector_codes_of.ENTRIES, vector_codes_of.ROUNDS
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, label, len(embedding) AS d, {_whole(vector_codes_of.SCALE, 64)} AS e
  FROM embeddings WHERE embedding IS NOT NULL AND {_FINITE}
), s AS MATERIALIZED (
  SELECT rn, d, p, list_slice(e, p * d // {parts} + 1, (p + 1) * d // {parts}) AS x FROM v, range({parts}) AS q(p)
), first AS (
  SELECT rn, row_number() OVER (PARTITION BY d ORDER BY vec_id NULLS LAST, e) - 1 AS k FROM v QUALIFY k < {entries}
), c0 AS MATERIALIZED (SELECT d, p, k, x AS e FROM first JOIN s USING (rn))"""]
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT rn, s.d, s.p, min({_apart('s.x', 'c.e')}::HUGEINT * {entries} + k) AS m FROM s JOIN c{t} c ON c.d = s.d AND c.p = s.p GROUP BY ALL
)""")
        if t < rounds:
            steps.append(f"""
c{t + 1} AS MATERIALIZED (
  SELECT c.d, c.p, c.k, coalesce(n.e, c.e) AS e FROM c{t} c LEFT JOIN (
    SELECT d, p, k, list(x ORDER BY i) AS e FROM (
      SELECT d, p, k, i, {_FLOOR_MEAN} AS x FROM (
        SELECT d, p, (m % {entries})::BIGINT AS k, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM a{t} JOIN s USING (rn, d, p)) GROUP BY ALL) GROUP BY d, p, k
  ) n USING (d, p, k)
)""")
    return ",".join(steps) + f""",
sha AS (SELECT d, sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds} GROUP BY d),
r AS (SELECT rn, d, string_agg(lpad(lower(hex(m % {entries})), 2, '0'), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY rn, d)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM r JOIN v USING (rn, d) JOIN sha USING (d)
"""
