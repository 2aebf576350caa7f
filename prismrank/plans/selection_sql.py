"""SQL of the selection conditions, as steps of common table expressions over pool(query_id, rank, doc_id, score, ...).

The selection itself runs in tasks over each query's pool; this is the same by
relational means: one expression for each candidate chosen or clusters merged.
"""

from __future__ import annotations


def _unit(top: int) -> str:
    """cand(query_id, rank, doc_id, score, norm) and sim(query_id, i, j, s): scaled scores, and cosines of all candidates."""
    return """, cand AS MATERIALIZED (
  SELECT query_id, rank, doc_id, score, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS norm FROM pool WINDOW w AS (PARTITION BY query_id)
), vec AS MATERIALIZED (SELECT query_id, rank, embedding::DOUBLE[] AS v FROM pool JOIN embeddings ON vec_id = doc_id),
sim AS MATERIALIZED (SELECT a.query_id, a.rank AS i, b.rank AS j, list_cosine_similarity(a.v, b.v) AS s FROM vec a JOIN vec b USING (query_id))"""


def _result(source: str, name: str, top: int) -> str:
    """Rows of the list `picked` of each query."""
    return f"""SELECT c.query_id, '{name}' AS condition, CAST(n AS INTEGER) AS selected_rank, c.doc_id, c.rank AS original_rank, round(c.score, 6) AS native_score
FROM (SELECT query_id, unnest(picked) AS rank, generate_subscripts(picked, 1) AS n FROM {source}) x JOIN cand c ON c.query_id = x.query_id AND c.rank = x.rank WHERE n <= {top}"""


def mmr(scored: str, name: str, weight: float, top: int) -> str:
    steps = [", c1 AS MATERIALIZED (SELECT query_id, [arg_min(rank, struct_pack(a := -norm, b := rank))] AS picked FROM cand GROUP BY query_id)"]
    for n in range(2, top + 1):
        steps.append(f"""c{n} AS MATERIALIZED (SELECT query_id, list_append(any_value(picked), arg_min(rank, struct_pack(a := -gain, b := rank))) AS picked FROM (
  SELECT p.query_id, p.picked, c.rank, {weight} * any_value(c.norm) - {1 - weight} * max(s) AS gain FROM c{n - 1} p JOIN cand c ON c.query_id = p.query_id AND NOT list_contains(p.picked, c.rank) JOIN sim ON sim.query_id = p.query_id AND sim.i = c.rank AND list_contains(p.picked, sim.j) GROUP BY p.query_id, p.picked, c.rank
) GROUP BY query_id)""")
    return f"WITH {scored}{_unit(top)}{', '.join(steps)} {_result(f'c{top}', name, top)}"


def dpp_map(scored: str, name: str, top: int) -> str:
    """Greedy determinants with the rows of an incremental Cholesky factor as lists."""
    kernel = f""", quality AS MATERIALIZED (SELECT query_id, rank, exp((norm - max(norm) OVER (PARTITION BY query_id)) / 2) AS q FROM cand),
plain AS MATERIALIZED (SELECT sim.query_id, i, j, a.q * b.q * s AS l FROM sim JOIN quality a ON a.query_id = sim.query_id AND a.rank = i JOIN quality b ON b.query_id = sim.query_id AND b.rank = j),
kernel AS MATERIALIZED (SELECT query_id, i, j, l + CASE WHEN i = j THEN 1e-6 * greatest(max(abs(l)) OVER (PARTITION BY query_id), 1.0) ELSE 0 END AS l FROM plain),
g1 AS MATERIALIZED (SELECT query_id, i, l AS d, [0.0]::DOUBLE[] AS c, false AS done FROM kernel WHERE i = j)"""
    steps = []
    for n in range(1, top + 1):
        steps.append(f"p{n} AS MATERIALIZED (SELECT query_id, arg_min(i, struct_pack(a := -d, b := i)) AS j FROM g{n} WHERE NOT done GROUP BY query_id)")
        if n < top:
            steps.append(f"""g{n + 1} AS MATERIALIZED (SELECT query_id, i, d - e * e AS d, list_append(c, e) AS c, done OR i = j AS done FROM (
  SELECT g.query_id, g.i, g.d, g.c, g.done, p.j, (k.l - list_inner_product(h.c, g.c)) / sqrt(h.d) AS e FROM g{n} g JOIN p{n} p ON p.query_id = g.query_id JOIN g{n} h ON h.query_id = g.query_id AND h.i = p.j JOIN kernel k ON k.query_id = g.query_id AND k.i = p.j AND k.j = g.i))""")
    picked = f"picks AS (SELECT p1.query_id, [{', '.join(f'p{n}.j' for n in range(1, top + 1))}] AS picked FROM p1 {' '.join(f'JOIN p{n} USING (query_id)' for n in range(2, top + 1))})"
    return f"WITH {scored}{_unit(top)}{kernel}, {', '.join(steps)}, {picked} {_result('picks', name, top)}"


def agglo(scored: str, name: str, clusters: int, pool: int, top: int) -> str:
    """Ward's merges by the recurrence of Lance and Williams; a cluster is named by its least member. Then the round robin."""
    steps = [""", n1 AS MATERIALIZED (SELECT query_id, rank AS a, 1 AS n FROM cand),
d1 AS MATERIALIZED (SELECT query_id, i AS a, j AS b, 1 - s AS d FROM sim WHERE i <> j), l1 AS MATERIALIZED (SELECT query_id, rank, rank AS a FROM cand)"""]
    for k in range(1, pool - clusters + 1):
        steps.append(f"m{k} AS MATERIALIZED (SELECT query_id, arg_min(struct_pack(a := a, b := b, d := d), struct_pack(x := d, y := a, z := b)) AS m FROM d{k} WHERE a < b GROUP BY query_id)")
        steps.append(f"n{k + 1} AS MATERIALIZED (SELECT n.query_id, a, n + CASE WHEN a = m.a THEN (SELECT o.n FROM n{k} o WHERE o.query_id = n.query_id AND o.a = m.b) ELSE 0 END AS n FROM n{k} n JOIN m{k} USING (query_id) WHERE a <> m.b)")
        steps.append(f"""u{k} AS MATERIALIZED (SELECT x.query_id, x.a AS other, ((na.n + no.n) * x.d + (nb.n + no.n) * y.d - no.n * m.d) / (na.n + nb.n + no.n) AS d FROM m{k} q JOIN d{k} x ON x.query_id = q.query_id AND x.b = q.m.a AND x.a <> q.m.b JOIN d{k} y ON y.query_id = q.query_id AND y.b = q.m.b AND y.a = x.a
  JOIN n{k} na ON na.query_id = q.query_id AND na.a = q.m.a JOIN n{k} nb ON nb.query_id = q.query_id AND nb.a = q.m.b JOIN n{k} no ON no.query_id = q.query_id AND no.a = x.a)""")
        steps.append(f"""d{k + 1} AS MATERIALIZED (SELECT d.query_id, a, b, d FROM d{k} d JOIN m{k} USING (query_id) WHERE a NOT IN (m.a, m.b) AND b NOT IN (m.a, m.b)
  UNION ALL SELECT u.query_id, m.a, other, u.d FROM u{k} u JOIN m{k} USING (query_id) UNION ALL SELECT u.query_id, other, m.a, u.d FROM u{k} u JOIN m{k} USING (query_id))""")
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT l.query_id, rank, CASE WHEN l.a = m.b THEN m.a ELSE l.a END AS a FROM l{k} l JOIN m{k} USING (query_id))")
    robin = f"""turns AS (SELECT c.query_id, c.rank, row_number() OVER (PARTITION BY c.query_id, l.a ORDER BY c.norm DESC, c.rank) AS inside, row_number() OVER (PARTITION BY c.query_id ORDER BY c.norm DESC, c.rank) AS place, l.a FROM cand c JOIN l{pool - clusters + 1} l ON l.query_id = c.query_id AND l.rank = c.rank),
first AS (SELECT *, min(place) OVER (PARTITION BY query_id, a) AS priority FROM turns), picks AS (SELECT query_id, list(rank ORDER BY inside, priority) AS picked FROM first GROUP BY query_id)"""
    return f"WITH {scored}{_unit(top)}{', '.join(steps)}, {robin} {_result('picks', name, top)}"
