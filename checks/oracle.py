"""The same results as plain SQL for DuckDB, written for clarity on small tables."""

from __future__ import annotations

BASE = """
tracking AS (
  SELECT event_id AS rid, CAST(day(ts) AS BIGINT) AS game_id, CAST(hour(ts)*60+minute(ts) AS BIGINT) AS frame,
    CASE WHEN user_id%24=0 THEN 0 WHEN user_id%24<=12 THEN 1 ELSE 2 END AS ha,
    CASE WHEN user_id%24=0 THEN 0 WHEN user_id%24<=12 THEN user_id%24 ELSE user_id%24-12 END AS no,
    value%105-52.5e0 AS x, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT)*0.68e0-34 AS y
  FROM events),
play AS (
  SELECT t.rid, t.game_id, t.frame,
    CASE WHEN e.event_type='click' THEN CAST(floor(hour(e.ts)/3.0e0)+1 AS BIGINT) ELSE 0 END AS attack_no,
    CASE WHEN e.event_type='signup' AND CAST(regexp_extract(e.props, '"k": *(-?[0-9]+)', 1) AS BIGINT)<5
      THEN '選手交代' ELSE e.event_type END AS action_name,
    t.ha, t.no AS shirt_no, CAST(t.ha AS BIGINT) AS team_id, c.c_name AS player_name
  FROM tracking t JOIN events e ON e.event_id=t.rid
  LEFT JOIN customer c ON c.c_custkey=t.ha*12+t.no AND t.ha>0),
players AS (
  SELECT CAST(k.ha*12+k.no AS BIGINT) AS rid, k.game_id, k.ha, k.no AS shirt_no,
    CAST(k.ha*12+k.no AS BIGINT) AS player_id, c.c_name AS player_name
  FROM (SELECT DISTINCT game_id, ha, no FROM tracking WHERE ha>0 AND NOT (ha=2 AND no=11)) k
  LEFT JOIN customer c ON c.c_custkey=k.ha*12+k.no),
ranges AS (
  SELECT game_id, attack_no, min(frame) AS min_frame, max(frame) AS max_frame
  FROM play WHERE attack_no>0 GROUP BY 1,2),
raw AS (
  SELECT r.attack_no, t.* FROM tracking t JOIN ranges r
  ON t.game_id=r.game_id AND t.frame BETWEEN r.min_frame AND r.max_frame),
counts AS (SELECT game_id, attack_no, ha, no, count(*) AS n_rows FROM raw GROUP BY 1,2,3,4),
changes AS (
  SELECT r.attack_no, p.* FROM (SELECT * EXCLUDE (attack_no) FROM play) p JOIN ranges r
  ON p.game_id=r.game_id AND p.frame BETWEEN r.min_frame AND r.max_frame WHERE p.action_name LIKE '%交代%'),
kept AS (
  SELECT c.* FROM counts c WHERE (c.ha=0 AND c.no=0) OR NOT EXISTS (
    SELECT 1 FROM changes s WHERE s.game_id=c.game_id AND s.attack_no=c.attack_no AND s.ha=c.ha AND s.shirt_no=c.no)),
frames AS (
  SELECT game_id, attack_no, frame,
    CAST(row_number() OVER (PARTITION BY game_id, attack_no ORDER BY frame)-1 AS BIGINT) AS frame_idx,
    count(*) OVER (PARTITION BY game_id, attack_no) AS frame_count
  FROM (SELECT DISTINCT game_id, attack_no, frame FROM raw))"""


def selected(source: str = "kept", limit: int = 12) -> str:
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY game_id, attack_no ORDER BY n_rows DESC, ha, no) AS rk,
    count(*) OVER (PARTITION BY game_id, attack_no) AS total
  FROM {source} WHERE NOT (ha=0 AND no=0)),
chosen AS (
  SELECT game_id, attack_no, ha, no, n_rows, rk AS count_rank, total>{limit} AS truncated, false AS is_ball
  FROM ranked WHERE rk<={limit}
  UNION ALL SELECT game_id, attack_no, ha, no, n_rows, 0, false, true FROM {source} WHERE ha=0 AND no=0)"""


def slab(limit: int = 12) -> str:
    return (
        BASE
        + ","
        + selected("kept", limit)
        + """,
ents AS (
  SELECT i.*, p.player_id,
    CASE WHEN i.is_ball THEN 'ball' ELSE CAST(p.player_id AS VARCHAR) END AS entity_id
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY game_id, attack_no ORDER BY is_ball DESC,
          CASE WHEN truncated THEN count_rank ELSE 0 END, ha, no)-1 AS BIGINT) AS entity_idx FROM chosen) i
  LEFT JOIN players p ON p.game_id=i.game_id AND p.ha=i.ha AND p.shirt_no=i.no),
cells AS (SELECT game_id, attack_no, frame, ha, no, arg_max(x, rid) AS x, arg_max(y, rid) AS y FROM raw GROUP BY 1,2,3,4,5),
slab AS (
  SELECT c.game_id, c.attack_no, i.entity_idx, i.is_ball, f.frame_idx, f.frame_count, c.x, c.y
  FROM cells c JOIN ents i USING (game_id, attack_no, ha, no) JOIN frames f USING (game_id, attack_no, frame)),
slots AS (SELECT CAST(unnest(range(0, 23)) AS BIGINT) AS entity_idx),
grid AS (
  SELECT a.game_id, a.attack_no, s.entity_idx, e.ha, e.no, e.is_ball, e.entity_id,
    CASE WHEN e.entity_id='ball' THEN -1 ELSE coalesce(e.player_id, 0) END AS player_code
  FROM (SELECT DISTINCT game_id, attack_no FROM ents) a CROSS JOIN slots s
  LEFT JOIN ents e ON e.game_id=a.game_id AND e.attack_no=a.attack_no AND e.entity_idx=s.entity_idx)"""
    )


PATCH = """,
thin AS (
  SELECT game_id, attack_no, entity_idx,
    CASE WHEN frame_count<2 THEN frame_idx ELSE frame_idx//2 END AS f,
    CASE WHEN frame_count<2 THEN frame_count ELSE CAST(ceil(frame_count/2.0e0) AS BIGINT) END AS n, x, y
  FROM slab WHERE frame_count<2 OR frame_idx%2=0),
cut AS (
  SELECT game_id, attack_no, entity_idx, f-greatest(n-10, 0) AS frame_idx, least(n, 10) AS frame_count, x, y
  FROM thin WHERE f>=n-10),
scale AS (
  SELECT game_id, attack_no, CASE WHEN my IS NOT NULL THEN mx*1.1e0 END AS x_scale,
    CASE WHEN mx IS NOT NULL THEN my*1.1e0 END AS y_scale
  FROM (SELECT game_id, attack_no, max(abs(x)) FILTER (x<>0) AS mx, max(abs(y)) FILTER (y<>0) AS my FROM cut GROUP BY 1,2)),
normed AS (
  SELECT c.game_id, c.attack_no, c.entity_idx, c.frame_idx,
    CASE WHEN c.x<>0 AND s.x_scale IS NOT NULL THEN c.x/s.x_scale ELSE c.x END AS x,
    CASE WHEN c.y<>0 AND s.y_scale IS NOT NULL THEN c.y/s.y_scale ELSE c.y END AS y
  FROM cut c JOIN scale s USING (game_id, attack_no)),
patch AS (
  SELECT g.game_id, g.attack_no, g.entity_idx, g.player_code, p.pos, coalesce(n.x, 0) AS x, coalesce(n.y, 0) AS y
  FROM grid g CROSS JOIN (SELECT CAST(unnest(range(0, 10)) AS BIGINT) AS pos) p
  LEFT JOIN normed n ON n.game_id=g.game_id AND n.attack_no=g.attack_no AND n.entity_idx=g.entity_idx
    AND n.frame_idx=p.pos),
steps AS (
  SELECT game_id, attack_no, entity_idx, pos, x-lag(x) OVER w AS dx, y-lag(y) OVER w AS dy
  FROM patch WINDOW w AS (PARTITION BY game_id, attack_no, entity_idx ORDER BY pos)),
valid AS (
  SELECT game_id, attack_no, entity_idx,
    CAST(bool_or(x<>0 OR y<>0) FILTER (pos>=8) AS BIGINT) AS valid FROM patch GROUP BY 1,2,3),
deltas AS (
  SELECT game_id, attack_no, entity_idx, valid, d.pos, d.value FROM (
    SELECT game_id, attack_no, entity_idx, (pos-1)*2 AS pos, dx AS value FROM steps WHERE pos>0
    UNION ALL SELECT game_id, attack_no, entity_idx, (pos-1)*2+1, dy FROM steps WHERE pos>0) d
  JOIN valid USING (game_id, attack_no, entity_idx))"""

WINDOWS = """,
lengths AS (SELECT DISTINCT game_id, attack_no, frame_count FROM frames),
wins AS (
  SELECT game_id, attack_no, CAST(w AS BIGINT) AS window_id, CAST(w*8 AS BIGINT) AS start_frame,
    least(w*8+16, frame_count) AS end_frame
  FROM (SELECT *, unnest(range(0, CASE WHEN frame_count<=16 THEN 1
          ELSE 1+CAST(ceil((frame_count-16)/8.0e0) AS BIGINT) END)) AS w FROM lengths)),
seen AS (
  SELECT w.window_id, s.* FROM slab s JOIN wins w ON w.game_id=s.game_id AND w.attack_no=s.attack_no
  AND s.frame_idx>=w.start_frame AND s.frame_idx<w.end_frame),
balls AS (SELECT game_id, attack_no, frame_idx, x AS ball_x, y AS ball_y FROM slab WHERE is_ball),
moves AS (
  SELECT s.*, sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2) AS step, sqrt((x-ball_x)**2+(y-ball_y)**2) AS ball
  FROM seen s LEFT JOIN balls USING (game_id, attack_no, frame_idx)
  WINDOW w AS (PARTITION BY s.game_id, s.attack_no, s.window_id, s.entity_idx ORDER BY s.frame_idx)),
stats AS (
  SELECT game_id, attack_no, window_id, entity_idx, count(*) AS n_observed,
    [count(*)/16.0e0, avg(x), avg(y), stddev_pop(x), stddev_pop(y), min(x), max(x), min(y), max(y),
     coalesce(avg(step), 0), coalesce(max(step), 0), coalesce(stddev_pop(step), 0), coalesce(sum(step), 0),
     sqrt((arg_max(x, frame_idx)-arg_min(x, frame_idx))**2+(arg_max(y, frame_idx)-arg_min(y, frame_idx))**2),
     coalesce(avg(ball), 0), avg(abs(x))] AS vec
  FROM moves GROUP BY 1,2,3,4),
features AS (
  SELECT w.game_id, w.attack_no, w.window_id, e.entity_idx, e.entity_id, coalesce(s.n_observed, 0) AS n_observed,
    coalesce(s.vec, list_transform(range(0, 16), lambda i: 0.0e0)) AS vec
  FROM wins w JOIN ents e USING (game_id, attack_no) LEFT JOIN stats s USING (game_id, attack_no, window_id, entity_idx))"""


def unit(v: str) -> str:
    n = f"greatest(sqrt(list_dot_product({v}, {v})), 1e-12)"
    return f"list_transform({v}, lambda u: u/{n})"


def explode(keys: str, vec: str, source: str) -> str:
    return (
        f"SELECT {keys}, CAST(i AS BIGINT) AS pos, round({vec}[i+1], 6)+0.0e0 AS value "
        f"FROM (SELECT *, unnest(range(0, len({vec}))) AS i FROM {source})"
    )


VECTORS = """
vecs AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS VARCHAR) AS label
  FROM embeddings)"""

QUESTIONS = """
qs AS (
  SELECT c_custkey AS question_id, n_name AS team,
    CASE WHEN c_custkey%7=0 THEN left(c_name, CAST(c_custkey%length(c_name) AS INT))
      || substr(c_name, CAST(c_custkey%length(c_name)+2 AS INT)) ELSE c_name END AS name
  FROM customer JOIN nation ON c_nationkey=n_nationkey)"""

SUPERVISION = """
sup AS (
  SELECT lpad(CAST(u.conv_id AS VARCHAR), 5, '0') AS id, u.conv_id, u.turn, trim(u.text) AS prompt, trim(a.text) AS target
  FROM conversations u LEFT JOIN conversations a
  ON a.conv_id=u.conv_id AND a.turn=u.turn+1 AND a.role='assistant' WHERE u.role='user')"""

SOME_LABELS = "(SELECT CAST(doc_id AS VARCHAR) AS id, CAST(quality AS VARCHAR) AS label FROM labels)"


# k-means of ten restarts: the first centres one after another, then rounds that move all centres.
def clustered(vec: str = "vec") -> str:
    draw = "((h * (2 * (r * 10 + {step}) + 1)) % 2147483647 + 0.5e0) / 2147483647"
    first, next_ = draw.format(step=0), draw.format(step="(step + 1)")
    gap = "list_distance(vec, pv) ** 2"
    return f"""{VECTORS},
p AS (SELECT id, label, {vec} AS vec, CAST('0x' || substr(md5('42|' || id), 1, 7) AS BIGINT) AS h FROM vecs),
seeds AS (
  SELECT r, 0 AS step, id, vec, h, pick, pv, {gap} AS near
  FROM (SELECT *, arg_min(id, -ln({first})) OVER (PARTITION BY r) AS pick, arg_min(vec, -ln({first})) OVER (PARTITION BY r) AS pv
    FROM p, (SELECT unnest(range(0, 10)) AS r))
  UNION ALL
  SELECT r, step + 1, id, vec, h, pick, pv, least(near, {gap})
  FROM (SELECT r, step, id, vec, h, near,
      arg_min(id, CASE WHEN near > 0 THEN -ln({next_}) / near END) OVER (PARTITION BY r) AS pick,
      arg_min(vec, CASE WHEN near > 0 THEN -ln({next_}) / near END) OVER (PARTITION BY r) AS pv
    FROM seeds WHERE step < 9)),
moves AS (
  SELECT 0 AS t, r, step AS c, any_value(pv) AS v FROM seeds GROUP BY r, step
  UNION ALL
  SELECT t + 1, r, c, CASE WHEN len(l) > 0 THEN list_transform(range(1, len(v) + 1), lambda i: list_avg(list_transform(l, lambda x: x[i]))) ELSE v END
  FROM (
    SELECT t, r, c, any_value(v) AS v, list(vec) FILTER (c = mine) AS l
    FROM (SELECT t, r, c, v, vec, arg_min(c, list_distance(vec, v)) OVER (PARTITION BY r, id) AS mine FROM moves, p WHERE t < 50)
    GROUP BY t, r, c)),
ends AS (SELECT r, c, v FROM moves WHERE t = 50),
members AS (
  SELECT r, id, label, arg_min(c, list_distance(vec, v)) AS c, min(list_distance(vec, v) ** 2) AS cost
  FROM ends, p GROUP BY r, id, label),
best AS (SELECT r FROM members GROUP BY r ORDER BY round(sum(cost), 6), r LIMIT 1),
clusters AS (
  SELECT id, label, dense_rank() OVER (ORDER BY head) - 1 AS cluster
  FROM (SELECT *, min({{'n': length(id), 'id': id}}) OVER (PARTITION BY c) AS head FROM members WHERE r = (SELECT r FROM best)))"""


NMI = """,
j AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM clusters GROUP BY 1, 2),
h AS (
  SELECT (SELECT ln(sum(n)) - sum(n*ln(n))/sum(n) FROM (SELECT sum(n) AS n FROM j GROUP BY label)) AS l,
    (SELECT ln(sum(n)) - sum(n*ln(n))/sum(n) FROM (SELECT sum(n) AS n FROM j GROUP BY cluster)) AS c,
    (SELECT ln(sum(n)) - sum(n*ln(n))/sum(n) FROM j) AS lc)
SELECT round((l + c - lc) / ((l + c) / 2), 6) AS nmi FROM h"""


# Principal components by Jacobi rotations: in each step every row of the covariance is paired with another one, as in a
# round-robin tournament, and all pairs are turned at once.
def components(width: int = 64, k: int = 16, sweeps: int = 12) -> str:
    n = width - 1
    mate = lambda c: f"CASE WHEN {c} = {n} THEN (t * {width // 2}) % {n} WHEN (t - {c} + {n}) % {n} = {c} THEN {n} ELSE (t - {c} + {n}) % {n} END"
    corner = lambda c, x, y: f"max(CASE WHEN i = {x} AND j = {y} THEN a END) OVER (PARTITION BY least({c}, {c}m))"
    lo, hi = "least({0}, {0}m)", "greatest({0}, {0}m)"
    pair = ", ".join(
        f"{corner(c, lo.format(c), lo.format(c))} AS {c}pp, {corner(c, hi.format(c), hi.format(c))} AS {c}qq, {corner(c, lo.format(c), hi.format(c))} AS {c}pq"
        for c in "ij"
    )
    tan = lambda c: f"CASE WHEN {c}pq = 0 THEN 0 ELSE CASE WHEN {c}qq >= {c}pp THEN 1 ELSE -1 END * 2 * {c}pq / (abs({c}qq - {c}pp) + sqrt(({c}qq - {c}pp) ** 2 + 4 * {c}pq ** 2)) END"
    return f"""{VECTORS},
flat AS (SELECT id, i, vec[i + 1] AS x FROM (SELECT id, vec, unnest(range(0, {width})) AS i FROM vecs)),
centred AS (SELECT id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM flat),
turned AS (
  SELECT 0 AS t, i, j, a, (i = j)::INT::DOUBLE AS v
  FROM (SELECT p.i, q.i AS j, sum(p.x * q.x) AS a FROM centred p JOIN centred q USING (id) GROUP BY p.i, q.i)
  UNION ALL
  SELECT t + 1, ti, tj, sum(fi * fj * a), sum(fv * fj * v)
  FROM (
    SELECT t, a, v,
      unnest([i, i, im, im]) AS ti, unnest([j, jm, j, jm]) AS tj,
      unnest([ic, ic, ig, ig]) AS fi, unnest([jc, jg, jc, jg]) AS fj, unnest([1, 1, 0, 0]) AS fv
    FROM (
      SELECT t, i, j, im, jm, a, v, 1 / sqrt(1 + it * it) AS ic, 1 / sqrt(1 + jt * jt) AS jc,
        CASE WHEN i < im THEN it ELSE -it END / sqrt(1 + it * it) AS ig, CASE WHEN j < jm THEN jt ELSE -jt END / sqrt(1 + jt * jt) AS jg
      FROM (SELECT *, {tan('i')} AS it, {tan('j')} AS jt
        FROM (SELECT *, {pair} FROM (SELECT *, {mate('i')} AS im, {mate('j')} AS jm FROM turned WHERE t < {sweeps * n})))))
  GROUP BY t, ti, tj),
axes AS (
  SELECT j, row_number() OVER (ORDER BY value DESC) AS place, v
  FROM (SELECT j, max(a) FILTER (i = j) AS value, list(v ORDER BY i) AS v FROM turned WHERE t = {sweeps * n} GROUP BY j)),
signed AS (
  SELECT place, list_transform(v, lambda x: x * CASE WHEN list_filter(v, lambda y: abs(y) >= list_max(list_transform(v, lambda z: abs(z))) - 1e-9)[1] < 0 THEN -1 ELSE 1 END) AS v
  FROM axes WHERE place <= {k}),
projected AS (
  SELECT id, list(list_dot_product(x, v) ORDER BY place) AS p
  FROM (SELECT id, list(x ORDER BY i) AS x FROM centred GROUP BY id), signed GROUP BY id)
"""


# The neighbour layout: one pair of tables for each of its twelve rounds.
def layout(rounds: int = 12, samples: int = 5) -> str:
    out = [
        f"""WITH RECURSIVE {knn()},{components(k=2).removeprefix(VECTORS + ",")},
flat2 AS (SELECT row_number() OVER (ORDER BY length(id), id) - 1 AS n, id, p[1] AS x, p[2] AS y FROM projected),
named AS (
  SELECT a.n AS i, b.n AS j, exp(-(distance - near) / greatest(mean - near, 1e-9)) AS w
  FROM (SELECT *, min(distance) OVER (PARTITION BY id) AS near, avg(distance) OVER (PARTITION BY id) AS mean FROM knn) k
  JOIN flat2 a ON a.id = k.id JOIN flat2 b ON b.id = neighbour),
edges AS MATERIALIZED (
  SELECT i, j, CASE WHEN count(*) = 1 THEN max(w) ELSE max(w) + min(w) - max(w) * min(w) END AS w
  FROM (SELECT i, j, w FROM named UNION ALL SELECT j, i, w FROM named) GROUP BY i, j),
y0 AS MATERIALIZED (SELECT n, 10 * x / m AS x, 10 * y / m AS y FROM flat2, (SELECT max(greatest(abs(x), abs(y))) AS m FROM flat2))"""
    ]
    for t in range(rounds):
        far = "((a.x - b.x) ** 2 + (a.y - b.y) ** 2)"
        cut = lambda e: f"greatest(least({e}, 4), -4)"
        push = lambda c: f"sum({cut(f'2 * (a.{c} - b.{c}) / ((0.1 + {far}) * (1 + {far}))')}) / {samples} AS q{c}"
        pull = lambda c: f"sum(-2 * w * (a.{c} - b.{c}) / (1 + {far})) / sum(w) AS p{c}"
        out.append(
            f"""y{t + 1} AS MATERIALIZED (
  SELECT y.n, x + {1 - t / rounds!r} * {cut('coalesce(px, 0) + qx')} AS x, y + {1 - t / rounds!r} * {cut('coalesce(py, 0) + qy')} AS y
  FROM y{t} y
  JOIN (SELECT a.n, {push('x')}, {push('y')} FROM (SELECT *, unnest(range(0, {samples})) AS s FROM y{t}) a
    JOIN y{t} b ON b.n = (a.n + 1) * (2 * ({t * samples} + s) + 1) * 48271 % 2147483647 % (SELECT count(*) FROM flat2) GROUP BY a.n) q ON q.n = y.n
  LEFT JOIN (SELECT i, {pull('x')}, {pull('y')} FROM edges JOIN y{t} a ON a.n = i JOIN y{t} b ON b.n = j GROUP BY i) p ON p.i = y.n)"""
        )
    return ",\n".join(out) + (
        f" SELECT id, round(y.x, 6)+0.0e0 AS x, round(y.y, 6)+0.0e0 AS y, n % greatest((SELECT count(*) FROM flat2) // 50, 1) = 0 AS show_label "
        f"FROM y{rounds} y JOIN flat2 USING (n)"
    )


# The matching-block ratio by recursion: a pair of texts is split at its longest common piece, and both sides go on.
_SIZES = "list_filter(range(1, least(length(a), length(b)) + 1), lambda n: len(list_filter(range(1, length(a) - n + 2), lambda i: contains(b, substr(a, i, n)))) > 0)"
RESOLVE = f"""
WITH RECURSIVE {QUESTIONS},
r AS (SELECT CAST(c_custkey AS VARCHAR) AS id, trim(c_name) AS name, lower(n_name) AS team, c_mktsegment||'-'||c_custkey AS alt
  FROM customer JOIN nation ON c_nationkey=n_nationkey),
hits AS (
  SELECT q.question_id, q.team, q.name, min(CAST(r.id AS BIGINT)) FILTER (lower(r.name)=lower(q.name) OR lower(r.alt)=lower(q.name)) AS exact_id,
    count(*) FILTER (contains(lower(r.name), lower(q.name)) OR contains(lower(r.alt), lower(q.name))) AS n,
    min(r.id) FILTER (contains(lower(r.name), lower(q.name)) OR contains(lower(r.alt), lower(q.name))) AS part_id
  FROM qs q JOIN r ON contains(r.team, lower(q.team)) GROUP BY ALL),
labs AS (SELECT id, team, name AS label, 0 AS kind FROM r UNION ALL SELECT id, team, alt, 1 FROM r),
pairs AS (
  SELECT DISTINCT h.name, l.label FROM hits h JOIN labs l ON contains(l.team, lower(h.team))
  WHERE exact_id IS NULL AND n<>1 AND 2.0*least(length(h.name), length(l.label)) >= 0.75*(length(h.name)+length(l.label))),
seg AS (
  SELECT name, label, label AS a, name AS b FROM pairs
  UNION ALL
  SELECT name, label, unnest([substr(a, 1, i-1), substr(a, i+n, length(a))]), unnest([substr(b, 1, j-1), substr(b, j+n, length(b))])
  FROM (
    SELECT *, position(substr(a, i, n) IN b) AS j
    FROM (SELECT *, list_filter(range(1, length(a)-n+2), lambda i: contains(b, substr(a, i, n)))[1] AS i
      FROM (SELECT *, coalesce(list_max({_SIZES}), 0) AS n FROM seg) WHERE n>0))),
ratios AS (
  SELECT name, label, 2.0e0*sum(coalesce(list_max({_SIZES}), 0))/(length(name)+length(label)) AS score
  FROM seg GROUP BY name, label HAVING score>=0.75),
near AS (
  SELECT h.question_id, l.id, row_number() OVER (
    PARTITION BY h.question_id ORDER BY s.score DESC, l.label DESC, l.kind, length(l.id), l.id) AS place
  FROM hits h JOIN ratios s ON s.name=h.name JOIN labs l ON l.label=s.label AND contains(l.team, lower(h.team))
  WHERE exact_id IS NULL AND n<>1)
SELECT h.question_id,
  CASE WHEN exact_id IS NOT NULL THEN CAST(exact_id AS VARCHAR) WHEN n=1 THEN part_id ELSE c.id END AS player_id,
  CAST(CASE WHEN exact_id IS NOT NULL THEN 1 WHEN n=1 THEN 2 WHEN c.id IS NOT NULL THEN 3 END AS BIGINT) AS stage
FROM hits h LEFT JOIN near c ON c.question_id=h.question_id AND c.place=1"""

SPACES = {"style": "vec", "baseline_p": "list_transform(vec, lambda x, i: x * ((i - 1) % 3 + 1))"}


def knn(metric: str = "cosine", space: str = "style") -> str:
    vec = SPACES[space]
    if metric == "cosine":
        prepared, dist = unit(vec), "1-list_dot_product(a.v, b.v)"
    else:
        prepared, dist = vec, "list_distance(a.v, b.v)"
    return (
        VECTORS
        + f""",
space AS (SELECT id, label, {prepared} AS v FROM vecs),
pairs AS (
  SELECT a.id, a.label, b.id AS neighbour, b.label AS neighbour_label, round({dist}, 12) AS distance
  FROM space a JOIN space b ON a.id<>b.id),
knn AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, length(neighbour), neighbour) AS rank
  FROM pairs QUALIFY rank<=10)"""
    )


PURITY = "SELECT round(sum(CASE WHEN label=neighbour_label THEN 1 ELSE 0 END)/count(*), 6) AS neighbor_purity FROM knn"
SILHOUETTE = """,
means AS (SELECT id, label, neighbour_label AS other, avg(distance) AS d FROM pairs GROUP BY 1,2,3),
ab AS (SELECT id, max(d) FILTER (label=other) AS a, min(d) FILTER (label<>other) AS b FROM means GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b-a)/greatest(a, b) END), 6) AS silhouette FROM ab"""

NCE = """,
sims AS (
  SELECT a.batch_id, a.k, a.p, b.p AS pos, list_dot_product(a.v, b.v)/0.07e0 AS sim
  FROM placed a JOIN placed b ON a.batch_id=b.batch_id),
losses AS (SELECT batch_id, k, ln(sum(exp(sim-m)))+any_value(m)-sum(sim) FILTER (p=pos) AS loss
  FROM (SELECT *, max(sim) OVER (PARTITION BY batch_id, k) AS m FROM sims) GROUP BY 1,2)"""
PLACED = (
    VECTORS
    + """,
placed AS (SELECT vec_id AS k, vec AS v, (row_number() OVER (ORDER BY vec_id)-1)//64 AS batch_id,
  (row_number() OVER (ORDER BY vec_id)-1)%64 AS p FROM vecs)"""
)

PREFIX_NAME = "選手名: "
REQUEST = "この選手のプレースタイルや特徴、強み、代表的なプレー例を簡潔に説明してください。"

DENSE = """
SELECT f.game_id, f.attack_no, s.entity_idx, f.frame_idx, f.frame, d.x, d.y
FROM frames f CROSS JOIN slots s LEFT JOIN slab d ON d.game_id=f.game_id AND d.attack_no=f.attack_no
  AND d.entity_idx=s.entity_idx AND d.frame_idx=f.frame_idx"""

ATT = "game_id, attack_no"

# Eight fixed kernels of three taps on x and on y over windows of 16 frames, dilated by 1, 2 and 4.
_DRAW = "(({} + 1) * 48271 % 2147483647 * 48271 % 2147483647) / 2147483647.0e0 * 2 - 1"
KERNELS = f""",
paths AS (
  SELECT {ATT}, window_id, start_frame, entity_idx, count(*) AS n_observed, map_from_entries(list((frame_idx-start_frame, {{'x': x, 'y': y}}))) AS m
  FROM seen JOIN wins USING ({ATT}, window_id) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1,2,3,4,5),
filled AS (
  SELECT {ATT}, window_id, entity_idx, n_observed, unnest(range(0, 8)) AS k,
    list_transform(range(0, 16), lambda i: coalesce(m[i].x, 0.0e0)) AS xs, list_transform(range(0, 16), lambda i: coalesce(m[i].y, 0.0e0)) AS ys
  FROM paths),
raw_taps AS (
  SELECT k, CAST(1 << (k%3) AS BIGINT) AS d, list_transform(range(0, 3), lambda j: {_DRAW.format('(k*7+j)')}) AS wx,
    list_transform(range(3, 6), lambda j: {_DRAW.format('(k*7+j)')}) AS wy, ({_DRAW.format('(k*7+6)')})/10 AS b
  FROM (SELECT unnest(range(0, 8)) AS k)),
taps AS (SELECT k, d, b, list_transform(wx, lambda w: w-list_avg(wx)) AS wx, list_transform(wy, lambda w: w-list_avg(wy)) AS wy FROM raw_taps),
answers AS (
  SELECT f.*, list_transform(range(1, 17-2*d), lambda i: wx[1]*xs[i]+wx[2]*xs[i+d]+wx[3]*xs[i+2*d]+wy[1]*ys[i]+wy[2]*ys[i+d]+wy[3]*ys[i+2*d]+b) AS a
  FROM filled f JOIN taps USING (k)),
pooled AS (
  SELECT {ATT}, window_id, entity_idx, n_observed,
    list_concat(list(list_max(a) ORDER BY k), list(len(list_filter(a, lambda v: v>0))/CAST(len(a) AS DOUBLE) ORDER BY k)) AS vec
  FROM answers GROUP BY 1,2,3,4,5),
wide AS (
  SELECT w.game_id, w.attack_no, w.window_id, e.entity_idx, e.entity_id, coalesce(p.n_observed, 0) AS n_observed,
    coalesce(p.vec, list_transform(range(0, 16), lambda i: 0.0e0)) AS vec
  FROM wins w JOIN ents e USING ({ATT}) LEFT JOIN pooled p USING ({ATT}, window_id, entity_idx))"""

# Least squares by elimination: 16 statistics and an intercept against the 18 steps, one column of the system a step.
HEAD = f""",
latest AS (SELECT {ATT}, entity_idx, arg_max(vec, window_id) AS vec FROM features GROUP BY 1,2,3),
obs AS (
  SELECT list_concat(list_append({unit('any_value(vec)')}, 1.0e0), list(value ORDER BY pos)) AS z
  FROM deltas JOIN latest USING ({ATT}, entity_idx) WHERE valid=1 GROUP BY {ATT}, entity_idx),
cross_ AS (SELECT z, i, unnest(range(0, 35)) AS j FROM (SELECT z, unnest(range(0, 35)) AS i FROM obs)),
sums AS MATERIALIZED (SELECT i, j, sum(z[i+1]*z[j+1]) AS a, count(*) AS n FROM cross_ GROUP BY i, j),
solved AS (
  SELECT 0 AS t, i, j, a FROM sums WHERE i<17
  UNION ALL
  SELECT t+1, i, j, CASE WHEN piv<1e-9 THEN CASE WHEN i=t THEN 0 ELSE a END WHEN i=t THEN a/piv ELSE a-below*beside/piv END
  FROM (SELECT *, max(CASE WHEN i=t AND j=t THEN a END) OVER () AS piv, max(CASE WHEN i=t THEN a END) OVER (PARTITION BY j) AS beside,
      max(CASE WHEN j=t THEN a END) OVER (PARTITION BY i) AS below FROM solved WHERE t<17))
SELECT round(((SELECT sum(a) FROM sums WHERE i>=17 AND i=j)
  - (SELECT sum(c.a*s.a) FROM solved c JOIN sums s ON s.i=c.i AND s.j=c.j WHERE c.t=17 AND c.j>=17)) / (18*(SELECT max(n) FROM sums)), 6)+0.0e0 AS masked_mse"""


def _sql() -> dict[str, str]:
    base, scene = f"WITH {BASE}\n", f"WITH {slab()}\n"
    patch, win = f"WITH {slab()}{PATCH}\n", f"WITH {slab()}{WINDOWS}\n"
    vec = f"WITH {VECTORS}\n"
    big_status = (
        f"WITH {slab(22)}, status AS (SELECT r.game_id, r.attack_no, "
        "CASE WHEN n=23 THEN 'ok' ELSE 'error' END AS status, "
        "CASE WHEN n=23 THEN '' ELSE 'incomplete_entities' END AS reason "
        "FROM ranges r LEFT JOIN (SELECT game_id, attack_no, count(*) AS n FROM ents GROUP BY 1,2) USING (game_id, attack_no))\n"
    )
    profile = [("rid", "bigint"), ("game_id", "bigint"), ("frame", "bigint"), ("ha", "int"), ("no", "int"), ("x", "double"), ("y", "double")]
    profile_play = [
        ("rid", "bigint"), ("game_id", "bigint"), ("frame", "bigint"), ("attack_no", "bigint"), ("action_name", "string"),
        ("ha", "int"), ("shirt_no", "int"), ("team_id", "bigint"), ("player_name", "string"),
    ]
    rows = [("tracking", i, n, t) for i, (n, t) in enumerate(profile)]
    rows += [("play", i, n, t) for i, (n, t) in enumerate(profile_play)]
    values = ", ".join(f"('{a}', CAST({i} AS BIGINT), '{n}', '{t}')" for a, i, n, t in rows)
    split = (
        "split AS (SELECT *, CASE WHEN p<floor(n*0.7e0) THEN 'train' WHEN p<floor(n*0.7e0)+floor(n*0.2e0) THEN 'val' "
        "ELSE 'test' END AS split FROM (SELECT game_id, attack_no, count(*) OVER () AS n, row_number() OVER "
        "(ORDER BY md5('42|'||game_id||'|'||attack_no))-1 AS p FROM ranges))"
    )
    r2 = "round(x, 6) AS x"
    return {
        "read_tracking_star": base
        + "SELECT 'tracking' AS t, rid, game_id, frame, CAST(ha AS BIGINT) AS ha, CAST(no AS BIGINT) AS no, round(x, 6) AS x FROM tracking "
        "UNION ALL SELECT 'play', rid, game_id, frame, ha, shirt_no, NULL FROM play "
        "UNION ALL SELECT 'players', rid, game_id, player_id, ha, shirt_no, NULL FROM players",
        "require_sources": "SELECT 'events' AS source, count(*) AS n_rows FROM events UNION ALL "
        "SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'embeddings', count(*) FROM embeddings",
        "table_profile": f"SELECT v.t AS table_name, v.i AS ordinal, v.n AS column_name, v.k AS column_type, "
        f"(SELECT count(*) FROM events) AS n_rows FROM (VALUES {values}) v(t, i, n, k)",
        "normalise_columns": base
        + "SELECT rid, CAST(game_id AS VARCHAR) AS game_id, CAST(ha AS VARCHAR) AS ha, CAST(shirt_no AS VARCHAR) AS shirt_no, "
        "CAST(player_id AS VARCHAR) AS player_id FROM players",
        "write_attacks": scene + f"SELECT game_id, attack_no, entity_idx, frame_idx, {r2}, round(y, 6) AS y FROM ({DENSE})",
        "build_all_attacks": big_status + "SELECT * FROM status",
        "attack_status_summary": big_status + "SELECT status, reason, count(*) AS n_attacks FROM status GROUP BY 1,2",
        "load_attack": scene
        + f"SELECT d.entity_idx, g.entity_id, d.frame_idx, d.frame, round(d.x, 6) AS x, round(d.y, 6) AS y FROM ({DENSE}) d "
        "JOIN grid g USING (game_id, attack_no, entity_idx) WHERE (game_id, attack_no) IN "
        "(SELECT (game_id, attack_no) FROM ranges ORDER BY md5('42|'||game_id||'|'||attack_no) LIMIT 1)",
        "list_attacks": base
        + "SELECT game_id, attack_no, printf('attack_%d_%04d', game_id, attack_no) AS stem FROM ranges ORDER BY stem LIMIT 100",
        "feather_source": scene
        + f"SELECT game_id, attack_no, entity_idx, g.entity_id, count(*) AS n_rows, count(x) AS n_seen, round(sum(x), 6) AS sum_x "
        f"FROM ({DENSE}) d JOIN grid g USING (game_id, attack_no, entity_idx) GROUP BY 1,2,3,4",
        "read_embeddings_csv": vec
        + explode("id", "v", "(SELECT id, list_filter(vec, lambda u: abs(u)>=0.005) AS v FROM vecs)"),
        "write_embeddings_csv": vec + explode("id", "vec", "vecs"),
        "read_roster": "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, n_name AS team, "
        "lower(c_mktsegment)||'-'||c_custkey AS alts, lower(c_name) AS name_lc, lower(n_name) AS team_lc "
        "FROM customer JOIN nation ON c_nationkey=n_nationkey",
        "read_labels": "SELECT CAST(doc_id%100 AS VARCHAR) AS id, CAST(arg_max(quality, doc_id) AS VARCHAR) AS label FROM labels GROUP BY doc_id%100",
        "read_supervision": f"WITH {SUPERVISION} SELECT id, prompt, target FROM sup WHERE prompt<>'' AND target<>''",
        "read_manifest": base
        + "SELECT 'patch/'||game_id||'/'||ha AS path, list_aggregate(list_transform(list_concat(ids, repeat([CAST(0 AS BIGINT)], 23))[1:23], "
        "lambda i: CAST(i AS VARCHAR)), 'string_agg', ' ') AS player_ids, CAST(ha AS BIGINT) AS team_id "
        "FROM (SELECT game_id, ha, list_sort(list_distinct(list(CAST(ha*12+no AS BIGINT)))) AS ids FROM tracking GROUP BY 1,2)",
        "attack_rows": base + "SELECT rid, game_id, attack_no, frame FROM play WHERE attack_no>0",
        "substitution_events": base
        + "SELECT game_id, frame, player_name, CAST(shirt_no AS BIGINT) AS shirt_no, CAST(ha AS BIGINT) AS ha, team_id FROM play WHERE action_name LIKE '%交代%'",
        "play_of_attack": base + "SELECT rid, game_id, attack_no, frame FROM play WHERE game_id=3 AND attack_no=4",
        "frame_slice": base
        + f"SELECT rid, frame, CAST(ha AS BIGINT) AS ha, CAST(no AS BIGINT) AS no, {r2} FROM tracking WHERE game_id=3 AND frame BETWEEN 300 AND 700",
        "player_rows_only": scene + f"SELECT {ATT}, entity_idx, entity_id FROM ents WHERE entity_id<>'ball'",
        "valid_shape_only": scene + f"SELECT {ATT}, count(*) AS n_rows FROM slab GROUP BY 1,2",
        "project_columns": base + "SELECT frame, player_name FROM play",
        "attack_slab": base
        + f"SELECT {ATT}, rid, frame, CAST(ha AS BIGINT) AS ha, CAST(no AS BIGINT) AS no, {r2}, round(y, 6) AS y FROM raw",
        "entity_ids": scene + f"SELECT {ATT}, entity_idx, CAST(ha AS BIGINT) AS ha, CAST(no AS BIGINT) AS no, entity_id FROM ents",
        "drop_substituted": base + f"SELECT {ATT}, CAST(ha AS BIGINT) AS ha, CAST(no AS BIGINT) AS no, n_rows FROM kept",
        "enrich_tracking": base
        + "SELECT t.rid, t.game_id, CAST(t.ha AS BIGINT) AS ha, CAST(t.no AS BIGINT) AS no, n.player_name, p.player_id FROM tracking t "
        "LEFT JOIN (SELECT game_id, ha, shirt_no, min(player_name) AS player_name FROM play GROUP BY 1,2,3) n "
        "ON n.game_id=t.game_id AND n.ha=t.ha AND n.shirt_no=t.no "
        "LEFT JOIN players p ON p.game_id=t.game_id AND p.ha=t.ha AND p.shirt_no=t.no AND p.player_name=n.player_name",
        "labelled_vectors": vec + explode("id, label", "vec", f"(SELECT v.id, l.label, v.vec FROM vecs v JOIN {SOME_LABELS} l ON l.id=v.id)"),
        "lookup_vector": f"WITH {VECTORS}, {SUPERVISION} "
        + explode("id, turn, vector_id", "vec", "(SELECT s.id, s.turn, v.id AS vector_id, v.vec FROM sup s JOIN vecs v ON v.vec_id=s.conv_id)"),
        "resolve_player_exact": f"WITH {QUESTIONS}, r AS (SELECT CAST(c_custkey AS VARCHAR) AS id, lower(c_name) AS name, "
        "lower(n_name) AS team, lower(c_mktsegment)||'-'||c_custkey AS alt FROM customer JOIN nation ON c_nationkey=n_nationkey), "
        "hits AS (SELECT q.question_id, min(CAST(r.id AS BIGINT)) FILTER (r.name=lower(q.name) OR r.alt=lower(q.name)) AS exact_id, "
        "count(*) FILTER (contains(r.name, lower(q.name)) OR contains(r.alt, lower(q.name))) AS n, "
        "min(r.id) FILTER (contains(r.name, lower(q.name)) OR contains(r.alt, lower(q.name))) AS part_id "
        "FROM qs q JOIN r ON contains(r.team, lower(q.team)) GROUP BY 1) "
        "SELECT question_id, CASE WHEN exact_id IS NOT NULL THEN CAST(exact_id AS VARCHAR) WHEN n=1 THEN part_id END AS player_id, "
        "CAST(CASE WHEN exact_id IS NOT NULL THEN 1 WHEN n=1 THEN 2 END AS BIGINT) AS stage FROM hits",
        "resolve_player": RESOLVE,
        "knn_pairs": f"WITH {knn()} SELECT id, rank, neighbour, round(distance, 6) AS distance FROM knn",
        "kmeans_labels": f"WITH RECURSIVE {clustered()} SELECT id, label, CAST(cluster AS BIGINT) AS cluster FROM clusters",
        "knn_index": f"WITH {knn()} SELECT id, rank, neighbour, round(distance, 6) AS distance FROM knn",
        "knn_recall": f"WITH {knn()} SELECT count(*) AS pairs, true AS reached FROM knn",
        "knn_pairs_euclidean": f"WITH {knn('euclidean')} SELECT id, rank, neighbour, round(distance, 6) AS distance FROM knn",
        "batch_similarity": f"WITH {PLACED}{NCE} SELECT batch_id, k AS vec_id, CAST(pos AS BIGINT) AS pos, round(sim, 6)+0.0e0 AS sim FROM sims",
        "supervision_with_vectors": f"WITH {VECTORS}, {SUPERVISION} SELECT s.id, s.prompt, s.target, CAST(256 AS BIGINT) AS width, "
        f"round(list_sum(list_transform({unit('v.vec')}, lambda x, i: x * i)), 6)+0.0e0 AS weighted FROM sup s JOIN vecs v ON v.vec_id=s.conv_id WHERE s.prompt<>'' AND s.target<>''",
        "row_and_batch_count": "SELECT count(*) AS n_rows, CAST(ceil(count(*)/32.0e0) AS BIGINT) AS n_batches FROM events",
        "attack_count": base + "SELECT count(DISTINCT (attack_no, game_id)) AS attack_count FROM play WHERE attack_no>0",
        "attack_list": base + f"SELECT {ATT} FROM ranges",
        "attack_ranges": base + "SELECT * FROM ranges",
        "entity_frame_counts": base + f"SELECT {ATT}, CAST(ha AS BIGINT) AS ha, CAST(no AS BIGINT) AS no, n_rows FROM counts",
        "attack_meta": scene
        + "SELECT r.game_id, r.attack_no, min_frame, max_frame, f.frame_count, CAST(23 AS BIGINT) AS tensor_shape_0, "
        "f.frame_count AS tensor_shape_1, CAST(2 AS BIGINT) AS tensor_shape_2, CAST(23 AS BIGINT) AS entities_count, g.entities "
        f"FROM ranges r JOIN (SELECT {ATT}, count(*) AS frame_count FROM frames GROUP BY 1,2) f USING ({ATT}) "
        f"JOIN (SELECT {ATT}, string_agg(coalesce(entity_id, 'None'), ',' ORDER BY entity_idx) AS entities FROM grid GROUP BY 1,2) g USING ({ATT})",
        "attack_frames": base
        + "SELECT f.*, round(b.x, 6) AS ball_x, round(b.y, 6) AS ball_y FROM frames f LEFT JOIN ("
        f"SELECT {ATT}, frame, arg_max(x, rid) AS x, arg_max(y, rid) AS y FROM raw WHERE ha=0 AND no=0 GROUP BY 1,2,3) b "
        f"USING ({ATT}, frame)",
        "patch_scale": patch + f"SELECT {ATT}, round(x_scale, 6) AS x_scale, round(y_scale, 6) AS y_scale FROM scale",
        "player_mean_vectors": win
        + f", flat AS (SELECT entity_id, i, {unit('vec')}[i+1] AS u FROM (SELECT *, unnest(range(0, 16)) AS i FROM features "
        "WHERE entity_id<>'ball')) SELECT entity_id AS id, CAST(i AS BIGINT) AS pos, round(avg(u), 6)+0.0e0 AS value FROM flat GROUP BY 1,2",
        "masked_mse": patch
        + "SELECT round(sum(e*valid)/greatest(sum(valid), 1), 6) AS masked_mse FROM "
        f"(SELECT {ATT}, entity_idx, valid, sum((value-(pos+1)*0.001e0)**2)/18 AS e FROM deltas GROUP BY 1,2,3,4)",
        "info_nce": f"WITH {PLACED}{NCE} SELECT round(avg(loss), 6) AS info_nce FROM losses",
        "neighbor_purity": f"WITH {knn()} {PURITY}",
        "nmi": vec
        + ", c AS (SELECT label AS l, (CASE WHEN vec[1]>0 THEN 2 ELSE 0 END)+(CASE WHEN vec[2]>0 THEN 1 ELSE 0 END) AS c FROM vecs), "
        "j AS (SELECT l, c, count(*)/(SELECT count(*) FROM c) AS p FROM c GROUP BY 1,2), "
        "a AS (SELECT l, sum(p) AS p FROM j GROUP BY 1), b AS (SELECT c, sum(p) AS p FROM j GROUP BY 1) "
        "SELECT round((SELECT sum(j.p*ln(j.p/(a.p*b.p))) FROM j JOIN a USING (l) JOIN b USING (c)) / "
        "((SELECT -sum(p*ln(p)) FROM a)/2+(SELECT -sum(p*ln(p)) FROM b)/2), 6) AS nmi",
        "split_sizes": base
        + f", {split} SELECT split, count(*) AS n_rows, round(count(*)/any_value(n), 6) AS share FROM split GROUP BY 1",
        "frame_index": base + f"SELECT {ATT}, frame, frame_idx FROM frames",
        "first_substitution": base
        + f"SELECT {ATT}, CAST(ha AS BIGINT) AS ha, CAST(shirt_no AS BIGINT) AS shirt_no, frame AS substitution_frame, team_id, player_name FROM changes "
        f"QUALIFY row_number() OVER (PARTITION BY {ATT}, ha, shirt_no ORDER BY frame, team_id, player_name)=1",
        "select_entities": f"WITH {BASE}, {selected('counts')} SELECT {ATT}, CAST(ha AS BIGINT) AS ha, CAST(no AS BIGINT) AS no, n_rows, "
        "count_rank, CAST(truncated AS BIGINT) AS truncated FROM chosen",
        "entity_index": scene + f"SELECT {ATT}, entity_idx, CAST(ha AS BIGINT) AS ha, CAST(no AS BIGINT) AS no FROM grid",
        "frame_deltas": patch + f"SELECT {ATT}, entity_idx, valid, pos, round(value, 6)+0.0e0 AS value FROM deltas",
        "keep_last_frames": patch + f"SELECT {ATT}, entity_idx, frame_idx, frame_count, {r2}, round(y, 6)+0.0e0 AS y FROM cut",
        "sliding_windows": win + "SELECT * FROM wins",
        "batch_id": "SELECT event_id AS rid, CAST((row_number() OVER (ORDER BY event_id)-1)//32 AS BIGINT) AS batch_id FROM events",
        "last_wins": base
        + "SELECT game_id, frame, CAST(ha AS BIGINT) AS ha, CAST(no AS BIGINT) AS no, round(arg_max(x, rid), 6) AS x, max(rid) AS rid FROM tracking GROUP BY game_id, frame, ha, no",
        "player_order": scene + "SELECT DISTINCT entity_id AS id FROM ents WHERE entity_id<>'ball'",
        "page": base + "SELECT rid, game_id, frame FROM tracking ORDER BY rid LIMIT 32 OFFSET 224",
        "stored_page": base + "SELECT rid, game_id, frame FROM tracking ORDER BY rid LIMIT 32 OFFSET 224",
        "sample_rows": base + "SELECT rid, game_id, frame FROM tracking ORDER BY md5('42|'||rid) LIMIT 32",
        "sample_attack": base + f"SELECT {ATT} FROM ranges ORDER BY md5('42|'||game_id||'|'||attack_no) LIMIT 1",
        "train_val_test_split": base + f", {split} SELECT {ATT}, split FROM split",
        "head": base + "SELECT rid, game_id, frame FROM tracking ORDER BY game_id, frame, rid LIMIT 10",
        "name_pool": "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS label, CAST(0 AS BIGINT) AS kind FROM customer "
        "UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_mktsegment||'-'||c_custkey, 1 FROM customer",
        "common_ids": vec + f"SELECT id FROM vecs INTERSECT SELECT id FROM {SOME_LABELS}",
        "unlabelled_ids": vec + f"SELECT id FROM vecs EXCEPT ALL SELECT id FROM {SOME_LABELS}",
        "missing_vectors": "SELECT lpad(CAST(doc_id AS VARCHAR), 6, '0') AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
        "distinct_labels": vec + "SELECT label, row_number() OVER (ORDER BY label)-1 AS code FROM (SELECT DISTINCT label FROM vecs)",
        "attack_stem": base + f"SELECT {ATT}, printf('attack_%d_%04d', game_id, attack_no) AS stem FROM ranges",
        "zero_fill": base + "SELECT rid, CASE WHEN x>0 THEN round(x, 6) ELSE 0.0e0 END AS x FROM tracking",
        "thin_frames": scene
        + f"SELECT {ATT}, entity_idx, CASE WHEN frame_count<5 THEN frame_idx ELSE frame_idx//5 END AS frame_idx, "
        f"CASE WHEN frame_count<5 THEN frame_count ELSE CAST(ceil(frame_count/5.0e0) AS BIGINT) END AS frame_count, {r2}, round(y, 6)+0.0e0 AS y "
        "FROM slab WHERE frame_count<5 OR frame_idx%5=0",
        "pad_crop_patch": patch
        + f"SELECT {ATT}, entity_idx, pos, round(x, 6)+0.0e0 AS x, round(y, 6)+0.0e0 AS y FROM patch UNION ALL "
        f"SELECT {ATT}, entity_idx, CAST(unnest(range(10, 14)) AS BIGINT), 0.0e0, 0.0e0 FROM grid",
        "pad_window": win
        + f"SELECT k.game_id, k.attack_no, k.window_id, k.entity_idx, k.pos, round(coalesce(s.x, 0), 6)+0.0e0 AS x, round(coalesce(s.y, 0), 6)+0.0e0 AS y FROM "
        f"(SELECT DISTINCT {ATT}, window_id, entity_idx, CAST(p AS BIGINT) AS pos FROM (SELECT *, unnest(range(0, 16)) AS p FROM seen)) k "
        "LEFT JOIN seen s ON s.game_id=k.game_id AND s.attack_no=k.attack_no AND s.window_id=k.window_id "
        "AND s.entity_idx=k.entity_idx AND s.frame_idx=k.window_id*8+k.pos",
        "normalise_coords": patch + f"SELECT {ATT}, entity_idx, frame_idx, round(x, 6) AS x, round(y, 6) AS y FROM normed",
        "patches": patch + f"SELECT {ATT}, entity_idx, player_code, pos, round(x, 6)+0.0e0 AS x, round(y, 6)+0.0e0 AS y FROM patch",
        "player_code": scene + f"SELECT {ATT}, entity_idx, player_code FROM grid",
        "parse_list_text": scene + f"SELECT {ATT}, entity_idx AS pos, entity_id AS item FROM grid",
        "strip_casefold": "SELECT c_custkey, lower(c_name) AS name FROM customer",
        "split_aliases": "SELECT c_custkey, CAST(0 AS BIGINT) AS pos, c_mktsegment AS alias FROM customer "
        "UNION ALL SELECT c_custkey, 1, c_name FROM customer",
        "parse_question": f"WITH {QUESTIONS} SELECT question_id, team, name FROM qs",
        "prompt_text": f"WITH {QUESTIONS} SELECT question_id, CASE question_id%3 "
        f"WHEN 0 THEN '選手名: '||name||chr(10)||'{REQUEST}'||chr(10)||'質問: '||name||'選手について' "
        f"WHEN 1 THEN '{REQUEST}'||chr(10)||'質問: 教えて' "
        f"ELSE '選手名: '||name||'、チーム: '||team||chr(10)||'{REQUEST}'||chr(10)||'質問: '||team||'の'||name||'選手について' END AS prompt FROM qs",
        "int_key": "SELECT c_custkey, CASE WHEN c_custkey%5<>0 THEN CAST(c_custkey AS VARCHAR) END AS int_key FROM customer",
        "strip_zeros": "SELECT c_custkey, ltrim(lpad(CAST(c_custkey AS VARCHAR), 9, '0')"
        "||CASE WHEN c_custkey%5=0 THEN 'x' ELSE '' END, '0') AS stripped FROM customer",
        "feather_sink": base
        + f"SELECT rid, game_id, frame, CAST(ha AS BIGINT) AS ha, CAST(no AS BIGINT) AS no, {r2}, round(y, 6) AS y FROM tracking",
        "clean_row_text": f"WITH {SUPERVISION} SELECT id, turn, coalesce(prompt, '') AS prompt, coalesce(target, '') AS target FROM sup",
        "l2_normalise": vec + explode("id", "u", f"(SELECT id, {unit('vec')} AS u FROM vecs)"),
        "fit_width": vec
        + explode("id", "u", "(SELECT id, list_concat(vec, list_transform(range(0, 16), lambda i: 0.0e0)) AS u FROM vecs)"),
        "window_features": win + explode(f"{ATT}, window_id, entity_idx, entity_id, n_observed", "vec", "features"),
        "conv_features": win + KERNELS + explode(f"{ATT}, window_id, entity_idx, entity_id, n_observed", "vec", "wide"),
        "wide_player_vectors": win
        + " SELECT DISTINCT entity_id AS id, CAST(256 AS BIGINT) AS width, 1.0e0 AS norm FROM features WHERE entity_id<>'ball'",
        "attack_vectors": win
        + f", flat AS (SELECT {ATT}, window_id, i, sum(vec[i+1])/23 AS m FROM (SELECT *, unnest(range(0, 16)) AS i FROM features) GROUP BY 1,2,3,4), "
        f"norms AS (SELECT *, greatest(sqrt(sum(m*m) OVER (PARTITION BY {ATT}, window_id)), 1e-12) AS n FROM flat) "
        f"SELECT {ATT}, window_id, CAST(i AS BIGINT) AS pos, round(m/n, 6)+0.0e0 AS value FROM norms",
        "silhouette": f"WITH {knn()} {SILHOUETTE}",
        "silhouette_euclidean": f"WITH {knn('euclidean')} {SILHOUETTE}",
        "evaluate_splits": f"WITH {slab()}{PATCH}{WINDOWS}"
        + f""",
latest AS (SELECT {ATT}, entity_idx, arg_max(vec, window_id) AS vec FROM features GROUP BY 1,2,3),
head AS (
  SELECT (e.game_id*1000+e.attack_no)*100+e.entity_idx AS k, {unit('l.vec')} AS v, e.valid, e.e
  FROM (SELECT {ATT}, entity_idx, valid, sum(value*value)/18 AS e FROM deltas GROUP BY 1,2,3,4) e
  JOIN latest l USING ({ATT}, entity_idx)),
ordered AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42|'||k))-1 AS r FROM head),
splitted AS (SELECT *, CASE WHEN r<floor(n*0.7e0) THEN 'train' WHEN r<floor(n*0.7e0)+floor(n*0.2e0) THEN 'val' ELSE 'test' END AS split FROM ordered),
placed AS (
  SELECT k, v, split, split||((row_number() OVER (PARTITION BY split ORDER BY k)-1)//64) AS batch_id,
    (row_number() OVER (PARTITION BY split ORDER BY k)-1)%64 AS p FROM splitted)"""
        + NCE
        + """
SELECT a.split, round(d, 6) AS loss_delta, round(c, 6) AS loss_infonce, round(d+0.5e0*c, 6) AS loss FROM
(SELECT split, sum(e*valid)/greatest(sum(valid), 1) AS d FROM splitted GROUP BY 1) a JOIN
(SELECT split, avg(loss) AS c FROM losses JOIN splitted USING (k) GROUP BY 1) b ON a.split=b.split""",
        "write_metrics_json": _metrics(),
        "space_report": _metrics(mutual=True),
        "delta_head": f"WITH RECURSIVE {slab()}{PATCH}{WINDOWS}" + HEAD,
        "layout_2d": layout(),
        "pca_project": f"WITH RECURSIVE {components()}"
        + explode("id", "vec", f"(SELECT id, {unit('p')} AS vec FROM projected)"),
        "save_projection": "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(8 AS BIGINT) AS width FROM embeddings",
        "attack_scene_summary": scene
        + "SELECT r.game_id, r.attack_no, min_frame, max_frame, f.frame_count, g.entities, s.n_cells, s.sum_x, s.sum_y "
        f"FROM ranges r JOIN (SELECT {ATT}, count(*) AS frame_count FROM frames GROUP BY 1,2) f USING ({ATT}) "
        f"JOIN (SELECT {ATT}, string_agg(coalesce(entity_id, 'None'), ',' ORDER BY entity_idx) AS entities FROM grid GROUP BY 1,2) g USING ({ATT}) "
        f"LEFT JOIN (SELECT {ATT}, count(*) AS n_cells, round(sum(x), 6)+0.0e0 AS sum_x, round(sum(y), 6)+0.0e0 AS sum_y FROM slab GROUP BY 1,2) s USING ({ATT})",
    }


def _metrics(mutual: bool = False) -> str:
    parts = []
    for space in SPACES:
        parts.append(f"SELECT '{space}' AS space, 'neighbor_purity' AS metric, neighbor_purity AS value FROM (WITH {knn(space=space)} {PURITY})")
        parts.append(f"SELECT '{space}', 'silhouette', silhouette FROM (WITH {knn(space=space)} {SILHOUETTE})")
        if mutual:
            parts.append(f"SELECT '{space}', 'nmi', nmi FROM (WITH RECURSIVE {clustered(SPACES[space])} {NMI})")
    return " UNION ALL ".join(parts)


ORACLE = _sql()
