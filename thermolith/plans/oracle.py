"""DuckDB SQL for the catalog's queries."""

from __future__ import annotations

PIXELS = """px AS (
  SELECT vec_id AS batch_id, vec_id % 16 AS tile_id, vec_id // 16 AS layer,
         CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
         least(65535, greatest(0, CAST(floor(32768 + CAST(e AS DOUBLE) * 200000) AS INTEGER))) AS t
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings))"""

MEANS = f"""{PIXELS},
ranked AS (SELECT batch_id, row_number() OVER (PARTITION BY vec_id % 16 ORDER BY vec_id // 16, vec_id) AS pos
           FROM (SELECT DISTINCT batch_id, batch_id AS vec_id FROM px)),
p AS (SELECT px.*, pos FROM px JOIN ranked USING (batch_id)),
o AS (SELECT dl, dy, dx, abs(dy) + abs(dx) + dl AS far
      FROM (SELECT unnest(range(3)) AS dl), (SELECT unnest(range(-4, 5)) AS dy), (SELECT unnest(range(-4, 5)) AS dx)
      WHERE abs(dy) + abs(dx) + dl <= 4),
sums AS (
  SELECT c.batch_id, c.y, c.x,
         CAST(sum(CASE WHEN o.far <= 2 THEN coalesce(n.t, 0) ELSE 0 END) AS BIGINT) AS cs,
         CAST(sum(CASE WHEN o.far > 2 THEN coalesce(n.t, 0) ELSE 0 END) AS BIGINT) AS ds
  FROM p c CROSS JOIN o
  LEFT JOIN p n ON n.tile_id = c.tile_id AND n.pos = c.pos - o.dl AND n.y = c.y + o.dy AND n.x = c.x + o.dx
  WHERE c.t > 5000 AND c.t < 65000 AND c.pos >= 3
  GROUP BY c.batch_id, c.y, c.x),
means AS (SELECT batch_id, y, x, CAST(cs AS DOUBLE) / 19.0 AS close_mean, CAST(ds AS DOUBLE) / 60.0 AS far_mean FROM sums)"""

OUTLIERS = f"""{MEANS},
outl AS (SELECT batch_id, y, x, abs(close_mean - far_mean) AS deviation FROM means WHERE abs(close_mean - far_mean) > 6000),
rnk AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY deviation DESC, y, x) AS rn FROM outl)"""

SATURATION = f"""WITH {PIXELS}
SELECT batch_id, 'P0' AS print_id, tile_id, CAST(sum(CASE WHEN t > 65000 THEN 1 ELSE 0 END) AS INTEGER) AS saturated
FROM px GROUP BY batch_id, tile_id"""


def top5() -> str:
    picks = ", ".join(f"max(CASE WHEN rn = {i} THEN {c} END) AS {a}{i}" for i in range(1, 6) for a, c in (("y", "y"), ("x", "x"), ("d", "deviation")))
    return f"WITH {OUTLIERS} SELECT batch_id, {picks} FROM rnk WHERE rn <= 5 GROUP BY batch_id"


def csv_rows() -> str:
    picks = ", ".join(
        f"coalesce(max(CASE WHEN rn = {i} THEN printf('(%d;%d)', y, x) END), '()') || ',' || coalesce(max(CASE WHEN rn = {i} THEN printf('%.2f', deviation) END), '') AS c{i}"
        for i in range(1, 6)
    )
    line = " || ',' || ".join(["CAST(v.vec_id AS VARCHAR)", "'P0'", "CAST(v.vec_id % 16 AS VARCHAR)", *(f"coalesce(c{i}, '(),')" for i in range(1, 6))])
    return f"WITH {OUTLIERS}, picks AS (SELECT batch_id, {picks} FROM rnk WHERE rn <= 5 GROUP BY batch_id) SELECT v.vec_id AS batch_id, {line} AS line FROM embeddings v LEFT JOIN picks ON picks.batch_id = v.vec_id"


def labels(eps: float, min_points: int) -> str:
    """Clusters as closures over cores that reach each other; a border point takes the lowest number it can reach."""
    reach = f"(a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= {eps * eps!r}"
    return f"""WITH RECURSIVE {OUTLIERS.replace('WITH ', '')},
near AS (SELECT a.batch_id, a.rn AS a, b.rn AS b FROM rnk a JOIN rnk b ON a.batch_id = b.batch_id AND {reach}),
core AS (SELECT batch_id, a AS rn FROM near GROUP BY batch_id, a HAVING count(*) >= {min_points}),
links AS (SELECT n.batch_id, n.a, n.b FROM near n
          JOIN core x ON x.batch_id = n.batch_id AND x.rn = n.a JOIN core z ON z.batch_id = n.batch_id AND z.rn = n.b),
walk AS (SELECT batch_id, rn AS a, rn AS b FROM core
         UNION SELECT w.batch_id, w.a, l.b FROM walk w JOIN links l ON l.batch_id = w.batch_id AND l.a = w.b),
roots AS (SELECT batch_id, a AS rn, min(b) AS root FROM walk GROUP BY batch_id, a),
reached AS (SELECT n.batch_id, n.a AS rn, min(r.root) AS root FROM near n JOIN roots r ON r.batch_id = n.batch_id AND r.rn = n.b GROUP BY n.batch_id, n.a),
numbered AS (SELECT batch_id, root, row_number() OVER (PARTITION BY batch_id ORDER BY root) - 1 AS label FROM (SELECT DISTINCT batch_id, root FROM roots)),
labelled AS (SELECT k.batch_id, k.y, k.x, CAST(coalesce(n.label, -1) AS INTEGER) AS label
             FROM rnk k LEFT JOIN reached r ON r.batch_id = k.batch_id AND r.rn = k.rn LEFT JOIN numbered n ON n.batch_id = r.batch_id AND n.root = r.root)"""


def centroids(eps: float, min_points: int) -> str:
    return labels(eps, min_points) + """
SELECT batch_id, label, CAST(sum(y) AS DOUBLE) / count(*) AS x, CAST(sum(x) AS DOUBLE) / count(*) AS y, CAST(count(*) AS INTEGER) AS count
FROM labelled WHERE label >= 0 GROUP BY batch_id, label"""


def cluster_lines(eps: float, min_points: int) -> str:
    """Lines of the third query; hundredths of centroids are whole numbers, rounded half up."""

    def hundredths(total: str) -> str:
        return f"((200 * sum({total}) + count(*)) // (2 * count(*)))"

    def written(total: str) -> str:
        return f"CAST({hundredths(total)} // 100 AS BIGINT), CAST({hundredths(total)} % 100 AS BIGINT)"

    return labels(eps, min_points) + f""",
centres AS (SELECT batch_id, label, printf('{{''x'': %d.%02d; ''y'': %d.%02d; ''count'': %d}}', {written('y')}, {written('x')}, count(*)) AS text
            FROM labelled WHERE label >= 0 GROUP BY batch_id, label),
lists AS (SELECT batch_id, string_agg(text, ', ' ORDER BY label) AS text FROM centres GROUP BY batch_id),
bright AS (SELECT batch_id, CAST(sum(CASE WHEN t > 65000 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM px GROUP BY batch_id)
SELECT printf('%d,P0,%d,%d,[%s]', v.vec_id, v.vec_id % 16, bright.n, coalesce(lists.text, '')) AS value
FROM embeddings v JOIN bright ON bright.batch_id = v.vec_id LEFT JOIN lists ON lists.batch_id = v.vec_id"""
