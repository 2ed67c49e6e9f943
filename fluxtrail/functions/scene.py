"""Scene geometry, parsed headers, running moments, hypothesis and hierarchy statements, valid in both SQL dialects."""

from __future__ import annotations

#: The scene's 3 x 4 perspective matrix.
P = ((0.9, 0.1, 0.2, 20.0), (-0.05, 0.8, -0.9, 60.0), (0.0002, 0.0004, 0.0001, 1.0))
#: The corners of one convex zone, clockwise on the screen.
CONVEX = ((100, 50), (500, 80), (560, 400), (80, 380))

#: One zone that is not convex, clockwise on the screen.
POLYGON = ((320, 60), (420, 200), (560, 240), (380, 300), (320, 420), (240, 260), (90, 200))
#: Object numbers as a tree, half of a number above it, and the ways up.
TREE = "nodes AS (SELECT object_id AS id, object_id DIV 2 AS parent, count(*) AS n FROM detections GROUP BY object_id), /*RECUR*/anc(id, a, d) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT anc.id, nodes.parent, anc.d + 1 FROM anc JOIN nodes ON nodes.id = anc.a WHERE nodes.parent > 0)"


def image(x: str, y: str, z: str) -> tuple[str, str]:
    """Image coordinates of a world point."""
    row = lambda r: f"({r[0]}D*({x}) + {r[1]}D*({y}) + {r[2]}D*({z}) + {r[3]}D)"
    return f"({row(P[0])}/{row(P[2])})", f"({row(P[1])}/{row(P[2])})"


def world(u: str, v: str, z: str) -> tuple[str, str, str]:
    """World x and y of an image point at height z, and the denominator; null where that is 0."""
    a, b = ([f"({P[i][k]}D - ({w})*{P[2][k]}D)" for k in range(4)] for i, w in ((0, u), (1, v)))
    e, f = f"(-{a[2]}*({z}) - {a[3]})", f"(-{b[2]}*({z}) - {b[3]})"
    det = f"({a[0]}*{b[1]} - {a[1]}*{b[0]})"
    return f"(({e}*{b[1]} - {a[1]}*{f})/nullif({det}, 0.0D))", f"(({a[0]}*{f} - {e}*{b[0]})/nullif({det}, 0.0D))", det


def ccw(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> str:
    return f"(({b[0]}-{a[0]})*({c[1]}-{a[1]}) - ({b[1]}-{a[1]})*({c[0]}-{a[0]}))"


def bodies() -> dict[str, str]:
    u, v = image("cx", "cy", "100*rd")
    x, y, _ = world("cx", "cy", "0.0D")
    out = {
        "geo_n_intersection": "SELECT object_id, frame_id DIV 24 AS day, max(xleft) AS l, min(xright) AS r, max(ytop) AS t, min(ybottom) AS b FROM boxes GROUP BY object_id, frame_id DIV 24 HAVING max(xleft) <= min(xright) AND max(ytop) <= min(ybottom)",
        "geo_world_to_img": f"SELECT det_id, round({u}, 5) AS u, round({v}, 5) AS v FROM boxes",
        "geo_img_to_world": f"SELECT det_id, round({x}, 4) AS x, round({y}, 4) AS y FROM boxes",
    }
    back = world("u", "v", "100*rd")
    out["geo_world_round_trip"] = f"m AS (SELECT det_id, cx, cy, rd, {u} AS u, {v} AS v FROM boxes)\n--\nSELECT det_id, round({back[0]} - cx, 4) + 0.0D AS dx, round({back[1]} - cy, 4) + 0.0D AS dy FROM m"
    rays = ", ".join(f"{world(f'{s}cx', f'{s}cy', z)[i]} AS {s}{n}{k}" for s in "ab" for k, z in enumerate(("0.0D", "100.0D")) for i, n in enumerate("xy"))
    cross = "((ax1-ax0)*(by1-by0) - (ay1-ay0)*(bx1-bx0))"
    t = f"(((bx0-ax0)*(by1-by0) - (by0-ay0)*(bx1-bx0))/{cross})"
    out["geo_focal_point"] = f"q AS (SELECT det_id, {rays} FROM pairs), r AS (SELECT *, CASE WHEN abs({cross}) > 1000.0D THEN {t} END AS t FROM q)\n--\nSELECT det_id, round(ax0 + t*(ax1-ax0), 0) AS x, round(ay0 + t*(ay1-ay0), 0) AS y, round(100*t, 0) AS z FROM r"
    a, b, c, d = ("ax", "ay"), ("ar", "ab"), ("bx", "by_"), ("br", "bb")
    out["geo_segment_intersect"] = f"SELECT det_id, sign({ccw(a, b, c)})*sign({ccw(a, b, d)}) <= 0 AND sign({ccw(c, d, a)})*sign({ccw(c, d, b)}) <= 0 AND ax <= br AND bx <= ar AND ay <= bb AND by_ <= ab AS hit FROM pairs"
    along = "greatest(0.0D, least(1.0D, ((bcx-ax)*(ar-ax) + (bcy-ay)*(ab-ay))/cast((ar-ax)*(ar-ax) + (ab-ay)*(ab-ay) AS double)))"
    out["geo_point_segment"] = f"k AS (SELECT *, {along} AS s FROM pairs)\n--\nSELECT det_id, round(sqrt(power(bcx - ax - s*(ar-ax), 2) + power(bcy - ay - s*(ab-ay), 2)), 5) AS dist FROM k"
    on = f"abs({ccw(a, b, ('bcx', 'bcy'))})/sqrt(cast((ar-ax)*(ar-ax) + (ab-ay)*(ab-ay) AS double)*(power(bcx-ax, 2) + power(bcy-ay, 2)))"
    out["geo_point_on_segment"] = f"SELECT det_id, CASE WHEN bcx = ax AND bcy = ay THEN true ELSE {on} <= 0.01D AND bcx BETWEEN ax AND ar AND bcy BETWEEN ay AND ab END AS on_segment FROM pairs"
    sides = " AND ".join(f"{ccw((str(p[0]), str(p[1])), (str(q[0]), str(q[1])), ('cx', 'cy'))} >= 0" for p, q in zip(CONVEX, CONVEX[1:] + CONVEX[:1], strict=True))
    out["geo_point_in_convex"] = f"SELECT det_id, {sides} AS inside FROM boxes"
    points = "pts AS (SELECT object_id, cx, cy, row_number() OVER (PARTITION BY object_id ORDER BY t_us, det_id) AS i, count(*) OVER (PARTITION BY object_id) AS n FROM boxes)\n--\n"
    out["geo_polygon_bbox"] = points + "SELECT object_id, min(cx) AS l, max(cx) AS r, min(cy) AS t, max(cy) AS b FROM pts GROUP BY object_id"
    out["geo_polygon_inverse"] = points + "SELECT object_id, n + 1 - i AS i, cx, cy FROM pts"
    ring = points.replace("\n--\n", ", ring AS (SELECT object_id, i, cx, cy, coalesce(lead(cx) OVER (PARTITION BY object_id ORDER BY i), first_value(cx) OVER (PARTITION BY object_id ORDER BY i)) AS nx, coalesce(lead(cy) OVER (PARTITION BY object_id ORDER BY i), first_value(cy) OVER (PARTITION BY object_id ORDER BY i)) AS ny FROM pts)\n--\n")
    out["geo_polygon_area"] = ring + "SELECT object_id, round(abs(sum(cast(cx*ny - nx*cy AS double)))/2, 3) AS area FROM ring GROUP BY object_id"
    edges = list(zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True))
    crossed = " + ".join(f"CASE WHEN cy >= {min(b, d)} AND cy < {max(b, d)} AND cx < {a} + (cy - {b})*{c - a}.0D/{d - b} THEN 1 ELSE 0 END" for (a, b), (c, d) in edges if b != d)
    on = " OR ".join(f"(cx - {a})*{d - b} = (cy - {b})*{c - a} AND cx BETWEEN {min(a, c)} AND {max(a, c)} AND cy BETWEEN {min(b, d)} AND {max(b, d)}" for (a, b), (c, d) in edges)
    out["geo_point_in_polygon"] = f"SELECT det_id, ({on}) OR ({crossed}) % 2 = 1 AS inside, NOT ({on}) AND ({crossed}) % 2 = 1 AS strict FROM boxes"
    cut = lambda p, q: [f"CASE WHEN c{p} BETWEEN {min(e[0][q], e[1][q])} AND {max(e[0][q], e[1][q])} THEN {e[0][1 - q]} + (c{p} - {e[0][q]})*{e[1][1 - q] - e[0][1 - q]}.0D/{e[1][q] - e[0][q]} END" for e in zip(CONVEX, CONVEX[1:] + CONVEX[:1], strict=True) if e[0][q] != e[1][q]]
    out["geo_convex_range"] = f"SELECT det_id, round(least({', '.join(cut('y', 1))}), 4) AS x_lo, round(greatest({', '.join(cut('y', 1))}), 4) AS x_hi, round(least({', '.join(cut('x', 0))}), 4) AS y_lo, round(greatest({', '.join(cut('x', 0))}), 4) AS y_hi FROM boxes"
    # A line a*x + b*y = c through the centres of a box and the one before; where it cuts each edge of the polygon.
    out["geo_contour_line"] = "l AS (SELECT det_id, acy - bcy AS a, bcx - acx AS b, (acy - bcy)*acx + (bcx - acx)*acy AS c FROM pairs WHERE acx <> bcx OR acy <> bcy), e AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}, {b}, {c}, {d})" for k, ((a, b), (c, d)) in enumerate(edges)) + ") AS v(edge, x0, y0, x1, y1)), s AS (SELECT l.*, e.*, cast(a*x0 + b*y0 - c AS double) AS f, cast(a*x1 + b*y1 - c AS double) AS g FROM l CROSS JOIN e)\n--\nSELECT det_id, edge, round(x0 + f/(f - g)*(x1 - x0), 4) AS x, round(y0 + f/(f - g)*(y1 - y0), 4) AS y FROM s WHERE f*g < 0 OR f = 0 AND g <> 0"
    out["geo_polygon_equal"] = "SELECT det_id, abs(ax-bx) <= 5 AND abs(ay-by_) <= 5 AND abs(ar-br) <= 5 AND abs(ab-bb) <= 5 AS equal FROM pairs"
    corners = [image(p, q, "0.0D") for p, q in (("xleft", "ytop"), ("xright", "ytop"), ("xright", "ybottom"), ("xleft", "ybottom"))]
    shoelace = " + ".join(f"(x{i}*y{(i + 1) % 4} - x{(i + 1) % 4}*y{i})" for i in range(4))
    out["geo_polygon_project"] = f"c AS (SELECT det_id, {', '.join(f'{p} AS x{i}, {q} AS y{i}' for i, (p, q) in enumerate(corners))} FROM boxes)\n--\nSELECT det_id, {', '.join(f'round(x{i}, 4) AS x{i}, round(y{i}, 4) AS y{i}' for i in range(4))}, round(abs({shoelace})/2, 3) AS area FROM c"
    out["geo_zone_center_dist"] = "SELECT det_id, zone, CASE WHEN zone = 'ellipse' THEN round(sqrt(power(cx-320, 2) + power(cy-240, 2)), 5) ELSE 0.0D END AS dist FROM boxes CROSS JOIN (VALUES ('ellipse'), ('polygon')) AS z(zone)"
    out["geo_hull_offset"] = points + "SELECT object_id, i, cx + 7 AS x, cy - 3 AS y FROM pts"
    hx, hy, _ = world("cx", "cy", "0.0D")
    out["geo_hull_dists"] = points.replace("\n--\n", f", hull AS (SELECT object_id, i, {hx} AS x, {hy} AS y FROM pts)\n--\n") + "SELECT p.object_id, p.i, round(sqrt(power(q.x-p.x, 2) + power(q.y-p.y, 2)), 4) AS dist FROM hull p JOIN hull q ON q.object_id = p.object_id AND q.i = p.i + 1"

    two = lambda e: f"lpad(cast({e} AS varchar(9)), 2, '0')"
    clock = f"concat({two('(t_us DIV 3600000000) % 24')}, '.', {two('(t_us DIV 60000000) % 60')}, '.', {two('(t_us DIV 1000000) % 60')}, '.', lpad(cast((t_us DIV 1000) % 1000 AS varchar(9)), 3, '0'))"
    name = r"-([0-9]+)[.]([0-9]+)[.]([0-9]+)[.]([0-9]+)-([0-9]+)[.][a-z]+$"
    part = lambda i, e="name", p=name: f"cast(regexp_extract({e}, '{p}', {i}) AS bigint)"
    out["src_frames_etiseo"] = f"n AS (SELECT concat('site-C1-', {clock}, '-', cast(det_id AS varchar(20)), '.jpg') AS name FROM detections)\n--\nSELECT {part(5)} AS frame, (({part(1)}*60 + {part(2)})*60 + {part(3)})*1000 + {part(4)} AS ms FROM n"
    digits = lambda lo, n: f"cast(substring(h, {lo}, {n}) AS int)"
    out["src_jpeg_header"] = f"n AS (SELECT det_id, concat('20260107', replace({clock}, '.', ''), lpad(cast(det_id % 1000000 AS varchar(9)), 6, '0'), 'C01') AS h FROM detections)\n--\nSELECT det_id, {digits(1, 4)} AS y, {digits(5, 2)} AS m, {digits(7, 2)} AS d, (({digits(9, 2)}*60 + {digits(11, 2)})*60 + {digits(13, 2)})*1000 + {digits(15, 3)} AS ms, {digits(18, 6)} AS frame, substring(h, 24, 3) AS camera FROM n"
    cell = "^[ ]*([0-9]+)[ ]+([0-9.]+)[ ]+([0-9.]+)[ ]+([0-9.]+)[ ]*$"
    out["src_supervised_txt"] = f"n AS (SELECT CASE WHEN det_id % 10 = 0 THEN '# remark' ELSE concat('  ', cast(det_id AS varchar(20)), '   ', cast(width AS varchar(9)), '.5  ', cast(height AS varchar(9)), ' 0.', cast(det_id % 9 + 1 AS varchar(9))) END AS line FROM detections)\n--\nSELECT {part(1, 'line', cell)} AS image, " + ", ".join(f"cast(regexp_extract(line, '{cell}', {i}) AS double) AS {c}" for i, c in ((2, "mean"), (3, "sd"), (4, "reliability"))) + " FROM n WHERE substring(line, 1, 1) <> '#'"

    order = "PARTITION BY object_id ORDER BY t_us, det_id"
    out["src_gt_tracking"] = f"SELECT det_id, xleft - 4 AS x, ytop - 2 AS y, cx - lag(cx) OVER ({order}) AS vx, cy - lag(cy) OVER ({order}) AS vy, round({x}, 4) AS world_x, round({y}, 4) AS world_y FROM boxes"
    out["math_inc_stats"] = f"SELECT det_id, round(avg(cx) OVER w, 4) AS mean, round(stddev_pop(cx) OVER w, 3) AS sigma FROM boxes WINDOW w AS ({order} ROWS UNBOUNDED PRECEDING)"
    out["math_angle_norm"] = "g AS (SELECT det_id, atan2(acy-bcy, acx-bcx) - 7 AS v FROM pairs)\n--\nSELECT det_id, round(v - floor(v/pi())*pi(), 6) AS mod_pi, round(v - floor(v/(2*pi()))*2*pi(), 6) AS mod_2pi FROM g"
    out["time_add_ms"] = "SELECT det_id, ((t_us DIV 1000) % 60000 + 70123) % 1000 AS ms, (((t_us DIV 1000) % 60000 + 70123) DIV 1000) % 60 AS sec, ((t_us DIV 1000) % 60000 + 70123) DIV 60000 AS carry FROM detections"
    out["time_frame_gap"] = f"l AS (SELECT det_id, object_id, t_us, frame_id, lag(frame_id) OVER w AS pf, lag(t_us) OVER w AS pt FROM detections WINDOW w AS ({order})), k AS (SELECT *, CASE WHEN frame_id - pf <= 24 THEN t_us - pt END AS known FROM l), c AS (SELECT *, count(known) OVER ({order} ROWS UNBOUNDED PRECEDING) AS island FROM k)\n--\nSELECT det_id, coalesce(max(known) OVER (PARTITION BY object_id, island), 80000) AS gap_us FROM c"

    out["hyp_inclusion_prob"] = "h AS (SELECT det_id, frame_id, rd AS p, sum(rd) OVER (PARTITION BY frame_id) AS total, coalesce(sum(rd) OVER (PARTITION BY frame_id ORDER BY rd DESC, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM detections), f AS (SELECT *, min(CASE WHEN 5*p > total - above + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id ORDER BY p DESC, det_id ROWS UNBOUNDED PRECEDING) AS fixed FROM h), r AS (SELECT *, sum(CASE WHEN fixed = 0 THEN p END) OVER (PARTITION BY frame_id) AS rest FROM f)\n--\nSELECT det_id, round(CASE WHEN fixed = 1 THEN 1.0D ELSE 5*p/rest END, 6) AS pi FROM r"
    out["trk_init"] = f"f AS (SELECT *, row_number() OVER ({order}) AS i FROM boxes)\n--\nSELECT object_id, cx AS value, 0.0D AS sd, 1.0D AS rc, rd, 0.0D AS v, 0.0D AS a FROM f WHERE i = 1"
    out["trk_reliability_nodata"] = "l AS (SELECT object_id, max(t_us) AS t FROM detections GROUP BY object_id), a AS (SELECT d.object_id, max(l.t) AS t, sum(rd*exp(-0.1D*(l.t - d.t_us)/3600000000.0D)) AS acc, sum(exp(-0.1D*(l.t - d.t_us)/3600000000.0D)) AS cool FROM detections d JOIN l ON l.object_id = d.object_id GROUP BY d.object_id), e AS (SELECT max(t_us) AS z FROM detections)\n--\nSELECT object_id, round(acc*exp(-0.1D*(z - t)/3600000000.0D), 6) AS acc_r, round(sqrt(9.0D/least(1.0D, acc/cool)), 5) AS sd FROM a CROSS JOIN e"
    out["trk_id_upsert"] = f"g AS (SELECT object_id, frame_id, det_id, frame_id - lag(frame_id) OVER ({order}) AS gap FROM detections)\n--\nSELECT det_id, object_id, CASE WHEN gap IS NULL THEN 'insert' WHEN gap > 24 THEN 'expire+insert' ELSE 'update' END AS act FROM g"
    out["lrn_attributes"] = f"l AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(width) OVER w AS pw, lag(height) OVER w AS ph, (t_us - lag(t_us) OVER w)/3600000000.0D AS gap FROM boxes WINDOW w AS ({order})), m AS (SELECT *, CASE WHEN gap > 0.01D THEN gap END AS dt FROM l)\n--\nSELECT det_id, cx AS x, cy AS y, width AS w, height AS h, round((cx-px)/dt, 4) AS vx, round((cy-py)/dt, 4) AS vy, round(sqrt(power(cx-px, 2) + power(cy-py, 2))/dt, 4) AS v2d, round((width-pw)/dt, 4) AS vw, round((height-ph)/dt, 4) AS vh FROM m"
    out["lrn_dwell_unseen"] = f"e AS (SELECT max(t_us) AS z FROM detections), l AS (SELECT object_id, obj_type, t_us, lead(t_us) OVER ({order}) AS nxt FROM detections)\n--\nSELECT object_id, obj_type, sum(coalesce(nxt, z) - t_us) AS dwell_us FROM l CROSS JOIN e GROUP BY object_id, obj_type"
    out["lrn_edge_pool"] = f"l AS (SELECT obj_type AS s, lead(obj_type) OVER ({order}) AS d, lead(t_us) OVER ({order}) - t_us AS dt FROM detections), r AS (SELECT CASE WHEN s IN ('click','view') THEN 'seen' ELSE s END AS src, CASE WHEN d IN ('click','view') THEN 'seen' ELSE d END AS dst, dt/3600000000.0D AS dt FROM l WHERE d IS NOT NULL), g AS (SELECT src, dst, count(*) AS n, avg(dt) AS m, stddev_pop(dt) AS sd, min(dt) AS lo, max(dt) AS hi FROM r WHERE src <> dst GROUP BY src, dst)\n--\nSELECT src, dst, n, round(cast(n AS double)/sum(n) OVER (PARTITION BY src), 6) AS p, round(m, 4) AS mean_t, round(sd, 4) AS sigma_t, round(lo, 4) AS min_t, round(hi, 4) AS max_t FROM g"
    grid = "(VALUES (0),(1),(2),(3),(4),(5),(6),(7)) AS i(i) CROSS JOIN (VALUES (0),(1),(2),(3)) AS j(j) CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) AS k(k) CROSS JOIN (VALUES (0),(1),(2)) AS l(l)"
    near = "power((gx*20 + 10 - mx)/sx, 2) + power((gy*20 + 10 - my)/sy, 2)"
    out["lrn_rasterise"] = f"c AS (SELECT obj_type, avg(cx) AS mx, stddev_pop(cx) AS sx, avg(cy) AS my, stddev_pop(cy) AS sy, avg(rd) AS rd FROM boxes GROUP BY obj_type), g AS (SELECT i*4 + j AS gx, k*3 + l AS gy FROM {grid}), d AS (SELECT gx, gy, rd, cast({near} AS double) AS q FROM g CROSS JOIN c)\n--\nSELECT gx, gy, round(max(exp(-q/2)), 6) AS gauss, max(CASE WHEN q <= 1 THEN 1 ELSE 0 END) AS flat, max(CASE WHEN abs(sqrt(q) - 1) <= 0.15D THEN 1 ELSE 0 END) AS border, round(max(CASE WHEN q <= 1 THEN rd END), 6) AS attribute FROM d GROUP BY gx, gy"
    out["tree_depth"] = TREE + "\n--\nSELECT id, max(d) AS depth FROM anc GROUP BY id"
    out["tree_distance_to_leaf"] = TREE + "\n--\nSELECT a AS id, max(d) AS to_leaf, count(*) AS below FROM anc GROUP BY a"
    out["tree_kinship"] = TREE + "\n--\nSELECT x.id AS id, min(x.d + y.d) AS steps FROM anc x JOIN anc y ON y.id = x.id + 1 AND y.a = x.a GROUP BY x.id"
    out["tree_likely_states"] = TREE + ", total AS (SELECT a AS id, sum(m.n) AS n FROM anc JOIN nodes m ON m.id = anc.id GROUP BY a), share AS (SELECT c.id, c.id DIV 2 AS parent, CASE WHEN p.n IS NULL THEN 1.0D ELSE cast(c.n AS double)/p.n END AS p FROM total c LEFT JOIN total p ON p.id = c.id DIV 2), bad AS (SELECT id FROM share WHERE p < 0.4D), kept AS (SELECT id FROM anc GROUP BY id HAVING count(CASE WHEN a IN (SELECT id FROM bad) THEN 1 END) = 0)\n--\nSELECT k.id FROM kept k LEFT JOIN (SELECT DISTINCT id DIV 2 AS id FROM kept) c ON c.id = k.id WHERE c.id IS NULL"
    out["sup_loocv"] = "g AS (SELECT obj_type, rd, width AS v, (sum(width) OVER (PARTITION BY obj_type) - width)/(count(*) OVER (PARTITION BY obj_type) - 1.0D) AS guess FROM detections)\n--\nSELECT obj_type, round(avg(abs(v - guess)), 6) AS mae, round(sum(rd*abs(v - guess))/sum(rd), 6) AS weighted_mae FROM g GROUP BY obj_type"
    return out
