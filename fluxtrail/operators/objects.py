"""Blob, join, aggregate and window operators over boxes."""

from fluxtrail.operators import grid

SAME = "boxes a JOIN boxes b ON a.frame_id = b.frame_id AND a.det_id < b.det_id"
HIT = "greatest(a.xleft, b.xleft) < least(a.xright, b.xright) AND greatest(a.ytop, b.ytop) < least(a.ybottom, b.ybottom)"
#: Areas of both boxes' common part, 0 without one, and of each box; whether a box stands outside the area of interest.
BOTH = f"(CASE WHEN {HIT} THEN (least(a.xright, b.xright) - greatest(a.xleft, b.xleft) + 1)*(least(a.ybottom, b.ybottom) - greatest(a.ytop, b.ytop) + 1) ELSE 0 END)"
AREA_OF = "cast({0}.width*{0}.height AS double)"
OUTSIDE = "NOT ({0}.cx BETWEEN 100 AND 540 AND {0}.ybottom BETWEEN 80 AND 400)"
GAP = "sqrt(cast(power(greatest(0, greatest(a.xleft, b.xleft) - least(a.xright, b.xright)), 2) + power(greatest(0, greatest(a.ytop, b.ytop) - least(a.ybottom, b.ybottom)), 2) AS double))"
#: How far apart boxes may be to merge: further where they share half a width, further still where the upper one floats outside the area.
REACH = f"10.0D * CASE WHEN least(a.xright, b.xright) - greatest(a.xleft, b.xleft) + 1 < 0.5D*least(a.width, b.width) THEN 1.0D WHEN a.ybottom < b.ytop AND NOT ({OUTSIDE.format('a')}) OR b.ybottom < a.ytop AND NOT ({OUTSIDE.format('b')}) THEN 1.5D ELSE 3.5D END"
W = "PARTITION BY object_id ORDER BY t_us, det_id"
STEP = f"st AS (SELECT *, lag(cx) OVER ({W}) AS px_, lag(cy) OVER ({W}) AS py_, lag(t_us) OVER ({W}) AS pt FROM boxes), sp AS (SELECT *, sqrt(cast((cx-px_)*(cx-px_)+(cy-py_)*(cy-py_) AS double)) AS d, (t_us - pt)/3600000000.0D AS h FROM st)"
#: A running count of rows, a turn of an angle t into [-pi, pi), and the coherence of a deviation s with an acuity.
AGE = f"SELECT *, row_number() OVER ({W}) AS age FROM boxes"
WRAP = "(({t}) - 2*pi()*floor((({t}) + pi() + 1e-9)/(2*pi())))"
COHERENT = "CASE WHEN {s} <= {a} THEN 1.0D ELSE {a}/{s} END"
BUFFER = f"({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
#: Up to this speed (an hour) an object is still; rests of so many hours count as stops, shorter ones as movement.
STILL_SPEED, STILL_TIME = "30.0D", "12.0D"
BODIES = {
    "blob_filter": "SELECT det_id, row_number() OVER (PARTITION BY frame_id ORDER BY det_id) - 1 AS blob FROM boxes WHERE width >= 12 AND height >= 12 AND width*height >= 300 AND NOT (xright < 10 OR xleft > 629 OR ybottom < 10 OR ytop > 469)",
    "blob_merge_n": "SELECT frame_id, min(xleft) AS l, min(ytop) AS t, max(xright) AS r, max(ybottom) AS b, count(*) AS n FROM boxes GROUP BY frame_id",
    "blob_split": "SELECT det_id, 'V' AS cut, 0 AS side, xleft AS l, 319 AS r, ytop AS t, ybottom AS b FROM boxes WHERE xleft < 320 AND xright >= 320 UNION ALL SELECT det_id, 'V', 1, 320, xright, ytop, ybottom FROM boxes WHERE xleft < 320 AND xright >= 320 UNION ALL SELECT det_id, 'H', 0, xleft, xright, ytop, 239 FROM boxes WHERE ytop < 240 AND ybottom >= 240 UNION ALL SELECT det_id, 'H', 1, xleft, xright, 240, ybottom FROM boxes WHERE ytop < 240 AND ybottom >= 240",
    "join_zone": "SELECT det_id, zone FROM boxes JOIN zones ON cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 UNION ALL SELECT det_id, 'ELLIPSE' FROM boxes WHERE power((cx - 320)/120.0D, 2) + power((cy - 240)/90.0D, 2) < 1 UNION ALL SELECT det_id, 'TRIANGLE' FROM boxes WHERE cy BETWEEN 100 AND 400 AND abs(cx - 320)*300 <= (cy - 100)*200",
    "join_nearest_zone": "z AS (SELECT * FROM zones UNION ALL SELECT * FROM (VALUES ('WEST', 0, 0, 320, 480), ('MID', 150, 100, 490, 380)) AS w(zone, x0, y0, x1, y1)), d AS (SELECT b.det_id, z.zone, row_number() OVER (PARTITION BY b.det_id ORDER BY power(cx - (x0 + x1)/2.0D, 2) + power(cy - (y0 + y1)/2.0D, 2), z.zone) AS rn FROM boxes b JOIN z ON b.cx BETWEEN z.x0 AND z.x1 AND b.cy BETWEEN z.y0 AND z.y1)\n--\nSELECT b.det_id, coalesce(d.zone, 'NONE') AS zone FROM boxes b LEFT JOIN d ON d.det_id = b.det_id AND d.rn = 1",
    "agg_module_time": f"{STEP}\n--\nSELECT obj_type, round(avg(h), 6) AS mean, round(stddev_pop(h), 6) AS sigma, round(min(h), 6) AS lo, round(max(h), 6) AS hi, round(sum(h), 4) AS total, count(h) AS n FROM sp GROUP BY obj_type",
    "agg_hypothesis_p": f"f AS ({AGE})\n--\nSELECT frame_id, CASE WHEN max(age) < 2 THEN 0.0D ELSE round(sum(CASE WHEN age > 1 THEN rd*age ELSE 0.0D END)/sum(CASE WHEN age > 1 THEN age ELSE 0 END), 6) END AS p, CASE WHEN max(age) < 2 THEN 1 ELSE 0 END AS just_first_frames FROM f GROUP BY frame_id",
    "agg_object_p": f"v AS (SELECT *, cast(cx - lag(cx) OVER ({W}) AS double) AS vx, sum(CASE WHEN rd >= 0.3D THEN 1 ELSE 0 END) OVER {BUFFER} AS found, count(*) OVER {BUFFER} AS n FROM boxes), m AS (SELECT *, exp(-power(width - 28, 2)/288.0D) AS p2d, CASE WHEN found < 2 THEN 0.0D ELSE (found - 1)/(n - 1.0D) END AS rv, coalesce(exp(-power(vx - avg(vx) OVER {BUFFER}, 2)/80000.0D), 0.0D) AS pv FROM v)\n--\nSELECT det_id, round((p2d*rd + pv*rv)/(rd + rv), 6) AS p FROM m",
    "agg_model_p": f"e AS (SELECT object_id, obj_type, rd, xleft, ytop, width, height FROM boxes), t AS (SELECT object_id, 'all' AS model, stddev_pop(xleft) AS sx, stddev_pop(ytop) AS sy, stddev_pop(width) AS sw, stddev_pop(height) AS sh, avg(rd) AS r, max(rd) AS top FROM e GROUP BY object_id UNION ALL SELECT object_id, obj_type, stddev_pop(xleft), stddev_pop(ytop), stddev_pop(width), stddev_pop(height), avg(rd), max(rd) FROM e GROUP BY object_id, obj_type), p AS (SELECT object_id, model, (r*({COHERENT.format(s='sx', a='30.0D')}) + r*({COHERENT.format(s='sy', a='30.0D')}) + top*({COHERENT.format(s='sw', a='3.0D')}) + top*({COHERENT.format(s='sh', a='3.0D')}))/(2*r + 2*top) AS p, (2*r + 2*top)/4 AS r FROM t), d AS (SELECT b.object_id, sum(d.p*d.r)/sum(d.r) AS p, sum(d.r)/count(*) AS r FROM p b JOIN p d ON d.object_id = b.object_id AND d.model <> 'all' AND b.r <= d.r AND b.p < d.p WHERE b.model = 'all' GROUP BY b.object_id)\n--\nSELECT b.object_id, round(coalesce(d.p, b.p), 6) AS p, round(coalesce(d.r, b.r), 6) AS r, CASE WHEN d.p IS NULL THEN 0 ELSE 1 END AS improved FROM p b LEFT JOIN d ON d.object_id = b.object_id WHERE b.model = 'all'",
    "agg_angle_hist": f"{STEP}, dir AS (SELECT object_id, t_us, det_id, atan2(cast(cy-py_ AS double), cast(cx-px_ AS double)) AS a FROM sp WHERE cx <> px_ OR cy <> py_), tn AS (SELECT object_id, a - lag(a) OVER ({W}) AS t FROM dir), bn AS (SELECT object_id, least(15, cast(floor(({WRAP.format(t='t')} + pi() + 1e-9)/(pi()/8)) AS bigint)) AS bin FROM tn WHERE t IS NOT NULL)\n--\nSELECT object_id, bin, round(count(*)/cast(sum(count(*)) OVER (PARTITION BY object_id) AS double), 6) AS p FROM bn GROUP BY object_id, bin",
    "agg_category_utility": "e AS (SELECT frame_id DIV 24 % 7 AS cls, cast(cx AS double) AS x, cast(cy AS double) AS y, obj_type, rd FROM boxes UNION ALL SELECT -1, cast(cx AS double), cast(cy AS double), obj_type, rd FROM boxes), num AS (SELECT cls, count(*) AS n, (20.0D/greatest(20.0D, stddev_pop(x)) + 20.0D/greatest(20.0D, stddev_pop(y)))/(2*3.5449077D) AS v FROM e GROUP BY cls), part AS (SELECT cls, obj_type, sum(rd) AS w FROM e GROUP BY cls, obj_type), sym AS (SELECT cls, sum(w*w)/(sum(w)*sum(w)) AS v FROM part GROUP BY cls), k AS (SELECT num.cls, n, num.v + sym.v AS v FROM num JOIN sym ON sym.cls = num.cls), root AS (SELECT n, v FROM k WHERE cls = -1)\n--\nSELECT k.cls, round(k.n/cast(r.n AS double)*k.v, 6) AS u FROM k CROSS JOIN root r WHERE k.cls >= 0 UNION ALL SELECT -1, round((sum(k.n*k.v)/sum(k.n) - max(r.v))/count(*), 6) FROM k CROSS JOIN root r WHERE k.cls >= 0",
    "win_planar_perimeter": f"{STEP}, o AS (SELECT *, CASE WHEN avg(CASE WHEN cx BETWEEN 100 AND 540 AND cy BETWEEN 80 AND 400 THEN 0.0D ELSE 1.0D END) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0.5D THEN 1 ELSE 0 END AS out_ FROM sp)\n--\nSELECT det_id, out_ AS outside, round(sum(out_*coalesce(d, 0)) OVER ({W}), 4) AS dist, round(sum(out_*coalesce(h, 0)) OVER ({W}), 6) AS hours FROM o",
    "win_frames_seen": f"n AS ({AGE})\n--\nSELECT det_id, age - coalesce(max(CASE WHEN rd < 0.5D THEN age END) OVER ({W}), 0) AS seen, age - coalesce(max(CASE WHEN rd >= 0.5D THEN age END) OVER ({W}), 0) AS unseen FROM n",
    "win_found_ratio": f"f AS (SELECT det_id, sum(CASE WHEN rd >= 0.5D THEN 1 ELSE 0 END) OVER {BUFFER} AS found, count(*) OVER {BUFFER} AS n FROM boxes)\n--\nSELECT det_id, round(found/cast(n AS double), 6) AS r, CASE WHEN found < 2 THEN 0.0D ELSE round((found - 1)/(n - 1.0D), 6) END AS rv FROM f",
    "win_angular": f"n AS ({AGE}), k AS (SELECT *, cx - lag(cx) OVER ({W}) AS dx, cy - lag(cy) OVER ({W}) AS dy FROM n WHERE age % 2 = 1), a AS (SELECT det_id, object_id, t_us, atan2(cast(dy AS double), cast(dx AS double)) AS ang FROM k WHERE dx IS NOT NULL), t AS (SELECT det_id, lead(ang) OVER ({W}) - ang AS t FROM a)\n--\nSELECT det_id, round({WRAP.format(t='t')}, 6) AS turn, round(abs({WRAP.format(t='t')}), 6) AS size FROM t",
    "obj_filter": "o AS (SELECT object_id, count(*) AS age, avg(rd) AS r, avg(width) AS w FROM boxes WHERE object_id % 7 <> 3 GROUP BY object_id), total AS (SELECT count(*) AS n FROM o), ok AS (SELECT object_id, age FROM o CROSS JOIN total WHERE n <= 10 OR (w >= 15 AND age >= 5 AND (age >= 10 OR r >= 0.3D))), few AS (SELECT count(*) AS m FROM ok), old AS (SELECT object_id, age FROM o ORDER BY age DESC, object_id LIMIT 10), kept AS (SELECT object_id, age FROM ok CROSS JOIN few WHERE m >= 10 UNION ALL SELECT object_id, age FROM old CROSS JOIN few WHERE m < 10)\n--\nSELECT object_id, age FROM kept ORDER BY age DESC, object_id LIMIT 50",
    "hyp_prune": f"n AS ({AGE}), h AS (SELECT *, max(rd) OVER (PARTITION BY frame_id) AS best, row_number() OVER (PARTITION BY frame_id ORDER BY rd DESC, det_id) AS rn FROM n), c AS (SELECT *, rn = 1 OR age = 1 AS sure, rd/best >= 0.8D AS near FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, sure, near ORDER BY rd DESC, det_id) AS nth, avg(rd) OVER (PARTITION BY frame_id, near) - coalesce(stddev_samp(rd) OVER (PARTITION BY frame_id, near), 0.0D) AS cut FROM c)\n--\nSELECT frame_id, det_id, sure OR near AND nth <= 10 AS least_reliable, sure OR near AND rd >= cut - 1e-9 AS max_likelihood FROM r WHERE sure OR near",
    "hyp_dedup_members": f"n AS ({AGE})\n--\nSELECT a.frame_id, a.det_id FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.frame_id = a.frame_id AND b.det_id <> a.det_id AND {BOTH} >= 0.95D*{AREA_OF.format('a')} AND {BOTH} >= 0.95D*{AREA_OF.format('b')} AND (b.age > a.age OR b.age = a.age AND (b.rd > a.rd OR b.rd = a.rd AND b.det_id < a.det_id)))",
    "path_cap": "SELECT object_id, det_id FROM (SELECT object_id, det_id, rd, max(rd) OVER (PARTITION BY object_id, frame_id DIV 24) AS best, row_number() OVER (PARTITION BY object_id, frame_id DIV 24 ORDER BY rd DESC, det_id) AS rn FROM boxes) r WHERE rn <= 3 AND rd >= 0.9D*best",
    "trk_project": f"{STEP}, v AS (SELECT *, (cx-px_)/nullif(h, 0) AS v FROM sp), a AS (SELECT *, (v - lag(v) OVER ({W}))/nullif(h, 0) AS a FROM v), c AS (SELECT *, coalesce(stddev_pop(cast(cx AS double)) OVER {BUFFER}, 0.0D) AS sx, coalesce(stddev_pop(v) OVER {BUFFER}, 0.0D) AS sv, coalesce(stddev_pop(a) OVER {BUFFER}, 0.0D) AS sa FROM a), k AS (SELECT *, {COHERENT.format(s='sx', a='30.0D')} AS rx, CASE WHEN v IS NULL THEN 0.0D ELSE {COHERENT.format(s='sv', a='30.0D')} END AS rv, CASE WHEN a IS NULL THEN 0.0D ELSE {COHERENT.format(s='sa', a='30.0D')} END AS ra FROM c)\n--\nSELECT det_id, round(cast(cx AS double) + CASE WHEN rv >= 0.1D THEN v ELSE 0.0D END + CASE WHEN rv >= 0.1D AND ra >= 0.1D THEN 0.5D*a ELSE 0.0D END, 3) AS x1, round((rx + rv + ra)/3, 5) AS r FROM k",
    "trk_best_output": f"n AS ({AGE}), h AS (SELECT frame_id, obj_type, sum(age*rd)/sum(age) AS p FROM n GROUP BY frame_id, obj_type), b AS (SELECT frame_id, obj_type, p, row_number() OVER (PARTITION BY frame_id ORDER BY round(p, 9) DESC, obj_type) AS rn FROM h)\n--\nSELECT n.frame_id, n.det_id, round(b.p, 6) AS p FROM b JOIN n ON n.frame_id = b.frame_id AND n.obj_type = b.obj_type WHERE b.rn = 1",
    "src_default_ts": f"s AS (SELECT object_id, det_id, t_us, CASE WHEN det_id % 5 > 0 THEN t_us END AS known FROM boxes), g AS (SELECT *, count(known) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM s)\n--\nSELECT det_id, coalesce(max(known) OVER (PARTITION BY object_id, run), 0) + (row_number() OVER (PARTITION BY object_id, run ORDER BY t_us, det_id) - 1)*80000 AS ts_us FROM g",
    "snk_tracks_xml": "SELECT frame_id, object_id, min(frame_id) OVER (PARTITION BY object_id) AS start_frame_track, cast(floor(cx - width/2.0) AS bigint) AS xmin, cast(floor(cx + width/2.0) AS bigint) AS xmax, cast(floor(cy - height/2.0) AS bigint) AS ymin, cast(floor(cy + height/2.0) AS bigint) AS ymax, cx AS x_center, cy AS y_center FROM boxes",
    "snk_planar_txt": f"{STEP}, fl AS (SELECT *, CASE WHEN h > 0 AND d/h > 30 THEN 1 ELSE 0 END AS mov, CASE WHEN cx BETWEEN 100 AND 540 AND cy BETWEEN 80 AND 400 THEN 0 ELSE 1 END AS far FROM sp), ch AS (SELECT *, CASE WHEN mov = 0 AND coalesce(lag(mov) OVER ({W}), 1) = 1 THEN 1 ELSE 0 END AS stop_ FROM fl), c AS (SELECT object_id, frame_id, row_number() OVER ({W}) AS num, sum(mov*coalesce(h, 0)) OVER ({W}) AS t_mov, sum((1-mov)*coalesce(h, 0)) OVER ({W}) AS t_still, sum(coalesce(d, 0)) OVER ({W}) AS dist, sum(stop_) OVER ({W}) AS stops, sum(far*coalesce(d, 0)) OVER ({W}) AS d_far, sum(far*coalesce(h, 0)) OVER ({W}) AS t_far FROM ch)\n--\nSELECT object_id, num, frame_id, round(t_mov, 4) AS t_mov, round(t_still, 4) AS t_still, round(dist, 4) AS dist, cast(stops AS bigint) AS stops, CASE WHEN stops > 0 THEN round(dist/stops, 4) END AS d_inter, round(100*d_far/nullif(dist, 0), 4) AS d_per, round(100*t_far/nullif(t_mov + t_still, 0), 4) AS t_per FROM c WHERE num % 10 = 0",
    "lrn_cutoff": "e AS (SELECT det_id, obj_type, cast(cx AS double) AS x, cast(cy AS double) AS y, CASE WHEN width*height > 80 THEN 'big' ELSE 'small' END AS size FROM boxes), m AS (SELECT obj_type, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM e GROUP BY obj_type), v AS (SELECT obj_type, size, count(*) AS k FROM e GROUP BY obj_type, size)\n--\nSELECT e.det_id, CASE WHEN abs(x - mx) <= 60 AND abs(y - my) <= 60 AND k >= 0.99D*n THEN 1 ELSE 0 END AS cut FROM e JOIN m ON m.obj_type = e.obj_type JOIN v ON v.obj_type = e.obj_type AND v.size = e.size",
    "lrn_recognise": f"s AS (SELECT object_id, det_id, obj_type, cast(cx AS double) AS x, cast(cy AS double) AS y, width > 28 AS wide, rd, lag(obj_type) OVER ({W}) AS prev, (t_us - lag(t_us) OVER ({W}))/3600000000.0D AS dwell FROM boxes), c AS (SELECT obj_type, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, avg(CASE WHEN wide THEN 1.0D ELSE 0.0D END) AS pw FROM s GROUP BY obj_type)\n--\nSELECT s.det_id, s.prev, s.obj_type, round((rd*exp(-power(x - mx, 2)/(2*sx*sx)) + rd*exp(-power(y - my, 2)/(2*sy*sy)) + 0.5D*CASE WHEN wide THEN pw ELSE 1 - pw END)/(2*rd + 0.5D), 6) AS p FROM s JOIN c ON c.obj_type = s.prev WHERE s.prev <> s.obj_type AND dwell > 1",
    "lrn_transition": f"s AS (SELECT object_id, t_us, det_id, obj_type, lag(obj_type) OVER ({W}) AS prev, lead(obj_type) OVER ({W}) AS nxt, (t_us - lag(t_us) OVER ({W}))/3600000000.0D AS h, (lead(t_us) OVER ({W}) - t_us)/3600000000.0D AS next_h FROM boxes), i AS (SELECT *, sum(CASE WHEN prev = obj_type THEN 0 ELSE 1 END) OVER ({W}) AS island FROM s), d AS (SELECT object_id, island, min(obj_type) AS src, max(CASE WHEN nxt <> obj_type THEN nxt END) AS dst, sum(CASE WHEN prev IS NULL THEN 0.0D WHEN prev <> obj_type THEN h/2 ELSE h END) + max(CASE WHEN nxt <> obj_type THEN next_h/2 END) AS dwell FROM i GROUP BY object_id, island)\n--\nSELECT src, dst, count(*) AS n, round(count(*)/cast(sum(count(*)) OVER (PARTITION BY src) AS double), 6) AS p, round(avg(dwell), 6) AS mean_t, round(stddev_pop(dwell), 5) AS sigma_t, round(min(dwell), 6) AS min_t, round(max(dwell), 6) AS max_t FROM d WHERE dst IS NOT NULL GROUP BY src, dst",
    "cls_score": "g AS (SELECT det_id, class, mean, rd AS rw, 1 - rd/2 AS rh, 0.5D AS rl, exp(-power(width-mean, 2)/(2*sigma*sigma)) AS w, exp(-power(height-mean, 2)/(2*sigma*sigma)) AS h, exp(-power((width + height)/2.0D - 1.2D*mean, 2)/(2*sigma*sigma)) AS l FROM boxes CROSS JOIN models)\n--\nSELECT det_id, class, round(w*h*l, 6) AS p, round((rw*w + rh*h + rl*l)/(rw + rh + rl), 6) AS pr, round((rw + rh + rl)/3, 6) AS r, round((w*mean + h*mean + l*1.2D*mean)/(3.2D*mean), 6) AS dp FROM g",
    "cls_assign": "s AS (SELECT det_id, class, exp(-power(width-mean, 2)/(2*sigma*sigma))*exp(-power(height-mean, 2)/(2*sigma*sigma)) AS p, CASE WHEN xleft < 10 OR xright > 629 OR ytop < 10 OR ybottom > 469 THEN exp(-power(least(width, height)-mean, 2)/(2*sigma*sigma)) ELSE 0.0D END AS q FROM boxes CROSS JOIN models), r AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY CASE WHEN p >= 0.3D THEN 0 WHEN q >= 0.3D THEN 1 ELSE 2 END, round(CASE WHEN p >= 0.3D THEN p ELSE q END, 9) DESC, class) AS rn FROM s)\n--\nSELECT det_id, CASE WHEN p >= 0.3D OR q >= 0.3D THEN class ELSE 'UNKNOWN' END AS class, p < 0.3D AND q >= 0.3D AS occluded FROM r WHERE rn = 1",
    "lrn_contextualise": "c AS (SELECT object_id, frame_id DIV 24 AS day, round(sum(rd*cx)/sum(rd), 6) AS x, round(sum(rd*cy)/sum(rd), 6) AS y, round(avg(rd), 6) AS r FROM boxes GROUP BY object_id, frame_id DIV 24), z AS (SELECT max(frame_id DIV 24) AS last_ FROM boxes), l AS (SELECT c.*, day - lag(day) OVER (PARTITION BY object_id ORDER BY day) AS gap, last_ - day AS left_, lead(day) OVER (PARTITION BY object_id ORDER BY day) - day AS next_gap FROM c CROSS JOIN z)\n--\nSELECT object_id, day, x, y, r, CASE WHEN gap IS NULL OR gap > 3 THEN 'new' ELSE 'update' END AS act, coalesce(next_gap, left_) > 3 AS expires FROM l",
    "snk_hierarchy_stats": f"s AS (SELECT frame_id DIV 24 AS frame, obj_type AS dst, lag(obj_type) OVER ({W}) AS src FROM boxes), st AS (SELECT dst, min(frame) AS born FROM s GROUP BY dst), ev AS (SELECT src, dst, min(frame) AS born FROM s WHERE src <> dst GROUP BY src, dst), f AS (SELECT DISTINCT frame FROM s), b AS (SELECT born, 1 AS state, 0 AS event FROM st UNION ALL SELECT born, 0, 1 FROM ev), d AS (SELECT f.frame, coalesce(sum(state), 0) AS state, coalesce(sum(event), 0) AS event FROM f LEFT JOIN b ON b.born = f.frame GROUP BY f.frame)\n--\nSELECT frame, cast(sum(state) OVER (ORDER BY frame) AS bigint) AS states, cast(sum(event) OVER (ORDER BY frame) AS bigint) AS events FROM d",
    "blob_biggest": "SELECT frame_id, det_id, area FROM (SELECT frame_id, det_id, width*height AS area, row_number() OVER (PARTITION BY frame_id ORDER BY width*height DESC, det_id) AS rn FROM boxes) r WHERE rn = 1",
    "blob_order_focal": "SELECT frame_id, det_id, row_number() OVER (PARTITION BY frame_id ORDER BY abs(cy - 240), abs(cx - 320), det_id) AS pos FROM boxes",
    "blob_contains_pixel": "SELECT a.det_id, p.x AS px_x FROM boxes a JOIN (VALUES (100, 100), (320, 240), (500, 50)) AS p(x, y) ON p.x BETWEEN a.xleft AND a.xright AND p.y BETWEEN a.ytop AND a.ybottom",
    "join_previous_seen": f"SELECT det_id, max(CASE WHEN rd >= 0.5 THEN t_us END) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS seen FROM boxes",
    "join_id_upsert": "o AS (SELECT object_id, frame_id DIV 24 AS day, count(*) AS n FROM boxes GROUP BY object_id, frame_id DIV 24)\n--\nSELECT coalesce(a.object_id, b.object_id) AS object_id, coalesce(a.day, b.day + 1) AS day, CASE WHEN b.day IS NULL THEN 'insert' WHEN a.day IS NULL THEN 'unseen' ELSE 'update' END AS act FROM o a FULL OUTER JOIN o b ON a.object_id = b.object_id AND a.day = b.day + 1",
    "join_semi_ids": "SELECT det_id FROM boxes WHERE object_id IN (SELECT object_id FROM boxes WHERE obj_type = 'signup' AND rd >= 0.9)",
    "join_hset_product": f"n AS ({AGE}), s AS (SELECT frame_id, obj_type, min(xleft) AS xleft, max(xright) AS xright, min(ytop) AS ytop, max(ybottom) AS ybottom FROM boxes GROUP BY frame_id, obj_type), j AS (SELECT a.frame_id, a.obj_type AS one, b.obj_type AS other FROM s a JOIN s b ON a.frame_id = b.frame_id AND a.obj_type < b.obj_type AND {HIT})\n--\nSELECT x.det_id AS a_id, y.det_id AS b_id, round(x.age*x.rd + y.age*y.rd, 4) AS value, x.age + y.age AS frames FROM j JOIN n x ON x.frame_id = j.frame_id AND x.obj_type = j.one JOIN n y ON y.frame_id = j.frame_id AND y.obj_type = j.other",
    "join_context_types": "SELECT det_id, ctx FROM boxes JOIN (VALUES ('pointer','click'),('pointer','view'),('all','ANY2D')) AS c(ctx, kind) ON obj_type = kind OR kind = 'ANY2D'",
    "agg_weighted_merge": "SELECT object_id, round(sum(rd*cx)/sum(rd), 6) AS mean, round(sqrt(greatest(0.0D, cast(sum(rd*cx*cx)/sum(rd) - (sum(rd*cx)/sum(rd))*(sum(rd*cx)/sum(rd)) AS double))), 5) AS sigma FROM boxes GROUP BY object_id",
    "agg_symbolic_hist": "SELECT object_id, obj_type, round(sum(rd)/sum(sum(rd)) OVER (PARTITION BY object_id), 6) AS p FROM boxes GROUP BY object_id, obj_type",
    "agg_label_bbox": "SELECT object_id, frame_id DIV 24 AS day, min(xleft) AS l, max(xright) AS r, min(ytop) AS t, max(ybottom) AS b FROM boxes GROUP BY object_id, frame_id DIV 24",
    "win_velocity": f"SELECT det_id, cx - lag(cx) OVER ({W}) AS vx, cy - lag(cy) OVER ({W}) AS vy FROM boxes",
    "win_velocity_dt": f"{STEP}\n--\nSELECT det_id, round((cx-px_)/nullif(h, 0), 4) AS vx FROM sp",
    "win_accel": f"v AS (SELECT det_id, object_id, t_us, cx - lag(cx) OVER ({W}) AS v FROM boxes)\n--\nSELECT det_id, v - lag(v) OVER ({W}) AS a FROM v",
    "win_planar_distance": f"{STEP}\n--\nSELECT det_id, round(sum(coalesce(d, 0)) OVER ({W}), 4) AS dist FROM sp",
    "win_planar_stats": f"{STEP}, fl AS (SELECT *, CASE WHEN h > 0 AND d/h > 30 THEN 1 ELSE 0 END AS mov FROM sp), ch AS (SELECT *, CASE WHEN mov <> coalesce(lag(mov) OVER ({W}), -1) THEN 1 ELSE 0 END AS turn FROM fl)\n--\nSELECT object_id, round(sum(coalesce(d, 0)), 4) AS dist, round(sum(CASE WHEN mov = 1 THEN coalesce(h, 0) ELSE 0 END), 6) AS t_mov, round(sum(CASE WHEN mov = 0 THEN coalesce(h, 0) ELSE 0 END), 6) AS t_still, cast(sum(CASE WHEN mov = 0 THEN turn ELSE 0 END) AS bigint) AS stops FROM ch GROUP BY object_id",
    "win_planar_stops": f"{STEP}, mo AS (SELECT *, CASE WHEN d > {STILL_SPEED}*h THEN 1 ELSE 0 END AS mov FROM sp WHERE px_ IS NOT NULL), nb AS (SELECT *, coalesce(lag(mov) OVER ({W}), 1) AS before, lead(mov) OVER ({W}) AS after, lead(h) OVER ({W}) AS next_h, sum(mov) OVER ({W}) AS run FROM mo), "
    f"rest AS (SELECT object_id, run, max(CASE WHEN before = 1 THEN h END) AS first_h, sum(h) - max(CASE WHEN before = 1 THEN h END)/2 AS held, max(CASE WHEN after = 1 THEN next_h END) AS exit_h FROM nb WHERE mov = 0 GROUP BY object_id, run), "
    f"kept AS (SELECT *, CASE WHEN held >= {STILL_TIME} THEN held WHEN held + exit_h/2 >= {STILL_TIME} THEN held + exit_h/2 END AS stop_h FROM rest), "
    "still AS (SELECT object_id, count(stop_h) AS stops, sum(coalesce(stop_h, 0)) AS t_still, sum(first_h/2 + CASE WHEN stop_h IS NULL AND exit_h IS NOT NULL THEN held + exit_h/2 ELSE 0 END) AS t_back FROM kept GROUP BY object_id), "
    "total AS (SELECT object_id, sum(d) AS dist, sum(CASE WHEN mov = 0 THEN 0 WHEN before = 1 THEN h ELSE h/2 END) AS t_mov FROM nb GROUP BY object_id)\n--\n"
    "SELECT t.object_id, cast(coalesce(stops, 0) AS bigint) AS stops, round(coalesce(t_still, 0), 6) AS t_still, round(t_mov + coalesce(t_back, 0), 6) AS t_mov, CASE WHEN stops > 0 THEN round(dist/stops, 4) END AS dist_interval FROM total t LEFT JOIN still s ON s.object_id = t.object_id",
    "win_time_accum": f"{STEP}\n--\nSELECT det_id, round(sum(coalesce(h, 0)) OVER ({W}), 6) AS hours FROM sp",
    "win_start_frame": "SELECT det_id, min(frame_id) OVER (PARTITION BY object_id) AS start_frame FROM boxes",
    "win_oldest_track": "SELECT day, object_id FROM (SELECT frame_id DIV 24 AS day, object_id, row_number() OVER (PARTITION BY frame_id DIV 24 ORDER BY count(*) DESC, object_id) AS rn FROM boxes GROUP BY frame_id DIV 24, object_id) r WHERE rn = 1",
    "win_contour_blur": "n AS (SELECT object_id, cx, row_number() OVER (PARTITION BY object_id ORDER BY t_us, det_id) - 1 AS k, count(*) OVER (PARTITION BY object_id) AS m FROM boxes)\n--\nSELECT a.object_id, a.k, round(sum(b.cx*w.w)/sum(w.w), 5) AS cx FROM n a JOIN (VALUES (-2, 0.0183D), (-1, 0.3679D), (0, 1.0D), (1, 0.3679D), (2, 0.0183D)) AS w(o, w) ON true JOIN n b ON b.object_id = a.object_id AND b.k = (a.k + w.o + a.m) % a.m GROUP BY a.object_id, a.k",
    "win_frame_gap": f"{STEP}\n--\nSELECT det_id, coalesce(t_us - pt, 80000) AS gap FROM sp",
    "win_buffer_n": f"SELECT det_id, min(xleft) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS lo, max(xright) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS hi, count(*) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM boxes",
    "top_contours": "c AS (SELECT object_id, frame_id DIV 24 AS day, count(*) AS n FROM boxes GROUP BY object_id, frame_id DIV 24)\n--\nSELECT object_id, day, n FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY n DESC, day) AS rn FROM c) r WHERE n >= 4 OR rn = 1",
    "trk_split_sets": "SELECT frame_id, object_id, count(*) AS members FROM boxes GROUP BY frame_id, object_id",
    "cls_size_check": "SELECT det_id, min(CASE WHEN width < lo OR height < lo THEN 1 ELSE 0 END) AS reduced, min(CASE WHEN width > hi OR height > hi THEN 1 ELSE 0 END) AS excessive FROM boxes CROSS JOIN models GROUP BY det_id",
    "src_gt_segmentation": "SELECT det_id, least(xleft, xright) - 4 AS x, least(ytop, ybottom) - 4 AS y, abs(xright - xleft) + 1 AS w, abs(ybottom - ytop) + 1 AS h, CASE obj_type WHEN 'click' THEN 'PERSON' WHEN 'view' THEN 'VEHICLE' ELSE 'UNKNOWN' END AS type FROM boxes",
}
#: Pairs of boxes of a frame: through the grid, widened by what may lie between them, for Spark; all of them for the other dialect.
NEAR = lambda reach: f"{grid.joined('boxes', 'boxes', reach=reach)} AND a.det_id < b.det_id"


def both(statement: str, near: str, plain: str) -> tuple[str, str]:
    """A statement with its join through the grid, and with the plain one."""
    return statement.replace("{join}", near), statement.replace("{join}", plain)


MERGEABLE = f"({BOTH} > 0.4D*{AREA_OF.format('a')} OR {BOTH} > 0.4D*{AREA_OF.format('b')} OR {GAP} < {REACH}) AND NOT ({OUTSIDE.format('a')} AND {OUTSIDE.format('b')})"
#: Blobs that share a tenth with where an object was, widened as its data are unreliable.
INVOLVED = f"m AS (SELECT * FROM (SELECT object_id, det_id, frame_id, lag(xleft) OVER ({W}) AS l, lag(xright) OVER ({W}) AS r, lag(ytop) OVER ({W}) AS t, lag(ybottom) OVER ({W}) AS b, (1 - lag(rd) OVER ({W}))*lag(width) OVER ({W})/2 + 2 AS wx, (1 - lag(rd) OVER ({W}))*lag(height) OVER ({W})/2 + 2 AS wy FROM boxes) w WHERE l IS NOT NULL), g AS (SELECT a.object_id, a.det_id, b.det_id AS blob, greatest(0.0D, least(a.r + wx, b.xright) - greatest(a.l - wx, b.xleft) + 1)*greatest(0.0D, least(a.b + wy, b.ybottom) - greatest(a.t - wy, b.ytop) + 1) AS shared, (a.r - a.l + 2*wx + 1)*(a.b - a.t + 2*wy + 1) AS own, b.width*b.height AS other FROM {{join}})\n--\nSELECT object_id, det_id, blob FROM g WHERE shared >= 0.1D*own OR shared >= 0.1D*other"
#: The place where each object was last seen reliably, to be looked for in its frame.
PLACES = f"n AS ({AGE}), s AS (SELECT *, max(CASE WHEN rd >= 0.5D THEN age END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM n), p AS (SELECT s.det_id, s.frame_id, n.cx, n.cy FROM s JOIN n ON n.object_id = s.object_id AND n.age = s.seen)"
NEAREST_SQL = f"{PLACES}, d AS (SELECT a.det_id, b.det_id AS nearest, row_number() OVER (PARTITION BY a.det_id ORDER BY power(b.cx - a.cx, 2) + power(b.cy - a.cy, 2), b.det_id) AS rn FROM p a JOIN boxes b ON a.frame_id = b.frame_id AND power(b.cx - a.cx, 2) + power(b.cy - a.cy, 2) <= 150*150)\n--\nSELECT det_id, nearest FROM d WHERE rn = 1"
_SETS = "s AS (SELECT frame_id DIV 24 AS day, frame_id, obj_type, {ids} AS ids, max(rd) AS p FROM boxes GROUP BY frame_id DIV 24, frame_id, obj_type), k AS (SELECT *, row_number() OVER (PARTITION BY day, ids ORDER BY p DESC, frame_id, obj_type) AS rn FROM s)\n--\nSELECT day, frame_id, obj_type, p FROM k WHERE rn = 1"
#: Statements whose two dialects differ: one row of each set of object ids within a day, the most probable.
PAIRED = {
    "hyp_dedup_sets": (_SETS.format(ids="array_join(sort_array(collect_set(object_id)), ',')"), _SETS.format(ids="array_to_string(list_sort(list_distinct(list(object_id))), ',')")),
    "join_bbox_intersect": both(f"SELECT a.det_id AS a_id, b.det_id AS b_id FROM {{join}} AND {HIT}", NEAR(0), SAME),
    "merge_candidates": both(f"SELECT a.det_id AS a_id, b.det_id AS b_id FROM {{join}} AND {MERGEABLE}", NEAR(36), SAME),
    "join_involved": both(INVOLVED, grid.joined("m", "boxes", ("l - wx", "r + wx", "t - wy", "b + wy"), reach=1), "m a JOIN boxes b ON a.frame_id = b.frame_id"),
}
