"""Pixel operators over px(frame, x, y, r, g, b): stencils are equi-joins of the nine places around each pixel."""

LAG = "px p JOIN px q ON q.frame = p.frame - 1 AND q.x = p.x AND q.y = p.y"
#: The nine places of a neighbourhood: a pixel is sent to each, and meets its neighbours by equal frame, x and y.
OFFSETS = "(VALUES (-1, -1), (0, -1), (1, -1), (-1, 0), (0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)) AS o(dx, dy)"
NEAR = f"px p CROSS JOIN {OFFSETS} JOIN px q ON q.frame = p.frame AND q.x = p.x + o.dx AND q.y = p.y + o.dy"
DIFF = "((p.r-q.r)*(p.r-q.r) + (p.g-q.g)*(p.g-q.g) + (p.b-q.b)*(p.b-q.b))"
FG = f"fg AS (SELECT p.frame, p.x, p.y, CASE WHEN {DIFF} > 22500 THEN 1 ELSE 0 END AS on_ FROM {LAG})"
NEAR_FG = f"CROSS JOIN {OFFSETS} JOIN {{b}} q ON q.frame = p.frame AND q.x = p.x + o.dx AND q.y = p.y + o.dy GROUP BY p.frame, p.x, p.y"
#: Integer hue; quotients of negative differences are cut off towards zero, and reds with more blue than green are below 360.
HUE = "CASE WHEN mx = mn THEN 0 WHEN mx = r AND g >= b THEN (60*(g-b)) DIV (mx-mn) WHEN mx = r THEN 360 - (60*(b-g)) DIV (mx-mn) WHEN mx = g AND b >= r THEN 120 + (60*(b-r)) DIV (mx-mn) WHEN mx = g THEN 120 - (60*(r-b)) DIV (mx-mn) WHEN r >= g THEN 240 + (60*(r-g)) DIV (mx-mn) ELSE 240 - (60*(g-r)) DIV (mx-mn) END"
#: The outline of a box in space as it shows in a frame, clockwise, and the test of a pixel against its sides.
CUBE = ((3, 6), (7, 3), (13, 4), (13, 11), (9, 14), (3, 13))
INSIDE = " AND ".join(f"({c - a})*(y - {b}) - ({d - b})*(x - {a}) >= 0" for (a, b), (c, d) in zip(CUBE, CUBE[1:] + CUBE[:1], strict=True))
HUE_BINS, LAGS = ", ".join(f"({k})" for k in range(36)), ", ".join(f"({k})" for k in range(1, 21))
RANGE = "SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM px"
BODIES = {
    "px_global_bg": f"d AS (SELECT p.frame, p.x, p.y, p.r - q.r AS dr, p.g - q.g AS dg, p.b - q.b AS db, q.r, q.g, q.b FROM {LAG}), k AS (SELECT p.frame, p.x, p.y, avg(cast(q.dr AS double)) AS dr, avg(cast(q.dg AS double)) AS dg, avg(cast(q.db AS double)) AS db FROM d p CROSS JOIN {OFFSETS} JOIN d q ON q.frame = p.frame AND q.x = p.x + o.dx AND q.y = p.y + o.dy WHERE p.x % 4 = 1 AND p.y % 4 = 1 GROUP BY p.frame, p.x, p.y), m AS (SELECT frame, avg(dr) AS dr, avg(dg) AS dg, avg(db) AS db, abs(avg(dr)) + abs(avg(dg)) + abs(avg(db)) > 25 AS shift FROM k GROUP BY frame)\n--\nSELECT d.frame, max(m.shift) AS shift, round(max(m.dr), 5) AS dr, round(avg(CASE WHEN shift THEN least(255.0D, greatest(0.0D, d.r + m.dr)) ELSE d.r END), 5) AS bg_r, round(avg(CASE WHEN shift THEN least(255.0D, greatest(0.0D, d.g + m.dg)) ELSE d.g END), 5) AS bg_g, round(avg(CASE WHEN shift THEN least(255.0D, greatest(0.0D, d.b + m.db)) ELSE d.b END), 5) AS bg_b FROM d JOIN m ON m.frame = d.frame GROUP BY d.frame",
    "px_zone_mask": "v AS (SELECT frame, x, y, row_number() OVER (PARTITION BY frame ORDER BY y, x) AS nth, x - row_number() OVER (PARTITION BY frame, y ORDER BY x) AS run FROM px WHERE x BETWEEN 2 AND 13 AND NOT (x BETWEEN 6 AND 9 AND y BETWEEN 6 AND 9))\n--\nSELECT frame, y, 'run' AS kind, min(x) AS x0, max(x) AS x1 FROM v GROUP BY frame, y, run UNION ALL SELECT frame, y, 'sample', x, x FROM v WHERE nth % 4 = 0",
    "agg_density": f"{FG}, i AS (SELECT frame, on_, CASE WHEN {INSIDE} THEN 1 ELSE 0 END AS in_ FROM fg), n AS (SELECT frame, sum(on_*in_) AS tp, sum((1-on_)*(1-in_)) AS tn, sum((1-on_)*in_) AS fp, sum(on_*(1-in_)) AS fn FROM i GROUP BY frame)\n--\nSELECT frame, cast(tp AS bigint) AS tp, cast(tn AS bigint) AS tn, cast(fp AS bigint) AS fp, cast(fn AS bigint) AS fn, round(tp/nullif(cast(tp + fp AS double), 0), 6) AS inside_rate, round((tp + tn)/cast(tp + tn + fp + fn AS double), 6) AS agreement FROM n",
    "px_chromatic": f"SELECT frame, x, y, CASE WHEN mx - mn > 30 AND (mx + mn) DIV 2 < 180 AND (hue >= 300 OR hue <= 60) THEN 1 ELSE 0 END AS keep FROM (SELECT *, {HUE} AS hue FROM ({RANGE}) a) h",
    "px_aperture": f"{FG}, er AS (SELECT p.frame, p.x, p.y, min(q.on_) AS on_ FROM fg p {NEAR_FG.format(b='fg')})\n--\nSELECT p.frame, p.x, p.y, max(q.on_) AS fg FROM er p {NEAR_FG.format(b='er')}",
    "px_close": f"{FG}, di AS (SELECT p.frame, p.x, p.y, max(q.on_) AS on_ FROM fg p {NEAR_FG.format(b='fg')})\n--\nSELECT p.frame, p.x, p.y, min(q.on_) AS fg FROM di p {NEAR_FG.format(b='di')}",
    "px_histogram": "SELECT frame, channel, v, count(*) AS n FROM (SELECT frame, 'R' AS channel, r AS v FROM px UNION ALL SELECT frame, 'G', g FROM px UNION ALL SELECT frame, 'B', b FROM px UNION ALL SELECT frame, 'Y', (r+g+b) DIV 3 FROM px) c GROUP BY frame, channel, v",
    "px_peaks_moments": "c AS (SELECT frame, 'R' AS channel, r AS v FROM px UNION ALL SELECT frame, 'G', g FROM px UNION ALL SELECT frame, 'B', b FROM px UNION ALL SELECT frame, 'Y', (r+g+b) DIV 3 FROM px), h AS (SELECT frame, channel, v, count(*) AS n FROM c GROUP BY frame, channel, v), f AS (SELECT channel, min(frame) AS first_ FROM h GROUP BY channel), k AS (SELECT h.*, row_number() OVER (PARTITION BY h.channel ORDER BY n DESC, v) AS rn FROM h JOIN f ON f.channel = h.channel AND f.first_ = h.frame), pk AS (SELECT channel, frame, v AS peak FROM k WHERE rn = 1), m AS (SELECT h.frame, h.channel, pk.peak, sum(cast(h.v*h.n AS double))/sum(h.n) AS m1, sum(cast(h.v*h.v*h.n AS double))/sum(h.n) AS m2 FROM h JOIN pk ON pk.channel = h.channel AND h.frame > pk.frame LEFT JOIN h p ON p.frame = h.frame AND p.channel = h.channel AND p.v = pk.peak WHERE h.n >= 0.1D*coalesce(p.n, 0) GROUP BY h.frame, h.channel, pk.peak)\n--\nSELECT frame, channel, peak, round(m1, 6) AS m1, round(sqrt(greatest(0.0D, m2 - m1*m1)), 5) AS spread, CASE WHEN channel = 'Y' THEN round(peak + 0.75D*sqrt(greatest(0.0D, m2 - m1*m1)), 5) ELSE round(sqrt(greatest(0.0D, m2 - m1*m1)), 5) END AS threshold FROM m",
    "px_grass": "SELECT frame, x, y, CASE WHEN g > r AND g > b AND g BETWEEN 60 AND 220 THEN 1 ELSE 0 END AS grass FROM px",
    "px_line_filter": f"SELECT p.frame, p.x, p.y, cast(sum(((q.r+q.g+q.b) DIV 3) * CASE WHEN q.x = p.x AND q.y = p.y THEN 4 WHEN q.x = p.x OR q.y = p.y THEN 1 ELSE -2 END) AS bigint) AS v FROM {NEAR} WHERE p.x BETWEEN 1 AND 14 AND p.y BETWEEN 1 AND 14 GROUP BY p.frame, p.x, p.y",
    "px_block_match": "blk AS (SELECT frame, x DIV 4 AS bx, y DIV 4 AS by_, x % 4 AS ox, y % 4 AS oy, r FROM px), sq AS (SELECT p.frame, p.bx, p.by_, q.bx AS sx, q.by_ AS sy, cast(sum((p.r-q.r)*(p.r-q.r)) AS bigint) AS d FROM blk p JOIN blk q ON q.frame = p.frame - 1 AND q.ox = p.ox AND q.oy = p.oy AND abs(q.bx - p.bx) <= 1 AND abs(q.by_ - p.by_) <= 1 GROUP BY p.frame, p.bx, p.by_, q.bx, q.by_)\n--\nSELECT frame, bx, by_, min(d) AS best, CASE WHEN min(d) < 0.9*min(CASE WHEN sx = bx AND sy = by_ THEN d END) THEN 'MOVING' ELSE 'STILL' END AS kind FROM sq GROUP BY frame, bx, by_",
    "px_corr": "SELECT p.frame, p.x DIV 4 AS bx, p.y DIV 4 AS by_, round(corr(cast(p.r AS double), cast(q.r AS double)), 6) AS c FROM px p JOIN px q ON q.frame = p.frame - 1 AND q.x = p.x AND q.y = p.y GROUP BY p.frame, p.x DIV 4, p.y DIV 4",
    "px_hue_hist": f"a AS (SELECT frame, {HUE} AS hue FROM ({RANGE}) c), h AS (SELECT frame, (hue % 360) DIV 10 AS bin, count(*) AS n FROM a GROUP BY frame, (hue % 360) DIV 10), acc AS (SELECT frame, round(100*avg(CASE WHEN hue >= 300 OR hue <= 60 THEN 1.0D ELSE 0.0D END), 4) AS accuracy FROM a GROUP BY frame), f AS (SELECT acc.frame, acc.accuracy, v.bin, coalesce(h.n, 0) AS n FROM acc CROSS JOIN (VALUES {HUE_BINS}) AS v(bin) LEFT JOIN h ON h.frame = acc.frame AND h.bin = v.bin), t AS (SELECT *, max(n) OVER (PARTITION BY frame) AS top, first_value(bin) OVER (PARTITION BY frame ORDER BY n DESC, bin) AS dominant FROM f)\n--\nSELECT frame, bin, n, dominant, coalesce(max(CASE WHEN bin < dominant AND n < 0.2D*top THEN bin END) OVER (PARTITION BY frame) + 1, 0) AS lo, coalesce(min(CASE WHEN bin > dominant AND n < 0.2D*top THEN bin END) OVER (PARTITION BY frame) - 1, 35) AS hi, accuracy FROM t",
    "px_color_hist2d": f"{FG}, c AS (SELECT px.frame, on_, (500*r - 419*g - 81*b + 128000) DIV 32000 AS cr, (500*b - 331*g - 169*r + 128000) DIV 32000 AS cb FROM px JOIN fg ON fg.frame = px.frame AND fg.x = px.x AND fg.y = px.y), n AS (SELECT frame, on_, cr, cb, count(*)/cast(sum(count(*)) OVER (PARTITION BY frame, on_) AS double) AS p FROM c GROUP BY frame, on_, cr, cb), u AS (SELECT frame, cr, cb, sum(CASE WHEN on_ = 1 THEN p ELSE 0.0D END) AS f, sum(CASE WHEN on_ = 0 THEN p ELSE 0.0D END) AS g FROM n GROUP BY frame, cr, cb)\n--\nSELECT frame, round(sum(abs(f - g)), 6) AS l1 FROM u GROUP BY frame",
    "px_movement_window": f"{FG}\n--\nSELECT p.frame, p.x, p.y, sum(q.on_) AS n FROM fg p {NEAR_FG.format(b='fg')}",
    "agg_centroid": f"{FG}\n--\nSELECT frame, round(avg(cast(x AS double)), 6) AS cx, round(avg(cast(y AS double)), 6) AS cy, round(var_pop(cast(x AS double)), 6) AS vx, round(covar_pop(cast(x AS double), cast(y AS double)), 6) AS cxy FROM fg WHERE on_ = 1 GROUP BY frame",
}
GRAY = ("SELECT frame, x, y, r ^ (r >> 1) AS code FROM px", "SELECT frame, x, y, xor(r, r >> 1) AS code FROM px")
#: A pixel is sent to each earlier frame and meets the one there by equal place. Spark would put the lags after the join of
#: all frames of a place, so they are made into rows of the pixel before it.
VIBE = f"y AS (SELECT frame, x, y, (r+g+b) DIV 3 AS v FROM px)\n--\nSELECT p.frame, p.x, p.y, count(*) AS samples, CASE WHEN sum(CASE WHEN abs(p.v - q.v) <= 20 THEN 1 ELSE 0 END) >= 2 THEN 0 ELSE 1 END AS fg FROM y p CROSS JOIN (VALUES {LAGS}) AS k(k) JOIN y q ON q.x = p.x AND q.y = p.y AND q.frame = p.frame - k.k GROUP BY p.frame, p.x, p.y"
VIBE_PAIR = (VIBE.replace(f"FROM y p CROSS JOIN (VALUES {LAGS}) AS k(k) JOIN y q ON", f"FROM (SELECT *, explode(array({LAGS})) AS k FROM y) p JOIN y q ON").replace("p.frame - k.k", "p.frame - p.k"), VIBE)
