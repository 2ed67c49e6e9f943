"""What depends on the camera: heights at the image borders, where a box lies to the camera, ground positions, axes of blobs."""

from __future__ import annotations

from fluxtrail.functions.scene import P, image, world

WIDTH, HEIGHT, METRE = 640, 480, "100.0D"
#: The plane's 3 x 3 homography, as in ``geo_img_to_hom``.
H = ((0.02, 0.001, 1.0), (0.002, 0.03, 2.0), (0.0001, 0.0002, 1.0))


def border_height(axis: int, border: int) -> str:
    """The height over the ground point (cx, cy) at which its vertical meets an image border; null unless positive."""
    ground = lambda i: f"({P[i][0]}D*cx + {P[i][1]}D*cy + {P[i][3]}D)"
    h = f"(({ground(axis)} - {border}*{ground(2)})/({border}*{P[2][2]}D - ({P[axis][2]}D)))"
    return f"CASE WHEN {h} > 0 THEN {h} END"


def plane(u: str, v: str) -> tuple[str, str]:
    """The plane's coordinates of an image point."""
    row = lambda r: f"({r[0]}D*{u} + {r[1]}D*{v} + {r[2]}D)"
    return f"({row(H[0])}/{row(H[2])})", f"({row(H[1])}/{row(H[2])})"


def unplane(x: str, y: str) -> tuple[str, str]:
    """The image point of the plane's coordinates, from the two linear equations they set."""
    (a, b, e), (c, d, f) = ([f"({H[i][k]}D - {w}*{H[2][k]}D)" for k in range(3)] for i, w in ((0, x), (1, y)))
    det = f"nullif({a}*{d} - {b}*{c}, 0.0D)"
    return f"(({b}*{f} - {d}*{e})/{det})", f"(({c}*{e} - {a}*{f})/{det})"


def poles() -> str:
    """The relation seat(det_id, ..., code): the box's place to the camera, 3 * row + column.

    A pole of one metre is set up on the ground at the corners. Row 0: it rises on the screen at the lower left; row 1: at
    the upper left only; row 2: at neither. Column 2: the left pole (of the lower edge in row 0, else of the upper) leans
    right; column 0: it and the right one lean left; column 1: else.
    """
    corners = {"bl": ("xleft", "ybottom"), "br": ("xright", "ybottom"), "tl": ("xleft", "ytop"), "tr": ("xright", "ytop")}
    feet = ", ".join(f"{e} AS {axis}_{n}" for n, (u, v) in corners.items() for axis, e in zip("xy", world(u, v, "0.0D")[:2], strict=True))
    tips = ", ".join(f"{e} AS {axis}_{n}" for n in corners for axis, e in zip("uv", image(f"x_{n}", f"y_{n}", METRE), strict=True))
    box = "det_id, xleft, xright, ytop, ybottom, cx, cy"
    column = lambda e: f"CASE WHEN u_{e}l >= xleft THEN 2 WHEN u_{e}r <= xright THEN 0 ELSE 1 END"
    code = f"CASE WHEN v_bl <= ybottom THEN {column('b')} WHEN v_tl <= ytop THEN 3 + {column('t')} ELSE 6 + {column('t')} END"
    return f"foot AS (SELECT {box}, {feet} FROM boxes), tip AS (SELECT {box}, {tips} FROM foot), seat AS (SELECT {box}, {code} AS code FROM tip)\n--\n"


def bodies() -> dict[str, str]:
    limit = f"-({P[2][0]}D*cx + {P[2][1]}D*cy + {P[2][3]}D)/({P[2][2]}D)"
    lowest = "least(" + ", ".join(border_height(axis, border) for axis, border in ((0, 0), (0, WIDTH), (1, 0), (1, HEIGHT))) + ")"
    x, y = plane("cx", "cy")
    u, v = unplane("x", "y")
    anchor = "CASE WHEN code < 3 THEN 1.0D*ybottom WHEN code < 6 THEN (ytop + ybottom)/2.0D ELSE 1.0D*ytop END"
    gx, gy, _ = world("ax", "ay", "0.0D")
    moments = "m AS (SELECT frame, count(*) AS n, var_pop(cast(x AS double)) - var_pop(cast(y AS double)) AS d, 2*covar_pop(cast(x AS double), cast(y AS double)) AS c, var_pop(cast(x AS double)) + var_pop(cast(y AS double)) AS t FROM px WHERE r > 170 GROUP BY frame), s AS (SELECT *, sqrt(d*d + c*c) AS len FROM m)\n--\n"
    return {
        "geo_limit_height": f"SELECT det_id, round({limit}, 3) AS h FROM boxes",
        "geo_lowest_height": f"SELECT det_id, round({lowest}, 4) AS h FROM boxes",
        "geo_hom_to_img": f"p AS (SELECT det_id, {x} AS x, {y} AS y FROM boxes)\n--\nSELECT det_id, round({u}, 4) AS u, round({v}, 4) AS v FROM p",
        "geo_camera_position": poles() + "SELECT det_id, code FROM seat",
        "geo_est_3d_position": poles().replace("\n--\n", f", foot_at AS (SELECT det_id, (xleft + xright)/2.0D AS ax, {anchor} AS ay FROM seat)\n--\n") + f"SELECT det_id, round({gx}, 3) AS x, round({gy}, 3) AS y, 0.0D AS z FROM foot_at",
        "agg_pca_axis": moments + "SELECT frame, n, round(d/nullif(len, 0.0D), 5) + 0.0D AS cos2, round(c/nullif(len, 0.0D), 5) + 0.0D AS sin2, round((t + len)/2, 5) AS major, round((t - len)/2, 5) + 0.0D AS minor FROM s WHERE len > 0.000001D OR len = 0.0D",
        # What an object's independent models say its box is now: as seen, as moving on, as resting; blended by their reliabilities.
        "agg_multimodel_estimate": "o AS (SELECT det_id, "
        + ", ".join(f"{c}, lag({c}) OVER w AS {c}_1, lag({c}, 2) OVER w AS {c}_2" for c in ("xleft", "xright", "ytop", "ybottom"))
        + ", 1.0D*rd AS rd, lag(1.0D*rd) OVER w AS rd_1, lag(1.0D*rd, 2) OVER w AS rd_2 FROM boxes WINDOW w AS (PARTITION BY object_id ORDER BY t_us, det_id)), "
        + "m AS (SELECT det_id, rd AS r, 1.0D*xleft AS l, 1.0D*xright AS e, 1.0D*ytop AS t, 1.0D*ybottom AS b FROM o"
        + " UNION ALL SELECT det_id, least(rd_1, rd_2)/2, 2.0D*xleft_1 - xleft_2, 2.0D*xright_1 - xright_2, 2.0D*ytop_1 - ytop_2, 2.0D*ybottom_1 - ybottom_2 FROM o WHERE rd_2 IS NOT NULL"
        + " UNION ALL SELECT det_id, rd_1/4, xleft_1, xright_1, ytop_1, ybottom_1 FROM o WHERE rd_1 IS NOT NULL)\n--\n"
        + "SELECT det_id, "
        + ", ".join(f"round(sum(r*{c})/sum(r), 4) AS {n}" for c, n in (("l", "l"), ("e", "r"), ("t", "t"), ("b", "b"), ("(e - l + 1)", "width"), ("(b - t + 1)", "height"), ("(l + e)/2", "x"), ("(t + b)/2", "y")))
        + ", round(avg(r), 6) AS reliability FROM m GROUP BY det_id",
        "agg_multimodel_p": "m AS (SELECT det_id, exp(-power(width - mean, 2)/(2*sigma*sigma)) AS p, CASE WHEN width BETWEEN lo AND hi THEN 1.0D*rd ELSE 0.1D*rd END AS r FROM boxes CROSS JOIN models)\n--\nSELECT det_id, round(sum(r*p)/sum(r), 6) AS p, round(sum(r)/count(*), 6) AS r FROM m GROUP BY det_id",
    }
