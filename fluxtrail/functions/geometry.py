"""Box geometry as SQL expressions over two boxes a and b: (ax, ay, aw, ah, ar, ab) and (bx, by_, bw, bh, br, bb)."""

OVERLAP_W = "(least(ar, br) - greatest(ax, bx) + 1)"
OVERLAP_H = "(least(ab, bb) - greatest(ay, by_) + 1)"
#: One shared pixel column or row is no intersection.
MEETS = "(greatest(ax, bx) < least(ar, br) AND greatest(ay, by_) < least(ab, bb))"
AREA = f"CASE WHEN {MEETS} THEN {OVERLAP_W} * {OVERLAP_H} ELSE 0 END"
GAP_X = "greatest(0, greatest(ax, bx) - least(ar, br))"
GAP_Y = "greatest(0, greatest(ay, by_) - least(ab, bb))"
#: The upper of two stacked boxes stands within the area of interest.
ON_GROUND = "{x} BETWEEN 100 AND 540 AND {y} BETWEEN 80 AND 400"
EXPRESSIONS = {
    "geo_rect_init": {"xr": "ax + aw - 1", "yb": "ay + ah - 1"},
    "geo_center": {"cx": "ax + aw DIV 2", "cy": "ay + ah DIV 2"},
    "geo_union": {"l": "least(ax, bx)", "t": "least(ay, by_)", "r": "greatest(ar, br)", "b": "greatest(ab, bb)"},
    "geo_intersection": {"l": f"CASE WHEN {MEETS} THEN greatest(ax, bx) END", "t": f"CASE WHEN {MEETS} THEN greatest(ay, by_) END", "area": AREA},
    "geo_contained_ratio": {"ratio": f"round(({AREA}) / cast(aw * ah AS double), 6)"},
    "geo_strict_ratio": {"ratio": f"round((greatest(aw*ah, bw*bh) - ({AREA})) / cast(greatest(aw*ah, bw*bh) AS double), 6)"},
    "geo_rect_dist": {"h": GAP_X, "v": GAP_Y, "d": f"round(sqrt(cast(({GAP_X})*({GAP_X}) + ({GAP_Y})*({GAP_Y}) AS double)), 6)"},
    "geo_gravity_dist": {"d": "round(sqrt(cast((acx-bcx)*(acx-bcx) + (acy-bcy)*(acy-bcy) AS double)), 6)"},
    "geo_inside": {"inside": "CASE WHEN ax >= bx AND ar <= br AND ay >= by_ AND ab <= bb THEN 1 ELSE 0 END"},
    "geo_point_in_rect": {"inside": "CASE WHEN acx BETWEEN bx AND br AND acy BETWEEN by_ AND bb THEN 1 ELSE 0 END"},
    "geo_rect_area": {"area": "aw * ah"},
    "geo_distance2": {"d": "round(sqrt(cast((ax-bx)*(ax-bx) + (ay-by_)*(ay-by_) AS double)), 6)"},
    "geo_distance3": {"d": "round(sqrt(cast((ax-bx)*(ax-bx) + (ay-by_)*(ay-by_) + (aw-bw)*(aw-bw) AS double)), 6)"},
    "geo_ccw": {"side": "cast(sign((ar-ax)*(by_-ay) - (ab-ay)*(bx-ax)) AS int)"},
    "geo_line_intersect": {"parallel": "CASE WHEN (ar-ax)*(bb-by_) - (ab-ay)*(br-bx) = 0 THEN 1 ELSE 0 END", "u": "round(cast((bx-ax)*(bb-by_) - (by_-ay)*(br-bx) AS double) / nullif((ar-ax)*(bb-by_) - (ab-ay)*(br-bx), 0), 6)"},
    "geo_point_line": {"d": "round(abs(cast((ar-ax)*(ay-by_) - (ax-bx)*(ab-ay) AS double)) / sqrt(cast((ar-ax)*(ar-ax) + (ab-ay)*(ab-ay) AS double)), 6)"},
    "geo_interval_intersect": {"lo": "CASE WHEN greatest(ax, bx) <= least(ar, br) THEN greatest(ax, bx) END", "hi": "CASE WHEN greatest(ax, bx) <= least(ar, br) THEN least(ar, br) END"},
    "geo_interval_unify": {"lo": "least(ax, bx)", "hi": "greatest(ar, br)"},
    "geo_ellipse_contains": {"inside": "CASE WHEN ((acx-320)/120.0D)*((acx-320)/120.0D) + ((acy-240)/90.0D)*((acy-240)/90.0D) < 1 THEN 1 ELSE 0 END"},
    "geo_img_to_hom": {"x": "round((0.02D*acx + 0.001D*acy + 1) / (0.0001D*acx + 0.0002D*acy + 1), 6)", "y": "round((0.002D*acx + 0.03D*acy + 2) / (0.0001D*acx + 0.0002D*acy + 1), 6)"},
    "geo_anchor_xy": {"x": "CASE det_id % 3 WHEN 0 THEN ax WHEN 1 THEN ax + aw DIV 2 ELSE ar END", "y": "CASE (det_id DIV 3) % 3 WHEN 0 THEN ay WHEN 1 THEN ay + ah DIV 2 ELSE ab END"},
    "geo_blob_same": {"same": "CASE WHEN abs(ax-bx) <= 0.5 AND abs(ay-by_) <= 0.5 AND abs(ar-br) <= 0.5 AND abs(ab-bb) <= 0.5 THEN 1 ELSE 0 END"},
    "math_gaussian": {"g": "round(exp(-(acx-bcx)*(acx-bcx)/(2*30.0D*30.0D)), 6)", "ng": "round(0.39894228D/30.0D*exp(-(acx-bcx)*(acx-bcx)/(2*30.0D*30.0D)), 8)"},
    "math_round_int": {"n": "CASE WHEN acx - floor(acx) > 0.5 THEN cast(floor(acx) AS bigint) + 1 ELSE cast(floor(acx) AS bigint) END"},
    "math_clamp01": {"c": "least(1.0D, greatest(0.0D, cast(aw - 20 AS double)/20.0D))"},
    "math_equal_eps": {"same": "CASE WHEN abs(cast(acx - bcx AS double)) < 1e-10 THEN 1 ELSE 0 END"},
    "math_coherence_sigma": {"c": "round(CASE WHEN aw <= 20 THEN 1.0D ELSE 20.0D/aw END, 6)"},
    "math_coherence_prob": {"p": "round(CASE WHEN aw = 8 THEN (CASE WHEN acx = bcx THEN 1.0D ELSE 0.0D END) ELSE exp(-cast((acx-bcx)*(acx-bcx) AS double)/(2.0D*aw*aw)) END, 6)"},
    "math_dim_reliability": {"r": "round(least(1.0D, aw*ah/400.0D), 6)", "q": "round(1 - least(1.0D, abs(aw - bw)/2.0D/40.0D), 6)"},
    "math_min_angular": {"d": "round(least(abs(atan2(cast(ay AS double), ax+1) - atan2(cast(by_ AS double), bx+1)), 2*pi() - abs(atan2(cast(ay AS double), ax+1) - atan2(cast(by_ AS double), bx+1))), 6)"},
    "merge_distance": {"near": f"CASE WHEN sqrt(cast(({GAP_X})*({GAP_X}) + ({GAP_Y})*({GAP_Y}) AS double)) < 40.0D * CASE WHEN ({OVERLAP_W})/cast(least(aw, bw) AS double) < 0.5D THEN 1.0D WHEN ab < by_ AND ({ON_GROUND.format(x='acx', y='ab')}) OR bb < ay AND ({ON_GROUND.format(x='bcx', y='bb')}) THEN 1.5D ELSE 3.5D END THEN 1 ELSE 0 END"},
    "blob_merge": {"l": "least(ax, bx)", "t": "least(ay, by_)", "w": "greatest(ar, br) - least(ax, bx) + 1", "h": "greatest(ab, bb) - least(ay, by_) + 1", "r": "round((ard + brd)/2, 6)"},
    "trk_special_cases": {"kind": f"CASE WHEN ({AREA}) >= 0.95D*aw*ah AND ({AREA}) >= 0.95D*bw*bh THEN 'NORMAL' WHEN ({AREA}) >= 0.95D*aw*ah AND bw*bh > aw*ah THEN 'PARTIALLY_DETECTED' WHEN ({AREA}) < 0.05D*bw*bh AND ({AREA}) < 0.95D*aw*ah THEN 'LOST' WHEN ({AREA}) >= 0.95D*bw*bh AND aw*ah > bw*bh THEN 'PART_OF_BIGGER' ELSE 'NORMAL' END"},
    "cls_border_flag": {"flags": "(CASE WHEN ax <= 0 THEN 1 ELSE 0 END) | (CASE WHEN ar >= 639 THEN 2 ELSE 0 END) | (CASE WHEN ay <= 0 THEN 4 ELSE 0 END) | (CASE WHEN ab >= 479 THEN 8 ELSE 0 END)"},
    "trk_out_of_scene": {"out": "CASE WHEN ar < -3 OR ab < -3 OR ax > 642 OR ay > 482 THEN 1 ELSE 0 END"},
    "math_cooling": {"c": "round(exp(-0.1D*(t_us - bt_us)/3600000000.0D), 6)"},
    "trk_bbox_support": {n: f"round(b{p} + greatest(-12.0D*(1 - brd), least(12.0D*(1 - brd), a{q} - b{p})), 5)" for n, p, q in (("l", "x", "x"), ("t", "y_", "y"), ("r", "r", "r"), ("b", "b", "b"))},
    "time_diff_ms": {"ms": "(t_us - bt_us) DIV 1000"},
}


def bodies() -> dict[str, str]:
    """A statement per expression set, over a box and the box before it of the same object."""
    return {name: "SELECT det_id, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM pairs" for name, columns in EXPRESSIONS.items()}
