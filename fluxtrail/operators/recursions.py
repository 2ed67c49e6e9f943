"""Ordered recursions per object, as a fold over the object's rows in time."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame

from fluxtrail.operators.folds import ordered_fold

#: Per hour.
LAMBDA = 0.1
HOUR_US = 3_600_000_000.0


def cooling(boxes: DataFrame) -> DataFrame:
    """det_id, cooling: the sum over the object's rows so far of exp(-LAMBDA * age in hours)."""

    def step(state: dict, row: Any) -> list[tuple]:
        old = state.get("s", 0.0) * math.exp(-LAMBDA * (row.t_us - state.get("t", row.t_us)) / HOUR_US)
        state.update(t=row.t_us, s=1 + old)
        return [(row.det_id, round(state["s"], 6))]

    return ordered_fold(boxes.select("object_id", "t_us", "det_id"), ["object_id"], ["t_us", "det_id"], "det_id long, cooling double", dict, step)


def reliability(boxes: DataFrame) -> DataFrame:
    """object_id, value, acc_r, rd_out: the reliability-weighted value after all rows, its accumulated and mean reliability."""

    def step(state: dict, row: Any) -> list[tuple]:
        c = math.exp(-LAMBDA * (row.t_us - state.get("t", row.t_us)) / HOUR_US)
        old = c * state.get("acc", 0.0)
        acc = float(row.rd) + old
        value = (float(row.cx) * float(row.rd) + old * state.get("value", 0.0)) / acc
        state.update(key=row.object_id, t=row.t_us, acc=acc, cool=1 + c * state.get("cool", 0.0), value=value)
        return []

    def finish(state: dict) -> list[tuple]:
        return [(state["key"], round(state["value"], 5), round(state["acc"], 6), round(min(1.0, state["acc"] / state["cool"]), 6))]

    rows = boxes.select("object_id", "t_us", "det_id", "cx", "rd")
    return ordered_fold(rows, ["object_id"], ["t_us", "det_id"], "object_id long, value double, acc_r double, rd_out double", dict, step, finish)


#: Closed forms of the same: every earlier row of the object weighs exp(-LAMBDA * age).
COOLING_SQL = f"SELECT a.det_id, round(sum(exp(-{LAMBDA}*(a.t_us - b.t_us)/3600000000.0::double)), 6) AS cooling FROM boxes a JOIN boxes b ON a.object_id = b.object_id AND (b.t_us < a.t_us OR b.t_us = a.t_us AND b.det_id <= a.det_id) GROUP BY a.det_id"
RELIABILITY_SQL = f"m AS (SELECT object_id, max(t_us) AS z FROM boxes GROUP BY object_id), w AS (SELECT b.object_id, rd, cx, exp(-{LAMBDA}*(z - t_us)/3600000000.0::double) AS k FROM boxes b JOIN m ON b.object_id = m.object_id)\n--\nSELECT object_id, round(sum(k*rd*cx)/sum(k*rd), 5) AS value, round(sum(k*rd), 6) AS acc_r, round(least(1.0, sum(k*rd)/sum(k)), 6) AS rd_out FROM w GROUP BY object_id"


def mobile_size(boxes: DataFrame, length: float = 20.0, spread: float = 40.0) -> DataFrame:
    """det_id, w, sd_w, rc_w, h, sd_h, rc_h: size of an object on the screen after each row, blended by the reliability of
    its area, min(1, w*h / length^2); coherence falls from 1 to 0 as the deviation grows to ``spread``."""

    def step(state: dict, row: Any) -> list[tuple]:
        weight = min(1.0, row.width * row.height / length**2)
        cool = math.exp(-LAMBDA * (row.t_us - state.get("t", row.t_us)) / HOUR_US)
        old = cool * state.get("acc", 0.0)
        acc, sums = weight + old, 1 + cool * state.get("sums", 0.0)
        rd = min(1.0, acc / sums)
        out = [row.det_id]
        for name, data in (("w", float(row.width)), ("h", float(row.height))):
            value, sd = state.get(name, (data, 0.0))
            sd = math.sqrt(old / acc * (sd**2 + weight * (data - value) ** 2 / rd))
            value = (data * weight + old * value) / acc
            state[name] = (value, sd)
            out += [round(value, 5), round(sd, 5), round(1 - min(1.0, sd / spread), 6)]
        state.update(t=row.t_us, acc=acc, sums=sums)
        return [tuple(out)]

    shape = "det_id long, w double, sd_w double, rc_w double, h double, sd_h double, rc_h double"
    return ordered_fold(boxes.select("object_id", "t_us", "det_id", "width", "height"), ["object_id"], ["t_us", "det_id"], shape, dict, step)


def mobile_place(boxes: DataFrame, columns: tuple[str, str] = ("cx", "cy"), expect: bool = False) -> DataFrame:
    """det_id, x, y, vx, vy: place and speed (an hour) of an object after each row, blended with the place its speed foretells.

    ``expect`` blends the result once more with the foretold place, by the reliability of the data and of the speed: the
    recursion of objects in space, whose ``columns`` are places on the ground.
    """

    def step(state: dict, row: Any) -> list[tuple]:
        hours = (row.t_us - state.get("t", row.t_us)) / HOUR_US
        old = math.exp(-LAMBDA * hours) * state.get("acc", 0.0)
        acc = row.rd + old
        out, speeds = [row.det_id], []
        for name in columns:
            data = float(getattr(row, name))
            value, speed, last = state.get(name, (data, 0.0, data))
            guess = value + speed * hours
            if state and hours > 0:
                speed = (row.rd * (data - last) / hours + old * speed) / acc
            value = (data * row.rd + old * guess) / acc
            if expect:
                trust = 1 / (1 + abs(speed) / 100)
                value = (row.rd * value + (1 - row.rd) * trust * guess) / (row.rd + (1 - row.rd) * trust)
            state[name] = (value, speed, data)
            out.append(round(value, 4))
            speeds.append(round(speed, 4))
        state.update(t=row.t_us, acc=acc)
        return [tuple(out + speeds)]

    shape = "det_id long, x double, y double, vx double, vy double"
    return ordered_fold(boxes.select("object_id", "t_us", "det_id", "rd", *columns), ["object_id"], ["t_us", "det_id"], shape, dict, step)


SHAPE = "det_id long, w double, rw double, l double, rl double, h double, rh double, cos2 double, sin2 double, turn double, ra double"


def wrapped(angle: float) -> float:
    """An angle modulo pi, from -pi/2 on."""
    return angle - math.pi * math.floor(angle / math.pi + 0.5)


def mobile_shape(samples: DataFrame, spread: float = 20.0) -> DataFrame:
    """SHAPE rows: width, length, height and orientation of an object in space after each row, with their reliabilities.

    ``samples`` has object_id, t_us, det_id, w, l, h, alpha and the reliabilities of its dimensions, rw, rl, rh. An angle is
    the same after half a turn; after a quarter turn it is with width and length swapped, so a sample more than an eighth
    of a turn from what the object's turning foretells is taken the other way round. Each dimension is blended by its own
    reliability, cooled over time; a dimension's reliability is the mean of that of its data and of its coherence, which
    falls from 1 to 0 as the deviation grows to ``spread`` (for the angle: to pi/2). cos2 and sin2 are those of twice the
    angle, ``turn`` is its change an hour. A row without a shape (null w) cools what is known and foretells the angle; rows
    before the first shape have null values.
    """

    def step(state: dict, row: Any) -> list[tuple]:
        hours = (row.t_us - state.get("t", row.t_us)) / HOUR_US
        cool = math.exp(-LAMBDA * hours)
        state["t"], state["sums"] = row.t_us, 1 + cool * state.get("sums", 0.0)
        seen, known = row.w is not None and row.w == row.w, "alpha" in state
        if seen or known:
            alpha, sd_a, acc_a, turn = state.get("alpha", (row.alpha, 0.0, 0.0, 0.0))
            expected = alpha + turn * hours
            data = {"w": (row.w, row.rw), "l": (row.l, row.rl), "h": (row.h, row.rh)} if seen else dict.fromkeys("wlh", (0.0, 0.0))
            off = wrapped(row.alpha - expected) if seen else 0.0
            if abs(off) > math.pi / 4 + 1e-9:
                off -= math.copysign(math.pi / 2, off)
                data["w"], data["l"] = data["l"], data["w"]
            weight = (data["w"][1] + data["l"][1]) / 2
            acc = weight + cool * acc_a
            share = weight / acc if acc > 0 else 1.0
            sd_a = math.sqrt((1 - share) * (sd_a**2 + share * off**2))
            if seen and known and hours > 0:
                turn = share * (expected + off - state["last"]) / hours + (1 - share) * turn
            state["alpha"] = (expected + share * off, sd_a, acc, turn)
            if seen:
                state["last"] = expected + off
            for name, (value, r) in data.items():
                old, sd, acc_d = state.get(name, (value, 0.0, 0.0))
                acc = r + cool * acc_d
                part = r / acc if acc > 0 else 0.0
                state[name] = (old + part * (value - old), math.sqrt((1 - part) * (sd**2 + part * (value - old) ** 2)), acc)
        if "alpha" not in state:
            return [(row.det_id, *[None] * 10)]
        out = [row.det_id]
        trust = lambda acc, sd, most: round((min(1.0, acc / state["sums"]) + 1 - min(1.0, sd / most)) / 2, 5)
        for name in "wlh":
            value, sd, acc = state[name]
            out += [round(value, 4), trust(acc, sd, spread)]
        alpha, sd, acc, turn = state["alpha"]
        return [(*out, round(math.cos(2 * alpha), 4), round(math.sin(2 * alpha), 4), round(turn, 4), trust(acc, sd, math.pi / 2))]

    columns = ["object_id", "t_us", "det_id", "w", "l", "h", "alpha", "rw", "rl", "rh"]
    return ordered_fold(samples.select(*columns), ["object_id"], ["t_us", "det_id"], SHAPE, dict, step)


_ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY t_us, det_id) AS i, (t_us - lag(t_us) OVER (PARTITION BY object_id ORDER BY t_us, det_id))/3600000000.0D AS g FROM {rows}), "


def size_sql(length: float = 20.0, spread: float = 40.0) -> str:
    """The same recursion, a row at a time."""
    start = f"SELECT object_id, i, det_id, least(1.0D, width*height/{length**2}D) AS acc, 1.0D AS sums, 1.0D*width AS w, 0.0D AS sw, 1.0D*height AS h, 0.0D AS sh FROM o WHERE i = 1"
    step = f"SELECT o.object_id, o.i, o.det_id, least(1.0D, o.width*o.height/{length**2}D) AS r, exp(-{LAMBDA}D*o.g) AS c, f.acc AS a0, f.sums AS s0, f.w AS w0, f.sw AS sw0, f.h AS h0, f.sh AS sh0, 1.0D*o.width AS dw, 1.0D*o.height AS dh FROM f JOIN o ON o.object_id = f.object_id AND o.i = f.i + 1"
    sd = lambda n: f"sqrt(c*a0/(r + c*a0)*(s{n}0*s{n}0 + r*(d{n} - {n}0)*(d{n} - {n}0)/least(1.0D, (r + c*a0)/(1 + c*s0))))"
    value = lambda n: f"(d{n}*r + c*a0*{n}0)/(r + c*a0)"
    rc = lambda n: f"round(1 - least(1.0D, s{n}/{spread}D), 6)"
    return _ORDERED.format(rows="boxes") + f"/*RECUR*/f(object_id, i, det_id, acc, sums, w, sw, h, sh) AS ({start} UNION ALL SELECT object_id, i, det_id, r + c*a0, 1 + c*s0, {value('w')}, {sd('w')}, {value('h')}, {sd('h')} FROM ({step}) k)\n--\nSELECT det_id, round(w, 5) AS w, round(sw, 5) AS sd_w, {rc('w')} AS rc_w, round(h, 5) AS h, round(sh, 5) AS sd_h, {rc('h')} AS rc_h FROM f"


def place_sql(x: str = "cx", y: str = "cy", expect: bool = False) -> str:
    """The same recursion, a row at a time."""
    rows = f"(SELECT object_id, t_us, det_id, cast(rd AS double) AS rd, cast({x} AS double) AS px_, cast({y} AS double) AS py_ FROM boxes) q"
    step = f"SELECT o.object_id, o.i, o.det_id, o.rd AS r, o.g, exp(-{LAMBDA}D*o.g)*f.acc AS a, o.px_ AS dx, o.py_ AS dy, f.x + f.vx*o.g AS ex, f.y + f.vy*o.g AS ey, " + ", ".join(f"CASE WHEN o.g > 0 THEN (o.rd*(o.p{n}_ - f.l{n})/o.g + exp(-{LAMBDA}D*o.g)*f.acc*f.v{n})/(o.rd + exp(-{LAMBDA}D*o.g)*f.acc) ELSE f.v{n} END AS w{n}" for n in "xy") + " FROM f JOIN o ON o.object_id = f.object_id AND o.i = f.i + 1"
    plain = lambda n: f"(d{n}*r + a*e{n})/(r + a)"
    trust = lambda n: f"((1 - r)/(1 + abs(w{n})/100))"
    value = (lambda n: f"(r*{plain(n)} + {trust(n)}*e{n})/(r + {trust(n)})") if expect else plain
    return _ORDERED.format(rows=rows) + f"/*RECUR*/f(object_id, i, det_id, acc, x, y, vx, vy, lx, ly) AS (SELECT object_id, i, det_id, rd, px_, py_, 0.0D, 0.0D, px_, py_ FROM o WHERE i = 1 UNION ALL SELECT object_id, i, det_id, r + a, {value('x')}, {value('y')}, wx, wy, dx, dy FROM ({step}) k)\n--\nSELECT det_id, round(x, 4) AS x, round(y, 4) AS y, round(vx, 4) AS vx, round(vy, 4) AS vy FROM f"


def shape_sql(samples: str, spread: float = 20.0) -> str:
    """The same recursion, a row at a time, over samples that all have a shape."""
    wrap = lambda a: f"({a} - pi()*floor({a}/pi() + 0.5D))"
    joined = f"SELECT o.*, exp(-{LAMBDA}D*o.g) AS c, f.sums AS s0, f.a AS a0, f.sa, f.ca, f.turn, f.last_, f.a + f.turn*o.g AS e, " + ", ".join(f"f.v{d}, f.s{d}, f.c{d}" for d in "wlh") + " FROM f JOIN o ON o.object_id = f.object_id AND o.i = f.i + 1"
    off = f"SELECT *, {wrap('(alpha - e)')} AS d0 FROM ({joined}) k"
    far = "abs(d0) > pi()/4 + 1e-9"
    turned = f"SELECT *, CASE WHEN {far} THEN d0 - sign(d0)*pi()/2 ELSE d0 END AS d, " + ", ".join(f"CASE WHEN {far} THEN {p}{y} ELSE {p}{x} END AS {p}{x}_" for p in ("", "r") for x, y in ("wl", "lw")) + f", h AS h_, rh AS rh_ FROM ({off}) k"
    shares = "SELECT *, (rw_ + rl_)/2/((rw_ + rl_)/2 + c*ca) AS q, " + ", ".join(f"r{d}_/(r{d}_ + c*c{d}) AS q{d}" for d in "wlh") + f" FROM ({turned}) k"
    angle = "e + q*d, sqrt((1 - q)*(sa*sa + q*d*d)), (rw_ + rl_)/2 + c*ca, CASE WHEN g > 0 THEN q*(e + d - last_)/g + (1 - q)*turn ELSE turn END, e + d"
    dims = ", ".join(f"v{d} + q{d}*({d}_ - v{d}), sqrt((1 - q{d})*(s{d}*s{d} + q{d}*({d}_ - v{d})*({d}_ - v{d}))), r{d}_ + c*c{d}" for d in "wlh")
    names = "object_id, i, det_id, sums, a, sa, ca, turn, last_, " + ", ".join(f"v{d}, s{d}, c{d}" for d in "wlh")
    start = "SELECT object_id, i, det_id, 1.0D, alpha, 0.0D, (rw + rl)/2, 0.0D, alpha, w, 0.0D, rw, l, 0.0D, rl, h, 0.0D, rh FROM o WHERE i = 1"
    trust = lambda acc, sd, most: f"round((least(1.0D, {acc}/sums) + 1 - least(1.0D, {sd}/{most}))/2, 5)"
    found = ", ".join(f"round(v{d}, 4) AS {d}, {trust(f'c{d}', f's{d}', f'{spread}D')} AS r{d}" for d in "wlh")
    return _ORDERED.format(rows=f"({samples}) q") + f"/*RECUR*/f({names}) AS ({start} UNION ALL SELECT object_id, i, det_id, 1 + c*s0, {angle}, {dims} FROM ({shares}) k)\n--\nSELECT det_id, {found}, round(cos(2*a), 4) AS cos2, round(sin(2*a), 4) AS sin2, round(turn, 4) AS turn, {trust('ca', 'sa', '(pi()/2)')} AS ra FROM f"
