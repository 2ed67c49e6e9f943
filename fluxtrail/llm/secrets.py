"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

Everything is a DataFrame expression within one map stage. Matches and their places come from one pattern that also takes
the gap before each match, so places are running sums of code points. Entropy runs over the candidate strings alone: a
fold keeps the counts of the symbols in the window, a character each, and the sum of c*log2(c); each step changes the
two counts of the symbol that enters and the one that leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_of, text_of

# The base patterns with the least length of their group, in the order of their kinds.
BASE = (
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 6),
    ("access", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"([0-9a-f]+)", 24),
)
#: A text without a match of these has no base span of that kind.
HINTS = {"assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Strings that are looked at, whole between other symbols, and the hint for a text that has any.
CANDIDATE, CANDIDATE_HINT = r"([A-Za-z0-9+/_-]+={0,2})", r"[A-Za-z0-9+/_-]{20}"
#: Classes, narrowest first: the symbols of a string of the class, the letters of which it must hold one beside a digit,
#: and the least bits a symbol.
CLASSES = (
    ("hex", r"^[0-9a-fA-F-]+$", r"[a-fA-F]", 2.9),
    ("alphanumeric", r"^[A-Za-z0-9]+$", r"[A-Za-z]", 3.6),
    ("base64", r"^[A-Za-z0-9+/_-]+={0,2}$", r"[A-Za-z]", 3.7),
)
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Strings that are never reported by entropy: placeholders, paths and hyphenated words, words with a number, one repeated unit.
#: The repeated group is possessive, as any other kind takes a frame of the stack per repetition.
ALLOW = r"^(?i:.*(?:example|sample|dummy|changeme|placeholder|xxxxxx).*)$|^/?[A-Za-z]+(?:[-_/][A-Za-z]+)*+[-_/]?[0-9]{0,4}$|^(.{1,4})\1+$"
FOUND = "array<struct<start:int,number:int,end:int,kind:string,match:string,bits:double>>"


def places(text: Column, pattern: str, least: int, kind: str, number: int) -> Column:
    """Array of (start, number, end, kind, match), in code points, of the leftmost non-overlapping matches.

    ``pattern`` has one group; matches whose group is shorter than ``least`` are left out. The last match of the whole
    pattern is the rest of the text.
    """
    whole = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    parts = F.arrays_zip(*(F.regexp_extract_all(text, whole, F.lit(i)).alias(n) for i, n in ((1, "gap"), (2, "match"), (3, "group"))))
    state = lambda at, found: F.struct(at.alias("at"), found.alias("found"))
    none = F.array().cast(FOUND)

    def step(now: Column, part: Column) -> Column:
        start = now["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        one = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(kind).alias("kind"), part["match"].alias("match"), F.lit(None).cast("double").alias("bits"))
        return state(end, F.when(F.length(part["group"]) >= least, F.concat(now["found"], F.array(one))).otherwise(now["found"]))

    def run(now: Column, some: Column) -> Column:
        own = F.aggregate(some, state(now["at"], none), step)
        return state(own["at"], F.concat(now["found"], own["found"]))

    def folded(parts: Column) -> Column:
        # Runs of sqrt(n) matches are folded apart, so that no long array is copied for every match.
        width = F.ceil(F.sqrt(F.size(parts))).cast("int")
        runs = F.transform(F.sequence(F.lit(1), F.size(parts), width), lambda i: F.slice(parts, i, width))
        return F.aggregate(runs, state(F.lit(0), none), run, lambda now: now["found"])

    return F.transform(F.array(parts), folded)[0]  # the matches, as a variable of this lambda, are made once


def highest_entropy(piece: Column, width: int) -> Column:
    """The highest Shannon entropy, in bits a symbol, of any window of ``width`` (up to 127) symbols; 0 for a shorter piece."""
    codes = F.transform(F.filter(F.split(piece, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c) + 1)
    leaves = F.slice(F.concat(F.array_repeat(F.lit(0), width), codes), F.lit(1), F.size(codes))
    moves = F.zip_with(codes, leaves, lambda a, b: F.struct(a.alias("enter"), b.alias("leave")))
    # What the sum gains when a count goes from n to n + 1, by n.
    gain = F.array(*(F.lit((n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)) for n in range(width + 1)))
    start = F.struct(F.lit("\0" * (len(SYMBOLS) + 1)).alias("counts"), F.lit(0).alias("seen"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    count = lambda counts, code: F.ascii(F.substring(counts, code, F.lit(1)))
    put = lambda counts, code, n: F.overlay(counts, F.char(n), code, F.lit(1))

    def step(state: Column, move: Column) -> Column:
        counts, enter, leave = state["counts"], move["enter"], move["leave"]
        into, out = count(counts, enter), count(counts, leave) - 1
        lost = F.when(leave > 0, F.get(gain, out)).otherwise(F.lit(0.0))
        total = state["total"] + F.when(enter == leave, F.lit(0.0)).otherwise(F.get(gain, into) - lost)
        seen = state["seen"] + 1
        grown = put(counts, enter, into + 1)
        after = F.when(enter == leave, counts).when(leave > 0, put(grown, leave, out)).otherwise(grown)
        return F.struct(after.alias("counts"), seen.alias("seen"), total.alias("total"), F.when(seen < width, 0.0).otherwise(F.greatest(state["best"], math.log2(width) - total / width)).alias("best"))

    return F.aggregate(moves, start, step, lambda state: state["best"])


def suspicion(piece: Column, width: int) -> Column:
    """The entropy of a candidate string that reaches the limit of its narrowest class and matches no allow rule; else null."""
    limit = F.lit(None).cast("double")
    for _, symbols, holds, bits in reversed(CLASSES):
        limit = F.when(piece.rlike(symbols), F.when(piece.rlike("[0-9]") & piece.rlike(holds), F.lit(bits))).otherwise(limit)
    bits = F.when(limit.isNotNull() & ~piece.rlike(ALLOW), highest_entropy(piece, width))
    return F.array_max(F.filter(F.array(bits), lambda b: b >= limit))


def spans(body: Column, width: int, entropy: bool) -> Column:
    """All spans of a text without nulls, by start and then kind."""
    empty = F.array().cast(FOUND)
    each = [F.when(body.rlike(HINTS[kind]), places(body, pattern, least, kind, i)).otherwise(empty) for i, (kind, pattern, least) in enumerate(BASE)]
    if entropy:
        some = places(body, CANDIDATE, width, "entropy", len(BASE))
        some = F.filter(F.transform(some, lambda c: c.withField("bits", suspicion(c["match"], width))), lambda c: c["bits"].isNotNull())
        each.append(F.when(body.rlike(CANDIDATE_HINT), some).otherwise(empty))
    return F.array_sort(F.concat(*each))


def scan(docs: DataFrame, text: str = "text", out: str = "secret_spans", width: int = 20, entropy: bool = True) -> DataFrame:
    """docs with ``out``: array of (start, number, end, kind, match, bits) by start and then kind; places in code points, end exclusive.

    Kinds are assign, access, hex and, by the entropy of windows of ``width`` symbols, entropy, with its bits a symbol;
    an entropy span may lie within a base span. A null or empty text has an empty array. Rows, repeated ones too, stay
    as they are; a column named like ``out`` is replaced.
    """
    return docs.withColumn(out, spans(text_of(text), width, entropy))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of the scan, overlapping ones as one, replaced by ``mask``, and n_chars, where it is a column, counted again.

    Texts without spans, null and empty ones too, and all other columns stay as they are, whatever their names; so do
    repeated rows.
    """
    rows = docs.select(row_of(docs))
    text = F.col("row").getField("text")
    rows = rows.select("row", spans(F.coalesce(text, F.lit("")), 20, True).alias("found"))
    none = F.array().cast("array<string>")
    state = lambda at, rest, done: F.struct(at.alias("at"), rest.alias("rest"), done.alias("done"))

    def run(now: Column, some: Column) -> Column:
        def step(own: Column, span: Column) -> Column:
            gap = F.substring(now["rest"], own["at"] - now["at"] + 1, span["start"] - own["at"])
            done = F.when(span["start"] >= own["at"], F.concat(own["done"], F.array(gap, F.lit(mask)))).otherwise(own["done"])
            return F.struct(F.greatest(own["at"], span["end"]).alias("at"), done.alias("done"))

        own = F.aggregate(some, F.struct(now["at"].alias("at"), none.alias("done")), step)
        rest = F.substring(now["rest"], own["at"] - now["at"] + 1, F.length(now["rest"]))
        return state(own["at"], rest, F.concat(now["done"], F.array(F.array_join(own["done"], ""))))

    # As above, by runs of sqrt(n) spans: a step walks the text of its run, not the whole.
    width = F.ceil(F.sqrt(F.size("found"))).cast("int")
    runs = F.transform(F.sequence(F.lit(1), F.size("found"), width), lambda i: F.slice("found", i, width))
    new = F.aggregate(runs, state(F.lit(0), text, none), run, lambda now: F.concat(F.array_join(now["done"], ""), now["rest"]))
    rows = rows.select("row", F.when(F.size("found") > 0, new).alias("masked"))
    swap = {"text": F.coalesce("masked", text), "n_chars": F.when(F.col("masked").isNull(), F.col("row").getField("n_chars")).otherwise(F.length("masked").cast("long")) if "n_chars" in docs.columns else None}
    return rows.select(*(swap.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
