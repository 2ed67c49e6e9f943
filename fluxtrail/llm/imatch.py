"""I-Match fingerprints over several randomised lexicon subsets.

The lexicon holds the terms within a band of inverse document frequency. The band's lower end bounds it: terms in at
least a share lo of all documents number at most (mean distinct terms a document) / lo, at any input size, so it is
broadcast. Each subset takes a term by a hash, at one of several rates; dense ones leave out a share of the band each, so
that every term of the band is in all of them but one. A signature is the hash of the sorted distinct
terms of a text that the subset holds. Sparse subsets survive large edits, dense ones tell close texts apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, interval_of, text_of

#: Document-frequency band as shares of all documents: idf from ln(1/0.25) to ln(1/0.003).
BAND = (0.003, 0.25)
#: (one in how many terms, how many subsets): 48 subsets; after them so many dense ones.
RATES, DENSE = ((32, 4), (128, 12), (512, 32)), 8


def terms(text: Column) -> Column:
    """Distinct runs of letters and digits, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda t: t != "")


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND, rates=RATES, seed: int = 7) -> DataFrame:
    """term, df, mask: terms within the band over all documents; bit k of mask says that subset k holds the term."""
    n = docs.count()
    counts = docs.select(F.explode(terms(text_of())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # Written before the masks are made: their filter would else be moved before the counting, over every occurrence.
    kept = durable(counts.filter((F.col("df") >= max(2.0, band[0] * n)) & (F.col("df") <= max(2.0, band[1] * n))))
    bits = [rate for rate, many in rates for _ in range(many)]
    held = [F.when(F.pmod(F.xxhash64(F.lit(seed + k), F.col("term")), F.lit(rate)) == 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rate in enumerate(bits)]
    out = F.pmod(F.xxhash64(F.lit(seed + len(bits)), F.col("term")), F.lit(DENSE))
    held += [F.when(out == k, F.lit(0)).otherwise(F.lit(1 << (len(bits) + k))).cast("long") for k in range(DENSE)]
    mask = held[0]
    for bit in held[1:]:
        mask = mask.bitwiseOR(bit)
    return kept.withColumn("mask", mask)


def short(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.pmod(value, F.lit(1 << 32))), 8, "0"))


def signatures(rows: DataFrame, found: str, other: str, out: str, rates=RATES) -> DataFrame:
    """rows with ``out``: a signature per subset over ``found``, the sorted structs (term, mask); '-' where the subset holds none of the terms.

    A text without any lexicon term has ``other`` (the hash of all its distinct terms) as each signature. The dense
    subsets leave out one of DENSE parts of the lexicon each, so their signatures are made from one hash per part.
    """
    many = sum(n for _, n in rates)
    held = lambda bit, yes=True: lambda t: (t["mask"].bitwiseAND(F.lit(bit)) != 0) == yes
    names = lambda own: F.xxhash64(F.transform(own, lambda t: t["term"]))
    empty = F.xxhash64(F.array().cast("array<string>"))
    rows = rows.withColumn(f"{out}_few", F.filter(found, held((1 << many) - 1)))
    sparse = F.array(*(names(F.filter(f"{out}_few", held(1 << k))) for k in range(many)))
    parts = F.array(*(names(F.filter(found, held(1 << (many + k), False))) for k in range(DENSE)))
    rows = rows.withColumns({f"{out}_sparse": sparse, f"{out}_parts": parts})
    rows = rows.withColumn(f"{out}_parts", F.transform(f"{out}_parts", lambda h, i: F.when(h != empty, F.xxhash64(h, i))))
    each = F.transform(f"{out}_sparse", lambda h, i: F.when(h == empty, "-").otherwise(short(F.xxhash64(h, i))))
    others = lambda k: lambda h, i: (i != k) & h.isNotNull()
    rest = [F.filter(f"{out}_parts", others(k)) for k in range(DENSE)]
    dense = F.array(*(F.when(F.size(r) == 0, "-").otherwise(short(F.xxhash64(r))) for r in rest))
    none = F.array_repeat(F.col(other), many + DENSE)
    rows = rows.withColumn(out, F.when(F.size(found) == 0, none).otherwise(F.concat(each, dense)))
    return rows.drop(f"{out}_few", f"{out}_sparse", f"{out}_parts")


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets that hold terms of either text, the share whose signatures are equal; 1 for equal fingerprints."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.filter(pairs, lambda p: (p["a"] != "-") | (p["b"] != "-"))
    same = F.filter(used, lambda p: p["a"] == p["b"])
    return F.when(a == b, F.lit(1.0)).when(F.size(used) == 0, F.lit(0.0)).otherwise(F.size(same) / F.size(used)).cast("double")


def in_order(docs: DataFrame, each: int = 500, most: int = 65_536) -> tuple[DataFrame, W]:
    """docs(doc_id, text) dealt into ranges of doc_id, with the row after each range's last; and the window of a range.

    Columns bucket, kind (0: a row of the range; 1: the first row of the next range, 2: the first of all, after the last
    range). Bounds are ids that occur, so the first rows of the next range are those that have its bound as id. Ranges hold
    about ``each`` rows, and more where that made over ``most``; a range is sorted by one task, which spills.
    """
    n = docs.count()
    k = max(1, min(most, n // each))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], max(10_000, 20 * k)), F.min("doc_id"), F.max(F.col("doc_id").isNull())).first() if n else (None, None, None)
    low = None if bounds[2] else bounds[1]
    cuts = sorted({b for b in bounds[0] or [] if low is None or b > low}) if k > 1 else []
    rows = docs.withColumn("_b", interval_of(F.col("doc_id"), cuts))
    rows = rows.withColumn("_cut", F.coalesce(F.get(F.array(*map(F.lit, cuts)), F.col("_b") - 1) == F.col("doc_id"), F.lit(False)) if cuts else F.lit(False))
    place = lambda b, kind: F.array(F.struct(b.alias("bucket"), F.lit(kind).alias("kind")))
    none = F.array().cast("array<struct<bucket:int,kind:int>>")
    spots = F.concat(
        place(F.col("_b"), 0),
        F.when(F.col("_cut"), place(F.col("_b") - 1, 1)).otherwise(none),
        F.when(F.col("doc_id").eqNullSafe(F.lit(low).cast("long")), place(F.lit(len(cuts)), 2)).otherwise(none),
    )
    rows = rows.withColumn("_spot", F.explode(spots)).select("doc_id", "text", "_spot.bucket", "_spot.kind")
    return rows, W.partitionBy("bucket").orderBy("kind", "doc_id", F.xxhash64("text"))


def fingerprint(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of each row of docs(doc_id, text), of its edited text, and their likeness to each other and the next.

    The edited text has the last half of the code points replaced by as many first ones of the next row by doc_id (the
    first after the last). A null text is empty; null ids come first; rows of equal id follow the hash of their text; a
    single row is its own next; an empty table gives no rows. Other columns are not read. Columns: doc_id, n_chars,
    edited_sha256, signatures, edited_signatures, near_edited, near_next.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    words = lexicon(docs, band)
    rows, window = in_order(docs)
    rows = rows.select("bucket", "kind", "doc_id", "text", F.row_number().over(window).alias("nth"), F.lead("text").over(window).alias("after"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("after", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("bucket", "kind", "nth", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("changed"))
    rows = rows.withColumns({"own_all": short(F.xxhash64(F.array_sort("own"))), "changed_all": short(F.xxhash64(F.array_sort("changed")))})
    keys = ["bucket", "nth", "kind", "doc_id", "n_chars", "edited_sha256", "own_all", "changed_all"]
    tagged = F.concat(F.transform("own", lambda t: F.struct(t.alias("term"), F.lit(0).alias("side"))), F.transform("changed", lambda t: F.struct(t.alias("term"), F.lit(1).alias("side"))), F.array(F.struct(F.lit("").alias("term"), F.lit(2).alias("side"))))
    rows = rows.select(*keys, F.explode(tagged).alias("t")).select(*keys, "t.term", "t.side")
    rows = rows.join(F.broadcast(words.select("term", "mask")), "term", "left").filter("mask is not null or side = 2")
    found = F.collect_list(F.when(F.col("mask").isNotNull(), F.struct("side", "term", "mask")))
    rows = rows.groupBy(*keys).agg(F.array_sort(found).alias("found"))
    side = lambda s: F.filter("found", lambda t: t["side"] == s)
    rows = rows.withColumns({"_a": side(0), "_b": side(1)})
    rows = signatures(signatures(rows, "_a", "own_all", "signatures"), "_b", "changed_all", "edited_signatures")
    rows = rows.select("bucket", "nth", "kind", "doc_id", "n_chars", "edited_sha256", "signatures", "edited_signatures")
    rows = rows.withColumn("after", F.lead("signatures").over(W.partitionBy("bucket").orderBy("nth"))).filter("kind = 0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "signatures", "edited_signatures",
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("after")).alias("near_next"),
    )
