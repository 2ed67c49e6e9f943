"""The queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, gif, imatch, jaccard, langid, leaderboard, mixing, mixlm, packing, pages, secrets, sharding, warc
from .common import table


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a GIF, read back, with digests and the histogram of its frames."""
    media = gif.store(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), "text"))
    return gif.features(media).withColumnRenamed("media_id", "doc_id").drop("problem")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of every document."""
    rows, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", "source", "slots", "n_slots")


def op3_mixlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text by the unigram base and by context mixing."""
    return mixlm.score(table(spark, sf_dir, "documents"))


def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held(F.col("doc_id"))))
    found = langid.predict(docs.select("doc_id", "text", langid.held(F.col("doc_id")).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens along the curve."""
    return packing.pack(table(spark, sf_dir, "documents"), length=2048)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents linked by a shingle Jaccard similarity of 0.8."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, read back from the archives."""
    return warc.archive(table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text: counts of the base kinds, their digest, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), out="found")
    base = F.filter("found", lambda s: s["number"] < len(secrets.BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k, _, _ in secrets.BASE),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("found")).alias("spans"),
        count("entropy").alias("n_entropy"),
        F.round(F.array_max(F.transform("found", lambda s: s["bits"])), 6).alias("most_bits"),
    )


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every text and of its edited text."""
    found = imatch.fingerprint(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("signatures", ".").alias("fingerprint"),
        F.array_join("edited_signatures", ".").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, equal texts in one."""
    rows = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups of both tokenizers over every whole text, and how common their linked ids are."""
    return alignment.align(table(spark, sf_dir, "documents")).drop("groups")


def op13_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of every nation's ten items of highest revenue, day of arrival by day of arrival."""
    return leaderboard.change_feed(*(table(spark, sf_dir, t) for t in ("sale_lines", "items", "vendors")), batches=10)


QUERIES = {
    "op1_gif": op1_gif,
    "op2_mixing": op2_mixing,
    "op3_mixlm": op3_mixlm,
    "op4_pages": op4_pages,
    "op5_langid": op5_langid,
    "op6_packing": op6_packing,
    "op7_jaccard": op7_jaccard,
    "op8_warc": op8_warc,
    "op9_secrets": op9_secrets,
    "op10_imatch": op10_imatch,
    "op11_sharding": op11_sharding,
    "op12_alignment": op12_alignment,
    "op13_leaderboard": op13_leaderboard,
}
#: DuckDB statements of the queries that SQL can express.
ORACLE = {
    "op7_jaccard": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS shingles FROM w
), each AS (SELECT doc_id, n, hash(s) AS shingle FROM (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS s FROM sets) u), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, max(a.n) AS n, max(b.n) AS m, count(*) AS both_
    FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM pairs WHERE 100 * both_ >= 80 * (n + m - both_)), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, cast(len(shingles) AS bigint) AS n_shingles, component_id FROM sets JOIN least USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_ FROM pages)
SELECT page_id, cast(strlen(body) AS bigint) AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS bigint) >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
    CASE WHEN first_ = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_ <> page_id THEN first_ END AS refers_to, true AS digest_ok FROM p""",
    "op13_leaderboard": """
WITH RECURSIVE bit(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
n AS (SELECT vendor_id, max(nation_id) AS nation FROM vendors GROUP BY vendor_id), p AS (SELECT item_id, floor(100.0::double*max(price) + 0.5::double) AS each FROM items GROUP BY item_id),
o AS (SELECT *, concat(coalesce(cast(sale_id AS varchar), ''), ',', coalesce(cast(item_id AS varchar), ''), ',', coalesce(cast(vendor_id AS varchar), ''), ',', coalesce(cast(line_no AS varchar), '')) AS txt FROM sale_lines),
h AS (SELECT o.*, xor(list_reduce([ascii(x) FOR x IN string_split(txt, '')], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM o CROSS JOIN tab),
s AS (SELECT *, coalesce(datediff('day', DATE '1970-01-01', cast(shipped_at AS date)), 19723 + h % 150) AS s FROM h),
a AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM s),
b AS (SELECT *, greatest(1, least(10, 1 + cast(floor((a - 19723)*10/180.0::double) AS bigint))) AS b FROM a),
m AS (SELECT k.b, (SELECT max(s) FROM b WHERE b.b < k.b) AS latest FROM (SELECT DISTINCT b FROM b) k),
d AS (SELECT n.nation, b.a, b.item_id, sum(CASE WHEN b.flag = 'returned' THEN -1 ELSE 1 END*cast(coalesce(floor(100.0::double*b.amount + 0.5::double), b.quantity*p.each, 0) AS bigint)) AS cents
 FROM b JOIN m ON m.b = b.b JOIN n ON n.vendor_id = b.vendor_id JOIN p ON p.item_id = b.item_id WHERE n.nation IS NOT NULL AND (m.latest IS NULL OR b.s + 3 >= m.latest) GROUP BY n.nation, b.a, b.item_id),
day AS (SELECT nation, a, row_number() OVER (PARTITION BY nation ORDER BY a) AS k FROM (SELECT DISTINCT nation, a FROM d) x), item AS (SELECT nation, item_id, min(a) AS first_ FROM d GROUP BY nation, item_id),
r AS (SELECT y.nation, y.a, y.k, i.item_id, sum(coalesce(d.cents, 0)) OVER (PARTITION BY y.nation, i.item_id ORDER BY y.k) AS revenue FROM day y JOIN item i ON i.nation = y.nation AND i.first_ <= y.a LEFT JOIN d ON d.nation = y.nation AND d.a = y.a AND d.item_id = i.item_id),
w AS (SELECT *, row_number() OVER (PARTITION BY nation, k ORDER BY revenue DESC, item_id) AS rank FROM r WHERE revenue > 0), board AS (SELECT * FROM w WHERE rank <= 10),
c AS (SELECT coalesce(x.nation, z.nation) AS nation, coalesce(x.k, z.k + 1) AS k, coalesce(x.item_id, z.item_id) AS item_id, z.rank AS old_, x.rank AS new_ FROM board x FULL JOIN board z ON z.nation = x.nation AND z.item_id = x.item_id AND z.k = x.k - 1)
SELECT c.nation AS nation_id, cast(y.a AS bigint) AS arrival_day, c.item_id, cast(greatest(1, least(10, 1 + floor((y.a - 19723)*10/180.0::double))) AS integer) AS batch,
 CASE WHEN old_ IS NULL THEN 'enter' WHEN new_ IS NULL THEN 'exit' ELSE 'move' END AS change, cast(old_ AS integer) AS old_rank, cast(new_ AS integer) AS new_rank, cast(r.revenue AS bigint) AS revenue
FROM c JOIN day y ON y.nation = c.nation AND y.k = c.k JOIN r ON r.nation = c.nation AND r.k = c.k AND r.item_id = c.item_id WHERE old_ IS DISTINCT FROM new_""",
}
