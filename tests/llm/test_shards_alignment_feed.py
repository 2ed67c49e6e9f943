"""Sharding, alignment and the change feed against brute force, and their defined results on odd rows."""

import bisect
import collections
import datetime
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxtrail.llm import alignment, leaderboard, queries, sharding

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "no id"), (None, "no id"), (4, "<s>hi</s>\x00 <|endoftext|> ﷺ"), (5, "a▁b"), (6, " "), (7, "é漢\U0001f600" * 40), (8, "the cat sat on " * 20_000)]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd)
    return rows.withColumns({"shard": F.lit("x"), "key": F.lit(1), "block": F.lit(2), "size": F.lit("y")})


def test_tree_gives_the_tightest_bin():
    for seed in range(60):
        rng, tree, have = random.Random(seed), sharding.Bins(), []
        for k in range(150):
            if rng.random() < 0.6:
                have.append((rng.randint(0, 40), k))
                tree.insert(have[-1])
            else:
                size = rng.randint(0, 45)
                want = min((e for e in have if e[0] >= size), default=None)
                assert tree.take(size) == want
                have = [e for e in have if e != want]


def test_best_fit_against_plain():
    for seed in range(40):
        rng = random.Random(seed)
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(0, 80))), reverse=True)
        rooms, want = [], []
        for s in sizes:
            fits = [k for k, room in enumerate(rooms) if room >= s]
            at = min(fits, key=lambda k: (rooms[k], k)) if fits else len(rooms)
            rooms += [50] * (at == len(rooms))
            rooms[at] -= s
            want.append(at)
        assert sharding.best_fit(sizes, 50) == want
        evened = sharding.evened(sizes, 4)
        loads = [sum(s for s, at in zip(sizes, evened, strict=True) if at == k) for k in range(4)]
        assert max(loads) <= max([0, *sizes[:1]], default=0) + -(-sum(sizes) // 4) and set(evened) <= set(range(4))


def test_shards(spark, docs):
    rows = sharding.shard(docs, shards=8).collect()
    texts = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs.select("doc_id", "text").collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    slots, of, loads = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        of[r.text_crc32].add(r.shard)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())
    group = collections.Counter()
    for (_, size, crc), n in texts.items():
        group[crc] += size * n
    large = [g for g in group.values() if 8 * g >= sum(loads.values())]
    rest = sorted(loads.values())[: 8 - len(large)]
    assert large and sorted(loads.values())[8 - len(large) :] == sorted(large) and max(rest) - min(rest) <= 0.02 * max(rest)
    assert {(r.law, r.grown_shard) for r in queries.op11_sharding(spark, SF).collect()} == {("bytes", None)}


def test_shards_of_a_capacity(docs):
    rows = sharding.shard(docs, shards=None, capacity=60_000, most=64).collect()
    loads = collections.Counter()
    for r in rows:
        loads[r.shard] += r.size
    over = [n for n in loads.values() if n > 60_000]
    assert over == [300_001] and len(loads) - 1 <= 1.1 * (sum(loads.values()) - 300_001) / 60_000 + 1
    assert not sharding.shard(docs.limit(0)).collect()
    assert [(r.shard, r.slot) for r in sharding.shard(docs.filter("doc_id = 2 AND text = ''")).collect()] == [(0, 0)]


def plain_alignment(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    both, a = alignment.Aligner(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    docs, counts = [], collections.Counter()
    for text in texts:
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
        raw_a, raw_b, raw = [both.bytes_a[i] for i in ids_a], [both.bytes_b[i] for i in ids_b], (" " + text).encode()
        if not text or b"".join(raw_a) != raw or b"".join(raw_b) != raw:
            docs.append(None)
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (raw_a, raw_b))
        links = []
        for i, end in enumerate(ends_a):
            k = bisect.bisect_right(ends_b, ends_a[i - 1] if i else 0)
            while k < len(ids_b) and (ends_b[k - 1] if k else 0) < end:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        groups, i, k = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = bisect.bisect_right(ends_a, cut), bisect.bisect_right(ends_b, cut)
            groups.append(",".join(map(str, ids_a[i:to_a])) + "|" + ",".join(map(str, ids_b[k:to_b])))
            i, k = to_a, to_b
        docs.append((len(ids_a), len(ids_b), groups, links))
        counts.update(links)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (0,) * 6 + ("", "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(counts[x] == best[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest(), ";".join(d[2]))
        for d in docs
    ]


def test_alignment(docs):
    rows = docs.collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, plain_alignment([r.text for r in rows]), strict=True)]
    for block in (3_000, 3_000_000):  # many blocks, one a task
        found = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in alignment.align(docs, block_links=block, groups=True).collect()]
        assert sorted(found, key=str) == sorted(want, key=str)
    assert not alignment.align(docs.limit(0)).collect()
    assert sum(r.n_a == 0 for r in alignment.align(docs.filter("doc_id IN (1, 2) OR text = ''")).collect()) >= 2


def plain_feed(sales, items, vendors):
    price, nation = {r.item_id: r.price for r in items}, {r.vendor_id: r.nation_id for r in vendors}
    rows = []
    for r in sales:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (r.sale_id, r.item_id, r.vendor_id, r.line_no)).encode())
        s = 19723 + h % 150 if r.shipped_at is None else (r.shipped_at.date() - datetime.date(1970, 1, 1)).days
        a = s + h % 7 + 20 * (h % 5 == 0)
        rows.append((min(10, 1 + math.floor((a - 19723) * 10 / 180)), a, s, r))
    latest = {b: max((s for c, _, s, _ in rows if c < b), default=-(10**9)) for b in range(1, 11)}
    days = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    for b, a, s, r in rows:
        n = nation.get(r.vendor_id)
        if s + 3 >= latest[b] and n is not None and r.item_id in price:
            each = price[r.item_id]
            cents = math.floor(100 * r.amount + 0.5) if r.amount is not None else 0 if r.quantity is None or each is None else r.quantity * math.floor(100 * each + 0.5)
            days[n][a][r.item_id] += -cents if r.flag == "returned" else cents
    out = []
    for n, of in days.items():
        revenue, old = collections.Counter(), {}
        for a in sorted(of):
            revenue.update(of[a])
            new = {i: k for k, (i, _) in enumerate(sorted(((i, c) for i, c in revenue.items() if c > 0), key=lambda x: (-x[1], x[0]))[:10], 1)}
            for i in old.keys() | new.keys():
                if old.get(i) != new.get(i):
                    out.append((n, a, i, min(10, 1 + math.floor((a - 19723) * 10 / 180)), "enter" if i not in old else "exit" if i not in new else "move", old.get(i), new.get(i), revenue[i]))
            old = new
    return out


def test_change_feed(spark):
    sales, items, vendors = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("sale_lines", "items", "vendors"))
    day = datetime.datetime
    odd = [(None, None, 1, 1, 2, 5.0, 0.0, "kept", day(2024, 2, 1)), (1, 1, 10**12, 1, 2, 5.0, 0.0, "kept", day(2024, 2, 1)), (1, 1, 1, 10**9, 2, 5.0, 0.0, "kept", day(2024, 5, 30)), (1, 1, 2, 2, None, None, None, None, None), (1, 1, 2, 2, 3, None, None, "returned", None)] * 2
    sales = sales.unionByName(spark.createDataFrame(odd, sales.schema))
    rows = [r.collect() for r in (sales, items, vendors)]
    extra = sales.withColumns({"day": F.lit("x"), "nation": F.lit(1), "part": F.lit(2), "batch": F.lit(3)})
    found = leaderboard.change_feed(extra, items, vendors, part_lines=500)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, plain_feed(*rows)))


def test_empty_feed(spark):
    sales, items, vendors = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("sale_lines", "items", "vendors"))
    assert leaderboard.change_feed(sales.limit(0), items, vendors, batches=1).collect() == []


def test_state_values_come_back():
    for columns in (([], []), ([-5, 0, 7], [-(2**50), 0, 2**50]), ([3], [-1])):
        held = [np.array(c, np.int64) for c in columns]
        assert [c.tolist() for c in leaderboard.restored(leaderboard.stored(*held), 2)] == [list(c) for c in columns]


def test_boards_do_not_depend_on_parts():
    rng = np.random.default_rng(4)
    due = [np.sort(rng.integers(0, 9, 400)), rng.integers(0, 60, 400), rng.integers(-40, 60, 400)]
    feeds = []
    for parts in (1, 2, 7):
        updates = []
        for p in range(parts):
            own = due[1] % parts == p
            updates += leaderboard.part_days([np.empty(0, np.int64)] * 2, [c[own] for c in due], 5)[1]
        columns = [np.array(c, np.int64) for c in zip(*sorted(updates), strict=True)]
        feeds.append(sorted(map(str, leaderboard.board_days([np.empty(0, np.int64)] * 2, columns, 5)[1])))
    assert feeds[0] == feeds[1] == feeds[2]
