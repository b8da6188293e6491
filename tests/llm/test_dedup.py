import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.llm import common, exact_dedup, near_dedup
from tests.llm import cases
from tests.llm.test_chat_and_quality import check_sql

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_against_sql(spark, sf_dir):
    check_sql(spark, sf_dir, exact_dedup.op4_exact_dedup, exact_dedup.OP4_SQL)


@pytest.mark.parametrize("counters", [1, 2, 512])
def test_heavy_split_changes_nothing(spark, counters):
    rows = [(i, "Hot Text" if i % 3 else f"text {i // 6}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.assign(exact_dedup.digests(docs), counters).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t.lower(), []).append(i)
    assert got == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    if counters > 1:
        digests = exact_dedup.digests(docs)
        hot = digests.groupBy("digest").count().orderBy(F.desc("count")).first()["digest"]
        assert hot in {r["digest"] for r in exact_dedup.frequent(digests, counters).collect()}


def test_exact_cases(spark):
    docs = cases.docs(spark)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    # 1 and 2 are empty, 5 and both 6 are equal, 7 and the null id are repeated rows
    assert ids == Counter({2: 1, 3: 1, 4: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, None: 1, 13: 1, cases.BIG: 1, cases.BIG + 2: 1})
    assert exact_dedup.drop_copies(cases.no_docs(spark)).count() == 0
    verdict = exact_dedup.assign(exact_dedup.digests(docs)).collect()
    assert len(verdict) == docs.count() and sum(r["kept"] for r in verdict) == 14


def shingles(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TABLE)) if x]
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else None


def brute_classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x is None or y is None or 5 * min(x.total(), y.total()) < 4 * max(x.total(), y.total()):
                continue
            common = (x & y).total()
            if common >= 0.8 * (x.total() + y.total() - common):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in sets}


def edited(text, changes, seed):
    rng, w = np.random.default_rng(seed), text.split(" ")
    for k in rng.choice(len(w), changes, replace=False):
        w[k] = f"edit{seed}x{k}"
    return " ".join(w)


def test_near_classes_against_brute_force(spark):
    rows, n = [], 0
    for g in range(12):
        base = cases.words(150, 100 + g)
        for k in range(5):
            rows.append((n, edited(base, k * 2, 1000 + n) if k else base))
            n += 1
    chain = cases.words(200, 77)
    for k in range(12):  # neighbours are similar, the ends are not
        rows.append((n, chain))
        chain = edited(chain, 3, 5000 + k)
        n += 1
    shared = cases.words(60, 9)
    for k in range(40):  # a common passage alone is no near copy
        rows.append((n, shared + " " + cases.words(50, 9000 + k)))
        n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "two words"), (n + 3, "Two, WORDS!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dedup.classes(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    sizes = Counter(r["class_id"] for r in got)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)


def test_second_search_joins_what_stars_miss(spark):
    # x is the bucket's first node; y and z resemble each other but not x enough, all three share most bands.
    base = cases.words(300, 5)
    y = edited(base, 8, 1)
    z = edited(y, 7, 2)
    rows = [(0, base), (1, y), (2, z)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_bucket_of_near_copies_that_mostly_miss(spark):
    # One text, edited at 0 to 9 places: few pairs are links, nearly all share bands.
    base = cases.words(146, 8)
    rows = [(i, edited(base, i % 10, 40_000 + i) if i % 10 else base) for i in range(700)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == brute_classes(rows)
    assert len(set(got.values())) > 150


@pytest.mark.parametrize("each", [64, 0])
def test_few_outside_meet_without_rounds_of_leaders(spark, monkeypatch, each):
    # Most copies are linked by the first leader; some that it misses resemble each other or another copy.
    monkeypatch.setattr(near_dedup, "EACH", each)
    calls = Counter()
    for name in ("split_buckets", "leader_pairs", "outside_pairs"):
        monkeypatch.setattr(near_dedup, name, lambda *a, f=getattr(near_dedup, name), name=name: calls.update([name]) or f(*a))
    base = cases.words(146, 8)
    far = [edited(base, 3, 70_000 + k) for k in range(10)]
    rows = [(i, edited(base, 1 + i % 2, 40_000 + i)) for i in range(160)]
    rows += [(160 + i, edited(far[i % 10], 2 + i % 4, 60_000 + i)) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == brute_classes(rows)
    assert len(set(got.values())) > 5
    if each:
        assert calls == Counter(split_buckets=2, outside_pairs=1)
    else:
        assert calls["leader_pairs"]


def test_bucket_rows_are_tagged_once(spark):
    # All rows and each row's bucket: the join with components must not be run again by what reads it.
    rows = spark.createDataFrame([(k, n, 9, 1) for k in range(20) for n in range(k, k + 6)], "key long, node long, n long, met long")
    found = spark.createDataFrame([(n, 0) for n in range(0, 20, 2)], "node long, component long")
    split = near_dedup.split_buckets(rows, found, [])
    assert "LeftOuter" not in split._jdf.queryExecution().executedPlan().toString()
    for key, got in split.toPandas().groupby("key"):
        inside = [n for n in range(key, key + 6) if n % 2 == 0 and n < 20]
        largest = 0 if len(inside) > 1 else got["component"].max()
        assert (got["largest"] == largest).all() and (got["outside"] == (got["component"] != largest).sum()).all() and len(got) == 6


def test_bit_maps_bound_the_difference():
    rng = np.random.default_rng(4)
    for n, m, common in ((200, 230, 190), (90, 100, 80), (3, 3, 0), (1500, 1300, 1200)):
        pool = rng.integers(0, 2**62, n + m - common).astype(np.uint64)
        a, b = near_dedup.bit_map(pool[:n]), near_dedup.bit_map(pool[n - common :])
        words = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in (a, b))
        differing = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
        assert 0.5 * (n + m - 2 * common) < differing <= n + m - 2 * common


def test_whole_small_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()} == brute_classes(rows)


def test_spread_join_is_a_join(spark):
    left = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(300)], "n long, k long")
    right = spark.createDataFrame([(i, i * i) for i in range(0, 300, 2)] + [(7, 49)], "k long, v long")
    hot = common.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("rows")), "k", "rows", least=30)
    assert hot == [7] and common.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("rows")), "k", "rows") == []
    for how in ("inner", "left"):
        rows = lambda df: sorted(df.select("n", "k", "v").collect())
        assert rows(common.spread_join(left, right, "k", "n", hot, how)) == rows(left.join(right, "k", how))


@pytest.mark.parametrize("limit", [0, 10])
def test_losers_go_by_either_join(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 4 * limit)
    docs = spark.createDataFrame([(i % 50, f"text {i % 25}", i) for i in range(100)], "doc_id long, text string, n long")
    verdict = spark.createDataFrame([(i % 50, f"text {i % 25}", i % 50 < 25 and i < 65) for i in range(100)], "doc_id long, digest string, kept boolean")
    out = common.drop_losers(docs, F.col("text"), verdict)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted([*range(25), *range(15)])


def test_signature_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    for overlap in (100, 180, 195):
        common = rng.integers(0, 2**62, overlap)
        a, b = (near_dedup.mix(np.concatenate([common, rng.integers(0, 2**62, 200 - overlap)]).astype(np.uint64)) for _ in "ab")
        agree = (near_dedup.signature(a, 2000) == near_dedup.signature(b, 2000)).mean()
        assert agree == pytest.approx(overlap / (400 - overlap), abs=0.05)
    assert len(near_dedup.signature(np.array([7], np.uint64), 240)) == 240


def test_units_count_occurrences():
    words = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5], dtype=np.int64)
    assert len(near_dedup.units(words)) == 6 and len(set(near_dedup.units(words).tolist())) == 6
    assert len(near_dedup.units(words[:3])) == 1 and len(near_dedup.units(words[:0])) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    for part in (500_000, 7):  # one task's stars, and many parts
        got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long").repartition(9), part).collect()}
        assert {n: c for n, c in got.items()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_cases(spark):
    docs = cases.docs(spark)
    out = near_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, None: 1, 13: 1, cases.BIG: 1})
    assert near_dedup.drop_near_copies(cases.no_docs(spark)).count() == 0


def test_only_rows_named_as_kept_and_lost_are_merged(spark):
    docs = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 3), (2, "b", 4), (3, None, 5), (3, None, 6), (None, "c", 7), (4, "d", 8)], "doc_id long, text string, n long")
    verdict = spark.createDataFrame([(1, "a", True), (1, "a", False), (2, "b", True), (2, "b", True), (3, None, True), (3, None, True), (None, "c", True), (4, "d", False)], "doc_id long, digest string, kept boolean")
    got = sorted(r["n"] for r in common.drop_losers(docs, F.col("text"), verdict).collect())
    assert got[1:] == [3, 4, 5, 6, 7] and got[0] in (1, 2)
