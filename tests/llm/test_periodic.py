import hashlib
import random
import zlib

import numpy as np

from evalmill.llm import periodic as pr
from tests.llm import cases


def brute_runs(words):
    """By each period from the smallest on: stretches in which words that far apart agree."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(12, 2 * q):
                found.setdefault((start, i + q - start), q)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def periodic_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        parts = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 40))]
            parts += (unit * 12)[: rng.randint(1, 12 * len(unit))]
            parts += [rng.choice(letters) for _ in range(rng.randint(0, 5))]
        yield parts


def test_runs_against_brute_force():
    texts = [[], ["a"], list("ab") * 50, ["a"] * 300, list("abababababa") + list("ababababab") + list("ababababababab"), fibonacci(500), list("a" * 11), list("a" * 12), list("abcdef" * 2), list("abcdef" * 2) + ["z"]]
    texts += [["a"] * k + ["b"] + ["a"] * k + ["b"] + ["a"] * j for k in (5, 12, 33) for j in (0, 4, 40)]
    texts += [list("xy") * 20 + ["x"] + list("xy") * i + ["y"] + list("xy") * 20 for i in range(8)]
    for seed in range(12):
        texts += periodic_texts(seed)
    rng = np.random.default_rng(1)
    texts += [[str(x) for x in rng.integers(0, k, 400)] for k in (1, 2, 3, 5, 50) for _ in range(6)]
    got = pr.text_runs(texts)
    for words, runs in zip(texts, got):
        assert runs == brute_runs(words)
    assert [pr.text_runs([t])[0] for t in texts[:40]] == got[:40]  # alone as among others


def test_range_successor():
    rng = np.random.default_rng(2)
    values = rng.permutation(300)[:211].astype(np.int64)
    tree = pr.WaveletMatrix(values)
    lo = rng.integers(0, 211, 500)
    hi = np.minimum(211, lo + rng.integers(0, 60, 500))
    value = rng.integers(0, 330, 500)
    want = [min((v for v in values[a:b] if v >= x), default=pr.NONE) for a, b, x in zip(lo, hi, value)]
    assert tree.successor(lo, hi, value).tolist() == want


def test_suffixes_of_several_texts():
    rng = np.random.default_rng(4)
    sizes = [0, 5, 1, 60, 33, 0, 100]
    words = rng.integers(0, 2, sum(sizes))
    words[66:99] = words[6:39]
    firsts = np.append(0, np.cumsum(sizes))
    found = pr.Suffixes(words, firsts)
    texts = [words[a:b].tolist() for a, b in zip(firsts, firsts[1:])]
    i, j = np.triu_indices(60, 1)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    text = texts[3]
    assert found.forward(i + 6, j + 6).tolist() == [common(text[a:], text[b:]) for a, b in zip(i, j)]
    assert found.backward(i + 6, j + 6).tolist() == [common(text[:a][::-1], text[:b][::-1]) for a, b in zip(i, j)]
    assert sorted(found.order.tolist()) == list(range(len(words)))
    ordered = [text[i - 6 :] for i in found.order.tolist() if 6 <= i < 66]
    assert ordered == sorted(text[i:] for i in range(60))


NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pr.op11_periodic_runs(spark, sf_dir).collect()
    assert len(rows) == len(docs) and sum(r["n_runs"] > 0 for r in rows) >= 5
    for r in rows:
        assert tuple(r[n] for n in NAMES) == brute_row(r["doc_id"], docs[r["doc_id"]])


def test_cases(spark):
    docs = cases.docs(spark)
    for together in (pr.TOGETHER, 50):
        rows = sorted(pr.periodic_runs(docs.repartition(2), 10, together).collect(), key=str)
        texts = [(i, t) for i, t, _ in cases.texts() if i != 10]
        want = sorted((str((i, *brute_row(i, t))) for i, t in texts))
        assert sorted(str((r["doc_id"], *(r[n] for n in NAMES))) for r in rows if r["doc_id"] != 10) == want
    assert pr.periodic_runs(cases.no_docs(spark), 10).count() == 0


def test_long_texts_of_few_words():
    n = 200_000
    assert pr.text_runs([["a"] * n]) == [[(0, n, 1)]]
    words = (["a"] * 999 + ["b"]) * (n // 1000)
    assert sorted(pr.text_runs([words])[0]) == sorted([(1000 * i, 999, 1) for i in range(n // 1000)] + [(0, n, 1000)])
