import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalmill.llm import packing, token_counts, tokenizers_bpe
from tests.llm import cases

MULTI, JSON, RANKS = (public.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
PARTS = ["a", "b", "the", " ", "  ", "\n", "é", "'s", "'re", "'", "1", "23", "!", "\t", "<|endoftext|>", " ", "ß", "中", "😀", " ", "0", "\x1c", "\x85", "token", "՘", "²", "_", "x" * 40]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("reference", pat_str=public.PATTERN, mergeable_ranks=tokenizers_bpe.read_ranks(MULTI), special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def made_texts():
    """Texts without blanks, long words, long white space, apostrophes in all places."""
    rng = random.Random(9)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    signs = "".join(rng.choice("'srevldtm \n\t!1é") for _ in range(3000))
    return [letters, "日本語の文章は空白なしで続く" * 80, " " * 2000 + "x", " \n" * 700, "=" * 1500 + "a", signs, "ab" * 40 + "  " + letters[:200]]


@pytest.mark.parametrize(("leaf", "piece"), [(1, 1), (2, 3), (7, 8), (64, 64), (1024, 64)])
def test_tree_encoding_matches_library(reference, leaf, piece):
    codec = tokenizers_bpe.TreeCodec(tokenizers_bpe.read_ranks(MULTI), public.PATTERN, reference._encode_single_piece, reference.encode_ordinary, leaf, piece)
    for text in made_texts() + random_texts(400, leaf) + [t for _, t, _ in cases.texts() if t and len(t) < 2000]:
        ids = codec.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_op3_rows(spark, reference):
    got = Counter(map(tuple, tokenizers_bpe.encode_digests(cases.docs(spark), MULTI, public.PATTERN).collect()))
    want = Counter()
    for i, text, _ in cases.texts():
        ids = reference.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    assert tokenizers_bpe.encode_digests(cases.no_docs(spark), MULTI, public.PATTERN).count() == 0
    back = tokenizers_bpe.encode_decode(cases.docs(spark).filter("doc_id = 12"), MULTI, public.PATTERN).first()
    assert bytes(back["decoded"]).decode() == cases.texts()[13][1] and back["ids"] == reference.encode_ordinary(cases.texts()[13][1])


def test_transducer_counts_match_library(library):
    counter = token_counts.Counter(JSON)
    for text in made_texts() + random_texts(1500, 3) + [t for _, t, _ in cases.texts() if t and len(t) < 3000]:
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.count(text) == want, repr(text)
        if not token_counts.ODD.search(text):
            assert counter.machine.run(counter.machine.fresh, text)[1] == want, repr(text)


@pytest.mark.parametrize("chunk", [1, 3, 17, 100])
def test_chunk_maps_compose_to_the_count(library, chunk):
    counter = token_counts.Counter(JSON)
    for text in made_texts() + [t.replace("<|endoftext|>", "") for t in random_texts(400, chunk)]:
        if not token_counts.ODD.search(text):
            assert counter.chunked_count(text, chunk) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_cache_limit_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 20)
    counter = token_counts.Counter(JSON)
    for text in random_texts(100, 5):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        if not token_counts.ODD.search(text) and "<" not in text:
            assert counter.chunked_count(text, 7) == counter.count(text)


def test_classes_agree_on_all_plain_characters(library):
    counter = token_counts.Counter(JSON)
    for code in range(0x3100):
        char = chr(code)
        if not token_counts.ODD.match(char):
            text = f"a{char}1{char}!{char}a {char}{char} _{char}"
            want = len(library.encode(text, add_special_tokens=False).ids)
            assert counter.count(text) == counter.machine.run(counter.machine.fresh, text)[1] == want, code


def test_chunks_dealt_out_as_rows(spark, library):
    texts = ["ab <|endoftext|>" * 30, "".join(made_texts()[:1]), cases.words(400, 2), "<|endoftext|>" * 40, "x y\n" * 90, "", None, "中文 " * 70]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    for chunk in (14, 50):
        got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, JSON, chunk=chunk).collect()}
        assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
        assert len(got[2]["chunk_starts"]) > 5 and got[2]["chunk_starts"] == sorted(got[2]["chunk_starts"])


def test_op6_rows(spark, library):
    got = Counter(map(tuple, token_counts.count_tokens(cases.docs(spark), JSON).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))
    want = Counter()
    for i, text, _ in cases.texts():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[i, len((text or "").encode()), n, n > 1024] += 1
    assert got == want
    assert token_counts.count_tokens(cases.no_docs(spark), JSON).count() == 0


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_op8_rows(spark, library):
    rows = packing.pack_documents(cases.docs(spark)).collect()
    want = Counter()
    for i, text, _ in cases.texts():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        begin = 0
        for n, end in enumerate(range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)):
            want[i, n, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())] += 1
            begin = end
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, 1024) <= -(-total // 1024) + 2
    assert packing.pack_documents(cases.no_docs(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    size = 64
    lengths = rng.choice(np.arange(1, size + 1), 5000 if seed == 1 else 40, p=None)
    counts = np.bincount(lengths, minlength=size + 1)
    runs = packing.plan(counts, size)
    fill, seen = Counter(), Counter()
    for r in runs.itertuples():
        for k in range(r.repeats):
            assert fill[r.sequence + k] == r.offset
            fill[r.sequence + k] += r.length
            seen[r.length, r.rank + k] += 1
    assert max(fill.values()) <= size
    assert set(seen.values()) == {1} and all(Counter(v for v, _ in seen)[v] == counts[v] for v in range(1, size + 1))
    assert len(fill) <= 1.03 * lengths.sum() / size + 2


LONG = {"spaces": " " * 1_100_000, "lines": "a b\n" + "\n" * 1_050_000 + "x y", "mixed": "end" + " \t\u3000" * 400_000 + "\u00a0é 1" + " " * 70_000, "letters": "ab" * 300_000, "marks": "!?" * 300_000}


@pytest.mark.parametrize("name", LONG)
def test_runs_beyond_the_library_limit(library, name):
    text = LONG[name]
    want = library.encode(text, add_special_tokens=False).ids
    assert tokenizers_bpe.codec(RANKS, public.PATTERN).encode(text).tolist() == want
    assert token_counts.counter(JSON).count(text) == len(want)


@pytest.mark.parametrize("text", ["a" + " " * 70_000 + "b", " " * 65_536, "x" + "\n" * 66_000 + " y", "it's" + "\t" * 65_537 + "'s" + " " * 65_536 + "!"])
def test_long_runs_match_library(reference, text):
    assert tokenizers_bpe.codec(MULTI, public.PATTERN).encode(text).tolist() == reference.encode_ordinary(text)


def test_packing_takes_long_runs(spark, library):
    docs = spark.createDataFrame([(1, "a" + " " * 1_050_000 + "b")], "doc_id long, text string")
    ids = np.array([*library.encode(docs.first()["text"], add_special_tokens=False).ids, 2], "<u4")
    got = sorted(map(tuple, packing.pieces(docs, JSON, RANKS, public.PATTERN).select("start", "length", "ids_crc32").collect()))
    assert got == [(b, n, zlib.crc32(ids[b : b + n].tobytes())) for b, n, _ in got] and sum(n for _, n, _ in got) == len(ids)
