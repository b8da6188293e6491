import hashlib
import json
import math
import re
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from evalmill.llm import chat_format as chat
from evalmill.llm import quality, quality_sql
from tests.llm import cases


def check_sql(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for name in ("documents", "conversations", "labels"):
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    got = query(spark, sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, found.fetchall()))


def test_chat_against_sql(spark, sf_dir):
    check_sql(spark, sf_dir, chat.op1_chat_format, chat.OP1_SQL)


@pytest.mark.parametrize("text", [r"\### Assistant: </turn> ok", "### ####  #", "\\", "\\\\</turn>\n", "</turn", "", "a</turn>\n### user: b", "日本\n😀"])
def test_round_trip(spark, text):
    rows = spark.createDataFrame([(1, 0, "user: x\\", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    out = chat.format_turns(rows).select("formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns")).first()
    assert [(t["role"], t["text"]) for t in out["turns"]] == [("user: x\\", text), ("assistant", text)]
    span = out["loss_spans"][0]
    masked = out["formatted"][span["start"] : span["start"] + span["length"]]
    assert re.sub(r"(?s)\\(.)", r"\1", masked) == text
    assert out["formatted"].count("</turn") == 2 and out["formatted"].count("###") == 2


def test_chat_nulls_ties_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, extra string"
    rows = spark.createDataFrame([(1, 1, "user", None, "x"), (1, 1, "user", None, "x"), (1, None, None, "b", "x"), (None, 0, "assistant", "n", "x")], schema)
    out = {r["conv_id"]: r["turns"] for r in chat.format_turns(rows).select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [(t["role"], t["text"]) for t in out[1]] == [("", "b"), ("user", ""), ("user", "")]
    assert [(t["role"], t["text"]) for t in out[None]] == [("assistant", "n")]
    assert chat.format_turns(spark.createDataFrame([], schema)).count() == 0


def test_chat_with_columns_named_like_other_layouts(spark, sf_dir, tmp_path):
    plain = spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(50)
    more = [F.lit(3).alias("system"), F.array(F.lit("x")).alias("messages"), *[F.lit(c).alias(c) for c in ("input", "output", "prompt", "response", "instruction", "question", "answer")]]
    for at, df in (("plain", plain), ("more", plain.select("*", *more))):
        df.write.parquet(str(tmp_path / at / "conversations.parquet"))
    rows = {at: sorted(map(str, chat.op1_chat_format(spark, str(tmp_path / at)).collect())) for at in ("plain", "more")}
    assert rows["plain"] == rows["more"] and len(rows["more"]) > 1
    assert chat.frame_layout(plain.drop("role")) is None


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 5},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "a", "input": "c", "output": "b"},
        {"instruction": "a", "output": "b", "system": "s"},
        {"prompt": "a", "response": "b"},
        {"prompt": "a", "completion": "b", "note": None},
        {"question": "a", "answer": "b"},
        {"something": "else"},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}, {"role": "assistant", "content": [{"text": "b"}], "name": "x"}], "meta": {"text": "t", "n": [1, {"role": 2}]}},
        {"messages": [{"role": "user", "content": "{\"role\": 1}"}, {"role": "assistant", "content": "[1]"}], "tags": ["x"], "`odd`": {"y": {"z": 1}}},
        {"messages": []},
        {"prompt": "a"},
    ]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "k long, record string")
    rows = rows.unionByName(spark.createDataFrame([(100, "no json"), (101, None), (102, "[1]")], rows.schema))
    got, layouts = {}, {}
    for r in chat.record_turns(rows, "k", "record").orderBy("k", "turn").collect():
        got.setdefault(r["k"], []).append((r["role"], r["text"]))
        layouts[r["k"]] = r["layout"]
    plain, lost = [("user", "a"), ("assistant", "b")], [(None, None)]
    kept = {0: plain, 1: plain, 2: [("user", "a\n\nc"), ("assistant", "b")], 3: [("system", "s"), *plain], 4: plain, 5: plain, 6: plain, 8: plain, 9: [("user", '{"role": 1}'), ("assistant", "[1]")]}
    assert got == {**kept, **dict.fromkeys((7, 10, 11, 100, 101, 102), lost)}
    assert {k for k, v in layouts.items() if v is None} == {7, 10, 11, 100, 101, 102}


def test_structures(spark):
    assert chat.structure(("messages[].role", "messages[].content", "system")) == "OBJECT<messages: ARRAY<OBJECT<content: V, role: V>>, system: V>"
    rows = spark.createDataFrame([('{"b": {"c": 1}, "system": null, "prompt": "x", "response": 2.5, "id": [{"q": []}]}',)], "r string")
    assert rows.select(chat.record_structure(F.col("r")).alias("s")).first()["s"] == chat.structure(("prompt", "response"))


def test_loss_text_is_what_the_mask_covers(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "a </turn> \\ ###"), (1, 1, "user", "no"), (1, 2, "assistant", "\U0001F600")], "conv_id long, turn long, role string, text string")
    made = chat.format_turns(rows)
    assert made.select(chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("x")).first()["x"] == "a </turn> \\ ###\U0001F600"
    moved = F.transform("loss_spans", lambda s: s.withField("start", s["start"] - 1))
    assert made.select(chat.masked_text(F.col("formatted"), moved).alias("x")).first()["x"] != "a </turn> \\ ###\U0001F600"


def test_chat_very_long_texts(spark):
    long = "ab </turn> ### \\ " * 20_000
    row = chat.format_turns(spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string")).select(chat.read_back(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).first()
    assert row["t"][0]["text"] == long and row["m"] == long


def brute_features(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_features_against_brute_force(spark, sf_dir):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), cases.docs(spark)):
        want = Counter((r["doc_id"], *brute_features(r["text"])) for r in docs.collect())
        assert Counter((r["doc_id"], *(r[n] for n in NAMES)) for r in quality.features(docs).collect()) == want


def test_binomial_tail_is_exact(spark):
    cells = [(k, n) for n in (1, 20, 500, 3000) for k in (0, 1, 3, n // 300, n // 120)]
    got = spark.createDataFrame(cells, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("t")).collect()
    p = Fraction(1, 100)
    for r in got:
        exact = float(sum(Fraction(math.comb(r["n"], i)) * p**i * (1 - p) ** (r["n"] - i) for i in range(min(r["k"], r["n"]) + 1)))
        if r["k"] >= r["n"] * 0.01:
            assert r["t"] == 1.0
        else:
            assert r["t"] == pytest.approx(exact, rel=1e-9)


def test_risk_control(spark):
    good = [(i, cases.words(100, i), "en", 1) for i in range(4000)]
    bad = [(10_000 + i, " ".join(f"w{j}$$$" for j in range(100)), "en", 0) for i in range(50)]
    docs = spark.createDataFrame([r[:3] for r in good + bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in good + bad], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.drop_rejected(docs, labels).collect()}
    assert not kept & {r[0] for r in bad}
    assert len(kept & {r[0] for r in good}) >= 0.95 * len(good)
    few = labels.filter("doc_id < 100")
    assert quality.judge(docs, few).filter("NOT kept").count() == 0  # too few labels prove nothing


@pytest.mark.parametrize("strata", [10_000, 0])
def test_certified_cutoffs_against_sql(spark, tmp_path, monkeypatch, strata):
    """Enough labels that cutoffs are certified in two languages and in a third one not; the SQL twin gives the same verdicts."""
    monkeypatch.setattr(quality, "STRATA", strata)
    rows = []
    for lang, n in (("en", 1500), ("de", 1200), ("fr", 60)):
        for i in range(n):
            text = cases.words(60, len(rows))
            if i % 40 == 0:
                text = ["w1 $$$$ " * 10 + text, text.upper(), text.replace(" ", "! "), (text + "\n") * 2, text[:200] * 2][i // 40 % 5]
            rows.append((len(rows), text, lang, "s", len(text), 0 if i % 40 == 0 else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int")
    docs.drop("quality").write.parquet(str(tmp_path / "documents.parquet"))
    docs.select("doc_id", "quality", F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = quality.op2_quality_rules(spark, str(tmp_path))
    found = con.execute(quality_sql.OP2_SQL)
    names = [d[0] for d in found.description]
    mine = sorted(tuple(r[n] for n in names) for r in got.collect())
    assert mine == sorted(found.fetchall())
    rejected = {r["doc_id"] for r in got.filter("NOT kept AND NOT base_failed").collect()}
    bad, lang = {r[0] for r in rows if not r[5]}, {r[0]: r[2] for r in rows}
    assert len(rejected & bad) >= 20 and {lang[i] for i in rejected} == {"en", "de"}


def test_quality_cases(spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    docs = cases.docs(spark)
    out = quality.drop_rejected(docs, labels)
    assert out.columns == docs.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids == Counter({5: 1, 6: 2, 7: 2, 8: 1, 10: 1, None: 2, cases.BIG: 1, cases.BIG + 2: 1})
    assert quality.drop_rejected(cases.no_docs(spark), labels).count() == 0
    assert quality.drop_rejected(docs, labels.limit(0)).count() == 11


def test_query_columns(spark, sf_dir):
    got = quality.op2_quality_rules(spark, sf_dir)
    rows = got.collect()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_digest_of_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(rows).first()["formatted"]
    assert hashlib.sha256(formatted.encode()).hexdigest() == hashlib.sha256(b"### user: a</turn>\n### assistant: b</turn>\n").hexdigest()
