"""Quality rules with risk-controlled thresholds.

Each rule compares one feature of a text with a cutoff. Which cutoff is in force is decided for each stratum (language) from
labelled documents: a cutoff counts as safe when the exact binomial tail P(Bin(n, alpha_r) <= k) is at most delta / m, where n
good documents (quality 1) of the stratum were looked at, k of them would be rejected, alpha_r is the rule's share of the
allowed false rejections and m counts all hypotheses (strata x rules x cutoffs), a Bonferroni correction. The strictest safe
cutoff is used, none where there is none. So, with probability 1 - delta, no stratum loses more than ``alpha`` of its good
documents to these rules. The grid of cutoffs is fixed beforehand (tails of more than 2,000
terms are bounded from above, which only makes fewer cutoffs safe); all labelled documents are holdout.

Cases: a null text has no words; a text without words fails the base rule; a null language is the stratum "und"; labels with
a null quality are left out, a document with several labels is good if one of them says so; without labels no rule is in force.
Words that occur in repeated 3-word windows are found by 64-bit hashes of the windows of one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm.common import cut_lineage, drop_losers, hot_keys, let, spread_join, table

#: Share of the good documents of a stratum that all rules together may reject, and the probability of missing that.
ALPHA, DELTA = 0.05, 0.05

#: Strata whose cutoffs may be broadcast; more of them are joined, rows of frequent strata dealt out.
STRATA = 10_000

#: Rule -> cutoffs; a document is rejected where the feature is above the cutoff.
RULES = {
    "symbol_ratio": (0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "upper_ratio": (0.1, 0.2, 0.3, 0.5, 0.7),
    "bang_ratio": (0.05, 0.1, 0.2, 0.5, 1.0),
    "digit_ratio": (0.05, 0.1, 0.2, 0.4),
    "dup_line_ratio": (0.1, 0.2, 0.3, 0.5, 0.7),
    "repeat_ratio": (0.1, 0.2, 0.3, 0.4),
}

SPACE = r"[\x20\x09-\x0D]"


def _count(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more: positions of equal window hashes, then their union."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s, x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        places = let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, x, i)), lambda x: x["p"])))
        widths = let(places, lambda d: F.transform(d, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(d, i + 1) - p, F.lit(3)))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts of every whole text; one scan, no shuffle."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select("doc_id", *keep, text.alias("text")).select(
        "doc_id",
        *keep,
        let(F.array_remove(F.split("text", SPACE + "+"), ""), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        _count(F.col("text"), SPACE + "+").alias("word_chars"),
        _count(F.col("text"), "[^#*$%&|<>]+").alias("n_symbols"),
        _count(F.col("text"), r"[^\p{Lu}]+").alias("n_upper"),
        _count(F.col("text"), "[^!?]+").alias("n_bang"),
        _count(F.col("text"), "[^0-9]+").alias("n_digits"),
    )
    return counted.select("doc_id", *keep, "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "n_bang", "n_digits")


def _ratios() -> dict[str, Column]:
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "symbol_ratio": over("n_symbols", "word_chars"),
        "upper_ratio": over("n_upper", "word_chars"),
        "bang_ratio": over("n_bang", "n_words"),
        "digit_ratio": over("n_digits", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "repeat_ratio": over("n_repeat_words", "n_words"),
    }


def ln_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series from n + 9 on and the exact product below it; about 1e-13 relative."""
    x = n + 10.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    shift = n + 1.0
    for i in range(2, 10):
        shift = shift * (n + float(i))
    return series - F.ln(shift)


def binomial_tail(k: Column, n: Column, p: float, terms: int = 2000) -> Column:
    """P(Bin(n, p) <= k): terms from k downwards, at most ``terms`` of them, and an upper bound for the rest; 1 from the mean on."""
    k, n = k.cast("double"), n.cast("double")
    top = ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    ratio = lambda i: (k - i + 1.0) * (1 - p) / ((n - k + i) * p)  # noqa: E731  of term k - i to term k - i + 1
    step = lambda a, i: let(a["term"] * ratio(i), lambda t: F.struct(t.alias("term"), (a["total"] + t).alias("total")))
    upto = F.least(k, F.lit(float(terms))).cast("int")
    summed = F.aggregate(F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>")), start, step)
    rest = lambda s: F.when(k > terms, s["term"] * ratio(F.lit(float(terms + 1))) / (1 - ratio(F.lit(float(terms + 1))))).otherwise(F.lit(0.0))
    return F.when((n <= 0) | (k >= n * p), F.lit(1.0)).otherwise(let(summed, lambda s: F.least(F.lit(1.0), F.exp(top) * (s["total"] + rest(s)))))


def safe_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """(stratum, n_good, one cutoff per rule or null) from the labelled documents; one row for each stratum that has labels."""
    good = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    held = measured.join(good, "doc_id", "left_semi").select("stratum", *[c.alias(name) for name, c in _ratios().items() if name in rules])
    fired = [F.count_if(F.col(name) > c).alias(f"k_{name}_{j}") for name, cuts in rules.items() for j, c in enumerate(cuts)]
    counts = cut_lineage(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *fired))
    hypotheses = max(1, counts.count()) * sum(map(len, rules.values()))
    share = alpha / len(rules)

    def chosen(name: str, cuts) -> Column:
        cells = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"k_{name}_{j}").alias("k")) for j, c in enumerate(cuts)])
        return F.array_min(F.transform(F.filter(cells, lambda x: binomial_tail(x["k"], F.col("n_good"), share) <= delta / hypotheses), lambda x: x["cut"]))

    return counts.select("stratum", "n_good", *[chosen(name, cuts).alias(f"cut_{name}") for name, cuts in rules.items()])


def judge(docs: DataFrame, labels: DataFrame, *keep: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Features, ``base_failed``, the rules that reject and ``kept`` for each document, and its columns ``keep``."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    measured = cut_lineage(features(docs.withColumn("stratum", F.coalesce(lang, F.lit("und"))), "stratum", *keep))
    cuts = cut_lineage(safe_cutoffs(measured, labels, alpha, delta).coalesce(1))
    few = cuts.limit(STRATA + 1).count() <= STRATA
    if few:
        judged = measured.join(F.broadcast(cuts), "stratum", "left")
    else:
        sizes = measured.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
        judged = spread_join(measured, cuts, "stratum", "doc_id", hot_keys(sizes, "stratum", "n"), "left")
    rejects = F.array_compact(F.array(*[F.when(c > F.col(f"cut_{name}"), F.lit(name)) for name, c in _ratios().items()]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", base).withColumn("rejected_by", rejects).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not kept."""
    content = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    verdict = cut_lineage(judge(docs.withColumn("digest", content), labels, "digest").select("doc_id", "digest", "kept"))
    return drop_losers(docs, content, verdict)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
