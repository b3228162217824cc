"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains. Documents are counted by their pattern of votes (3 ** rules patterns at most,
whatever the corpus), expectation-maximisation over those counts estimates how each rule votes on good and on bad
documents, and the posterior probability of quality decides instead of all-must-pass. The statistics of all documents
go to the shared folder once; the posterior is a sum of literals by vote.

Defined cases: null text has no words and fails; repeated rows and null ids give a row each; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
GOOD, ABSTAIN, BAD = 1, 0, -1


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the numbers that the rules look at; texts are read whole."""
    text = F.coalesce(docs["text"], F.lit(""))
    split = docs.select("doc_id", text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"), F.split(text, "\n").alias("lines"))
    lines = F.filter("lines", lambda x: F.translate(x, BLANKS, "") != "")
    counted = split.select(
        "doc_id", "words", lines.alias("lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length("text").alias("n_chars"),
        _without(F.col("text"), BLANKS).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("text") - _without(F.col("text"), "!?")).alias("n_shouts"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])\p{L}++[.,]?+(?![^\x20\x09-\x0D])")).alias("n_plain"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.xxhash64(F.slice("words", i, 5)))).alias("windows"),
    )
    repeats = F.col("windows").isNotNull() & (F.size(F.array_distinct("windows")) < F.size("windows"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, _repeated(F.col("words"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), "n_chars", "n_shouts", "n_upper", "n_plain", "n_distinct",
    )


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once and then is a variable: looking into it from another lambda costs
    the same at any length."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in a window of five that the text has twice or more. Equal windows are next to each other once
    sorted; what their positions cover is summed in order."""

    def cover(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        text = lambda k: sorted_windows[k]["text"]
        twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ((k > 0) & (text(F.greatest(k - 1, F.lit(0))) == text(k))) | ((k < n - 1) & (text(F.least(k + 1, n - 1)) == text(k))))
        starts = F.array_sort(F.transform(twice, lambda k: sorted_windows[k]["at"]))
        none = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
        step = lambda a, x: F.struct((a["covered"] + x + 5 - F.greatest(a["end"], x)).alias("covered"), (x + 5).alias("end"))
        return F.aggregate(starts, none, step, lambda a: a["covered"])

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, 5)).alias("text"), i.alias("at")))
    return _let(F.array_sort(windows), cover)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def votes() -> dict[str, Column]:
    """Each rule over the statistics. Shares are of words or of characters in words."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = {k: F.col(k) / of for k, of in (("n_symbols", c), ("n_shouts", n), ("n_upper", c), ("n_plain", n), ("n_repeat_words", n), ("n_distinct", n))}
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / n
    return {
        "length": _vote(F.col("n_words") >= 20, F.col("n_words") < 10),
        "symbols": _vote(share["n_symbols"] < 0.005, share["n_symbols"] > 0.03),
        "shouting": _vote(share["n_shouts"] < 0.1, share["n_shouts"] > 0.3),
        "capitals": _vote(share["n_upper"] < 0.15, share["n_upper"] > 0.35),
        "plain_words": _vote(share["n_plain"] > 0.8, share["n_plain"] < 0.6),
        "lines": _vote((dup < 0.1) & (F.col("n_lines") > 1), dup > 0.3),
        "repeats": _vote(share["n_repeat_words"] < 0.1, share["n_repeat_words"] > 0.2),
        "variety": _vote((share["n_distinct"] > 0.4) | (F.col("n_words") < 50), (share["n_distinct"] < 0.2) & (F.col("n_words") >= 50)),
        "word_length": _vote(mean.between(3, 10), (mean < 2) | (mean > 15)),
    }


def learn(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over counted patterns of votes: (log odds of quality, for each rule the log likelihood
    ratio of each vote). Documents with a bad vote begin as bad; a pseudo-vote keeps all estimates inside. Abstaining says nothing about quality."""
    rows = sorted(patterns.items())
    if not rows:
        return 0.0, []
    n_rules = len(rows[0][0])
    weight = [0.001 if BAD in p else 0.999 for p, _ in rows]
    for _ in range(rounds):
        good = sum(w * n for w, (_, n) in zip(weight, rows, strict=True))
        total = sum(n for _, n in rows)
        prior = math.log((good + 1) / (total - good + 1))
        ratios = []
        for j in range(n_rules):
            for_good, for_bad = ({GOOD: 0.5, BAD: 0.5} for _ in range(2))
            for w, (p, n) in zip(weight, rows, strict=True):
                if p[j] != ABSTAIN:
                    for_good[p[j]] += w * n
                    for_bad[p[j]] += (1 - w) * n
            voted_good, voted_bad = sum(for_good.values()), sum(for_bad.values())
            ratios.append({v: math.log(for_good[v] / voted_good) - math.log(for_bad[v] / voted_bad) for v in for_good} | {ABSTAIN: 0.0})
        new = [1 / (1 + math.exp(-max(-700.0, min(700.0, prior + sum(r[v] for r, v in zip(ratios, p, strict=True)))))) for p, _ in rows]
        moved = max(abs(a - b) for a, b in zip(new, weight, strict=True))
        weight = new
        if moved < 1e-10:
            break
    return prior, ratios


def judge(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """A row for each document: the base numbers, base_failed, the posterior ``quality``, and kept."""
    rules = votes()
    numbers = cut(statistics(docs).select("*", *(v.cast("byte").alias(f"rule_{k}") for k, v in rules.items())))
    names = [f"rule_{k}" for k in rules]
    counted = numbers.groupBy(*names).count().collect()  # 3 ** 9 patterns at most
    prior, ratios = learn({tuple(r[:-1]): r[-1] for r in counted})
    odds = F.lit(prior)
    for name, ratio in zip(names, ratios, strict=False):
        odds = odds + F.when(F.col(name) == GOOD, F.lit(ratio[GOOD])).when(F.col(name) == BAD, F.lit(ratio[BAD])).otherwise(F.lit(ratio[ABSTAIN]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = numbers.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return scored.select(*base, (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"), F.round("quality", 6).alias("quality"), *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
