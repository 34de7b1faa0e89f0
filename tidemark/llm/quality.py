"""Quality rules with risk-controlled thresholds, on DataFrame functions only.

Base rules fail a document outright. Beyond them, each rule of ``RULES`` gives a score in
thousandths, and a document goes if a score reaches the rule's cutoff in its stratum (the
``lang`` column). Cutoffs are chosen on the labelled documents that pass the base rules:

1. One half of them (by a digest of the id) proposes: eighths of the scores of its bad
   documents are the candidate cutoffs of a rule, ``CANDIDATES`` at most.
2. The other half, the holdout, certifies: a candidate is admissible in a stratum if an
   exact binomial test, at the level ``delta`` divided by the number of all tests
   (Bonferroni: strata x rules x candidates), rules out that it rejects more than its share of
   ``alpha`` of the good documents. The rules share ``alpha`` equally, so that together
   they stay below it: of the good documents that pass the base rules, one in twenty goes
   at most, in every stratum at once, with a probability of 95 %.
3. Of the admissible candidates the one that removes the most bad documents, net of good
   ones at tenfold weight, is taken, the highest on a tie.

A language whose holdout has too few good documents for any certificate (some 700) joins
the others of that kind in one stratum. Languages without labelled documents, and strata
without enough even so, get no cutoff and lose nothing but base failures.

Null text has no words (and fails the base rules). A null lang is a language of its own.
A document labelled twice is good only if all its labels say so; labels without a value
are ignored. Repeated rows are judged alike. Texts of any length are handled whole. An
empty table gives an empty result. Extra columns are ignored by ``judge`` and kept by
``keep_good``, whatever their names. Everything about one document is computed in its own
row: nothing is exploded or shuffled but the scores of labelled documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small, release, stage, with_rid

SPACE = " \t\n\x0b\x0c\r"
#: The rules: a count for each thousand of another.
RULES = {
    "symbol_share": ("q_n_symbols", "q_n_words"),
    "upper_share": ("q_n_upper", "q_word_chars"),
    "dup_line_share": ("q_n_dup_lines", "q_n_lines"),
    "pipe_share": ("q_n_pipes", "q_n_words"),
}
HIGHEST, CANDIDATES = 2000, 8
ALPHA, DELTA = 0.05, 0.05
GOOD_WEIGHT = 10
MIN_WORDS, MAX_REPEAT_PERCENT, GRAM = 10, 20, 5


def _counts(docs: DataFrame) -> DataFrame:
    """Adds the words and the cheap counts; all names start with q_."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    docs = docs.withColumns({"q_text": text, "q_trimmed": trimmed})
    words = F.when(F.col("q_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("q_trimmed", r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("q_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    docs = docs.withColumns({"q_words": words, "q_lines": lines})
    return docs.withColumns({
        "q_n_words": F.size("q_words").cast("long"),
        "q_word_chars": F.length(F.array_join("q_words", "")).cast("long"),
        "q_n_symbols": F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "q_n_pipes": F.regexp_count("q_text", F.lit(r"\|")).cast("long"),
        "q_n_upper": F.regexp_count("q_text", F.lit(r"\p{Lu}")).cast("long"),
        "q_n_lines": F.size("q_lines").cast("long"),
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
    }).drop("q_text", "q_trimmed", "q_lines")


def _repeats(docs: DataFrame) -> DataFrame:
    """Adds q_n_repeat_words: words in windows of ``GRAM`` words that occur again in the text.

    Windows are hashed to 64 bits; only texts in which a hash repeats sort them.
    """
    at = F.sequence(F.lit(0), F.size("q_words") - F.lit(GRAM))
    gram = lambda i: F.xxhash64(*[F.get(F.col("q_words"), i + k) for k in range(GRAM)])
    grams = F.when(F.size("q_words") >= GRAM, F.transform(at, gram)).otherwise(F.array().cast("array<bigint>"))
    docs = docs.withColumn("q_grams", grams)
    docs = docs.withColumn("q_again", F.size(F.array_distinct("q_grams")) < F.size("q_grams"))
    numbered = F.array_sort(F.transform("q_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    docs = docs.withColumn("q_sorted", F.when(F.col("q_again"), numbered))
    twin = lambda x, j: F.get("q_sorted", j - 1)["g"].eqNullSafe(x["g"]) | F.get("q_sorted", j + 1)["g"].eqNullSafe(x["g"])
    places = F.array_sort(F.transform(F.filter("q_sorted", twin), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    add = lambda seen, i: F.struct((i + GRAM).alias("end"), (seen["n"] + GRAM - F.greatest(F.lit(0), seen["end"] - i)).alias("n"))
    total = F.aggregate(places, zero, add, lambda seen: seen["n"])
    return docs.withColumn("q_n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("q_grams", "q_again", "q_sorted")


def _scores() -> dict[str, Column]:
    over = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(HIGHEST), F.floor(F.col(a) * 1000 / F.col(b)))).otherwise(0).cast("int")
    return {rule: over(*parts) for rule, parts in RULES.items()}


def base_failed() -> Column:
    return (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words"))


def tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed term by term in logarithms.

    1 where k >= n p, which no admissible cutoff reaches.
    """
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))

    def add(seen, i):
        term = seen["term"] + F.ln((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(seen["sum"], term), F.least(seen["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, start, add, lambda seen: F.exp(seen["sum"]))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(total)


def _candidates(proposals: DataFrame) -> list[tuple[str, int]]:
    """(rule, cutoff): the least score above each eighth of the bad documents that have one, ``CANDIDATES`` a rule at most."""
    long = proposals.filter("not good").unpivot([], list(RULES), "rule", "score").filter("score > 0")
    counts = long.groupBy("rule", "score").agg(F.count("*").alias("n"))  # few distinct scores
    by = Window.partitionBy("rule")
    upto = counts.withColumns({"upto": F.sum("n").over(by.orderBy("score")), "all": F.sum("n").over(by)})
    eighth = F.floor((F.col("upto") - 1) * CANDIDATES / F.col("all"))
    before = F.floor((F.col("upto") - F.col("n") - 1) * CANDIDATES / F.col("all"))
    return sorted((r.rule, r.score) for r in upto.filter((eighth > before) | (F.col("upto") == F.col("n"))).select("rule", "score").collect())


def needed(alpha: float, level: float) -> int:
    """Good documents of which none may be hit to certify ``alpha`` at ``level``."""
    return math.ceil(math.log(level) / math.log1p(-alpha))


def fit_cutoffs(scores: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Staged, one row per labelled language: q_lang and the cutoff of each rule (null: none).

    ``scores`` has doc_id, lang and a column for each rule.
    """
    quality = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) >= "8"
    known = stage(scores.join(quality, "doc_id").select("lang", (F.col("quality") >= 1).alias("good"), held.alias("held"), *RULES))
    options = _candidates(known.filter("not held"))
    langs = known.groupBy("lang").agg(F.count_if(F.col("held") & F.col("good")).alias("n"))
    share = alpha / len(RULES)
    level = delta / ((langs.count() + 1) * len(RULES) * CANDIDATES)
    langs = stage(langs.select(F.col("lang").alias("q_lang"), (F.col("n") >= needed(share, level)).alias("own")))
    stratum = [F.col("own"), F.when(F.col("own"), F.col("q_lang")).alias("stratum")]
    if not options:
        return langs.select("q_lang", *[F.lit(None).cast("int").alias(f"cut_{r}") for r in RULES])
    hits = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cut"), (F.col(r) >= c).alias("hit")) for r, c in options])
    cells = known.filter("held").join(langs, F.col("lang").eqNullSafe(F.col("q_lang"))).select(*stratum, "good", F.explode(hits).alias("o"))
    cells = cells.groupBy("own", "stratum", "o.rule", "o.cut").agg(
        F.count_if(F.col("good")).alias("n"),
        F.count_if(F.col("good") & F.col("o.hit")).alias("k"),
        F.count_if(~F.col("good") & F.col("o.hit")).alias("bad"),
    )
    gain = F.col("bad") - GOOD_WEIGHT * F.col("k")
    fine = stage(cells).filter((tail(F.col("n"), F.col("k"), share) <= F.lit(level)) & (gain > 0))
    best = fine.groupBy("own", "stratum", "rule").agg(F.max_by("cut", F.struct(gain, F.col("cut"))).alias("cut"))
    best = best.groupBy(F.col("own").alias("o"), F.col("stratum").alias("s")).pivot("rule", list(RULES)).agg(F.first("cut"))
    chosen = langs.select("q_lang", *stratum).join(best, (F.col("own") == F.col("o")) & F.col("stratum").eqNullSafe(F.col("s")), "left")
    return stage(chosen.select("q_lang", *[F.col(r).alias(f"cut_{r}") for r in RULES]))


def _rejected() -> Column:
    hits = [F.coalesce(F.col(rule) >= F.col(f"cut_{rule}"), F.lit(False)) for rule in RULES]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def judge(docs: DataFrame, labels: DataFrame, **levels) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, the scores, the cutoffs in force and kept."""
    rows = _repeats(_counts(docs.select("doc_id", "text", "lang"))).withColumns(_scores() | {"base_failed": base_failed()}).drop("q_words", "text")
    rows = stage(rows)
    cutoffs = fit_cutoffs(rows.filter("not base_failed"), labels, **levels)
    rows = rows.join(cutoffs, F.col("lang").eqNullSafe(F.col("q_lang")), "left").drop("q_lang")
    rows = rows.withColumn("kept", ~(F.col("base_failed") | _rejected()))
    return rows.withColumnsRenamed({c: c[2:] for c in rows.columns if c.startswith("q_")})


def keep_good(docs: DataFrame, labels: DataFrame, **levels) -> DataFrame:
    """The rows of ``docs``, all columns, that pass.

    One pass over the texts gives the scores, staged without the texts; a second one leaves
    out the rows that are rejected, a list of names that is broadcast while it is small.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = with_rid(docs.select("doc_id", "text", "lang", whole))
    rows = _repeats(_counts(named.select("rid", "doc_id", "text", "lang"))).withColumns(_scores()).withColumn("base_failed", base_failed())
    rows = stage(rows.select("rid", "doc_id", "lang", *RULES, "base_failed"))
    cutoffs = fit_cutoffs(rows.filter("not base_failed").select("doc_id", "lang", *RULES), labels, **levels)
    judged = rows.join(cutoffs, F.col("lang").eqNullSafe(F.col("q_lang")), "left").filter(F.col("base_failed") | _rejected())
    gone = broadcast_if_small(judged.select(F.col("rid").alias("r"), F.col("lang").alias("l")).distinct())
    release(rows)
    return named.join(gone, (F.col("rid") == F.col("r")) & F.col("lang").eqNullSafe(F.col("l")), "left_anti").select("row.*")
