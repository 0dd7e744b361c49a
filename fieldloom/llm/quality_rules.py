"""Quality rules whose cutoffs are risk-controlled on labelled holdouts.

Every rule rejects documents whose measure lies above a cutoff. The rules are tightened together
along one path that is fixed beforehand: all rules at the loosest cutoff, one after the other, then
at the next, and so on. A stratum goes along the path as far as its labelled good documents show,
by the exact binomial tail, that the rules so far reject together at most a set share of good
documents. Steps are tested in order until the first that fails (fixed sequence), so a stratum
takes one share of the error level, which is split over the strata (Bonferroni). With too few
labels no cutoff is admitted and nothing is rejected. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, materialize
from .special import binomial_tail

#: Measures, each a share or a rate for which more is worse.
RULES = ("symbol_rate", "exclaim_rate", "upper_share", "dup_line_share")
#: Candidate cutoffs, from the loosest.
CUTOFFS = (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02, 0.01)
#: Declared strata; other languages, and null, share one more.
STRATA = ("en", "de", "fr", "es")
#: Of good documents, the share that all rules together may reject, and the chance that a cutoff breaks that.
ALPHA, DELTA = 0.025, 0.05


def stratum_of(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise("other")


def measures(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stratum, the base counts and the measures of every whole text (null: no words), and the columns to carry as the struct `row`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.struct(*carry).alias("row")] if carry else []
    own = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), stratum_of(F.col("lang")).alias("stratum"), *row).alias("own"), text.alias("text"))
    words = own.select("own", "text", F.array_remove(F.split("text", f"[{SPACES}]+"), "").alias("w"))
    grams = words.select("own", "text", "w", F.expr("slice(transform(w, (x, i) -> xxhash64(slice(w, i + 1, 5))), 1, greatest(size(w) - 4, 0))").alias("g"))
    # windows that occur twice, by sorting (hash, place) only where a text has any
    repeated = """case when size(array_distinct(g)) = size(g) then cast(array() as array<int>) else
        array_sort(array_compact(transform(array(array_sort(transform(g, (h, i) -> struct(h, i)))), s ->
            transform(s, (x, k) -> case when (k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h) then x.i end))[0])) end"""
    lines = "filter(split(text, '\\n'), l -> rlike(l, '[^\\\\x20\\\\x09-\\\\x0D]'))"
    marks = grams.select("own", "text", "w", F.expr(repeated).alias("r"), F.expr(lines).alias("lines"))
    counted = marks.select(
        "own.*",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(case when size(r) = 0 then 0 else 5 + aggregate(zip_with(r, slice(r, 2, size(r)), (a, b) -> case when b is null then 0 else least(5, b - a) end), 0, (s, x) -> s + x) end as bigint)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclaims"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "n_words").alias("symbol_rate"),
        share("n_exclaims", "n_words").alias("exclaim_rate"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
    )


def select_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff column per rule, null if none is admitted): at most a row per declared stratum and one more.

    labels: doc_id and quality; a document labelled good and bad counts as good. Good documents of
    the holdout that the base rules reject anyway say nothing of the cutoffs and are left out.
    """
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    held = measured.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    # the first step of the path that rejects the document: candidates that keep it, loosest first, then the rule's place
    kept_by = lambda r: F.size(F.filter(F.array(*[F.lit(x) for x in CUTOFFS]), lambda x: x >= F.col(r)))
    step = F.least(*[kept_by(r) * len(RULES) + j for j, r in enumerate(RULES)])
    counts = held.select("stratum", step.alias("step")).groupBy("stratum", "step").agg(F.count("*").alias("n"))
    totals = counts.groupBy("stratum").agg(F.sum("n").alias("n"), F.collect_list(F.struct("step", "n")).alias("by"))  # a row per step of the path and one more, at most
    tests = totals.select("stratum", "n", "by", F.explode(F.sequence(F.lit(0), F.lit(len(RULES) * len(CUTOFFS) - 1))).alias("step"))
    tests = tests.select("stratum", "n", "step", F.expr("aggregate(by, 0L, (s, b) -> s + if(b.step <= step, b.n, 0L))").alias("k"))
    # rejections only grow along the path, and with them the tail: the steps that pass come first
    passed = tests.filter(binomial_tail(F.col("k"), F.col("n"), alpha) <= delta / (len(STRATA) + 1)).groupBy("stratum").agg(F.max("step").alias("last"))
    level = lambda j: F.floor((F.col("last") - j) / len(RULES)).cast("int")
    cut = lambda j: F.when(level(j) >= 0, F.element_at(F.array(*[F.lit(x) for x in CUTOFFS]), level(j) + 1))
    return passed.select("stratum", *[cut(j).alias(f"cut_{r}") for j, r in enumerate(RULES)])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, carry: tuple[str, ...] = ()) -> DataFrame:
    """Measures of every document, base_failed and kept, and the columns to carry along as the struct `row`.

    Null text: no words, so base_failed. Null doc_id: judged, never a holdout. Repeated rows: a row
    each. Null or undeclared language: the stratum 'other'. Empty table or labels: nothing beyond
    the base rules is rejected. Other columns are ignored.
    """
    measured = materialize(measures(docs, carry), "measures")
    cuts = F.broadcast(select_cutoffs(measured, labels, alpha, delta))  # at most a row per declared stratum and one more
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return measured.join(cuts, "stratum", "left").withColumn("kept", ~(F.col("base_failed") | over))
