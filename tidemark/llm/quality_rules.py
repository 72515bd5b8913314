"""Quality rules with risk-controlled cutoffs, in SQL functions only.

A rule rejects a document whose value lies above a cutoff.  The cutoff of each
rule and stratum comes from labelled documents: one half of them chooses, the
other half certifies by an exact binomial bound that at most ``ALPHA`` of the
good documents of the stratum are rejected by the rule.  The level ``DELTA`` is
divided by the number of rules and strata; cutoffs of one rule are nested, so
they are tested in a fixed order from loose to strict at no further cost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, struct_of, text_of, with_verdict, words_of, written

ALPHA, DELTA = 0.01, 0.05
#: What one rejected good document costs, in rejected bad ones.
COST = 20
#: Cutoffs in thousandths, strict to loose.
CUTOFFS = [5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 600, 700, 800]
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = [*BASE, "rules_failed", "base_failed", "kept"]


def _shifted(array: Column | str, by: int) -> Column:
    """The array from element ``by`` on; zipped with the array it pairs neighbours."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with ``BASE`` counts and ``values``, the rules' values in thousandths by name.

    Repeated windows are found by 64-bit hashes within one text: hashes of
    neighbouring words are joined to pairs, fours and eights.  Positions are
    sorted only in texts in which some window does occur twice.
    """
    text = text_of(text_col)
    out = docs.withColumn("_text", text).withColumn("_words", words_of(F.col("_text")))
    out = out.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    out = out.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    out = out.withColumn("_lines", lines).withColumn("_n_lines", F.size("_lines"))
    out = out.withColumn("n_dup_lines", (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    for name, pattern in (("n_symbols", "[#*$%&|<>]"), ("_marks", "[!?]"), ("_capitals", r"\p{Lu}{3,}")):
        out = out.withColumn(name, F.regexp_count("_text", F.lit(pattern)).cast("long"))
    out = out.drop("_text", "_lines")
    out = out.withColumn("_doubled", F.size(F.filter(F.zip_with("_h", _shifted("_h", 1), lambda a, b: a == b), lambda x: x)))
    for have in (1, 2, 4):
        out = out.withColumn("_h", F.zip_with("_h", _shifted("_h", have), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("_h", F.slice("_h", 1, F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    out = out.withColumn("_pairs", F.when(repeats, pairs)).drop("_h")
    out = out.withColumn("_next", F.zip_with("_pairs", _shifted("_pairs", 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    before = F.concat(F.array(F.lit(False)), F.col("_next"))
    twice = F.zip_with(
        F.zip_with("_pairs", "_next", lambda a, e: F.struct(a["at"].alias("at"), e.alias("same"))), before,
        lambda a, b: F.when(a["same"] | b, a["at"]),
    )
    out = out.withColumn("_at", F.sort_array(F.filter(twice, lambda x: x.isNotNull()))).drop("_pairs", "_next")
    gaps = F.zip_with("_at", _shifted("_at", 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))

    def share(part: str, whole: str) -> Column:
        return F.floor(F.col(part) * 1000 / F.greatest(F.col(whole), F.lit(1))).cast("long")

    values = {
        "symbols": share("n_symbols", "word_chars"), "marks": share("_marks", "n_words"), "capitals": share("_capitals", "n_words"),
        "dup_lines": share("n_dup_lines", "_n_lines"), "repeat_words": share("n_repeat_words", "n_words"), "doubled": share("_doubled", "n_words"),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("value")) for k, v in values.items()])
    return out.withColumn("values", entries).drop("_marks", "_capitals", "_n_lines", "_doubled", "_at")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p): terms by recurrence, summed as logarithms."""
    odds = F.lit(p / (1 - p))
    first = n.cast("double") * F.log1p(F.lit(-p))

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i * odds)
        return F.struct(term.alias("term"), (state["sum"] + F.log1p(F.exp(term - state["sum"]))).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(terms, F.struct(first.alias("term"), first.alias("sum")), step, lambda s: s["sum"]))


def select_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cost: int = COST) -> DataFrame:
    """``stratum, rule, cutoff``: one row for each rule that may act in a stratum.

    ``labelled`` has ``stratum, rule, value, good, certify``.  A rule acts only
    where a certified cutoff exists that rejects bad documents worth more than
    ``cost`` each rejected good one; of equal gains the loosest is taken.
    """
    merged = labelled.groupBy("stratum", "rule", "value").agg(
        F.sum(F.when(F.col("good") & F.col("certify"), 1).otherwise(0)).alias("held"),
        F.sum(F.when(F.col("good") & ~F.col("certify"), 1).otherwise(0)).alias("good"),
        F.sum(F.when(~F.col("good") & ~F.col("certify"), 1).otherwise(0)).alias("bad"),
    )
    merged = written(merged, "quality-counts")
    tests = merged.select("stratum", "rule").distinct().count()

    def above(counted: str) -> Column:
        return F.sum(F.when(F.col("value") > F.col("cutoff"), F.col(counted)).otherwise(0))

    tried = merged.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in CUTOFFS]))).groupBy("stratum", "rule", "cutoff").agg(
        F.sum("held").alias("n"), above("held").alias("k"), (above("bad") - cost * above("good")).alias("gain")
    )
    chance = F.when(F.col("k") < F.col("n") * alpha, binomial_tail(F.col("k"), F.col("n"), alpha)).otherwise(1.0)
    certified = tried.where("n > 0 and gain > 0").where(chance <= delta / max(tests, 1))
    best = certified.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("best"))
    return best.select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    carry: Sequence[str] | None = None, alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """The rows' ``carry`` columns (default all) with ``BASE``, ``rules_failed``, ``base_failed`` and ``kept``.

    ``labels`` has ``doc_id`` and ``quality`` (1 good); contradicting labels of
    one id count as bad.  Rows without an id have no label.  A null stratum is
    the stratum of the empty name; a stratum without enough labelled good
    documents has no certified rule, and only the base checks act there.  A
    null text counts as empty and fails the base.  Repeated rows are judged
    each for itself.  An input column named like a verdict column is replaced.
    """
    carry = list(docs.columns if carry is None else carry)
    return judge_quality(docs, labels, id_col, text_col, stratum_col, carry, alpha, delta).select(*with_verdict(carry, VERDICT))


def judge_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    carry: Sequence[str] | None = None, alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """As ``quality_rules``, with the carried columns in one struct ``doc``."""
    packed = docs.select(
        struct_of(docs.columns if carry is None else carry).alias("doc"), F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("")).alias("stratum"), F.col(f"`{text_col}`").alias("text"),
    )
    rows = written(measured(packed, "text").drop("text"), "quality-rows")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg((F.min("quality") == 1).alias("good"))
    half = F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 1) < "8"
    labelled = rows.select("id", "stratum", "values").join(known, "id").select(
        "stratum", F.explode("values").alias("v"), "good", half.alias("certify")
    )
    cutoffs = select_cutoffs(labelled.select("stratum", "v.rule", "v.value", "good", "certify"), alpha, delta)
    by_stratum = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    # a small table: where its files are below the session's threshold, Spark broadcasts it
    judged = rows.join(written(by_stratum, "quality-cutoffs"), "stratum", "left")
    failed = F.filter("values", lambda v: F.coalesce(v["value"] > F.try_element_at("cutoffs", v["rule"]), F.lit(False)))
    judged = judged.withColumn("rules_failed", F.transform(failed, lambda v: v["rule"]))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = judged.withColumn("base_failed", base).withColumn("kept", ~base & (F.size("rules_failed") == 0))
    return judged.select("doc", *VERDICT)
