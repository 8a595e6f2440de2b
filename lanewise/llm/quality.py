"""Quality rules: a table of thresholds, compiled into one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, ascii_lower

#: Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    "the", "and", "of", "to", "a", "in", "is", "that", "it", "was", "for", "with", "on", "are", "be", "this",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "nicht", "ein", "eine", "für", "ist",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "est", "que", "pour", "dans", "par",
    "el", "los", "las", "y", "no", "una", "su", "con", "del", "al", "lo", "como", "más", "pero",
)

#: (metric, comparison that rejects, threshold, fewest words for the rule to apply)
RULES = (
    ("n_words", "<", 20, 0),
    ("n_words", ">", 1_000_000, 0),
    ("mean_word_chars", "<", 2.0, 0),
    ("mean_word_chars", ">", 16.0, 0),
    ("symbol_ratio", ">", 0.1, 0),
    ("stop_ratio", "<", 0.02, 50),
    ("dup_line_ratio", ">", 0.3, 0),
    ("bullet_line_ratio", ">", 0.9, 0),
    ("ellipsis_line_ratio", ">", 0.3, 0),
    ("alpha_ratio", "<", 0.6, 0),
)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, width: int = 8) -> Column:
    """Words of windows of ``width`` words that occur twice or more, every occurrence counted, overlaps once."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n_windows = F.size(words) - width + 1
    grams = _let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(F.slice(h, i, width))))

    def starts(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return _let(
            pairs,
            lambda p: F.array_sort(
                F.transform(
                    F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["g"] == x["g"])) | F.coalesce(F.get(p, k + 1)["g"] == x["g"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(s: Column) -> Column:
        zero = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(width), x - acc["last"])).alias("n"))
        return F.aggregate(s, zero, step, lambda acc: acc["n"])

    repeated = _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(starts(g))))
    return F.when(n_windows >= 2, repeated).otherwise(F.lit(0).cast("long"))


def with_quality(docs: DataFrame, rules: tuple = RULES, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Quality measures and verdict of every text: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept`` and the name of the first rule that rejects, ``reason``.

    One map over the rows; repeated rows give repeated results. A null or empty text has no words and fails. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0)
    base = base.withColumn("l", lines).select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: ascii_lower(x).isin(*stop_words))).cast("long").alias("n_stop"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.size(F.filter("l", lambda x: F.ltrim(x).rlike(r"^[-*•]\s"))).cast("long").alias("n_bullets"),
        F.size(F.filter("l", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))).cast("long").alias("n_ellipses"),
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    metrics = {
        "n_words": F.col("n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "word_chars"),
        "stop_ratio": per("n_stop", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "bullet_line_ratio": per("n_bullets", "n_lines"),
        "ellipsis_line_ratio": per("n_ellipses", "n_lines"),
        "alpha_ratio": per("n_letters", "word_chars"),
    }
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    reason = F.coalesce(
        F.when(failed, F.lit("base")),
        *[F.when((F.col("n_words") >= least) & ((metrics[m] < v) if op == "<" else (metrics[m] > v)), F.lit(f"{m} {op} {v}")) for m, op, v, least in rules],
    )
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), reason.isNull().alias("kept"), reason.alias("reason"))
