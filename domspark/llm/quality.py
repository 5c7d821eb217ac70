"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Defined results: a null text is an empty one (no words, so it fails); other columns, also with the names of the
signals, stay out of the way because only the columns asked for are read; repeated rows each get their own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, whole_text, words

#: Frequent function words of the four languages; fixed values.
STOP_WORDS = (
    "the of and to in a is that for it on was as with be by are this or at from an he his not "
    "de la le les des du un une et en que qui dans est pour pas par sur au il ce "
    "der die das und ist nicht den von zu mit sich auf für ein eine im dem auch als "
    "el los las y se del con para por su al lo como más o"
).split()

#: rule, signal, comparison that a good text fulfils, threshold
THRESHOLDS = (
    ("min_words", "n_words", ">=", 20),
    ("repeats", "repeat_ratio", "<=", 0.30),
    ("word_length_low", "mean_word", ">=", 2.5),
    ("word_length_high", "mean_word", "<=", 12.0),
    ("symbols", "symbol_ratio", "<=", 0.20),
    ("shouting", "mark_ratio", "<=", 0.50),
    ("stop_words", "stop_ratio", ">=", 0.08),
    ("stutter", "stutter_ratio", "<=", 0.30),
    ("line_copies", "dup_line_ratio", "<=", 0.40),
)
WINDOW = 8


def repeated_words(tokens: Column, k: int = WINDOW) -> Column:
    """Words that lie in k-word windows found twice or more in the same array of words.

    Windows are compared by the 64-bit hash of their words' hashes, sorted only if one occurs twice.
    """

    def windows(h: Column) -> Column:
        return F.when(F.size(h) < k, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        )

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(k)), F.lit(k))), F.lit(0), lambda a, x: a + x)

    def starts(s: Column) -> Column:
        same = lambda e, i, j: F.coalesce(F.get(s, i + j)["h"] == e["h"], F.lit(False)) & (i + j >= 0)
        return F.array_sort(F.transform(F.filter(s, lambda e, i: same(e, i, 1) | same(e, i, -1)), lambda e: e["p"]))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            bind(F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), lambda s: bind(starts(s), covered))
        )

    return bind(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: bind(windows(h), count))


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the thresholds are made from; a projection, no shuffle."""
    t = whole_text(text)
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    split = docs.withColumn("_words", words(t)).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w, lines = F.col("_words"), F.col("_lines")
    return split.select(
        *[docs[c] for c in docs.columns],
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.length(F.regexp_replace(t, "[^!?]+", "")).cast("long").alias("n_marks"),
        bind(stop, lambda s: F.size(F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda x: F.array_contains(s, x)))).cast("long").alias("n_stop_words"),
        bind(w, lambda ws: F.size(F.filter(ws, lambda x, i: (i > 0) & (x == F.get(ws, i - 1))))).cast("long").alias("n_stutter"),
    )


def verdict(thresholds=THRESHOLDS) -> tuple[Column, Column]:
    """Whether all rules hold, and the names of those that do not, from the columns of signals()."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    value = {
        "n_words": F.col("n_words"),
        "mean_word": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "mark_ratio": F.col("n_marks") / n,
        "stop_ratio": F.col("n_stop_words") / n,
        "stutter_ratio": F.col("n_stutter") / n,
        "repeat_ratio": F.col("n_repeat_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    rules = [(name, value[s] >= F.lit(x) if op == ">=" else value[s] <= F.lit(x)) for name, s, op, x in thresholds]
    good = F.lit(True)
    for _, holds in rules:
        good = good & holds
    return good, F.filter(F.array(*[F.when(~holds, F.lit(name)) for name, holds in rules]), lambda x: x.isNotNull())


def judge(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """docs with the signals, base_failed, kept and the names of the rules that fail."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good, broken = verdict(thresholds)
    return signals(docs, text).withColumns({"base_failed": failed, "kept": ~failed & good, "failed_rules": broken})


def kept_rows(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of docs whose text is kept, in the same columns, whatever their names."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text].alias("_text"))
    return judge(packed, "_text", thresholds).where("kept").select("_row.*")


def op2_quality_rules(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
