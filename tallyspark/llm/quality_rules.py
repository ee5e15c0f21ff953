"""Quality rules: line-first cleaning, DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; lines
that fail are taken out; a document that loses too much of its text, or whose
whole text fails the base rules, is rejected.

Defined results: null text counts as empty; an empty text has no words, fails
the base rules and is not kept; rows with equal ids are judged each on their
own; an empty table gives an empty result; other columns pass through unless
their names clash with the operator's, which then replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, bound, unused, words_of

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Words of a window whose repetition counts.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is noisy when it has this many symbols or doubled exclamation marks for 10 words.
NOISE_PER_10_WORDS = 3
#: A line of this many words must hold some sentence punctuation.
PLAIN_LINE_WORDS = 12
#: A line with this many separators standing alone is navigation.
MIN_SEPARATORS = 2
#: A document that loses more of its words than this is rejected.
MAX_LOST_PERCENT = 50

NOISE = r"[#*$%&<>]+|!!+"
SEPARATOR = r"(^|[ \t])[|»›•·>]+"
SENTENCE = r"[.,;:!?…。]"
#: A short line that holds one of these is boilerplate.
BOILERPLATE = (
    r"(javascript|cookie|all rights reserved|terms of (use|service)|privacy policy|subscribe|newsletter"
    r"|click here|read more|sign (in|up)|log ?in|powered by|lorem ipsum|copyright|skip to content)"
)
BOILERPLATE_WORDS = 30


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more among the given words, the first included."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            n = F.size(p)
            return F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            p,
                            lambda x, j: F.when(
                                ((j > 0) & (F.get(p, j - 1)["h"] == x["h"])) | ((j + 1 < n) & (F.get(p, j + 1)["h"] == x["h"])),
                                x["i"],
                            ).otherwise(F.lit(-1)),
                        ),
                        lambda i: i >= 0,
                    ),
                    lambda i: i,
                )
            )

        counted = F.aggregate(
            bound(pairs, positions),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + i + window - F.greatest(i, a["end"])).alias("n"), (i + window).alias("end")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(counted)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), lambda i: F.xxhash64(F.slice(h, i, window)))

    hashed = lambda ws: F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(bound(bound(bound(words, hashed), windows), covered))


def line_fails(line: Column) -> Column:
    n = F.regexp_count(line, F.lit(f"[^{WHITE}]+"))
    return (
        (F.regexp_count(line, F.lit(NOISE)) * 10 >= n * NOISE_PER_10_WORDS)
        | (F.regexp_count(line, F.lit(SEPARATOR)) >= MIN_SEPARATORS)
        | ((n >= PLAIN_LINE_WORDS) & ~line.rlike(SENTENCE))
        | ((n <= BOILERPLATE_WORDS) & F.lower(line).rlike(BOILERPLATE))
    )


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of the base rules, the cleaned text, and the verdicts base_failed and kept; other columns pass."""
    by_word, by_line = unused(df, "_words", "_lines")
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda s: s.rlike(f"[^{WHITE}]"))
    judged = F.transform(lines, lambda s: F.struct(s.alias("line"), F.regexp_count(s, F.lit(f"[^{WHITE}]+")).alias("n"), line_fails(s).alias("fails")))
    summed = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    per_words = lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_words(ws).cast("long").alias("repeated"))
    per_lines = lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(F.transform(ls, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(ls, lambda x: x["fails"])).cast("long").alias("n_failed_lines"),
        summed(F.transform(ls, lambda x: F.when(x["fails"], x["n"]).otherwise(0))).cast("long").alias("n_lost_words"),
        F.array_join(F.transform(F.filter(ls, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    out = df.withColumns({
        by_word: bound(words_of(F.col(text)), per_words),
        by_line: bound(judged, per_lines),
        "word_chars": (F.length(raw) - F.regexp_count(raw, F.lit(f"[{WHITE}]"))).cast("long"),
        "n_symbols": F.regexp_count(raw, F.lit(SYMBOLS)).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.col(by_word)["n"],
        "n_repeat_words": F.col(by_word)["repeated"],
        **{c: F.col(by_line)[c] for c in ("n_dup_lines", "n_lines", "n_failed_lines", "n_lost_words", "clean_text")},
    }).drop(by_word, by_line)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_lost_words") * 100 <= F.col("n_words") * MAX_LOST_PERCENT)
    )
