"""Quality rules: a threshold table compiled into one projection.

Every rule is a row ``(name, metric, least, most)``.  ``verdict`` turns the
table into a single built-in expression over the metric columns; nothing runs
outside the JVM and nothing is shuffled.

Defined results: a null or empty text has zero words and fails; ratios over
nothing are 0; repeated rows are judged one by one; an empty table gives an
empty result; other columns of the input pass through untouched in
``keep_clean`` and are ignored in ``measure``.  Texts are judged whole.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in it for was on as at by this from or an are "
    "le la les de des du et un une en que qui dans pour est sur par avec au aux pas "
    "der die das und von zu mit den ist ein eine sich auf dem nicht auch für "
    "el los las del y una es por con para se al como más su"
).split()


class Rule(NamedTuple):
    name: str
    metric: str
    least: float | None
    most: float | None


#: A document is kept only if every metric lies inside its bounds.
RULES = (
    Rule("length", "n_words", 20, None),
    Rule("word_length", "mean_word_chars", 1.5, 25),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.01, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.7),
    Rule("bullet_lines", "bullet_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_ratio", None, 0.3),
    Rule("shouting", "bang_ratio", None, 0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.transform(F.array(value), body)[0]


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the row.

    Equal windows have equal hashes, so a row of distinct hashes has none.
    Only the others sort their windows themselves, so the count is exact.
    """
    sorted_windows = F.array_sort(F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
        lambda i: F.struct(F.slice(words, i, WINDOW).alias("w"), i.alias("i"))))

    def covered(arr: Column) -> Column:
        twins = F.filter(arr, lambda x, j: (
            F.coalesce(F.get(arr, j - 1)["w"] == x["w"], F.lit(False))
            | F.coalesce(F.get(arr, j + 1)["w"] == x["w"], F.lit(False))))
        starts = F.array_sort(F.transform(twins, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, p: F.struct(
                (p + WINDOW).alias("end"),
                (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n")),
            lambda a: a["n"])

    return F.when(F.size(words) < WINDOW, F.lit(0)).when(
        F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)
    ).otherwise(let(sorted_windows, covered)).cast("long")


def measure(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and every metric that the table can name."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *carry, body.alias("_t"),
        F.filter(F.split(body, WORD_BREAK, -1), lambda w: w != "").alias("_w"),
        F.filter(F.split(body, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0).alias("_l"))
    hashed = split.select(
        "*",
        F.when(F.size("_w") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("_h"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").alias("_n_lines"),
        # A filter on the metrics stays above this number, so that it is not pushed
        # down into copies of the arrays.
        F.monotonically_increasing_id().alias("_mark"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"))
    words, lines = F.col("n_words"), F.col("_n_lines")
    return hashed.select(
        *carry, "_mark", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        _repeat_words(F.col("_w"), F.col("_h")).alias("n_repeat_words"),
        _ratio(F.col("word_chars"), words).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), words).alias("symbol_ratio"),
        _ratio(F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))), words).alias("stop_ratio"),
        _ratio(F.length("_t") - F.length(F.translate("_t", "!", "")), words).alias("bang_ratio"),
        _ratio(F.col("n_dup_lines"), lines).alias("dup_line_ratio"),
        _ratio(F.size(F.filter("_l", lambda x: x.rlike(r"^\s*[-*•]"))), lines).alias("bullet_ratio"),
        _ratio(F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))), lines).alias("ellipsis_ratio"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the metric columns."""
    passed = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            passed = passed & (F.col(rule.metric) >= rule.least)
        if rule.most is not None:
            passed = passed & (F.col(rule.metric) <= rule.most)
    return passed


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",),
          rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics, ``base_failed`` and ``kept`` for every row."""
    return (measure(docs, text, carry)
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))


def keep_clean(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col(f"`{text}`").alias("_text"))
    return judge(whole, "_text", ("_row",), rules).where("kept AND _mark >= 0").select("_row.*")
