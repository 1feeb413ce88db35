"""Quality rules as a short-circuit cascade.

A document is kept if it passes every rule. Which rule runs first only decides the cost: each rule's seconds and
its share of rejected rows are measured on a bounded sample (``SAMPLE_ROWS`` rows), and the rules are ordered by
rejection per second. The verdict is one ``CASE`` expression, so a row that a rule rejects is not put to the later
ones. The verdict does not depend on the order or on the sample. Everything is built-in column functions.

Nulls and odd rows: a null or empty text has no words, fails ``long_enough`` and is rejected; repeated rows are
judged alike, each by itself; an empty table gives an empty result, with the rules in the order they are listed.
Only the text is read, so other columns and their names do not matter. Texts are judged whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import WORD, let, n_words, table, words

SAMPLE_ROWS = 400
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_PERCENT = 10
MAX_DUP_LINES_PERCENT = 30
FEW_DUP_LINES = 2
MAX_SHOUTS_PERCENT = 20
MEAN_WORD_CHARS = (2, 20)
SYMBOLS = r"[#*$%&|<>]"


def repeated_words(ws: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words which the text holds twice or more.

    Windows are compared by their 64-bit hash. Only texts with a repeated window sort theirs; positions of
    equal neighbours, in order, then give the number of words that the windows cover together.
    """
    none = F.lit(0).cast("int")

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("at")))

        def at_repeats(s: Column) -> Column:
            h, n = s.getField("h"), F.size(s)
            gap = F.array(F.lit(None).cast("long"))
            sides = F.arrays_zip(s.getField("at").alias("at"), h.alias("h"), F.concat(gap, F.slice(h, F.lit(1), n - 1)).alias("a"),
                                 F.concat(F.slice(h, F.lit(2), n - 1), gap).alias("b"))
            repeated = F.filter(sides, lambda x: (x["h"] == x["a"]) | (x["h"] == x["b"]))
            return F.sort_array(repeated.getField("at"))

        def cover(p: Column) -> Column:
            k = F.size(p)
            steps = F.zip_with(F.slice(p, F.lit(2), k - 1), F.slice(p, F.lit(1), k - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
            return F.when(k > 0, F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x)).otherwise(none)

        return let(let(by_hash, at_repeats), cover)

    def of_words(w: Column) -> Column:
        count = F.size(w) - (WINDOW - 1)
        columns = [F.slice(w, F.lit(i + 1), count) for i in range(WINDOW)]
        hashes = F.transform(F.arrays_zip(*columns), lambda x: F.xxhash64(x))
        repeats = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(none)
        return F.when(count > 1, let(hashes, repeats)).otherwise(none)

    return let(ws, of_words)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, as one struct."""
    safe = F.coalesce(text, F.lit(""))
    return let(words(safe), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(safe, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(safe).cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words")))


@dataclass(frozen=True)
class Rule:
    """``passes`` maps the text column to a boolean column."""

    name: str
    passes: Callable[[Column], Column]


def _share(part: Column, text: Column, percent: int) -> Column:
    return part * 100 <= n_words(text) * percent


def _lines(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


BASE_RULES = [
    Rule("long_enough", lambda t: n_words(t) >= MIN_WORDS),
    Rule("few_repeated_windows", lambda t: let(words(t), lambda w: repeated_words(w) * 100 <= F.size(w) * MAX_REPEAT_PERCENT)),
]
METHOD_RULES = [
    Rule("few_symbols", lambda t: _share(F.regexp_count(t, F.lit(SYMBOLS)), t, MAX_SYMBOLS_PERCENT)),
    Rule("few_shouts", lambda t: _share(F.regexp_count(t, F.lit("!")), t, MAX_SHOUTS_PERCENT)),
    Rule("few_duplicate_lines", lambda t: let(
        duplicate_lines(t), lambda n: (n <= FEW_DUP_LINES) | (n * 100 <= _lines(t) * MAX_DUP_LINES_PERCENT))),
    Rule("usual_word_length", lambda t: let(words(t), lambda w: F.char_length(F.array_join(w, "")).between(
        F.size(w) * MEAN_WORD_CHARS[0], F.size(w) * MEAN_WORD_CHARS[1]))),
]


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        """Rejected share per second."""
        return self.rejected / max(self.seconds, 1e-4)


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of each rule on at most ``sample_rows`` rows; only the order of rules depends on it."""
    spark = docs.sparkSession
    taken = docs.select("text").limit(sample_rows).collect()
    if not taken:
        return [Estimate(r.name, 1.0, 0.0) for r in rules]
    sample = spark.createDataFrame(taken, docs.select("text").schema).coalesce(1)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for rule in rules:
        counted = sample.agg(F.count_if(~rule.passes(text)).alias("n"))
        counted.first()  # compiles the expression
        start = time.perf_counter()
        rejected = counted.first()["n"]
        found.append(Estimate(rule.name, time.perf_counter() - start, rejected / len(taken)))
    return found


def in_order(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    worth = {e.name: e.worth for e in estimates}
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(text: Column, rules: list[Rule]) -> Column:
    """False at the first rule that the text fails; later rules are not evaluated then."""
    text = F.coalesce(text, F.lit(""))
    verdict = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        verdict = verdict.when(~rule.passes(text), F.lit(False))
    return verdict.otherwise(F.lit(True))


def passing(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass all rules, columns unchanged."""
    rules = BASE_RULES + METHOD_RULES if rules is None else rules
    return docs.where(cascade(F.col("text"), in_order(rules, estimate(docs, rules, sample_rows))))


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = in_order(METHOD_RULES, estimate(docs, METHOD_RULES))
    measured = docs.withColumn("m", measures(F.col("text"))).select(
        "doc_id", "text", *[F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return measured.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(F.col("text"), rules)).alias("kept"))


def quality_ctes(docs: str = "documents") -> str:
    """CTEs up to ``q_all`` (doc_id, the measures, base_failed, kept); doc_id must be unique for them."""
    return f"""
q_w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM {docs}),
q_win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM q_w WHERE len(w) >= {WINDOW})),
q_rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM q_win) WHERE n > 1),
q_cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM q_rep) GROUP BY 1),
q_m AS (SELECT q_w.doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(q_cov.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '!')) AS shouts,
    len(string_split(text, chr(10))) AS n_lines
    FROM q_w LEFT JOIN q_cov ON q_w.doc_id IS NOT DISTINCT FROM q_cov.doc_id),
q_all AS (SELECT *, (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AS base_failed,
    NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT})
    AND n_symbols * 100 <= n_words * {MAX_SYMBOLS_PERCENT} AND shouts * 100 <= n_words * {MAX_SHOUTS_PERCENT}
    AND (n_dup_lines <= {FEW_DUP_LINES} OR n_dup_lines * 100 <= n_lines * {MAX_DUP_LINES_PERCENT})
    AND word_chars BETWEEN n_words * {MEAN_WORD_CHARS[0]} AND n_words * {MEAN_WORD_CHARS[1]} AS kept FROM q_m)"""


OP4_SQL = f"""WITH {quality_ctes()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_all"""
