"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every metric is a Column over the whole text, every rule a row of a table of
``(name, metric, least, most)``; :func:`judge` compiles the table into flag
columns and a verdict in one select. No shuffle, no user function.

Defined cases: a null text counts as no words (all metrics zero); an empty text
likewise; repeated rows and repeated or null ids are judged row by row; a long text is
measured whole, as arrays of its words within one row; an empty table gives an empty
result; columns of the input that clash with a metric's name are replaced by the metric.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common short words of the corpus languages, one list for each language; a text's are those of the language it has most of.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "with", "as", "was", "it", "by", "be", "this", "are", "or", "at"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "dans", "qui", "par", "pour", "au", "sur"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su"),
}
SPACE = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A document passes if ``least <= metric <= most``; a bound of None is open."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: Production thresholds. The first two are hard limits, the rest catch junk.
BASE_RULES = (
    Rule("enough_words", "n_words", least=50),
    Rule("few_repeats", "repeat_ratio", most=0.5),
)
METHOD_RULES = (
    Rule("word_length", "mean_word_length", least=2.0, most=12.0),
    Rule("few_symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.05),
    Rule("few_dup_lines", "dup_line_ratio", most=0.4),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != F.lit(""))


def _repeated(words: str, windows: str) -> Column:
    """Words under 3-word windows that occur twice or more, from the words and the windows' hashes.

    Sorting (hash, place) pairs puts windows of equal hash side by side in n log n steps,
    and neighbours of equal hash are compared by their words, so unequal windows never
    count. Equal ones would be missed only if a third window of the text shared their 64-bit
    hash and stood between them: for a text of a million words, odds below 1 in 10
    million. The places found then count up to three words each, less where they overlap.
    """
    same = lambda j: f"x.h = get(s, {j}).h AND " + " AND ".join(f"get({words}, x.i + {k}) = get({words}, get(s, {j}).i + {k})" for k in range(3))
    return F.expr(
        f"""element_at(transform(array(array_sort(transform({windows}, (h, i) -> named_struct('h', h, 'i', i)))), s ->
              element_at(transform(array(sort_array(filter(transform(s, (x, j) ->
                  IF({same("j - 1")} OR {same("j + 1")}, x.i, NULL)), v -> v IS NOT NULL))), p ->
                aggregate(transform(p, (v, j) -> CAST(least(3, coalesce(get(p, j + 1) - v, 3)) AS BIGINT)), 0L, (a, b) -> a + b)), 1)), 1)"""
    )


def _among(words: tuple[str, ...]):
    return lambda w: F.lower(w).isin(*words)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the count and ratio columns that rules may name."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = [c for c in df.columns if c not in METRICS]
    out = df.select(*own, body.alias("__body")).withColumn("__words", _words(F.col("__body")))
    out = out.withColumns(
        {
            "__n": F.size("__words"),
            "__chars": F.length(F.array_join("__words", "")),
            "__lines": F.filter(F.split("__body", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "__stop": F.greatest(*[F.size(F.filter("__words", _among(words))) for words in STOP_WORDS.values()]),
            "__windows": F.expr("slice(transform(__words, (w, i) -> xxhash64(w, get(__words, i + 1), get(__words, i + 2))), 1, greatest(size(__words) - 2, 0))"),
        }
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = out.withColumns(
        {
            "n_words": F.col("__n").cast("long"),
            "word_chars": F.col("__chars").cast("long"),
            "n_symbols": F.length(F.regexp_replace("__body", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct("__windows")) == F.size("__windows"), F.lit(0).cast("long")).otherwise(_repeated("__words", "__windows")),
            "n_stop_words": F.col("__stop").cast("long"),
        }
    ).drop("__body", "__words", "__n", "__chars", "__lines", "__stop", "__windows")
    return out.withColumns(
        {
            "mean_word_length": ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": ratio(F.col("n_symbols"), F.col("word_chars")),
            "stop_ratio": ratio(F.col("n_stop_words"), F.col("n_words")),
            "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_ratio": ratio(F.col("n_repeat_words"), F.col("n_words")),
        }
    )


METRICS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
    "mean_word_length", "symbol_ratio", "stop_ratio", "dup_line_ratio", "repeat_ratio",
)


def passes(rules) -> Column:
    """The conjunction of a table of rules as one Column."""
    out = F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & (F.col(r.metric) >= F.lit(r.least))
        if r.most is not None:
            out = out & (F.col(r.metric) <= F.lit(r.most))
    return out


def judge(df: DataFrame, text: str = "text", base=BASE_RULES, rules=METHOD_RULES) -> DataFrame:
    """``df`` with all metrics, ``base_failed``, and ``kept``: true where base and method rules hold."""
    out = measure(df.drop("base_failed", "kept"), text)
    return out.withColumns({"base_failed": ~passes(base), "kept": passes(base) & passes(rules)})


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(base=BASE_RULES, rules=METHOD_RULES) -> str:
    """DuckDB SQL of :func:`op10_quality_rules`."""
    stop = ", ".join("len(list_filter(ws, lambda x: lower(x) IN (" + ", ".join(f"'{w}'" for w in words) + ")))" for words in STOP_WORDS.values())
    cond = " AND ".join(f"{r.metric} {op} {v}" for r in rules for op, v in ((">=", r.least), ("<=", r.most)) if v is not None)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT k, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
g3 AS (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM g3 WHERE c > 1) GROUP BY k),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             greatest({stop}) AS n_stop_words
      FROM w LEFT JOIN r USING (k)),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_length,
             CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_ratio,
             CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0.0 END AS stop_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
             (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {cond}) AS kept FROM q"""
