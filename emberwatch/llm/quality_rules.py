"""Quality rules: a table of thresholds compiled into one projection over whole texts.

Words are the runs without space and U+0009 to U+000D. Null and empty texts have no words and zero in every measure; they
fail the least-words rule. Ratios with nothing to divide by are null and fail no rule. Rows come back as they came, ties
and repeats included; columns beyond doc_id and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import GAP, by_place, pick

SYMBOLS = "#*$%&|<>"
WINDOW = 5
WORD_CHAR = r"[^\x20\x09-\x0D]"
# Frequent words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "was", "with", "be", "by", "on", "are", "this", "from", "or",
    "which", "at", "it", "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "im", "für", "auf", "eine", "ein",
    "dem", "des", "sich", "nicht", "als", "le", "la", "les", "et", "de", "du", "un", "une", "est", "que", "dans", "qui",
    "pour", "par", "sur", "au", "avec", "pas", "el", "los", "las", "y", "en", "del", "se", "por", "con", "una", "para",
    "como", "al", "su", "no",
]


@dataclass(frozen=True)
class Rule:
    """A measure and the range it must lie in; both borders belong to the range."""

    measure: str
    least: float | None = None
    most: float | None = None


# Rules of which one failure makes base_failed, then those of the verdict.
BASE_RULES = [Rule("n_words", least=10), Rule("repeat_word_percent", most=20)]
RULES = [
    Rule("mean_word_chars", least=1.5, most=20),
    Rule("symbols_per_word", most=0.1),
    Rule("stop_word_ratio", least=0.05),
    Rule("dup_line_ratio", most=0.5),
    Rule("mean_line_words", least=2),
]


def measured(df: DataFrame, prefix: str = "") -> DataFrame:
    """``df`` with the measures of its column ``text`` added, their names led by ``prefix``; JVM expressions only."""
    t = f"{prefix}_"
    text = F.coalesce("text", F.lit(""))
    df = df.withColumns(
        {f"{t}words": F.array_remove(F.split(text, GAP), ""), f"{t}lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))}
    )
    words, lines = F.col(f"{t}words"), F.col(f"{t}lines")
    df = df.withColumn(f"{t}hashes", F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col(f"{t}hashes")
    starts = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
    df = df.withColumn(f"{t}wins", F.transform(starts, lambda x, i: F.xxhash64(x, *[h[i + k] for k in range(1, WINDOW)])))
    wins = F.col(f"{t}wins")
    # Only texts with an equal window twice are sorted: windows by hash, then the places of those with an equal neighbour.
    placed = F.sort_array(F.transform(wins, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn(f"{t}sorted", F.when(F.size(F.array_distinct(wins)) < F.size(wins), placed))
    s = F.col(f"{t}sorted")
    twice = lambda e, k: F.when((e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"]), e["i"])
    df = df.withColumn(f"{t}places", F.sort_array(F.filter(F.transform(s, twice), lambda i: i.isNotNull())))
    places = F.col(f"{t}places")
    reach = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
    stop = F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(stop),
    }
    # A filter on the measures must not be pushed below them, where each would be computed once a word: the row number
    # is not deterministic, and failures() refers to it.
    df = df.withColumns({f"{prefix}{k}": c.cast("long") for k, c in counts.items()} | {f"{prefix}row": F.monotonically_increasing_id()})
    return df.drop(*[f"{t}{c}" for c in ("words", "lines", "hashes", "wins", "sorted", "places")])


def ratios(prefix: str = "") -> dict[str, Column]:
    c = lambda name: F.col(f"{prefix}{name}").cast("double")
    per = lambda a, b: F.when(b > 0, a / b)
    return {
        "n_words": c("n_words"),
        "repeat_word_percent": per(100 * c("n_repeat_words"), c("n_words")),
        "mean_word_chars": per(c("word_chars"), c("n_words")),
        "symbols_per_word": per(c("n_symbols"), c("n_words")),
        "stop_word_ratio": per(c("n_stop_words") + 1, c("n_words")),  # one more, so that few words are not judged
        "dup_line_ratio": per(c("n_dup_lines"), c("n_lines")),
        "mean_line_words": per(c("n_words"), c("n_lines")),
    }


def failures(rules: list[Rule], prefix: str = "") -> Column:
    """Names of the rules that a row fails."""
    found, of = [], ratios(prefix)
    for r in rules:
        below = of[r.measure] < r.least if r.least is not None else F.lit(False)
        above = of[r.measure] > r.most if r.most is not None else F.lit(False)
        found.append(F.when(F.coalesce(below | above, F.lit(False)), F.lit(r.measure)))
    return F.when(F.col(f"{prefix}row") >= 0, F.array_compact(F.array(*found)))


def quality_rules(docs: DataFrame, base: list[Rule] = BASE_RULES, rules: list[Rule] = RULES) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and the names of the failed rules per row of ``docs(doc_id, text)``."""
    out = measured(pick(docs, "doc_id", "text")).drop("text")
    out = out.withColumn("base_failed", F.size(failures(base)) > 0)
    out = out.withColumn("failed", F.concat(failures(base), failures(rules)))
    return out.withColumn("kept", F.size("failed") == 0).drop("row")


def keep_good(docs: DataFrame, base: list[Rule] = BASE_RULES, rules: list[Rule] = RULES) -> DataFrame:
    """Rows of ``docs`` that fail no rule, with the columns of ``docs``, whatever else these are called."""
    rows, (text,) = by_place(docs, "text")
    out = measured(rows.withColumn("text", F.col(text)), "__rule_").where(F.size(failures([*base, *rules], "__rule_")) == 0)
    return out.select(*rows.columns).toDF(*docs.columns)
