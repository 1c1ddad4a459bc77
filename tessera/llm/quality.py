"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, fresh, words_of

#: Frequent function words of the languages served.
STOP_WORDS = (
    "the be to of and that have with in is was for on are as at by this from it an or "
    "le la les de des et un une que qui dans pour est sur avec pas du au par "
    "der die das und ist von den mit zu auf ein eine nicht sich dem des im "
    "el los las en y por para una con no su se del lo como es"
).split()

#: A text is rejected if the measure is under the lower or over the upper bound (None: no bound). Shares
#: are of words, of characters in words, or of lines with a word.
THRESHOLDS = [
    ("mean_word_chars", 1.5, 15.0),
    ("symbols_per_word", None, 0.1),
    ("marks_per_word", None, 0.5),
    ("upper_share", None, 0.4),
    ("dup_line_share", None, 0.5),
    ("stop_word_share", 0.01, None),
]
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once a row even where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _recurring(pairs: Column) -> Column:
    """Starts, unordered, of the (key, start) pairs, sorted by key, whose key a neighbour has too."""

    def start(i: Column) -> Column:
        key = lambda j: F.get(pairs, j)["k"]
        again = F.coalesce(key(i) == key(i - 1), F.lit(False)) | F.coalesce(key(i) == key(i + 1), F.lit(False))
        return F.when(again, F.get(pairs, i)["i"])

    return F.when(F.size(pairs) == 0, F.array().cast("array<int>")).otherwise(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(pairs) - 1), start)))


def _covered(words: Column, hashes: Column) -> Column:
    """Words in windows that occur twice or more: those of one hash, sorted and compared as text."""

    def total(at: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda j: F.least(F.coalesce(F.get(at, j + 1) - F.get(at, j), F.lit(WINDOW)), F.lit(WINDOW)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda a, x: a + x))

    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("i"))))
    by_text = lambda at: F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("k"), i.alias("i"))))
    return _let(by_hash, lambda a: _let(by_text(_recurring(a)), lambda b: _let(F.sort_array(_recurring(b)), total)))


def _repeat_words(words: Column) -> Column:
    """Windows are hashed first; if no hash recurs no window does, else the windows are compared as text.

    The words are bound to a lambda's variable: a lambda that captured the expression would split the text for each window.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def repeats(w: Column):
        return lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(w, hashes))

    def bound(w: Column) -> Column:
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(_let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _let(windows(h), repeats(w))))

    return _let(words, bound)


def quality_measures(df: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """All rows and columns of df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept.

    A null text has no words and fails. An empty table gives an empty table. Equal rows get equal verdicts.
    Columns of df that have the name of a new column are replaced.
    """
    words, lines, text = fresh(df, "words__", "lines__", "text__")
    with_words = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    with_words = with_words.withColumn(words, words_of(F.col(text))).withColumn(lines, F.filter(F.split(F.col(text), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    w, t, n = F.col(words), F.col(text), F.size(words)
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    symbols, joined = left(r"[^#*$%&|<>]+"), F.array_join(w, "")
    base = {
        "n_words": n.cast("long"),
        "word_chars": F.length(joined).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(w).cast("long"),
    }
    more = {
        "mark__": left(r"[^!?]+"),
        "upper__": left(r"[^\p{Lu}]+"),
        "stop__": F.size(F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda x: x.isin(STOP_WORDS))),
        "lines__n": F.size(lines),
    }
    names = dict(zip(more, fresh(df, *more)))
    old = [c for c in df.columns if c.lower() not in {*base, "base_failed", "kept"}]
    measured = with_words.select(*old, *[v.alias(k) for k, v in base.items()], *[v.alias(names[k]) for k, v in more.items()])
    c, per = F.col, lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    measures = {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "marks_per_word": per(names["mark__"], "n_words"),
        "upper_share": per(names["upper__"], "word_chars"),
        "dup_line_share": per("n_dup_lines", names["lines__n"]),
        "stop_word_share": per(names["stop__"], "n_words"),
    }
    passes = F.lit(True)
    for name, low, high in thresholds:
        for bound, ok in ((low, lambda x, b: x >= b), (high, lambda x, b: x <= b)):
            if bound is not None:
                passes = passes & ok(measures[name], F.lit(bound))
    failed = (c("n_words") < LEAST_WORDS) | (100 * c("n_repeat_words") > MOST_REPEATED * c("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & passes).select(*old, *base, "base_failed", "kept")


def quality_filter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that pass, with df's columns."""
    (keep,) = fresh(df, "verdict__")
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    clash = [x for x in df.columns if x.lower() in new]
    safe = df.withColumnsRenamed({x: f"{keep}{x}" for x in clash})
    measured = quality_measures(safe, f"{keep}{text_col}" if text_col in clash else text_col)
    # a column that is not deterministic keeps the filter above the projection; below it, each use of a measure would be evaluated anew
    marked = measured.withColumn(keep, F.monotonically_increasing_id())
    out = marked.filter(F.col("kept") & (F.col(keep) >= 0)).drop(keep, *new)
    return out.withColumnsRenamed({f"{keep}{x}": x for x in clash}).select(df.columns)
