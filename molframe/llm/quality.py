"""Quality rules with adaptive thresholds.

Signals of every text are computed once, inside the row. Their distributions per (language, source) are kept as
quantile sketches: counts over logarithmic value buckets, so that a quantile has a bounded relative error, sketches
merge by adding counts, and the result does not depend on the order of rows. Fences are placed beyond the quartiles of a
sketch. Those of a (language, source) are drawn towards those of the language, and these towards the corpus's, as if a
fixed number of rows there had been added, so that small groups borrow and large ones stand for themselves, with no
size at which the rule changes. They are joined back to the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import settle

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Ratio between neighbouring bucket bounds of a sketch: quantiles are right to 1 %.
GAMMA = 1.02
#: Values below this share one bucket.
TINY = 1e-6
#: Rows that the larger group counts for when a group's fences are drawn towards its own.
PRIOR_ROWS = 200
#: Fences lie this many interquartile ranges beyond the quartiles.
REACH = 3.0
#: Signal: (least interquartile range that counts, whether low values fail too).
SIGNALS = {
    "mean_word": (0.5, True),
    "symbol_share": (0.05, False),
    "dup_line_share": (0.2, False),
    "repeat_share": (0.05, False),
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words covered by five-word windows that occur twice or more in the array.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes.
    """

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(5)), F.lit(5)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda s, g: s + g))

    def positions(order: Column) -> Column:
        twice = F.filter(
            order,
            lambda x, i: x["k"].eqNullSafe(F.get(order, i - 1)["k"]) | x["k"].eqNullSafe(F.get(order, i + 1)["k"]),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def of_windows(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        some = F.size(F.array_distinct(keys)) < F.size(keys)
        return F.when(some, _let(_let(pairs, positions), covered)).otherwise(F.lit(0))

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - 5)
        return _let(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(5)])), of_windows)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > 5, _let(hashes, of_hashes)).otherwise(F.lit(0)).cast("long")


def text_signals(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """Per row: ids, group columns and counted signals of the whole text. A null text has no words and no lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"),
        text.alias("text"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return plain.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def _with_ratios(signals: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return signals.withColumns(
        {
            "mean_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
        }
    )


def sketch(rated: DataFrame) -> DataFrame:
    """Quantile sketches: (lang, source, signal, bucket) with a count. Add counts to merge sketches."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("x")) for s in SIGNALS]))
    rows = rated.where("n_words > 0").select("lang", "source", pairs.alias("p")).select("lang", "source", "p.*")
    bucket = F.when(F.col("x") <= TINY, F.lit(None)).otherwise(F.ceil(F.log("x") / math.log(GAMMA))).cast("int")
    return rows.groupBy("lang", "source", "signal", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and fences per signal of the sketches merged over all but ``keys``, one row per key."""
    merged = sketches.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "signal")
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)), F.lit(0.0))
    ranked = merged.select(
        *keys,
        "signal",
        value.alias("value"),
        F.sum("n").over(group).alias("total"),
        F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first())).alias("upto"),
    )
    quarter = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("value")))
    quartiles = ranked.groupBy(*keys, "signal").agg(
        F.max("total").alias("total"), quarter(0.25).alias("q1"), quarter(0.75).alias("q3")
    )
    floors = F.create_map(*[F.lit(v) for s, (least, _) in SIGNALS.items() for v in (s, least)])
    spread = F.greatest(F.col("q3") - F.col("q1"), floors[F.col("signal")]) * REACH
    wide = quartiles.select(*keys, "signal", "total", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    pick = lambda s, c: F.max(F.when(F.col("signal") == s, F.col(c))).alias(f"{s}_{c}")
    return wide.groupBy(*keys).agg(F.max("total").alias("rows"), *[pick(s, c) for s in SIGNALS for c in ("low", "high")])


def thresholds(sketches: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Fences per (lang, source), drawn towards its language's, which are drawn towards the corpus's."""
    own, by_lang, whole = (_fences(sketches, k) for k in (["lang", "source"], ["lang"], []))
    names = [f"{s}_{c}" for s in SIGNALS for c in ("low", "high")]
    rename = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    lang, corpus = rename(by_lang, "l_"), rename(whole, "c_")  # corpus: one row
    both = own.join(lang, own["lang"].eqNullSafe(lang["l_lang"])).crossJoin(F.broadcast(corpus))
    drawn = lambda rows, mine, theirs: (F.col(rows) * F.col(mine) + prior_rows * theirs) / (F.col(rows) + prior_rows)
    fence = lambda c: drawn("rows", c, drawn("l_rows", f"l_{c}", F.col(f"c_{c}")))
    return both.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[fence(c).alias(c) for c in names])


def quality_rules(
    docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", prior_rows: int = PRIOR_ROWS
) -> DataFrame:
    """Counts, base verdict and adaptive verdict of every row of ``docs``.

    ``base_failed``: under 10 words, or over 20 % of the words in repeated five-word windows. ``kept`` is false for
    those, else true if every signal lies within the fences of the row's (language, source). Null languages and sources
    are groups like any other. Null and empty texts fail for want of words. Repeated rows are judged one by one. An
    empty table gives no rows. Only the named columns are read, so other columns may have any name.
    """
    rated = settle(_with_ratios(text_signals(docs, id_col, text_col, lang_col, source_col)))
    fences = thresholds(sketch(rated), prior_rows)
    joined = rated.join(
        fences, rated["lang"].eqNullSafe(fences["t_lang"]) & rated["source"].eqNullSafe(fences["t_source"]), "left"
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = F.lit(True)
    for signal, (_, both_ways) in SIGNALS.items():
        within &= F.col(signal) <= F.col(f"{signal}_high")
        if both_ways:
            within &= F.col(signal) >= F.col(f"{signal}_low")
    return joined.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        *SIGNALS,
        failed.alias("base_failed"),
        (~failed & F.coalesce(within, F.lit(False))).alias("kept"),
    )
