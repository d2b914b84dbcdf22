"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Base counts come from each text alone, in whole-number form. Four ratios of them are judged against fences that the
corpus itself sets: every (lang, source) group has a sketch per ratio, and the fences are its median and 90 % quantile
extended by their distance.

Sketch. A value is counted under its leading ``BITS`` binary digits (relative error below 1/64). Such counts merge by
addition, so groups roll up from one partial aggregation, sources merge into their language, and a hot group is one row
per cell and task before the shuffle. Small groups lean on their language: a fence is the mean of the group's and the
language's, weighted by n and ``LEAN`` (a continuous rule; there is no size at which it switches).

Defined results: null or blank text has no words and fails the base rule; null lang or source is a group of its own;
repeated rows are judged alike; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.llm.common import fresh, join_small, let, materialise, same, words

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BITS = 7
LEAN = 200
REACH = 3  # fence: quantile + REACH * (its distance to the median) + the ratio's slack
#: ratio: (numerator, denominator, scale, slack, is there a lower fence too?)
RATIOS = {
    "word_length": ("word_chars", "n_words", 100, 150, True),
    "symbols": ("n_symbols", "word_chars", 10000, 300, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 100, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 100, False),
}


def _repeat_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text (linear but for one sort)."""
    windows = F.transform(F.sequence(F.lit(0), F.size(tokens) - 3), lambda i: F.struct(
        F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)).alias("w"), i.alias("i")))

    def starts(ordered: Column) -> Column:
        text = lambda j: F.get(ordered, j)["w"]
        twice = F.filter(ordered, lambda x, j: (F.coalesce(text(j + 1) == x["w"], F.lit(False))
                                                | F.coalesce(F.when(j > 0, text(j - 1)) == x["w"], F.lit(False))))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        spans = F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - i, F.lit(3))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    def counted(found: Column) -> Column:
        plain = F.size(F.array_distinct(F.transform(found, lambda x: x["w"]))) == F.size(found)
        return F.when(plain, 0).otherwise(let(let(F.sort_array(found), starts), covered))

    return F.when(F.size(tokens) < 3, 0).otherwise(let(windows, counted))


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a text (null: empty)."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(tokens: Column, kept: Column) -> Column:
        named = {"n_words": F.size(tokens), "word_chars": F.length(F.array_join(tokens, "")),
                 "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)),
                 "n_dup_lines": F.size(kept) - F.size(F.array_distinct(kept)),
                 "n_repeat_words": _repeat_words(tokens), "n_lines": F.size(kept)}
        return F.struct(*[v.cast("bigint").alias(k) for k, v in named.items()])

    return let(words(text), lambda tokens: let(lines, lambda kept: counts(tokens, kept)))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed and the ratios as whole numbers."""
    counted = docs.select("doc_id", "lang", "source", F.explode(F.array(base_counts(F.col("text")))).alias("c"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    ratios = {name: F.when(F.col(b) > 0, F.expr(f"{scale} * {a} div {b}")).otherwise(F.lit(0).cast("bigint"))
              for name, (a, b, scale, _, _) in RATIOS.items()}
    return counted.select("doc_id", "lang", "source", "c.*").withColumn("base_failed", failed).withColumns(ratios)


def cell(value: Column) -> Column:
    """Sketch cell of a whole number: its leading binary digits, the rest zero."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    step = F.pow(F.lit(2.0), drop)
    return (F.floor(value / step) * step).cast("bigint")


def sketches(measured: DataFrame) -> DataFrame:
    """Mergeable sketches: rows (lang, source, ratio, cell, n) over the documents that pass the base rule."""
    ratios = F.array(*[F.struct(F.lit(name).alias("ratio"), F.col(name).alias("value")) for name in RATIOS])
    return (measured.filter(~F.col("base_failed")).select("lang", "source", F.inline(ratios))
            .groupBy("lang", "source", "ratio", cell(F.col("value")).alias("cell")).agg(F.count("*").alias("n")))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "ratio", "cell").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per key and ratio: rows, 10 %, 50 % and 90 % quantiles (least cell that holds the rank)."""
    part = Window.partitionBy(*keys, "ratio")
    ranked = (sketch.withColumn("upto", F.sum("n").over(part.orderBy("cell")))
              .withColumn("rows", F.sum("n").over(part)))
    at = lambda q: F.min(F.when(F.col("upto") * 10 >= F.col("rows") * q, F.col("cell")))
    return ranked.groupBy(*keys, "ratio").agg(F.max("rows").alias("rows"), at(1).alias("q10"), at(5).alias("q50"),
                                              at(9).alias("q90"))


def fences(measured: DataFrame) -> DataFrame:
    """One row per (lang, source): key and, for every ratio, its lower and upper fence."""
    stored = materialise(sketches(measured), "quality-sketches")
    own = quantiles(stored, "lang", "source").withColumn("parent", same(F.col("lang")))
    whole = (quantiles(materialise(merge(stored, "lang"), "quality-languages"), "lang")
             .select(same(F.col("lang")).alias("parent"), "ratio",
                     *[F.col(q).alias(f"lang_{q}") for q in ("q10", "q50", "q90")]))
    mean = lambda q: ((F.col("rows") * F.col(q) + LEAN * F.col(f"lang_{q}")) / (F.col("rows") + LEAN))
    slack = F.element_at(F.create_map(*[F.lit(x) for k, v in RATIOS.items() for x in (k, v[3])]), F.col("ratio"))
    edges = own.join(whole, ["parent", "ratio"]).select(
        F.concat_ws("/", same(F.col("lang")), same(F.col("source"))).alias("key"), "ratio",
        (mean("q90") + REACH * (mean("q90") - mean("q50")) + slack).alias("high"),
        (mean("q10") - REACH * (mean("q50") - mean("q10")) - slack).alias("low"))
    at = lambda name, edge: F.max(F.when(F.col("ratio") == name, F.col(edge))).alias(f"{edge}_{name}")
    return edges.groupBy("key").agg(*[at(n, e) for n in RATIOS for e in ("low", "high")])


def judge(docs: DataFrame) -> DataFrame:
    """measures() with ``kept``: not base_failed and all ratios inside the fences of its language and source."""
    measured = materialise(measures(docs), "quality-measures")
    limits = materialise(fences(measured), "quality-fences")
    key = F.concat_ws("/", same(F.col("lang")), same(F.col("source")))
    inside = F.lit(True)
    for name, (_, _, _, _, lower) in RATIOS.items():
        inside = inside & (F.col(name) <= F.col(f"high_{name}"))
        if lower:
            inside = inside & (F.col(name) >= F.col(f"low_{name}"))
    return (join_small(measured.withColumn("key", key), limits, "key")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
            .select(*measured.columns, "kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns (their counts are taken on the way, the fences first)."""
    limits = materialise(fences(materialise(measures(docs), "quality-measures")), "quality-fences")
    got, key = fresh(docs, "quality_counts"), fresh(docs, "quality_key")
    named = limits.select(F.col("key").alias(key), F.struct(*limits.columns).alias(fresh(docs, "quality_fences")))
    fence = F.col(fresh(docs, "quality_fences"))
    joined = join_small(docs.withColumn(key, F.concat_ws("/", same(F.col("lang")), same(F.col("source")))), named, key)
    counted = joined.withColumn(got, F.explode(F.array(base_counts(F.col("text")))))
    c = F.col(got)
    good = (c["n_words"] >= MIN_WORDS) & (100 * c["n_repeat_words"] <= MAX_REPEAT_PERCENT * c["n_words"])
    for name, (a, b, scale, _, lower) in RATIOS.items():
        value = F.when(c[b] > 0, F.floor(scale * c[a] / c[b])).otherwise(0)
        good = good & (value <= fence[f"high_{name}"])
        if lower:
            good = good & (value >= fence[f"low_{name}"])
    return counted.filter(F.coalesce(good, F.lit(False))).select(*docs.columns)
