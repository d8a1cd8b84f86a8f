"""Quality rules by distribution divergence, in DataFrame functions only.

Each text gives two histograms: character classes, and its language's common words (with one bin for all other words).
The language's references are the mean histograms of its documents that pass the base rules. A document is rejected when a
Jensen-Shannon distance (base 2, 0 to 1) from its reference exceeds that histogram's threshold. Guards: texts under
MIN_CHARS characters aren't judged by characters, under MIN_WORDS words not by words; a null language or one without a word list has no
reference and is judged by the base rules alone.

Base rules: fewer than 20 words, or over 30 % of the words in eight-word windows that occur twice or more. Null text counts as empty.
Equal windows are told by 64-bit hashes inside one text. Each row is judged by itself, so repeated rows and ids get equal
verdicts; an empty table gives an empty result; extra columns pass through ``rules``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Frequent function words of each language with a reference (fixed values).
COMMON_WORDS = {
    "de": "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu".split(),
    "en": "a and are as at be by for from he in is it of on that the this to was with".split(),
    "es": "al con de del el en es esta la las los no para por que se su un una y".split(),
    "fr": "au avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une".split(),
}
MIN_CHARS, MIN_WORDS = 200, 50
CHAR_DISTANCE, WORD_DISTANCE = 0.26, 0.36
CLASSES = ["lower", "upper", "digit", "space", "stop", "symbol", "other"]
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once: inside a lambda a column would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, size: int = 8) -> Column:
    """Words in windows of ``size`` that occur twice or more."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = lambda s: F.filter(F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"]), e["i"])), lambda i: i.isNotNull())
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(size), i - acc["last"])).alias("n"), i.alias("last"))
        start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(placed, lambda s: F.aggregate(F.sort_array(twice(s)), start, step)["n"]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size)))
    return F.when(F.size(words) < size, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), covered)))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__q``: the base counts, the class counts and the common-word counts of each text."""
    text = F.coalesce("text", F.lit(""))
    length = F.length("__text")
    without = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    rest = F.col("__rest")
    df = docs.withColumn("__text", text).withColumn("__rest", F.regexp_replace("__text", r"\p{Ll}+", ""))
    df = df.withColumn("__words", F.array_remove(F.split("__text", SPACE + "+"), ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    known = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    # Common words between double spaces, so that each can be counted by what its removal shortens.
    common = F.concat(F.lit(" "), F.array_join(F.filter(F.transform("__words", lambda w: F.lower(w)), lambda w: w.isin(known)), "  "), F.lit(" "))
    lists = F.create_map(*[x for k, ws in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))])
    bins = F.try_element_at(lists, F.coalesce("lang", F.lit("")))
    counts = let(common, lambda s: F.transform(bins, lambda b: ((F.length(s) - F.length(F.replace(s, F.concat(F.lit(" "), b, F.lit(" ")), F.lit("")))) / (F.length(b) + 2)).cast("double")))
    symbols = F.length(rest) - F.length(F.translate(rest, "#*$%&|<>", ""))
    spaces = F.length(rest) - F.length(F.translate(rest, " \t\n\x0b\x0c\r", ""))
    uppers, digits, stops = without(rest, r"\p{Lu}+"), without(rest, r"\p{Nd}+"), without(rest, r"[.,;:!?'\"()\-]+")
    lowers = length - F.length(rest)
    return df.withColumn(
        "__q",
        F.struct(
            F.size("__words").cast("long").alias("n_words"),
            (length - spaces).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("__words")).cast("long").alias("n_repeat_words"),
            length.alias("n_chars"),
            F.transform(F.array(lowers, uppers, digits, spaces, stops, symbols, F.length(rest) - uppers - digits - spaces - stops - symbols), lambda x: x.cast("double")).alias("classes"),
            counts.alias("common"),
            F.when(F.col("lang").isin(sorted(COMMON_WORDS)), F.col("lang")).alias("language"),
        ),
    ).drop("__text", "__rest", "__words")


def _failed(q: str = "__q") -> Column:
    return (F.col(f"{q}.n_words") < 20) | (100 * F.col(f"{q}.n_repeat_words") > 30 * F.col(f"{q}.n_words"))


def _shares(q: str = "__q") -> tuple[Column, Column]:
    chars = F.transform(f"{q}.classes", lambda x: x / F.greatest(F.col(f"{q}.n_chars"), F.lit(1)))
    common = F.transform(f"{q}.common", lambda x: x / F.greatest(F.col(f"{q}.n_words"), F.lit(1)))
    return chars, F.concat(common, F.array(F.lit(1.0) - F.aggregate(common, F.lit(0.0), lambda a, x: a + x)))


def references(featured: DataFrame) -> DataFrame:
    """(language, chars, words): mean histograms; at most one row for each language with a word list."""
    chars, words = _shares()
    good = featured.where(~_failed() & F.col("__q.language").isNotNull() & (F.col("__q.n_words") >= MIN_WORDS) & (F.col("__q.n_chars") >= MIN_CHARS))
    width = max(map(len, COMMON_WORDS.values())) + 1
    z = good.select(F.col("__q.language").alias("language"), chars.alias("c"), words.alias("w"))
    means = z.groupBy("language").agg(*[F.avg(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))], *[F.avg(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(width)])
    return means.select(F.col("language").alias("__language"), F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("__chars"), F.filter(F.array(*[f"w{i}" for i in range(width)]), lambda x: x.isNotNull()).alias("__common"))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(2 * x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, x + y) + part(y, x + y))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judged(featured: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds base_failed, char_distance, word_distance and kept; the references are a handful of rows and are broadcast."""
    chars, words = _shares()
    df = featured.join(F.broadcast(reference), F.col("__q.language") == F.col("__language"), "left")
    df = df.withColumn("base_failed", _failed())
    df = df.withColumn("char_distance", F.when((F.col("__q.n_chars") >= MIN_CHARS) & F.col("__chars").isNotNull(), divergence(chars, F.col("__chars"))))
    df = df.withColumn("word_distance", F.when((F.col("__q.n_words") >= MIN_WORDS) & F.col("__common").isNotNull(), divergence(words, F.col("__common"))))
    far = (F.coalesce("char_distance", F.lit(0.0)) > CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > WORD_DISTANCE)
    return df.withColumn("kept", ~F.col("base_failed") & ~far).drop("__language", "__chars", "__common")


def report(docs: DataFrame) -> DataFrame:
    featured = materialize(features(docs.select("doc_id", "lang", "text")).select("doc_id", "__q"), "quality")
    counts = [F.col(f"__q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged(featured, references(featured)).select("doc_id", *counts, "base_failed", "kept", "char_distance", "word_distance")


def rules(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows."""
    own = docs.columns
    renamed = docs.select([F.col(c).alias(c if c in ("lang", "text") else f"__in_{i}") for i, c in enumerate(own)])
    # Written with the texts, so that the features are computed once: the optimizer would inline them into the filter and into the references.
    featured = materialize(features(renamed), "quality")
    kept = judged(featured, references(featured)).where("kept")
    return kept.select([F.col(c if c in ("lang", "text") else f"__in_{i}").alias(c) for i, c in enumerate(own)])
