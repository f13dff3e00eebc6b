"""Quality rules by divergence from language references.

A document's histogram of character classes and its histogram of common words are
compared with those of its language over the whole corpus, by Jensen-Shannon
divergence.  Which words are common is learned: each language's most frequent ones by
documents.  They fall into a fixed number of bins by a hash of their letters, with a
last bin for all other words, so all languages share one layout and a row's histogram
has one size whatever the number of languages.

A sample of n words differs from its own source by about (bins - 1) / (8 n ln 2), where
bins are those that the source fills.  This expectation, with a margin, is granted to
each document, so one measure and one limit hold at every length over the minimum.  Only DataFrame functions run here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch

#: Frequent words learned for a language; bins of their hash.
COMMON_PER_LANG, WORD_BINS = 50, 60
#: Bytes of a language's reference, about; references that a row is compared with in one pass.
REFERENCE_BYTES, REFERENCES_AT_ONCE = 640, 4096
#: A bin with a smaller part of a reference's words counts as empty where chance is estimated.
FILLED = 0.001
SYMBOLS = "#*$%&|<>"
WORD_SPLIT = r"[ \x09-\x0D]+"
#: Character classes of their histogram: white space, upper case, digits, stops, symbols, the rest.
N_CLASSES, N_COMMON = 6, WORD_BINS + 1
#: The bins' marks: one character each, from here on.
_FIRST_MARK = 48


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def words_in(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SPLIT), "")


def _covered(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Most texts have no such window, which the distinct hashes tell at once.  Elsewhere a
    window's hash gives up its low bits to the window's place, so one sort of plain
    numbers brings equals together in order of place.  Neighbours that agree are
    checked on the whole hash; each place covers three words, less what the next
    covers.
    """
    # The mask has as many bits as places need; 64 less that many are left to the hash.
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size(words) + 1)).cast("int")) - 1

    n = F.size(words)
    runs = F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))
    windows = F.transform(F.slice(runs, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w: F.xxhash64(w))

    def found(win: Column, m: Column) -> Column:
        order = F.sort_array(F.transform(win, lambda w, i: w.bitwiseOR(m).bitwiseXOR(m).bitwiseOR(i.cast("long"))))

        def pairs(s: Column) -> Column:
            near = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a.bitwiseXOR(b) <= m, F.when(a.bitwiseXOR(b) >= 0, F.call_function("shiftleft", a.bitwiseAND(m), F.lit(32)).bitwiseOR(b.bitwiseAND(m)))))
            return F.filter(F.array_compact(near), lambda p: F.get(win, _high(p)) == F.get(win, _low(p)))

        return _let(order, lambda s: _let(pairs(s), width))

    def width(p: Column) -> Column:
        places = F.sort_array(F.array_distinct(F.concat(F.transform(p, _high), F.transform(p, _low))))
        step = lambda q: F.zip_with(q, F.slice(q, 2, F.size(q)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(_let(places, lambda q: F.aggregate(step(q), F.lit(0).cast("long"), lambda n, x: n + x)))

    def repeated(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(_let(mask, lambda m: found(win, m)))

    return _let(windows, repeated)


def _high(pair: Column) -> Column:
    return F.shiftright(pair, 32).cast("int")


def _low(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int")


def bin_of(word: Column) -> Column:
    """A common word's bin: from its first and last character and its length."""
    return (F.ascii(word) * 7 + F.ascii(F.substring(word, -1, 1)) * 13 + F.length(word) * 17) % WORD_BINS


def word_counts(df: DataFrame, common: list[str], text: str = "_text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    ``classes`` (characters by class) and ``common`` (the common words by bin, then all
    other words)."""
    t = F.col(text)
    df = df.withColumn("_words", words_in(t))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^ \x09-\x0D]"))))
    mark = lambda w: F.char((bin_of(w) + _FIRST_MARK).cast("long"))
    known = F.filter("_words", lambda w: w.isin(common)) if common else F.array().cast("array<string>")
    df = df.withColumn("_marks", F.array_join(F.transform(known, mark), ""))
    rare = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    n = F.size("_words").cast("long")
    df = df.select(
        *[c for c in df.columns if not c.startswith("_") or c.startswith("_k")],
        n.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(t).cast("long").alias("_chars"),
        rare(f"[{SYMBOLS}]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_words")).alias("n_repeat_words"),
        rare(r"\p{Lu}").alias("_upper"),
        rare("[0-9]").alias("_digit"),
        rare(r"""[.,;:!?'"()-]""").alias("_stop"),
        F.length("_marks").cast("long").alias("_known"),
        F.col("_marks"),
    )
    # Bin by bin: what a mark's removal takes from the string is its count.
    counts = [(F.col("_known") - F.length(F.replace("_marks", F.lit(chr(_FIRST_MARK + i)), F.lit("")))).cast("long") for i in range(WORD_BINS)]
    space = F.col("_chars") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("_stop") - F.col("n_symbols")
    df = df.withColumn("classes", F.array(space, F.col("_upper"), F.col("_digit"), F.col("_stop"), F.col("n_symbols"), rest))
    return df.withColumn("common", F.array(*counts, F.col("n_words") - F.col("_known"))).drop("_chars", "_upper", "_digit", "_stop", "_known", "_marks")


def common_words(rows: DataFrame, key: Column | None = None, per_lang: int = COMMON_PER_LANG) -> list[str]:
    """The words that most documents of a language hold, of all languages together.

    ``rows``: tongue and _text.  They are learned from all labelled rows; ties go to the
    smaller word.  ``key`` has no part in it.  At most ``per_lang`` words a language reach
    the driver.
    """
    labelled = rows.where("tongue <> ''")
    held = labelled.select("tongue", F.explode(F.array_distinct(words_in(F.col("_text")))).alias("word")).groupBy("tongue", "word").agg(F.count("*").alias("n"))
    # Heads of hash parts first: no task sorts a whole language.
    part = Window.partitionBy("tongue", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(F.desc("n"), "word")
    whole = Window.partitionBy("tongue").orderBy(F.desc("n"), "word")
    head = held.where("n > 1").withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= per_lang)
    top = head.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= per_lang)
    return sorted(r["word"] for r in top.select("word").distinct().collect())


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence (base 2) of two histograms of counts; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    half = lambda a, m: F.when(a > 0, 0.5 * a * F.log2(a / m)).otherwise(F.lit(0.0))

    def term(a: Column, b: Column) -> Column:
        return _let((a + b) / 2, lambda m: half(a, m) + half(b, m))

    def of(ps: Column) -> Column:
        return F.when((ps["p"] > 0) & (ps["q"] > 0), F.greatest(F.lit(0.0), total(F.zip_with(p, q, lambda a, b: term(a / ps["p"], b / ps["q"])))))

    return _let(F.struct(total(p).alias("p"), total(q).alias("q")), of)


def expected(reference: Column, margin: float, n: Column) -> Column:
    """What a sample of n differs from its source, and ``margin`` standard deviations more."""
    total = F.aggregate(reference, F.lit(0.0), lambda s, x: s + x)
    free = _let(total, lambda t: F.greatest(F.size(F.filter(reference, lambda x: x >= FILLED * t)) - 1, F.lit(0)))
    return _let(free, lambda f: (f + margin * F.sqrt(2.0 * f)) / (8 * math.log(2) * n))


def _references(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tongue, ref_classes, ref_common) of each language, and the same of all documents under the language ''."""

    def summed(a: str, n: int) -> list[Column]:
        return [F.coalesce(F.sum(F.col(a)[i].cast("double")), F.lit(0.0)).alias(f"{a}_{i}") for i in range(n)]

    sums = [*summed("classes", N_CLASSES), *summed("common", N_COMMON)]
    arrays = [F.array(*[F.col(f"{a}_{i}") for i in range(n)]).alias(f"ref_{a}") for a, n in (("classes", N_CLASSES), ("common", N_COMMON))]
    by = good.where("tongue <> ''").groupBy("tongue").agg(*sums).select("tongue", *arrays)
    return by, good.agg(*sums).select(F.lit("").alias("tongue"), *arrays)


def _compared(counted: DataFrame, good: DataFrame, margin: float, scratch: Scratch) -> DataFrame:
    """``counted`` with both divergences from the references that ``good`` gives, and
    ``chance``: what of the words' divergence the length accounts for."""
    by, pooled = map(scratch.cut, _references(good))
    n = by.count()
    if not n:
        by, n = pooled, 1
    own = F.struct(F.lit(0.0).alias("d"), F.lit("").alias("tongue"), "ref_classes", "ref_common")
    met = counted.join(F.broadcast(by) if n * REFERENCE_BYTES <= BROADCAST_BYTES else by, "tongue", "left").withColumn("_own", F.col("ref_common").isNotNull())
    met = met.withColumn("_ref", F.when(F.col("_own"), own)).select(*counted.columns, "_own", "_ref")
    parts = -(-n // REFERENCES_AT_ONCE)
    for i in range(parts):
        if i:
            met = scratch.cut(met)
        # One row of about REFERENCES_AT_ONCE references, whatever the input.
        some = by.where(F.pmod(F.xxhash64("tongue"), F.lit(parts)) == i).agg(F.collect_list(F.struct("tongue", "ref_classes", "ref_common")).alias("_refs"))
        found = F.array_min(F.transform("_refs", lambda r: F.struct(divergence(F.col("common"), r["ref_common"]).alias("d"), r["tongue"].alias("tongue"), r["ref_classes"].alias("ref_classes"), r["ref_common"].alias("ref_common"))))
        met = met.crossJoin(F.broadcast(some)).withColumn("_ref", F.when(F.col("_own"), F.col("_ref")).otherwise(F.least("_ref", found))).drop("_refs")
    return met.select(*counted.columns, divergence(F.col("classes"), F.col("_ref.ref_classes")).alias("class_divergence"), divergence(F.col("common"), F.col("_ref.ref_common")).alias("word_divergence"), F.when(F.col("n_words") > 0, expected(F.col("_ref.ref_common"), margin, F.col("n_words"))).otherwise(F.lit(0.0)).alias("chance"))


def judge(
    docs: DataFrame,
    *,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    lang: str = "lang",
    min_words: int = 50,
    max_repeat: float = 0.5,
    max_distance: float = 0.25,
    margin: float = 0.0,
    common: list[str] | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``keep`` with the counts of ``word_counts``, ``base_failed``, ``class_divergence``,
    ``word_divergence``, ``chance`` and ``kept``.

    Base rules: under ``min_words`` words, or over ``max_repeat`` of the words in
    repeated windows.  The common words are ``common``, or learned (``common_words``).
    References are sums over all documents that pass the base rules, by language, and
    then once more over those that are within the limits of the first references, so
    that what is to be rejected doesn't shape them.  Documents of null languages and of
    such as have no passing document use the reference whose word histogram is nearest
    to theirs, and the sum over all only where no language has a reference.

    ``kept``: no base rule failed, and the classes' divergence together with what the
    words' is beyond ``chance`` (that of the document's length, with ``margin`` standard
    deviations) is at most ``max_distance`` squared.  Under ``min_words`` words the base rule decides alone.
    Without any reference nothing is judged by divergence.

    A null or empty text has no words.  Repeated rows stay; an empty table gives none.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, names)], F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("tongue"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if common is None:
        common = common_words(rows.select("tongue", "_text"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    counted = scratch.cut(word_counts(rows, common).withColumn("base_failed", failed))
    beyond = F.greatest(F.coalesce(F.col("word_divergence") - F.col("chance"), F.lit(0.0)), F.lit(0.0))
    near = F.coalesce("class_divergence", F.lit(0.0)) + beyond <= max_distance**2
    bins = counted.select("tongue", "n_words", "classes", "common", "base_failed")
    good = _compared(bins.where("not base_failed"), bins.where("not base_failed"), margin, scratch).where(near)
    met = _compared(counted, good, margin, scratch)
    return met.select(
        *[F.col(a).alias(c) for c, a in zip(keep, names)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_divergence", "word_divergence", "chance", (~F.col("base_failed") & near).alias("kept")
    )
