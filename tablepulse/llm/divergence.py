"""Quality by distribution divergence, in DataFrame expressions only.

Every document has two histograms: characters by class, and how often each of a list of
common words occurs (and all other words together).  The references are the sums of these
histograms over all documents of a language.  A document is dropped if the Jensen-Shannon
distance (base 2, from 0 to 1) to the reference of its language is too large for either
histogram.  Short documents and languages with few documents are not judged, as their
histograms are mostly chance.

Base rules (long counts) are computed alongside and drop a document by themselves.

Rows: NULL texts have no words; a NULL language is a language of its own.  Repeated rows are
judged alike.  Columns of the same names as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.llm.storage import landed

SPACE = r"\x20\x09-\x0D"
WORD = rf"([^{SPACE}]+)"
#: Character classes in the order in which they are taken out; what is left is the last class.
CLASSES = {
    "lower": "[a-z]+", "space": rf"[{SPACE}]+", "upper": "[A-Z]+", "digit": "[0-9]+", "point": "[.,;:!?'\"()-]+", "foreign": r"[^\x00-\x7F]+",
}
# Common words of four languages.
COMMON = sorted(set(
    "the of and to in is that it for was der die und den von zu das mit le la les des et en un une du que el los las y por con se".split()
))
MIN_WORDS = 100
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.35


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more, the first included.

    Windows are sorted together with their places; equal neighbours give the places, in whose
    order every window adds the words that the window before it does not cover.
    """
    n = F.size(words)
    rows = F.sort_array(F.arrays_zip(
        F.slice(words, F.lit(1), n - 2).alias("a"), F.slice(words, F.lit(2), n - 2).alias("b"),
        F.slice(words, F.lit(3), n - 2).alias("c"), F.sequence(F.lit(0), n - 3).alias("at"),
    ))
    return F.when(n >= 4, rows)


def _covered(rows: Column) -> Column:
    def same(i: Column, j: Column) -> Column:
        one, other = F.get(rows, i), F.get(rows, j)
        return (one["b"] == other["b"]) & (one["c"] == other["c"]) & (one["a"] == other["a"])

    last = F.size(rows) - 1
    hit = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)))
    places = F.sort_array(F.transform(hit, lambda i: F.get(rows, i)["at"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
    total = F.aggregate(
        places, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["at"])).alias("n"), p.alias("at")), lambda s: s["n"]
    )
    return F.coalesce(total, F.lit(0)).cast("bigint")


def features(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the text, with the base counts and the arrays ``classes`` and ``common``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"]
    rows = docs.drop(*[n for n in names if n not in (text, lang)]).withColumn("__text", F.coalesce(docs[text], F.lit("")))
    rows = rows.drop(text).withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD)))
    rows = rows.withColumn("n_words", F.size("__words").cast("bigint"))
    left, before = F.col("__text"), F.length("__text")
    counts = []
    for number, pattern in enumerate(CLASSES.values()):
        rows = rows.withColumn(f"__left{number}", F.regexp_replace(left, pattern, ""))
        left = F.col(f"__left{number}")
        counts.append(before - F.length(left))
        before = F.length(left)
    rows = rows.withColumn("classes", F.array(*[c.cast("bigint") for c in (*counts, before)]))
    rows = rows.withColumn("word_chars", F.length("__text").cast("bigint") - F.get("classes", F.lit(1)))
    marks = F.regexp_replace("__left5", "[#*$%&|<>]+", "")
    rows = rows.withColumn("n_symbols", (F.length("__left5") - F.length(marks)).cast("bigint"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    rows = rows.withColumn("__lines", lines)
    rows = rows.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
    rows = rows.withColumn("__windows", repeated_words(F.col("__words")))
    rows = rows.withColumn("n_repeat_words", _covered(F.col("__windows")))
    listed = rf"(?<![^{SPACE}])({'|'.join(sorted(COMMON, key=len, reverse=True))})(?![^{SPACE}])"
    found = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("__text"), F.lit(listed)), "  "), F.lit(" "))
    rows = rows.withColumn("__found", found)
    each = [
        ((F.length("__found") - F.length(F.replace("__found", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("bigint") for w in COMMON
    ]
    rows = rows.withColumn("__common", F.array(*each))
    known = F.aggregate("__common", F.lit(0).cast("bigint"), lambda a, b: a + b)
    rows = rows.withColumn("common", F.concat("__common", F.array(F.col("n_words") - known)))
    return rows.select(*[c for c in rows.columns if not c.startswith("__")])


def references(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """Sums of both histograms over all documents of each language."""
    sums = [
        F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(size)]).alias(f"ref_{name}")
        for name, size in (("classes", len(CLASSES) + 1), ("common", len(COMMON) + 1))
    ]
    return measured.groupBy(F.col(lang).alias("ref_lang")).agg(*sums)


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; NULL if either is empty."""
    add = lambda a, b: a + b
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), add).cast("double")

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    l_sum, r_sum = total(left), total(right)
    terms = F.zip_with(left, right, lambda a, b: part(a / l_sum, b / r_sum) + part(b / r_sum, a / l_sum))
    divergence = F.aggregate(terms, F.lit(0.0), add) / 2
    return F.when((l_sum > 0) & (r_sum > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judge(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS,
    max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """``docs`` without the text, with base counts, ``base_failed``, both distances and ``kept``.

    The histograms of all documents are written once, without the texts, and read twice.
    """
    measured = landed(features(docs, text, lang), "histograms")
    known = landed(references(measured, lang), "references")
    rows = measured.join(known, measured[lang].eqNullSafe(known["ref_lang"]), "left")
    rows = rows.withColumn("class_distance", distance(F.col("classes"), F.col("ref_classes")))
    rows = rows.withColumn("word_distance", distance(F.col("common"), F.col("ref_common")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = F.col("n_words") >= min_words
    odd = (F.coalesce("class_distance", F.lit(0.0)) > max_class) | (F.coalesce("word_distance", F.lit(0.0)) > max_word)
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~(judged & odd))
    return rows.drop("classes", "common", "ref_lang", "ref_classes", "ref_common")
