"""Quality rules: divergence of a document's histograms from those of its language.

Two histograms are made of each whole text: how its code points spread over character classes, and
how its words spread over the common words of all languages (plus one bin for all others). Each is
compared with the reference of the document's language, made of all documents of that language that
pass the base rules, by the Jensen-Shannon distance (base 2, between 0 and 1). Shorter texts than ``min_judged_words`` have histograms too coarse to judge and are exempt.

``judge`` makes references of the shares of each document, each distinct text once, so that neither
long texts nor copies weigh more than others. Its limits are those of the language: the median
distance of its distinct texts plus a multiple of their spread (the median absolute deviation), both
after an allowance for short texts. Languages with few texts have fixed limits.

Everything is a column expression. Windows of eight words are compared inside their row, by sorting,
so a long or very repetitive text costs n log n. They are compared by 64-bit hashes. Nothing that a
lambda refers to is computed inside it: it would be computed again for each element.

Defined results: a null or empty text has no words and fails the base rules; a null language is a
language of its own; repeated rows are judged alike; an empty table gives an empty result. Other
columns are not read. A language without any document that passes the base rules has no reference,
and then none of its documents is left to judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitframe.llm.common import SPACE, staged, text_of
from remitframe.session import checked_join

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Texts with fewer words are not compared with a reference.
MIN_JUDGED_WORDS = 40
MAX_CLASS_DISTANCE = 0.28
# The word histogram of a short text is coarse: the limit is this plus the second over the square
# root of the number of words.
MAX_WORD_DISTANCE = 0.2
SHORT_TEXT_ALLOWANCE = 1.2

# Limits of a language are its median distance plus so many spreads. Histograms of short texts are
# coarse: both distances are counted less an allowance over the square root of the number of words.
CLASS_SPREADS = 10
WORD_SPREADS = 6
SHORT_CLASS_ALLOWANCE = 0.6
# A language of nearly equal texts has almost no spread.
LEAST_SPREAD = 0.005
# With fewer distinct texts than this a spread says nothing, and the fixed limits hold.
MIN_TEXTS = 30
# References are sums of whole parts of this, and so the same in any order of summing.
_PARTS = 100_000_000
# Distances are rounded to this many decimals for medians, which bounds what an aggregate holds.
_DECIMALS = 4

# Common words of the languages that are told apart.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "that",
    "der", "die", "und", "den", "von", "mit",
    "le", "la", "les", "des", "et", "que",
    "el", "los", "las", "en", "por", "con",
)
# Each class takes what white space and the classes before it have left; the last bin is the rest.
CHAR_CLASSES = ("[a-z]+", r"[.,;:!?'\x22()\-]+", "[A-Z]+", "[0-9]+", r"\p{L}+")


def _removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _paired(hashes: Column, step: int) -> Column:
    """Hashes of twice as many words: each with the one ``step`` places on."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(
        F.size(hashes) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _repeated_places(placed: Column) -> Column:
    """Places of the windows whose hash is not unique, ascending; ``placed`` is sorted by hash.

    ``placed`` has to be a plain column: a lambda would compute anything else for each element.
    """
    def same(a, b):
        return F.coalesce(F.get(placed, a)["h"] == F.get(placed, b)["h"], F.lit(False))
    at = F.sequence(F.lit(0), F.size(placed) - 1)
    return F.array_sort(F.transform(F.filter(at, lambda k: same(k, k - 1) | same(k, k + 1)),
                                    lambda k: F.get(placed, k)["i"]))


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", carried: Column | None = None,
                  hashed: bool = False) -> DataFrame:
    """Base columns and the two histograms, one row per document, and ``carried`` as it is.

    With ``hashed``, also ``text_hash``, which tells distinct texts apart.
    """
    text = text_of(text_col)
    carried = F.lit(None).cast("boolean") if carried is None else carried
    df = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                     text.alias("text"), carried.alias("carried"))
    hashes = ["text_hash"] if hashed else []
    if hashed:
        df = df.withColumn("text_hash", F.xxhash64("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", SPACE + "+", -1), ""))
    # Hashes of one, two, four and eight words; those that run past the end are cut off.
    df = df.withColumn("hash1", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("hash2", _paired(F.col("hash1"), 1))
    df = df.withColumn("hash4", _paired(F.col("hash2"), 2))
    df = df.withColumn("windows", F.when(F.size("words") > WINDOW, F.slice(
        _paired(F.col("hash4"), 4), 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    both_cases = (*COMMON_WORDS, *(w.capitalize() for w in COMMON_WORDS))
    df = df.withColumn("lines", lines).withColumn("common", F.transform(
        F.filter("words", lambda w: w.isin(*both_cases)), lambda w: F.lower(w)))
    # What is left of the text after each class, as lengths.
    df = df.withColumn("in_words", _removed(F.col("text"), SPACE + "+"))
    left, sizes = F.col("in_words"), []
    for k, pattern in enumerate(CHAR_CLASSES):
        df = df.withColumn(f"left{k}", _removed(left, pattern))
        sizes.append(F.length(left) - F.length(f"left{k}"))
        left = F.col(f"left{k}")
    sizes.append(F.length(left))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("placed", F.when(repeats, F.array_sort(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("repeated", _repeated_places(F.col("placed")))
    counts = [F.size("common") - F.size(F.array_remove("common", w)) for w in COMMON_WORDS]
    n_words = F.size("words")
    # A repeated window adds the words up to the next one, at most its own eight.
    covered = F.aggregate(
        F.transform("repeated", lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get("repeated", k + 1), p + WINDOW) - p)),
        F.lit(0), lambda a, b: a + b)
    return df.select(
        "id", "lang", "carried", n_words.cast("long").alias("n_words"),
        F.length("in_words").cast("long").alias("word_chars"),
        # The symbols are among what the letters leave.
        (F.length("left0") - F.length(_removed(F.col("left0"), r"[#*$%&|<>]+"))).cast(
            "long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*[s.cast("long") for s in sizes]).alias("class_counts"),
        F.array(*[c.cast("long") for c in counts],
                (n_words - F.size("common")).cast("long")).alias("word_counts"), *hashes,
    ).select(
        *hashes, "id", "lang", "carried", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS)
         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias(
            "base_failed"), "class_counts", "word_counts")


def jensen_shannon(p_counts: Column, q_counts: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of equal length, base 2; null if one is empty."""
    def total(a):
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y).cast("double")
    p_sum, q_sum = total(p_counts), total(q_counts)

    def term(p, q):
        p, q = p / p_sum, q / q_sum
        m = (p + q) / 2
        return (F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
                + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)) / 2
    divergence = F.aggregate(F.zip_with(p_counts, q_counts, term), F.lit(0.0), lambda x, y: x + y)
    return F.when((p_sum > 0) & (q_sum > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def share_references(texts: DataFrame) -> DataFrame:
    """Mean shares of the texts of each language, as whole parts; ``texts`` has each text once."""
    def sums(column, n):
        counts = F.col(column)
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y)
        return F.array(*[F.sum(F.when(total > 0, F.floor(
            F.get(counts, F.lit(k)) * F.lit(_PARTS) / total)).otherwise(0).cast("long"))
            for k in range(n)]).alias(f"ref_{column}")
    return texts.groupBy("lang").agg(
        sums("class_counts", len(CHAR_CLASSES) + 1), sums("word_counts", len(COMMON_WORDS) + 1))


def _scored(rows: DataFrame, references: DataFrame) -> DataFrame:
    """``rows`` with both distances to the reference of their language."""
    joined = checked_join(rows, references, rows["lang"].eqNullSafe(references["ref_lang"]), "left")
    return joined.withColumn(
        "class_distance", jensen_shannon(F.col("class_counts"), F.col("ref_class_counts"))
    ).withColumn("word_distance", jensen_shannon(F.col("word_counts"), F.col("ref_word_counts")))


def _excess() -> dict[str, Column]:
    """Both distances less what a text of its length may have."""
    root = F.sqrt(F.col("n_words"))
    return {"class": F.col("class_distance") - SHORT_CLASS_ALLOWANCE / root,
            "word": F.col("word_distance") - SHORT_TEXT_ALLOWANCE / root}


def language_limits(scored: DataFrame) -> DataFrame:
    """Limits of the excess of each language; ``scored`` has each judged text once."""
    excess = staged(scored.select("lang", *[
        F.round(c, _DECIMALS).alias(n) for n, c in _excess().items()]), "excess")
    middle = staged(excess.groupBy(F.col("lang").alias("mid_lang")).agg(
        F.count(F.lit(1)).alias("texts"), F.percentile("class", F.lit(0.5)).alias("mid_class"),
        F.percentile("word", F.lit(0.5)).alias("mid_word")), "medians")
    apart = checked_join(excess, middle, excess["lang"].eqNullSafe(middle["mid_lang"]), "inner")

    def limit(name, spreads, fixed):
        spread = F.percentile(F.round(F.abs(F.col(name) - F.col(f"mid_{name}")), _DECIMALS),
                              F.lit(0.5))
        return F.when(F.max("texts") < MIN_TEXTS, F.lit(fixed)).otherwise(
            F.max(f"mid_{name}") + spreads * F.greatest(spread, F.lit(LEAST_SPREAD))).alias(
            f"{name}_limit")
    return apart.groupBy(F.col("lang").alias("limit_lang")).agg(
        F.max("texts").alias("texts"),
        limit("class", CLASS_SPREADS, MAX_CLASS_DISTANCE), limit("word", WORD_SPREADS,
                                                                 MAX_WORD_DISTANCE))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          references: DataFrame | None = None, min_judged_words: int = MIN_JUDGED_WORDS,
          carried: Column | None = None) -> DataFrame:
    """Features, both distances and ``kept``, one row per document, by the limits of its language.

    ``references`` (as ``share_references`` makes them) may come from another corpus; otherwise all
    documents given here make them. ``carried`` is handed through.
    """
    features = staged(text_features(docs, id_col, text_col, lang_col, carried, hashed=True),
                      "quality")
    # Copies have equal counts, so grouping by all of them leaves one row a text.
    texts = staged(features.where(~F.col("base_failed")).select(
        "lang", "text_hash", "n_words", "class_counts", "word_counts").distinct(), "texts")
    references = share_references(texts) if references is None else references
    references = staged(references, "references").withColumnRenamed("lang", "ref_lang")
    limits = staged(language_limits(
        _scored(texts.where(F.col("n_words") >= min_judged_words), references)), "limits")
    scored = _scored(features, references)
    scored = checked_join(scored, limits, scored["lang"].eqNullSafe(limits["limit_lang"]), "left")
    excess, few = _excess(), F.col("texts") < MIN_TEXTS
    # The fixed limit of the classes has no allowance.
    far = (F.coalesce(F.when(few, F.col("class_distance")).otherwise(excess["class"])
                      > F.col("class_limit"), F.lit(False))
           | F.coalesce(excess["word"] > F.col("word_limit"), F.lit(False)))
    return scored.withColumn("kept", ~F.col("base_failed") & ~(
        (F.col("n_words") >= min_judged_words) & far)).drop(
        "ref_lang", "ref_class_counts", "ref_word_counts", "limit_lang", "texts", "class_limit",
        "word_limit", "text_hash")
