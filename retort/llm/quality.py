"""Quality rules by distribution divergence, in SQL expressions only.

A text's character classes and common words are counted and held against the reference of its language with
the Jensen-Shannon distance (base 2, so 0 to 1). The references are the counts over all documents of the language.
The largest distances allowed come from the distances of all documents of the language, by length.
Short texts have noisy histograms, so below a number of words only the base rules decide.

The texts are read once: counts of every row are written out, and the references, the limits and the verdicts come from those.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.session import cut_lineage

# Frequent function words of the languages that have a reference.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with"),
    "fr": ("de", "la", "le", "et", "les", "des", "un", "une", "du", "en", "que", "est"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "des", "auf"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"),
}
# Character classes as Java character sets; letters and marks that are in none make the last class.
CLASSES = {"upper": "A-Z", "digit": "0-9", "symbol": "#*$%&|<>", "punct": r".,;:!?'\"()\-"}

#: Blanks other than the space.
BLANKS = "\t\n\x0b\x0c\r"
WINDOW = 8
#: Fewer words than this: no verdict from histograms.
MIN_WORDS = 40
#: Largest distance of the character classes, and of the common words, from the language's reference, whatever the others are.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.45
#: A distance may lie so many deviations over the median of its language and length. The deviation is that of the lower
#: half, which junk doesn't move, and at least NOISE / sqrt(words), the noise of a histogram of so many words.
CLASS_DEVIATIONS, WORD_DEVIATIONS, NOISE = 6.0, 4.5, 0.3
#: Fewer different documents of a language and length (in powers of two of words): the limits are those of the next shorter.
LEAST_DOCUMENTS = 30
#: Distances, and word distances times sqrt(words), are counted in steps of one over these.
CLASS_STEPS, WORD_STEPS = 1000.0, 100.0
_LENGTHS = 40

#: What is counted of each row.
COUNTED = ("n_words", "word_chars", "dup_lines", "repeat", *CLASSES, "classes", "common")
_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})


def _let(value: Column, body) -> Column:
    """Binds an expression to a name for the body, so that it is worked out once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than space and U+0009 to U+000D.

    The text is cut at a literal space: cutting at a character class takes several times as long, and slows the other patterns.
    """
    spaced = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def _pairwise(values: Column, apart: int) -> Column:
    """Hashes of values[i] with values[i + apart], which is null beyond the end."""
    return F.transform(values, lambda x, i: F.xxhash64(x, F.get(values, i + apart)))


def _distinct(hashes: Column) -> Column:
    return F.size(F.array_distinct(hashes)) == F.size(hashes)


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur at least twice, the first occurrence included.

    Windows of half that length are looked at first: most texts have none twice.
    """
    half = WINDOW // 2

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            marked = F.transform(
                rows,
                lambda r, k: F.when(
                    ((k > 0) & (F.get(rows, k - 1)["h"] == r["h"])) | ((k < F.size(rows) - 1) & (F.get(rows, k + 1)["h"] == r["h"])),
                    r["i"],
                ),
            )
            starts = F.sort_array(F.array_compact(marked))
            sums = F.aggregate(
                starts,
                F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
            )
            return sums["n"]

        return F.when(_distinct(windows), F.lit(0)).otherwise(_let(ordered, twice))

    def starting(hashes: Column, words_each: int) -> Column:
        return F.slice(hashes, F.lit(1), F.greatest(F.size(words) - (words_each - 1), F.lit(0)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    halves = _let(hashed, lambda h: _let(_pairwise(h, 1), lambda p: _pairwise(p, 2)))
    return _let(halves, lambda h: F.when(_distinct(starting(h, half)), F.lit(0)).otherwise(_let(starting(_pairwise(h, half), WINDOW), covered))).cast("long")


def _count_class(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _once(frame: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is worked out once, however often it is used.

    The optimizer copies a projected expression into each of its uses; it doesn't see through a generator.
    """
    return frame.select("*", F.explode(F.array(value)).alias(name))


def features(docs: DataFrame) -> DataFrame:
    """Adds the struct ``f``: base counts, character-class histogram and common-word histogram of ``text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = _once(docs, words_of(F.col("text").cast("string")), "f_words")
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(" " + BLANKS)) != "")
    hits = F.filter("f_words", lambda w: w.isin(_WORDS))
    fields = {
        "n_words": F.size("f_words").cast("long"),
        "word_chars": F.length(F.array_join("f_words", "")).cast("long"),
        "hits": F.concat(F.lit(" "), F.array_join(hits, "  "), F.lit(" ")),
        "dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "repeat": repeated_words(F.col("f_words")),
    } | {name: _count_class(text, chars) for name, chars in CLASSES.items()}
    base = _once(split, F.struct(*[c.alias(n) for n, c in fields.items()]), "f_base").drop("f_words")
    length = F.length(F.col("f_base.hits"))
    counted = F.array(*[((length - F.length(F.replace("f_base.hits", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("double") for w in _WORDS])
    classes = [F.col(f"f_base.{c}").cast("double") for c in CLASSES]
    other = F.greatest(F.col("f_base.word_chars").cast("double") - sum(classes[1:], classes[0]), F.lit(0.0))
    kept = [F.col(f"f_base.{n}").alias(n) for n in COUNTED if n in fields]
    return _once(base, F.struct(*kept, F.array(*classes, other).alias("classes"), counted.alias("common")), "f").drop("f_base")


def _with_rest(common: Column, total: Column) -> Column:
    """The common-word histogram with a last bin for all other words."""
    return F.concat(common, F.array(F.greatest(total.cast("double") - F.aggregate(common, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))


def language_references(counted: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each language of COMMON_WORDS with any text: (character-class shares, common-word shares) over all its documents.

    One aggregation with a partial sum in each task; at most one row a language reaches the driver.
    """
    n_classes, n_common = len(CLASSES) + 1, len(_WORDS)
    sums = [F.sum(F.col("f_classes")[i]).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.col("f_common")[i]).alias(f"w{i}") for i in range(n_common)]
    found = {}
    for row in counted.where(F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(F.sum("f_n_words").alias("n"), *sums).collect():
        classes = [row[f"c{i}"] for i in range(n_classes)]
        common = [row[f"w{i}"] for i in range(n_common)]
        common.append(max(0.0, row["n"] - sum(common)))
        if row["n"]:
            found[row["lang"]] = ([x / sum(classes) for x in classes], [x / sum(common) for x in common])
    return found


def jensen_shannon(counts: Column, reference: list[float]) -> Column:
    """Distance (0 to 1) of a histogram's shares from reference shares; null for an empty histogram."""

    def distance(total: Column) -> Column:
        def part(p: Column, q: Column) -> Column:
            m = (p + q) / 2
            return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

        terms = F.zip_with(F.transform(counts, lambda x: x / total), F.array(*[F.lit(float(q)) for q in reference]), part)
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))

    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return _let(total, lambda t: F.when(t > 0, distance(t)))


def _nearest(counts: str, references: dict[str, tuple[list[float], list[float]]], which: int) -> Column:
    """Distance from the reference of the row's language, or from the nearest of all if it has none."""
    by_lang = {lang: jensen_shannon(F.col(counts), r[which]) for lang, r in references.items()}
    if not by_lang:
        return F.lit(None).cast("double")
    least = F.array_min(F.array(*by_lang.values()))
    out = None
    for lang, d in by_lang.items():
        out = F.when(F.col("lang") == lang, d) if out is None else out.when(F.col("lang") == lang, d)
    return F.round(out.otherwise(least), 6)


def _length(n_words: Column) -> Column:
    """The power of two that a number of words has reached."""
    return F.length(F.bin(F.greatest(n_words, F.lit(1)))) - 1


def _spread(counts: dict[int, int], steps: float) -> tuple[float, float, int]:
    """(median, deviation of the lower half, number) of values counted in whole steps; the deviation is that of a normal curve."""
    total, seen, quarter = sum(counts.values()), 0, None
    for step in sorted(counts):
        seen += counts[step]
        if quarter is None and 4 * seen >= total:
            quarter = step / steps
        if 2 * seen >= total:
            return step / steps, (step / steps - quarter) / 0.6745, total
    return 0.0, 0.0, 0


def distance_limits(judged: DataFrame, references: dict[str, tuple[list[float], list[float]]]) -> dict[str, list[tuple[float, float, float, float, float]]]:
    """For each language with a reference, and "" for all others: limits by power of two of words.

    (class median, class deviations allowed, those of noise times sqrt(words), word limit times sqrt(words), most words to divide by).
    Word distances fall as 1 / sqrt(words), so they are compared times that. Documents that are equal in length and distances
    count once, so copies don't narrow the limits. Histograms of rounded distances reach the driver: languages with a
    reference, lengths and steps of 0.01 or 0.001, however many documents there are.
    """
    if not references:
        return {}
    group = F.when(F.col("lang").isin(list(references)), F.col("lang")).otherwise("").alias("lang")
    n_words = F.col("f_n_words")
    far = judged.where(n_words >= MIN_WORDS).select(group, n_words.alias("n_words"), F.col("f_far.c").alias("c"), F.col("f_far.w").alias("w")).distinct()
    values = F.array(
        F.struct(F.lit(0).alias("which"), F.floor(F.col("c") * CLASS_STEPS + 0.5).alias("value")),
        F.struct(F.lit(1).alias("which"), F.floor(F.col("w") * F.sqrt("n_words") * WORD_STEPS + 0.5).alias("value")),
    )
    rows = far.select("lang", _length(F.col("n_words")).alias("length"), F.inline(values)).where("value is not null").groupBy("lang", "length", "which", "value").count().collect()
    counts: dict[tuple, dict[int, int]] = defaultdict(dict)
    for r in rows:
        counts[r["lang"], r["length"], r["which"]][r["value"]] = r["count"]
    out = {}
    for lang in [*references, ""]:
        limit, limits = (MAX_CLASS_DISTANCE, 0.0, 0.0, MAX_WORD_DISTANCE, 1.0), []
        for length in range(_LENGTHS):
            c, w = _spread(counts[lang, length, 0], CLASS_STEPS), _spread(counts[lang, length, 1], WORD_STEPS)
            if min(c[2], w[2]) >= LEAST_DOCUMENTS:
                limit = (c[0], CLASS_DEVIATIONS * c[1], CLASS_DEVIATIONS * NOISE, w[0] + WORD_DEVIATIONS * max(w[1], NOISE), 2.0 ** (length + 1))
            limits.append(limit)
        out[lang] = limits
    return out


def _allowed(limits: dict[str, list[tuple[float, float, float, float, float]]], n_words: Column) -> tuple[Column, Column]:
    """The largest class and word distances of a row."""
    length = _length(n_words)

    def pick(k: int) -> Column:
        out = None
        for lang, by_length in limits.items():
            value = F.get(F.array(*[F.lit(float(x[k])) for x in by_length]), length)
            if lang:
                out = F.when(F.col("lang") == lang, value) if out is None else out.when(F.col("lang") == lang, value)
            else:
                out = out.otherwise(value)
        return out

    words = n_words.cast("double")
    return (
        F.least(pick(0) + F.greatest(pick(1), pick(2) / F.sqrt(words)), F.lit(MAX_CLASS_DISTANCE)),
        F.least(pick(3) / F.sqrt(F.least(words, pick(4))), F.lit(MAX_WORD_DISTANCE)),
    )


def quality(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance) of every row.

    ``docs`` has doc_id, text and lang; null text counts as empty, so it has no words and fails the base rules.
    A null or other lang is held against the nearest of all references. Distances are rounded to six places and null
    where there is no reference or nothing to count, which rejects nothing. Rows that repeat are judged alike.
    The limits are those of ``distance_limits``. ``carry`` names columns to return as well, packed into one struct
    ``row``, so their names may be any.
    """
    packed = ["row"] if carry else []
    docs = docs.select("doc_id", "text", "lang", *([F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []))
    counted = cut_lineage(features(docs).select("doc_id", "lang", *[F.col(f"f.{n}").alias(f"f_{n}") for n in COUNTED], *packed))
    references = language_references(counted)
    whole = _once(counted, _with_rest(F.col("f_common"), F.col("f_n_words")), "f_all")
    judged = _once(whole, F.struct(_nearest("f_classes", references, 0).alias("c"), _nearest("f_all", references, 1).alias("w")), "f_far").drop("f_all")
    limits = distance_limits(judged.drop(*packed), references)
    failed = (F.col("f_n_words") < 20) | (100 * F.col("f_repeat") > 30 * F.col("f_n_words"))
    most_c, most_w = _allowed(limits, F.col("f_n_words")) if limits else (F.lit(MAX_CLASS_DISTANCE), F.lit(MAX_WORD_DISTANCE))
    odd = (F.col("f_n_words") >= MIN_WORDS) & ((F.coalesce("f_far.c", F.lit(0.0)) > most_c) | (F.coalesce("f_far.w", F.lit(0.0)) > most_w))
    return judged.select(
        "doc_id",
        F.col("f_n_words").alias("n_words"),
        F.col("f_word_chars").alias("word_chars"),
        F.col("f_symbol").alias("n_symbols"),
        F.col("f_dup_lines").alias("n_dup_lines"),
        F.col("f_repeat").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ~odd).alias("kept"),
        F.col("f_far.c").alias("class_distance"),
        F.col("f_far.w").alias("word_distance"),
        *packed,
    )
