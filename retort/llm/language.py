"""Language identification in two steps: the family first, then one-versus-one support vector machines within it.

Features are shares of hashed byte trigrams of the lower-cased text with digits and punctuation read as spaces, so
scoring a text is a sum of table entries over its bytes. Models are linear machines trained with the hinge loss on a
bounded sample of labelled documents; all other figures come from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.textbatch import Slice, map_batches, mix, text_slices

#: Bound of the training sample: so many documents of each of so many languages, those of the least id hashes.
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 300, 64
BINS = 1 << 14
EPOCHS, REGULAR = 12, 2e-4
UNDETERMINED = "und"
#: A text is no text of its language if its trigrams are so many deviations less usual than those of the sample.
REJECT_DEVIATIONS = 6.0
#: And so large a share of it is in no such language: 0 is the median of the language's own sample, 1 that of the other languages'.
FOREIGN_SHARE = 0.25
#: Parts the sample is dealt into: each is held against the trigrams of the others.
HELD_PARTS = 5
#: Fewer sample documents of a language: nothing is rejected as not of it. Most trigrams by which noise is taken to fall.
LEAST_CALIBRATED, STEADY_TRIGRAMS = 20, 4000

# Families of related languages; a code that is in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
}
_family_of = {code: family for family, codes in FAMILIES.items() for code in codes}

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_fold[:65] = 32
_fold[91:97] = 32
_fold[123:128] = 32

# All 2**24 trigrams hash to BINS without a table: three small ones, of the bytes as folded, are mixed.
_parts = [(mix(np.arange(256, dtype=np.uint64) + np.uint64(salt)) >> np.uint64(50)).astype(np.int64)[_fold] for salt in (7, 1007, 2007)]


def family(code: str) -> str:
    return _family_of.get(code.split("-")[0].lower(), f"only:{code}")


def trigram_bins(data: np.ndarray) -> np.ndarray:
    """Bin of the trigram at each byte but the last two. Case of letters beyond ASCII: their second UTF-8 bytes differ, which a few bins absorb."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    bins = _parts[0][data[:-2]]
    bins ^= _parts[1][data[1:-1]]
    bins ^= _parts[2][data[2:]]
    return bins


def text_sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of values[low:high] for ranges in order that don't overlap; 0 for empty ones."""
    out = np.zeros(len(low))
    some = np.flatnonzero(high > low)
    if len(some):
        edges = np.stack([low[some], high[some]], axis=1).ravel()
        out[some] = np.add.reduceat(values, edges[:-1] if edges[-1] == len(values) else edges, dtype=np.float64)[::2]
    return out


def text_ranges(part: Slice, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's trigrams begin and end."""
    low = np.minimum(part.offsets[:-1], len(bins))
    return low, np.maximum(np.minimum(part.offsets[1:] - 2, len(bins)), low)


@dataclass
class LanguageModel:
    """Weights by bin: one row for each family (one against the rest) and for each pair of languages of a family."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # (families + pairs, BINS)
    bias: np.ndarray
    usual: np.ndarray  # (languages, BINS): log2 of each trigram's share in a language's sample
    centre: np.ndarray  # by language: median of the sample's means of it, and the least of (mean - centre) * sqrt(trigrams)
    least: np.ndarray
    far: np.ndarray  # by language: the mean that a text with FOREIGN_SHARE of other text has

    def foreign(self, part: Slice, bins: np.ndarray, named: np.ndarray) -> np.ndarray:
        """Whether each text is too unlike the sample of the language (by number) that it was taken for, by the mean of ``usual``."""
        low, high = text_ranges(part, bins)
        out = high == low
        for k in range(len(self.languages)):
            own = np.flatnonzero((named == k) & ~out)
            n = high[own] - low[own]
            mean = text_sums(self.usual[k][bins], low[own], high[own]) / n
            out[own] = (mean < self.far[k]) & ((mean - self.centre[k]) * np.sqrt(np.minimum(n, STEADY_TRIGRAMS)) < self.least[k])
        return out

    def margins(self, part: Slice, bins: np.ndarray) -> np.ndarray:
        """Mean margins of each text and machine."""
        low, high = text_ranges(part, bins)
        count = np.maximum(high - low, 1)
        means = [text_sums(w[bins], low, high) / count for w in self.weights]
        return np.stack(means, axis=1) + self.bias if means else np.zeros((len(part), 0))

    def predict(self, part: Slice, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each text's language, score): the best family, then most votes of its pairs, then the larger sum of margins."""
        n, n_families = len(part), len(self.families)
        margins = self.margins(part, bins)
        best = np.argmax(margins[:, :n_families], axis=1)
        shape = (n, len(self.languages))
        votes, strength, closest = np.zeros(shape), np.zeros(shape), np.full(shape, 6.0)
        for k, (a, b) in enumerate(self.pairs):
            margin = margins[:, n_families + k]
            for side, won in ((a, margin >= 0), (b, margin < 0)):
                votes[:, side] += won
                strength[:, side] += margin if side == a else -margin
                closest[:, side] = np.where(won, np.minimum(closest[:, side], np.abs(margin)), closest[:, side])
        own = np.array([self.families.index(family(code)) for code in self.languages])
        votes[own[None, :] != best[:, None]] = -1
        top = np.argmax(np.where(votes == votes.max(axis=1, keepdims=True), strength, -np.inf), axis=1)
        rows = np.arange(n)
        of_family = margins[rows, best] if n_families > 1 else np.full(n, 6.0)
        return top, _certainty(of_family) * _certainty(closest[rows, top])


def _certainty(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-3.0 * np.clip(margin, -6.0, 6.0)))


def _train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine by averaged subgradient steps on the hinge loss, in a fixed order."""
    weights, total = np.zeros(BINS), np.zeros(BINS)
    bias = bias_total = 0.0
    balance = {1: len(target) / max(1, 2 * (target > 0).sum()), -1: len(target) / max(1, 2 * (target < 0).sum())}
    rng, step = np.random.default_rng(7), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            step += 1
            rate = 1.0 / (1.0 + REGULAR * step)
            bins, share = rows[i]
            if target[i] * (weights[bins] @ share + bias) < 1:
                weights[bins] += rate * balance[int(target[i])] * target[i] * share * 40
                bias += 0.05 * rate * balance[int(target[i])] * target[i]
        total += weights
        bias_total += bias
    return total / EPOCHS, bias_total / EPOCHS


def fit(texts: list[str], languages: list[str]) -> LanguageModel:
    """Family machines (one against the rest) and one machine for each pair of languages of a family."""
    rows = []
    for text in texts:
        bins, counts = np.unique(trigram_bins(np.frombuffer(text.encode(), np.uint8)), return_counts=True)
        rows.append((bins, counts / max(1, counts.sum())))
    codes = sorted(set(languages))
    families = sorted({family(c) for c in codes})
    label = np.array([codes.index(c) for c in languages])
    own = np.array([families.index(family(c)) for c in languages])
    machines = [_train(rows, np.where(own == f, 1, -1)) if len(families) > 1 else (np.zeros(BINS), 0.0) for f in range(len(families))]
    pairs = [(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if family(codes[a]) == family(codes[b])]
    for a, b in pairs:
        at = np.flatnonzero((label == a) | (label == b))
        machines.append(_train([rows[i] for i in at], np.where(label[at] == a, 1, -1)))
    weights = np.stack([w for w, _ in machines]) if machines else np.zeros((0, BINS))
    counts = [(bins, np.rint(share * n)) for (bins, share), n in zip(rows, [max(1, len(t.encode()) - 2) for t in texts], strict=True)]
    return LanguageModel(codes, families, pairs, weights.astype(np.float32), np.array([b for _, b in machines]), *_typical(counts, label, len(codes)))


def _usual(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log2 of each bin's share, half a trigram added to each. A document adds its counts at most as if it had STEADY_TRIGRAMS."""
    total = np.full(BINS, 0.5)
    for bins, n in counts:
        total[bins] += n * min(1.0, STEADY_TRIGRAMS / max(1.0, n.sum()))
    return np.log2(total / total.sum())


def _typical(counts: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, n_languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(usual, centre, least, far) of each language; centre and least from documents held against the others' trigrams only."""
    usual, centre, least = np.zeros((n_languages, BINS)), np.zeros(n_languages), np.full(n_languages, -np.inf)
    far = np.full(n_languages, -np.inf)
    for k in range(n_languages):
        own = [counts[i] for i in np.flatnonzero(label == k)]
        usual[k] = _usual(own)
        if len(own) < LEAST_CALIBRATED:
            continue
        means, sizes = [], []
        for fold in range(HELD_PARTS):
            table = _usual([x for i, x in enumerate(own) if i % HELD_PARTS != fold])
            for bins, n in own[fold::HELD_PARTS]:
                if n.sum():
                    means.append(float(table[bins] @ n / n.sum())), sizes.append(n.sum())
        if len(means) < LEAST_CALIBRATED:
            continue
        centre[k] = np.median(means)
        off = (np.array(means) - centre[k]) * np.sqrt(np.minimum(sizes, STEADY_TRIGRAMS))
        least[k] = -REJECT_DEVIATIONS * max(float(np.median(np.abs(off))) * 1.4826, 1.0)
        other = [float(usual[k][bins] @ n / n.sum()) for i, (bins, n) in enumerate(counts) if label[i] != k and n.sum()]
        unlike = float(np.median(other)) if len(other) >= LEAST_CALIBRATED else -float(np.log2(BINS))
        far[k] = centre[k] - FOREIGN_SHARE * max(centre[k] - unlike, 0.0)
    return usual.astype(np.float32), centre, least, far


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most: int = MOST_LANGUAGES) -> DataFrame:
    """(text, lang) of at most ``per_language`` documents of each of the ``most`` commonest languages.

    The rows with the least hashes of doc_id and text; rows that repeat count once. A language's rows are counted first,
    and only those move whose hash is so low that about twice as many as wanted have one, however many there are.
    """
    labelled = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"))
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most)
    highest = F.when(F.col("count") <= 2 * per_language, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + F.lit(2.0**64) * (2 * per_language) / F.col("count")).cast("long"))
    low = labelled.join(F.broadcast(common.select("lang", highest.alias("highest"))), "lang").where("h <= highest").dropDuplicates(["lang", "h"])
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return ranked.where(F.col("rank") <= per_language).select("text", "lang")


def held_out() -> "F.Column":
    """Documents that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


PREDICTED = "lang_pred string, score double"


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), reject: bool = False) -> DataFrame:
    """The ``keep`` columns of each row with lang_pred and score (0 to 1) from its whole text.

    Each text is given to one of the model's languages; with ``reject`` one that isn't like the sample of that language
    (in another, in several or in none) is ``und`` with score 0.

    A null text and one without a letter are ``und`` with score 0. A letter is anything that isn't ASCII punctuation,
    a digit, a space or a control character in the ASCII range, or that Unicode classes as a letter beyond it.
    """
    import re

    letter = re.compile(r"[^\W\d_]")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", " + PREDICTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for part in text_slices(batch.column("_text")):
                rows = slice(*part.rows)
                bins = trigram_bins(part.data)
                known = bool(machine.languages)
                named, sure = machine.predict(part, bins) if known else (np.zeros(len(part), int), np.zeros(len(part)))
                ascii_letter = ((part.data | 32) >= 97) & ((part.data | 32) <= 122)
                some = text_sums(ascii_letter, part.offsets[:-1], part.offsets[1:]) > 0
                for i in np.flatnonzero(~some).tolist():  # letters beyond ASCII are looked for only where none is in it
                    some[i] = bool(letter.search(part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().decode()))
                some &= known
                if reject and known:
                    some &= ~machine.foreign(part, bins, named)
                lang = [machine.languages[k] if s else UNDETERMINED for k, s in zip(named.tolist(), some.tolist(), strict=True)]
                columns = [batch.column(c)[rows] for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(np.where(some, sure, 0.0), pa.float64())], names=[*keep, "lang_pred", "score"])

    return map_batches(docs.select(*keep, F.col("text").cast("string").alias("_text")), run, schema)


def fit_on(docs: DataFrame) -> LanguageModel:
    """A model from the training sample of ``docs``; the sample, bounded as documented, comes to the driver."""
    rows = training_sample(docs).collect()
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def language_predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from documents that aren't held out, predicts all from their texts."""
    model = fit_on(docs.where(~held_out()))
    return identify(docs.withColumn("held_out", held_out()), model, ("doc_id", "held_out"))
