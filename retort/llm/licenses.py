"""Licence scans: a paragraph classifier over hashed word n-grams, confirmed against templates.

A softmax regression over sparse one- and two-word features tells licence families and an unknown class apart. It is
trained here on notices and on the licences' texts (``licence_texts``: the standard texts, but chosen paragraphs only of
the AGPL, whose other text is the GPL's, and of CC BY, BY-SA and BY-NC), cut and thinned in many ways, and on a bounded
sample of the corpus as unknown. Its probabilities are calibrated with a temperature on held-out examples, and the
probability that a family needs is the least, from a half on, at which no more than a set share of held-out unknown
paragraphs are taken for a family and confirmed.

A long paragraph is classified in windows as well, so that a notice within it is found. A prediction is confirmed if
enough of the text's word trigrams stand in the family's templates, one of them in no other's, or nearly all of one
template stand in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.textbatch import NEWLINE, Slice, gather, map_batches, mix, text_slices

UNKNOWN = "unknown"
BINS_LOG = 15
#: Bound of the sample of the corpus that stands for the unknown class: documents, and paragraphs of them.
UNKNOWN_SAMPLE, UNKNOWN_PARAGRAPHS = 200, 2000
#: Longer ones of the sample are cut into pieces of so many words.
SAMPLE_WORDS = 200
#: Share of held-out unknown paragraphs that may be taken for a family and confirmed.
FALSE_SHARE = 0.001
#: Least share of a text's trigrams in the templates, or of a template's in the text, and least trigrams of such a template.
CONFIRM_SHARE, CONTAINED_SHARE, CONTAINED_TRIGRAMS = 0.5, 0.9, 3
#: Paragraphs of more than LONG words are also taken in windows of WINDOW words, one every STRIDE.
LONG, WINDOW, STRIDE = 32, 24, 12
EPOCHS, BATCH = 24, 64

# Names that notices give the families, and sentences of the licences' texts.
NAMES = {
    "mit": ("the MIT License", "MIT License", "the Expat License"),
    "apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 license"),
    "gpl": ("the GNU General Public License, version 3", "the GNU General Public License, version 2", "the GNU GPL v3", "GPL-3.0-or-later"),
    "lgpl": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License", "the GNU LGPL v3"),
    "agpl": ("the GNU Affero General Public License, version 3", "the GNU AGPL v3"),
    "bsd": ("the BSD 3-Clause License", "the BSD 2-Clause License", "the New BSD License", "a BSD-style license"),
    "mpl-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "isc": ("the ISC License", "ISC license"),
    "cc-by": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc0": ("CC0 1.0 Universal", "the CC0 public domain dedication"),
}
NOTICES = (
    "Licensed under {}.",
    "Released under {}.",
    "This work is licensed under {}.",
    "Distributed under the terms of {}.",
    "This project is available under {}. See the LICENSE file for details.",
    "This software is made available under {}.",
    "License: {}",
    "You may use this file under {}.",
)
# The files with the texts of each family.
TEXTS = {
    "mit": ("mit",),
    "apache-2.0": ("apache-2.0",),
    "gpl": ("gpl-2", "gpl-3"),
    "lgpl": ("lgpl-2.1", "lgpl-3"),
    "agpl": ("agpl-3",),
    "bsd": ("bsd",),
    "mpl-2.0": ("mpl-2.0",),
    "isc": ("isc",),
    "cc-by": ("cc-by",),
    "cc-by-sa": ("cc-by-sa",),
    "cc-by-nc": ("cc-by-nc",),
    "cc0": ("cc0",),
}
#: Everyday sentences with words of licences, as unknown.
DISTRACTORS = (
    "The driver showed a valid license to the officer at the gate.",
    "Copyright law changed a great deal over the last century.",
    "Permission to enter the park was granted to any person with a ticket.",
    "The new version of the program is distributed to every member of the public.",
    "Under the terms of the agreement the work was to be finished by spring.",
    "The general public was free to use the library at any time without charge.",
    "This work is dedicated to the memory of the author.",
    "A warranty of two years covers all parts of the software and the machine.",
    "By using this website you accept the terms of service and the privacy policy of the company.",
    "All rights reserved. No part of this book may be copied without permission of the publisher.",
    "The contract ends if either party breaks its conditions and does not put this right within thirty days.",
    "The seller is not liable for any damage that arises from the use of the product.",
    "Members may copy and share the recipes with friends for any purpose they like.",
    "The city grants each holder of a permit the right to park in the old town.",
    "Copyright 2019 by the authors. Printed in the north of the country.",
    "The court held that the conditions of the agreement did not apply to later versions of the work.",
)

_between = np.ones(256, bool)
for low, high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _between[low : high + 1] = False


class Paragraphs:
    """The lines of a slice that have a word, and their words' hashes (case of A-Z ignored, punctuation dropped)."""

    def __init__(self, part: Slice):
        starts, _ = lines = part.words(NEWLINE)
        words, ends = part.words(_between)
        self.hashes = part.hashes(words, ends, "folded")
        self.line = np.searchsorted(starts, words, side="right") - 1
        seen = np.unique(self.line)
        self.starts, self.ends = lines[0][seen], lines[1][seen]
        self.text = part.owner(self.starts)
        self.row = np.searchsorted(seen, self.line)
        self.first = np.searchsorted(self.row, np.arange(len(seen)))
        self.count = np.diff(np.append(self.first, len(self.row)))

    def __len__(self) -> int:
        return len(self.starts)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(paragraph, first word, words) of what is classified: every paragraph, then the windows of long ones, the last at the end."""
        long = np.flatnonzero(self.count > LONG)
        steps = -(-(self.count[long] - WINDOW) // STRIDE) + 1
        owner = np.repeat(long, steps)
        step = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
        first = self.first[owner] + np.minimum(step * STRIDE, self.count[owner] - WINDOW)
        return np.concatenate([np.arange(len(self)), owner]), np.concatenate([self.first, first]), np.concatenate([self.count, np.full(len(owner), WINDOW)])

    def bins(self) -> tuple[np.ndarray, np.ndarray]:
        """The feature of every word, and of every word with the next."""
        shift = np.uint64(64 - BINS_LOG)
        pairs = mix(self.hashes[:-1] * np.uint64(3) + mix(self.hashes[1:]))
        return (self.hashes >> shift).astype(np.int64), (pairs >> shift).astype(np.int64)

    def features(self, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(span, feature) of every word and of every two neighbouring words of the spans."""
        single, pairs = self.bins()
        rows = np.arange(len(first))
        return np.concatenate([np.repeat(rows, count), np.repeat(rows, count - 1)]), np.concatenate([gather(single, first, count), gather(pairs, first, count - 1)])

    def trigrams(self, first: int, count: int) -> set[int]:
        own = self.hashes[first : first + count]
        if len(own) < 3:
            return {int(mix(own.sum(dtype=np.uint64, keepdims=True))[0])}
        return set(mix(own[:-2] * np.uint64(3) + mix(own[1:-1] * np.uint64(5) + mix(own[2:]))).tolist())


@dataclass
class LicenseModel:
    families: list[str]  # the last is UNKNOWN
    weights: np.ndarray  # (families, bins)
    bias: np.ndarray
    temperature: float
    threshold: float
    whole: dict[str, set[int]]  # trigrams of all templates of a family
    each: dict[str, list[set[int]]]  # of each that may be contained in a text

    def logits(self, found: Paragraphs, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """From running sums over the words, so spans that overlap cost no more."""
        sums = np.zeros((len(first), len(self.families)))
        single, pairs = found.bins()
        last = first + count
        for k, w in enumerate(self.weights):
            words, two = (np.concatenate([[0.0], np.cumsum(w[x])]) for x in (single, pairs))
            sums[:, k] = words[last] - words[first] + two[last - 1] - two[first]
        return sums / np.sqrt(2 * count - 1)[:, None] + self.bias

    def probabilities(self, found: Paragraphs, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(found, first, count) / self.temperature)

    def confirmation(self, grams: set[int], family: str) -> tuple[float, bool]:
        """(larger of the share of a text's trigrams in the templates and that of a template's in the text, whether it suffices).

        A share in the templates suffices only with a trigram that no other family's templates have.
        """
        inside = len(grams & self.whole[family]) / len(grams)
        around = max((len(grams & t) / len(t) for t in self.each[family] if len(t) <= len(grams)), default=0.0)
        own = inside >= CONFIRM_SHARE and bool((grams & self.whole[family]).difference(*[t for f, t in self.whole.items() if f != family]))
        return max(inside, around), own or around >= CONTAINED_SHARE


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _paragraphs(texts: list[str]) -> Paragraphs:
    """Each text as one paragraph, all in one slice."""
    encoded = [x.replace("\n", " ").encode() for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded], dtype=np.int64)])
    return Paragraphs(Slice(np.frombuffer(b"".join(encoded), np.uint8), offsets, (0, len(texts))))


def template_paragraphs(family: str) -> list[str]:
    """The blocks of the family's texts between blank lines, each as one line."""
    folder = resources.files("retort.llm") / "licence_texts"
    blocks = [x for name in TEXTS[family] for x in re.split(r"\n\s*\n", (folder / f"{name}.txt").read_text())]
    return [x for x in (" ".join(b.split()) for b in blocks) if re.search(r"[A-Za-z0-9]", x)]


def templates() -> dict[str, list[str]]:
    """Notices and paragraphs of each family. A paragraph that an earlier family has for the most part is that one's."""
    out, before = {}, set()
    for name, aliases in NAMES.items():
        own = template_paragraphs(name)
        found = _paragraphs(own)
        grams = [found.trigrams(found.first[i], found.count[i]) for i in range(len(found))]
        fresh = [x for x, g in zip(own, grams, strict=True) if len(g & before) < 0.5 * len(g)]
        before.update(*grams)
        out[name] = [*(n.format(a) for n in NOTICES for a in aliases), *fresh]
    return out


def examples(unknown: list[str], known: dict[str, list[str]]) -> tuple[list[str], list[str]]:
    """Training texts and their families, made in a fixed order: whole, thinned, pieces as of wrapped lines, and among other words."""
    rng = np.random.default_rng(5)
    texts, labels = [], []
    for name, own in known.items():
        for text in own:
            words = text.split()
            made = [text, " ".join([w for w in words if rng.random() > 0.1] or words)]
            for _ in range(1 + len(words) // 20 if len(words) > 12 else 0):
                low = int(rng.integers(len(words) - 8))
                made.append(" ".join(words[low : low + int(rng.integers(8, 25))]))
            if unknown and len(words) <= WINDOW:
                for _ in range(4):  # as in a window of a longer paragraph
                    around = unknown[int(rng.integers(len(unknown)))].split()[: max(2, WINDOW - len(words))]
                    at = int(rng.integers(len(around) + 1))
                    made.append(" ".join([*around[:at], *words, *around[at:]]))
            texts += made
            labels += [name] * len(made)
    for text in [*DISTRACTORS * 6, *unknown]:
        texts.append(text), labels.append(UNKNOWN)
    return texts, labels


def fit(unknown: list[str]) -> LicenseModel:
    """A calibrated model from the templates and sample paragraphs of no licence."""
    known = templates()
    texts, labels = examples(unknown, known)
    families = [*NAMES, UNKNOWN]
    target = np.array([families.index(x) for x in labels])
    found = _paragraphs(texts)
    if len(found) != len(texts):
        raise ValueError("a training paragraph has no word")
    rows, bins = found.features(found.first, found.count)
    order = np.argsort(rows, kind="stable")
    rows, bins = rows[order], bins[order]
    cuts = np.searchsorted(rows, np.arange(len(found) + 1))
    size = np.diff(cuts)
    held = np.arange(len(texts)) % 5 == 4
    share = np.bincount(target[~held], minlength=len(families))
    balance = np.minimum(len(target) / (len(families) * np.maximum(share, 1)), 4.0)
    weights, bias = np.zeros((1 << BINS_LOG, len(families))), np.zeros(len(families))
    seen = np.full(weights.shape, 1e-6)  # sums of squared steps, by which later ones shrink
    rng = np.random.default_rng(9)
    for _ in range(EPOCHS):
        mixed = rng.permutation(np.flatnonzero(~held))
        for low in range(0, len(mixed), BATCH):
            chosen = mixed[low : low + BATCH]
            own, of = gather(bins, cuts[chosen], size[chosen]), np.repeat(np.arange(len(chosen)), size[chosen])
            scale = 1 / np.sqrt(size[chosen])
            used, back = np.unique(own, return_inverse=True)
            z = np.zeros((len(chosen), len(families)))
            np.add.at(z, of, weights[own])
            p = _softmax(z * scale[:, None] + bias)
            p[np.arange(len(chosen)), target[chosen]] -= 1
            p *= balance[target[chosen]][:, None]
            slope = np.zeros((len(used), len(families)))
            np.add.at(slope, back, (p * scale[:, None])[of])
            seen[used] += slope**2
            weights[used] -= 0.5 * slope / np.sqrt(seen[used])
            bias -= 0.05 * p.mean(axis=0)
    whole, each = {}, {}
    for name, own in known.items():
        paragraphs, every = _paragraphs(own), _paragraphs(template_paragraphs(name))
        grams, all_grams = ([x.trigrams(x.first[i], x.count[i]) for i in range(len(x))] for x in (paragraphs, every))
        whole[name], each[name] = set().union(*grams, *all_grams), [g for g in grams if len(g) >= CONTAINED_TRIGRAMS]
    model = LicenseModel(families, np.ascontiguousarray(weights.T), bias, 1.0, 0.5, whole, each)
    z, gold = model.logits(found, found.first, found.count)[held], target[held]
    losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(gold)), gold], 1e-12)).mean() for t in np.geomspace(0.25, 8, 26).tolist()}
    model.temperature = min(losses, key=losses.get)
    p = _softmax(z / model.temperature)
    passing = []  # probabilities at which held-out unknown paragraphs are taken for a family and confirmed
    for i in np.flatnonzero(gold == len(families) - 1).tolist():
        k, at = int(np.argmax(p[i, :-1])), int(np.flatnonzero(held)[i])
        if model.confirmation(found.trigrams(found.first[at], found.count[at]), families[k])[1]:
            passing.append(float(p[i, k]))
    allowed = int(FALSE_SHARE * (gold == len(families) - 1).sum())
    model.threshold = max(0.5, np.nextafter(sorted(passing, reverse=True)[allowed], 1.0)) if len(passing) > allowed else 0.5
    return model


def unknown_sample(docs: DataFrame, documents: int = UNKNOWN_SAMPLE) -> list[str]:
    """Lines of the documents with the least hashes, without those that speak of licences or rights."""
    hashed = docs.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("h"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(documents).collect()]  # texts of the chosen only come after
    rows = sorted(hashed.where(F.col("h").isin(least)).distinct().collect(), key=lambda r: (r["h"], r["text"])) if least else []
    cues = ("licen", "copyright", "gpl", "creative commons", "cc by", "cc0")
    lines = [x.split() for row in rows for x in row["text"].split("\n") if not any(c in x.lower() for c in cues)]
    pieces = [" ".join(x[i : i + SAMPLE_WORDS]) for x in lines for i in range(0, len(x), SAMPLE_WORDS)]
    return [x for x in pieces if re.search(r"[A-Za-z0-9\x80-\U0010ffff]", x)][:UNKNOWN_PARAGRAPHS]


def _matches(machine: LicenseModel, found: Paragraphs, texts: int) -> list[list[dict]]:
    """The matches of each text, by paragraph and family; of several windows of a paragraph the surest that is confirmed, else the surest."""
    best: dict[tuple[int, str], dict] = {}
    settled: set[int] = set()
    if len(found):
        owner, first, count = found.spans()
        p = machine.probabilities(found, first, count)
        top = np.argmax(p[:, :-1], axis=1)
        sure = p[np.arange(len(top)), top]
        begins = np.searchsorted(found.text, np.arange(texts))
        for i in np.flatnonzero((sure >= machine.threshold) & (sure > p[:, -1])).tolist():
            family, paragraph = machine.families[top[i]], int(owner[i])
            alike, confirmed = machine.confirmation(found.trigrams(first[i], count[i]), family)
            if paragraph in settled:
                continue  # a window of a paragraph that is confirmed as a whole
            match = {"paragraph": paragraph - int(begins[found.text[paragraph]]), "family": family, "probability": round(float(sure[i]), 6), "similarity": round(alike, 6), "confirmed": confirmed}
            if confirmed and i < len(found):
                settled.add(paragraph)
            held = best.get((paragraph, family))
            if held is None or (match["confirmed"], match["probability"]) > (held["confirmed"], held["probability"]):
                best[paragraph, family] = match
    out: list[list[dict]] = [[] for _ in range(texts)]
    for paragraph, family in sorted(best):
        out[found.text[paragraph]].append(best[paragraph, family])
    return out


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, families, n_confirmed, matches) of every row.

    Paragraphs are lines with a letter or digit. matches lists, for each paragraph and each family that it or a window of
    it is taken for: its number from 0 among such lines, family, calibrated probability, similarity to the templates, and
    whether that confirms it. families is the sorted list of confirmed ones, n_confirmed the number of confirmed matches.
    Null and empty texts have no paragraphs.
    """
    model = model or fit(unknown_sample(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for part in text_slices(batch.column("text")):
                found = Paragraphs(part)
                total = np.bincount(found.text, minlength=len(part))
                matches = _matches(machine, found, len(part))
                confirmed = [[m["family"] for m in x if m["confirmed"]] for x in matches]
                kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[slice(*part.rows)].cast(pa.int64()), pa.array(total, pa.int64()), pa.array([sorted(set(x)) for x in confirmed], pa.list_(pa.string())), pa.array([len(x) for x in confirmed], pa.int64()), pa.array(matches, kind)],
                    names=["doc_id", "n_paragraphs", "families", "n_confirmed", "matches"],
                )

    schema = "doc_id long, n_paragraphs long, families array<string>, n_confirmed long, matches array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>"
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)
