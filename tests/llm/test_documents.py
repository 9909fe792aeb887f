"""Operators on documents against brute force, with odd rows and empty tables."""

import re
import textwrap
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers
import pytest
import sentencepiece
from tests.paths import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retort.llm import language, licenses, lines, media, minhash, packing, quality, spencode, tokencount
from retort.llm.queries import BYTES, PIECES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def expected_components(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    lead = list(range(len(rows)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            lead[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark, odd_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = minhash.near_duplicates(docs, 4).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == expected_components(rows, 4)
    odd = minhash.near_duplicates(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in odd) == expected_components([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 5)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    import random

    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "BLOCK_NODES", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(120):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(80)] = f"x{rng.randrange(50)}"
        rows.append((d, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == expected_components(rows, 4)


def test_similarity_estimate(spark):
    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(300, 3000))
    sketches = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").withColumn("key", F.lit(0).cast("long")).mapInArrow(minhash._sketch(5), minhash.SKETCH)
    pair = sketches.where("doc_id = 1").alias("x").join(sketches.where("doc_id = 2").alias("y"), F.lit(True))
    assert abs(pair.select(minhash.estimated_similarity("x", "y").alias("e")).first()["e"] - 0.9) < 0.12


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    own = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(covered)


def test_quality(spark, odd_docs):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd_docs):
        texts = sorted((str(r["doc_id"]), *base_counts(r["text"])) for r in docs.collect())
        got = quality.quality(docs).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == texts
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality.quality(odd_docs.limit(0)).count() == 0
    carried = quality.quality(odd_docs, carry=tuple(odd_docs.columns)).select("row.*")
    assert carried.columns == odd_docs.columns and carried.count() == odd_docs.count()


def test_quality_by_distribution(spark, odd_docs):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    judged = quality.quality(docs).join(labels, "doc_id").where("not base_failed").collect()
    junk = [r["kept"] for r in judged if r["quality"] == 0 and r["n_words"] >= quality.MIN_WORDS]
    assert len(junk) >= 20 and sum(junk) <= 0.2 * len(junk)
    clean = [r["kept"] for r in judged if r["quality"] == 1]
    assert sum(clean) >= 0.995 * len(clean)
    by_words = [r for r in judged if not r["kept"] and r["class_distance"] <= 0.2 and r["quality"] == 0]
    assert by_words and all(r["word_distance"] < quality.MAX_WORD_DISTANCE for r in by_words)


def test_jensen_shannon(spark):
    f = lambda counts, ref: spark.range(1).select(quality.jensen_shannon(F.array(*[F.lit(float(x)) for x in counts]), ref).alias("d")).first()["d"]
    assert f([5, 5], [0.5, 0.5]) == 0 and f([1, 0], [0.0, 1.0]) == 1 and f([0, 0], [0.5, 0.5]) is None


def test_language(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    rows = language.language_predictions(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4, 7)} == {"und"}
    assert language.language_predictions(odd_docs.limit(0)).count() == 0


def test_language_reject(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").where("quality = 1 and length(text) > 300").collect()
    by_lang = {k: [r["text"].split()[:60] for r in rows if r["lang"] == k][:20] for k in ("de", "en", "es", "fr")}
    mixed = [(f"{a}+{b}", " ".join(x + y)) for a in by_lang for b in by_lang if a != b for x, y in zip(by_lang[a], by_lang[b], strict=False)]
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    ]
    model = language.fit_on(docs)
    planted = spark.createDataFrame([*mixed, *[("foreign", t) for t in foreign]], "kind string, text string")
    told = language.identify(planted, model, keep=("kind",), reject=True).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in told if r["kind"] == "foreign")
    assert sum(r["lang_pred"] != "und" for r in told) <= 0.05 * len(mixed)
    clean = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    assert sum(r["lang_pred"] == "und" for r in language.identify(clean, model, reject=True).collect()) <= 0.02 * len(rows)


def test_token_counts_and_prefixes(spark, odd_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in tokencount.token_counts(docs, PIECES).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]])) and r["n_bytes"] == len(texts[r["doc_id"]].encode())
    few = docs.where("n_chars < 400").limit(8).union(odd_docs.where("doc_id in (3, 4, 6, 7)").select(*docs.columns[:-1], F.lit(0).cast("long")))
    for r, t in zip(tokencount.prefix_counts(few, PIECES).collect(), few.collect(), strict=True):
        table = [int.from_bytes(r["prefix_tokens"][i : i + 4], "little") for i in range(0, len(r["prefix_tokens"]), 4)]
        assert table == [len(library.encode(t["text"][:k])) for k in range(1, len(t["text"]) + 1)]
    limited = tokencount.token_counts(docs, PIECES, limit=50).collect()
    for r in limited:
        if r["over_limit"]:
            assert len(library.encode(texts[r["doc_id"]][: r["fit_chars"]])) <= 50 < len(library.encode(texts[r["doc_id"]][: r["fit_chars"] + 1]))
    asked = tokencount.tokens_of_prefix(tokencount.prefix_counts(docs, PIECES).withColumn("k", F.lit(30)), "k").collect()
    assert all(r["prefix_n"] == len(library.encode(texts[r["doc_id"]][:30])) for r in asked)
    assert {r["n_tokens"] for r in tokencount.token_counts(odd_docs.where("doc_id in (2, 3)"), PIECES).collect()} == {0}
    assert tokencount.token_counts(odd_docs.limit(0), PIECES).count() == 0


def test_sentencepiece(spark, odd_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd_docs):
        texts = docs.select("text").collect()
        coded = spencode.encode(docs, PIECES)
        assert [r["ids"] for r in coded.collect()] == [library.encode(t["text"] or "") for t in texts]
        assert [r["text"] for r in spencode.decode(coded, PIECES).collect()] == [(t["text"] or "").replace("▁", " ") for t in texts]
    assert spencode.encode(odd_docs.limit(0), PIECES).count() == 0
    assert all(r["round_trip"] for r in spencode.encoding_digests(odd_docs, PIECES).collect())


def test_packing(spark, odd_docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd_docs):
        pieces = packing.pack_documents(docs, *BYTES).collect()
        spans = defaultdict(list)
        for p in pieces:
            assert 0 < p["length"] <= 1024 and (p["piece"] == 0 or p["length"] == 1024)
            spans[p["sequence_id"]].append((p["offset"], p["length"]))
        for own in spans.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
        sums = Counter((str(p["doc_id"]), p["start"], p["length"], p["ids_crc32"]) for p in pieces)
        expected = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            start = 0
            while start < len(ids):
                stop = start + ((len(ids) - start) % 1024 or 1024)
                expected[str(r["doc_id"]), start, stop - start, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start:stop]))] += 1
                start = stop
        assert sums == expected
        assert len(spans) <= 1.1 * sum(p["length"] for p in pieces) / 1024 + 4
    assert packing.pack_documents(odd_docs.limit(0), *BYTES).count() == 0


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, open_bins=2)
    assert [bins.place(x) for x in (6, 5, 7, 3)] == [(0, 0), (1, 0), (2, 0), (2, 7)]
    assert bins.place(5) == (1, 5)


def test_media(spark, odd_docs):
    import hashlib

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(odd_docs.where("doc_id is not null and doc_id > 1").select("doc_id", "text"))
    got = media.media_digests(docs).collect()
    stored = {}
    for r, t in zip(got, docs.collect(), strict=True):
        raw = (t["text"] or "").encode()
        whole = raw + b"\xff" * ((-(-len(raw) // 576) or 1) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert stored.setdefault(whole, (r["media_sha256"], r["feature"], r["media_bytes"])) == (r["media_sha256"], r["feature"], r["media_bytes"])
    few = odd_docs.where("doc_id in (2, 6)")
    blocks = media.pcm_blocks(media.store_texts(few)).orderBy("doc_id", "block").collect()
    assert [b["sample_offset"] for b in blocks if b["doc_id"] == 6] == [0] and len(blocks) == 2 and len(blocks[0]["pcm"]) == 576
    assert media.media_digests(odd_docs.limit(0)).count() == 0


def test_licences(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    planted = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    model = licenses.fit(licenses.unknown_sample(docs))
    assert len(licenses._paragraphs(["some words"] * 300_000)) == 300_000  # over several slices' bytes
    for r in licenses.scan_licenses(docs, model).collect():
        assert r["families"] == sorted({f for x, f in planted.items() if x in texts[r["doc_id"]].split("\n")})
    prose = " ".join(" ".join(texts[d].split("\n")[0] for d in sorted(texts) if texts[d])[:4000].split()[:150])
    mit, bsd = licenses.template_paragraphs("mit"), licenses.template_paragraphs("bsd")
    whole = [
        ("mit", "\n".join(mit[2:])),
        ("mit", mit[2]),
        ("mit", mit[4]),
        ("mit", "\n".join(textwrap.wrap(mit[2], 72))),
        ("bsd", "\n".join(bsd[2:6])),
        ("apache-2.0", "\n".join(licenses.template_paragraphs("apache-2.0")[4:12])),
        ("mit", f"{prose} Released under the MIT License. {prose}"),
        ("gpl", f"{prose} This work is licensed under the GNU General Public License, version 3. {prose}"),
    ]
    plain = ["The library is free to use for any person.", prose, *licenses.DISTRACTORS]
    made = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(whole)] + [(100 + i, t) for i, t in enumerate(plain)], "doc_id long, text string")
    found = {r["doc_id"]: r["families"] for r in licenses.scan_licenses(made, model).collect()}
    assert [found[i] for i in range(len(whole))] == [[f] for f, _ in whole]
    assert all(not found[100 + i] for i in range(len(plain)))
    assert licenses.scan_licenses(odd_docs).count() == odd_docs.count() and licenses.scan_licenses(odd_docs.limit(0)).count() == 0


def within_one(a, b):
    if a == b:
        return True
    if max(len(a), len(b)) < lines.NEAR_CHARS or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def expected_removals(rows):
    found = sorted({(d is not None, d or 0, h, i, x) for d, h, t in rows for i, x in enumerate((t or "").split("\n")) if WORD.search(x)})
    out = defaultdict(list)
    for k, (has, d, h, i, x) in enumerate(found):
        if any(within_one(x, y[-1]) for y in found[:k]):
            out[d if has else None, h].append(i)
    return dict(out)


def test_line_dedup(spark, odd_docs):
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([5, 8, 9, 10, 11, 20, 40, 90]))) for _ in range(50)]

    def edited(s):
        p, o = rng.randrange(len(s)), rng.choice("ids")
        return s[:p] + ("" if o == "d" else rng.choice("xyzé")) + s[p + (o != "i") :]

    rows = []
    for d in range(120):
        own = [rng.choice(base) for _ in range(rng.randrange(7))]
        rows.append((d if rng.random() > 0.03 else None, "\n".join(edited(x) if rng.random() < 0.5 else x for x in own)))
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for docs in (made, odd_docs.select("doc_id", "text")):
        keyed = [(r["doc_id"], r["h"], r["text"]) for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").collect()]
        got = {(r["doc_id"], r["text_hash"]): r["removed"] for r in lines.removed_lines(docs).collect()}
        assert got == expected_removals(keyed)
    out = lines.dedup_lines(made).collect()
    left = [x for r in out for x in r["text"].split("\n") if WORD.search(x)]
    assert len(left) == len(set(left))
    kept = lines.dedup_lines(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} >= {2, 3, 4, 5, 6, 7}
    assert lines.line_report(odd_docs.limit(0)).count() == 0


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_one_of_each(spark, odd_docs):
    same = "one two three four five six seven eight nine ten"
    rows = [(None, same, "a"), (None, same, "b"), (5, same, "c"), (5, same, "d"), (9, same, "e"), (None, "quite another text of more than five words", "f"), (None, "quite another text of more than five words", "g"), (1, None, "h"), (1, None, "i"), (2, "", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted((r["text"] or "", r["doc_id"] or -1) for r in kept.collect())
    assert found == sorted([("", 1), ("", 1), ("", 2), (same, 5), ("quite another text of more than five words", -1)])
    assert minhash.one_of_each(odd_docs.limit(0)).count() == 0 and minhash.one_of_each(odd_docs).columns == odd_docs.columns
    unnamed = minhash.near_duplicates(spark.createDataFrame([(None, same), (3, same + " eleven")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in unnamed} == {(None, 3, False), (3, 3, True)}
