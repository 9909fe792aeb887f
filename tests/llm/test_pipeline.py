"""The pipeline's stages on all that the one before kept."""

import corpus_pipeline
from tests.paths import SMALL


def test_stages(spark, odd_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SMALL)
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name != "packing":
            assert out.columns == docs.columns
            rows = spark.createDataFrame(out.collect(), out.schema)
    order = [n for n, _ in corpus_pipeline.STAGES]
    assert order == ["quality", "language", "line_dedup", "near_dedup", "packing"]
    for a, b in zip(order, order[1:], strict=False):
        assert kept[b] <= kept[a]
    assert kept["packing"] == kept["near_dedup"]
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    assert len(clean - kept["language"]) <= 0.05 * len(clean)


FOREIGN = (
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
)


def test_language_stage_rejects(spark):
    """Planted texts in other languages and without a letter go, labelled clean ones stay."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    planted = [(-1 - i, t, None, "planted", len(t)) for i, t in enumerate((*FOREIGN, "1234 5678 !!!"))]
    rows = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language"](spark, rows, folder).select("doc_id").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    assert not [d for d in kept if d < 0] and len(clean - kept) <= 0.02 * len(clean)


def test_near_stage_keeps_one_of_each(spark):
    text = "the very same text of more than five words in many rows"
    rows = [(None, text), (4, text), (4, text), (9, text.upper()), (7, "a second text that has words of its own"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SMALL).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(4, text), (7, rows[4][1]), (8, "")]


def test_odd_rows(spark, odd_docs):
    rows = odd_docs.withColumnRenamed("n_words", "n_chars").drop("n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SMALL)
        assert out.columns == rows.columns
        out.count()
        stage(spark, rows.limit(0), SMALL).count()
