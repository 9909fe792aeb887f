import pytest
from pyspark.sql import functions as F

from retort.functions import conditions, parsing, reactions, scores


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "temperature", "hours", "confidence", "issues"),
    [
        ("CCO>O.100.64800>CC=O", 100.0, 18.0, "high", []),
        ("CCO>O.25.3600>CC=O", 25.0, 1.0, "high", []),
        ("C>-78.rt>C", 25.0, None, "low", ["single_numeric_assumed_temperature"]),
        ("C>rt.overnight>C", 25.0, 16.0, "high", []),
        ("C>25>C", 25.0, None, "low", ["single_numeric_assumed_temperature"]),
        ("C>7200>C", None, 2.0, "medium", []),
        ("C>20.40>C", 20.0, None, "low", ["multi_temperature_profile_primary_selected"]),
        ("C>-20.30>C", -20.0, None, "medium", []),
        ("C>O>C", None, None, "none", []),
        ("C>>C", None, None, "none", []),
        ("C> >C", None, None, "none", []),
        (None, None, None, "none", []),
    ],
)
def test_middle_field(spark, text, temperature, hours, confidence, issues):
    got = one(spark, conditions.reparse_middle(F.lit(text).cast("string")))
    assert (got["temperature_c"], got["time_h"], got["confidence"], got["issues"]) == (temperature, hours, confidence, issues)


def test_outliers_are_kept_apart(spark):
    got = one(spark, conditions.validate_conditions(F.lit(-2100), F.lit(61_700_000)))
    assert got["status"] == "suspicious" and got["temperature_clean_c"] is None and got["time_clean_h"] is None and got["temperature_observed_c"] == -2100


def test_patent_and_lists(spark):
    assert one(spark, parsing.patent_document_id(F.lit("20121206-US20120309739A1-0397"))) == "20121206-US20120309739A1"
    assert one(spark, parsing.parse_list(F.lit("['O', 'CO']"))) == ["O", "CO"]
    assert one(spark, parsing.parse_list(F.lit('["a", 2, ""]'))) == ["a", "2"]
    assert one(spark, parsing.parse_list(F.lit("THF"))) == ["THF"]
    assert one(spark, parsing.parse_list(F.lit("nan"))) == []
    assert one(spark, parsing.parse_list(F.lit(None).cast("string"))) == []
    assert one(spark, parsing.number(F.lit("1_000"))) is None and one(spark, parsing.number(F.lit("25f"))) is None and one(spark, parsing.number(F.lit("NaN"))) is None
    assert one(spark, parsing.number(F.lit(" -1.5e2 "))) == -150


def test_route_score(spark):
    parts = {"parse_completeness": F.lit(1.0), "mapping_coverage": F.lit(0.5), "condition_completeness": F.lit(1.0), "intermediate_continuity": F.lit(1.0), "anomaly_score_inverse": F.lit(1.0), "evidence_support": F.lit(0.75)}
    assert one(spark, scores.route_quality(parts)) == 0.875
    assert one(spark, scores.route_quality({})) == 0.0


def test_duplicate_headers(spark):
    frame = spark.createDataFrame([("", "b", 1), (None, None, 2), ("a", "c", 3)], "`k` string, `k.1` string, n int")
    assert [r["k"] for r in parsing.coalesce_duplicate_headers(frame).orderBy("n").collect()] == ["b", None, "a"]


def test_mapping_check(spark):
    got = one(spark, reactions.mapping_check(F.lit("[CH3:1][OH:2]>>[CH3:1]")))
    assert got["valid"] and got["coverage"] == 0.5


def test_bits(spark):
    words = scores.tanimoto(F.array(F.lit(3).cast("long")), F.array(F.lit(-1).cast("long")))
    assert one(spark, words) == 2 / 64
    assert one(spark, scores.tanimoto(F.array(F.lit(0).cast("long")), F.array(F.lit(0).cast("long")))) == 0
    assert 0 <= min(one(spark, scores.centre_bits(F.sha2(F.lit("x"), 256)))) and len(one(spark, scores.centre_bits(F.sha2(F.lit("x"), 256)))) == 32


@pytest.mark.parametrize(
    ("text", "expected", "reactants", "products"),
    [
        ("AB>>CD", "valid", 1, 1),
        ("AB>O.25>C.D", "valid", 1, 2),
        ("ABC", "malformed_delimiter", 0, 0),
        (">>CD", "empty_reaction_side", 0, 1),
        ("m12.A>>B", "symbolic_intermediate", 2, 1),
        ("a1>>B", "invalid_reactant", 1, 1),
        ("A>>b9. C", "invalid_product", 1, 2),
        ("x1>>y2", "invalid_both_sides", 1, 1),
        ("A>>B>>C", "malformed_delimiter", 0, 0),
        (None, "malformed_delimiter", 0, 0),
    ],
)
def test_parse_classes(spark, text, expected, reactants, products):
    sides = reactions.reaction_sides(F.lit(text).cast("string"))
    ok = [F.forall(sides[s], lambda x: x.rlike("\\A[A-Z]+\\z") | reactions.is_placeholder(x)) for s in ("reactants", "products")]
    got = one(spark, F.struct(reactions.parse_class(sides, *ok), F.size(sides["reactants"]), F.size(sides["products"])))
    assert tuple(got) == (expected, reactants, products)


def test_ngrams(spark):
    from retort.ml.features import character_ngrams, hash_features, sparse_parts

    text = "aé😀bcdé"
    assert one(spark, character_ngrams(F.lit(text))) == [text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)]
    assert one(spark, character_ngrams(F.lit("ab"))) == [] and one(spark, character_ngrams(F.lit(""))) == []
    rows = hash_features(spark.createDataFrame([("abcabc",), (None,), ("",)], "t string"), "t").select(sparse_parts("features").alias("v")).collect()
    assert sum(x * x for x in rows[0]["v"]["values"]) == pytest.approx(1) and rows[0]["v"]["indices"] == sorted(rows[0]["v"]["indices"]) and not rows[1]["v"]["indices"] and not rows[2]["v"]["indices"]
