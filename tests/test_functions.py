"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from larder.functions import boxes, measures, paths, text


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_tags(spark):
    got = values(spark, text.tag(F.lit("Café & Thé d'été!")), text.tag(F.lit("a  b.c?")), text.store_tag(F.lit("Leader & Price D'Or")), text.emb_code(F.lit(" FR 40.261.001 CE")))
    assert got == ["cafe-the-d-ete", "a--b-c", "leader-price-d-or", "fr40261001ec"]


def test_folding(spark):
    got = values(spark, text.fold(F.lit("œuf ñ 日")), text.fold(F.lit("œuf 日"), "keep"), text.fold(F.lit("œufé"), "same_length"), text.strip_accents(F.lit("ﬁn œ é")))
    assert got == ["oeuf n ", "oeuf 日", "œufe", "fin  e"]


def test_image_ids(spark):
    got = values(spark, *[paths.image_id(F.lit(p)) for p in ("/322/247/762/7888/2.jpg", "/1/front_fr.3.jpg", "/1/1.400.jpg", "7")])
    assert got == ["2", None, None, "7"]


def test_barcodes(spark):
    got = values(spark, paths.is_reserved(F.lit("0212345")), paths.is_reserved(F.lit("312")), paths.barcode_prefix(F.lit("5400141651306")), paths.barcode_prefix(F.lit("123")), paths.image_path(F.lit("3222477627888"), F.lit("2")))
    assert got == [True, False, "5400141xxxxxx", None, "/322/247/762/7888/2.jpg"]


def test_weights(spark):
    got = values(
        spark, measures.normalize_weight(F.lit("1,5"), F.lit("kg")), measures.normalize_weight(F.lit("2"), F.lit("fl oz")), measures.is_valid_weight(F.lit("05")),
        measures.is_valid_weight(F.lit("250")), measures.is_valid_weight(F.lit("2.5")), measures.is_suspicious_weight(F.lit(1255.0)), measures.is_extreme_weight(F.lit(100.0), F.lit("30")),
    )
    assert got == [1500.0, 60.0, False, True, False, True, True]


@pytest.mark.parametrize(
    "words,label,expected",
    [
        ("25 g", "proteins_100g", ("25", "g", True)), ("O g", "salt_100g", ("0", "g", True)), ("<0.5 g", "salt_100g", ("< 0.5", "g", True)), ("12.58", "fat_100g", ("12.5", "g", True)),
        ("126", "energy_kcal_100g", ("126", "kcal", True)), ("525 kj", "energy_kcal_100g", ("525", "kj", False)), ("20mcg", "vitamin_d_100g", ("20", "µg", True)), ("abc", "salt_100g", (None, None, False)),
        ("08", "fat_100g", ("0", "g", True)), ("3.8", "fat_100g", ("3.8", None, True)), ("10 kcal", "sodium_100g", ("10", "kcal", False)),
    ],
)
def test_nutrient_value(spark, words, label, expected):
    row = spark.range(1).select(measures.match_nutrient_value(F.lit(words), F.lit(label)).alias("m")).select("m.*").first()
    assert tuple(row) == expected


def test_boxes(spark):
    a, b = (F.array(*[F.lit(float(x)) for x in v]) for v in ((0, 0, 2, 2), (1, 1, 3, 3)))
    got = values(spark, F.round(boxes.iou(a, b), 6), boxes.iou(a, a), boxes.rotate(F.array(*[F.lit(float(x)) for x in (10, 20, 60, 80)]), F.lit(100.0), F.lit(200.0), F.lit(90)))
    assert got[0] == round(1 / 7, 6) and got[1] == 1.0 and got[2] == [20.0, 140.0, 80.0, 190.0]
