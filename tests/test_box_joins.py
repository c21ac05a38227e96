"""Joins of boxes and words by image: the same pairs in crowded and other images, each row joined once."""

import random

import pytest

from larder.operators import joins as J


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        y, x, s = (rng.randrange(60) / 100 for _ in range(3))
        rows.append((f"im{min(rng.randrange(30), rng.randrange(30))}", i, [y, x, y + 0.05 + s / 2, x + 0.05 + s / 2]))
    return rows, spark.createDataFrame([*rows, ("im0", 999, None), (None, 998, [0.0, 0.0, 1.0, 1.0])], "source_image string, index int, bounding_box array<double>")


def overlap(a, b):
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


@pytest.mark.parametrize("most", [0, 10, 256])
def test_overlapping_boxes_in_images_of_any_size(boxes, most):
    rows, df = boxes
    wanted = {(i, j) for k, i, a in rows for m, j, b in rows if k == m and i < j and overlap(a, b) >= 0.3}
    got = [(r["i"], r["j"]) for r in J.iou_self_join(df, 0.3, most=most).collect()]
    assert len(wanted) > 20 and sorted(got) == sorted(wanted)


@pytest.mark.parametrize("most", [0, 10, 256])
def test_words_inside_boxes_in_images_of_any_size(spark, boxes, most):
    rows, df = boxes
    words = [(k, i, f"w{i}", [b[0], b[1], b[0] + 0.02, b[1] + 0.02]) for k, i, b in rows]
    found = {}
    for k, i, b in rows:
        inside = [t for m, _, t, w in words if m == k and w[0] >= b[0] and w[1] >= b[1] and w[2] <= b[2] and w[3] <= b[3]]
        if inside:
            found[i] = " ".join(inside)
    frame = spark.createDataFrame(words, "source_image string, word_idx int, text string, bbox array<double>")
    got = J.box_containment_join(frame, df.withColumnRenamed("index", "id"), most=most)
    assert {r["logo_id"]: r["text"] for r in got.collect()} == found


def test_rows_of_common_images_are_not_copied_to_cells(spark, boxes):
    df = boxes[1]
    words = df.selectExpr("source_image", "index AS word_idx", "'w' AS text", "bounding_box AS bbox")
    for joined in (J.iou_self_join(df, 0.3), J.box_containment_join(words, df.withColumnRenamed("index", "id"))):
        assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
