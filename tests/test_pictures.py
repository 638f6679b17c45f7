"""Pictures and their titles on small pages."""

import pytest

from millrace.operators import chunking

BLOCK = "page long, block int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double"
PICTURE = "picture string, page long, number int, ext string, width int, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize("cell", [256.0, 30.0])
def test_titles(spark, cell):
    blocks = [
        (0, 0, " Figure 1\n", 12.0, True, 100.0, 180.0, 200.0, 195.0),  # 4 + 2
        (0, 1, "ends here.", 12.0, True, 100.0, 160.0, 200.0, 175.0),
        (0, 2, "above, plain", 9.0, False, 100.0, 100.0, 200.0, 112.0),  # 1 + 2
        (0, 3, "below, bold", 11.0, True, 100.0, 320.0, 200.0, 335.0),  # 4 - 1
        (0, 4, "too far below", 11.0, True, 100.0, 790.0, 200.0, 800.0),  # the foot
        (0, 5, "beside", 12.0, True, 400.0, 180.0, 500.0, 195.0),
        (0, 6, "a\nb\nc\nd " + "x" * 40, 9.0, True, 100.0, 150.0, 200.0, 158.0),  # 1 + 2
        (0, 7, "", 12.0, True, 100.0, 150.0, 200.0, 158.0),
        (0, 8, None, 12.0, True, 100.0, 150.0, 200.0, 158.0),
        (1, 0, "Figure 1 of another page", 12.0, True, 100.0, 180.0, 200.0, 195.0),
    ]
    pictures = [("a", 0, 0, "jpeg", 300, 100.0, 200.0, 200.0, 300.0), ("icon", 0, 1, "jpeg", 34, 100.0, 200.0, 200.0, 300.0), ("png", 0, 2, "png", 300, 100.0, 200.0, 200.0, 300.0), ("b", 2, 0, "jpeg", 300, 0.0, 10.0, 50.0, 60.0), ("c", 0, 3, None, 300, 0.0, 0.0, 1.0, 1.0)]
    pages = spark.createDataFrame([(p, 595.0, 842.0) for p in range(3)], "page long, page_width double, page_height double")
    got = chunking.picture_titles(spark.createDataFrame(pictures, PICTURE), spark.createDataFrame(blocks, BLOCK), pages, cell=cell).collect()
    want = {("a", 0, "page1_img1.jpeg", "Figure 1\nabove, plain\nbelow, bold\na\nb\nc\nd " + "x" * 40, "Figure 1"), ("b", 2, "page3_img1.jpeg", "", "")}
    assert {tuple(r) for r in got} == want


def test_without_rows(spark):
    pages = spark.createDataFrame([], "page long, page_width double, page_height double")
    assert chunking.picture_titles(spark.createDataFrame([], PICTURE), spark.createDataFrame([], BLOCK), pages).count() == 0
