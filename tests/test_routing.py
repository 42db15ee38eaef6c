import pytest

from foliomill.operators.routing import route

IMAGE, SHORT, UNKNOWN, LONG, OTHER = "image", "pdf 20", "pdf unknown", "pdf 21", "other"
FILES = [(IMAGE, ".png", None), (SHORT, ".pdf", 20), (UNKNOWN, ".pdf", None), (LONG, ".pdf", 21), (OTHER, ".docx", 99)]


@pytest.mark.parametrize("available", [True, False])
@pytest.mark.parametrize("prefer", ["auto", "paddleocr", "markitdown"])
def test_decision_table(spark, prefer, available):
    files = spark.createDataFrame(FILES, "kind string, ext string, page_count int")
    found = {r.kind: (r.use_text, r.use_ocr, r.ocr_supported) for r in route(files, available, prefer).collect()}
    if prefer == "markitdown":
        ocr = dict.fromkeys((SHORT, UNKNOWN, LONG, OTHER), False) | {IMAGE: True}
    else:
        ocr = dict.fromkeys((IMAGE, SHORT, UNKNOWN, OTHER), available) | {LONG: False}
    assert found == {k: (k != IMAGE, ocr[k], k != OTHER) for k in ocr}


def test_page_count_is_optional_and_preference_is_checked(spark):
    files = spark.createDataFrame([(".pdf",)], "ext string")
    assert route(files).first().use_ocr
    with pytest.raises(ValueError):
        route(files, prefer="other")
