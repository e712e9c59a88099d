import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as tx
from weftgraph.functions.values import endpoint, flag, json_anywhere, json_array, json_in, json_object, listed, urls_in

FOUND = "1. Harbour news\n URL: https://port.example/a).\n Summary: ships came\n2. A walk\nURL: https://walks.example/b\nSummary: along the quay\n3. no address\nSummary: x"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_texts(spark):
    got = [r.asDict() for r in one(spark, tx.search_entries(F.lit(FOUND)))]
    assert got == [{"title": "Harbour news", "url": "https://port.example/a", "summary": "ships came"}, {"title": "A walk", "url": "https://walks.example/b", "summary": "along the quay"}]
    assert one(spark, tx.question_entities(F.lit("Where did the Ferry stop near ferry and Pier-Nine today?"))) == ["did", "Ferry", "stop"]
    assert one(spark, tx.web_terms(F.lit("Порт и Harbour, the port 2031 harbour"))) == one(spark, tx.web_terms(F.lit("порт и harbour, the port 2031")))


def test_values():
    assert urls_in({"href": "https://one.example", "more": [{"source": "https://two.example/x"}, "see https://three.example/y."]}) == ["https://one.example", "https://two.example/x", "https://three.example/y"]
    assert json_in('first {"k": "]", "l": {"m": 2}} rest') == {"k": "]", "l": {"m": 2}} and json_array("[3, 4] and more") == [3, 4]
    for bad in ("", None, "nothing", "{broken"):
        with pytest.raises(ValueError):
            json_in(bad)
    with pytest.raises(ValueError):
        json_object("[5]")
    assert json_anywhere("before [7, 8] after") == [7, 8] and json_anywhere("none here") is None
    assert flag("on") and not flag("no", True) and flag("", True) and listed("x, y ,,") == ["x", "y"]
    assert endpoint("http://box/v1", "z") == "http://box/v1/z"
