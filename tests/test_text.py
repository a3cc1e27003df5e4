import pytest
from pyspark.sql import functions as F

from facetmill.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("name, parts", [("HTTPServerRequestQueue", ["HTTP", "Server", "Request", "Queue"]), ("a_bC", ["a", "b", "C"]), ("x", ["x"])])
def test_split_identifier(spark, name, parts):
    assert one(spark, tx.split_identifier(F.lit(name))) == parts


@pytest.mark.parametrize("word, stem", [("Queries", "query"), ("ties", "tie"), ("running", "runn"), ("being", "being"), ("class", "clas"), ("bus", "bus"), ("listeners", "listener")])
def test_stem(spark, word, stem):
    assert one(spark, tx.stem(F.lit(word))) == stem


def test_tokens_drop_stop_words_digits_and_annotations(spark):
    assert one(spark, tx.tokens(F.lit("getFloorListeners 42 Override floorRequests.class"))) == ["floor", "floor", "request", "clas"]


@pytest.mark.parametrize("raw, ids", [(None, []), (" A | B||A ", ["A", "B", "A"]), ("|", [])])
def test_parse_signature(spark, raw, ids):
    assert one(spark, tx.parse_signature(F.lit(raw).cast("string"))) == ids


@pytest.mark.parametrize("text, target, simple, external", [("java.util.List<A>", "java.util.List", "List", True), ("a.B []", "a.B", "B", False), ("Runnable", "Runnable", "Runnable", True), ("Request", "Request", "Request", False)])
def test_names(spark, text, target, simple, external):
    c = F.lit(text)
    assert (one(spark, tx.canonical_target(c)), one(spark, tx.simple_name(c)), one(spark, tx.known_external(c))) == (target, simple, external)


def test_packages_and_classes(spark):
    assert one(spark, tx.package_prefix(F.lit("a.b.C"))) == "a.b" and one(spark, tx.package_prefix(F.lit("C"))) == ""
    assert one(spark, tx.enclosing_class(F.lit("a.b.C"))) == "b" and one(spark, tx.enclosing_class(F.lit("C"))) == "C"


def test_jaccard_is_zero_for_empty_sets(spark):
    a, none = F.array(F.lit("x"), F.lit("y")), F.array().cast("array<string>")
    assert one(spark, tx.jaccard(a, F.array(F.lit("y")))) == 0.5 and one(spark, tx.jaccard(none, none)) == 0.0 and one(spark, tx.jaccard(a, none)) == 0.0
