import pytest

from wideframe.operators.joins import Lookup, assemble


def test_lookups_in_turn(spark):
    facts = spark.createDataFrame([(1, 10), (2, 20), (3, None), (4, 99)], "id int, a int")
    one = spark.createDataFrame([(10, "x", 7), (20, "y", 8)], "k int, name string, b int")
    two = spark.createDataFrame([(7, "far")], "k int, name string")
    inner = assemble(facts, [Lookup(one, {"a": "k"}, {"name": "first", "b": "b"}), Lookup(two, {"b": "k"}, {"name": "second"})], ["id", "first", "second"])
    assert [tuple(r) for r in inner.collect()] == [(1, "x", "far")]
    left = assemble(facts, [Lookup(one, {"a": "k"}, {"name": "first", "b": "b"}, "left"), Lookup(two, {"b": "k"}, {"name": "second"}, "left")])
    assert sorted(tuple(r) for r in left.select("id", "first", "second").fillna("-").collect()) == [(1, "x", "far"), (2, "y", "-"), (3, "-", "-"), (4, "-", "-")]
    assert assemble(facts, [Lookup(one, {"a": "k"})]).columns == ["id", "a"]
    with pytest.raises(ValueError, match="already"):
        assemble(facts, [Lookup(one, {"a": "k"}, {"b": "A"})])
