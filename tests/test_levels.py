"""A level's nodes are told apart once, as the level is stored."""

from ledgerloom.operators import nested


def test_stored_levels_hold_what_was_told(spark):
    texts = spark.createDataFrame([(1, '{"a":{"b":[1,null,{"c":"x"}]},"d":true}'), (2, "no"), (3, "7"), (4, "[]")], "id long, text string")
    found = nested.leaves(texts, "id", "text")
    assert "schema_of_variant" not in found._jdf.queryExecution().optimizedPlan().toString().lower().replace(" ", "_")
    assert {(r["id"], r["path"], r["key"], r["value"]) for r in found.collect()} == {(1, "$.a.b[0]", None, "1"), (1, "$.a.b[1]", None, None), (1, "$.a.b[2].c", "c", "x"), (1, "$.d", "d", "true"), (3, "$", None, "7")}
