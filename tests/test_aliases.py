"""Aliases of facts: only keys that an id joins are walked."""

from ledgerloom.operators import facts


def test_only_joined_keys_are_walked(spark, monkeypatch):
    walked = []
    plain = facts.components
    monkeypatch.setattr(facts, "components", lambda edges, name: walked.append(edges.where("a <> b").distinct().count()) or plain(edges, name))
    versions = [(1, 10), (1, 20), (2, 20), (2, None), (3, 30), (4, 30), (5, 40), (6, None), (None, 50), (7, 25), (7, 10)]
    df = spark.createDataFrame(versions, "event_id long, physical long")
    got = {(r["event_id"], r["physical"], r["group"]) for r in facts.alias_groups(df, "event_id", "physical").collect()}
    assert got == {(1, 10, 10), (1, 20, 10), (2, 20, 10), (2, None, 10), (3, 30, 30), (4, 30, 30), (5, 40, 40), (7, 25, 10), (7, 10, 10)}
    assert walked == [2]
