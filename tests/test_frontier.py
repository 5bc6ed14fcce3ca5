"""Expansion level by level: both joins, limits inside the loop, runs that are cut off."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import frontier
from ledgerloom.plans import collect_catalogue
from ledgerloom.plans.catalogue import WINDOW
from ledgerloom.sources.derived import transfers
from ledgerloom.sources.shared import Run, digest_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    t = transfers(spark, SF)
    seeds = t.where("success and sender <> recipient and amount_raw > 0 and event_id % 10 = 0")
    return t, seeds


def ids(df):
    return sorted(map(tuple, df.select("level", "event_id").collect()))


def service(account):
    return account % 10 == 3


def test_both_joins_find_the_same(given):
    t, seeds = given
    small, large = (frontier.trace(t, seeds, 3, WINDOW, service, most=m) for m in (frontier.BROADCAST, 0))
    assert ids(small) == ids(large) and max(level for level, _ in ids(small)) == 3
    cut = [frontier.trace(t, seeds, 3, WINDOW, service, scope_end=1_704_500_000, most=m) for m in (frontier.BROADCAST, 0)]
    assert ids(cut[0]) == ids(cut[1]) and len(ids(cut[0])) < len(ids(small))


def test_no_seeds_no_states(given):
    t, seeds = given
    for most in (frontier.BROADCAST, -1):
        assert ids(frontier.trace(t, seeds.where("event_id < 0"), 2, WINDOW, service, most=most)) == []


def test_a_run_goes_on_where_it_was_cut_off(spark, given, monkeypatch):
    t, seeds = given
    key = f"test|{digest_of(spark, SF)}"
    Run(spark, key).drop()
    whole, calls, was = ids(frontier.trace(t, seeds, 3, WINDOW, service)), [], frontier.successors

    def dies(*args):
        calls.append("died")
        if len(calls) == 2:
            raise RuntimeError("the driver is gone")
        return was(*args)

    monkeypatch.setattr(frontier, "successors", dies)
    with pytest.raises(RuntimeError):
        frontier.trace(t, seeds, 3, WINDOW, service, run=Run(spark, key))
    assert Run(spark, key).finished() == ["level-0", "level-1"]
    monkeypatch.setattr(frontier, "successors", lambda *args: calls.append("again") or was(*args))
    assert ids(frontier.trace(t, seeds, 3, WINDOW, service, run=Run(spark, key))) == whole
    assert calls == ["died", "died", "again", "again"]  # levels 2 and 3 only
    assert ids(frontier.trace(t, seeds, 3, WINDOW, service, run=Run(spark, key))) == whole and len(calls) == 4
    Run(spark, key).drop()
    assert Run(spark, key).finished() == []


def test_a_digest_tells_changed_inputs(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    first = digest_of(spark, str(tmp_path))
    assert first == digest_of(spark, str(tmp_path))
    (tmp_path / "a").write_text("12")
    assert first != digest_of(spark, str(tmp_path))


def test_limits_end_the_expansion(spark, given):
    """The kept states are those of the whole expansion; a query at its limit has no edge beyond that level."""
    t, seeds = given
    seeds = seeds.withColumn("query_id", F.col("event_id") % 7)
    registry, most = collect_catalogue.registry(spark, SF), (6, 4)
    kept = lambda states: sorted(map(tuple, frontier.limited(states, *most).where("not cut").select("query_id", "level", "event_id").collect()))
    whole, edges = frontier.collect(t, seeds, registry, 3, WINDOW, collect_catalogue.SCOPE_END)
    cut, fewer = frontier.collect(t, seeds, registry, 3, WINDOW, collect_catalogue.SCOPE_END, budget=most)
    assert kept(whole) == kept(cut) and fewer.count() < edges.count()
    states = [(r.query_id, r.level, r.recipient) for r in cut.collect()]
    for query, level in {(r.query_id, r.level) for r in fewer.collect()}:
        before = [a for q, d, a in states if q == query and d < level]
        assert len(before) < most[0] and len(set(before)) < most[1]
