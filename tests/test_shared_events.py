"""Variants of certificates read events that are derived once."""

import shutil

from ledgerloom.plans import audit_catalogue


def test_events_are_derived_once(spark, tmp_path, monkeypatch):
    shutil.copyfile("/root/testdata/sf0.001/events.parquet", tmp_path / "events.parquet")
    calls, plain = [], audit_catalogue.events
    monkeypatch.setattr(audit_catalogue, "events", lambda *a: calls.append(a) or plain(*a))
    audit_catalogue._certified(spark, str(tmp_path), "causal")
    audit_catalogue._certified(spark, str(tmp_path), "window")
    assert len(calls) == 2  # for the events and for the seeds among them
