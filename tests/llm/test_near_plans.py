"""No table that grows with the corpus goes through the driver."""

from folioscope.llm import _store, jaccard_join

from .test_small import components, near_copies, rows


def test_nothing_is_broadcast(spark, table, monkeypatch):
    plans = []
    pin = _store.pin

    def told(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return pin(df, *more)

    monkeypatch.setattr(_store, "pin", told)
    data = near_copies(8)
    found = jaccard_join.join(table(data))
    assert rows(found) == components(data)
    kept = jaccard_join.one_of_each(table(data))
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (found, kept)]
    assert any("SortMergeJoin" in x for x in plans)
    assert not [x for x in plans if "Broadcast" in x]
