"""The driver holds nothing that grows with the input: joins of near-duplicate detection are merges, whatever the sizes."""

import pytest

from wanderlane.llm import components, simhash

TEXTS = ["one two three four five six", "one two three four five six", "seven eight nine ten eleven", "a b c d e f g h", None]


@pytest.mark.parametrize("job", [simhash.near_duplicates, simhash.keep_one])
def test_near_duplicates_broadcast_nothing(spark, monkeypatch, job):
    plans = []
    for module in (simhash, components):
        def noted(df, *args, cut=module.cut, **options):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return cut(df, *args, **options)

        monkeypatch.setattr(module, "cut", noted)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = job(docs)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == (5 if job is simhash.near_duplicates else 4)
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
