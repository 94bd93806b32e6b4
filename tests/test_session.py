import os

from locavec.session import cut_lineage, scratch


def test_scratch_removes_what_was_written_inside(spark):
    kept = cut_lineage(spark.range(5), "kept")
    with scratch(spark) as outer:
        a = cut_lineage(kept, "a")
        with scratch(spark) as inner:
            assert cut_lineage(a, "b").count() == 5
        assert len(outer) == len(inner) == 1 and not os.path.exists(inner[0]) and os.path.exists(outer[0]) and a.count() == 5
    assert not os.path.exists(outer[0]) and kept.count() == 5 and not scratch._open
