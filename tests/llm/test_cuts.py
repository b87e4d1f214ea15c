"""What the cuts between jobs leave on disk."""

from __future__ import annotations

import time

from tessella.llm import common


def test_cuts_leave_no_shuffle_files(spark):
    def files() -> set[str]:
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    before, set_before = files(), spark.conf.get(common.CLEANUP, None)
    dealt = spark.range(200_000).repartition(3, "id")
    made = common.cut(dealt.groupBy((dealt.id % 7).alias("k")).count(), "dealt")
    for _ in range(40):  # they are removed beside what follows
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before
    assert spark.conf.get(common.CLEANUP, None) == set_before
    assert made.count() == 7
