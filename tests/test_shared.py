"""Tables in the shared folder, and their removal."""

from __future__ import annotations

import os

from strataloom.sources.shared import MADE, release, written


def test_only_tables_that_are_not_read_go(spark):
    before = len(MADE)
    one, two = written(spark.range(5), "one"), written(spark.range(7), "two")
    folders = MADE[before:]
    assert len(folders) == 2
    kept = release(spark, folders, two.filter("id > 3"))
    assert kept == folders[1:] and two.count() == 7
    assert [os.path.exists(f.removeprefix("file:")) for f in folders] == [False, True]
    assert release(spark, kept, spark.range(1)) == [] and not os.path.exists(folders[1].removeprefix("file:"))
