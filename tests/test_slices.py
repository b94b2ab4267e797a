"""Batches are parsed in slices."""

from __future__ import annotations

import pyarrow as pa

from strataloom.operators import documents


def test_slices_make_the_whole_batch():
    batch = pa.RecordBatch.from_pydict({"n": list(range(300))})
    got = [b.column("n").to_pylist() for b in documents.sliced(iter([batch, batch.slice(0, 0), batch.slice(0, 1)]))]
    assert [len(x) for x in got] == [128, 128, 44, 1]
    assert sum(got, []) == [*range(300), 0]
