"""Owners of keys after batches."""

import random
from collections import defaultdict

from sketchloom.streaming import markers

SCHEMA = "sample_id long, ctx long, obj long"


def test_batches_equal_one_pass(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted({(s, rng.randrange(40), rng.randrange(3)) for s in range(12) for _ in range(15)})
    path = str(tmp_path / "store")
    assert markers.owners(spark, path).count() == 0 and markers.merge(spark, path) is None
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    for batch in range(4):
        own = [r for r in rows if r[0] % 4 == batch]
        markers.add(path, frame(own + own[:3] + [(None, 1, 1), (1, None, 1)]), batch, 8)
        if batch == 2:
            markers.add(path, frame(own), batch, 8)  # repeated
            assert markers.merge(spark, path, 8) == 2
        seen = [r for r in rows if r[0] % 4 <= batch]
        keys, ctxs = defaultdict(set), defaultdict(set)
        for s, c, o in seen:
            keys[c, o].add(s)
            ctxs[c].add(s)
        state = markers.owners(spark, path)
        assert {(r.ctx, r.obj, r.sample_id) for r in markers.unique_keys(state).collect()} == {(*k, *v) for k, v in keys.items() if len(v) == 1}
        assert {(r.ctx, r.sample_id) for r in markers.unique_owners(state).collect()} == {(k, *v) for k, v in ctxs.items() if len(v) == 1}
        assert state.count() == len(keys)
    some = markers.owners(spark, path, buckets=[1, 5])
    assert {r.bucket for r in some.collect()} <= {1, 5} and "PartitionFilters: [bucket" in some._jdf.queryExecution().toString()
    assert not (tmp_path / "store/batch=0").exists() and (tmp_path / "store/base=2").exists()
