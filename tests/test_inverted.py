"""Older sketches: keys and k-mers, posting lists."""

import random
from collections import Counter

import numpy as np
import pytest

from sketchloom.operators import inverted
from sketchloom.operators.pairs import exact_overlap


def test_lists_round_trip():
    rng = np.random.default_rng(1)
    for ids in ([0], [inverted.CHUNK - 1], range(300), sorted(rng.choice(inverted.CHUNK, 900, replace=False).tolist()), [0, 65535]):
        raw = inverted.encoded(np.array(list(ids)))
        assert inverted.decoded(raw).tolist() == list(ids)
    assert len(inverted.encoded(np.arange(60_000))) == 60_001


@pytest.mark.parametrize("chunk", [1 << 16, 8])
def test_runs_merge_and_counts_equal_overlaps(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(inverted, "CHUNK", chunk)
    monkeypatch.setattr(inverted, "PAIRS", 50)
    rng = random.Random(chunk)
    rows = [(s, k) for s in range(-9, 40) for k in rng.sample(range(30), rng.randrange(12))] + [(s, 7) for s in range(40)] + [(3, 5), (3, 5), (None, 1), (4, None)]
    df = spark.createDataFrame(rows, "sample_id long, key long")
    path = str(tmp_path / "store")
    for run, some in enumerate(("sample_id < 5", "sample_id >= 5 AND sample_id < 20", "sample_id >= 3")):
        inverted.append(path, df.where(some), run)
        inverted.append(path, df.where(some), run)  # a repeated batch
    want = {tuple(r) for r in df.where("sample_id IS NOT NULL AND key IS NOT NULL").distinct().collect()}
    whole = inverted.merged(spark, path, str(tmp_path / "one"))
    assert {(r.sample_id, r.key) for r in inverted.listed(inverted.read(spark, path)).collect()} == want
    assert {(r.sample_id, r.key) for r in inverted.listed(whole).collect()} == want and whole.groupBy("key", "chunk").count().where("count > 1").count() == 0
    df = df.where("sample_id IS NOT NULL AND key IS NOT NULL")
    pairs = {tuple(r) for r in exact_overlap(df, keys=("key",)).collect()}
    assert {tuple(r) for r in inverted.shared_counts(whole).collect()} == pairs
    assert {tuple(r) for r in inverted.shared_counts(inverted.read(spark, path)).collect()} == pairs
    few = df.where("sample_id % 3 = 0")
    got = inverted.shared_counts(inverted.postings(few), whole)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in exact_overlap(few, df, ("key",)).collect()}
    assert inverted.shared_counts(inverted.postings(df.where("false")), whole).count() == 0


@pytest.mark.parametrize(("half", "sub", "level"), [(6, 3, 1), (4, 4, 2), (15, 3, 2)])
def test_keys_go_back_to_kmers(spark, half, sub, level):
    layout = inverted.SubcontextLayout(half, sub, level)
    rng = np.random.default_rng(half)
    places = rng.permutation(16**sub)
    seqs = ["".join(rng.choice(list("ACGTN"), p=[0.249] * 4 + [0.004], size=3000)) for _ in range(3)] + ["ACG", ""]
    records = spark.createDataFrame(list(enumerate(seqs)), "sample_id long, seq string")
    table = spark.createDataFrame([(i, int(p)) for i, p in enumerate(places)], "inner long, place long")
    got = Counter((r.sample_id, r.kmer) for r in inverted.reversed_kmers(inverted.keyed(records, layout, places), layout, table).collect())
    want, pair = Counter(), str.maketrans("ACGT", "TGCA")
    for i, s in enumerate(seqs):
        for at in range(len(s) - 2 * half + 1):
            k = s[at : at + 2 * half]
            if "N" not in k:
                k = min(k, k[::-1].translate(pair))
                inner = 0
                for c in k[half - sub : half + sub]:
                    inner = 4 * inner + "ACGT".index(c)
                if places[inner] < 16 ** (sub - level):
                    want[i, k] += 1
    assert got == want and len(want) > 5
    with pytest.raises(ValueError):
        inverted.keyed(records, layout, places % 7)
    with pytest.raises(ValueError):
        inverted.SubcontextLayout(4, 5, 1)


@pytest.mark.parametrize("busy", [2048, 10])
def test_far_ids_and_keys_of_many_samples(spark, monkeypatch, busy):
    """Ids that doubles can't tell apart, runs that overlap, and keys that are met by blocks."""
    monkeypatch.setattr(inverted.meets, "BUSY", busy)
    monkeypatch.setattr(inverted, "PAIRS", 7)
    rng = random.Random(busy)
    ids = [(1 << 60) + 65_530 + i for i in range(20)] + [-(1 << 60) - i for i in range(20)] + list(range(5))
    rows = [(s, k) for s in ids for k in rng.sample(range(40), 6)] + [(s, 99) for s in ids]
    df = spark.createDataFrame(rows, "sample_id long, key long")
    lists = inverted.postings(df).unionByName(inverted.postings(df.where("sample_id > 0")))
    assert {tuple(r) for r in inverted.listed(lists).collect()} == set(rows)
    want = {tuple(r) for r in exact_overlap(df, keys=("key",)).collect()}
    assert sorted(map(tuple, inverted.shared_counts(lists).collect())) == sorted(want)
    few = df.where("key % 2 = 1")
    got = sorted(map(tuple, inverted.shared_counts(inverted.postings(few), lists).collect()))
    assert got == sorted(map(tuple, exact_overlap(few, df, ("key",)).collect()))
