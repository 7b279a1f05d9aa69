import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


def mixed_rows():
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 300)) + [str(i)]), f"s{i % 3}" if i % 7 else None) for i in range(300)]
    return [*rows, (900, None, "s0"), (901, "", "s1"), (None, "no id here", "s1"), (5, rows[5][1], "s2"), (902, " ".join(["long"] * 9000), "s9")]


def test_shards(spark):
    rows = mixed_rows() + [(2000 + i, "copy of one text", "s") for i in range(60)]
    got = sharding.digest(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots, load, shard_of = defaultdict(list), Counter(), defaultdict(set)
    text = defaultdict(set)
    for i, t, _ in rows:
        text[i].add(t)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        if r.doc_id is not None and len(text[r.doc_id]) == 1:
            shard_of[next(iter(text[r.doc_id]))].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert all(len(s) == 1 for s in shard_of.values())  # equal texts stay together
    assert max(load.values()) < 9000 * 5 + 1 + 1.2 * sum(load.values()) / 8
    assert sharding.digest(docs(spark, [])).count() == 0


def test_shards_are_even(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(10, 3000)) + str(i), "s") for i in range(3000)]
    load = Counter()
    for r in sharding.assign(docs(spark, rows), bucket_groups=500).collect():
        load[r.shard] += r.size
    assert max(load.values()) <= 1.01 * min(load.values())


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "y" * 100, "s") for i in range(400)] + [(1000 + i, "z" * 100 + str(i), "s") for i in range(400)]
    load = Counter()
    for r in sharding.assign(docs(spark, rows)).collect():
        load[r.shard] += r.size
    assert max(load.values()) <= 1.1 * min(load.values())


def test_placement_by_brute_force(spark):
    """Largest group first, each where the dot product with the room left is highest, one shard after another."""
    rng = np.random.default_rng(5)
    texts = [("word " * int(rng.integers(1, 60)) + str(k)) for k in range(400)]
    rows = [(i, texts[int(rng.integers(0, 400))], "s") for i in range(1000)] + [(None, None, None), (2000, "", "s"), (2000, "", "s")]
    got = sharding.assign(docs(spark, rows), shards=3, bucket_groups=10_000).collect()
    groups = defaultdict(lambda: np.zeros(3))
    for _, t, _ in rows:
        groups[None if t is None else t] += [len((t or "").encode()) + 1, len((t or "").split()), 1]
    key = lambda t: b"" if t is None else hashlib.md5(t.encode()).digest()
    totals = sum(groups.values())
    large = {t for t, v in groups.items() if (v > totals / (3 * 64)).any()}
    assert 0 < len(large) < len(groups)
    room, shard = np.full((3, 3), 1 / 3), {}
    for t in sorted(large, key=lambda t: (-(groups[t] / totals).max(), key(t))):
        v = groups[t] / totals
        shard[t] = int(np.argmax([sum(r * v * [4, 1, 1]) for r in room]))
        room[shard[t]] -= v
    room = np.maximum(room, 0) / np.maximum(room, 0).sum(axis=0)
    rest = {t: v for t, v in groups.items() if t not in large}
    inside = sum(rest.values())
    for t in sorted(rest, key=lambda t: (-(rest[t] / inside).max(), key(t))):
        v = rest[t] / inside
        shard[t] = int(np.argmax([sum(r * v * [4, 1, 1]) for r in room]))
        room[shard[t]] -= v
    crc = {zlib.crc32((t or "").encode()): s for t, s in shard.items() if t}
    assert all(r.shard == crc[r.text_crc32] for r in got if r["size"] > 1)


def test_hot_groups_without_ids(spark):
    rows = [(None, "same text", "s")] * 3000 + [(7, "another", "s")] * 2000 + [(i, f"text {i}", "s") for i in range(1000)]
    df = docs(spark, rows).repartition(5).withColumns({"Shard_": F.lit(1), "key": F.lit("k"), "Parts": F.lit(2)})
    got = sharding.assign(df, shards=4, bucket_groups=100).collect()
    assert len(got) == len(rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert max(load.values()) <= 1.02 * min(load.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_written_shards(spark, tmp_path):
    rows = mixed_rows() + [(None, "same", "s")] * 900
    df = docs(spark, rows).withColumns({"SHARD": F.lit(5), "key": F.lit("k")})
    sharding.write(df, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns[:-1] == df.columns and back.columns[-1] == "_shard"
    assert Counter((r.doc_id, r.text, r.source) for r in back.collect()) == Counter(rows) and back.select("_shard").distinct().count() == 3
    sharding.write(df.limit(0), str(tmp_path / "none"))


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == [20, Fraction(50, 3), Fraction(25, 3)]
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []
    t = mixing.targets([100, 1, 50, 7], [5, 2, 1, 5])
    assert sum(t) == Fraction(3, 2) * 158 and all(a <= 2 * b for a, b in zip(t, [100, 1, 50, 7], strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutations(n):
    for key in range(3):
        got = mixing.permute(np.arange(n), np.full(n, n), mixing.epoch_key(1, key, np.zeros(n)))
        assert sorted(got.tolist()) == list(range(n))
    if n == 1000:
        assert (mixing.permute(np.arange(n), np.full(n, n), mixing.epoch_key(1, 2, np.zeros(n))) != np.arange(n)).mean() > 0.9


def test_draws_are_exact_and_mixed():
    slots = np.array([5000, 2000, 999])
    whole = list(mixing.shards_of(slots, 0, 16, shard_slots=500))
    counts = np.stack([own for *_, own in whole])
    assert [s for s, *_ in whole] == list(range(16)) and counts.sum(axis=0).tolist() == slots.tolist()
    assert counts.sum(axis=1).tolist() == [500] * 15 + [499] and (counts[:-1, 0] > 250).all() and len({tuple(c) for c in counts.tolist()}) > 8
    assert all((first == counts[:s].sum(axis=0)).all() for s, first, _ in whole)
    parts = [x for low in range(0, 16, 3) for x in mixing.shards_of(slots, low, low + 3, shard_slots=500)]
    assert all(a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(whole, parts, strict=True))
    assert list(mixing.shards_of(np.array([0, 0]), 0, 16)) == []


def test_slots_by_brute_force(spark):
    """Slots, blocks, documents and texts again, one after another."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"{i}w{k}" for k in range(int(rng.integers(0, 40)))), f"s{i % 3}") for i in range(60)]
    df, block = docs(spark, rows), 8
    got = mixing.blocks(df, block=block, shard_slots=20).collect()
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values()) and all(len(p) == 20 for s, p in by_shard.items() if s < max(by_shard))
    place = {(r.src, r.doc_id): r.start for r in mixing.mix(df.select("doc_id", "source", "text"), block=block).docs.collect()}
    sizes = [sum(len(t.split()) for _, t, s in rows if s == f"s{i}") for i in range(3)]
    goal = mixing.targets(sizes, [5, 2, 1])
    for i in range(3):
        words = [""] * sizes[i]
        for d, t, s in rows:
            if s == f"s{i}" and t:
                words[place[i, d] : place[i, d] + len(t.split())] = t.split()
        q = mixing.quota(sizes[i], goal[i], i, block)
        want = Counter()
        for slot in range(q.slots):
            key = mixing.epoch_key(mixing.SEED, i, np.array([slot // q.blocks]))
            at = int(mixing.permute(np.array([slot % q.blocks]), np.array([q.blocks]), key)[0])
            own = words[at * block : (at + 1) * block]
            want[" ".join(own[: len(own) - (q.cut if slot == q.slots - 1 else 0)])] += 1
        assert Counter(" ".join(r.text.split()) for r in got if r.source == f"s{i}") == want and sum(want.values()) == q.slots
    assert len({r.source for r in got if r.shard == 0}) == 3  # shards are mixtures


def test_rows_keep_their_own_columns(spark):
    rows = [(1, "a b c", "s", "first", 1), (1, "a b c", "s", "second", 1), (1, "a b c", "s", "second", 1), (None, "d", None, None, None), (2, None, "s", "none", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string, `words` int").selectExpr("*", "map('k', key) AS hash", "7 AS `_key`", "8 AS `Shard`")
    out = mixing.mixed_documents(df, weights=(1,), share=Fraction(2))
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text, r.key, r.words, r.hash["k"] if r.key else None, r["_key"], r["Shard"]) for r in out.collect()) == Counter({(1, "a b c", "first", 1, "first", 7, 8): 2, (1, "a b c", "second", 1, "second", 7, 8): 4, (None, "d", None, None, None, 7, 8): 2})
    assert mixing.mixed_documents(df.limit(0)).count() == 0 and mixing.blocks(df.limit(0)).count() == 0


def test_mixture(spark):
    rows = mixed_rows()
    got = mixing.digest(docs(spark, rows)).collect()
    size = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(size(t) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(sizes, mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r["size"] and r.target == float(want[r.source_size])
        taken[r.source_size] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes if s)
    again = mixing.digest(docs(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.digest(docs(spark, [])).count() == 0


def test_mixed_documents_hold_what_was_taken(spark):
    df = docs(spark, mixed_rows())
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in mixing.digest(df).collect():
        want[r.doc_id] += r.taken
    assert +words == +want


def test_cutting_words():
    assert mixing.cut_words("a\tb  c d", [(0, 4)]) == "a\tb  c d"
    assert mixing.cut_words("a\tb  c d", [(0, 2), (3, 4)]) == "a\tb\nd" and mixing.cut_words("a b  c", [(2, 3), (1, 2)]) == "b  c"
