import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from sketchloom.llm import minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in lower.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(30, 160))] for _ in range(12)]
    out = ["", "one two", "One  TWO", "a b c d e", "a b c d E", "   ", None and ""]
    for _ in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            b[rng.randrange(len(b))] = rng.choice(vocab)
        out.append(rng.choice(["\n", " ", "\t "]).join(b))
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


@pytest.mark.parametrize("seed", range(2))
def test_components_are_exact(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.digest(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_blocks_lose_nothing(spark, monkeypatch):
    rows = corpus(7)
    monkeypatch.setattr(minhash, "LIMIT", 7)  # many blocks for each group
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.digest(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_empty_blocks_lose_nothing(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for k in range(30):  # clusters of three make two blocks each, some with nothing in the second
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        rows += [(3 * k + j, " ".join([*words, *(f"end{j}{i}" for i in range(j))])) for j in range(3)]
    monkeypatch.setattr(minhash, "LIMIT_SHINGLES", 200)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.digest(frame(spark, rows)).collect()}
    assert got == brute(rows) and {c for _, c in got.values()} == set(range(0, 90, 3))
    sets = [np.arange(k, 100 + k, dtype=np.uint64).tobytes() for k in range(3)]
    for side in (1, 2):
        assert minhash.linked(85)(np.full(3, side), {"shingles": sets}) == []


def test_odd_rows(spark):
    text = " ".join(f"v{i}" for i in range(40))
    df = frame(spark, [(5, text), (5, text), (3, text + " end"), (9, None), (10, ""), (None, text), (None, "x y")])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.digest(df).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (9, 9, True), (10, 10, True), (None, 3, False), (None, None, True)], key=str)
    assert minhash.digest(frame(spark, [])).count() == 0
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["10", "3", "9", "None"]


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(4))
    batch = [(1, a), (2, a), (3, a + " end"), (4, b), (5, ""), (5, None)]
    rows = [*batch, *batch, (None, c), (None, c), (None, c + " end"), (None, b), (7, d), (7, d + " end")]
    df = frame(spark, rows)
    kept = minhash.deduplicated(df)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.schema == df.schema
    assert [x for x in got if x[0] not in (None, 7)] == sorted([(1, a), (4, b), (5, ""), (5, ""), (5, None), (5, None)], key=str)
    assert len([x for x in got if x[0] is None]) == 1 and len([x for x in got if x[0] == 7]) == 1
    assert {t for i, t in got if i is None} <= {c, c + " end"}


def test_columns_that_clash_and_repeated_rows(spark):
    text = " ".join(f"v{i}" for i in range(40))
    rows = [(None, text, "first")] * 500 + [(None, text, "second")] * 500 + [(1, text + " end", "third"), (2, "of its own kind it is", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string").selectExpr("*", "1 AS ID", "2 AS _hash", "3 AS comp", "4 AS fp")
    got = minhash.digest(df).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id != 2} == {1}
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.hash, r["_hash"]) for r in kept.collect()) == [(1, "third", 2), (2, "x", 2)]


def test_a_large_group_of_copies_costs_its_size(spark, monkeypatch):
    """Most copies are joined within blocks; only what isn't is compared with all."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    far = [*base[:100], *(f"y{i}" for i in range(100))]
    rows += [(1000 + i, " ".join([*far[:150], f"z{i}", *far[151:]])) for i in range(5)]
    monkeypatch.setattr(minhash, "LIMIT", 20)
    sizes, across = [], minhash.across

    def counted(members, key, joined, weigh):
        out = across(members, key, joined, weigh)
        sizes.append((members.where("blocks > 1").count(), 0 if out is None else out.count()))
        return out

    monkeypatch.setattr(minhash, "across", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.digest(frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert sizes[0][0] > 1000 and all(more <= 2 * members for members, more in sizes)


def test_whole_long_texts_are_hashed(monkeypatch):
    rng = random.Random(3)
    text = " ".join(f"é{rng.randrange(10**6)}" for _ in range(3000))
    whole = next(minhash.shingle_sets(pa.array([text])))
    monkeypatch.setattr(minhash, "SEGMENT", 500)
    parts = next(minhash.shingle_sets(pa.array([text])))
    assert (whole == parts).all() and len(whole) == len(shingles(text))
    several = list(minhash.shingle_sets(pa.array([text[:300], None, "", text, "a B"])))
    assert [len(s) for s in several] == [len(shingles(text[:300])), 0, 0, len(whole), 1]


def test_estimates_are_near():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.85, 0.95):
        a = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
        b = np.r_[a[: int(len(a) * share)], rng.integers(0, 1 << 63, len(a) - int(len(a) * share), dtype=np.uint64)]
        with np.errstate(over="ignore"):
            x, y = (np.frombuffer(minhash.signature(minhash.minima(np.unique(s))), dtype=np.uint64) for s in (a, b))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(float(minhash.similarity(minhash.equal_nibbles(x, y))) - true) < 0.2
    assert minhash.least_equal() < 0.85 * minhash.MINIMA
