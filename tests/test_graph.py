import random

import pytest

from sketchloom.operators import graph


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(max(a, b), min(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def found(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    n, edges = 80, random_edges(seed, 80, 50)
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert [got.get(i, i) for i in range(n)] == found(n, edges)


def test_a_path_and_no_edges(spark):
    edges = [(i + 1, i) for i in range(200)]
    random.Random(1).shuffle(edges)
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert set(got.values()) == {0} and len(got) == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_dedup_is_sequential(spark, seed):
    n, edges = 40, random_edges(seed + 10, 40, 70)
    ranks = list(range(1, n + 1))
    random.Random(seed).shuffle(ranks)
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    order = sorted(range(n), key=lambda i: ranks[i])
    greedy = {}
    for i in order:
        if i not in greedy:
            greedy[i] = i
            for j in near[i]:
                greedy.setdefault(j, i)
    clique = {}
    for i in order:
        if i in clique:
            continue
        clique[i], members = i, [i]
        for j in order:
            if j not in clique and all(j in near[m] for m in members):
                clique[j] = i
                members.append(j)
    r = spark.createDataFrame(list(enumerate(ranks)), "sample_id long, rank long")
    e = spark.createDataFrame(edges, "q long, r long")
    assert {x.sample_id: x.representative for x in graph.greedy(r, e).collect()} == greedy
    assert {x.sample_id: x.representative for x in graph.full_linkage(r, e).collect()} == clique


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_dedup_settles_long_paths(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    n = 2000 if one_task else 12
    r = spark.createDataFrame([(i, i + 1) for i in range(n)], "sample_id long, rank long")
    e = spark.createDataFrame([(i + 1, i) for i in range(n - 1)], "q long, r long")
    got = {x.sample_id: x.representative for x in graph.greedy(r, e, rounds=2).collect()}
    assert got == {i: i - i % 2 for i in range(n)}


def test_quality_order(spark):
    rows = [
        (0, False, True, 0.9, 100, 1, 10, 0.0, 50),
        (1, True, True, 0.5, 100, 1, 10, 0.0, 50),
        (2, True, True, 0.5, 100, 0, 10, 0.0, 50),
        (3, True, False, 0.9, 900, 1, 10, 0.0, 50),
        (4, True, True, 0.5, 100, 1, 10, float("nan"), 50),
        (5, True, True, 0.5, 100, 1, 10, 0.0, 60),
    ]
    s = spark.createDataFrame(rows, "sample_id long, meta_valid boolean, is_fasta boolean, asm_level double, total_length_bp long, record_count long, median_length_bp long, length_cv double, n_entries long")
    order = [x.sample_id for x in graph.quality_rank(s).orderBy("rank").collect()]
    assert order == [5, 1, 4, 2, 3, 0]


def test_cluster_numbers(spark):
    ranks = spark.createDataFrame([(0, 2), (1, 1), (2, 3), (3, 4)], "sample_id long, rank long")
    edges = spark.createDataFrame([(3, 1)], "q long, r long")
    got = {x.sample_id: (x.cluster_id, x.component_size, x.representative) for x in graph.clusters(ranks, edges).collect()}
    assert got == {0: ("cluster_000001", 1, 0), 1: ("cluster_000002", 2, 1), 3: ("cluster_000002", 2, 1), 2: ("cluster_000003", 1, 2)}


@pytest.mark.parametrize("seed, n, one_task", [(0, 300, 10**6), (1, 300, 10**6), (2, 300, 10**6), (3, 150, 1000), (4, 24, 0)])
def test_cliques_of_a_dense_component(spark, monkeypatch, seed, n, one_task):
    """More edges than an Arrow batch holds, or than a task may settle, in one component."""
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(seed)
    block = [rng.randrange(1 + n // 25) for _ in range(n)]
    pairs = {(i, j) for i in range(n) for j in range(i) if rng.random() < (0.97 if block[i] == block[j] else 0.3)}
    near = {i: {j for a, b in pairs for j in (a, b) if i in (a, b) and j != i} for i in range(n)}
    groups = []
    for i in range(n):
        own = next((g for g in groups if all(m in near[i] for m in g)), None)
        if own is None:
            groups.append([i])
        else:
            own.append(i)
    ranks = spark.createDataFrame([(1000 - i, i + 1) for i in range(n)], "sample_id long, rank int")
    edges = spark.createDataFrame([(1000 - i, 1000 - j) for i, j in pairs] + [(1000 - j, 1000 - i) for i, j in list(pairs)[:50]], "q long, r long")
    got = {r.sample_id: r.representative for r in graph.full_linkage(ranks, edges).collect()}
    assert len(pairs) > n * n // 9 and got == {1000 - i: 1000 - g[0] for g in groups for i in g}
