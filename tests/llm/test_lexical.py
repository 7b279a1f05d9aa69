import math
import re
from collections import Counter

from sketchloom.llm import lexical

DOCS = "doc_id long, text string, score string, H long"
ITEMS = "item_id long, text string, term string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, top=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    big_n, big_l = sum(s > 0 for s in sizes), sum(sizes)
    want = {}
    for i, t in items:
        want.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in want.items():
        scored = []
        for (d, b), n in zip(bags, sizes, strict=True):
            score = 0
            for w in own & b.keys():
                df = sum(w in x for _, x in bags)
                m = 50 + 50 * n * big_n // big_l
                score += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df + 1))) * (10**9 * b[w] // (1000 * b[w] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


TEXTS = ["The cat sat", "the CAT sat on the mat", "", None, "dog-dog dog É é", "x" * 5000 + " cat", "?!", "cat dog " * 3000, "Ünder the İstanbul 😀 mat 12"]


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "s", 1) for d, t in docs], DOCS).repartition(3), spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)


def test_against_brute_force(spark):
    docs = [(k, TEXTS[k % len(TEXTS)]) for k in range(60)] + [(3, "cat"), (3, "cat"), (None, "cat"), (None, "the mat")]
    items = [(1, "CAT!"), (2, "the dog on a mat"), (2, "é"), (3, "nothing"), (4, None), (None, "istanbul 😀 12"), (5, "")]
    d, i = frames(spark, docs, items)
    got = sorted(map(tuple, lexical.search(d, i, top=5).collect()), key=str)
    assert got == brute(docs, items, 5) and len({r[0] for r in got}) == 3
    # a block for each item or so gives the same
    assert sorted(map(tuple, lexical.search(d, i, top=5, many=2).collect()), key=str) == got


def test_large_classes_and_ties(spark):
    docs = [(1000 - k, "same words here") for k in range(300)] + [(k + 2000, f"same w{k}") for k in range(100)] + [(5000, "same"), (4999, "same")]
    items = [(7, "same"), (8, "words w5")]
    d, i = frames(spark, docs, items)
    got = sorted(map(tuple, lexical.search(d, i).collect()), key=str)
    assert got == brute(docs, items)
    assert [r[2] for r in sorted(got) if r[0] == 8][:3] == [2005, 701, 702]


def test_equal_hashes_do_not_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lexical.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    docs = [(k, f"a{k % 7} b{k % 5}") for k in range(40)]
    items = [(1, "a1 b2"), (2, "a3")]
    d, i = frames(spark, docs, items)
    assert sorted(map(tuple, lexical.search(d, i).collect()), key=str) == brute(docs, items)


def test_nothing(spark):
    d, i = frames(spark, [(1, "a")], [(1, "a")])
    for docs, items in ((d.where("false"), i), (d, i.where("false")), (d.where("false"), i.where("false"))):
        out = lexical.search(docs, items)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
