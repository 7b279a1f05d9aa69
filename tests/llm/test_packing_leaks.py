import random
import re

import numpy as np
import pytest

from sketchloom.llm import decontaminate, packing

DOCS = "doc_id long, text string, lang string"
tokenizer = pytest.mark.skipif(not __import__("os").path.exists(packing.VOCABULARY), reason="no vocabulary here")


def edit(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        last, row[0] = row[0], i + 1
        for j, d in enumerate(text):
            last, row[j + 1] = row[j + 1], min(last + (c != d), row[j + 1] + 1, row[j] + 1)
    return min(row), row.index(min(row))


def test_myers_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        p, t = "".join(rng.choices("abc", k=rng.randint(1, 70))), "".join(rng.choices("abc", k=rng.randint(0, 90)))
        assert decontaminate.myers(p, t) == edit(p, t)


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghéß", k=rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(8)] + [(8, "Ab"), (9, ""), (10, None)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.randint(0, 80))]
        if d % 2:
            x = list(rng.choice(items[:8])[1])
            for _ in range(rng.randint(0, 2 + len(x) // 14)):
                x[rng.randrange(len(x))] = rng.choice("xyz")
            text.insert(rng.randint(0, len(text)), "".join(x).upper())
        docs.append((d, rng.choice([" ", "\n", "  "]).join(text), "en"))
    docs += [(100, None, "en"), (101, "", "en"), (None, items[0][1], "en"), (7, docs[7][1], "en")]
    want = []
    for d, t, _ in docs:
        n = decontaminate.normal(t)
        for i, x in items:
            p = decontaminate.normal(x)
            if p and n:
                far, _ = edit(p, n)
                if far <= int(len(p) * decontaminate.RATE):
                    want.append((d, i, far))
    df = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(df, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 15
    bad = {d for d, *_ in want}
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, *_ in docs} - bad
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(df, none).count() == 0 and decontaminate.clean(df, none).count() == len(docs)
    assert decontaminate.leaks(df.limit(0), bench).count() == 0


def test_one_word_replaced(spark):
    rng = random.Random(9)
    word = lambda low=2, high=12: "".join(rng.choices("abcdefgh", k=rng.randint(low, high)))
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 20)))) for i in range(60)]
    docs, want = [], set()
    for d in range(500):
        x = rng.choice(items)[1].split(" ")
        k = rng.randrange(len(x))
        x[k : k + 1] = rng.choice([[], [word(1, 30)], [word(9, 30)], [word(), word()]])
        around = [word() for _ in range(6)]
        docs.append((d, " ".join([*around[: rng.randint(0, 3)], *x, *around[3 : rng.randint(3, 6)]]), "en"))
    for d, text, _ in docs:
        for i, x in items:
            budget, at, cut = int(len(x) * decontaminate.RATE), 0, []
            for w in x.split(" "):
                if budget and len(w) <= len(x) / 5:
                    before, after = re.escape(x[:at].rstrip(" ")), re.escape(x[at + len(w) + 1 :])
                    cut.append(before + after if not before or not after else before + r" (?:[^ ]+ )?" + after)
                at += len(w) + 1
            if decontaminate.myers(x, text)[0] <= budget or any(re.search(c, text) for c in cut):
                want.add((d, i))
    got = {(d, i) for d, own in enumerate(decontaminate.Scanner(items).matches([t for _, t, _ in docs])) for i, *_ in own}
    assert got == want and len(want) > 100
    item = "the committee considered internationalisation of the programme for all of its members in spring"
    df = spark.createDataFrame([(1, f"so {item.replace('internationalisation', 'abandonment')} ."), (2, item[: len(item) // 2])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item.replace("internationalisation", "standardisation"))], "item_id long, text string")
    assert [(r.doc_id, r.distance) for r in decontaminate.leaks(df, bench).collect()] == [(1, edit(bench.first().text, df.first().text)[0])]
    assert [r.doc_id for r in decontaminate.clean(df, bench).collect()] == [2]


def test_best_fit_is_the_fullest_row():
    rng = random.Random(1)
    lengths = [rng.randint(1, 50) for _ in range(400)]
    rows, room = [], []
    for i in sorted(range(400), key=lambda i: (-lengths[i], i)):
        fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
        if fits:
            least = min(r for r, _ in fits)
            room[[k for r, k in fits if r == least][0]] -= lengths[i]
        else:
            room.append(50 - lengths[i])
    rows = packing.best_fit(lengths, 50)
    assert sorted(50 - sum(lengths[i] for i in r) for r in rows) == sorted(room)
    assert sorted(i for r in rows for i in r) == list(range(400)) and packing.best_fit([], 50) == []
    with pytest.raises(ValueError):
        packing.best_fit([51], 50)


@tokenizer
def test_packing_round_trip(spark):
    rng = random.Random(2)
    texts = ["", None, " lead", "a  b", "x \n y", "trail ", "it's  's", "\n w  z", "word " * 5000, "é\u00a0x \u2003y", "日本 語"] + [" ".join("".join(rng.choices("abcde,.\n", k=5)) for _ in range(rng.randint(1, 400))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.pack(df, size=256, shard_tokens=3000).collect()
    e = packing.Encoder(packing.driver_file(packing.VOCABULARY))
    got = packing.unpack(rows)
    assert got == {i: [*e.bpe.encode_ordinary(t or ""), e.end] for i, t in enumerate(texts)}
    for r in rows:
        assert r.n_tokens == r.cu_seqlens[-1] <= 256 and r.position_resets == r.cu_seqlens[:-1] and len(r.ids) == 2 * r.n_tokens
        p = packing.position_ids(r)
        assert all(p[a] == 0 for a in r.position_resets) and (np.diff(p) <= 1).all()
    assert packing.id_matrix(rows, 256).shape == (len(rows), 256)
    assert packing.pack(df.limit(0)).count() == 0


def test_long_texts_clashing_columns_and_parts(spark, monkeypatch):
    rng = random.Random(12)
    filler = " ".join("".join(rng.choices("klmnop", k=6)) for _ in range(200_000))  # over a segment
    items = [(i, " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(12))) for i in range(5)]
    rows = [(1, filler + " " + items[0][1]), (2, filler), (3, items[4][1].upper() + "\t" + filler), (3, items[4][1].upper() + "\t" + filler), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'a' AS item_id", "*", "1 AS distance", "2 AS Keep")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 AS doc_id")
    assert len(filler) > decontaminate.SEGMENT
    for size in (decontaminate.MAX_CHARS, 100):  # one part, and a part for each item
        monkeypatch.setattr(decontaminate, "MAX_CHARS", size)
        assert sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(df, bench).collect()) == [(1, 0, 0), (3, 4, 0), (3, 4, 0)]
        kept = decontaminate.clean(df, bench)
        assert kept.columns == df.columns and sorted((str(r.doc_id), r["item_id"], r["Keep"]) for r in kept.collect()) == [("2", "a", 2), ("None", "a", 2)]


@tokenizer
def test_packing_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string").selectExpr("3 AS shard", "*", "4 AS ids").repartition(1)
    rows = packing.pack(df, size=8).collect()
    e = packing.Encoder(packing.driver_file(packing.VOCABULARY))
    pieces = sorted((str(d), np.frombuffer(r.ids, dtype="<u2")[a:b].tolist()) for r in rows for d, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:], strict=False))
    assert pieces == sorted((str(d), [*e.bpe.encode_ordinary(t or ""), e.end]) for d, t in ((1, "a b"), (1, "a b"), (None, "c"), (None, None)))


def test_repeated_items_count_once(spark):
    docs = spark.createDataFrame([(1, "so the quick brown fox jumps over it"), (2, "xx abc def yy"), (3, "nothing")], "doc_id long, text string")
    items = [(1, "the quick brown fox jumps"), (1, "the quick brown fox jumps"), (1, "quick brown fox jumped over"), (2, "abc def"), (None, "xx"), (None, "abc")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(docs, bench).collect()), key=str)
    assert got == [(1, 1, 0), (2, 2, 0), (2, None, 0)]
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(docs, bench.unionByName(bench)).collect()), key=str) == got


def test_short_pieces_by_the_automaton():
    rng = random.Random(4)
    items = [(i, " ".join("".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    texts = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    scan = decontaminate.Scanner(items)
    got = {(t, i) for t, own in enumerate(scan.matches(texts)) for i, *_ in own}
    want = {(t, i) for t, text in enumerate(texts) for i, x in items if decontaminate.myers(x, text)[0] <= int(len(x) * decontaminate.RATE)}
    # a word of a short item may also be another one, which the edits don't say
    assert scan.short and want <= got and {(t, i) for t, i in got if int(len(items[i][1]) * decontaminate.RATE) == 0} <= want


def test_parts_are_written_between(spark, monkeypatch):
    rows = [(i, f"text {i} holds item number {i % 7} here") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, Text string").withColumnRenamed("doc_id", "doc.id").selectExpr("`doc.id`", "Text", "1 AS doc_id")
    bench = spark.createDataFrame([(i, f"item number {i} here") for i in range(4)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "MAX_CHARS", 20)
    kept = decontaminate.clean(df, bench)
    assert kept.columns == ["doc.id", "Text", "doc_id"] and sorted(r[0] for r in kept.collect()) == [i for i in range(30) if i % 7 > 3]
    assert kept._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("MapInArrow") == 1
