import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sketchloom.llm import langid, minhash, mixing, packing
from sketchloom.llm.decontaminate import normal
from sketchloom.session import materialize
from tests.llm.test_minhash import shingles
from tests.llm.test_models import fused, sentence
from tests.llm.test_packing_leaks import edit

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(packing.VOCABULARY)), reason="no test tables or vocabulary here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
        if name == "near-duplicates":
            assert minhash.digest(docs).where("NOT kept").count() == 0
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and docs.columns[0] == "shard"
    known = {r.doc_id for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert set(packing.unpack(docs.collect())) == known


def test_near_copies_at_four_fifths(spark):
    rng = random.Random(5)
    rows = []
    for k in range(30):  # a text and a copy with a new word inside, of similarity 0.72 to 0.92
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(34, 120))]
        other = list(words)
        other[len(words) // 2] = "new"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    shingles = {i: {tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for i, t in rows}
    same = {i: len(shingles[i] & shingles[i + 1]) / len(shingles[i] | shingles[i + 1]) for i in range(0, 60, 2)}
    assert any(0.8 <= s < 0.85 for s in same.values()) and any(s < 0.8 for s in same.values())
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, "").collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or same[i - 1] < 0.8}


def planted(rng):
    """Documents with copies, near copies, leaks and junk, and the benchmark."""
    items = [(i, " ".join(f"{sentence(rng, 'en', 1)}{rng.randrange(1000)}" for _ in range(14))) for i in range(6)]
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "en", "de", "fr"])
        rows.append((i, sentence(rng, lang, rng.randint(30, 90)), lang, f"src{rng.randrange(4)}"))
    for i in range(90, 100):
        words = rows[i - 80][1].split()
        words[rng.randrange(len(words))] = "changed" if i % 2 else words[0]
        rows.append((i, " ".join(words), rows[i - 80][2], "src1"))
    rows += [(100 + i, rows[i][1].replace(" ", "  "), rows[i][2], "src2") for i in range(8)]
    rows += [(110 + i, f"{rows[30 + i][1]} {items[i][1].upper()} {sentence(rng, 'en', 9)}", "en", "src3") for i in range(6)]
    rows += [(120 + i, "".join(rng.choices("qxzjkwvbpf", k=300)), None, "src0") for i in range(4)] + [(130, None, "en", "src0"), (131, "", None, None)]
    return rows, items


def test_every_stage_by_brute_force(spark, tmp_path):
    rng = random.Random(21)
    rows, items = planted(rng)
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), "test")
        results[name] = docs.collect()

    # language: the fusion row by row; all rows are in the models' sample, so none declares anything
    model = langid.fit(spark.read.parquet(str(tmp_path / "documents.parquet")))
    said = [kind if p >= 0.5 else "und" for kind, p in fused([(t, None, s, "") for _, t, _, s in rows], model)]
    left = [r for r, kind in zip(rows, said, strict=True) if kind != "und"]
    assert [r.doc_id for r in sorted(results["language"], key=lambda r: r.doc_id)] == [i for i, *_ in left] and not {120, 130, 131} & {i for i, *_ in left}
    # near-duplicates: all pairs, smallest id of each component
    sets = {i: shingles(t) for i, t, *_ in left}
    comp = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    left = [r for r in left if comp[r[0]] == r[0]]
    assert {r.doc_id for r in results["near-duplicates"]} == {i for i, *_ in left} and len(left) < len(sets)
    # decontamination: every item against every text
    clean = lambda t: all(edit(normal(x), normal(t))[0] > len(normal(x)) * 0.05 for _, x in items)
    left = [r for r in left if clean(r[1])]
    assert {r.doc_id for r in results["decontamination"]} == {i for i, *_ in left} and not {i for i, *_ in left} & set(range(110, 116))
    # mixing: every slot's block, from each source's words in their order
    df = spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in left], "doc_id long, text string, lang string, source string, n_chars long")
    place = {r.doc_id: (r.src, r.start) for r in mixing.mix(df).docs.collect()}
    names = sorted({s for *_, s in left})
    sizes = [sum(len(t.split()) for _, t, _, s in left if s == n) for n in names]
    taken = defaultdict(set)
    for k, goal in enumerate(mixing.targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])):
        q = mixing.quota(sizes[k], goal, k)
        for slot in range(q.slots):
            epoch = slot // q.blocks
            at = int(mixing.permute(np.array([slot % q.blocks]), np.array([q.blocks]), mixing.epoch_key(mixing.SEED, k, np.array([epoch])))[0])
            stop = min((at + 1) * mixing.BLOCK, sizes[k]) - (q.cut if slot == q.slots - 1 else 0)
            for i, t, _, s in left:
                first = place[i][1]
                if s == names[k]:
                    taken[i, epoch] |= {w - first for w in range(max(first, at * mixing.BLOCK), min(first + len(t.split()), stop))}
    text = {i: t for i, t, *_ in left}
    want = sorted((i, " ".join(text[i].split()[w] for w in sorted(own))) for (i, _), own in taken.items() if own)
    assert sorted((r.doc_id, " ".join(r.text.split())) for r in results["mixing"]) == want
    # packing: every text's ids once
    enc = packing.Encoder(packing.driver_file(packing.VOCABULARY))
    ids = Counter()
    for r in results["mixing"]:
        ids.update((r.doc_id, x) for x in [*enc.bpe.encode_ordinary(r.text), enc.end])
    got = Counter()
    for r in results["packing"]:
        row = np.frombuffer(r.ids, dtype="<u2").tolist()
        for d, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            got.update((d, x) for x in row[a:b])
    assert got == ids


def test_empty_tables_pass_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
