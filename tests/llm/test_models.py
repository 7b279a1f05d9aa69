import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import ann, langid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"en": "the and ing tion er of th ness ly ed with".split(), "de": "der und ung keit sch ein ü lich ß ver ge".split(), "fr": "le eau tion que é è ment oi aux des un".split(), "es": "el ción os ado ñ que rr mente ez ía las".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(n))


def labelled(seed, n):
    rng = random.Random(seed)
    return [(i, sentence(rng, lang := rng.choice(list(PARTS)), rng.randint(4, 60)), lang, f"{lang}{rng.randrange(3)}.example.{lang}", 0) for i in range(n)]


def fused(rows, model):
    """The fusion again, row by row: language and probability of (text, declaration, host, suffix)."""
    kinds, n = [*model.languages, "und"], len(model.languages) + 1

    def shares(x):
        w = np.exp(x - x.max())
        return w / w.sum()

    logs = []
    for text, said, *_ in rows:
        out = model.score(text)
        if out is not None:
            out = np.asarray(out) / 3
            if said in model.languages:
                trust = np.full(n, 0.1 / (n - 2))
                trust[kinds.index(said)], trust[-1] = 0.9, 1 / (n - 1)
                out = out + np.log(trust)
        logs.append(out)
    own = [None if x is None else shares(x) for x in logs]
    total = sum(p for p in own if p is not None)
    overall = (total + 1) / (total.sum() + n)
    host, suffix = {}, {}
    for (_, _, h, end), p in zip(rows, own, strict=True):
        if p is not None:
            host[end, h or ""] = host.get((end, h or ""), 0) + p
            suffix[end] = suffix.get(end, 0) + p
    for (_, _, h, end), x, p in zip(rows, logs, own, strict=True):
        if x is None:
            yield "und", 1.0
            continue
        up = (suffix[end] + 50 * overall) / (suffix[end].sum() + 50)
        rest = np.maximum(host[end, h or ""] - p, 0)
        final = shares(x + np.log((rest + 20 * up) / (rest.sum() + 20)))
        yield kinds[int(np.argmax(final))], float(final.max())


def test_held_out_accuracy(spark):
    model = langid.fit(spark.createDataFrame(labelled(1, 400), DOCS))
    held = labelled(2, 300)
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t, *_ in held], DOCS)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert np.mean([got[i].lang_id == lang for i, _, lang, *_ in held]) > 0.97
    assert np.mean([got[i].lang_kept for i, *_ in held]) > 0.97


def test_evidence_is_fused(spark):
    model = langid.fit(spark.createDataFrame(labelled(1, 400), DOCS))
    rng = random.Random(9)
    same = [(i, sentence(rng, "fr", 40), None, "h.example.fr", 0) for i in range(30)]
    weak = [(100, "tion", None, "h.example.fr", 0), (101, "tion", None, "h.example.en", 0), (102, "tion", "fr", None, 0), (103, "tion", "en", None, 0), (104, "que", "es", None, 0), (105, "que", "fr", None, 0)]
    others = [(200 + i, sentence(rng, "en", 40), None, "h.example.en", 0) for i in range(30)]
    rows = same + weak + others
    df = spark.createDataFrame(rows, DOCS)
    suffix = F.regexp_extract(F.coalesce("source", F.lit("")), "([a-z]+)$", 1)
    got = {r.doc_id: r for r in langid.identify(df, model, declared="lang", host="source", suffix=suffix).collect()}
    assert tuple(got[i].lang_id for i in range(100, 104)) == ("fr", "en", "fr", "en")
    assert (got[104].lang_id, got[105].lang_id) == ("es", "fr")  # a declaration turns a weak text
    for i, (kind, p) in enumerate(fused([(t, said, h, (h or "").rpartition(".")[2]) for _, t, said, h, _ in rows], model)):
        r = got[rows[i][0]]
        assert r.lang_id == kind and r.lang_probability == pytest.approx(p, abs=1e-9)


def test_a_label_is_not_used_twice(spark):
    rows = [(i, t, "en" if i < 40 else lang, s, c) for i, t, lang, s, c in labelled(3, 300)]  # some wrong labels
    df = spark.createDataFrame([*rows, rows[0]], DOCS)
    model = langid.fit(df, sample=100)
    drawn = df.where(langid._place("doc_id", "lang", "text") <= model.upto).select("doc_id")
    ids = {r.doc_id for r in drawn.collect()}
    assert 90 <= len(ids) <= 100
    got = {r.doc_id: r for r in langid.identified(df, model=model).collect()}
    plain = {r.doc_id: r for r in langid.identify(df, model, declared=F.when(~F.col("doc_id").isin(*ids), F.col("lang")), host="source", suffix=F.regexp_extract("source", r"\.([a-z]+)$", 1)).collect()}
    assert {i: r.lang_id for i, r in got.items()} == {i: r.lang_id for i, r in plain.items()}


def test_pages(spark):
    model = langid.fit(spark.createDataFrame(labelled(1, 400), DOCS))
    rng = random.Random(2)
    page = lambda lang, text: f"<!DOCTYPE html><HTML class=x lang='{lang}'><head><script>var the = 'and the';</script><style>p{{}}</style></head><body><!-- the and --><p>{text}&nbsp;</p></body></html>"
    rows = [(i, f"http://www.h{i % 3}.Example.FR:80/a?x=://y", page("fr-FR", sentence(rng, "fr", 30))) for i in range(20)]
    rows += [(100, "http://a.b.es/", page("es", "que")), (101, None, page("", "")), (102, "no address", None), (103, "http://h0.example.fr/", page("de", sentence(rng, "fr", 30)))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("theirs"))
    parts = {r.page_id: r for r in df.select("page_id", *(c.alias(n) for c, n in zip(langid.page_parts(F.col("url"), F.col("html")), "tlhs", strict=True))).collect()}
    assert (parts[0].l, parts[0].h, parts[0].s) == ("fr-FR", "www.h0.example.fr:80", "fr") and "the" not in parts[0].t.split()
    got = {r.page_id: r for r in langid.identified_pages(df, model).collect()}
    assert all(got[i].lang_id == "fr" and got[i].text == "theirs" for i in [*range(20), 103]) and got[100].lang_id == "es"
    assert got[101].lang_id == got[102].lang_id == "und"


NO_PAGES = "page_id long, url string, html string"


def test_rejections_and_odd_rows(spark):
    rng = random.Random(4)
    junk = "".join(rng.choices("qxzjkwvbpf", k=400))
    long = " ".join([sentence(rng, "en", 500)] * 900)  # over four megabytes
    rows = labelled(1, 300) + [(900, None, None, None, 0), (901, "", "en", "s", 0), (902, "12 34 !!", "en", "s", 0), (903, junk, None, "s", 0), (None, sentence(rng, "de", 50), None, None, 0), (904, long, None, None, 0), (905, "tion", None, None, 0), (905, "tion", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    pages = spark.createDataFrame([(1, "http://a.example.fr/", f"<html lang=fr>{sentence(rng, 'fr', 30)}")], NO_PAGES)
    every = langid.digest(df, pages).collect()
    got = {r.doc_id: r for r in every if r.page_id is None}
    assert len(every) == len(rows) + 1 and [r.lang_id for r in every if r.page_id == 1] == ["fr"]
    assert all(got[i].lang_id == "und" and not got[i].kept for i in (900, 901, 902, 903)) and got[None].lang_id == "de" and got[904].lang_id == "en"
    clashing = df.withColumns({"lang_kept": F.lit("mine"), "Score": F.lit(1), "host": F.lit(2), "_lang_kept": F.lit(3)})
    kept = langid.kept(clashing)
    assert kept.columns == clashing.columns and kept.count() == sum(r.kept for r in every if r.page_id is None)
    assert {(r["lang_kept"], r["Score"], r["host"]) for r in kept.collect()} == {("mine", 1, 2)}
    assert langid.digest(df.limit(0), pages.limit(0)).count() == 0 and langid.kept(df.limit(0)).count() == 0


def test_ties_go_to_the_language_named_first(spark):
    table = np.zeros((1 << 18, 3), dtype=np.float32)  # every text is equally likely in every language
    df = spark.createDataFrame([(1, "abc", None, None, 0), (2, "abc", "zz", None, 0), (3, "abc", "bb", None, 0)], DOCS)
    got = {r.doc_id: r.lang_id for r in langid.identify(df, langid.Model(("bb", "aa"), table), declared="lang").collect()}
    assert got[3] == "bb" and got[1] == got[2] == "bb"


def test_without_labels_nothing_is_judged(spark):
    df = spark.createDataFrame(labelled(1, 20), DOCS).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source")
    pages = spark.createDataFrame([(1, "u", "h")], NO_PAGES)
    assert {(r.lang_id, r.lang_probability, r.kept) for r in langid.digest(df, pages).collect()} == {(None, None, True)}
    assert langid.kept(df).count() == 20
    ids = spark.createDataFrame(labelled(1, 200), DOCS).withColumn("doc_id", F.lit(None).cast("long"))
    assert langid.kept(ids).count() > 190  # labels count without ids


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, d))
    return (centres[rng.integers(0, 10, n)] + rng.normal(scale=0.7, size=(n, d))).astype(np.float32)


def brute(x, ids, every=100, k=10):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        out[int(ids[q])] = [(int(ids[i]), far[i]) for i in np.lexsort((ids, far)) if ids[i] != ids[q]][:k]
    return out


def test_recall_and_scores(spark):
    x = vectors(3000, 24, 1)
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = ann.digest(df).collect()
    want, hit = brute(x, ids), 0
    for q, near in want.items():
        rows = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, *_ in rows] == list(range(1, 11)) and [s for *_, s in rows] == sorted(s for *_, s in rows)
        hit += len({v for _, v, _ in rows} & {v for v, _ in near})
        for _, v, s in rows:
            assert s == pytest.approx(np.linalg.norm(x[v].astype(float) - x[q].astype(float)), abs=1e-12)
    assert hit / (10 * len(want)) >= 0.95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_recall_on_the_table_and_outside_the_sample(spark):
    """The driver's table, with all rows in the sample that was fitted on and with half of them."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.where("vec_id IS NOT NULL").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float32)
    for every, sample in ((100, 10_000), (50, len(rows) // 2)):
        index, how = ann.build(df, sample)
        got = defaultdict(set)
        for r in ann.search(index, how, every).collect():
            got[r.query_id].add(r.vec_id)
        want = brute(x, ids, every)
        assert sum(len(got[q] & {v for v, _ in near}) for q, near in want.items()) >= 0.95 * sum(map(len, want.values()))


def test_chunks_blocks_and_doubles(spark):
    x = vectors(1500, 16, 5).astype(np.float64) + 1e-9
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS codes", "3 AS VECTOR")
    index, how = ann.build(df, 1000)
    assert how.dtype == "float64" and len(how.cells) == 1000 // 64
    whole = ann.search(index, how, 20, probes=len(how.cells)).collect()
    cut = ann.search(index, how, 20, probes=len(how.cells), chunk=50, block=7).collect()
    want = {}
    for q in range(0, 1500, 20):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        want[q] = [(int(i), float(far[i])) for i in np.lexsort((ids, far)) if i != q][:10]
    for got in (whole, cut):
        assert {q: [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in want} == {q: [(i, pytest.approx(s, abs=1e-12)) for i, s in near] for q, near in want.items()}


@pytest.mark.parametrize("kind", ["offset", "tight", "outliers"])
def test_no_neighbour_is_missed_wherever_rows_lie(spark, kind):
    """Rows far from the origin, in clusters narrower than what codes leave out, and of very different lengths, most outside the fit sample."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 12))
    if kind == "offset":
        x = 5000 + 0.1 * x
    elif kind == "tight":
        x = rng.normal(size=(3, 12))[rng.integers(0, 3, 4000)] + 1e-4 * x
    else:
        x *= rng.pareto(0.6, size=(4000, 1)) + 0.01
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in sorted(ann.search(*ann.build(df, 400)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    assert got == {q: [v for v, _ in near] for q, near in brute(x, np.arange(4000)).items()}


def test_equal_and_odd_vectors(spark):
    x = vectors(300, 8, 2)
    x[50:250] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (500, [0.0] * 8), (600, [1.0] * 7 + [None]), (700, [float("nan")] * 8), (800, [float("inf")] * 8), (900, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.digest(df).collect()
    want = brute(x, np.arange(300))
    assert {r.query_id for r in got} == set(want)
    for q, near in want.items():
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [v for v, _ in near]
    assert ann.digest(df.limit(0)).count() == 0 and ann.digest(df.where("vec_id >= 400")).count() == 0
    few = ann.digest(df.where("vec_id IN (100, 3, 4)")).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r.rank)] == [v for v, _ in brute(x[[3, 4, 100]], np.array([3, 4, 100]))[100]]


def test_all_labels_of_the_sample_are_languages(spark):
    rng = random.Random(40)
    words = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for n in range(40)}
    rows = [(40 * k + n, " ".join(rng.choices(words[n], k=20)), f"l{n:02}", "s.x") for k in range(8) for n in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(df)
    assert len(model.languages) == 40
    named = df.select("doc_id", "text", F.col("source").alias("so.urce"), "lang", "source")
    kept = langid.kept(named)
    assert kept.columns == named.columns and kept.count() == len(rows)
    got = {r.doc_id: r.lang_id for r in langid.identified(df, carry=["doc_id"]).collect()}
    assert sum(got[d] == lang for d, _, lang, _ in rows) > 0.95 * len(rows)


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_evidence_decides_short_texts(spark):
    """Pages cut to their first word: with host, suffix and declaration more of them have the language of the whole page."""
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    model = langid.fit(docs)
    text, said, host, suffix = langid.page_parts(F.col("url"), F.col("html"))
    cut = pages.select("page_id", F.substring_index(F.trim(text), " ", 1).alias("text"), said.alias("said"), host.alias("host"), suffix.alias("suffix"))
    named = lambda df, name: {r.page_id: r[name] for r in df.collect()}
    whole = named(langid.identified_pages(pages.select("page_id", "url", "html"), model, ["page_id"]), "lang_id")
    alone = named(langid.identify(cut, model, carry=["page_id"]), "lang_id")
    fused = named(langid.identify(cut, model, "text", "said", "host", "suffix", carry=["page_id"]), "lang_id")
    right = lambda got: sum(got[i] == whole[i] for i in whole)
    assert sum(alone[i] != fused[i] for i in whole) >= 5 and right(fused) > right(alone) and right(fused) >= 0.97 * len(whole)
