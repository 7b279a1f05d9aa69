"""Tokens against plain integers, parsers, sketches from files, stores and streams."""

import gzip
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.functions.bits import mix64, sampled
from sketchloom.operators import ani
from sketchloom.operators.tokenize import KmerLayout, gather, recovered, shuffled_subcontexts, spread, tokens
from sketchloom.plans import sketching
from sketchloom.sources import fastx, store
from sketchloom.sources.sinks import write_sequences, write_tsv
from sketchloom.streaming import ingest

M = (1 << 64) - 1


def plain_mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain_tokens(seq, layout):
    k, out = layout.k, []
    code = {c: i for i, c in enumerate("ACGT")} | {c: i for i, c in enumerate("acgt")}
    for at in range(len(seq) - k + 1):
        window = seq[at : at + k]
        if any(c not in code for c in window):
            continue
        f = r = 0
        for c in window:
            f = f << 2 | code[c]
        for c in reversed(window):
            r = r << 2 | 3 - code[c]
        f_ctx, r_ctx = f & layout.mask, r & layout.mask
        x = f if f_ctx < r_ctx else r
        if plain_mix(x & layout.mask) & 0xFFFFFFFF > layout.threshold:
            continue
        bases = [x >> 2 * (k - 1 - i) & 3 for i in range(k)]
        ctx = obj = 0
        for b, kind in zip(bases, layout.pattern, strict=True):
            if kind == "C":
                ctx = ctx << 2 | b
            else:
                obj = obj << 2 | b
        out.append((ctx, obj, at))
    return out


@pytest.mark.parametrize("layout", [KmerLayout.coden(11, 1), KmerLayout.coden(9, 0), KmerLayout.manual(6, 2, 3, 0), KmerLayout.manual(3, 1, 1, 0)])
def test_tokens(layout):
    rng = random.Random(layout.k)
    seq = "".join(rng.choice("ACGTacgtN" if i % 50 == 0 else "ACGTacgt") for i in range(900)) + "ACGT" * 12
    ctx, obj, pos = tokens(seq.encode(), layout)
    assert list(zip(ctx.tolist(), obj.tolist(), pos.tolist(), strict=True)) == plain_tokens(seq, layout)
    whole = spread(ctx, obj, layout.pattern)
    assert (gather(whole, layout.pattern, "C") == ctx).all() and (gather(whole, layout.pattern, "O") == obj).all()


def test_layouts():
    assert KmerLayout.coden().mask == 0xF3CF3CF3CF3CF3CF and KmerLayout.coden().ctx_bits == 44 and KmerLayout.coden().obj_bits == 20
    assert [KmerLayout.coden(n).k for n in (9, 10, 11)] == [26, 29, 32]
    with pytest.raises(ValueError):
        KmerLayout("CXO")
    assert len(tokens(b"ACGT", KmerLayout.coden())[0]) == 0
    x = np.array([0, 1, M, 1 << 63], dtype=np.uint64)
    assert mix64(x).tolist() == [plain_mix(int(v)) for v in x]
    p = shuffled_subcontexts(2, 1, 3)
    assert sorted(p.tolist()) == list(range(256)) and (p == shuffled_subcontexts(2, 1, 3)).all()


def test_native_sampling(spark):
    df = spark.range(5000).withColumnRenamed("id", "ctx")
    assert {r.ctx for r in sampled(df, "ctx", 3).collect()} == {x for x in range(5000) if plain_mix(x) & 0xFFFFFFFF <= 0xFFFFFFFF >> 3}


def test_parser():
    assert list(fastx.parse(b">a one two\nAC\nGT\n\n>b\n>c x\nT")) == [("a", "one two", b"ACGT"), ("b", "", b""), ("c", "x", b"T")]
    assert list(fastx.parse(b"@r1\nACGT\n+\n@III\n@r2 y\nAC\nGT\n+r2\n>>\n+I\n")) == [("r1", "", b"ACGT"), ("r2", "y", b"ACGT")]
    assert list(fastx.parse(b"")) == []
    assert [fastx.kind_of(p) for p in ("a.fa", "b.FQ.gz", "c.fna.bz2", "d.txt")] == ["fasta", "fastq", "fasta", None]
    with pytest.raises(ValueError):
        fastx.checked(["x.fa", "y.doc"])


def write(path, text):
    (gzip.open if str(path).endswith(".gz") else open)(path, "wt").write(text)
    return str(path)


def test_files_to_report(spark, tmp_path):
    rng = random.Random(4)
    base = "".join(rng.choice("ACGT") for _ in range(20_000))
    changed = "".join(rng.choice("ACGT") if i % 500 == 0 else c for i, c in enumerate(base))
    a = write(tmp_path / "a.fa", f">one\n{base}\n")
    b = write(tmp_path / "b.fa.gz", f">one\n{base[:9000]}\n>two\n{base[9000:]}\n")
    c = write(tmp_path / "c.fa", f">x\n{changed}\n")
    layout = KmerLayout.coden(11, 2)
    entries_, samples, params = sketching.sketch(spark, [a, b, c], layout, counts=True, positions=True)
    assert params["klen"] == 32 and {r.sample_id: r.record_count for r in samples.collect()} == {0: 1, 1: 2, 2: 1}
    rows = ani.detail(entries_, None, ani.Options(metric=4, anicut=0.5), layout.distances()).collect()
    got = {(r.q, r.r): r.ani for r in rows}
    assert got[1, 0] > 0.9999 and 0.99 < got[2, 0] < 1.0
    # positions run over a file's records; b's second record starts where the first ends
    pos = {(r.ctx, r.obj): r.pos for r in entries_.where("sample_id = 0").collect()}
    assert all(pos[r.ctx, r.obj] == r.pos for r in entries_.where("sample_id = 1").collect() if (r.ctx, r.obj) in pos)
    report = sketching.compare_files(spark, [c], [a], ani.Options(metric=4), layout)
    assert tuple(report.columns) == ani.DETAIL and report.count() == 1
    write_tsv(report, str(tmp_path / "report"))
    with pytest.raises(Exception, match="exists"):
        write_tsv(report, str(tmp_path / "report"))
    as_one, s, _ = sketching.sketch(spark, [a, c], layout, as_one=True, name="both")
    assert [r.sample_id for r in s.collect()] == [0] and as_one.select("sample_id").distinct().count() == 1
    split, s, _ = sketching.sketch(spark, [b], layout, split=True)
    assert [r.name for r in s.orderBy("sample_id").collect()] == ["one", "two"] and split.select("sample_id").distinct().count() == 2
    first = recovered(entries_.where("sample_id = 0").limit(20), layout).collect()
    assert all(r.kmer in base or r.reverse_complement in base for r in first)


def test_fasta_by_marks(spark, tmp_path):
    p = write(tmp_path / "m.fa", ">a one two\nAC\nGT\n>b\nTT\n>c\nA\n")
    got = fastx.records(spark, [p]).orderBy("rec_no").collect()
    assert [(r.rec_no, r.name, r.comment, bytes(r.seq), r.offset) for r in got] == [(0, "a", "one two", b"ACGT", 0), (1, "b", "", b"TT", 4), (2, "c", "", b"A", 6)]
    with pytest.raises(PermissionError):
        fastx.piped_records(spark, [p], "cat {}")
    assert fastx.piped_records(spark, [p], "cat {}", allow=True).count() == 3
    write(tmp_path / "list.txt", f"{p}\n\n{p}\n")
    assert fastx.listed(spark, str(tmp_path / "list.txt")) == [p, p]


def plain_records(path, text):
    """What a reader of the whole text gives."""
    at = 0
    for n, (name, comment, seq) in enumerate(fastx.parse(text.encode())):
        yield path, n, name, comment, seq, len(seq), at
        at += len(seq)


@pytest.mark.parametrize(("size", "compressed", "many"), [(120, "", 16), (5000, "", 300), (5000, ".gz", 40)])
def test_splits_lose_nothing(spark, tmp_path, size, compressed, many):
    """Records of one line and of many, marks in qualities, odd files, empty files and a record of many splits, at any split size."""
    rng = random.Random(size)
    dna = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    wrapped = lambda s: "\n".join(s[i : i + 60] for i in range(0, len(s), 60))
    quality = lambda n: "".join(rng.choice("@@+>IF!5") for _ in range(n))
    reads = [(f"r{i} c {i}", dna(rng.randrange(1, 90))) for i in range(many)]
    texts = {
        "a.fa": "".join(f">s{i} x\n{wrapped(dna(rng.randrange(200)))}\n" for i in range(many // 2)) + ">last\nACG",
        "b.fasta": ">one\n" + wrapped(dna(100 * many)) + "\n>two\n" + dna(30 * many) + "\n",
        "c.fq": "".join(f"@{n}\n{s}\n+\n{quality(len(s))}\n" for n, s in reads),
        "d.fastq": "".join(f"@{n}\n{s}\n+{n}\n{quality(len(s))}\n" for n, s in reads)[:-40],
        "e.fq": "".join(f"@{n}\n{wrapped(s)}\n+\n{wrapped('I' * len(s))}\n" for n, s in reads[:150]),
        "f.fq": "".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n\n" for n, s in reads[:60]),
        "g.fa": "".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads[:60]),
        "h.fq": "".join(f">{n}\n{s}\n" for n, s in reads[:60]),
        "i.fa": "",
        "j.fq": "\n\n@x\nAC\n+\nII\n",
        "k.fa": "\n>x y\r\nAC\r\nGT\r\n",
        "l m%20.fa": ">only",
    }
    paths = [write(tmp_path / (n + compressed), t) for n, t in texts.items()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = fastx.records(spark, paths).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [r for p, t in zip(paths, texts.values(), strict=True) for r in plain_records(p, t)]
    assert sorted((re.sub("^file:/+", "/", r.path), r.rec_no, r.name, r.comment, bytes(r.seq), r.length, r.offset) for r in got) == sorted(want)
    assert {r.fmt for r in got if "/c.fq" in r.path or "/e.fq" in r.path or "/g.fa" in r.path} == {"fastq"} and {r.fmt for r in got if "/a.fa" in r.path or "/h.fq" in r.path} == {"fasta"}


def test_written_sequences_are_read(spark, tmp_path):
    rows = [(f"n{i}", "c d" if i % 2 else "", "ACGTACG" * (i % 40 + 1), "I" * 7 * (i % 40 + 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "name string, comment string, seq string, quality string").repartition(3)
    for fmt in ("fasta", "fastq"):
        paths = write_sequences(df, str(tmp_path / fmt), fmt)
        got = fastx.records(spark, [str(tmp_path / fmt)]).collect()
        assert len(paths) == 3 and sorted((r.name, r.comment, bytes(r.seq).decode()) for r in got) == sorted(r[:3] for r in rows) and {r.fmt for r in got} == {fmt}


def test_qualities_mask_bases(spark, tmp_path):
    p = write(tmp_path / "q.fq", "@a\nACGTAC\n+\nI!I#I5\n@b\nAAAA\n+\nIIII\n" * 20)
    got = fastx.records(spark, [p], least_quality=20).orderBy("rec_no").collect()
    assert [bytes(r.seq) for r in got] == [b"ANGNAC", b"AAAA"] * 20
    w = write(tmp_path / "w.fq", "@a\nACG\nTAC\n+\nI!I\n#I5\n")
    assert [bytes(r.seq) for r in fastx.records(spark, [w], least_quality=21).collect()] == [b"ANGNAN"]
    layout = KmerLayout.manual(1, 1, 1, 0)
    made, _, _ = sketching.sketch(spark, [w], layout, least_quality=20)
    assert made.count() == 0 and sketching.sketch(spark, [w], layout)[0].count() > 0


def test_store(spark, tmp_path):
    e = spark.createDataFrame([(0, 5, 1, 2), (1, 6, 1, 1)], "sample_id long, ctx long, obj long, cnt long")
    s = spark.createDataFrame([(0, "x/a"), (1, "y/b")], "sample_id long, name string")
    for n in ("one", "two"):
        store.write_sketch(str(tmp_path / n), e, s, {"hash_id": 1})
    store.write_sketch(str(tmp_path / "other"), e, s, {"hash_id": 2})
    both, names, _ = store.read_many(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert sorted(r.sample_id for r in both.collect()) == [0, 1, 2, 3] and names.count() == 4
    with pytest.raises(ValueError):
        store.read_many(spark, [str(tmp_path / "one"), str(tmp_path / "other")])
    assert [(r["count"], r["name"]) for r in store.inspect_samples(e, s).collect()] == [(1, "x/a"), (1, "y/b")]
    store.write_separate(str(tmp_path / "sep"), e, s)
    assert {r["value"] for r in spark.read.text(str(tmp_path / "sep/query_sketches.txt")).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        store.write_separate(str(tmp_path / "sep2"), e, spark.createDataFrame([(0, "x/a"), (1, "y/a")], "sample_id long, name string"))


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGT") for _ in range(3000)) for _ in range(3)]
    layout = KmerLayout.coden(11, 2)
    for i, s in enumerate(seqs[:2]):
        write(folder / f"{i}.fa", f">s\n{s}\n")
    run = lambda: ingest.append(ingest.record_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "check"), layout).awaitTermination()
    run()
    time.sleep(1.1)
    write(folder / "2.fa", f">s\n{seqs[2]}\n")
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("sample_id").distinct().count() == 3
    want = sum(len({(c, o) for c, o, _ in plain_tokens(s, layout)}) for s in seqs)
    assert got.count() == want


def test_separate_samples_are_files(spark, tmp_path):
    e = spark.range(0, 4000, numPartitions=8).select((F.col("id") % 5).alias("sample_id"), F.col("id").alias("ctx"), F.lit(0).cast("long").alias("obj"))
    s = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "sample_id long, name string")
    store.write_separate(str(tmp_path / "sep"), e, s)
    files = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "sep" / "sketches").glob("sample=*")]
    assert files == [1] * 5  # not one of each task
    assert {r["sample"]: r["count"] for r in spark.read.parquet(str(tmp_path / "sep" / "sketches")).groupBy("sample").count().collect()} == {f"s{i}": 800 for i in range(5)}
