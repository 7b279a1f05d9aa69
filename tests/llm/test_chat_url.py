import hashlib
import random
from collections import defaultdict

import pytest

from sketchloom.llm import chat, urlfilter

TURNS = "conv_id long, turn long, role string, text string, window long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], TURNS)


def rows_of(seed):
    rng = random.Random(seed)
    out = []
    for c in range(20):
        for t in range(rng.randint(1, 12)):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant"])
            out.append((c, t, role, " ".join(rng.choice(["a", "</turn>", "\\", "<turn 3 user>", "é", "\\l"]) for _ in range(rng.randint(0, 90)))))
    return out + [(None, 1, "user", "no id"), (None, 0, None, None), (50, None, "assistant", "x" * 100_000), (50, 1, "assistant", ""), (51, 1, "user", "tie"), (51, 1, "assistant", "tie"), (51, 1, "assistant", "tie")]


def test_windows_round_trip(spark):
    rows = rows_of(1)
    got = {r.conv_id: r for r in chat.read_back(chat.windows(conversations(spark, rows), budget=120, history=40)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        learnt = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c].loss_chars == len(learnt) and got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert any(r.n_windows > 1 for r in got.values())


def test_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "be kind " * 5)] + [(1, t, "user" if t % 2 else "assistant", "w " * 30) for t in range(1, 13)]
    out = sorted(chat.windows(conversations(spark, rows), budget=150, history=50).collect(), key=lambda r: r.window)
    assert len(out) > 2 and all(r.n_tokens <= 150 for r in out)
    for r in out:
        turns = chat.parse(r.text)
        assert turns[0][0] == 0 and turns[0][1] == "system"
        repeated = [i for i, *_ in turns[1:] if i < r.first_turn]
        assert not r.window or repeated == [r.first_turn - 1]
    assert [r.first_turn for r in out][1:] == [r.last_turn + 1 for r in out][:-1]


def test_the_budget_comes_before_the_system_turn(spark):
    rows = [(1, 0, "system", "s " * 400)] + [(1, t, "user", "w " * 200) for t in range(1, 4)] + [(1, 4, "assistant", "w " * 60), (1, 5, "user", "long " * 900)]
    out = sorted(chat.windows(conversations(spark, rows)).collect(), key=lambda r: r.window)
    assert all(r.n_tokens <= chat.BUDGET or (r.first_turn == r.last_turn == 5 and len(chat.parse(r.text)) == 1) for r in out)
    assert chat.parse(next(r for r in out if r.last_turn == 4).text)[0][1] == "user"


def test_contract_conversation(spark):
    got = chat.digest(spark, conversations(spark, [])).collect()
    assert [r.conv_id for r in got] == [-7] and got[0].n_turns == 2 and got[0].loss_chars == len("\\### Assistant: </turn> ok")


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme/en/": ("", "", None, "allow"),
        "http://A.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "x://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://m.example.net/de/81": ("m.example.net", "/de/81", "example.net/de/8", "block"),
        "http://casino.net/de/1": ("casino.net", "/de/1", "net/de/", "allow"),
        "http://my-casino.example.org/fr/": ("my-casino.example.org", "/fr/", None, "block"),
        "http://casinoz.example.org/fr/": ("casinoz.example.org", "/fr/", None, "allow"),
        "http://free.example.org/fr": ("free.example.org", "/fr", None, "allow"),
        "http://free.example.org/fr/BETS": ("free.example.org", "/fr/BETS", None, "block"),
        "http://free-free.example.org": ("free-free.example.org", "", None, "allow"),
        "http://É.org/es/?a://b": ("É.org", "/es/", "org/es/", "block"),
        "http://h#x/y": ("h", "", None, "allow"),
        "http://h/" + "a" * 100_000: ("h", "/" + "a" * 100_000, None, "allow"),
    }
    df = pages(spark, list(cases))
    got = urlfilter.judge(df).collect()
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in got} == cases
    assert "html" in got[0].__fields__ and urlfilter.digest(pages(spark, [])).count() == 0


def test_vocabularies(spark, tmp_path):
    built_in = urlfilter.read_vocabulary()
    assert len(built_in.strict) > 40 and len(built_in.soft) > 50 and not set(built_in.strict) & {t for t, _ in built_in.soft}
    (tmp_path / "v.tsv").write_text("# mine\nBad-Word\tstrict\t1\none\tsoft\t0.1\ntwo\tsoft\t0.1\n")
    v = urlfilter.read_vocabulary(str(tmp_path / "v.tsv"))
    table = spark.createDataFrame([("Bad-Word", "strict", 1.0), ("one", "soft", 0.1), ("two", "soft", 0.1)], "term string, kind string, weight double")
    assert v == urlfilter.vocabulary_of(table) and v.strict == ("bad-word",)
    df = spark.createDataFrame([(1, "http://a/one/two"), (2, "http://a/one/one"), (3, "http://a/bad-word"), (4, "http://a/bad-words?casino"), (5, None)], "page_id long, url string").selectExpr("*", "9 AS _terms", "8 AS TERMS", "7 AS Host")
    got = urlfilter.judge(df, rules=(), vocabulary=v)
    assert {r.page_id: (r.verdict, round(r.soft_weight, 3), r["_terms"], r["TERMS"]) for r in got.collect()} == {1: ("block", 0.2, 9, 8), 2: ("allow", 0.1, 9, 8), 3: ("block", 0.0, 9, 8), 4: ("allow", 0.0, 9, 8), 5: ("allow", 0.0, 9, 8)}
    with pytest.raises(ValueError):
        urlfilter.vocabulary_of(table.selectExpr("term", "'odd' AS kind", "weight"))
