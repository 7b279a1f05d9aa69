"""Secrets in texts: patterns of known forms, and strings that a character model takes for random.

Two Markov models give the probability of a character after the one before it: one of random strings, one of ordinary
identifiers. Both are counted from labelled samples (:func:`fit`, columns ``value`` and ``random``), and what is kept of them is
one whole number for each pair of characters, the logarithm of the ratio of their probabilities in hundredths of a nat. A
run of at least ``LEAST_RANDOM`` characters that holds a letter and a digit is a secret if its sum reaches ``threshold``.
Scanning and counting are DataFrame expressions; scanning has no shuffle. The model is a row for each pair of
characters, so its size is bounded by the alphabet.

:func:`labelled` makes samples from documents: words of the ``SAMPLE`` documents of the smallest hash, alone and joined into
identifiers, are ordinary, and as many hash values in several alphabets are random.

Kinds are listed in ``KINDS``. ``assign``, ``access`` and ``hex`` are the base kinds, kept whenever they are long enough; ``random``
is the model's. A string may be found by several kinds.

Defined results: a null text counts as empty and has no spans; an empty text has none; very long texts and runs are read
whole; repeated rows give repeated results; other columns pass through, and one called like the result is
replaced; an empty table gives an empty result; samples without rows of both labels, or none, give a model that tells nothing, so no
run is random.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.pii import running_sum
from sketchloom.session import fresh, quoted, without

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
LEAST_RANDOM = 20
#: Nats: a run must be so much likelier as a random string, e**9 or about 8,000 to one, as ordinary runs are that much more frequent.
THRESHOLD = 9.0
#: Documents whose words are ordinary samples, and words of each.
SAMPLE, SAMPLE_WORDS = 2000, 60
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
# A maximal run of at least n characters is what a run of any length gives after the drop of shorter ones.
PATTERNS = {
    "assign": rf"""(?:{_KEYS})["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "random": rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RANDOM},}}+",
}
#: What a text must contain for a pattern to be tried.
HINTS = {"assign": r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}", "access": "AKIA", "hex": PATTERNS["hex"], "random": PATTERNS["random"]}
VALUE = r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}$"


def labelled(docs: DataFrame, text: str = "text", documents: int = SAMPLE, words: int = SAMPLE_WORDS) -> DataFrame:
    """``value`` and ``random`` of a bounded sample; rows without text give none."""
    keyed = docs.select(F.md5(F.col(quoted(text))).alias("key"), F.col(quoted(text)).alias("body")).where("key IS NOT NULL")
    chosen = keyed.select("key").distinct().orderBy("key").limit(documents)
    some = keyed.join(F.broadcast(chosen), "key").groupBy("key").agg(F.first("body").alias("body"))  # equal texts are one sample
    found = some.select("key", F.slice(F.regexp_extract_all("body", F.lit("[A-Za-z]+"), F.lit(0)), 1, words).alias("w"))
    found = found.select("key", F.posexplode(F.arrays_zip(F.col("w"), F.slice("w", 2, words).alias("v"), F.slice("w", 3, words).alias("u"))).alias("n", "z"))
    one, two, three = (F.coalesce(F.col(f"z.{c}"), F.lit("a")) for c in "wvu")
    n = F.col("n")
    forms = [
        one,
        F.concat_ws("_", one, two, three),
        F.concat(F.lower(one), F.initcap(two), F.initcap(three)),
        F.concat_ws("-", one, two, three),
        F.upper(F.concat_ws("_", one, two)),
        F.concat(F.lower(one), F.initcap(two), F.initcap(three), F.initcap(one), F.pmod(n, F.lit(10)).cast("string")),
        F.concat_ws("_", one, two, F.pmod(n, F.lit(100)).cast("string")),
        F.concat_ws("/", one, two, three),
    ]
    joined = F.element_at(F.array(*forms), (F.pmod(n, F.lit(len(forms))) + 1).cast("int"))
    ordinary = found.select(joined.alias("value"), F.lit(False).alias("random"))
    made = found.select(F.sha2(F.concat_ws(":", "key", "n"), 256).alias("h"), n.alias("n"))
    tail = F.substr(F.col("h"), F.lit(1), F.lit(40))
    random = made.select(F.element_at(F.array(tail, F.upper(tail), F.base64(F.unhex("h"))), (F.pmod("n", F.lit(3)) + 1).cast("int")).alias("value"), F.lit(True).alias("random"))
    return ordinary.unionByName(random)


def codes(value: Column) -> Column:
    """Places in ``ALPHABET``, from 1, of a string's characters; 0 for others."""
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))


def fit(samples: DataFrame) -> list[int]:
    """Hundredths of a nat for each pair of characters, row by row over ``ALPHABET``: positive where random strings are likelier."""
    width = len(ALPHABET)
    seen = samples.where("value IS NOT NULL AND random IS NOT NULL").select("random", codes(F.col("value")).alias("c"))
    pairs = seen.select("random", F.explode(F.zip_with("c", F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))), lambda a, b: F.when((a > 0) & (b > 0), (a - 1) * width + b - 1))).alias("pair"))
    counted = pairs.where("pair IS NOT NULL").groupBy("random", "pair").count().collect()  # at most two rows for each pair of characters
    count = {label: [0] * (width * width) for label in (True, False)}
    for r in counted:
        count[r["random"]][r["pair"]] = r["count"]
    if not all(map(any, count.values())):
        return [0] * (width * width)
    logs = {}
    for label, n in count.items():  # a row's probabilities lean on those of the following character alone, these on equal ones
        after = [sum(n[b::width]) for b in range(width)]
        share = [(x + 0.5) / (sum(after) + 0.5 * width) for x in after]
        logs[label] = [math.log((n[a * width + b] + 4 * share[b]) / (sum(n[a * width : (a + 1) * width]) + 4)) for a in range(width) for b in range(width)]
    return [round(100 * (r - i)) for r, i in zip(logs[True], logs[False], strict=True)]


def ratio(value: Column, model: list[int]) -> Column:
    """Log-likelihood ratio of a string, in hundredths of a nat."""
    table = F.from_json(F.lit(json.dumps(model)), "array<int>")  # a constant for the optimiser
    each = F.zip_with(codes(value), F.slice(codes(value), 2, F.greatest(F.length(value), F.lit(1))), lambda a, b: F.when((a > 0) & (b > 0), F.get(table, (a - 1) * len(ALPHABET) + b - 1)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def find(df: DataFrame, model: list[int], text: str = "text", threshold: float = THRESHOLD, out: str = "secrets") -> DataFrame:
    """``df`` with array ``out`` of struct(start, rank, end, kind, value, score), by start, then kind.

    ``start`` and ``end`` count code points, end exclusive. ``score`` is in nats, and null for base kinds.
    """
    names = [quoted(c) for c in without(df.columns, out)]
    body, *own = fresh(df.columns, "body", *(f"{part}_{k}" for part in ("hit", "gap", "at") for k in KINDS))
    hits, gaps, ats = (dict(zip(KINDS, own[i : i + len(KINDS)], strict=True)) for i in range(0, len(own), len(KINDS)))
    none = F.array().cast("array<string>")
    got = df.select(*names, F.coalesce(F.col(quoted(text)), F.lit("")).alias(body))
    got = got.select(*names, body, *(F.when(F.col(body).rlike(HINTS[k]), F.regexp_extract_all(body, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(hits[k]) for k in KINDS))
    got = got.select(*names, *hits.values(), *(F.when(F.size(hits[k]) > 0, F.split(body, PATTERNS[k], -1)).otherwise(none).alias(gaps[k]) for k in KINDS))

    def steps(k: str) -> Column:
        return F.transform(hits[k], lambda h, i: F.length(F.get(gaps[k], i)) + F.when(i > 0, F.length(F.get(hits[k], i - 1))).otherwise(0))

    got = got.withColumns({ats[k]: F.when(F.size(hits[k]) > 0, running_sum(steps(k))).otherwise(F.array().cast("array<int>")) for k in KINDS})

    def spans(k: str) -> Column:
        score = (lambda h: F.when(h.rlike("[0-9]") & h.rlike("[A-Za-z]"), ratio(h, model) / 100)) if k == "random" else (lambda h: F.lit(None).cast("double"))
        one = lambda h, i: F.struct(F.get(ats[k], i).alias("start"), F.lit(KINDS.index(k)).alias("rank"), (F.get(ats[k], i) + F.length(h)).alias("end"), F.lit(k).alias("kind"), h.alias("value"), score(h).alias("score"))
        kept = {"assign": lambda s: s["value"].rlike(VALUE), "random": lambda s: F.coalesce(s["score"] >= threshold, F.lit(False))}.get(k, lambda s: F.lit(True))
        return F.filter(F.transform(hits[k], one), kept)

    kind = "array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>"
    every = [F.when(F.size(hits[k]) > 0, spans(k)).otherwise(F.array().cast(kind)).cast(kind) for k in KINDS]
    return got.select(*names, F.array_sort(F.concat(*every)).alias(out))


def redact(df: DataFrame, model: list[int], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with the spans of ``text`` replaced by ``[SECRET]``; overlapping spans become one."""
    whole, spans = fresh(df.columns, "whole", "spans")
    found = find(df.withColumn(whole, F.coalesce(F.col(quoted(text)), F.lit(""))), model, text, threshold, spans)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("made"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col(whole), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["made"], F.array(gap))).otherwise(acc["made"]).alias("made"))

    clean = F.aggregate(spans, start, step, lambda acc: F.array_join(F.concat(acc["made"], F.array(F.substr(F.col(whole), acc["at"] + 1))), "[SECRET]"))
    return found.withColumn(text, F.when(F.col(quoted(text)).isNotNull(), clean)).drop(whole, spans)


def digest(docs: DataFrame, model: list[int] | None = None) -> DataFrame:
    """The contract's columns of :func:`find`, by a model of the documents' own labelled sample unless one is given."""
    model = fit(labelled(docs)) if model is None else model
    found = find(docs.select("doc_id", "text"), model)
    named = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(named(F.filter("secrets", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"), named("secrets").alias("spans"))


def sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for :func:`digest` over ``documents``, the labelled sample and the model included."""
    width, table = len(ALPHABET), "list_transform(string_split({}, ''), lambda c : instr('" + ALPHABET + "', c))"
    cap = lambda w: f"upper({w}[1]) || lower({w}[2:])"
    forms = ["one", "one || '_' || two || '_' || three", f"lower(one) || {cap('two')} || {cap('three')}", "one || '-' || two || '-' || three", "upper(one || '_' || two)"]
    forms += [f"lower(one) || {cap('two')} || {cap('three')} || {cap('one')} || n % 10", "one || '_' || two || '_' || n % 100", "one || '/' || two || '/' || three"]
    ordinary = f"CASE n % {len(forms)} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"
    plain = {"assign": rf"""(?:{_KEYS})[""'']?\x20*[:=]\x20*[""'']?[A-Za-z0-9+/_.=-]+""".replace('""', '"'), "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "random": rf"[A-Za-z0-9+/_=-]{{{LEAST_RANDOM},}}"}
    score = f"list_sum(list_transform(range(1, length(value)), lambda i : m[(c[i] - 1) * {width} + c[i + 1]]))"
    checks = {"assign": "regexp_matches(value, '" + VALUE.replace(r"\"'", "\"''") + "')", "random": f"regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND {score} >= {100 * threshold}"}
    parts = []
    for rank, k in enumerate(KINDS):
        parts.append(f"""
SELECT rid, '{k}' AS kind, {rank} AS rank, start, start + length(value) AS stop FROM (
  SELECT rid, hits[i] AS value, {table.format('hits[i]')} AS c, CAST(list_sum(list_transform(gaps[1:i], lambda x : length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x : length(x))), 0) AS BIGINT) AS start
  FROM (SELECT rid, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT rid, regexp_extract_all(body, '{plain[k]}') AS hits, string_split_regex(body, '{plain[k]}') AS gaps FROM t) WHERE len(hits) > 0)
), model WHERE {checks.get(k, "true")}""")
    text = "kind || ':' || start || ':' || stop"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT key, regexp_extract_all(text, '[A-Za-z]+')[1:{SAMPLE_WORDS}] AS w FROM (SELECT DISTINCT md5(text) AS key, text FROM documents WHERE text IS NOT NULL ORDER BY key LIMIT {SAMPLE})),
z AS (SELECT key, n, w[n + 1] AS one, coalesce(w[n + 2], 'a') AS two, coalesce(w[n + 3], 'a') AS three, sha256(key || ':' || n) AS h FROM (SELECT *, unnest(range(0, len(w))) AS n FROM w)),
v AS (SELECT {ordinary} AS value, false AS random FROM z UNION ALL SELECT CASE n % 3 WHEN 0 THEN h[1:40] WHEN 1 THEN upper(h[1:40]) ELSE to_base64(unhex(h)) END, true FROM z),
p AS (SELECT random, c[i] AS a, c[i + 1] AS b FROM (SELECT random, c, unnest(range(1, len(c))) AS i FROM (SELECT random, {table.format('value')} AS c FROM v))),
n AS (SELECT random, a, b, COUNT(*) AS n FROM p WHERE a > 0 AND b > 0 GROUP BY ALL),
g AS (SELECT random, a, b, coalesce(n, 0) AS n FROM (SELECT * FROM (VALUES (true), (false)) AS r(random), range(1, {width + 1}) AS x(a), range(1, {width + 1}) AS y(b)) LEFT JOIN n USING (random, a, b)),
l AS (SELECT random, a, b, ln((n + 4 * ((SUM(n) OVER (PARTITION BY random, b) + 0.5::DOUBLE) / (SUM(n) OVER (PARTITION BY random) + {0.5 * width}::DOUBLE))) / (SUM(n) OVER (PARTITION BY random, a) + 4)) AS p FROM g),
model AS (SELECT list(CAST(round(100 * (r.p - i.p)) AS BIGINT) ORDER BY r.a, r.b) AS m FROM l r JOIN l i USING (a, b) WHERE r.random AND NOT i.random),
s AS ({" UNION ALL ".join(parts)}),
f AS (SELECT rid, {", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in KINDS)}, coalesce(string_agg({text}, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '') AS base, string_agg({text}, ',' ORDER BY start, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN f USING (rid)"""
