"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

The whole operator is DataFrame expressions, has no shuffle and no Python on the
executors.  A span's place comes from splitting the text by the same pattern: the
lengths of the gaps and of the matches, summed up, are code-point offsets.

Kinds are listed in ``KINDS``. ``email``, ``ip``, ``card`` and ``phone`` are the base
kinds; they are kept whenever their own check passes, whatever the context says.
``iban`` (mod-97) and ``ssn`` are added by the method and kept when their score
reaches ``threshold``.

Defined results: a null text counts as empty and has no spans; an empty text has
none; very long texts are read whole, and running sums are built block by block,
so a text with n matches costs about n * sqrt(n) at worst; repeated rows give
repeated results; other columns pass through untouched, also those that are called
like ours, since the result's own columns are added under the names given here and
replace clashing ones; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.session import fresh, quoted, without

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

# Matches start at the start of a run of their characters, or where the last match
# ended; the same matches as without that condition, without rescans of long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"

#: kind: score before context, words that raise it, words that lower it.
CONTEXT = {
    "email": (0.9, r"mail|contact|write to|@", r"example of|noreply"),
    "ip": (0.6, r"\bip\b|address|server|host|login", r"version|release|section|build"),
    "card": (0.8, r"card|visa|master|amex|credit|debit|pay", r"order|isbn|serial|tracking|invoice"),
    "phone": (0.6, r"phone|tel|call|mobile|fax|whatsapp", r"version|score|total"),
    "iban": (0.9, r"iban|account|bank|konto|compte|cuenta", r"part no|serial"),
    "ssn": (0.4, r"ssn|social|security|taxpayer|tin\b", r"part|serial|model|sku"),
}
CONTEXT_CHARS = 40
BLOCK = 512


def luhn(digits: Column) -> Column:
    """True if a string of ASCII digits passes the Luhn check."""
    back = F.reverse(digits)

    def one(i: Column) -> Column:
        d = F.ascii(F.substr(back, i + 1, F.lit(1))) - 48
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + one(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN, spaces removed, has remainder 1 modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i + 1, F.lit(1)))
        return F.when(c < 58, acc * 10 + c - 48).otherwise(acc * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(0), F.length(turned) - 1), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.length(digits).between(12, 19) & luhn(F.substr(digits, F.lit(1), F.lit(19)))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        compact = F.translate(value, " ", "")
        return F.length(compact).between(15, 34) & mod97(compact)
    if kind == "ssn":
        return ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def running_sum(steps: Column) -> Column:
    """Prefix sums of an array of integers, by blocks, so that no long array is rebuilt for each element."""

    def within(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: within(F.slice(steps, b * BLOCK + 1, BLOCK)))
    before = lambda done: F.aggregate(done, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(p, -1))))
    long = F.flatten(F.transform(F.arrays_zip(blocks.alias("p"), F.slice(before(blocks), 1, F.size(blocks)).alias("o")), lambda z: F.transform(z["p"], lambda x: x + z["o"])))
    return F.when(F.size(steps) <= BLOCK, within(steps)).otherwise(long)


def may_hold(kind: str, text: Column, digits: Column) -> Column:
    """A cheap test that most texts without the kind fail."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return digits


def find(df: DataFrame, text: str = "text", threshold: float = 0.6, out: str = "pii") -> DataFrame:
    """``df`` with array ``out`` of struct(start, rank, end, kind, value, score), by start, then kind.

    ``start`` and ``end`` count code points, end exclusive. Base kinds are always kept;
    the others need a score of ``threshold``.
    """
    names = [quoted(c) for c in without(df.columns, out)]
    body, digits, *own = fresh(df.columns, "body", "digits", *(f"{part}_{k}" for part in ("hit", "gap", "at") for k in KINDS))
    hits, gaps, ats = (dict(zip(KINDS, own[i : i + len(KINDS)], strict=True)) for i in range(0, len(own), len(KINDS)))
    empty = F.array().cast("array<string>")
    got = df.select(*names, F.coalesce(F.col(quoted(text)), F.lit("")).alias(body)).withColumn(digits, F.col(body).rlike("[0-9]"))
    got = got.select(*names, body, *(F.when(may_hold(k, F.col(body), F.col(digits)), F.regexp_extract_all(body, F.lit(PATTERNS[k]), F.lit(0))).otherwise(empty).alias(hits[k]) for k in KINDS))
    got = got.select(*names, *hits.values(), *(F.when(F.size(hits[k]) > 0, F.split(body, PATTERNS[k], -1)).otherwise(empty).alias(gaps[k]) for k in KINDS))

    def steps(k: str) -> Column:
        hit, gap = F.col(hits[k]), F.col(gaps[k])
        return F.transform(hit, lambda h, i: F.length(F.get(gap, i)) + F.when(i > 0, F.length(F.get(hit, i - 1))).otherwise(0))

    got = got.withColumns({ats[k]: F.when(F.size(hits[k]) > 0, running_sum(steps(k))).otherwise(F.array().cast("array<int>")) for k in KINDS})

    def spans(k: str) -> Column:
        hit, gap, at = F.col(hits[k]), F.col(gaps[k]), F.col(ats[k])
        score, up, down = CONTEXT[k]

        def one(h: Column, i: Column) -> Column:
            near = F.lower(F.concat(F.right(F.get(gap, i), F.lit(CONTEXT_CHARS)), F.lit(" \x1f "), F.left(F.get(gap, i + 1), F.lit(CONTEXT_CHARS))))
            value = F.round(F.lit(score) + F.when(near.rlike(up), 0.3).otherwise(0.0) - F.when(near.rlike(down), 0.3).otherwise(0.0), 2)
            return F.struct(F.get(at, i).alias("start"), F.lit(KINDS.index(k)).alias("rank"), (F.get(at, i) + F.length(h)).alias("end"), F.lit(k).alias("kind"), h.alias("value"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("score"))

        made = F.filter(F.transform(hit, one), lambda s: confirmed(k, s["value"]))
        return made if k in BASE else F.filter(made, lambda s: s["score"] >= threshold)

    none = "array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>"
    every = [F.when(F.size(hits[k]) > 0, spans(k)).otherwise(F.array().cast(none)).cast(none) for k in KINDS]
    return got.select(*names, F.array_sort(F.concat(*every)).alias(out))


def redact(df: DataFrame, text: str = "text", threshold: float = 0.6) -> DataFrame:
    """``df`` with the spans of ``text`` replaced by ``[KIND]``; overlapping spans become one, named after the first."""
    whole, spans = fresh(df.columns, "whole", "spans")
    found = find(df.withColumn(whole, F.coalesce(F.col(quoted(text)), F.lit(""))), text, threshold, spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col(whole), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["made"], mark).alias("made"))

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["made"], F.substr(F.col(whole), acc["at"] + 1)))
    return found.withColumn(text, F.when(F.col(quoted(text)).isNotNull(), clean)).drop(whole, spans)


def digest(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The contract's columns of :func:`find`: counts, a hash of the base spans, and all spans."""
    found = find(df.select("doc_id", "text"), "text", threshold, "pii")
    named = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(named(F.filter("pii", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
        named("pii").alias("spans"),
        F.concat_ws(",", F.transform("pii", lambda s: F.format_number(s["score"], 2))).alias("scores"),
    )


#: The same patterns without look-around, which DuckDB's engine doesn't need for speed and doesn't have.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_CHECKS = {
    "email": "true",
    "ip": "len(list_filter(string_split(value, '.'), lambda p : length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0",
    "card": "length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i : CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(substr(digits, i, 1) AS INTEGER) "
    "ELSE 2 * CAST(substr(digits, i, 1) AS INTEGER) - CASE WHEN CAST(substr(digits, i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    "phone": "length(digits) BETWEEN 9 AND 15",
    "iban": "length(replace(value, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(value, ' ', ''), 5) || substr(replace(value, ' ', ''), 1, 4), ''), lambda c : ascii(c))), "
    "lambda a, c : CASE WHEN c < 58 THEN a * 10 + c - 48 ELSE a * 100 + c - 55 END % 97) = 1",
    "ssn": "NOT regexp_matches(value, '^(?:000|666|9)|-00-|-0000$')",
}


def sql(threshold: float = 0.6) -> str:
    """DuckDB SQL for :func:`digest` over ``documents``."""
    parts = []
    for rank, k in enumerate(KINDS):
        score, up, down = CONTEXT[k]
        pattern = _PLAIN[k]
        near = "lower(right(gaps[i], 40) || ' ' || left(gaps[i + 1], 40))"
        points = f"round({score} + CASE WHEN regexp_matches({near}, '{up}') THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches({near}, '{down}') THEN 0.3 ELSE 0 END, 2)"
        parts.append(f"""
SELECT rid, '{k}' AS kind, {rank} AS rank, start, start + length(value) AS stop, GREATEST(0, LEAST(1, {points})) AS score FROM (
  SELECT rid, i, gaps, hits[i] AS value, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits,
         CAST(list_sum(list_transform(gaps[1:i], lambda x : length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x : length(x))), 0) AS BIGINT) AS start
  FROM (SELECT rid, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT rid, regexp_extract_all(body, '{pattern}') AS hits, string_split_regex(body, '{pattern}') AS gaps FROM t) WHERE len(hits) > 0)
) WHERE {_CHECKS[k]}{"" if k in BASE else f" AND GREATEST(0, LEAST(1, {points})) >= {threshold}"}""")
    text = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in KINDS)
    zero = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT rid, {counts}, coalesce(string_agg({text}, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '') AS base,
             string_agg({text}, ',' ORDER BY start, rank) AS spans, string_agg(printf('%.2f', score), ',' ORDER BY start, rank) AS scores FROM s GROUP BY rid)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM t LEFT JOIN g USING (rid)"""
