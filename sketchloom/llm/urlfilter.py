"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

The vocabulary has strict and soft terms, read from a file (:func:`read_vocabulary`) or a table
(:func:`vocabulary_of`). A term counts where both neighbours in the
lower-cased (A-Z) url are no ASCII letters or digits. One strict term rejects; soft
terms reject when at least ``min_distinct`` different ones occur. The sum of their weights is given as a score.

Defined results: a null url, or one without ``://``, has an empty host and path and fits
no rule; the vocabulary is still looked for in it (null: nothing found). Very long urls
are read whole; repeated rows repeat; an empty table gives an empty result; columns of the
input that are called like the result's are replaced by it, all others pass through.
Rules and terms are parameters: their size is the caller's and doesn't grow with the data; a table of more than ``MOST_TERMS`` terms is refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.session import driver_file, fresh, quoted, without

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...]
    soft: tuple[tuple[str, float], ...]
    min_distinct: int = 2


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: The vocabulary that comes with the package: term, kind and weight in columns parted by tabs.
TERMS = str(Path(__file__).with_name("url_terms.tsv"))
MOST_TERMS = 100_000


def _vocabulary(rows: Iterable[tuple[str, str, float]], min_distinct: int) -> Vocabulary:
    strict, soft = set(), {}
    for term, kind, weight in rows:
        term = term.translate(str.maketrans(LETTERS, LETTERS.lower()))
        if kind not in ("strict", "soft") or not term:
            raise ValueError(f"a term is strict or soft: {term!r}, {kind!r}")
        if kind == "strict":
            strict.add(term)
        else:
            soft[term] = float(weight)
    return Vocabulary(tuple(sorted(strict)), tuple(sorted((t, w) for t, w in soft.items() if t not in strict)), min_distinct)


def read_vocabulary(path: str = TERMS, min_distinct: int = 2) -> Vocabulary:
    """A vocabulary from a small local file; lines that start with # say nothing."""
    lines = [x.split("\t") for x in driver_file(path).decode().splitlines() if x and not x.startswith("#")]
    return _vocabulary(((t, k, float(w)) for t, k, w in lines), min_distinct)


def vocabulary_of(terms: DataFrame, min_distinct: int = 2) -> Vocabulary:
    """A vocabulary from a table with columns term, kind and weight."""
    rows = terms.select("term", "kind", F.col("weight").cast("double")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return _vocabulary(rows, min_distinct)


_automata: dict[Vocabulary, object] = {}


def automaton(vocabulary: Vocabulary):
    """Built once in each Python worker."""
    if vocabulary not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for term in vocabulary.strict:
            made.add_word(term, (term, len(term), -1.0))
        for term, weight in vocabulary.soft:
            made.add_word(term, (term, len(term), weight))
        made.make_automaton()
        _automata[vocabulary] = made
    return _automata[vocabulary]


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def hits(url: str, vocabulary: Vocabulary) -> tuple[list[str], list[str], float]:
    """Distinct strict terms, distinct soft terms and the soft terms' weight, of a lower-cased url."""
    strict, soft = set(), {}
    for last, (term, n, weight) in automaton(vocabulary).iter(url):
        if (last < n or not _plain(url[last - n])) and (last + 1 == len(url) or not _plain(url[last + 1])):
            if weight < 0:
                strict.add(term)
            else:
                soft[term] = weight
    return sorted(strict), sorted(soft), float(sum(soft[x] for x in sorted(soft)))


def finder(vocabulary: Vocabulary):
    @F.pandas_udf("strict array<string>, soft array<string>, weight double")
    def find(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in urls:
            yield pd.DataFrame([hits(u or "", vocabulary) for u in batch], columns=["strict", "soft", "weight"])

    return find


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, LETTERS, LETTERS.lower()), path


def judge(df: DataFrame, url: str = "url", rules: Sequence[Rule] = RULES, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``df`` with host, path, rule, verdict, strict_terms, soft_terms and soft_weight."""
    made = ("host", "path", "rule", "verdict", "strict_terms", "soft_terms", "soft_weight")
    vocabulary = read_vocabulary() if vocabulary is None else vocabulary
    kept = [quoted(c) for c in without(df.columns, *made)]
    found, = fresh((*df.columns, *made), "terms")
    address = F.col(quoted(url))
    host, path = host_path(address)
    terms = finder(vocabulary)(F.translate(address, LETTERS, LETTERS.lower()))
    got = df.select(*kept, host.alias("host"), path.alias("path"), terms.alias(found))
    by_length = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [(F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host)) for r in by_length]
    fits = [f & F.startswith(F.col("path"), F.lit(r.path)) for f, r in zip(fits, by_length, strict=True)]
    rule = F.coalesce(*(F.when(f, F.lit(r.text)) for f, r in zip(fits, by_length, strict=True)), F.lit(None).cast("string"))
    said = F.coalesce(*(F.when(f, F.lit(r.verdict)) for f, r in zip(fits, by_length, strict=True)), F.lit(None).cast("string"))
    term = lambda c: F.col(found)[c]
    bad = (F.size(term("strict")) > 0) | (F.size(term("soft")) >= vocabulary.min_distinct)
    return got.select(
        *kept, "host", "path", rule.alias("rule"),
        F.coalesce(said, F.when(bad, "block").otherwise("allow")).alias("verdict"),
        term("strict").alias("strict_terms"), term("soft").alias("soft_terms"), term("weight").alias("soft_weight"),
    )


def digest(df: DataFrame) -> DataFrame:
    got = judge(df.select("page_id", "url"))
    return got.select("page_id", "host", "path", "rule", "verdict", F.size("strict_terms").cast("long").alias("n_strict"), F.size("soft_terms").cast("long").alias("n_soft"))


def sql(rules: Sequence[Rule] = RULES, vocabulary: Vocabulary | None = None) -> str:
    """DuckDB SQL for :func:`digest` over ``pages``."""
    vocabulary = read_vocabulary() if vocabulary is None else vocabulary
    by_length = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fit = lambda r: f"((host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    seen = lambda term: f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])') THEN 1 ELSE 0 END"
    strict = " + ".join(seen(x) for x in vocabulary.strict)
    soft = " + ".join(seen(x) for x, _ in vocabulary.soft)
    return f"""
WITH a AS (SELECT page_id, coalesce(translate(url, '{LETTERS}', '{LETTERS.lower()}'), '') AS low,
                  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, low, translate(raw, '{LETTERS}', '{LETTERS.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, {strict} AS n_strict, {soft} AS n_soft FROM c)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {fit(r)} THEN '{r.text}'" for r in by_length)} END AS rule,
       CASE {" ".join(f"WHEN {fit(r)} THEN '{r.verdict}'" for r in by_length)}
            WHEN n_strict > 0 OR n_soft >= {vocabulary.min_distinct} THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n_strict AS BIGINT) AS n_strict, CAST(n_soft AS BIGINT) AS n_soft
FROM d"""
