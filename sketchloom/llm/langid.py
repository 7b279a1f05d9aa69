"""Language identification by Bayesian evidence fusion.

The text's likelihood comes from letter-trigram models of each language and from a model of
unrelated letters, ``und``. It is combined with the declared markup language and with a
prior for the host, which is smoothed towards its address suffix and that towards all
rows: the priors are sums of the rows' own posteriors, grouped by host, and a
row's own part is taken out of its host's prior again.

For pages the declaration is the ``lang`` of the html element, the host and suffix are the url's. For documents ``source`` stands for
the host, and ``lang`` is the label that models are fitted on and the declaration; a row that a model was fitted on has no declaration,
so no label is used twice.

The models are fitted on a bounded sample of labelled rows (at most ``SAMPLE`` rows, those with the smallest hash
of id, label and text), for all labels in it unless languages are named; all else covers every row. Texts are scored once and whole, in one pass that writes
the scores beside the columns that are wanted; priors are grouped sums, and a second pass fuses them with the scores. The prior of a host is a
row for each host, joined by broadcast if there are at most ``BROADCAST_ROWS`` hosts; beyond that only what is wanted of the rows is shuffled.

Defined results: a null or empty text, or one without any letters, is ``und`` and rejected; very long
texts are scored whole; null hosts are one host, null declarations are no evidence; repeated
rows repeat; ties go to the language named first; an empty table gives an empty result;
without any labelled rows there is no model, so nothing is judged: language and probability are null and no row is rejected;
other columns pass through; those called like the result's are replaced by :func:`identify` and left alone by :func:`kept`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from sketchloom.session import bounded_batches, fresh, lean, materialize, plainly_named, quoted, small, without

UNKNOWN = "und"
SAMPLE = 2000
#: Trigrams overlap, so a text's likelihood counts to this power.
TEMPER = 1 / 3
#: Rows that the pooled trigrams count as in each language, and the share of unrelated letters.
SMOOTH, FOREIGN = 500.0, 0.05
TRUST, SUFFIX_ROWS, HOST_ROWS, LEAST = 0.9, 50.0, 20.0, 0.5
#: Bytes of a text that are scored at once.
SEGMENT = 1 << 19

_SYMBOL = np.zeros(256, dtype=np.uint32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 32
_SPACE = 1 << 18


def trigrams(raw: bytes) -> np.ndarray:
    """Numbers of a text's trigrams; letters are a-z and the bytes of other letters, all else is a gap."""
    s = _SYMBOL[np.frombuffer(b" " + raw + b" ", dtype=np.uint8)]
    t = (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]
    return t[t > 0]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # log-probability of each trigram in each language, and of unrelated letters last
    upto: int = 0  # hash of the last row in the sample

    def score(self, text: str | None) -> np.ndarray | None:
        """The log-likelihood under each model; None without letters."""
        if not text:
            return None
        total, n, raw = np.zeros(len(self.languages) + 1), 0, text.encode()
        for at in range(0, len(raw), SEGMENT):
            t = trigrams(raw[max(0, at - 2) : at + SEGMENT])
            n += len(t)
            total += self.table[t].sum(axis=0, dtype=np.float64)
        return total if n else None


def model_of(counts: dict[str, np.ndarray], languages: tuple[str, ...], upto: int = 0) -> Model:
    """Trigram probabilities of each language, mixed with a little of ``und``'s, and ``und``'s own.

    ``und`` draws three unrelated letters, half by how often all texts have them, half evenly. Its part in the
    languages bounds what a foreign name or a key in a text costs them.
    """
    everything = sum(counts.values())
    at = np.arange(_SPACE)
    letters = np.bincount(at >> 12, weights=everything, minlength=64)
    letters = 0.5 * letters / max(1.0, letters.sum()) + 0.5 / 59
    loose = letters[at >> 12] * letters[(at >> 6) & 63] * letters[at & 63]
    pooled = (everything + 1) / (everything.sum() + _SPACE)
    columns = []
    for name in languages:
        own = counts.get(name, np.zeros(_SPACE)) + SMOOTH * pooled
        columns.append((1 - FOREIGN) * own / own.sum() + FOREIGN * loose)
    return Model(languages, np.log(np.stack([*columns, loose], axis=1)).astype(np.float32), upto)


def _place(key: str, lang: str, text: str) -> Column:
    """Where a row stands in the order that samples are drawn in."""
    return F.xxhash64(F.col(quoted(key)).cast("string"), quoted(lang), quoted(text))


def fit(labelled: DataFrame, languages: tuple[str, ...] | None = None, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Models from at most ``sample`` labelled rows, the first by a hash of id, label and text; None if there are none.

    Without ``languages`` they are all of the sample's labels, the most frequent first; a model has a megabyte for each.
    Rows that are the same in all three count once.
    """
    label = F.col(quoted(lang))
    known = label.isin(*languages) if languages else F.length(F.trim(label)) > 0
    rows = labelled.where(known & (F.length(quoted(text)) > 0)).select(label.alias("lang"), F.col(quoted(text)).alias("text"), _place(key, lang, text).alias("place"))
    upto = rows.select("place").orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    if upto is None:
        return None
    picked = rows.where(F.col("place") <= upto).groupBy("place").agg(F.first("lang").alias("lang"), F.first("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.setdefault(name, np.zeros(_SPACE, dtype=np.int64))
                raw = t.as_py().encode()
                for at in range(0, len(raw), SEGMENT):
                    seen[name] += np.bincount(trigrams(raw[max(0, at - 2) : at + SEGMENT]), minlength=_SPACE)
        for name, x in seen.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([x[at].astype(np.int64).tobytes()], pa.binary())], names=["lang", "at", "n"])

    labels = languages or tuple(r["lang"] for r in picked.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect())
    counts = {name: np.zeros(_SPACE, dtype=np.int64) for name in labels}
    for r in picked.where(F.col("lang").isin(*labels)).coalesce(4).mapInArrow(lean(count), "lang string, at binary, n binary").toLocalIterator():  # counts of a bounded sample, language by language
        counts[r["lang"]][np.frombuffer(r["at"], dtype=np.int32)] += np.frombuffer(r["n"], dtype=np.int64)
    return model_of(counts, tuple(labels), upto)


def _shares(logs: np.ndarray) -> np.ndarray:
    """Probabilities from log-weights, a row each."""
    weights = np.exp(logs - logs.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def declared_weights(said: str, languages: tuple[str, ...]) -> np.ndarray:
    """Log-weights that a declaration gives the languages and ``und``; none if it names no known language."""
    n = len(languages)
    if said not in languages:
        return np.zeros(n + 1)
    trust = np.full(n + 1, (1 - TRUST) / max(1, n - 1))
    trust[languages.index(said)], trust[n] = TRUST, 1 / n
    return np.log(trust)


def _lists(values: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists, null where they aren't valid."""
    offsets = pa.array(np.r_[0, np.cumsum(np.full(len(values), values.shape[1]))].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()), mask=pa.array(~valid))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as a matrix, zeros for nulls."""
    out = np.zeros((len(column), width))
    valid = np.asarray(column.is_valid())
    out[valid] = np.asarray(column.drop_null().flatten()).reshape(-1, width)
    return out


def _scores(shared, carried: int, names: list[str]):
    """The first ``carried`` columns of each row, the log-weights of its text and declaration, and what they alone say.

    Text and declaration come after them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            logs, valid = np.zeros((batch.num_rows, len(model.languages) + 1)), np.zeros(batch.num_rows, dtype=bool)
            said = batch.column(carried + 1).to_pylist()
            for i, text in enumerate(batch.column(carried)):
                score = model.score(text.as_py())
                if score is not None:
                    logs[i], valid[i] = score * TEMPER + declared_weights(said[i], model.languages), True
            made = [_lists(logs, valid), _lists(_shares(logs), valid)] if batch.num_rows else [pa.array([], pa.list_(pa.float64()))] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *made], names=[*batch.schema.names[:carried], *names])

    return run


def _fused(kinds: tuple[str, ...], overall: np.ndarray, carried: int, least: float, names: tuple[str, ...]):
    """The first ``carried`` columns of each row and its language, its own part taken out of its host's sums.

    After them come the log-weights, what they alone say, and the sums of the host and of the suffix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = np.asarray(batch.column(carried).is_valid())
            logs, own, host, suffix = (_matrix(batch.column(carried + i), len(kinds)) for i in range(4))
            up = (suffix + SUFFIX_ROWS * overall) / (suffix.sum(axis=1, keepdims=True) + SUFFIX_ROWS)
            rest = np.maximum(host - own, 0)
            p = _shares(logs + np.log((rest + HOST_ROWS * up) / (rest.sum(axis=1, keepdims=True) + HOST_ROWS)))
            best = np.where(lettered, p.argmax(axis=1), len(kinds) - 1)
            sure = np.where(lettered, p.max(axis=1), 1.0)
            made = [pa.array(np.asarray(kinds, dtype=object)[best], pa.string()), pa.array(sure), pa.array((best < len(kinds) - 1) & (sure >= least))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *made], names=[*batch.schema.names[:carried], *names])

    return run


def identify(
    df: DataFrame, model: Model, text: str = "text", declared: Column | str | None = None, host: Column | str | None = None, suffix: Column | str | None = None,
    least: float = LEAST, carry: list[str] | None = None, made: tuple[str, str, str] = ("lang_id", "lang_probability", "lang_kept"),
) -> DataFrame:
    """``df`` with lang_id, lang_probability and lang_kept (a language, with at least probability ``least``).

    ``carry`` names the columns that are wanted besides; all of them by default. ``made`` are the result's names.
    """
    names = without(df.columns if carry is None else carry, *made)
    given = lambda c: F.lit("") if c is None else F.coalesce((F.col(quoted(c)) if isinstance(c, str) else c).cast("string"), F.lit(""))
    said, addressed, called, logs, own, hosts, suffixes, body = fresh([*names, *made], "said", "suffix", "host", "logs", "own", "hosts", "suffixes", "text")
    bounded_batches(df.sparkSession)
    keep = [quoted(c) for c in names]
    spoken = F.lower(F.substring_index(F.translate(given(declared), "_", "-"), "-", 1))
    rows = df.select(*keep, given(suffix).alias(addressed), given(host).alias(called), F.col(quoted(text)).alias(body), spoken.alias(said))
    shared = df.sparkSession.sparkContext.broadcast(model)
    lists = [StructField(c, ArrayType(DoubleType())) for c in (logs, own)]
    scored = rows.mapInArrow(lean(_scores(shared, len(names) + 2, [logs, own])), StructType([*rows.schema.fields[:-2], *lists]))
    scored = materialize(scored, "lang-scores")

    kinds, n = (*model.languages, UNKNOWN), len(model.languages) + 1
    sums = lambda c: F.array(*(F.sum(F.get(c, F.lit(k))) for k in range(n)))
    by_host = materialize(scored.where(F.col(own).isNotNull()).groupBy(addressed, called).agg(sums(own).alias(hosts)), "lang-hosts")
    by_suffix = by_host.groupBy(addressed).agg(sums(hosts).alias(suffixes))
    seen = np.array([float(x or 0) for x in by_host.agg(sums(hosts)).first()[0]])
    overall = (seen + 1) / (seen.sum() + n)
    both = scored.join(small(by_host.join(small(by_suffix), addressed)), [addressed, called], "left").select(*keep, logs, own, hosts, suffixes)
    schema = StructType([*(df.schema[c] for c in names), StructField(made[0], StringType()), StructField(made[1], DoubleType()), StructField(made[2], BooleanType())])
    return both.mapInArrow(lean(_fused(kinds, overall, len(names), least, made)), schema)


def identified(docs: DataFrame, languages: tuple[str, ...] | None = None, sample: int = SAMPLE, carry: list[str] | None = None, made: tuple[str, str, str] = ("lang_id", "lang_probability", "lang_kept"), model: Model | None = None) -> DataFrame:
    """:func:`identify` for documents: ``lang`` is what they declare, ``source`` their host, its last part after a dot the suffix.

    A row that the model was fitted on declares nothing: its label is in the model already.
    """
    model = fit(docs, languages, sample) if model is None else model  # looked for again in digest, where there is nothing to fit on
    if model is None:
        kept = [quoted(c) for c in without(docs.columns if carry is None else carry, *made)]
        return docs.select(*kept, F.lit(None).cast("string").alias(made[0]), F.lit(None).cast("double").alias(made[1]), F.lit(True).alias(made[2]))
    said = F.when(F.coalesce(_place("doc_id", "lang", "text") > model.upto, F.lit(True)), F.col("lang"))
    suffix = F.regexp_extract(F.coalesce("source", F.lit("")), r"\.([A-Za-z]+)$", 1)
    return identify(docs, model, "text", said, "source", suffix, carry=carry, made=made)


def page_parts(url: Column, html: Column) -> tuple[Column, Column, Column, Column]:
    """A page's visible text, the language its html element declares, its host and its address suffix."""
    lean_html = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(lean_html, r"<[^>]*+>", " "), r"&#?[A-Za-z0-9]{1,10};", " ")
    declared = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    return text, declared, host, F.regexp_extract(host, r"\.([a-z]+)(?::\d+)?$", 1)


def identified_pages(pages: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """:func:`identify` for web pages (columns url and html), with a model fitted elsewhere."""
    text, declared, host, suffix = page_parts(F.col("url"), F.col("html"))
    keep = pages.columns if carry is None else carry
    body, = fresh(pages.columns, "text")
    return identify(pages.withColumn(body, text), model, body, declared, host, suffix, carry=keep)


def digest(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Language, probability and verdict of every document (``doc_id``) and every page (``page_id``), by one model, fitted on documents."""
    model = fit(docs)
    found = identified(docs.select("doc_id", "text", "lang", "source"), carry=["doc_id"], model=model)
    if model is None:
        of_pages = pages.select("page_id", F.lit(None).cast("string").alias("lang_id"), F.lit(None).cast("double").alias("lang_probability"), F.lit(True).alias("lang_kept"))
    else:
        of_pages = identified_pages(pages.select("page_id", "url", "html"), model, ["page_id"])
    found = found.unionByName(of_pages, allowMissingColumns=True)
    return found.select("doc_id", "page_id", "lang_id", F.round("lang_probability", 6).alias("lang_probability"), F.col("lang_kept").alias("kept"))


def kept(docs: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is known, with all their columns."""

    def run(named: DataFrame) -> DataFrame:
        made = tuple(fresh(named.columns, "lang_id", "lang_probability", "lang_kept"))
        return identified(named, languages, made=made).where(made[2]).select(*(quoted(c) for c in named.columns))

    return plainly_named(docs, run)
