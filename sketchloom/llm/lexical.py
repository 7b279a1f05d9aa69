"""Ranked lexical search of all documents for a set of items, by classes of documents that no item can tell apart.

Only the items' terms matter to a score, besides a document's length measure ``m``. So a document is reduced to its *bag*,
the counts of those terms, and documents of equal bag and m are one class: they are grouped by a hash, their m and the
bag itself, so a hash that two bags share joins nothing. A class is scored once. An item's best documents lie in its best classes,
ordered by score and the class's smallest id: each class before another holds a document before all of the other's,
so ``top`` classes hold the ``top`` documents. Of each such class the members of the smallest ids are read back,
and a last ranking orders them.

Reading the documents is one Arrow pass, which writes a narrow row for each (id, length, bag). Document frequencies, scores and the
best classes of a task are computed over the classes in Arrow batches; a task hands on at most ``top`` classes for each item, and only the
members of chosen classes are ranked, at most ``top`` of a class in each task before they are shuffled (a window's group limit). Nothing is cut
off that could be in a result.

The items' terms are broadcast, and as many numbers as there are terms go through the driver. If there are more than
``VOCABULARY`` of them, or more than ``ITEMS`` items, items are dealt into blocks by a hash and each block searches all documents on its own; statistics are of all documents in any case.

Defined results: a null or empty text has no terms and isn't counted; very long texts are read whole; a repeated row is a document of
its own, so an id may come twice for an item; ids may be null and come last among equal scores; texts of the same
item are one item with the terms of all of them, and a null item_id is an item; items without terms, or without a matching document, have no
rows; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchloom.session import BROADCAST_ROWS, bounded_batches, lean, materialize, measured, quoted, small

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same in UTF-8, once A-Z are lower-case.
BYTES = rb"[0-9a-z\x80-\xff]+"
TOP = 50
#: Terms and items of a block; the driver and each worker hold the terms, and a worker its best classes for each item.
VOCABULARY, ITEMS = 1_000_000, 5_000
#: Additions to scores that a worker holds at a time, and scores (classes by items).
ADDED, CELLS = 500_000, 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """item_id and its different terms; items without terms have no rows."""
    low = F.translate(F.col(quoted(text)), _UPPER, _LOWER)
    return items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))).alias("term")).distinct()


def bags(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """doc_id, the number of all terms, and the bag: pairs of term number and count as 32-bit integers, by number."""
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): k for t, k in terms.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found = shared.value.get, re.compile(BYTES).findall
        for batch in batches:
            lengths, made = [], []
            for value in batch.column(1):
                words = found(value.as_buffer().to_pybytes().lower()) if value.is_valid else []
                held = np.fromiter((k for k in map(number, words) if k is not None), dtype=np.int32)
                own, count = np.unique(held, return_counts=True)
                lengths.append(len(words))
                made.append(np.stack([own, count.astype(np.int32)], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n", "bag"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n long, bag binary")


def classes(found: DataFrame, documents: int, terms: int) -> DataFrame:
    """The bags with their class's key: ``h``, ``m`` and ``bag``; bags of no term are left out."""
    m = F.expr(f"CAST((50 * CAST(n AS DECIMAL(18, 0)) * CAST({documents} AS DECIMAL(15, 0))) div {terms} + 50 AS BIGINT)")
    return found.where(F.length("bag") > 0).withColumn("m", m).withColumn("h", F.xxhash64("m", "bag"))


def _parsed(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and count of each pair in a batch's bags."""
    raw = batch.column(batch.schema.get_field_index(column)).to_pylist()
    pairs = np.frombuffer(b"".join(raw), dtype=np.int32).reshape(-1, 2)
    return np.repeat(np.arange(len(raw)), [len(b) // 8 for b in raw]), pairs[:, 0], pairs[:, 1].astype(np.int64)


def frequencies(grouped: DataFrame, size: int) -> dict[int, int]:
    """Documents that hold each term, from classes and their numbers of members; as many numbers as terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            row, term, _ = _parsed(batch, "bag")
            np.add.at(held, term, batch.column(batch.schema.get_field_index("members")).to_numpy()[row])
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["term", "held"])

    return {r["term"]: r["df"] for r in grouped.select("bag", "members").mapInArrow(run, "term long, held long").groupBy("term").agg(F.sum("held").alias("df")).collect()}


def best_classes(grouped: DataFrame, items: list, held: list[np.ndarray], weight: np.ndarray, top: int) -> DataFrame:
    """The item's number, score and key of its ``top`` classes or more, each scored once; from every task ``top`` of an item at most."""
    start = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
    shared = grouped.sparkSession.sparkContext.broadcast((start, np.concatenate([*held, np.empty(0, dtype=np.int32)]), weight))
    many = len(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, flat, weight = shared.value
        by_term = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(many), np.diff(start))[by_term]  # the items of each term, term after term
        first = np.searchsorted(flat[by_term], np.arange(len(weight) + 1))
        kept = pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "first_id": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "m": pa.array([], pa.int64()), "bag": pa.array([], pa.binary())})
        for whole in batches:
            row, term, tf = _parsed(whole, "bag")
            met = first[term + 1] - first[term]
            upto = np.cumsum(np.bincount(row, weights=met, minlength=whole.num_rows)).astype(np.int64)
            at = 0
            while at < whole.num_rows:
                done = upto[at - 1] if at else 0
                end = min(max(at + 1, int(np.searchsorted(upto, done + ADDED, side="right"))), at + max(1, CELLS // many), whole.num_rows)
                one, two = np.searchsorted(row, [at, end])
                batch, part_row, many_met = whole.slice(at, end - at), row[one:two] - at, met[one:two]
                m = batch.column(batch.schema.get_field_index("m")).to_numpy()[part_row]
                part = weight[term[one:two]] * ((1_000_000_000 * tf[one:two]) // (1000 * tf[one:two] + 20 * m))
                place = np.arange(many_met.sum()) - np.repeat(np.cumsum(many_met) - many_met - first[term[one:two]], many_met)
                scores = np.zeros(batch.num_rows * many, dtype=np.int64)
                np.add.at(scores, np.repeat(part_row * many, many_met) + owner[place], np.repeat(part, many_met))
                met_at = np.flatnonzero(scores)
                r = met_at // many
                keys = batch.select(["first_id", "h", "m"]).take(pa.array(r))
                new = pa.Table.from_arrays([pa.array(met_at % many), pa.array(scores[met_at]), *keys.columns, pa.array(r + at)], kept.schema.names[:-1] + ["row"])
                new = leading(new, top)  # only of these the bags are copied
                bags_of = whole.column(whole.schema.get_field_index("bag")).take(new.column("row"))
                kept = leading(pa.concat_tables([kept, new.drop(["row"]).append_column("bag", bags_of)]), top)
                at = end
        yield from kept.combine_chunks().to_batches(max_chunksize=1000)

    return grouped.select("first_id", "h", "m", "bag").mapInArrow(lean(run), "item long, score long, first_id long, h long, m long, bag binary")


def leading(rows: pa.Table, top: int) -> pa.Table:
    """The ``top`` rows of each item, by score and the smallest id, null last."""
    item, score, h = (rows.column(c).to_numpy() for c in ("item", "score", "h"))
    ids = rows.column("first_id").combine_chunks()
    none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    order = np.lexsort((h, ids, none, -score, item))
    ordered = item[order]
    place = np.arange(len(order)) - np.searchsorted(ordered, ordered, side="left")
    return rows.take(pa.array(order[place < top]))


def _searched(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """:func:`search` for items whose terms the driver may hold: one row for each item and term at most."""
    spark: SparkSession = docs.sparkSession
    rows = items.groupBy("item_id").agg(F.collect_set("term").alias("terms")).collect()
    terms = {t: k for k, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
    ids = [r["item_id"] for r in rows]
    held = [np.array(sorted(terms[t] for t in r["terms"]), dtype=np.int32) for r in rows]
    found, seen = measured(bags(docs, terms), "bags", documents=F.count_if(F.col("n") > 0), terms=F.coalesce(F.sum("n"), F.lit(0)))
    kind = items.schema["item_id"].dataType
    if not seen["terms"] or not ids:
        return spark.createDataFrame([], items.select("item_id").schema).selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score").where("false")
    keyed = classes(found, seen["documents"], seen["terms"])
    grouped = materialize(keyed.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("members")), "classes")
    df = frequencies(grouped, len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * seen["documents"] + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(terms))], dtype=np.int64)
    chosen = best_classes(grouped, ids, held, weight, top)
    by_class = Window.partitionBy("item").orderBy(F.desc("score"), F.col("first_id").asc_nulls_last(), "h")
    chosen = materialize(chosen.withColumn("at", F.row_number().over(by_class)).where(F.col("at") <= top).select("item", "score", "h", "m", "bag"), "chosen")
    wanted = small(chosen.select("h", "m").distinct(), min(len(ids) * top, BROADCAST_ROWS + 1))  # the join with chosen tells bags of one hash apart
    member = Window.partitionBy("h", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    members = keyed.join(wanted, ["h", "m"], "left_semi").select("doc_id", "h", "m", "bag").withColumn("at", F.row_number().over(member)).where(F.col("at") <= top).drop("at")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = members.join(chosen, ["h", "m", "bag"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], f"item long, item_id {kind.simpleString()}")
    return ranked.join(small(names, len(ids)), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, text: str = "text", top: int = TOP, vocabulary: int = VOCABULARY, many: int = ITEMS) -> DataFrame:
    """item_id, rank from 1, doc_id and score of each item's ``top`` documents with a score above 0."""
    own = materialize(item_terms(items, text), "item-terms")
    size = own.agg(F.count("*").alias("terms"), F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items")).first()
    blocks = max(-(-size["terms"] // vocabulary), -(-size["items"] // many))
    if blocks <= 1:
        return _searched(docs, own, top)
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out, *more = [materialize(_searched(docs, own.where(part == b), top), "ranked") for b in range(blocks)]
    for d in more:
        out = out.unionByName(d)
    return out


def sql(top: int = TOP) -> str:
    """DuckDB SQL for :func:`search` over ``documents`` and ``benchmark``."""
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({low}, '{TERM}') AS words FROM documents WHERE text IS NOT NULL),
c AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(words)) AS BIGINT) AS big_l FROM d WHERE len(words) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({low}, '{TERM}')) AS term FROM benchmark WHERE text IS NOT NULL),
v AS (SELECT DISTINCT term FROM i),
e AS (SELECT rid, doc_id, len(words) AS n, unnest(words) AS term FROM d),
t AS (SELECT rid, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM e SEMI JOIN v USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM t, c GROUP BY term),
s AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
      FROM t JOIN w USING (term) JOIN i USING (term), c GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {top}"""
