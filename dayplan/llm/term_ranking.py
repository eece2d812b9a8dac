"""Ranked lexical search by accumulator-limited term-at-a-time (operator 13).

Documents are indexed in segments of about two million terms: for each term the documents of
the segment that hold it and how often, besides the greatest frequency and the least document
length, which bound what the term can add to a score.  Segments are written once and can be
searched for any queries.

A search first sums document counts and lengths over all segments, as weights need them, and
then takes the queries to every segment.  There the terms of a query are taken one after the
other, rarest first.  A document gets an accumulator when a term meets it first.  As soon as
the bounds of the remaining terms together are below the k-th best partial score known to
the task, no document without an accumulator can be among the k best any more: no further
ones are created, and the remaining terms update those that there are, exactly.  Queries of a
block keep step, so that a step is a few array operations however small a segment is.  Each
task hands on the k best documents of a query, and a window keeps the k best of all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayplan.llm.positional_index import Codes
from dayplan.sources.staging import stage

TOP = 20
#: Terms of a segment, after which the next document starts another one.
SEGMENT_TERMS = 2_000_000
SEGMENT_DOCS = 100_000
#: Bytes of distinct query terms in a block of queries.  A block is broadcast; only a single
#: query with more terms makes a larger one.
BLOCK_BYTES = 4_000_000
#: Accumulators of queries that keep step.
CELLS = 4_000_000

INDEX_SCHEMA = (
    "segment string, doc_ids array<bigint>, lengths array<int>, terms binary, counts binary,"
    " gaps binary, times binary, most binary, least binary"
)
BLOCK_SCHEMA = "block string, items array<string>, ends array<int>, terms array<binary>, repeats array<int>"
FOUND_SCHEMA = "query int, doc_id bigint, score bigint"

#: A-Z in lower case, ASCII but digits and letters blank, everything else as it is.
_TO_TERMS = bytes(
    code + 32 if 65 <= code <= 90 else code if code >= 128 or 48 <= code <= 57 or 97 <= code <= 122 else 32
    for code in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8 in order."""
    return text.translate(_TO_TERMS).split() if text else []


def packed(values: np.ndarray) -> bytes:
    """Numbers of 32 bits by byte planes, which compress well where most are small."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def segment_row(name: str, doc_ids: list, codes: list[np.ndarray], known: Codes) -> list:
    lengths = np.array([len(c) for c in codes], np.int64)
    # One number for term and document, so that equal numbers are repeats of a term in a document.
    stream = np.concatenate(codes).astype(np.int64) * len(codes) + np.repeat(np.arange(len(codes)), lengths)
    postings, times = np.unique(stream, return_counts=True)
    terms, places = np.divmod(postings, len(codes))
    counts = np.bincount(terms, minlength=len(known))
    firsts = np.cumsum(counts) - counts
    gaps = np.diff(places, prepend=0)
    if len(firsts):
        gaps[firsts] = places[firsts]
        most, least = np.maximum.reduceat(times, firsts), np.minimum.reduceat(lengths[places], firsts)
    else:
        most = least = counts
    return [name, doc_ids, lengths.astype(np.int32), b" ".join(known), packed(counts), packed(gaps), packed(times), packed(most), packed(least)]


INDEX_KINDS = pa.schema(
    [("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]
    + [(name, pa.binary()) for name in ("terms", "counts", "gaps", "times", "most", "least")]
)


def one_row(values: list, kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kinds, strict=True)], schema=kinds)


def indexer(segment_terms: int) -> Callable:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, waiting = TaskContext.get().partitionId(), 0, 0
        doc_ids, codes, known = [], [], Codes()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0), texts, strict=True):
                found = terms_of(text.as_py())
                doc_ids.append(doc_id.as_py())
                codes.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                waiting += len(found)
                if waiting >= segment_terms or len(doc_ids) >= SEGMENT_DOCS:
                    yield one_row(segment_row(f"{task}-{made}", doc_ids, codes, known), INDEX_KINDS)
                    made, waiting = made + 1, 0
                    doc_ids, codes, known = [], [], Codes()
        if doc_ids:
            yield one_row(segment_row(f"{task}-{made}", doc_ids, codes, known), INDEX_KINDS)

    return index


def build_index(docs: DataFrame, segment_terms: int = SEGMENT_TERMS) -> DataFrame:
    """The segments of all documents, written to the shared folder and read back.

    Every row is a document: a doc_id that is missing or repeated does not join rows.  A
    missing text has no terms.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(rows.mapInArrow(indexer(segment_terms), INDEX_SCHEMA), "ranking-index")


BLOCK_KINDS = pa.schema(
    [("block", pa.string()), ("items", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("repeats", pa.list_(pa.int32()))]
)


def blocker(block_bytes: int) -> Callable:
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size = TaskContext.get().partitionId(), 0, 0
        items, ends, terms, repeats = [], [], [], []
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                found = Counter(terms_of(text.as_py()))
                items.append(item.as_py())
                terms += found.keys()
                repeats += found.values()
                ends.append(len(terms))
                size += sum(map(len, found)) + 8 * len(found) + 8
                if size >= block_bytes:
                    yield one_row([f"{task}-{made}", items, ends, terms, repeats], BLOCK_KINDS)
                    made, size = made + 1, 0
                    items, ends, terms, repeats = [], [], [], []
        if items:
            yield one_row([f"{task}-{made}", items, ends, terms, repeats], BLOCK_KINDS)

    return block


def query_blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The distinct terms of every query and their repeats, in rows of bounded size.

    Tasks are as many as blocks are expected, so that few queries in many partitions do not
    become a block each.
    """
    rows = queries.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).distinct()
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("n")).first().n or 0
    return stage(rows.coalesce(1 + total // block_bytes).mapInArrow(blocker(block_bytes), BLOCK_SCHEMA), "ranking-queries")


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def damping(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The scores' m by document length."""
    return 75 + (25 * lengths * n_docs) // max(n_terms, 1)


def impact(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


class Segment:
    """The postings of a stored segment and what they add to scores."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.doc_ids = row["doc_ids"]
        self.code = {term: code for code, term in enumerate(row["terms"].split(b" "))} if row["terms"] else {}
        self.counts = unpacked(row["counts"])
        self.firsts = np.cumsum(self.counts) - self.counts
        gaps = unpacked(row["gaps"])
        steps = np.cumsum(gaps)
        self.places = steps - np.repeat((steps - gaps)[self.firsts], self.counts)
        m = damping(np.array(row["lengths"], np.int64), n_docs, n_terms)
        self.impacts = impact(unpacked(row["times"]), m[self.places])
        self.bounds = impact(unpacked(row["most"]), damping(unpacked(row["least"]), n_docs, n_terms))


class Best:
    """The k best documents of a query so far: scores with doc_ids, missing ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """No document below this score can be among the k best."""
        return self.rows[-1][0] if len(self.rows) == self.k else 0

    def add(self, scores: list[int], doc_ids: list) -> None:
        self.rows += zip(scores, doc_ids, strict=True)
        self.rows.sort(key=lambda row: (-row[0], row[1] is None, row[1] or 0))
        del self.rows[self.k :]


def accumulate(segment: Segment, codes: np.ndarray, weights: np.ndarray, best: list[Best]) -> np.ndarray:
    """Partial scores that are whole for every document that can be among a query's k best.

    ``codes`` has the terms of one query in a row, rarest first, -1 where the segment lacks
    one; ``weights`` count repeats.  A document without an accumulator has a score of 0.
    """
    size, k = len(segment.doc_ids), best[0].k
    here = codes >= 0
    bounds = np.where(here, weights * segment.bounds[np.where(here, codes, 0)], 0)
    rest = np.cumsum(bounds[:, ::-1], axis=1)[:, ::-1]
    reached = np.cumsum(bounds, axis=1) - bounds
    least = np.array([own.least() for own in best], np.int64)
    creates = np.ones(len(codes), bool)
    scores = np.zeros((len(codes), size), np.int64)
    cells = scores.reshape(-1)
    for turn in range(codes.shape[1]):
        # Strictly below: an equal score could still win by its doc_id.
        creates &= rest[:, turn] >= least
        if size >= k:
            rows = np.flatnonzero(creates & (rest[:, turn] < reached[:, turn]))
            kth = np.partition(scores[rows], size - k, axis=1)[:, size - k]
            creates[rows[rest[rows, turn] < kth]] = False
        queries = np.flatnonzero(here[:, turn])
        terms = codes[queries, turn]
        counts = segment.counts[terms]
        owner = np.repeat(queries, counts)
        at = np.arange(len(owner)) + np.repeat(segment.firsts[terms] - (np.cumsum(counts) - counts), counts)
        cell = owner * size + segment.places[at]
        if not creates[queries].all():
            able = creates[owner] | (cells[cell] > 0)
            owner, at, cell = owner[able], at[able], cell[able]
        cells[cell] += weights[owner, turn] * segment.impacts[at]
    return scores


def keep_best(segment: Segment, scores: np.ndarray, best: list[Best]) -> None:
    for row, own in zip(scores, best, strict=True):
        able = np.flatnonzero(row >= max(own.least(), 1))
        if len(able) > own.k:
            able = able[row[able] >= np.partition(row[able], -own.k)[-own.k]]
        if len(able):
            own.add(row[able].tolist(), [segment.doc_ids[place] for place in able.tolist()])


def rank_segment(segment: Segment, local: np.ndarray, queries: list[tuple], best: list[Best]) -> None:
    """All queries, which come by their number of terms, in runs of bounded size."""
    first, size = 0, len(segment.doc_ids)
    while first < len(queries):
        last = first + 1
        while last < len(queries) and (last + 1 - first) * max(size, len(queries[last][0])) <= CELLS:
            last += 1
        run, width = queries[first:last], len(queries[last - 1][0])
        codes, weights = np.full((len(run), width), -1, np.int64), np.zeros((len(run), width), np.int64)
        for row, (terms, own) in enumerate(run):
            codes[row, : len(terms)], weights[row, : len(terms)] = local[terms], own
        keep_best(segment, accumulate(segment, codes, weights, best[first:last]), best[first:last])
        first = last


def holding(block) -> Callable:
    """Documents by term of the block, for each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = block.value["codes"], np.zeros(len(block.value["codes"]), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = np.array([wanted.get(term, -1) for term in terms.split(b" ")] if terms else [], np.int64)
                here = codes >= 0
                total[codes[here]] += unpacked(counts)[here]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["term", "n"])

    return count


def ranker(block, n_docs: int, n_terms: int, k: int) -> Callable:
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(np.array([t for t, _ in terms], np.int64), [w for _, w in terms]) for _, terms in block.value["queries"]]
        best = [Best(k) for _ in queries]
        for batch in batches:
            for at in range(batch.num_rows):
                segment = Segment({name: batch.column(name)[at].as_py() for name in batch.schema.names}, n_docs, n_terms)
                if len(segment.counts):
                    local = np.array([segment.code.get(term, -1) for term in block.value["codes"]], np.int64)
                    rank_segment(segment, local, queries, best)
        rows = [(number, doc_id, score) for (number, _), own in zip(block.value["queries"], best, strict=True) for score, doc_id in own.rows]
        query, doc_ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    return rank


def search_block(index: DataFrame, row, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(query, doc_id, score)``: the k best documents of each query of a block by task."""
    spark = index.sparkSession
    codes = Codes()
    owned = [codes[bytes(term)] for term in row.terms]
    wanted = spark.sparkContext.broadcast({"codes": dict(codes)})
    counts = index.select("terms", "counts").mapInArrow(holding(wanted), "term int, n bigint")
    df = {r.term: r.n for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the block's terms
    wanted.unpersist()
    queries, start = [], 0
    for number, end in enumerate(row.ends):
        own = sorted(((df.get(t, 0), t, n) for t, n in zip(owned[start:end], row.repeats[start:end], strict=True)))
        weighed = [(t, n * weight(n_docs, have)) for have, t, n in own if have]
        queries.append((number, [(t, w) for t, w in weighed if w]))  # a weight of 0 adds nothing
        start = end
    queries = sorted((q for q in queries if q[1]), key=lambda q: len(q[1]))
    block = spark.sparkContext.broadcast({"codes": dict(codes), "queries": queries})
    found = stage(index.drop("segment").mapInArrow(ranker(block, n_docs, n_terms, k), FOUND_SCHEMA), "ranked")
    block.unpersist()
    return found


def search(index: DataFrame, queries: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of every query: item_id, rank, doc_id, score.

    ``queries`` has item_id and text; repeated rows count once, and rows that share an
    item_id but not a text are queries of their own, each with ranks from 1.  A query
    without terms, or whose terms no document has, has no rows; nor has any over an empty
    table of documents.  Equal scores come by ascending doc_id, a missing one last.
    """
    spark = index.sparkSession
    size = F.size("doc_ids")
    filled = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(x > 0, 1).otherwise(0).cast("bigint"))
    words = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    total = index.filter(size > 0).agg(F.sum(filled).alias("docs"), F.sum(words).alias("terms")).first()
    n_docs, n_terms = total.docs or 0, total.terms or 0
    blocks = query_blocks(queries, block_bytes)
    ranked = None
    for row in blocks.toLocalIterator():  # a block is one row of bounded size
        found = search_block(index, row, n_docs, n_terms, k)
        best = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        first = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(row.items)), "query int, item_id string")
        here = first.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # a block's items
        ranked = here if ranked is None else ranked.unionByName(here)
    if ranked is None:
        ranked = spark.createDataFrame([], "item_id string, rank int, doc_id bigint, score bigint")
    return ranked.withColumn("item_id", F.col("item_id").cast(queries.schema["item_id"].dataType))


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``search`` in a new index of ``docs`` (doc_id, text; other columns are not read)."""
    return search(build_index(docs), queries, k)
