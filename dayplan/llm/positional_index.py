"""Benchmark passages in training documents by a positional inverted index (operator 10).

The index is split by documents.  A segment holds about a million words of whole documents:
its terms, and for each term the ascending positions at which it stands.  Segments are
written once and can be searched again for other benchmarks.

A search cuts the benchmark into windows of ten words and takes these in blocks of bounded
size to every segment.  Inside a segment each window starts from the postings of its rarest
term, shifted by the term's offset, and is intersected with the shifted postings of its
other terms from rare to frequent.  A position is skipped between documents, so that no
match runs across two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayplan.llm.common import free_name
from dayplan.sources.staging import stage

WINDOW = 10
#: Words of a segment, after which the next document starts another one.
SEGMENT_WORDS = 1_000_000
#: Windows in a block; a block is broadcast and has this bound whatever the benchmark's size.
BLOCK_WINDOWS = 200_000
#: Shifted postings that are compared at once.
AT_ONCE = 2_000_000

INDEX_SCHEMA = (
    "segment string, doc_ids array<bigint>, text_hashes array<bigint>, n_words array<bigint>,"
    " terms binary, counts binary, gaps binary"
)
MATCH_SCHEMA = (
    "segment string, place int, items array<string>, near_items array<string>,"
    " runs array<struct<lo:bigint,hi:bigint>>"
)

#: A-Z in lower case, everything else in ASCII but digits and letters blank.
_TO_WORDS = bytes(
    code + 32 if 65 <= code <= 90 else code if code >= 128 or 48 <= code <= 57 or 97 <= code <= 122 else 32
    for code in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split(b" ") if text else []


def terms_of(text: str | None) -> list[bytes]:
    return [word for word in split_words(text) if word]


class Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def segment_row(name: str, docs: list[list], codes: list[np.ndarray], known: Codes) -> list:
    """A segment as stored; gaps are distances between postings, by byte planes so that they pack well."""
    doc_ids, hashes, sizes = docs
    stream = np.concatenate(codes)
    positions = np.arange(len(stream)) + np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(stream, kind="stable")
    counts = np.bincount(stream, minlength=len(known)).astype("<u4")
    postings = positions[order]
    gaps = np.diff(postings, prepend=0)
    firsts = np.cumsum(counts) - counts
    gaps[firsts] = postings[firsts]
    planes = gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return [name, doc_ids, hashes, sizes, b" ".join(known), counts.tobytes(), np.ascontiguousarray(planes).tobytes()]


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs, blob = pa.list_(pa.int64()), pa.binary()
    kinds = pa.schema(
        [("segment", pa.string()), ("doc_ids", longs), ("text_hashes", longs), ("n_words", longs), ("terms", blob), ("counts", blob), ("gaps", blob)]
    )
    task, made, waiting = TaskContext.get().partitionId(), 0, 0
    docs, codes, known = [[], [], []], [], Codes()

    def row() -> pa.RecordBatch:
        values = segment_row(f"{task}-{made}", docs, codes, known)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kinds, strict=True)], schema=kinds)

    for batch in batches:
        for doc_id, text_hash, text in zip(*(batch.column(c) for c in range(3)), strict=True):
            found = terms_of(text.as_py())
            docs[0].append(doc_id.as_py())
            docs[1].append(text_hash.as_py())
            docs[2].append(len(found))
            codes.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
            waiting += len(found) + 1
            if waiting >= SEGMENT_WORDS:
                yield row()
                made, waiting = made + 1, 0
                docs, codes, known = [[], [], []], [], Codes()
    if docs[0]:
        yield row()


def build_index(docs: DataFrame) -> DataFrame:
    """The segments of all documents, written to the shared folder and read back.

    Rows are indexed one by one: a repeated row, or a doc_id that is missing or repeated,
    is a document of its own.  A missing text has no words.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return stage(rows.mapInArrow(segments, INDEX_SCHEMA), "positional-index")


def window_blocks(benchmark: DataFrame, size: int = BLOCK_WINDOWS) -> Iterator[dict]:
    """The windows of the benchmark, block by block; an item may go on in the next block."""
    known, windows, owners, items = Codes(), {}, [], []

    def block() -> dict:
        shape = np.full((len(windows), WINDOW), -1, np.int32)
        for number, window in enumerate(windows):
            shape[number, : len(window)] = window
        pairs = np.array(sorted(set(owners)), np.int64).reshape(-1, 2)
        return {"terms": list(known), "windows": shape, "owners": pairs, "items": list(items)}

    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        found = terms_of(row.t)
        items.append(row.i or "")
        for start in range(max(1, len(found) - WINDOW + 1) if found else 0):
            window = tuple(known[word] for word in found[start : start + WINDOW])
            owners.append((windows.setdefault(window, len(windows)), len(items) - 1))
            if len(owners) >= size:
                yield block()
                known, windows, owners, items = Codes(), {}, [], [row.i or ""]
    if owners:
        yield block()


class Segment:
    """The postings of a stored segment: ``keys`` are (term, position) in ascending order."""

    def __init__(self, sizes: np.ndarray, terms: bytes, counts: bytes, gaps: bytes):
        self.sizes = sizes
        self.ends = np.cumsum(sizes + 1)
        self.span = int(self.ends[-1]) + 1
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        planes = np.frombuffer(gaps, np.uint8).reshape(4, -1)
        steps = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        self.terms = terms.split(b" ") if terms else []
        total = np.cumsum(steps)
        before = np.repeat((total - steps)[self.firsts[self.counts > 0]], self.counts[self.counts > 0])
        self.positions = total - before
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.span + self.positions

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions of many terms after each other, and which of them each belongs to."""
        counts = self.counts[terms]
        owner = np.repeat(np.arange(len(terms)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.positions[self.firsts[terms][owner] + within], owner

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        wanted = terms * self.span + positions
        at = np.searchsorted(self.keys, wanted)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == wanted

    def next_after(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The first position of each term after the given one, or the span if there is none."""
        at = np.searchsorted(self.keys, terms * self.span + positions, side="right")
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (found // self.span == terms), found % self.span, self.span)


def present_windows(segment: Segment, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows all of whose terms the segment has, and their terms here."""
    here = {term: code for code, term in enumerate(segment.terms)}
    local = np.array([here.get(term, -1) for term in block["terms"]] + [-2], np.int64)
    windows = local[block["windows"]]  # -1 wraps to the last entry, the filler
    kept = np.flatnonzero((windows != -1).all(axis=1))
    return kept, windows[kept]


def pieces(segment: Segment, rarest: np.ndarray) -> Iterator[slice]:
    """Runs of windows whose first lists hold about ``AT_ONCE`` postings together."""
    total, first = np.cumsum(segment.counts[rarest]), 0
    while first < len(rarest):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + AT_ONCE, side="right")))
        yield slice(first, last)
        first = last


def phrases(segment: Segment, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Window numbers and starts of all exact matches."""
    counts = np.where(windows < 0, np.iinfo(np.int64).max, segment.counts[windows])
    order = np.argsort(counts, axis=1, kind="stable")
    rows = np.arange(len(windows))
    for piece in pieces(segment, windows[rows, order[:, 0]]):
        part, turns = windows[piece], order[piece]
        positions, owner = segment.postings(part[np.arange(len(part)), turns[:, 0]])
        starts = positions - turns[owner, 0]
        inside = starts >= 0
        starts, owner = starts[inside], owner[inside]
        for turn in range(1, WINDOW):
            offset = turns[owner, turn]
            terms = part[owner, offset]
            hold = terms < 0
            hold[~hold] = segment.holds(terms[~hold], starts[~hold] + offset[~hold])
            starts, owner = starts[hold], owner[hold]
        yield piece.start + owner, starts


def near_phrases(segment: Segment, windows: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows whose words stand in order with at most ``slop`` other words between them, and starts."""
    lengths = (windows >= 0).sum(axis=1)
    counts = np.where(windows < 0, np.iinfo(np.int64).max, segment.counts[windows])
    rare = counts.argmin(axis=1)
    for piece in pieces(segment, windows[np.arange(len(windows)), rare]):
        part, offset = windows[piece], rare[piece]
        positions, owner = segment.postings(part[np.arange(len(part)), offset])
        # The first word stands before the rarest one, by its offset and up to slop more.
        low = positions - offset[owner] - slop
        starts = segment.next_after(part[owner, 0], low - 1)
        found_starts, found_owner = [], []
        for _ in range(slop + 1):
            fits = starts <= positions - offset[owner]
            starts, owner, positions = starts[fits], owner[fits], positions[fits]
            found_starts.append(starts)
            found_owner.append(owner)
            starts = segment.next_after(part[owner, 0], starts)
        starts, owner = np.concatenate(found_starts), np.concatenate(found_owner)
        last = starts
        for turn in range(1, WINDOW):
            terms = part[owner, turn]
            last = np.where(terms < 0, last, segment.next_after(np.maximum(terms, 0), last))
            fits = last - starts < lengths[piece][owner] + slop
            starts, owner, last = starts[fits], owner[fits], last[fits]
        whole = np.searchsorted(segment.ends, starts, side="right") == np.searchsorted(segment.ends, last, side="right")
        yield piece.start + owner[whole], starts[whole]


def matches_in(segment: Segment, block: dict, slop: int) -> list[tuple]:
    """For each document with a match: its place, items, items found with gaps, covered runs."""
    kept, windows = present_windows(segment, block)
    if not len(kept) or not len(segment.keys):
        return []
    lengths = (windows >= 0).sum(axis=1)
    cover = np.zeros(segment.span + WINDOW + 1, np.int64)
    exact, near = [], []
    for owner, starts in phrases(segment, windows):
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + lengths[owner], -1)
        exact.append(np.stack([np.searchsorted(segment.ends, starts, side="right"), kept[owner]]))
    if slop:
        for owner, starts in near_phrases(segment, windows, slop):
            near.append(np.stack([np.searchsorted(segment.ends, starts, side="right"), kept[owner]]))

    firsts = np.searchsorted(block["owners"][:, 0], np.arange(len(block["windows"]) + 1))

    def by_place(found: list[np.ndarray]) -> dict[int, set[str]]:
        out: dict[int, set[str]] = {}
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        for place, window in pairs.T.tolist():
            owned = block["owners"][firsts[window] : firsts[window + 1], 1]
            out.setdefault(place, set()).update(block["items"][item] for item in owned.tolist())
        return out

    items, near_items = by_place(exact), by_place(near)
    edges = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0, append=0)
    lows, highs = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    starts = segment.ends - segment.sizes - 1
    runs: dict[int, list] = {}
    places = np.searchsorted(segment.ends, lows, side="right")
    for place, low, high in zip(places.tolist(), (lows - starts[places]).tolist(), (highs - starts[places]).tolist(), strict=True):
        runs.setdefault(place, []).append({"lo": low, "hi": high})
    return [
        (place, sorted(items.get(place, ())), sorted(near_items.get(place, set()) - items.get(place, set())), runs.get(place, []))
        for place in sorted(items.keys() | near_items.keys())
    ]


def searcher(block, slop: int):
    names = ["segment", "place", "items", "near_items", "runs"]
    texts = pa.list_(pa.string())
    spans = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, sizes, terms, counts, gaps = (batch.column(c)[k].as_py() for c in range(5))
                segment = Segment(np.array(sizes, np.int64), terms, counts, gaps)
                found = matches_in(segment, block.value, slop)
                if found:
                    place, items, near, runs = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(found)), pa.array(place, pa.int32()), pa.array(items, texts), pa.array(near, texts), pa.array(runs, spans)],
                        names,
                    )

    return search


def search(index: DataFrame, benchmark: DataFrame, slop: int = 0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Matches by document: ``(segment, place, items, near_items, runs)``.

    ``runs`` are the stretches of words that some exact match covers.  ``near_items`` have
    a window whose words stand in order with up to ``slop`` others between, and no exact
    match.  Each block of windows is one pass over the stored segments.
    """
    spark = index.sparkSession
    # A segment is a large row: few of them at a time go to Python.
    found = []
    for block in window_blocks(benchmark, block_windows):
        shared = spark.sparkContext.broadcast(block)
        columns = index.select("segment", "n_words", "terms", "counts", "gaps")
        found.append(stage(columns.mapInArrow(searcher(shared, slop), MATCH_SCHEMA), "index-matches"))
        shared.unpersist()
    if not found:
        return spark.createDataFrame([], MATCH_SCHEMA)
    if len(found) == 1:
        return found[0]
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    merged = together.groupBy("segment", "place").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
    )
    return merged.withColumn("near_items", F.array_except("near_items", "items"))


def covered(runs: str) -> Column:
    """Words in the union of runs that are sorted by their starts."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    longer = lambda acc, run: F.struct(
        (acc.n + F.greatest(run.hi - F.greatest(acc.end, run.lo), F.lit(0))).cast("bigint").alias("n"),
        F.greatest(acc.end, run.hi).alias("end"),
    )
    return F.aggregate(runs, start, longer, lambda acc: acc.n)


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int = 0) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, near_items.

    An item without an item_id counts under the empty id; items that share an id count once.
    An item of fewer words than a window is one window, an item without words none.  An empty
    benchmark finds nothing; an empty table of documents gives no rows.
    """
    index = build_index(docs)
    found = search(index, benchmark, slop).select(
        "segment",
        "place",
        covered("runs").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.array_join("items", ",").alias("item_list"),
        "near_items",
    )
    # Word counts of the index, one row per document.
    places = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "text_hashes", "n_words")).alias("place", "doc"))
    rows = places.select("segment", "place", "doc.doc_ids", "doc.text_hashes", "doc.n_words").join(found, ["segment", "place"], "left")
    return rows.select(
        F.col("doc_ids").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("item_list", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"),
        F.col("text_hashes").alias("text_hash"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window; whole rows, all columns.

    Rows are found again by doc_id and a hash of the text, so that a repeated or missing
    doc_id does not take other documents along.
    """
    id_name, key = free_name(docs, "bad_doc_id"), free_name(docs, "text_hash")
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias(id_name), F.col("text_hash").alias(key)).distinct()
    keyed = docs.withColumn(f"{key}_own", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(bad[id_name]) & (keyed[f"{key}_own"] == bad[key])
    # Contaminated rows grow with the corpus: joined by shuffle at every size.
    return keyed.join(bad.hint("merge"), same, "left_anti").select(*docs.columns)
