"""Token ids in ORC files (operator 3).

Documents are put in the order of their ids by a range partitioning, encoded, and written
as one ORC row each: integer run-length encoding for the ids, row indexes, and a Bloom
filter on ``doc_id``.  Stripes are read in parallel; a search for documents skips stripes
and row groups by their statistics and filters.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import repeat
from operator import is_
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayplan.llm.common import free_name
from dayplan.sources.staging import new_path, stage

END_ID = 1
#: Parts of words whose ids a worker remembers; the table is emptied when it is full.
REMEMBERED_WORDS = 200_000
#: Bytes of text whose words are told apart at once; a longer text is taken alone or with those before it.
TEXT_BYTES = 2 << 20
FILE_SCHEMA = "doc_id bigint, file_start bigint, ids array<int>"
#: Letters that never change their neighbours when a text is normalised, and stay one letter in lower case.
_PLAIN_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower().isalpha())


def word_parts(words: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """A head and a tail of each word, which have the ids of the word between them, and whether the head is a stem.

    A word of plain letters with punctuation after it, or of one of both, is a stem, the
    letters in lower case, and a mark.  Any other word is a head, with an empty tail.
    """
    stems, marks = pc.utf8_rtrim(words, punctuation), pc.utf8_ltrim(words, _PLAIN_LETTERS)
    plain = pc.equal(pc.add(pc.binary_length(stems), pc.binary_length(marks)), pc.binary_length(words))
    return pc.if_else(plain, pc.utf8_lower(stems), words), pc.if_else(plain, marks, ""), plain


class WordIds(dict):
    """The ids of a part of a word as little-endian bytes, encoded when first asked for.

    White space separates tokens in this vocabulary, so the ids of a text are those of its
    words, and those of a word are those of its parts.  Letters of either case share theirs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # Stems need no normalising, and each is one piece: only blanks are to be cut.
        self.for_stems = Tokenizer(self.tokenizer.model)
        self.for_stems.normalizer = normalizers.Sequence([])
        bytes_only = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.for_stems.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_only])
        self.ends = None
        self[""] = b""

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def is_end(self) -> np.ndarray:
        """For each id, whether it ends a word."""
        if self.ends is None:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        return self.ends

    def learn(self, words: list[str]) -> None:
        """Add the parts of words that are not known yet, many in one call of the library."""
        heads, tails, plain = word_parts(pa.array(words, pa.string()))
        self.learn_stems(list(set(_strings(heads.filter(plain))).difference(self)))
        others = {*_strings(heads.filter(pc.invert(plain))), *_strings(tails.unique())}
        self.update({word: self.whole(word) for word in others.difference(self)})

    def learn_stems(self, stems: list[str], at_once: int = 256) -> None:
        pieces = [stems[i : i + at_once] for i in range(0, len(stems), at_once)]
        encoded = self.for_stems.encode_batch_fast([" ".join(p) for p in pieces], add_special_tokens=False)
        for piece, found in zip(pieces, encoded, strict=True):
            ids = np.asarray(found.ids, "<u4")
            cuts = np.flatnonzero(self.is_end()[ids]) + 1
            if len(cuts) == len(piece):
                data, last = ids.tobytes(), 0
                for stem, cut in zip(piece, cuts.tolist(), strict=True):
                    self[stem] = data[last * 4 : cut * 4]
                    last = cut
            else:  # a word that the library cuts in two
                self.update({stem: self.whole(stem) for stem in piece})

    def of_words(self, words: pa.Array) -> pa.ListArray:
        """The ids of each of some different words.

        Every part is looked up once; only those that are not known are looked up again.  A
        full table keeps the parts at hand alone, so that common ones are not learnt again.
        """
        heads, tails, _ = word_parts(words)
        both = pa.concat_arrays([heads, tails]).dictionary_encode()
        parts, places = _strings(both.dictionary), both.indices.to_numpy().reshape(2, -1)
        found = list(map(self.get, parts))
        if len(self) > REMEMBERED_WORDS:
            kept = {part: ids for part, ids in zip(parts, found, strict=True) if ids is not None}
            self.clear()
            self.update(kept)
            self[""] = b""
        is_new = np.fromiter(map(is_, found, repeat(None)), bool, len(found))
        self.learn(_strings(words.filter(pa.array(is_new[places].any(axis=0)))))
        for place in np.flatnonzero(is_new).tolist():
            found[place] = self[parts[place]]
        taken = _lists(found).take(pa.array(places.T.ravel()))
        return pa.ListArray.from_arrays(taken.offsets[::2], taken.values)

    def of_texts(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, whose different words are looked up once."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        taken = self.of_words(words.dictionary).take(words.indices)
        return pa.ListArray.from_arrays(taken.offsets.take(split.offsets), taken.values)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The same as little-endian bytes."""
        lists = self.of_texts(pa.array(texts, pa.string()))
        return [np.asarray(ids.values, "<u4").tobytes() for ids in lists]


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _lists(rows: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, rows), np.int32, len(rows)) // 4, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def word_ids(path: str) -> WordIds:
    """This worker's table, which lives as long as the Python process."""
    kept = sys.modules.setdefault("_dayplan_worker_state", types.ModuleType("_dayplan_worker_state"))
    tables = kept.__dict__.setdefault("word_ids", {})
    if path not in tables:
        tables[path] = WordIds(path)
    return tables[path]


def by_bytes(batch: pa.RecordBatch, column: int, n_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``n_bytes`` in one column."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    firsts = np.flatnonzero(np.diff(ends // n_bytes, prepend=-1)).tolist()
    for first, after in zip(firsts, [*firsts[1:], batch.num_rows]):
        yield batch.slice(first, after - first)


def encoder(path: str, end_id: int):
    """Texts in order become rows of ids; ``file_start`` counts the ids before in the task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = word_ids(path), 0
        for batch in batches:
            for part in by_bytes(batch, 1, TEXT_BYTES):
                lists = known.of_texts(part.column(1))
                ends = lists.offsets.to_numpy()[1:]
                ids = np.insert(lists.values.to_numpy(), ends, end_id)
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                starts = pa.array(start + offsets[:-1])
                start += len(ids)
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), starts, ids], ["doc_id", "file_start", "ids"])
                # Executors have little memory beside the Java heap; without this, freed arrays stay with the worker.
                pa.default_memory_pool().release_unused()

    return encode


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encode ``text`` of ``docs`` and write ORC files below ``path`` in ascending doc_id order.

    A missing or empty text has the end id alone.  A missing doc_id comes first; rows with
    one doc_id are ordered by a hash of their texts, so that a doc_id that holds a third of
    the rows is spread over files as well.  Other columns are not written.
    """
    tie = free_name(docs, "tie")
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias(tie))
        .repartitionByRange("doc_id", tie)
        .sortWithinPartitions("doc_id", tie)
        .select("doc_id", "text")
    )
    (
        ordered.mapInArrow(encoder(vocabulary, end_id), FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(32 << 20))
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents; stripes without them are skipped by statistics and filters."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = [zlib.crc32(data[a * 4 : b * 4]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            ["file", "doc_id", "file_start", "n_tokens", "ids_crc32"],
        )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    Files follow each other in the order of their names, which is the order of doc_id.
    Only the sums of files, one row each, are put in order in one task.  The ids are read
    once: what is told of each document is written down, and summed from there.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = read_tokens(spark, path).select(name.alias("file"), "doc_id", "file_start", "ids")
    digests = stage(
        rows.mapInArrow(_digests, "file int, doc_id bigint, file_start bigint, n_tokens bigint, ids_crc32 bigint"),
        "token-digests",
    )
    sums = digests.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return digests.join(starts, "file").select(
        "doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs`` to a new folder, and return what its files hold by document."""
    path = new_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, vocabulary, end_id)
    return token_digests(docs.sparkSession, path)
