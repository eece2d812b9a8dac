"""Near-duplicate documents by Order MinHash and banded alignment (operator 9).

A sketch takes the k-mers (five words, labelled with their occurrence) with the smallest
hash values and keeps them in the order of the text, so that it agrees for texts that are
close in edit distance, not only in their sets of words.  Texts that agree in a sketch are
paired with the first text of that bucket; pairs are verified by an alignment in a band
around the diagonal, and verified links are joined to classes.  In buckets that still hold
several classes, further texts are paired with the members of other classes.  What is still
mixed after that is searched exactly: a pair of texts that reaches the similarity shares one
of its rarest k-mers, so texts of different classes are paired by those.

Before texts are fetched, a pair is compared by the parities of its k-mers in a few hundred
cells: each cell that differs stands for a k-mer that only one of the two texts has, so that
pairs with too many of them are no links and leave no row.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayplan.llm.common import content_key, free_name
from dayplan.llm.components import components
from dayplan.sources.staging import stage

SHINGLE = 5
SIMILARITY = 0.8
#: Sketches of a text, and k-mers in each.
SKETCHES = 12
PICKS = 2
#: Texts of a bucket with several classes that are compared with the rest of it before the
#: exact search; they decide how much is left to it, not what is found.
HUBS = 2
#: 64-bit numbers of a text's parities; they decide how many pairs are verified, not what is found.
PARITY_WORDS = 8
KNOWN_WORDS = 500_000
SKETCH_CELLS = 2_000_000
_ONE, _TWO = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order."""
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    found = text.lower().split()
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A hash of every five consecutive words; of all words if there are fewer."""
    n = max(1, len(hashes) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(hashes))):
        out = mixed(out + hashes[k : k + n] + np.uint64(k + 1))
    return out


def occurrences(kmers: np.ndarray) -> np.ndarray:
    """How often each k-mer came before in the text."""
    in_order = np.sort(kmers)
    if not (in_order[1:] == in_order[:-1]).any():
        return np.zeros(len(kmers), np.uint64)
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    firsts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    counts = np.diff(np.append(firsts, len(ranked)))
    out = np.empty(len(kmers), np.uint64)
    out[order] = np.arange(len(kmers)) - np.repeat(firsts, counts)
    return out


def labelled_shingles(hashes: np.ndarray) -> np.ndarray:
    """The shingles of a text, told apart by how often they came before."""
    kmers = shingles(hashes)
    return mixed(kmers + occurrences(kmers) * _TWO)


def parities(labelled: np.ndarray) -> np.ndarray:
    """Whether an odd number of the labelled k-mers falls into each cell, as bits of a few numbers.

    Cells in which two texts differ are at most as many as the k-mers that one of them has alone.
    """
    cells = np.bincount((labelled % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def sketch(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One number per seed: the smallest ``PICKS`` labelled k-mers in the order of the text."""
    return sketch_labelled(labelled_shingles(hashes), seeds)


def sketch_labelled(labelled: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    at_once = max(1, SKETCH_CELLS // len(labelled))
    if at_once < len(seeds):  # a long text takes its seeds a few at a time
        parts = [seeds[i : i + at_once] for i in range(0, len(seeds), at_once)]
        return np.concatenate([sketch_of(labelled, part) for part in parts])
    return sketch_of(labelled, seeds)


def sketch_of(labelled: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    values = mixed(labelled[None, :] ^ seeds[:, None])
    rows = np.arange(len(seeds))
    picked = []
    for _ in range(min(PICKS, len(labelled))):
        at = values.argmin(axis=1)
        picked.append(at)
        values[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = seeds.copy()
    for at in np.sort(np.stack(picked), axis=0):
        out = mixed(out + labelled[at])
    return out


def equal_lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(rows[0])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))


def sketcher(n_sketches: int):
    seeds = mixed(np.arange(1, n_sketches + 1, dtype=np.uint64) * _ONE)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keys, found, odd, sizes, seen = [], [], [], [], set()
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                hashes = word_hashes(text.as_py(), known)
                if len(hashes):
                    keys.append(key.as_py())
                    sizes.append(len(hashes))
                    labelled = labelled_shingles(hashes)
                    found.append(sketch_labelled(labelled, seeds).view(np.int64))
                    odd.append(parities(labelled))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), equal_lists(found), equal_lists(odd)],
                    ["text_key", "n", "sketches", "parities"],
                )

    return sketches


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """For each word of ``a`` the matched word of ``b`` or -1, on a shortest path of insertions
    and deletions; nothing between the common ends is matched if it leaves the band.

    After the common ends, diagonals are followed to their furthest reaching points with
    0, 1, ... differences, up to ``band`` diagonals to either side.
    """
    out = np.full(len(a), -1, np.int64)
    least = min(len(a), len(b))
    differs = np.flatnonzero(a[:least] != b[:least])
    head = int(differs[0]) if len(differs) else least
    rest = least - head
    differs = np.flatnonzero(a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1])
    tail = int(differs[0]) if len(differs) else rest
    out[:head] = np.arange(head)
    out[len(a) - tail :] = np.arange(len(b) - tail, len(b))
    x, y = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    n, m = len(x), len(y)
    if not n or not m:
        return out
    reach, trail, met = [0] * (2 * band + 3), [], False
    middle = band + 1
    for d in range(min(band, n + m) + 1):
        trail.append(array("i", reach[middle - d - 1 : middle + d + 2]))
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach[middle + k - 1] < reach[middle + k + 1])
            i = reach[middle + k + 1] if down else reach[middle + k - 1] + 1
            if d == 0:
                i = 0
            while i < n and 0 <= i - k < m and x[i] == y[i - k]:
                i += 1
            reach[middle + k] = i
            if i >= n and i - k >= m:
                met = True
                break
        if met:
            break
    if not met:
        return out
    i, j = n, m
    for d in range(len(trail) - 1, 0, -1):
        before, k = trail[d], i - j
        at = k + d + 1
        down = k == -d or (k != d and before[at - 1] < before[at + 1])
        i_from = before[at + 1] if down else before[at - 1]
        j_from = i_from - (k + 1 if down else k - 1)
        i_next = i_from if down else i_from + 1
        while i > i_next:
            i, j = i - 1, j - 1
            out[head + i] = head + j
        i, j = i_from, j_from
    while i > 0 and j > 0:
        i, j = i - 1, j - 1
        out[head + i] = head + j
    return out


def shared_at_most(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles that two texts have in common, whatever their order."""
    left, n_left = np.unique(a, return_counts=True)
    right, n_right = np.unique(b, return_counts=True)
    _, at, to = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    return int(np.minimum(n_left[at], n_right[to]).sum())


def alignment_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shingles that the alignment matches whole, divided by all shingles of the two texts.

    A pair whose shingles cannot reach ``least`` in any order is not aligned.  The other pairs
    leave out at most ``spoiled`` shingles, and an inserted or deleted word leaves out one at
    least but at the ends: that is the width of the band.
    """
    na, nb = max(1, len(a) - SHINGLE + 1), max(1, len(b) - SHINGLE + 1)
    if min(na, nb) < least * max(na, nb):
        return 0.0
    if len(a) < SHINGLE or len(b) < SHINGLE:
        return float(len(a) == len(b) and bool((a == b).all()))
    most = shared_at_most(shingles(a), shingles(b))
    if most < least * (na + nb - most):
        return 0.0
    spoiled = (1 - least) / (1 + least) * (na + nb)
    to = aligned(a, b, int(spoiled) + 2 * SHINGLE)
    joined = (to[1:] == to[:-1] + 1) & (to[:-1] >= 0)
    run = np.convolve(joined.astype(np.int64), np.ones(SHINGLE - 1, np.int64), "valid")
    shared = int((run == SHINGLE - 1).sum())
    return shared / (na + nb - shared)


def verifier(least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last_key, last = WordHashes(), None, np.zeros(0, np.uint64)
        for batch in batches:
            scores = []
            for key, first, second in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if last_key != key.as_py():
                    last_key, last = key.as_py(), word_hashes(first.as_py(), known)
                scores.append(alignment_similarity(last, word_hashes(second.as_py(), known), least))
            scores = np.array(scores, float)
            kept = pa.array(scores >= least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(scores[scores >= least])],
                ["a", "b", "similarity"],
            )

    return verify


def shingle_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        for key, root, text in zip(*batch.columns, strict=True):
            grams = labelled_shingles(word_hashes(text.as_py(), known)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), pa.array(grams))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key.as_py()], pa.binary()), pa.array([root.as_py()], pa.binary()), lists], ["text_key", "root", "grams"]
            )


def bucket_members(sketched: DataFrame) -> DataFrame:
    """``(bucket, text_key, n)``: a bucket for each sketch, and one for each two in a row."""
    near = F.transform(
        F.sequence(F.lit(0), F.size("sketches") - 1),
        lambda i: F.struct(
            F.xxhash64(i, F.get("sketches", i)).alias("one"),
            F.xxhash64(i, F.get("sketches", i), F.get("sketches", (i + 1) % F.size("sketches"))).alias("two"),
        ),
    )
    keys = F.flatten(F.transform(near, lambda x: F.array(x.one, x.two)))
    return sketched.select(F.explode(keys).alias("bucket"), "text_key", "n")


def shared_enough(parities: str, other: str, shingles_of_both: Column, least: float) -> Column:
    """False only for two texts whose parities rule out ``least``: the shingles that one of
    them has alone are too many, in whatever order."""
    differing = [F.bit_count(F.get(parities, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))) for i in range(PARITY_WORDS)]
    return sum(differing[1:], differing[0]) <= (1 - least) / (1 + least) * shingles_of_both + 1e-6


def as_pairs(met: DataFrame, least: float) -> DataFrame:
    """Different ``(a, b)`` of ``(text_key, n, parities, hub, n_hub, parities_hub)`` whose lengths
    and parities allow ``least``."""
    shingle_count = lambda n: F.greatest(F.col(n) - (SHINGLE - 1), F.lit(1))
    small, large = F.least(shingle_count("n"), shingle_count("n_hub")), F.greatest(shingle_count("n"), shingle_count("n_hub"))
    alike = shared_enough("parities", "parities_hub", small + large, least)
    close = met.filter((F.col("hub") != F.col("text_key")) & (small >= least * large) & alike)
    return close.select(F.least("hub", "text_key").alias("a"), F.greatest("hub", "text_key").alias("b")).distinct()


def first_pairs(shared: DataFrame, least: float) -> DataFrame:
    """Every text with the smallest text of each of its buckets, which is found with map-side
    combine: as many pairs as a bucket has texts, spread over tasks in the join."""
    firsts = shared.groupBy("bucket").agg(F.min(F.struct("text_key", "n", "parities")).alias("f"))
    firsts = firsts.select("bucket", F.col("f.text_key").alias("hub"), F.col("f.n").alias("n_hub"), F.col("f.parities").alias("parities_hub"))
    return as_pairs(shared.join(stage(firsts, "bucket-firsts"), "bucket"), least)


def with_roots(shared: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias("text_key"), "root")
    placed = shared.join(named, "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    return stage(placed, "bucket-classes")


def further_pairs(shared: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs across classes that share a bucket: two texts can be alike where neither is like
    the bucket's first.  Each bucket that still holds several classes has ``HUBS`` more texts,
    others in every bucket, that are compared with its members of other classes."""
    placed = with_roots(shared, roots)
    order = lambda k: F.struct(F.xxhash64("text_key", "bucket", F.lit(k)).alias("order"), "text_key", "n", "root", "parities")
    hubs = F.array(*[F.min(order(k)) for k in range(HUBS)])
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), hubs.alias("hubs")).filter("low != high")
    split = stage(split.select("bucket", F.explode(F.array_distinct("hubs")).alias("h")).select("bucket", F.col("h.text_key").alias("hub"), F.col("h.n").alias("n_hub"), F.col("h.root").alias("hub_root"), F.col("h.parities").alias("parities_hub")), "bucket-hubs")
    return as_pairs(placed.join(split, "bucket").filter(F.col("root") != F.col("hub_root")), least)


def rare_shingles(grams: DataFrame, least: float) -> DataFrame:
    """``(text_key, root, n, gram, at)``: of ``(text_key, root, grams)`` the rarest shingles of
    each text that recur in another one.

    ``at`` is the place of a shingle among all ``n`` of its text, rarest first.  Two texts that
    share the part ``least`` of their shingles share one of the first ``n - least * n + 1``;
    shingles that no other text has take places, but need no row.
    """
    each = grams.select("text_key", F.explode("grams").alias("gram"))
    often = stage(each.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1"), "recurring-shingles")
    ranked = each.join(often.hint("merge"), "gram").groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("found"))
    sized = grams.select("text_key", "root", F.size("grams").alias("n"))
    first = (F.col("n") - F.ceil(least * F.col("n") - 1e-6) + 1).cast("int")
    alone = F.col("n") - F.size("found")
    some = F.slice("found", 1, F.greatest(first - alone, F.lit(0)))
    placed = ranked.join(sized.hint("merge"), "text_key").select("text_key", "root", "n", alone.alias("alone"), F.posexplode(some).alias("i", "g"))
    return stage(placed.select("text_key", "root", "n", F.col("g.gram").alias("gram"), (F.col("alone") + F.col("i")).alias("at")), "rare-shingles")


def remaining_pairs(shared: DataFrame, roots: DataFrame, texts: DataFrame, odd: DataFrame, least: float) -> DataFrame:
    """All ``(a, b)`` in different classes that can reach ``least``, among the texts of buckets
    that still hold several classes.

    Texts are paired at a shared rare shingle if their lengths, its places in them and their
    parities ``odd`` leave room for enough common ones; members of one class make no pair.
    """
    placed = with_roots(shared, roots)
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    left = placed.join(stage(split.select("bucket"), "mixed-buckets").hint("merge"), "bucket", "left_semi").select("text_key", "root").distinct()
    left = stage(left, "mixed-texts")
    held = texts.join(left.hint("merge"), "text_key").select("text_key", "root", "text")
    grams = stage(held.mapInArrow(shingle_lists, "text_key binary, root binary, grams array<bigint>"), "mixed-shingles")
    rare = rare_shingles(grams, least)
    several = rare.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    rare = rare.join(several.select("gram").hint("merge"), "gram", "left_semi")
    # Only the shingles that classes share get the parities, which are longer than their rows.
    rare = stage(rare.join(odd.hint("merge"), "text_key"), "shared-rare-shingles")
    other = rare.select("gram", *[F.col(c).alias(f"{c}_2") for c in ("text_key", "root", "n", "at", "parities")])
    room = F.least(F.col("n") - F.col("at"), F.col("n_2") - F.col("at_2"))
    fits = (room >= least / (1 + least) * (F.col("n") + F.col("n_2")) - 1e-6) & (F.least("n", "n_2") >= least * F.greatest("n", "n_2"))
    fits &= shared_enough("parities", "parities_2", F.col("n") + F.col("n_2"), least)
    close = rare.join(other.hint("merge"), "gram").filter((F.col("root") < F.col("root_2")) & fits)
    return close.select(F.least("text_key", "text_key_2").alias("a"), F.greatest("text_key", "text_key_2").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    with_b = pairs.join(texts.select(F.col("text_key").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("text_key").alias("a"), F.col("text").alias("text_a")), "a")
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(verifier(least), "a binary, b binary, similarity double")
    return stage(found, "near-links")


def near_links(texts: DataFrame, n_sketches: int = SKETCHES, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links ``(a, b, similarity)`` between different texts ``(text_key, text)``,
    which may be given more than once, and the classes ``(node, root)`` that they make."""
    schema = "text_key binary, n int, sketches array<bigint>, parities array<bigint>"
    made = texts.select("text_key", "text").mapInArrow(sketcher(n_sketches), schema)
    made = stage(made.dropDuplicates(["text_key"]), "sketches")
    member, odd = bucket_members(made), made.select("text_key", "parities")
    several = member.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    # The parities are joined to the rows that are left, not dealt with every bucket.
    shared = stage(member.join(several, "bucket").join(odd.hint("merge"), "text_key"), "shared-buckets")
    ends = stage(shared.select("text_key").distinct(), "bucket-texts")
    # The list of texts in buckets grows with the corpus: joined by shuffle at every size.
    wanted = texts.join(ends.hint("merge"), "text_key", "left_semi").groupBy("text_key").agg(F.min("text").alias("text"))
    wanted = stage(wanted, "candidate-texts")
    first = stage(first_pairs(shared, least), "first-pairs")
    links = verified(first, wanted, least)
    more = further_pairs(shared, components(links.select("a", "b")), least)
    more = stage(more.join(first, ["a", "b"], "left_anti"), "further-pairs")
    links = stage(links.unionByName(verified(more, wanted, least)), "bucket-links")
    rest = remaining_pairs(shared, components(links.select("a", "b")), wanted, odd, least)
    rest = stage(rest.join(first.unionByName(more), ["a", "b"], "left_anti"), "remaining-pairs")
    links = links.unionByName(verified(rest, wanted, least))
    return links, components(links.select("a", "b"))


def classes(docs: DataFrame, n_sketches: int = SKETCHES, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, class_rep and n_links.

    ``class_id`` is the smallest doc_id of the texts that are linked with each other, directly
    or over others.  Equal texts are one text with several documents.  A missing text is no
    copy of anything; an empty one or one of white space only is a copy of its equals alone.
    ``n_links`` counts verified links of the text to other texts of its class.
    """
    rows = stage(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), content_key("text").alias("text_key"), F.col("text").isNull().alias("missing")),
        "document-keys",
    )
    texts = docs.filter(F.col("text").isNotNull()).select(content_key("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    links, roots = near_links(texts, n_sketches, least)
    degree = (
        links.select(F.col("a").alias("text_key")).unionAll(links.select("b")).groupBy("text_key").agg(F.count("*").alias("n_links"))
    )
    placed = (
        rows.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left")
        .join(degree, "text_key", "left")
        .select("doc_id", "text_key", "missing", F.coalesce("root", "text_key").alias("root"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    )
    placed = stage(placed, "placed-documents")
    # The smallest doc_id of a class, and its text; a missing doc_id comes after all others.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))
    heads = placed.filter(~F.col("missing")).groupBy("root").agg(F.min(order).alias("head"), F.count("*").alias("n"))
    many = heads.filter("n > 1").select("root", F.col("head.doc_id").alias("head_id"), F.col("head.text_key").alias("head_key"), F.lit(True).alias("found"))
    out = placed.join(stage(many, "class-heads"), "root", "left")
    return out.select(
        "doc_id",
        "text_key",
        F.when(F.col("found"), F.col("head_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("found"), F.col("head_key")).otherwise(F.col("text_key")).alias("class_rep"),
        "n_links",
        "missing",
    )


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document of every class only, all columns, whole rows.

    Documents are first by doc_id.  Of repeated rows with that doc_id and text one stays;
    a missing text always stays.
    """
    key, id_name = free_name(docs, "other_text_key"), free_name(docs, "other_doc_id")
    found = stage(classes(docs).filter(~F.col("missing")), "classes")
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_rep"))
    named = [F.col("doc_id").alias(id_name), F.col("text_key").alias(key)]
    others = stage(found.filter(~first).select(*named).distinct(), "other-documents")
    firsts = found.filter(first).groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    repeated = stage(firsts.filter("n > 1").select(*named), "repeated-firsts")
    own = f"{key}_own"
    keyed = docs.withColumn(own, content_key("text"))

    def same(rows: DataFrame):
        return keyed["doc_id"].eqNullSafe(rows[id_name]) & (keyed[own] == rows[key])

    # A missing text has a key of its own that is in neither list.
    # Other documents grow with the corpus: joined by shuffle at every size.
    single = keyed.join(others.hint("merge"), same(others), "left_anti").join(repeated, same(repeated), "left_anti")
    several = keyed.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", own])
    return single.unionByName(several).select(*docs.columns)
