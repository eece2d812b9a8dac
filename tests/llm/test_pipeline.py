"""The five stages of the pipeline against a brute-force version on a small fixture."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from dayplan.llm import mixing
from dayplan.llm.common import vocabulary
from tokenizers import Tokenizer

from tests.llm.test_filters import DOCS, base_counts, expected_hits, jaccard, some_words

WEIGHTS = (3, 1, 2)


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    pick = random.Random(21)
    passage = " ".join(some_words(pick, 30))
    texts = [" ".join(some_words(pick, pick.randrange(15, 120))) for _ in range(40)]
    near = texts[0].split()
    near[3] = "changed"
    texts += [texts[1], texts[1], texts[2], " ".join(texts[3].split() * 1), " ".join(near) if jaccard(" ".join(near), texts[0]) >= 0.8 else texts[0]]
    texts += [f"{texts[5]} {passage[:200]}", passage, "too short", "same words again " * 30, None, "", "tab\tand\nline " + texts[6][::-1]]
    rows = [(100 + k, text, "en", pick.choice(["a", "b", "c", None]), len(text or "")) for k, text in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{folder}/documents.parquet")
    items = [(1, passage), (2, None), (3, "never seen words of a benchmark item")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs.collect(), items


def one_of_each(rows):
    group = {row.doc_id: row.doc_id for row in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if (a.text == b.text or jaccard(a.text, b.text) >= 0.8) and group[a.doc_id] > group[b.doc_id]:
                    group[a.doc_id] = group[b.doc_id]
        if all(group[group[k]] == group[k] for k in group):
            break
    return [row for row in rows if group[row.doc_id] == row.doc_id]


def mixed(rows):
    """(doc_id, text) for each time that the mixture takes a document."""
    by_source = defaultdict(list)
    for row in rows:
        by_source[row.source].append(row)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(row.text.split()) for row in by_source[s]) for s in order}
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, target, open_ones = 1.5 * sum(size.values()), {}, list(order)
    while open_ones:
        rate = left / sum(weight[s] for s in open_ones)
        full = [s for s in open_ones if rate * weight[s] > 2 * size[s]]
        for s in full or open_ones:
            target[s] = 2 * size[s] if full else rate * weight[s]
            left -= target[s] if full else 0
        open_ones = [s for s in open_ones if s not in target]
    out = []
    for s in order:
        drawn, start = int(target[s] + 0.5), 0
        for row in sorted(by_source[s], key=lambda r: hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()):
            parts = re.findall(r"\s*\S+", row.text)
            for epoch in range(2):
                n = max(0, min(min(drawn - epoch * size[s], size[s]) - start, len(parts)))
                if n:
                    out.append((row.doc_id, row.text if n == len(parts) else "".join(parts[:n])))
            start += len(parts)
    return out


def test_pipeline_equals_brute_force(spark, inputs):
    folder, rows, items = inputs
    good = [row for row in rows if not base_counts(row.text)[-1]]
    firsts = one_of_each(good)
    hits = {hit[0] for hit in expected_hits(firsts, items) if hit[5]}
    clean = [row for row in firsts if row.doc_id not in hits]
    assert len(rows) > len(good) > len(firsts) > len(clean) > 30
    encode = Tokenizer.from_file(vocabulary()).encode
    want = []
    for doc_id, text in mixed(clean):
        ids = [*encode(text, add_special_tokens=False).ids, 1]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda row: row.start)
    assert Counter((row.doc_id, row.n_tokens, row.ids_crc32) for row in got) == Counter(want)
    assert [row.doc_id for row in got] == sorted(row.doc_id for row in got)
    assert [row.start for row in got] == [sum(row.n_tokens for row in got[:k]) for k in range(len(got))]


def test_stages_keep_columns_and_stand_empty_tables(spark, inputs):
    folder, _, _ = inputs
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, work in corpus_pipeline.STAGES[:-1]:
        assert work(spark, docs, folder).columns == docs.columns
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, docs.limit(0), folder).count() == 0
