"""Vector codes, personal data and ranked search against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from dayplan.llm import ball_kmeans, private_spans, term_ranking
from dayplan.llm.queries import ball_kmeans_sql

VECTORS = "vec_id bigint, embedding array<float>, label int"
DOCS = "doc_id bigint, text string"
ITEMS = "item_id bigint, text string"


def plain_codes(rows, entries=256, rounds=4):
    """Every part against every entry, in Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    vectors = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    size = len(vectors[0]) // 4
    codes, errors, books = [""] * len(rows), [0] * len(rows), []
    for p in range(4):
        parts = [v[p * size : (p + 1) * size] for v in vectors]
        book = [list(x) for x in parts[:entries]]

        def near(part):
            return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), k) for k, entry in enumerate(book))  # noqa: B023

        for _ in range(rounds):
            mine = [near(part)[1] for part in parts]
            for k in range(len(book)):
                own = [part for part, at in zip(parts, mine, strict=True) if at == k]
                if own:
                    book[k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
        for at, part in enumerate(parts):
            far, k = near(part)
            codes[at] += f"{k:02x}"
            errors[at] += far
        books.append(book)
    sums = Counter()
    for row, error in zip(rows, errors, strict=True):
        sums[row[2]] += error
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return Counter((r[0], code, error, sums[r[2]], sha) for r, code, error in zip(rows, codes, errors, strict=True))


def random_vectors(seed, n, size=8, ties=False):
    pick = random.Random(seed)
    number = (lambda: pick.choice([-0.5, 0.0, 0.25])) if ties else (lambda: pick.gauss(0, 0.3))
    return [(k, [float(np.float32(number())) for _ in range(size)], pick.choice([None, 1, 2])) for k in range(n)]


@pytest.mark.parametrize("ties", [False, True])
def test_codes_equal_plain_k_means(spark, ties):
    rows = random_vectors(3, 320, 4 if ties else 8, ties)
    rows += [rows[0], rows[5], (None, rows[7][1], 2)]  # repeated rows, a missing id
    odd = [(900, None, 1), (901, [float("nan")] * len(rows[0][1]), 1), (902, [float("inf")] + rows[0][1][1:], 1), (903, [None] + rows[0][1][1:], 2)]
    vectors = spark.createDataFrame(rows + odd, VECTORS).selectExpr("*", "label as code", "vec_id as error", "vec_id as part")
    got = ball_kmeans.compress(vectors.repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_codes(rows)


def test_vectors_without_a_code_and_empty_tables(spark):
    rows = random_vectors(4, 12)
    odd = [(50, [1.0] * 12, 7), (51, [], 7), (52, [20000.0] * 8, 7)]
    got = {r.vec_id: r for r in ball_kmeans.compress(spark.createDataFrame(rows + odd, VECTORS)).collect()}
    assert all(got[k].code is None and got[k].error is None and got[k].label_error is None for k in (50, 51, 52))
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.values() if r.code) == plain_codes(rows)
    assert ball_kmeans.compress(spark.createDataFrame([], VECTORS)).collect() == []
    only = ball_kmeans.compress(spark.createDataFrame([(1, [0.5] * 7, 1)], VECTORS)).collect()
    assert [tuple(r) for r in only] == [(1, None, None, None, None)]


def test_balls_leave_out_nothing_that_is_nearest():
    draw = np.random.default_rng(5)
    entries = draw.integers(-60, 60, (40, 3))
    entries[7] = entries[3]
    parts = np.concatenate([draw.integers(-70, 70, (600, 3)), entries])
    full = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    for before in (np.zeros(len(parts), np.int64), full.argmin(axis=1), draw.integers(0, 40, len(parts))):
        own = full[np.arange(len(parts)), before]
        radii = np.sqrt([own[before == k].max(initial=0) for k in range(40)]) + 1e-6
        found, far, made = ball_kmeans.nearest(parts, before, ball_kmeans.Balls.around(entries, radii))
        assert (found == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()
    # Parts that start in their own ball compare with fewer entries than there are.
    settled = full.argmin(axis=1)
    radii = np.sqrt([full[settled == k, k].max(initial=0) for k in range(40)]) + 1e-6
    assert ball_kmeans.nearest(parts, settled, ball_kmeans.Balls.around(entries, radii))[2] < full.size / 2


def test_distances_are_exact_beyond_doubles():
    parts = np.array([[ball_kmeans.LARGEST, 1], [-ball_kmeans.LARGEST, 3]], np.int64)
    entries = np.array([[-ball_kmeans.LARGEST, 0], [ball_kmeans.LARGEST, 2]], np.int64)
    assert ball_kmeans.to_all(parts, entries).tolist() == [[(2 * ball_kmeans.LARGEST) ** 2 + 1, 1], [9, (2 * ball_kmeans.LARGEST) ** 2 + 1]]


def test_code_sql_has_all_rounds():
    assert ball_kmeans_sql(2, 16).count("as materialized") == 2 + 1 + 3 + 2


# Personal data


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            if kind == 1 and any(int(part) > 255 for part in match[0].split(".")):
                continue
            if kind == 2:
                total = sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((match.start(), kind, match.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    pick = random.Random(8)
    for _ in range(20000):
        text = "".join(pick.choice("aZ0123456789.-@ +()%\n_é") for _ in range(pick.randrange(60)))
        assert private_spans.base_spans(text) == plain_spans(text)
    for _ in range(20000):
        text = "".join(pick.choice("0123456789" if pick.random() < 0.8 else ".- +") for _ in range(pick.randrange(80)))
        assert private_spans.base_spans(text) == plain_spans(text)


def test_messages_are_exact_on_trees_and_loops_keep_the_sides():
    pick = np.random.default_rng(2)
    unary = pick.normal(0, 1, (7, 5))
    ends, weights = np.array([(0, 1), (1, 2), (1, 3), (4, 5)]), np.array([2.0, 0.7, 3.0, 1.5])
    got = private_spans.beliefs(unary, ends, weights, rounds=80)
    exact = np.zeros((7, 5))
    for labels in itertools.product(range(5), repeat=7):
        score = sum(unary[k, label] for k, label in enumerate(labels)) + sum(w for (a, b), w in zip(ends, weights, strict=True) if labels[a] == labels[b])
        exact[np.arange(7), labels] += np.exp(score)
    share = np.exp(got) / np.exp(got).sum(axis=1, keepdims=True)
    assert np.allclose(share, exact / exact.sum(axis=1, keepdims=True), atol=1e-6)
    ring = private_spans.beliefs(np.array([[2.0, 0], [0, 0], [0, 0], [0, 0.5]]), np.array([(0, 1), (1, 2), (2, 3), (3, 0)]), np.full(4, 1.0))
    assert (ring.argmax(axis=1) == 0).all()


def kinds_and_texts(text, listed):
    parts = [part.split(":") for part in listed.split(",") if part]
    return [(kind, text[int(start) : int(end)]) for kind, start, end in parts]


def test_other_spellings_are_labelled_alike_and_clean_texts_stay(spark):
    phone = "Call +1 (487) 555-7209 now, or later (487) 555-7209, or 4875557209."
    mail = "jane.doe77@mail7.example.com wrote; ask jane.doe77 (at mail7) for chapter 12 and 3.14"
    # With a number behind it the phone has too many digits for the pattern; its copy has not.
    glued = "+1 (487) 555-7209 12345 x\ny +1 (487) 555-7209"
    clean = "Version 3.14 of 2024-01-05, order 555-7209 and 1234567 and 1234567, page 12, a@b"
    rows = [(1, phone), (2, mail), (3, glued), (4, clean), (5, None), (6, ""), (None, "10.0.0.1"), (6, ""), (7, "🙂 10.0.0.1 x")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "text as spans", "doc_id as n_email")
    out = private_spans.find_private(docs).collect()
    assert len(out) == len(rows)
    got = {row.doc_id: row for row in out}
    found = kinds_and_texts(phone, got[1].spans)
    assert found[0] == ("phone", "+1 (487) 555-7209") and found[2:] == [("phone", "4875557209")]
    assert found[1] in [("phone", "(487) 555-7209"), ("phone", "555-7209")]  # few texts say little of the prefix
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (0, 0, 0, 1)
    assert kinds_and_texts(mail, got[2].spans) == [("email", "jane.doe77@mail7.example.com"), ("email", "jane.doe77")]
    assert ("phone", "555-7209") in [(kind, found[-8:]) for kind, found in kinds_and_texts(glued, got[3].spans)[:1]]
    assert got[4].spans == "" and got[5].spans == "" and got[6].spans == ""
    assert got[None].spans == "ip:0:8" and got[7].spans == "ip:2:10"
    for row in out:
        text = dict(rows).get(row.doc_id) or ""
        assert row.base_sha256 == hashlib.sha256(private_spans.listed(plain_spans(text)).encode()).hexdigest()


def test_weights_count_features_and_links(spark):
    texts = ["a +1 (487) 555-7209 b 555-7209", "5 10.0.0.1 and 6"]
    got = private_spans.train(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(2))
    # Two equal chains inside the phone; the skip has a free side and says nothing.
    assert math.isclose(got.links["chain"], private_spans.CHAIN) and math.isclose(got.links["text"], math.log(30))
    plain = private_spans.trained([SimpleNamespace(what="label", place=0, label=3, n=2), SimpleNamespace(what="link", place=1, label=0, n=29)])
    assert math.isclose(plain.links["text"], 0.0) and plain.prior.argmax() == 3
    assert private_spans.find_private(spark.createDataFrame([], DOCS)).collect() == []


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "1" + "." * 300_000 + "1", "a" * 300_000 + "@", "+1" * 100_000, "@" * 300_000):
        assert private_spans.field_of(text).spans == []
    assert len(private_spans.field_of("1." * 100_000).spans) == 25_000
    own = private_spans.field_of("x 5557209 " * 5000 + "+1 (487) 555-7209")
    assert len(own.skips) == 5000 and private_spans.decoded([own], [""], private_spans.trained([])) is not None


# Ranked search


def plain_terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_ranking(docs, items, k=20):
    found = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(term for _, c in found for term in c)
    out = Counter()
    for item_id, text in dict.fromkeys(items):
        scores = []
        for doc_id, c in found:
            if not c:
                continue
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for term in plain_terms(text):
                if c[term]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * ((1_000_000_000 * c[term]) // (1000 * c[term] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1):
            out[item_id, rank, doc_id, -score] += 1
    return out


def ranked_rows(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def lexical():
    pick = random.Random(12)
    words = [f"w{k}" for k in range(300)] + ["Ünï", "漢字", "Ab9", "x"]
    chosen = lambda n: " ".join(pick.choice(words[: int(3 + 300 * pick.random() ** 2)]) + pick.choice(["", ".", "-y", "\x00"]) for _ in range(n))
    docs = [(k, chosen(pick.randrange(1, 80))) for k in range(400)]
    docs += [(500 + k, docs[3][1]) for k in range(60)]  # ties
    docs += [(600, None), (601, ""), (602, "... \n"), (603, chosen(6000)), (3, docs[3][1]), (None, docs[3][1])]
    items = [(k, chosen(pick.randrange(1, 40))) for k in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, "w1 W1 w1"), (33, "w2"), (0, docs[3][1]), (None, "w5 w6")]
    return docs, [*items, items[4]]


def test_ranking_equals_scoring_everything(spark, lexical):
    docs, items = lexical
    table = spark.createDataFrame(docs, DOCS).selectExpr("*", "text as item_id", "doc_id as score").repartition(4)
    queries = spark.createDataFrame(items, ITEMS).selectExpr("*", "text as terms")
    want = plain_ranking(docs, items)
    assert ranked_rows(term_ranking.rank_documents(table, queries)) == want
    # Several segments in a task, several blocks of queries, other k.
    index = term_ranking.build_index(table.coalesce(1), segment_terms=700)
    assert index.count() > 10
    assert ranked_rows(term_ranking.search(index, queries, block_bytes=300)) == want
    assert ranked_rows(term_ranking.search(index, queries, k=3)) == plain_ranking(docs, items, 3)


def test_runs_of_queries_are_bounded(spark, lexical, monkeypatch):
    docs, items = lexical
    monkeypatch.setattr(term_ranking, "CELLS", 1500)
    n_docs, n_terms = 466 - 3, sum(len(plain_terms(t)) for _, t in docs)
    known = term_ranking.Codes()
    codes = [np.array([known[w] for w in term_ranking.terms_of((t or "").encode())], np.int32) for _, t in docs]
    row = dict(zip(term_ranking.INDEX_KINDS.names, term_ranking.segment_row("s", [d for d, _ in docs], codes, known), strict=True))
    segment = term_ranking.Segment(row, n_docs, n_terms)
    df = Counter(term for _, t in docs for term in set(plain_terms(t)))
    queries = []
    for _, text in items[:25]:
        own = Counter(plain_terms(text))
        order = sorted((df[t], known[t.encode()], n) for t, n in own.items() if df[t])
        queries.append((np.array([c for _, c, _ in order]), [n * term_ranking.weight(n_docs, have) for have, _, n in order]))
    queries.sort(key=lambda q: len(q[0]))
    best = [term_ranking.Best(20) for _ in queries]
    term_ranking.rank_segment(segment, np.arange(len(known)), queries, best)
    limited = whole = 0
    for (terms, weights), own in zip(queries, best, strict=True):
        exact = np.zeros(len(docs), np.int64)
        for term, w in zip(terms, weights, strict=True):
            at = slice(segment.firsts[term], segment.firsts[term] + segment.counts[term])
            exact[segment.places[at]] += w * segment.impacts[at]
        top = sorted(((-s, docs[k][0] is None, docs[k][0] or 0) for k, s in enumerate(exact) if s > 0))[:20]
        assert [(s, d) for s, d in own.rows] == [(-s, None if none else d) for s, none, d in top]
        padded = np.array([terms]), np.array([weights])
        scores = term_ranking.accumulate(segment, *padded, [term_ranking.Best(20)])
        assert ((scores[0] == exact) | (scores[0] == 0)).all()
        limited, whole = limited + np.count_nonzero(scores), whole + np.count_nonzero(exact)
    assert limited < whole  # some documents never got an accumulator


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "w1")], ITEMS)
    assert term_ranking.rank_documents(docs, items).collect() == []
    assert term_ranking.rank_documents(spark.createDataFrame([(1, "w1")], DOCS), spark.createDataFrame([], ITEMS)).collect() == []
    assert term_ranking.rank_documents(spark.createDataFrame([(1, None)], DOCS), items).collect() == []
