"""Quality rules, near-duplicates, the positional index and line templates against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from dayplan.llm import components, line_templates, order_minhash, positional_index, quality_rules

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_words(pick, n, size=4000):
    return [f"w{pick.randrange(size)}" for _ in range(n)]


def documents(spark, texts, **extra):
    rows = [(i, text, "en", "s0", None) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    pick = random.Random(3)
    long = " ".join(some_words(pick, 6000))
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (None, "one two three four five six seven eight nine ten", "en", None, None),
        (3, " \n\t ", "en", "b", 3), (4, long, "en", "b", len(long)), (4, long, "en", "b", len(long)),
        (5, "same words again " * 8, "en", None, 10), (None, None, None, None, None), (6, "Ünï 漢字 \U0001f600 # $ x\nx\nx\n\ny", "de", "a", 5),
        (7, "word", "en", "a", 4),
    ]
    return spark.createDataFrame(rows, DOCS)


def base_counts(text):
    text = text or ""
    found = WORD.findall(text)
    windows = [tuple(found[k : k + 5]) for k in range(len(found) - 4)]
    often, hit = Counter(windows), set()
    for k, window in enumerate(windows):
        if often[window] > 1:
            hit.update(range(k, k + 5))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(found) < 10 or 100 * len(hit) > 20 * len(found)
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(hit), failed


def test_base_rules_equal_brute_force(spark, odd_docs):
    rows = quality_rules.judge(odd_docs.withColumn("w", odd_docs.lang)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter(tuple(row[name] for name in ["doc_id", *names]) for row in rows)
    assert got == Counter((row.doc_id, *base_counts(row.text)) for row in odd_docs.collect())


def test_frequent_lines_deplete_documents_but_copies_do_not(spark):
    pick = random.Random(5)
    body = lambda: " ".join(some_words(pick, 30))
    footer = "all the same footer words on every single page of this host here"
    texts = [f"{body()}\n{footer}" for _ in range(40)] + [f"short one number{i}\n{footer}" for i in range(3)]
    copied = body()
    docs = documents(spark, texts + [copied] * 60)
    rows = {row.doc_id: row for row in quality_rules.judge(docs, line_docs=20, line_share=0.05, kept_share=0.5).collect()}
    assert all(rows[i].kept for i in range(40))
    assert all(row.n_kept_chars < row.word_chars for i, row in rows.items() if i < 43)
    assert not rows[40].kept and not rows[40].base_failed
    assert all(rows[i].kept for i in range(43, 103))
    kept = quality_rules.good_documents(docs.withColumn("bad_doc_id", docs.doc_id))
    assert kept.columns == [*docs.columns, "bad_doc_id"]
    assert {row.doc_id for row in kept.collect()} == {i for i, row in rows.items() if row.kept}


def test_lines_of_one_section_of_a_large_host_are_frequent(spark):
    pick = random.Random(15)
    menu = "the menu of one section of a large host and of no other section"
    names = lambda n: " ".join("".join(pick.choice("bcdfghjklm") for _ in range(7)) for _ in range(n))
    texts = [f"{names(12)}\n{menu}" if i < 15 else names(12) for i in range(900)] + [f"{names(2)}\n{menu}" for _ in range(25)]
    rows = {row.doc_id: row for row in quality_rules.judge(documents(spark, texts)).collect()}
    squeezed = len(menu.replace(" ", ""))
    assert all(rows[i].n_kept_chars == rows[i].word_chars - (squeezed if i < 15 else 0) for i in range(900))
    assert all(rows[i].kept for i in range(900))
    assert all(not rows[i].kept and not rows[i].base_failed for i in range(900, 925))


def test_frequent_lines_leave_the_texts(spark, odd_docs):
    pick = random.Random(16)
    menu = "Home Menu of 12 entries"
    bodies = [[" ".join(some_words(pick, 12)) for _ in range(2)] for _ in range(25)]
    texts = [f"{a}\n{menu.replace('12', str(10 + i))} \n\n{b}" for i, (a, b) in enumerate(bodies)]
    docs = documents(spark, [*texts, texts[0]]).unionByName(odd_docs.selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars"))
    kept = quality_rules.good_documents(docs)
    assert kept.schema.names == docs.schema.names
    rows = [row for row in kept.collect() if row.source == "s0"]
    want = {i: f"{a}\n\n{b}" for i, (a, b) in enumerate([*bodies, bodies[0]])}
    assert {row.doc_id: row.text for row in rows} == want and len(rows) == 26
    assert all(row.n_chars == len(row.text) for row in rows)
    judged = quality_rules.judge_texts(docs).collect()
    assert len(judged) == docs.count()
    assert {row.doc_id: row.text for row in judged if row.source == "s0"} == want
    whole = Counter((row.doc_id, row.text or "") for row in docs.collect() if row.source != "s0")
    assert Counter((row.doc_id, row.text) for row in judged if row.source != "s0") == whole


def test_no_documents_at_all(spark, odd_docs):
    none = odd_docs.limit(0)
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert quality_rules.judge(none).count() == 0
    assert quality_rules.good_documents(none).count() == 0
    assert order_minhash.classes(none).count() == 0
    assert order_minhash.one_of_each_class(none).count() == 0
    assert positional_index.contamination(none, bench).count() == 0
    assert line_templates.without_templates(none).count() == 0
    assert positional_index.clean_documents(odd_docs, bench).count() == odd_docs.count()


def jaccard(a, b):
    cut = lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


def test_near_duplicates_equal_brute_force(spark):
    pick = random.Random(11)
    texts = []
    for group in range(30):
        words = some_words(pick, pick.choice([12, 60, 300]))
        texts.append(" ".join(words))
        for _ in range(pick.choice([0, 1, 2, 12])):
            changed = list(words)
            for _ in range(pick.randrange(0, 1 + len(words) // 25)):
                at = pick.randrange(len(changed))
                pick.choice([lambda: changed.pop(at), lambda: changed.insert(at, "new"), lambda: changed.__setitem__(at, "other")])()
            texts.append(" ".join(changed))
    chain = some_words(pick, 200)
    for step in range(12):  # each is close to the one before, the ends are not
        chain[step * 4] = f"step{step}"
        texts.append(" ".join(chain))
    texts += texts[:5]
    rows = {row.doc_id: row for row in order_minhash.classes(documents(spark, texts)).collect()}
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    want = {i: top(i) for i in range(len(texts))}
    assert all(want[row.class_id] == want[i] for i, row in rows.items())
    links = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j] and jaccard(texts[i], texts[j]) >= 0.8]
    met = sum(rows[i].class_id == rows[j].class_id for i, j in links)
    assert met >= 0.99 * len(links)
    kept = order_minhash.one_of_each_class(documents(spark, texts)).collect()
    assert sorted(row.doc_id for row in kept) == sorted({row.class_id for row in rows.values()})


def test_no_link_is_lost_in_a_bucket_of_many_classes(spark):
    """Texts with a long common passage fill one bucket; each has a near copy of its own."""
    pick = random.Random(6)
    passage = " ".join(some_words(pick, 60))
    texts = []
    for _ in range(60):
        own = some_words(pick, 20)
        texts += [f"{passage} {' '.join(own)}", f"{passage} {' '.join([*own[:-1], 'other'])}"]
    seeds = order_minhash.mixed(np.arange(1, 2, dtype=np.uint64) * order_minhash._ONE)
    known = order_minhash.WordHashes()
    buckets = [int(order_minhash.sketch(order_minhash.word_hashes(t, known), seeds)[0]) for t in texts]
    assert max(Counter(buckets).values()) > 40
    rows = {row.doc_id: row for row in order_minhash.classes(documents(spark, texts), n_sketches=1).collect()}
    alike = {(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8}
    assert alike == {(i + 1, i) for i in range(0, len(texts), 2)}
    together = {(i, j) for i in rows for j in range(i) if rows[i].class_id == rows[j].class_id}
    assert together <= alike
    assert {(i, j) for i, j in alike if buckets[i] == buckets[j]} <= together
    assert all(rows[i].n_links == 1 and rows[j].n_links == 1 for i, j in together)


def test_parities_never_exceed_what_one_text_has_alone():
    rng, known = random.Random(17), order_minhash.WordHashes()
    for n in (1, 4, 5, 60, 3000):
        words = [f"w{rng.randrange(2 * n)}" for _ in range(n)]
        other = [w if rng.random() < 0.9 else "x" for w in words] + words[: n // 3]
        a, b = (order_minhash.labelled_shingles(order_minhash.word_hashes(" ".join(w), known)) for w in (words, other))
        differing = int(np.bitwise_count((order_minhash.parities(a) ^ order_minhash.parities(b)).view(np.uint64)).sum())
        assert differing <= len(set(a.tolist()) ^ set(b.tolist()))
        assert (differing == 0) == (words == other)


def test_texts_of_one_passage_that_are_no_copies_are_not_fetched(spark, monkeypatch):
    """Any two texts differ in two of three places, which leaves less than 0.8 in common."""
    rng = random.Random(23)
    passage = [f"w{rng.randrange(10**9)}" for _ in range(60)]
    texts = []
    for i, j in product(range(12), repeat=2):
        words = list(passage)
        words[10], words[30], words[50] = f"a{i}", f"b{j}", f"c{(i + j) % 12}"
        texts.append(" ".join(words))
    texts += [f"{t} more" for t in texts[::12]]
    pairs, verified = [], order_minhash.verified

    def counted(found, *more):
        pairs.append(found.count())
        return verified(found, *more)

    monkeypatch.setattr(order_minhash, "verified", counted)
    rows = {row.doc_id: row for row in order_minhash.classes(documents(spark, texts)).collect()}
    for k in range(12):
        assert rows[144 + k].class_id == rows[12 * k].class_id == 12 * k
    assert len({row.class_id for row in rows.values()}) == 144
    assert sum(pairs) <= len(texts), pairs


def test_near_duplicates_of_odd_documents(spark, odd_docs):
    rows = order_minhash.classes(odd_docs.withColumn("root", odd_docs.lang)).collect()
    assert len(rows) == odd_docs.count()
    assert all(row.class_id == row.doc_id for row in rows)
    kept = order_minhash.one_of_each_class(odd_docs.withColumn("other_doc_id", odd_docs.lang))
    assert kept.count() == odd_docs.count() - 1  # the repeated row
    assert sum(row.text is None for row in kept.collect()) == 2


def test_alignment_matches_the_longest_common_subsequence():
    pick = random.Random(2)
    for _ in range(200):
        a = np.array([pick.randrange(6) for _ in range(pick.randrange(0, 25))], np.uint64)
        b = np.array([pick.randrange(6) for _ in range(pick.randrange(0, 25))], np.uint64)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        to = order_minhash.aligned(a, b, 60)
        pairs = [(i, int(j)) for i, j in enumerate(to) if j >= 0]
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == table[-1][-1]


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    rows = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}
    assert {row.node: row.root for row in rows} == want and len(rows) == len(want)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected_hits(docs, items):
    windows = {}
    for item, text in items:
        found = bench_words(text)
        for k in range(max(1, len(found) - 9) if found else 0):
            windows.setdefault(tuple(found[k : k + 10]), set()).add("" if item is None else str(item))
    out = []
    for row in docs:
        found, hit, named = bench_words(row.text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(found) - size + 1):
                if tuple(found[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    named |= windows[tuple(found[k : k + size])]
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((row.doc_id, len(found), len(hit), len(named), digest, bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block", [7, 200_000])
def test_contamination_equals_brute_force(spark, odd_docs, block, monkeypatch):
    pick = random.Random(8)
    monkeypatch.setattr(positional_index, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(positional_index.search, "__defaults__", (0, block))
    items = [(i, " ".join(some_words(pick, n))) for i, n in enumerate([3, 10, 11, 40, 25, 1])]
    items += [(3, items[4][1]), (None, "alpha, beta; gamma"), (50, None), (51, "..."), (52, "one TWO three four five six seven eight nine ten eleven")]
    texts = [" ".join([*some_words(pick, 30), text or "", *some_words(pick, 30)]) for _, text in items]
    texts += [items[3][1][:90] + "\n" + items[3][1][30:], items[3][1].upper(), "one two three four five six seven eight nine", "ten eleven"]
    docs = documents(spark, texts).unionByName(odd_docs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = positional_index.contamination(docs, bench).collect()
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = expected_hits(docs.collect(), items)
    assert Counter(tuple(row[name] for name in names) for row in rows) == want
    clean = positional_index.clean_documents(docs.withColumn("text_hash", docs.lang), bench)
    assert clean.count() == sum(n for row, n in want.items() if not row[5])


def test_proximity_finds_words_with_others_between(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [item.replace("gamma", "gamma extra"), item.replace("beta", "beta x y z"), item, "beta alpha " + item[11:], item[:-6]]
    bench = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    rows = {row.doc_id: row for row in positional_index.contamination(documents(spark, texts), bench, slop=2).collect()}
    assert [rows[i].near_items for i in range(5)] == [["9"], [], [], [], []]
    assert [rows[i].contaminated for i in range(5)] == [False, False, True, False, False]


def test_line_templates_generalise_fields_and_keep_prose(spark, odd_docs):
    pick = random.Random(4)
    texts = []
    for i in range(15):
        prose = "\n".join(" ".join(some_words(pick, 8)) for _ in range(3)).replace("w", "x ").translate({c: None for c in range(48, 58)})
        lines = [f"Posted on day {i} by user{i}", f"Read more about {pick.choice(['cats', 'dogs', 'fish'])} on our site", f"unlike line {'abcdefghijklmno'[i]} {'z' * i} q"]
        texts.append("\n".join([f"start {chr(97 + i) * 3} of text", *lines, ""]) + prose * 0)
    docs = documents(spark, texts).unionByName(odd_docs)
    rows = {row.doc_id: row for row in line_templates.without_templates(docs, min_texts=10).collect() if row.doc_id is not None}
    for i in range(8, 15):
        assert "Posted" not in rows[i].text and "Read more" not in rows[i].text
        assert "unlike line" in rows[i].text and rows[i].n_dropped == 2
    assert line_templates.without_templates(docs, min_texts=10).count() == docs.count()
    few = line_templates.without_templates(docs, min_texts=16).collect()
    assert all(row.n_dropped == 0 for row in few)


def test_templates_that_share_a_leaf_and_long_passages_are_all_found(spark):
    pick = random.Random(9)
    name = lambda: "".join(pick.choice("bcdfghjklm") for _ in range(7))
    ends = [("on", "our", "site"), ("in", "the", "shop")]
    texts = [f"alpha {name()}\nRead more about {name()} {' '.join(ends[i % 2])}" for i in range(30)]
    texts += [f"beta {name()}\nRead more about {' '.join(name() for _ in range(4))}" for _ in range(60)]  # prose of the same leaf
    places = [tuple(name() for _ in range(3)) for _ in range(4)]
    texts += [f"gamma {name()}\nsold by the {name()} near {p[0]} of {name()} {p[1]} to {name()} {p[2]} via {name()} {p[0]}" for p in places for _ in range(12)]
    passage = " ".join(name() for _ in range(24))
    shared = passage.split()
    shared[10] = "changed"
    texts += [f"delta one {name()}\n{passage}", f"delta two {name()}\n{passage}", f"delta three {name()}\n{' '.join(shared)}"]
    short = " ".join(name() for _ in range(12))
    texts += [f"short {name()}\n{short}", f"short {name()}\n{short}"]
    rows = {row.doc_id: row for row in line_templates.without_templates(documents(spark, texts)).collect()}
    assert all(rows[i].text == texts[i].split("\n")[0] and rows[i].n_dropped == 1 for i in range(30))
    assert all(rows[i].n_dropped == 0 for i in range(30, 90))
    assert all(rows[i].n_dropped == 1 for i in range(90, 138))
    assert sorted(rows[i].n_dropped for i in range(138, 141)) == [0, 1, 1]  # one text keeps the passage
    assert rows[141].n_dropped == rows[142].n_dropped == 0


def templates_by_brute_force(texts, hashes, min_texts):
    """Text, filled lines and dropped lines of each text, with every group of a leaf made by plain comparison."""

    def variant(line):
        return tuple("<*>" if re.search("[0-9]", token) else token for token in re.split(r"[ \t\x0b-\r]+", line.strip(" \t\x0b\x0c\r")))

    where = {}
    for text in set(texts):
        for line in text.split("\n"):
            if line.strip(" \t\x0b\x0c\r"):
                where.setdefault(variant(line), set()).add(text)
    leaves, keepers = {}, {}
    for line in where:
        leaves.setdefault((len(line), line[:3]), []).append(line)
    for (size, _), members in leaves.items():
        need = min(2, min_texts) if size >= 20 else min_texts
        counts = Counter((at, token) for line in members for at, token in enumerate(line) for _ in where[line])
        rest = max(size - 3, 1)
        keys = [lambda line, c=c: tuple(line[i] for i in range(3, size) if c >> ((i - 3) * 4 // rest) & 1) for c in range(15)]
        keys += [lambda line, k=k: tuple((at, t) for at, t in enumerate(line) if counts[at, t] >= need * 8**k) for k in range(6)]
        for key in keys:
            groups = {}
            for line in members:
                groups.setdefault(key(line), []).append(line)
            for group in groups.values():
                total = sum(len(where[line]) for line in group)
                if len(group) == 1 or total < need:
                    continue
                at_place = [Counter(line[at] for line in group for _ in where[line]).most_common(1)[0] for at in range(size)]
                template = [token if n >= 0.6 * total else "<*>" for token, n in at_place]
                alike = [line for line in group if sum(map(str.__eq__, line, template)) >= 0.6 * size]
                found = set().union(*(where[line] for line in alike))
                if set(template) != {"<*>"} and len(found) >= need:
                    for line in alike:
                        keepers.setdefault(line, []).append(min(hashes[t] for t in found) if len(found) < min_texts else None)
        for line in members:
            if len(where[line]) >= need:
                keepers.setdefault(line, []).append(min(hashes[t] for t in where[line]) if len(where[line]) < min_texts else None)
    kept_by = {line: None if None in found else min(found) for line, found in keepers.items()}
    out = []
    for text in texts:
        lines = text.split("\n")
        filled = [bool(line.strip(" \t\x0b\x0c\r")) for line in lines]
        goes = [f and variant(x) in kept_by and kept_by[variant(x)] != hashes[text] for f, x in zip(filled, lines)]
        left = "\n".join(x for g, x in zip(goes, lines) if not g)
        out.append((text if not any(goes) else left if left.strip(" \t\x0b-\r\n") else "", sum(filled), sum(goes)))
    return out


@pytest.mark.parametrize("seed, min_texts", [(1, 3), (2, 6)])
def test_line_templates_equal_brute_force(spark, seed, min_texts):
    pick = random.Random(seed)
    token = lambda: pick.choice(["red", "blue", "green", "x7", "42", "é", "tall"])
    base = [[token() for _ in range(n)] for n in (1, 2, 4, 5, 9, 9, 20, 22, 24)]

    def line():
        tokens = list(pick.choice(base))
        for _ in range(pick.choice([0, 0, 1, 2, 5])):
            tokens[pick.randrange(len(tokens))] = token()
        return pick.choice(["", "", " ", "\t"]) + pick.choice([" ", " ", "  ", "\r"]).join(tokens) + pick.choice(["", " "])

    texts = ["\n".join(pick.choice([line, line, line, lambda: " "])() for _ in range(pick.randrange(1, 6))) for _ in range(120)]
    texts += texts[:10] + ["", "\n", " \n\t"]
    docs = documents(spark, texts)
    hashes = {row.text: row.h for row in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    rows = {row.doc_id: (row.text, row.n_lines, row.n_dropped) for row in line_templates.without_templates(docs, min_texts).collect()}
    want = templates_by_brute_force(texts, hashes, min_texts)
    assert sum(n for _, _, n in want) > 20
    assert rows == dict(enumerate(want))
