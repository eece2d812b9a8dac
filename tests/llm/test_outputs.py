"""Archives and token files as exact round trips, mixing against its targets."""

import random
from pathlib import Path
import base64
import hashlib
import zlib

import numpy as np
from dayplan.llm import mixing, token_orc, warc
from dayplan.llm.common import vocabulary


def test_archives_round_trip(spark):
    rows = [(3, "http://a/x", "<p>é</p>", 1), (1, "http://a/y\r\nEvil: 1", "<p>é</p>", 1), (2, None, None, 1), (5, "u", "", 1), (None, "n", "<p>é</p>", 1), (9, "l", "x" * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, offset int")
    got = {row.page_id: row for row in warc.round_trip(spark, pages).collect()}
    assert len(got) == len(rows)
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        assert got[page_id].payload_bytes == len(data)
        assert got[page_id].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if r.record_type == "revisit"} == {3: ("revisit", 1), 5: ("revisit", 2)}
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    texts = {7: "Don't stop, Ünï! 漢字 x<|endoftext|>y", 2: None, 5: "", 4: "word " * 5000, 9: " ́a\tb\x1cc"}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id bigint, text string, ids int")
    encode, start, want = Tokenizer.from_file(vocabulary()).encode, 0, []
    for i in sorted(texts):
        ids = [*encode(texts[i] or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_orc.encode_documents(docs, vocabulary()).collect())) == want
    assert token_orc.encode_documents(docs.limit(0), vocabulary()).count() == 0


def test_mixture_reaches_its_targets(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 3}" if i % 5 else None, i) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, None, None, 0), (3, "w w", "s0", 1)], "doc_id bigint, text string, source string, taken int")
    got = mixing.word_budget(docs).collect()
    assert len(got) == 202 and all(0 <= row.taken <= 2 * row.size for row in got)
    sums = {}
    for row in got:
        sums.setdefault((row.source_size, row.target), 0)
        sums[row.source_size, row.target] += row.taken
    assert all(abs(taken - target) <= 0.5 for (_, target), taken in sums.items())
    mixed = mixing.mixture(docs)
    assert mixed.columns == [*docs.columns, "shard", "place"]
    assert sum(len(row.text.split()) for row in mixed.collect()) == sum(row.taken for row in got)
    assert mixing.word_budget(docs.limit(0)).count() == 0


def test_selected_records_of_several_archives(spark, tmp_path):
    pick = random.Random(6)
    texts = ["".join(pick.choice("abcdefgh <>é") for _ in range(pick.choice([0, 40, 3000, 90000]))) for _ in range(160)]
    texts += [texts[2], texts[2], None]
    rows = [(k if k != 5 else 4, f"https://h{k % 3}.example/{k}", text) for k, text in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2)
    folder = str(tmp_path / "archives")
    index = warc.write_archives(pages, folder, archive_bytes=100_000, dated="2024-01-05T00:00:00Z")
    names = [row.archive for row in index.select("archive").distinct().collect()]
    assert len(names) > 5 and {path.name for path in Path(folder).iterdir()} == set(names)
    # Every seventh record and a run at the end: gaps, joined ranges, several archives.
    wanted = {url for k, (_, url, _) in enumerate(rows) if k % 7 == 0 or k > 140}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        selected = warc.read_records(index.filter(index.url.isin(*wanted)), folder)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert selected.rdd.getNumPartitions() > 1
    got = {row.url: row for row in selected.collect()}
    assert got.keys() == wanted
    for page_id, url, text in rows:
        if url in wanted:
            payload = (text or "").encode()
            row = got[url]
            assert (row.page_id, row.payload_bytes, row.payload_digest) == (page_id, len(payload), warc.sha1_of(payload))
            assert bytes(row.payload) == payload if row.record_type == "response" else row.payload is None and row.refers_to is not None
    heads = [zlib.decompress(member, 31).split(b"\r\n\r\n")[0].decode() for member in members(folder, index)]
    ids = [line for head in heads for line in head.split("\r\n") if line.startswith("WARC-Record-ID: <urn:uuid:")]
    assert len(set(ids)) == len(heads) == len(rows)
    assert all("WARC-Date: 2024-01-05T00:00:00Z" in head for head in heads)


def members(folder, index):
    for row in index.collect():
        with (Path(folder) / row.archive).open("rb") as file:
            file.seek(row.offset)
            yield file.read(row.length)


def test_folders_are_qualified_before_tasks_open_them(spark, tmp_path):
    named = warc.qualified(spark, str(tmp_path))
    assert named == f"file:{tmp_path}" and warc.file_system(named)[1] == str(tmp_path)
    assert warc.qualified(spark, f"file://{tmp_path}").startswith("file:/")


def test_words_are_looked_up_once_and_only_new_ones_are_learned(monkeypatch):
    asked, learn = [], token_orc.WordIds.learn
    monkeypatch.setattr(token_orc.WordIds, "learn", lambda self, words: (asked.append(set(words)), learn(self, words))[1])
    known = token_orc.WordIds(vocabulary())
    texts = ["one two\tTwo, one", "", "three ünï two"]
    first = known.encode(texts)
    assert asked == [{"one", "two", "Two,", "three", "ünï"}]
    assert known.encode(texts) == first == [known.whole(text) for text in texts]
    assert known.encode(["two four"]) == [known.whole("two four")]
    assert asked[1:] == [set(), {"four"}]
    monkeypatch.setattr(token_orc, "REMEMBERED_WORDS", 3)  # the tables are emptied between two lookups of a text
    assert known.encode(["one five two"]) == [known.whole("one five two")]


def test_a_worker_remembers_a_bounded_number_of_words_and_the_common_ones_longest(monkeypatch):
    monkeypatch.setattr(token_orc, "REMEMBERED_WORDS", 400)
    asked, learn = [], token_orc.WordIds.learn
    monkeypatch.setattr(token_orc.WordIds, "learn", lambda self, words: (asked.append(set(words)), learn(self, words))[1])
    known = token_orc.WordIds(vocabulary())
    for k in range(30):
        # Each new word and its stem: two entries of 60 words.
        new = ["Q" + "".join(chr(97 + int(d)) for d in f"{k:02d}{i:03d}") + ";" for i in range(60)]
        texts = ["The common, words of ȾȺ Ⱦⱥ all", " ".join(new), "texts. ünï's 漢字 x1 <|endoftext|>"]
        assert known.encode(texts) == [known.whole(text) for text in texts]
        held = len(known) + sum(len(value) for value in vars(known).values() if isinstance(value, dict))
        assert held <= 400 + 200
    assert all("common," not in words and "texts." not in words for words in asked[1:])


def test_a_word_is_looked_up_once_however_often_it_occurs_and_its_parts_are_shared(monkeypatch):
    looked_up, asked, learn = [], [], token_orc.WordIds.learn
    monkeypatch.setattr(token_orc.WordIds, "get", lambda self, *key: (looked_up.append(key[0]), dict.get(self, *key))[1], raising=False)
    monkeypatch.setattr(token_orc.WordIds, "learn", lambda self, words: (asked.append(set(words)), learn(self, words))[1])
    known = token_orc.WordIds(vocabulary())
    texts = ["one, TWO ünï's " * 500, "", "two\n" * 500 + "One"]
    assert known.encode(texts) == [known.whole(text) for text in texts]
    assert sorted(looked_up) == sorted({"one", "two", "ünï's", ",", ""})
    assert known.encode(["TWO, one Two"]) == [known.whole("TWO, one Two")] and asked[1:] == [set()]


def test_texts_are_encoded_in_pieces_of_a_batch(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_orc, "TEXT_BYTES", 12, raising=False)
    texts = ["one two", None, "three, " * 40, "", "x1 <|endoftext|>", "İı Ǆ ª", "four"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    got = list(token_orc.encoder(vocabulary(), 1)(iter([batch, batch.slice(0, 0), batch.slice(2)])))
    assert len(got) == 7
    rows = [row for piece in got for row in piece.to_pylist()]
    known, start = token_orc.WordIds(vocabulary()), 0
    for row, k in zip(rows, [*range(7), *range(2, 7)], strict=True):
        ids = [*np.frombuffer(known.whole(texts[k] or ""), "<u4").tolist(), 1]
        assert row == {"doc_id": k, "file_start": start, "ids": ids}
        start += len(ids)
