"""URL lists, tool chats and site quality against brute force and held-out labels."""

import datetime
import json
import math
import random
from collections import Counter, defaultdict
from decimal import Decimal
from urllib.parse import urlsplit

import pytest
from dayplan.llm import site_quality, tool_chat, url_lists

ENTRIES = "list_name string, kind string, pattern string, action string, dated date, pattern_note string"
CAPTURES = "page_id bigint, url string, fetched_at date, verdict string, _url string"
MESSAGES = f"conv_id bigint, turn bigint, role string, text string, calls {tool_chat.CALLS}, result_of string, msg string"
SCHEMAS = "tool string, parameter string, kind string, required boolean"
DAY0 = datetime.date(2021, 11, 1)


def keys_of(url):
    parts = urlsplit(url or "")
    host = (parts.hostname or "").rstrip(".")
    if not host:
        return set()
    labels = host.split(".")
    steps = [s for s in parts.path.split("/") if s]
    domains = {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))}
    return domains | {f"{host}/{'/'.join(steps[:i])}" for i in range(1, len(steps) + 1)}


def verdict_of(url, at, history):
    active = []
    for (name, kind, pattern), events in history.items():
        past = [(dated, action) for dated, action in events if at is not None and dated <= at]
        if pattern in keys_of(url) and past and max(past)[1] == "add":
            active.append((len(pattern), kind == "allow", pattern, name))
    if not active:
        return 0, "none", None, None
    _, allows, pattern, name = max(active)
    return len(active), "allow" if allows else "block", pattern, name


def test_url_verdicts_equal_brute_force(spark):
    pick = random.Random(1)
    hosts = ["a.example.org", "b.example.org", "example.org", "news.site.net", "localhost"]
    patterns = [*hosts, "site.net", "org", "a.example.org/x", "a.example.org/x/y", "news.site.net/x"]
    entries = [
        (pick.choice("LM"), pick.choice(["block", "allow"]), pick.choice(patterns), pick.choice(["add", "add", "remove"]), DAY0 + datetime.timedelta(pick.randrange(900)), "n")
        for _ in range(250)
    ]
    entries += entries[:5] + [("L", "block", None, "add", DAY0, None), ("L", "block", "localhost", "add", None, None)]
    urls = [f"http://{host}{path}" for host in hosts for path in ("", "/", "/x", "/x/y?q=1", "/x/y/z#f", "/xy")]
    urls += ["HTTP://u@A.Example.ORG.:80/x", "no url", "", None]
    rows = [(k, pick.choice(urls), DAY0 + datetime.timedelta(pick.randrange(-20, 1000)), "old", "own") for k in range(400)]
    rows += rows[:7] + [(None, urls[0], None, None, None)]
    history = defaultdict(list)
    for name, kind, pattern, action, dated, _ in entries:
        if pattern is not None and dated is not None:
            history[name, kind, pattern].append((dated, action))
    captures, listed = spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(entries, ENTRIES)
    got = url_lists.url_verdicts(captures, listed).collect()
    names = ["page_id", "url", "fetched_at", "_url", "n_active", "verdict", "pattern", "list_name"]
    assert Counter(tuple(row[n] for n in names) for row in got) == Counter(
        (page, url, at, own, *verdict_of(url, at, history)) for page, url, at, _, own in rows
    )
    assert url_lists.url_verdicts(captures.limit(0), listed).count() == 0
    assert {row.verdict for row in url_lists.url_verdicts(captures, listed.limit(0)).collect()} == {"none"}


@pytest.fixture(scope="module")
def schemas(spark):
    rows = [("find", "query", "string", True), ("find", "limit", "integer", False), ("find", "deep", "boolean", False), (None, "x", "string", True)]
    return spark.createDataFrame(rows, SCHEMAS)


def chat(spark, rows):
    return spark.createDataFrame([(*row, "own") for row in rows], MESSAGES)


def canonical(conv, role, text, calls=(), result_of=None):
    fields = {"conv_id": conv, "role": role, "content": text, "tool_call_id": result_of}
    fields = {key: value for key, value in fields.items() if value is not None}
    if calls:
        fields["tool_calls"] = [{k: v for k, v in zip(("id", "name", "arguments"), call, strict=True) if v is not None} for call in calls]
    return json.dumps(fields, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_messages_become_canonical_json_with_checked_calls(spark, schemas):
    long = "word " * 40_000
    rows = [
        (1, 0, "user", 'say "é"\n{x}', None, None),
        (1, 1, "assistant", None, [("a", "find", '{"query": "q", "limit": 3}'), ("b", "other", '{"z": {"y": [1, null], "a": true}}')], None),
        (1, 2, "tool", "", None, "a"), (1, 3, "tool", "late", None, "nobody"),
        (1, 4, "assistant", long, [("a", "find", '{"limit": "many", "extra": 1}'), (None, "find", "not json"), ("d", "find", None)], None),
        (2, None, None, None, None, None), (None, 5, "user", "x", [], None), (2, 1, "user", "x", None, None), (2, 1, "user", "x", None, None),
    ]
    got = Counter((row.json, row.errors) for row in tool_chat.format_chats(chat(spark, rows), schemas).collect())
    want = [
        (canonical(1, "user", rows[0][3]), ""),
        (canonical(1, "assistant", None, [("a", "find", {"query": "q", "limit": 3}), ("b", "other", {"z": {"y": [1, None], "a": True}})]), "unknown tool; no result"),
        (canonical(1, "tool", "", (), "a"), ""), (canonical(1, "tool", "late", (), "nobody"), "result without call"),
        (
            canonical(1, "assistant", long, [("a", "find", {"limit": "many", "extra": 1}), (None, "find", "not json"), ("d", "find", None)]),
            "wrong kind: limit; missing: query; unknown parameter: extra; repeated identifier;"
            " arguments are not an object; no identifier; arguments are not an object; no result",
        ),
        (canonical(2, None, None), ""), (canonical(None, "user", "x"), ""), (canonical(2, "user", "x"), ""), (canonical(2, "user", "x"), ""),
    ]
    for row in want:
        assert got[row] == want.count(row), row
    assert sum(got.values()) == len(rows)
    assert tool_chat.format_chats(chat(spark, rows).limit(0), schemas).count() == 0
    assert tool_chat.format_chats(chat(spark, rows), schemas.limit(0)).count() == len(rows)


def test_messages_follow_what_they_wait_for(spark, schemas):
    pick, rows, before = random.Random(6), [], defaultdict(set)
    for conv in range(30):
        turns = list(range(24))
        pick.shuffle(turns)
        ids = [f"c{k}" for k in range(8)]
        for k, call in enumerate(ids):
            wanted = pick.sample(ids[:k], min(k, pick.randrange(3)))
            given = json.dumps({"query": " ".join("{{%s}}" % other for other in wanted)})
            rows.append((conv, turns[k], "assistant", call, [(call, "find", given)], None))
            rows.append((conv, turns[8 + k], "tool", f"result {call}", None, call))
            before[conv, f"result {call}"].add(call)
            before[conv, call] |= {f"result {other}" for other in wanted}
            rows.append((conv, turns[16 + k], "user", f"free {k}", None, None))
    circle = [(99, k, "assistant", f"x{k}", [(f"x{k}", "find", json.dumps({"query": "{{x%d}}" % (1 - k)}))], None) for k in range(2)]
    circle += [(99, 2 + k, "tool", f"result x{k}", None, f"x{k}") for k in range(2)]
    got = tool_chat.format_chats(chat(spark, rows + circle), schemas).collect()
    place = {(row.conv_id, json.loads(row.json)["content"]): (row.slot, row.depth, row.turn, row.json) for row in got}
    for (conv, name), firsts in before.items():
        assert all(place[conv, first] < place[conv, name] for first in firsts)
    assert all(row.slot == row.turn for row in got if row.role == "user")
    assert {row.conv_id for row in got if "circular" in row.errors} == {99}


def site_rows(pick, n):
    """Good documents are prose, bad ones shout; four sites with other shares of good ones, and sparse ones."""
    for k in range(n):
        site = pick.choice([*"abcd" * 5, f"sparse{k}"])
        good = pick.random() < {"a": 0.95, "b": 0.7, "c": 0.3, "d": 0.05}.get(site, 0.5)
        words = [f"word{pick.randrange(500)}" if pick.random() < 0.3 else "calm text" for _ in range(pick.randrange(20, 80))]
        noisy = [w.upper() + "!!" if pick.random() < (0.05 if good else 0.5) else w for w in words]
        yield k, ", ".join(noisy) + ".", pick.choice(["en", "de", None]), None if site == "d" else site, good


def test_site_quality_on_held_out_labels_and_its_posteriors(spark):
    rows = list(site_rows(random.Random(9), 1500))
    docs = spark.createDataFrame([(*row[:4], 0.0) for row in rows], "doc_id bigint, text string, lang string, source string, p double")
    seen = [(row[0], int(row[4])) for row in rows[:700]]
    labels = spark.createDataFrame([*seen, (None, 1), (99_999, 1), (3, None), (4, 7)], "doc_id bigint, quality int")
    got = {row.doc_id: row for row in site_quality.quality(docs, labels).collect()}
    held_out = [got[row[0]].kept == row[4] for row in rows[700:]]
    assert len(got) == 1500 and sum(held_out) > 0.95 * len(held_out)

    prior = (sum(q for _, q in seen) + 1) / (len(seen) + 2)
    p = {k: 1 / (1 + math.exp(-row.evidence) * (1 - prior) / prior) for k, row in got.items()}

    def grouped(key):
        found = defaultdict(lambda: [0, 0.0])
        for row in rows:
            found[key(row)][0] += 1
            found[key(row)][1] += p[row[0]]
        return found

    def weight(groups, rate):
        wide = [(n, g, rate(k)) for k, (n, g) in groups.items() if n >= 2]
        chance = sum(r * (1 - r) for _, _, r in wide)
        spread = sum(n * (g / n - r) ** 2 for n, g, r in wide)
        between = (spread - chance) / (sum(n for n, _, _ in wide) - len(wide))
        return min(max(chance / len(wide) / max(between, 1e-9) - 1, 1.0), 1000.0)

    sites, paths = grouped(lambda row: row[3]), grouped(lambda row: (row[3], row[2]))
    site_weight = weight(sites, lambda _: prior)
    path_weight = weight(paths, lambda k: (sites[k[0]][1] + site_weight * prior) / (sites[k[0]][0] + site_weight))
    for k, _, lang, site, _ in rows:
        (n, g), (pn, pg) = sites[site], paths[site, lang]
        site_rate = (g - p[k] + site_weight * prior) / (n - 1 + site_weight)
        path_rate = (pg - p[k] + path_weight * site_rate) / (pn - 1 + path_weight)
        assert got[k].site_rate == pytest.approx(site_rate, abs=1e-9) and got[k].path_rate == pytest.approx(path_rate, abs=1e-9)
        logit = got[k].evidence + math.log(path_rate / (1 - path_rate))
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)


def test_site_quality_of_odd_tables(spark):
    rows = [(1, None, None, None), (None, "", "en", "a"), (2, "word " * 30_000, "en", "a"), (2, "word " * 30_000, "en", "a"), (3, "#" * 50, None, "b")]
    docs = spark.createDataFrame([(*row, 1) for row in rows], "doc_id bigint, text string, lang string, source string, bins int")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    assert site_quality.quality(docs, labels).count() == len(rows)
    unlabelled = site_quality.quality(docs, labels.limit(0)).collect()
    assert len(unlabelled) == len(rows) and all(row.evidence == 0 and row.score == pytest.approx(0.5) for row in unlabelled)
    assert site_quality.quality(docs.limit(0), labels).count() == 0


def test_numbers_have_one_form(spark, schemas):
    pick = random.Random(3)
    literals = ["0", "-0", "0.0", "1e2", "100.0", "100", "1E-3", "-2.50e1", "12345678901234567890123456789012345678", "0.1", "5e-38", "1e37", "0e999"]
    for _ in range(60):
        body = str(pick.randrange(10 ** pick.randrange(1, 20)))
        body += "." + "".join(pick.choice("001234") for _ in range(pick.randrange(1, 9))) if pick.random() < 0.6 else ""
        literals.append(pick.choice(["", "-"]) + body + (f"{pick.choice('eE')}{pick.choice(['', '+', '-'])}{pick.randrange(9)}" if pick.random() < 0.5 else ""))
    strings = ['say \\"1e2\\" 1.50', "back\\\\", "3.10\\n" * 20_000]
    rows, want = [], []
    for i, literal in enumerate(literals):
        text = strings[i % 3]
        rows.append((i, 0, "assistant", None, [("a", "other", '{"z": [true, %s , {"n":%s}], "e": "%s"}' % (literal, literal, text))], None))
        plain = format(Decimal(literal), "f")
        plain = plain.rstrip("0").rstrip(".") if "." in plain else plain
        plain = "0" if Decimal(literal) == 0 else plain
        want.append('"arguments":{"e":"%s","z":[true,%s,{"n":%s}]}' % (text, plain, plain))
    got = {row.conv_id: row.json for row in tool_chat.format_chats(chat(spark, rows), schemas).collect()}
    for i, part in enumerate(want):
        assert part in got[i], (literals[i], got[i][:200], part[:200])


def test_numbers_out_of_range_are_an_error_and_stay_text(spark, schemas):
    wide = ["1E400", "1e38", "1" * 39, "1e-39", "1e99999999999", "0." + "1" * 39]
    rows = [(i, 0, "assistant", None, [("a", "find", '{"query": "q", "limit": %s}' % n)], None) for i, n in enumerate(wide)]
    rows.append((90, 0, "assistant", None, [("a", "find", "not json 1E400")], None))
    rows.append((91, 0, "assistant", None, [("a", "find", '{"query": "1E400", "limit": 1e2}')], None))
    got = {row.conv_id: row for row in tool_chat.format_chats(chat(spark, rows), schemas).collect()}
    for i, n in enumerate(wide):
        assert got[i].errors == "number out of range; no result"
        assert json.loads(got[i].json)["tool_calls"][0]["arguments"] == rows[i][4][0][2]
    assert got[90].errors == "arguments are not an object; no result"
    assert got[91].errors == "no result" and '"limit":100,' in got[91].json
