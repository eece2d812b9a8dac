"""Personal data by patterns and a skip-chain conditional random field (operator 12).

Four patterns give the base spans: e-mail addresses, IP addresses, card numbers, phone
numbers.  They stay as they are.  The field labels the words that the patterns miss: other
spellings of something that a pattern has found elsewhere in the document.

The words with a digit or an @ are the sites of the field; any other word has the one label
"none".  A site inside a base span has that span's label, the others are free.  Factors are

* emission: how far the word's shape, digits and neighbouring words speak for a label.  It
  always speaks against a label by at least ``DOUBT``, as the patterns have the first word;
* chain: adjacent free sites tend to the same label;
* skip: sites with equal text, equal last seven digits or the same local part of an address
  tend to the same label, however far apart they are.  Occurrences are linked in a row, each
  with the next one, so that a word that fills a document gives no more links than words.

Loopy message passing runs for a fixed number of rounds over all documents of an Arrow batch
at once; a document's result does not depend on the others.  A free part of the field without
a skip to a base span keeps the label "none", because all its factors favour that.

Weights are trained on the base spans of all documents: counts of features by label for the
emission, and of equal and different labels among linked sites that both lie in base spans.
Features are hashed to ``BUCKETS`` numbers, so the counts that reach the driver, and the
weights that it broadcasts, have a fixed size.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
BUCKETS = 1 << 14
#: Log-odds of the emission for a label against none lie between -EVIDENCE and -DOUBT.
EVIDENCE, DOUBT = 3.0, 1.0
#: The greatest weights of a chain and of a skip.
CHAIN, SKIP = 2.0, 5.0
#: Equal and different labels that every kind of link counts besides the observed ones.
PRIOR_EQUAL, PRIOR_DIFFERENT = 30.0, 1.0
#: Letters and digits that a word needs to be linked by its text, and digits by its number.
LEAST_TEXT, LEAST_DIGITS = 7, 7
ROUNDS = 30
LINKS = ("chain", "text", "digits", "local")
#: Digits of a number that may stand as several words.
MOST_DIGITS = {2: 19, 3: 15}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive, and not from inside a run of digits: the same matches in linear time.
ADDRESS = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SITE = re.compile(r"[0-9@]")
OPENS = re.compile(r"[0-9A-Za-z+(@]")
CLOSES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789)@")
NO_DIGIT = re.compile(r"[^0-9]+")

COUNTS = "what string, place int, label int, n bigint"
SPANS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to both sides: what a leftmost search finds, in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start, step = at, at + 1
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            free = step = domain.end()
            yield start, free
        at = text.find("@", step)


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the four patterns in order."""
    found = [(start, 0, end) for start, end in emails(text)]
    found += [(m.start(), 1, m.end()) for m in ADDRESS.finditer(text) if all(map(at_most_255, m.groups()))]
    for match in NUMBER.finditer(text):
        if 14 <= match.end() - match.start() <= 37 and 14 <= len(digits := NO_DIGIT.sub("", match[0])) <= 19 and luhn(digits):
            found.append((match.start(), 2, match.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= n_digits(m[0]) <= 15]
    return sorted(found)


@dataclass
class Field:
    """The sites of one document."""

    spans: list[tuple[int, int, int]]
    #: First and last position of each site without punctuation at its edges.
    places: list[tuple[int, int]] = field(default_factory=list)
    #: Number of the word in the document.
    numbers: list[int] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    features: list[tuple[int, ...]] = field(default_factory=list)
    #: Linked sites, and what links them.
    links: dict[tuple[int, int], str] = field(default_factory=dict)
    skips: list[tuple[int, int, str]] = field(default_factory=list)


def bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "surrogatepass")) % BUCKETS


def shape(core: str) -> str:
    """Runs of digits by their length, runs of letters as one letter."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda run: f"<{min(len(run[0]), 20)}>", core))


def keys(core: str) -> Iterator[tuple[str, str]]:
    """What links a word with others, the surest first."""
    digits = NO_DIGIT.sub("", core)
    low = core.lower()
    if sum(map(str.isalnum, core)) >= LEAST_TEXT:
        yield "text", low
    if len(digits) >= LEAST_DIGITS:
        yield "digits", digits[-LEAST_DIGITS:]
    local = low.partition("@")[0]
    if len(local) >= LEAST_TEXT:
        yield "local", local


def field_of(text: str) -> Field:
    out = Field(base_spans(text))
    words = [m.span() for m in WORD.finditer(text)]
    last: dict[tuple[str, str], int] = {}
    by_kind = [[span for span in out.spans if span[1] == kind] for kind in range(NONE)]
    heads = [0] * NONE  # spans of a kind do not overlap: the first that ends behind a word's start decides
    for number, (start, end) in enumerate(words):
        if not SITE.search(text, start, end):
            continue
        low, high = OPENS.search(text, start, end).start(), end  # a site has a digit or an @
        while text[high - 1] not in CLOSES:
            high -= 1
        over = []
        for kind, spans in enumerate(by_kind):
            while heads[kind] < len(spans) and spans[heads[kind]][2] <= start:
                heads[kind] += 1
            if heads[kind] < len(spans) and spans[heads[kind]][0] < end:
                over.append(spans[heads[kind]])
        core, site = text[low:high], len(out.places)
        near = [text[slice(*words[k])].lower() if 0 <= k < len(words) else "" for k in (number - 1, number + 1)]
        out.features.append((bucket("shape", shape(core)), bucket("digits", str(min(n_digits(core), 20))), bucket("before", near[0]), bucket("after", near[1])))
        out.places.append((low, high))
        out.labels.append(min(over)[1] if over else NONE)
        if out.numbers and out.numbers[-1] == number - 1:
            out.links[site - 1, site] = "chain"
        out.numbers.append(number)
        linked = set()
        for key in keys(core):
            other = last.get(key)
            last[key] = site
            if other is not None and other not in linked:
                linked.add(other)
                out.skips.append((other, site, key[0]))
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts for training over the documents of a task."""
    n: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            if not (text := text.as_py()):
                continue
            own = field_of(text)
            for label, features in zip(own.labels, own.features, strict=True):
                n["label", 0, label] += 1
                n.update(("feature", k, label) for k in features)
            for (a, b), kind in [*own.links.items(), *(((a, b), kind) for a, b, kind in own.skips)]:
                pair = own.labels[a], own.labels[b]
                if NONE not in pair:
                    n["link", LINKS.index(kind), int(pair[0] == pair[1])] += 1
    what, place, label = zip(*n, strict=True) if n else ((), (), ())
    columns = [pa.array(what, pa.string()), pa.array(place, pa.int32()), pa.array(label, pa.int32()), pa.array(n.values(), pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["what", "place", "label", "n"])


@dataclass
class Weights:
    #: Emission of each feature bucket for each kind against none.
    features: np.ndarray
    prior: np.ndarray
    links: dict[str, float]


def trained(rows: list) -> Weights:
    labels, features = np.zeros(NONE + 1), np.zeros((BUCKETS, NONE + 1))
    links = {kind: [PRIOR_DIFFERENT, PRIOR_EQUAL] for kind in LINKS}
    for row in rows:
        if row.what == "label":
            labels[row.label] += row.n
        elif row.what == "feature":
            features[row.place, row.label] += row.n
        else:
            links[LINKS[row.place]][row.label] += row.n
    given = np.log((features + 0.5) / (labels + 1.0))
    prior = np.log(labels + 1.0)
    limit = lambda kind: CHAIN if kind == "chain" else SKIP
    weighed = {kind: float(np.clip(np.log(equal / different), 0, limit(kind))) for kind, (different, equal) in links.items()}
    return Weights(given[:, :NONE] - given[:, NONE:], prior[:NONE] - prior[NONE], weighed)


def train(docs: DataFrame) -> Weights:
    """Weights from the base spans of all documents; the counts collected have a fixed size."""
    rows = candidates(docs).select("text").mapInArrow(counted, COUNTS)
    return trained(rows.groupBy("what", "place", "label").agg(F.sum("n").alias("n")).orderBy("what", "place", "label").collect())


def candidates(docs: DataFrame) -> DataFrame:
    """The text only where it has a digit or an @; other texts have no sites and no base spans."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(text.rlike("[0-9@]"), text).alias("text"))


def beliefs(unary: np.ndarray, ends: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log beliefs of all sites, up to a constant, after loopy message passing.

    ``ends`` are the linked sites (one row each), ``weights`` the log-factor that a link gives
    to equal labels.  Messages go both ways at once and are damped by half.
    """
    from_, to = np.concatenate([ends, ends[:, ::-1]]).T.reshape(2, -1)
    gain = np.expm1(np.concatenate([weights, weights]))[:, None]
    back = np.roll(np.arange(len(from_)), len(ends))
    messages, total = np.zeros((len(from_), unary.shape[1])), unary
    for _ in range(rounds if len(from_) else 0):
        v = total[from_] - messages[back]
        p = np.exp(v - v.max(axis=1, keepdims=True))
        messages = 0.5 * messages + 0.5 * np.log1p(gain * p / p.sum(axis=1, keepdims=True))
        total = unary.copy()
        np.add.at(total, to, messages)
    return total


def n_digits(text: str) -> int:
    return len(NO_DIGIT.sub("", text))


def joined(own: Field, text: str, labels: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the labelled sites; adjacent words are one span as long as its kind has room for their digits."""
    spans: list[tuple[int, int, int]] = []
    before = None
    for site, label in labels:
        low, high = own.places[site]
        number = own.numbers[site]
        if before == (number - 1, label) and n_digits(text[spans[-1][0] : high]) <= MOST_DIGITS.get(label, -1):
            low = spans.pop()[0]
        spans.append((low, label, high))
        before = number, label
    return spans


def decoded(fields: list[Field], texts: list[str], weights: Weights) -> list[list[tuple[int, int, int]]]:
    """For each document the spans that the field adds to the base ones."""
    unary, ends, strengths, firsts, numbers = [], [], [], [], 0
    held = []
    for own in fields:
        free = [k for k, label in enumerate(own.labels) if label == NONE]
        linked = any((own.labels[a] == NONE) != (own.labels[b] == NONE) for a, b, _ in own.skips)
        if not linked:
            held.append(None)
            continue
        at = {site: numbers + k for k, site in enumerate(free)}
        scores = np.zeros((len(free), NONE + 1))
        for k, site in enumerate(free):
            scores[k, :NONE] = np.clip(weights.prior + weights.features[list(own.features[site])].sum(axis=0), -EVIDENCE, -DOUBT)
        for a, b, kind in own.skips:
            for one, other in ((a, b), (b, a)):
                if own.labels[one] == NONE and own.labels[other] != NONE:
                    scores[at[one] - numbers, own.labels[other]] += weights.links[kind]
        for a, b, kind in [*own.skips, *((a, b, kind) for (a, b), kind in own.links.items())]:
            if a in at and b in at:
                ends.append((at[a], at[b]))
                strengths.append(weights.links[kind])
        unary.append(scores)
        held.append(free)
        firsts.append(numbers)
        numbers += len(free)
    if not unary:
        return [[] for _ in fields]
    labels = beliefs(np.concatenate(unary), np.array(ends, np.int64).reshape(-1, 2), np.array(strengths)).argmax(axis=1)
    out, starts = [], iter(firsts)
    for own, text, free in zip(fields, texts, held, strict=True):
        first = next(starts) if free is not None else 0
        found = [(site, int(labels[first + k])) for k, site in enumerate(free or ())]
        out.append(joined(own, text, [(site, label) for site, label in found if label != NONE]))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def finder(shared) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            fields = list(map(field_of, texts))
            added = decoded(fields, texts, shared.value)
            counts = [[sum(kind == k for _, kind, _ in own.spans) for own in fields] for k in range(NONE)]
            digests = [hashlib.sha256(listed(own.spans).encode()).hexdigest() for own in fields]
            spans = [listed(sorted(own.spans + more)) for own, more in zip(fields, added, strict=True)]
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(part.split()[0] for part in SPANS.split(", "))])

    return find


def find_private(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of the base spans, ``spans`` has those and the added ones.
    Weights are trained on ``training``, by default on ``docs`` itself.  Missing and empty
    texts have no spans, repeated rows and ids are documents of their own, texts of any length
    are read whole, and an empty table gives no rows.  Only doc_id and text are read, so other
    columns may have any names.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs if training is None else training))
    return candidates(docs).mapInArrow(finder(weights), f"doc_id bigint, {SPANS}")
