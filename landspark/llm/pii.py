"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers. The field scores whole
spans: their shape, digit count, checksum, octets, neighbours. A region is a short stretch of words with
digits, ``@`` or a bracketed "at" or "dot"; all else cannot hold an entity. Within a region, dynamic
programming over all segmentations into single outside atoms and entities of at most ``LONGEST`` atoms
chooses boundaries and kinds together.

The field is trained here by conditional likelihood: regions of a bounded, hashed sample of documents,
labelled by the patterns, and the same with spans rewritten as people disguise them ("(at)", dots in
brackets, no plus sign, other separators). So it learns to find what the patterns miss by form alone. Made-up dates,
times, ranges, scores and the like are trained on as holding nothing, and no span begins or ends inside a chain of
digits and marks.
The weights, some thousand numbers, are the only thing that goes to the tasks.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 6_000  # documents of the training sample, about
REGIONS = 2_500  # regions of them that are trained on, at most: half with entities, half without
NOISE = 600  # made-up dates, times, ranges, scores, numbers and versions that are trained on as no entities
LONGEST, ROUNDS, COPIES, RATE, SEED = 32, 3, 3, 0.2, 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{] ?(?:at|dot|AT|DOT) ?[)\]}]")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
_GAP = re.compile(r"[ ().-]*")
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_CHAIN = frozenset("-./:,_")  # marks that make one chain of the digits before and after them


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each pattern, in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            out.append(("email", first, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", at + 1 if not m else done)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() < 64 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that may hold an entity: whole words with a trigger, with the words beside a bracketed one."""
    begin, end, words = -1, -1, None
    for m in _TRIGGER.finditer(text):
        a, b = m.span()
        if a < end and b - a == 1:
            continue
        if words is None:
            words = [w.span() for w in _WORD.finditer(text)]
            starts = [w[0] for w in words]
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        if b - a > 1:
            first, last = max(0, first - 1), min(len(words) - 1, last + 1)
        lo, hi = words[first][0], words[last][1]
        if begin >= 0 and (lo <= end or _GAP.fullmatch(text, end, lo)):
            end = max(end, hi)
        else:
            if begin >= 0:
                yield begin, end
            begin, end = lo, hi
    if begin >= 0:
        yield begin, end


_RUNS = re.compile(r"[0-9]+|[A-Za-z]+|[\x80-\U0010ffff]+")


def _shape(s: str) -> str:
    return _RUNS.sub(lambda m: "9" if "0" <= m[0][0] <= "9" else "a", s)


def features(s: str, before: str, after: str) -> list[str]:
    """Features of a span as a whole. ``before``, ``after``: the characters beside it."""
    d = _digits(s)
    shape = _shape(s)
    out = ["bias", f"digits={min(len(d), 20)}", f"shape={shape[:24]}", f"marks={''.join(sorted(set(shape) - set('9a')))}"]
    if "@" in s or "at)" in s or "at]" in s or "at}" in s or "AT)" in s or "AT]" in s:
        local, _, domain = re.sub(r" ?[(\[{] ?at ?[)\]}] ?", "@", re.sub(r" ?[(\[{] ?(?:dot|\.) ?[)\]}] ?", ".", s.replace("AT", "at").replace("DOT", "dot"))).partition("@")
        out.append("address" if local and " " not in local and _DOMAIN.fullmatch(domain) else "odd address")
        out.append("letters end" if s[-1].isalpha() else "other end")
    elif any(c.isalpha() for c in s):
        out.append("letters")
    if len(d) >= 13:
        out.append(f"luhn={16 <= len(d) <= 19 and luhn(d)}")
    groups = re.findall(r"[0-9]+", s)
    if len(groups) == 4 and len(d) <= 12:
        out.append(f"octets={all(int(g) <= 255 for g in groups)}")
    out.append(f"groups={min(len(groups), 6)}")
    if len(groups) > 1:  # people part the groups of one number in one way
        out.append(f"alike={len(groups)},{len(set(re.findall(r'(?<=[0-9])[^0-9]+(?=[0-9])', s))) == 1}")
    out.append(f"left={'w' if before.isalnum() else before if before in '+@.-([/' else 's'}")
    out.append(f"right={'w' if after.isalnum() else after if after in '@-)]/' else 's'}")
    return out


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def segments(region: str) -> tuple[list[int], list[tuple[int, int]], list[list[str]]]:
    """Borders of the atoms, candidate segments as (first border, last border), and their features."""
    borders = [0, *(m.end() for m in _ATOM.finditer(region))]
    first = [region[b] for b in borders[:-1]]
    count, marks = [0], [0]
    for a, b in zip(borders, borders[1:]):
        atom = region[a:b]
        count.append(count[-1] + (b - a if "0" <= atom[0] <= "9" else 0))
        marks.append(marks[-1] + (atom == "@" or atom in ("at", "AT")))
    spans, found = [], []
    for i in range(len(first)):
        if not (first[i].isalnum() or first[i] in "+("):
            continue
        if i and first[i].isalnum() and region[borders[i] - 1].isalnum():
            continue  # not inside a word
        if i > 1 and _digit(first[i]) and first[i - 1] in _CHAIN and _digit(first[i - 2]):
            continue  # nor inside a chain of digits and marks, such as a date
        for j in range(i + 1, min(len(first), i + LONGEST) + 1):
            if not first[j - 1].isalnum() or count[j] - count[i] > 19:
                continue
            if marks[j] == marks[i] and not 4 <= count[j] - count[i]:
                continue
            if j < len(first) and first[j].isalnum():
                continue
            if j + 1 < len(first) and _digit(first[j - 1]) and first[j] in _CHAIN and _digit(first[j + 1]):
                continue
            a, b = borders[i], borders[j]
            spans.append((i, j))
            found.append(features(region[a:b], region[a - 1:a] or " ", region[b:b + 1] or " "))
    return borders, spans, found


class Field:
    """Weights of the features, one column per kind; an outside atom scores 0."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))

    def scores(self, found: list[list[str]]) -> np.ndarray:
        """Score of each segment as each kind. A shape never seen in training adds nothing."""
        get, w = self.index.get, self.weights
        return np.array([w[[k for k in map(get, f) if k is not None]].sum(axis=0) for f in found]).reshape(len(found), len(KINDS))

    def best(self, region: str) -> list[tuple[str, int, int]]:
        """Entities of the best segmentation."""
        borders, spans, found = segments(region)
        if not spans:
            return []
        scores = self.scores(found)
        kind, value = scores.argmax(axis=1), scores.max(axis=1)
        ending: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(spans):
            if value[k] > 0:
                ending.setdefault(j, []).append(k)
        best, back = [0.0] * len(borders), [-1] * len(borders)
        for j in range(1, len(borders)):
            best[j] = best[j - 1]
            for k in ending.get(j, ()):
                if best[spans[k][0]] + value[k] > best[j]:
                    best[j], back[j] = best[spans[k][0]] + value[k], k
        out, j = [], len(borders) - 1
        while j > 0:
            k = back[j]
            if k < 0:
                j -= 1
            else:
                out.append((KINDS[kind[k]], borders[spans[k][0]], borders[j]))
                j = spans[k][0]
        return out[::-1]

    def train(self, examples: list[tuple[str, list[tuple[str, int, int]]]]) -> None:
        """Ascend the log-likelihood of the labelled segmentations, one example at a time."""
        ready = []
        for region, gold in examples:
            borders, spans, found = segments(region)
            place = {(borders[i], borders[j]): k for k, (i, j) in enumerate(spans)}
            gold = [(place.get((a, b)), KINDS.index(kind)) for kind, a, b in gold]
            if spans and all(k is not None for k, _ in gold):
                ready.append((len(borders), spans, [[self.index.setdefault(x, len(self.index)) for x in f] for f in found], gold))
        self.weights = np.zeros((len(self.index), len(KINDS)))
        order, rng = list(range(len(ready))), random.Random(SEED)
        for turn in range(ROUNDS):
            rng.shuffle(order)
            for e in order:
                self._step(*ready[e], RATE / (1 + turn))

    def _step(self, n, spans, found, gold, rate) -> None:
        s = np.array([self.weights[f].sum(axis=0) for f in found])
        both = np.logaddexp.reduce(s, axis=1)
        ending, starting = {}, {}
        for k, (i, j) in enumerate(spans):
            ending.setdefault(j, []).append(k)
            starting.setdefault(i, []).append(k)
        up, down = np.zeros(n), np.zeros(n)
        for j in range(1, n):
            up[j] = np.logaddexp.reduce([up[j - 1], *(up[spans[k][0]] + both[k] for k in ending.get(j, ()))])
        for i in range(n - 2, -1, -1):
            down[i] = np.logaddexp.reduce([down[i + 1], *(down[spans[k][1]] + both[k] for k in starting.get(i, ()))])
        first, last = np.array([i for i, _ in spans]), np.array([j for _, j in spans])
        push = -np.exp(up[first][:, None] + s + down[last][:, None] - up[-1])
        for k, y in gold:
            push[k, y] += 1
        for k in np.flatnonzero(np.abs(push).max(axis=1) > 1e-4):
            self.weights[found[k]] += rate * push[k]


def _disguised(kind: str, s: str, rng: random.Random) -> str:
    """The span as people write it to get past patterns."""
    if kind == "email":
        at, dot = rng.choice([(" (at) ", "."), ("(at)", "."), (" [at] ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]")])
        if rng.random() < 0.5:  # people's names rather than numbers
            s = re.sub("[0-9]+", lambda m: rng.choice(["ann", "bo", "lee", "smith", "x"]), s)
        local, _, domain = s.partition("@")
        return local.strip(".%+-_") + at + domain.replace(".", dot)
    if kind == "ip":
        return s.replace(".", rng.choice(["[.]", "(.)", "-", " . "]))
    if kind == "card":
        d, mark = _digits(s), rng.choice([".", "/", "  ", " - "])
        return mark.join(d[k:k + 4] for k in range(0, len(d), 4))
    d = _digits(s)
    d = d[-10:] if rng.random() < 0.7 else d
    return rng.choice([s.lstrip("+"), "00" + s.lstrip("+"), f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"])


def noise(rng: random.Random) -> str:
    """Digits and marks that name no person or machine: dates, times, ranges, scores, versions, order numbers, amounts."""
    n = rng.randint
    day = rng.choice([f"{n(1990, 2035)}-{n(1, 12):02}-{n(1, 31):02}", f"{n(1, 31)}/{n(1, 12)}/{n(1990, 2035)}", f"{n(1, 31):02}.{n(1, 12):02}.{n(1990, 2035)}", f"{n(1990, 2035)}/{n(1, 12):02}/{n(1, 31):02}"])
    clock = rng.choice([f"{n(0, 23):02}:{n(0, 59):02}", f"{n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}", f"{n(0, 23)}.{n(0, 59):02}"])
    pair = lambda top: f"{n(0, top)}-{n(0, top)}"
    return rng.choice([
        lambda: day, lambda: clock, lambda: f"{day} {clock}", lambda: f"{day}T{clock}Z", lambda: f"{day} - {day}", lambda: f"{clock}-{clock}", lambda: f"{day} {clock}-{clock}",
        lambda: ", ".join(pair(rng.choice([6, 30, 300])) for _ in range(n(1, 5))), lambda: " ".join(pair(6) for _ in range(n(2, 5))), lambda: "-".join(str(n(1, 5)) for _ in range(4)),
        lambda: f"v{n(0, 12)}.{n(0, 30)}.{n(0, 30)}", lambda: f"{n(0, 12)}.{n(0, 30)}-{n(1, 9)}", lambda: f"{n(1990, 2035)}-{n(0, 10**6):06}-{n(0, 99):02}", lambda: f"No. {n(10**4, 10**9)}-{n(0, 99)}",
        lambda: f"978-{n(0, 9)}-{n(10, 99)}-{n(10**5, 10**6 - 1)}-{n(0, 9)}", lambda: f"{n(1, 999)},{n(0, 999):03},{n(0, 999):03}.{n(0, 99):02}", lambda: f"-{n(1, 89)}.{n(10**3, 10**6)}, -{n(1, 170)}.{n(10**3, 10**6)}",
        lambda: " ".join(f"{n(1, 400)}" for _ in range(n(2, 8))), lambda: f"({n(1, 99)}) {n(1, 999)} ({n(1, 99)}) {n(1, 999)}", lambda: "/".join(str(n(1, 60)) for _ in range(n(2, 6))), lambda: f"pp. {n(1, 900)}-{n(1, 900)}, {n(1, 900)}-{n(1, 900)}"])()


def examples(found: list[tuple[str, list]]) -> list[tuple[str, list]]:
    """Regions with their spans, and each a few times more with its spans disguised; broken checksums are no cards,
    and noise holds nothing."""
    rng, out = random.Random(SEED), []
    out += [(noise(rng), []) for _ in range(NOISE)]
    for region, gold in found:
        kept = []
        for kind, a, b in sorted(gold, key=lambda g: (KINDS.index(g[0]), g[1])):
            if all(b <= x or a >= y for _, x, y in kept):
                kept.append((kind, a, b))
        kept.sort(key=lambda g: g[1])
        out.append((region, kept))
        for _ in range(COPIES if kept else 0):
            text, spans, at = "", [], 0
            for kind, a, b in kept:
                text += region[at:a]
                made = _disguised(kind, region[a:b], rng)
                spans.append((kind, len(text), len(text) + len(made)))
                text, at = text + made, b
            out.append((text + region[at:], spans))
            kind, a, b = kept[0]
            if kind == "card":  # the same disguise with a wrong digit
                wrong = _disguised(kind, region[a:b - 1] + str((int(region[b - 1]) + 1) % 10), rng)
                out.append((region[:a] + wrong, []))
            if kind == "ip":
                out.append((region[:a] + _disguised(kind, "999" + region[a:b][region[a:b].index("."):], rng), []))
    return out


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    """Fit the field on about ``rows`` documents, those of the lowest text hashes; all if there are fewer."""
    spark = docs.sparkSession
    ship_package(spark)
    n = docs.count()
    bound = -2**63 + min(rows, n) * (2**64 - 1) // max(1, n)
    low = docs.select("text").filter(F.col("text").isNotNull() & (F.xxhash64("text") <= F.lit(bound)))

    def pick(batches):
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                for a, b in regions(text):
                    inner = [(k, x - a, y - a) for k, x, y in spans if a <= x and y <= b]
                    found.append((text[a:b], ";".join(f"{k}:{x}:{y}" for k, x, y in inner)))
            yield pa.RecordBatch.from_pydict({"region": [f[0] for f in found], "spans": [f[1] for f in found]},
                                             schema=pa.schema([("region", pa.string()), ("spans", pa.string())]))

    found = low.mapInArrow(pick, "region string, spans string").filter(F.length("region") <= 400).distinct()
    # half of the places for either sort, so that neither crowds out the other
    taken = [r for sort in ("spans <> ''", "spans = ''") for r in found.filter(sort).orderBy(F.xxhash64("region"), "region").limit(REGIONS // 2).collect()]
    parse = lambda s: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(";") if x)]
    field = Field()
    field.train(examples([(r, parse(s)) for r, s in taken]))
    return field


def _outside(text: str, lo: int, hi: int, inner: list[tuple[int, int]]) -> str:
    """What of a region lies outside its base spans (sorted, they may overlap), in lines."""
    parts, at = [], lo
    for a, b in inner:
        parts.append(text[at:max(a, at)])
        at = max(at, b)
    return "\n".join([*parts, text[at:hi]])


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """Base spans, and base spans with those the field adds where no base span lies; by kind, then start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for lo, hi in regions(text):
        inner = [(a, b) for a, b in taken if a < hi and b > lo] if len(taken) < 50 else [x for x in taken if x[0] < hi and x[1] > lo]
        if inner and not _TRIGGER.search(_outside(text, lo, hi, inner)):
            continue  # all its triggers lie in base spans
        added += [(k, lo + a, lo + b) for k, a, b in field.best(text[lo:hi]) if all(lo + b <= x or lo + a >= y for x, y in inner)]
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(base + added, key=order)


def pii_report(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row.

    Null and empty texts have no spans (the digest of an empty string). Repeated rows are reported each.
    Empty table: no rows.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(docs, rows))  # a few thousand weights

    def find(batches):
        for batch in batches:
            cols = {k: [] for k in ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]}
            for text in batch.column(1):
                base, every = all_spans(text.as_py() or "", field.value)
                for kind in KINDS:
                    cols[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                cols["base_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                cols["spans"].append(",".join(f"{k}:{a}:{b}" for k, a, b in every))
                cols["n_added"].append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in cols.items())],
                                             names=["doc_id", *cols])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows_.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
