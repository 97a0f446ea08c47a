"""Operators against brute force on small tables with nulls, ties, empty and long texts."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from landspark.llm import decontamination, lattice, mixing, near_texts, pii, quality, queries, sharding, simhash, site_lines, substrings, token_counts
from landspark.llm.common import running_total, table, word_count, words_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _row int, size long, shard int, h long, stratum string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text and a long word."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = say(60), say(35)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "two words", base, base, base, base + " tail", "Head " + base, say(30) + " " + passage + " " + say(10),
             passage + "\n" + say(25), passage + " " + passage, say(3000) + " " + passage, "x" * 5000, "é" * 50 + " ñandú Ünï " + say(20),
             "line one\nline one\n\nline two\nline one", "#$% *** <a> | & " + say(12), "a b c d e f g h i j " * 5, say(21), say(20), say(19)]
    rows = [(i * 3, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "Z", ""][i % 5], None, "k", 1, 2, 3, 4, "z") for i, t in enumerate(texts)]
    rows += [rows[5], rows[10], rows[10], (15, say(40), "en", "s1", 1, None, None, None, None, None, None), (None, base, None, None, None, *[None] * 6), (None, say(25), "en", "s2", None, *[None] * 6)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(a, b):
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def test_words(spark, odd):
    for text, words, n in odd.select("text", words_of(F.col("text")), word_count(F.col("text"))).collect():
        assert words == WORD.findall(text or "") and n == len(words)


def test_running_total(spark):
    rows = [(i % 7, i, i * i % 11) for i in range(200)]
    got = running_total(spark.createDataFrame(rows, "a int, b int, n int").repartition(4), ["a", "b"], "n", "t").collect()
    want, total = [], 0
    for r in sorted(rows):
        total += r[2]
        want.append((*r, total))
    same(got, want)


# --- 1

def greedy_capacity(sizes, shards):
    def needed(c):
        n, room = 0, 0
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n
    low, high = max(sizes) - 1, sum(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= shards else (mid, high)
    return high


@pytest.mark.parametrize("seed,segments", [(1, 32_768), (2, 40), (3, 40), (4, 64), (5, 33)])
def test_minimax_cuts(spark, monkeypatch, seed, segments):
    monkeypatch.setattr(sharding, "SEGMENTS", segments)  # few segments: several rounds
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50, rng.randint(1, 5000)]) for _ in range(rng.choice([3, 400, 2000]))]
    upto = list(itertools.accumulate(sizes))
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame([(u,) for u in upto], "upto long"), upto[-1], max(sizes), 16)
    assert capacity == greedy_capacity(sizes, 16)
    assert cuts[-1] == upto[-1] and all(b - a <= capacity for a, b in zip([0, *cuts], cuts)) and set(cuts) <= set(upto)


def check_shards(rows, docs, shards):
    text_of = {}
    for d, t in docs:
        text_of.setdefault((d, zlib.crc32(t.encode()) if t is not None else None), t)
    assert len(rows) == len(docs) and all(0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None for r in rows)
    assert all(r.size == len((text_of[r.doc_id, r.text_crc32] or "").encode()) + 1 for r in rows)
    where, slots, sizes, first = {}, {}, Counter(), {}
    for r in rows:
        t = text_of[r.doc_id, r.text_crc32]
        assert where.setdefault(t, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[t] += r.size
        first[t] = min(first.get(t, math.inf), math.inf if r.doc_id is None else r.doc_id)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    key = lambda t: hashlib.md5(t.encode()).digest() if t is not None else b""
    order = sorted(sizes, key=lambda t: (first[t], key(t)))
    assert [where[t] for t in order] == sorted(where[t] for t in order)  # contiguous
    load = Counter()
    for t in order:
        load[where[t]] += sizes[t]
    assert max(load.values()) == greedy_capacity([sizes[t] for t in order], shards)


def test_sharding(spark, odd, none):
    for docs, shards in ((odd, 16), (odd, 3), (table(spark, SF, "documents"), 16)):
        check_shards(sharding.shard_report(docs, shards).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()], shards)
    out = sharding.sharded(odd, 4)
    assert out.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"] and out.count() == odd.count()
    assert sharding.shard_report(none).collect() == [] and sharding.sharded(none).collect() == []


# --- 8

def mix_by_hand(docs):
    size = lambda t: len(WORD.findall(t or ""))
    total = Counter()
    for _, s, t in docs:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    goal, capped = {}, set()
    while True:
        free = [s for s in order if s not in capped]
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 3 * total[s] for s in capped}
        over = {s for s in free if goal[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    hashed = {}
    for d, s, t in docs:
        h = int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)
        hashed.setdefault(s, Counter())[h] += size(t)
        out.append((d, s, t, h))
    extra = {}
    for s, c in hashed.items():
        q = math.floor(goal[s] / total[s]) if total[s] else 0
        rest, seen = goal[s] - q * total[s], 0
        for h in sorted(c):
            take = seen + c[h] <= rest or (seen <= rest and seen + c[h] - rest < rest - seen)
            extra[s, h] = q + take
            seen += c[h]
    return [(d, size(t), total[s], goal[s], size(t) * extra[s, h]) for d, s, t, h in out]


def test_mixing(spark, odd, none, monkeypatch):
    monkeypatch.setattr(mixing, "LEVEL_BITS", 3)  # many levels on few rows
    for docs in (odd, table(spark, SF, "documents")):
        rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
        got, want = mixing.mix_report(docs).collect(), mix_by_hand(rows)
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert tuple(a[:3]) + (a[4],) == b[:3] + (b[4],) and a[3] == pytest.approx(b[3])
        taken = sum(r.taken for r in got)
        assert mixing.mixed(docs).select(F.sum(word_count(F.col("text")))).first()[0] == taken
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix_report(none).collect() == [] and mixing.mixed(none).collect() == []


# --- 6

def measured(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i:i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (15, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for docs in (odd, table(spark, SF, "documents")):
        got = quality.quality_report(docs, labels).collect()
        same([(r.doc_id, *r[1:6]) for r in got], [(d, *measured(t)) for d, t in docs.select("doc_id", "text").collect()])
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.quality_report(none, labels).collect() == []
    assert quality.quality_kept(odd, labels.limit(0)).columns == odd.columns


def test_binomial_tail(spark):
    cases = [(n, k, a) for n in (1, 7, 300, 5000) for k in (0, 1, 5, 40) for a in (0.01, 0.05) if k <= n]
    for n, k, a in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(n), F.lit(k), a)).first()[0]
        want = math.fsum(math.comb(n, i) * a**i * (1 - a)**(n - i) if n < 1000 else
                         math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(a) + (n - i) * math.log1p(-a)) for i in range(k + 1))
        assert got == pytest.approx(want if k <= n * a else 1.0, rel=1e-9)


def test_certified_cutoffs(spark):
    """A rule that parts good from bad is certified; one that would cost good documents is not."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(3000):
        good = i % 4 > 0
        text = " ".join(("w%d" % rng.randint(0, 10**6)) + ("" if good else "###") for _ in range(30)) + ("\nsame line\nsame line" if rng.random() < 0.1 else "")
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_report(docs, labels).collect()
    assert all(("symbols" in r.rejected_by) == (r.doc_id % 4 == 0) for r in got)
    lost = [r for r in got if r.doc_id % 4 and not r.kept]
    assert len(lost) <= quality.ALPHA * 2250
    few = quality.quality_report(docs.limit(100), labels).collect()  # too few labels to certify anything
    assert all(r.kept for r in few)


# --- 4

def leaks_by_hand(docs, items):
    out = set()
    split = lambda rows: [(i, decontamination.plain_words((t or "").encode())) for i, t in rows]
    known = [(k, d, a, set(a)) for k, (d, a) in enumerate(split(docs))]
    for (k, d, a, held), (i, b) in itertools.product(known, split(set(items))):
        size = min(len(b), 13)
        if len(b) < 5:
            continue
        allowed = 2 if len(b) >= 13 else 0
        if sum(x in held for x in b) < size - allowed:
            continue
        if any(sum(x != y for x, y in zip(a[p:p + size], b[q:q + size])) <= allowed for p in range(len(a) - size + 1) for q in range(len(b) - size + 1)):
            out.add((k, d, i))
    return Counter((d, i) for _, d, i in out)


def test_masks_find_all_pairs_of_replacements():
    spaced = [[j for j, c in enumerate(m) if c == "1"] for m in decontamination.MASKS[:2]]
    for gone in itertools.combinations(range(13), 2):
        assert any(all(p + j not in gone for j in m) for m in spaced for p in range(13 - m[-1]))


def test_decontamination(spark, odd, none):
    rng = random.Random(8)
    vocab = ["v%d" % k for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([3, 5, 9, 12, 13, 14, 30, 45, 45])] + [(90, None), (91, ""), (7, "other text of the same item id with many words in it so that it counts")]
    items.append(items[6])
    docs = []
    for k in range(300):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        item = rng.choice(items)[1] or ""
        part = item.split()
        if k % 2 and len(part) > 4:
            lo = rng.randint(0, max(0, len(part) - 13))
            part = part[lo:lo + rng.randint(5, 30)]
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = rng.choice(vocab)
            p = rng.randint(0, len(words))
            words[p:p] = [w.upper() + rng.choice(["", ",", "."]) for w in part]
        docs.append((k, " ".join(words)))
    docs += [(None, items[6][1]), (5, None), (5, ""), (17, items[8][1]), (17, items[8][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for words in (decontamination.BLOCK_WORDS, 40):  # one block, and many
        got = decontamination.leak_report(d, b, words).collect()
        assert Counter((r.doc_id, r.item_id) for r in got) == leaks_by_hand(docs, items)
    leaking = {doc for doc, _ in leaks_by_hand(docs, items)}
    kept = decontamination.without_leaks(d, b).collect()
    assert len(kept) == len([x for x in docs if not leaks_by_hand([x], items)]) and not {r.doc_id for r in kept} & (leaking - {None, 5, 17})
    assert decontamination.leak_report(none, b).collect() == [] == decontamination.leak_report(d, b.limit(0)).collect()
    assert decontamination.without_leaks(odd, b).schema == odd.schema and decontamination.without_leaks(odd, b.limit(0)).count() == odd.count()


# --- 9

def fingerprint_by_hand(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(words)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints):
    """Prints: (id, fingerprint); least id of the component of each."""
    top = {i: i for i in range(len(prints))}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
            top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), math.inf), math.inf if d is None else d)
    return [None if least[find(i)] == math.inf else least[find(i)] for i in range(len(prints))]


def test_simhash(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    prints = [(d, fingerprint_by_hand(t)) for d, t in rows]
    want = [(d, format(f, "016x"), c) for (d, f), c in zip(prints, components_by_hand(prints))]
    same(simhash.near_duplicates(odd).collect(), want)
    assert simhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("crowd", [2, 4, 64])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            f = base
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            prints.add(f)
    rows = list(enumerate(sorted(prints)))
    signed = [(i, f - (1 << 64) * (f >> 63)) for i, f in rows]
    got = {r.fp: r.component_id for r in simhash.components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    assert [got[f] for _, f in signed] == components_by_hand(rows)


def near_by_hand(texts):
    """Component number of each text by all pairs."""
    held, top = [], list(range(len(texts)))
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        held.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j]):
            low, high = sorted((top[i], top[j]))
            top = [low if x == high else x for x in top]
    return top


def test_near_texts(spark, odd, none):
    """Against all pairs: each component keeps its first row; chains, word changes and small bands included."""
    rng = random.Random(3)
    say = lambda n: ["w%d" % rng.randrange(3000) for _ in range(n)]
    texts = []
    for _ in range(25):
        words = say(rng.randint(60, 300))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):  # a walk: neighbours are near, ends need not be
            words = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 50))):
                words[rng.randrange(len(words))] = "new%d" % rng.randrange(10**6)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    top = near_by_hand(texts)
    assert 25 <= len(set(top)) < len(texts)
    same(near_texts.one_of_each(made).collect(), [(i, texts[i]) for i in sorted(set(top))])
    one = near_texts.one_of_each(odd)
    assert one.columns == odd.columns and one.count() == len(set(near_by_hand([r.text for r in odd.collect()])))
    assert near_texts.one_of_each(none).collect() == []


def test_near_texts_without_id_or_of_one_id_stay(spark):
    """The survivor is chosen by component: different texts stay whatever their ids, near copies do not."""
    rng = random.Random(9)
    say = lambda: " ".join("w%d" % rng.randrange(3000) for _ in range(80))
    a, b, c, d = say(), say(), say(), say()
    rows = [(None, a), (None, a + " tail"), (None, b), (None, b), (0, c + " tail"), (1, d), (1, c), (1, say()), (1, d)]
    got = Counter(tuple(r) for r in near_texts.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    first = min(a, a + " tail", key=lambda t: hashlib.md5(t.encode()).digest())
    assert got == Counter([(None, first), (None, b), (0, c + " tail"), (1, d), (1, rows[7][1])])


def test_a_shared_passage_makes_no_pairs(spark, monkeypatch):
    """Different texts with one long passage in common meet in bands, but give few pairs, whatever their number."""
    counted = []
    plain = near_texts._by_rare_shingles
    monkeypatch.setattr(near_texts, "_by_rare_shingles", lambda *a, **k: counted.append(plain(*a, **k).count()) or plain(*a, **k))
    for n in (200, 400):
        rng = random.Random(n)
        say = lambda k: " ".join("w%d" % rng.randrange(10**6) for _ in range(k))
        passage = say(100)
        rows = [(i, say(15) + " " + passage + " " + say(15)) for i in range(n)] + [(n, passage + " end"), (n + 1, "so " + passage)]
        assert near_texts.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).count() == n + 1
    assert len(counted) == 4 and max(counted) <= 10


@pytest.mark.parametrize("seed", [1, 2])
def test_rare_shingles_find_all_near_texts(spark, monkeypatch, seed):
    """Without the first two steps: texts around the border of 0.8, of many sizes, with passages in common."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(500)
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 12, 40, 150]))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words + [word() for _ in range(rng.randint(0, 1 + len(base) // 8))]))
    texts = sorted(set(texts))
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    rest = frame.select("node", (F.col("node") - F.col("node") % 2).alias("label"))
    prefixes = near_texts._prefixes(rest, frame)
    got = {tuple(r) for r in near_texts._by_rare_shingles(prefixes, rest).collect()}
    assert {tuple(r) for r in near_texts._by_rare_shingles(prefixes, rest, heads=True).collect()} <= got
    held = [near_texts.shingles(t.encode()) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if i // 2 != j // 2 and near_texts.near(held[i], held[j])}
    assert len(want) > 50 and want <= got and all(i // 2 != j // 2 for i, j in got)


def test_near_texts_take_maps(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", {"k": 1}), (2, "a b c d e f", None), (3, "x y z", {})], "doc_id long, text string, m map<string,int>")
    assert sorted((r.doc_id, r.m) for r in near_texts.one_of_each(rows).collect()) == [(1, {"k": 1}), (3, {})]


# --- 2

def substrings_by_hand(rows):
    """Per distinct row; rows of one id are not earlier than one another."""
    out, occurs = [], {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            occurs[key] = min(occurs.get(key, math.inf), math.inf if d is None else d)
    for d, w in split:
        gone, seen = set(), set()
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            if occurs[key] < (math.inf if d is None else d) or key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def test_substrings(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    same(substrings.substring_report(odd).collect(), substrings_by_hand(rows))
    assert substrings.substring_report(none).collect() == []
    rng = random.Random(2)
    vocab = ["w%d" % k for k in range(50)]
    parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(rng.randint(0, 60), " ".join(rng.choice(parts) if rng.random() < 0.6 else rng.choice(vocab) for _ in range(rng.randint(1, 9)))) for _ in range(90)]
    same(substrings.substring_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), substrings_by_hand(rows))


# --- 3

def test_token_counts(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    want = [(d, len(token_counts.token_ids(t))) for d, t in rows]
    for block in (token_counts.BLOCK, 7, 1):
        same(token_counts.token_counts(odd, block=block).collect(), want)
    assert token_counts.token_counts(none).collect() == []
    blocks = [(1, 0, [5, 6]), (1, 1, [7]), (1, 2, [9, 8, 9]), (1, 3, [9, 1]), (2, 0, [9]), (3, 0, [4, 4]), (3, 1, [])]
    raw = spark.createDataFrame([(s, k, bytearray(np.array(x, "<u2").tobytes())) for s, k, x in blocks], "stream int, at long, ids binary")
    same(token_counts.scan(raw, end=9).collect(), [(1, 0, 3), (1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 0, 0), (3, 0, 2)])


# --- 5

def test_site_lines(spark):
    page = lambda nav, body: f"<html><title>t</title><body><p>{nav}</p><script>x<y</script><div>{body} &amp;  more</div></body></html>"
    rows = [(i, f"http://a.example.com/{i}", page("menu", f"text {i}")) for i in range(10)] + [(i, f"https://u@B.example.com:80/{i}", page("menu" if i < 12 else "x", "same")) for i in range(10, 15)]
    rows += [(20, None, page("menu", "q")), (21, "no host", page("menu", "q")), (None, "http://a.example.com/z", None), (22, "http://a.example.com/y", ""), rows[0], rows[0]]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = site_lines.site_lines(pages)
    db = duckdb.connect()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").toPandas()
    db.register("pages", frame)
    rel = db.execute("SELECT page_id, host, n_lines, n_dropped, text FROM (" + site_lines.ORACLE + ")")
    same([(None if r[0] is None else int(r[0]), *r[1:]) for r in got.collect()], [(None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in rel.fetchall()])
    by = {r.page_id: r for r in got.collect()}
    assert by[1].text == "text 1 & more" and by[1].host == "a.example.com" and by[20].n_dropped == 0 and by[11].text == "menu"
    assert site_lines.site_lines(pages.limit(0)).collect() == []


def test_site_lines_by_salts(spark, monkeypatch):
    """Joined with salts by the number of pages, or broadcast: the same rows."""
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 20), F.lit("/")).alias("url"),
                                    F.concat(F.lit("menu<br>text "), F.col("id"), F.lit("<p>a"), F.col("id") % 3).alias("html"))
    rows = sorted(map(tuple, site_lines.site_lines(pages).collect()))
    monkeypatch.setattr(site_lines, "FILTER_ROWS", 0)
    monkeypatch.setattr(site_lines, "SALT_PAGES", 7)
    assert sorted(map(tuple, site_lines.site_lines(pages).collect())) == rows and sum(r[3] for r in rows) > 300


# --- 7

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_hand(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(1)
    for _ in range(4000):
        s = "".join(rng.choice(["a", "1", "23", "@", ".", "-", "+", " ", "(", ")", "b.c", "4111111111111111", "é", "\n"]) for _ in range(rng.randint(1, 14)))
        assert sorted(base_by_hand(s)) == sorted(pii.base_spans(s)), s
    assert pii.base_spans("a" * 10**6) == [] and pii.base_spans("1" * 10**6) == []


def test_field_decodes_the_best_segmentation():
    """Dynamic programming against all segmentations of short regions."""
    rng = random.Random(4)
    field = pii.Field()
    texts = ["1.2.3.4 5678", "+1 (609) 555-7932", "a (at) b.c 12345", "1234 5678 9012"]
    for t in texts:
        for f in pii.segments(t)[2]:
            for x in f:
                field.index.setdefault(x, len(field.index))
    field.weights = np.array([[rng.uniform(-1, 0.8) for _ in pii.KINDS] for _ in field.index])
    for t in texts:
        borders, spans, found = pii.segments(t)
        value = field.scores(found).max(axis=1)
        best = max(sum(value[k] for k in some) for n in range(4) for some in itertools.combinations(range(len(spans)), n)
                   if all(spans[a][1] <= spans[b][0] or spans[b][1] <= spans[a][0] for a, b in itertools.combinations(some, 2)))
        place = {(borders[i], borders[j]): value[k] for k, (i, j) in enumerate(spans)}
        assert sum(place[a, b] for _, a, b in field.best(t)) >= best - 1e-9


def test_pii(spark, none):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionAll(spark.createDataFrame([
        (9001, "write to bob (at) mail (dot) com or call (609) 555-7932"), (9002, "card 4111.1111.1111.1111 not 4111.1111.1111.1112"), (9003, None), (9003, ""), (None, "x@y.zz"),
        (9004, "ok x@y.zz 1.2.3.4, 4111 1111 1111 1111 +1 (609) 555-7932 " * 3)], "doc_id long, text string"))
    big = docs.unionAll(table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text"))
    field = pii.train(big)
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id != 9003}
    held = spark.sparkContext.broadcast(field)
    got = {d: pii.all_spans(t or "", held.value) for d, t in rows.items()}
    kinds = pii.KINDS
    for d, (base, every) in got.items():
        assert base == sorted(base_by_hand(rows[d] or ""), key=lambda s: (kinds.index(s[0]), s[1])) and set(base) <= set(every)
    spans = lambda d: [(k, rows[d][a:b]) for k, a, b in got[d][1]]
    assert spans(9001) == [("email", "bob (at) mail (dot) com"), ("phone", "(609) 555-7932")]
    assert spans(9002) == [("card", "4111.1111.1111.1111")]
    report = pii.pii_report(docs).collect()
    assert len(report) == docs.count()
    r = next(r for r in report if r.doc_id == 9004)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (3, 3, 3, 3)
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in got[9004][0]).encode()).hexdigest()
    assert all(x.spans == "" and x.base_sha256 == hashlib.sha256(b"").hexdigest() for x in report if x.doc_id == 9003)
    assert pii.pii_report(none).collect() == []


def test_added_spans_between_base_spans(spark):
    """What lies between two base spans is scored as if it stood alone."""
    field = pii.train(table(spark, "/root/testdata/sf0.1", "documents"))
    for inside in ("(609) 555-7932", "4111.1111.1111.1111"):
        text = f"a@b.com {inside} c@d.com"
        assert any(text[x + a:x + b] == inside for x, y in pii.regions(text) for _, a, b in field.best(text[x:y])), inside
        base, every = pii.all_spans(text, field)
        assert [text[a:b] for _, a, b in base] == ["a@b.com", "c@d.com"]
        assert [text[a:b] for k, a, b in every if (k, a, b) not in base] == [inside]
    text = "a@b.com c@d.com - +1 (609) 555-7932 1.2.3.4"
    assert pii._TRIGGER.search(pii._outside(text, 0, len(text), sorted((a, b) for _, a, b in pii.base_spans(text)))) is None


def test_held_out_disguises_are_found(spark):
    """Disguised spans of documents that training has not seen; plain numbers beside them stay."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    field = pii.train(docs.filter("doc_id % 5 <> 0"))
    rng, found, total, false = random.Random(11), 0, 0, 0
    for text in (r.text for r in docs.filter("doc_id % 5 = 0").select("text").collect()):
        for kind, a, b in pii.base_spans(text):
            made = pii._disguised(kind, text[a:b], rng)
            new = "so " + made + " then"
            total += 1
            found += any(k == kind and abs(x - 3) <= 2 and abs(y - 3 - len(made)) <= 2 for x0, y0 in pii.regions(new) for k, x, y in
                         [(k, x0 + x, x0 + y) for k, x, y in field.best(new[x0:y0])])
        base, every = pii.all_spans(text, field)
        false += len(every) - len(base)
    assert total > 80 and found >= 0.85 * total and false <= 0.05 * total


def test_dates_ranges_and_scores_are_no_entities(spark):
    """Recall and precision by kind on held-out spans, disguised and set between numbers that are none."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    field = pii.train(docs.filter("doc_id % 5 <> 0"))
    added = lambda t: [(k, t[a:b]) for k, a, b in pii.all_spans(t, field)[1]]
    for t in ("logged 2023-11-04 08:15:22", "range 1-5, 2-6, 3-7, 4-8", "scores 3-2, 4-1", "won 4-2-3-1", "on 04.11.2023, 08:15-09:30", "ISBN 978-3-16-148410-0"):
        assert added(t) == [], t
    long = "x" * 100 + " (at) mail (dot) com"
    assert added(long) == [("email", long)] and added("y" * 10**5 + "(at)b(dot)org") == [("email", "y" * 10**5 + "(at)b(dot)org")]
    rng, found, total, false = random.Random(11), Counter(), Counter(), 0
    for text in (r.text for r in docs.filter("doc_id % 5 = 0").select("text").collect()):
        for kind, a, b in pii.base_spans(text):
            made = pii._disguised(kind, text[a:b], rng)
            new = f"seen {pii.noise(rng)} so "
            start, new = len(new), new + made + f" then {pii.noise(rng)} end"
            spans = pii.all_spans(new, field)[1]
            total[kind] += 1
            found[kind] += any(k == kind and abs(x - start) <= 2 and abs(y - start - len(made)) <= 2 for k, x, y in spans)
            false += sum(y <= start or x >= start + len(made) for _, x, y in spans)
    assert set(total) == set(pii.KINDS) and all(found[k] >= 0.9 * total[k] for k in total) and false <= 0.02 * sum(total.values())


# --- 10

def test_lattice_forward_against_all_segmentations():
    pieces = [(b" ", 2.0), (b"a", 3.0), (b"b", 1.0), (b"ab", 2.0), (b" a", 1.5), (b"ba", 0.5), (b"aba", 0.7)]
    lat = lattice.Lattice(pieces)
    p = {x: math.exp(lat.logp[k]) for x, k in lat.ids.items()}
    assert sum(p.values()) + math.exp(lat.logp[0]) == pytest.approx(1)

    def total(w):
        return 1.0 if not w else sum(p[w[:n]] * total(w[n:]) for n in range(1, min(3, len(w)) + 1) if w[:n] in p)
    words = [bytes(w) for n in range(0, 7) for w in itertools.product(b"ab", repeat=n)]
    for some in (words * 70, words):  # by length groups, and one by one
        logs, _ = lat.words(some)
        assert all(math.exp(x) == pytest.approx(total(b" " + w)) for w, x in zip(some, logs))
    _, many = lat.words(words * 70, np.ones(len(words) * 70))
    _, one = lat.words(words, np.full(len(words), 70.0))
    assert np.allclose(many, one)


def test_lattice_scores(spark, odd, none):
    for docs in (odd, table(spark, SF, "documents")):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = lattice.lattice_scores(docs).collect()
        split = [(d, (t or "").encode().translate(lattice._LOWER).split() + [None]) for d, t in rows]
        out = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
        c = Counter(w for (d, ws), o in zip(split, out) if not o for w in ws)
        n, v = sum(c.values()), len(c)
        want = [(d, o, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for (d, ws), o in zip(split, out)]
        same([(*r[:5], round(r.base_score, 4)) for r in got], want)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice.lattice_scores(none).collect() == []


def test_lattice_score_against_a_recursion_by_hand(spark, odd, monkeypatch):
    """The column ``score`` of several batches and partitions, from the fitted weights, word by word."""
    made, load = [], lattice.load_lattice
    monkeypatch.setattr(lattice, "load_lattice", lambda model=lattice.MODEL: made.append(load(model)) or made[-1])
    monkeypatch.setattr(lattice, "BATCH_WORDS", 60)
    docs = odd.unionByName(table(spark, SF, "documents").limit(25), allowMissingColumns=True).repartition(4)
    got = [(r.doc_id, r.n_tokens, r.score) for r in lattice.lattice_scores(docs).collect()]
    ids, logp, longest = made[0].ids, made[0].logp, max(map(len, made[0].ids))
    known = {}

    def by_hand(word):
        if word not in known:
            w, up = b" " + word, [0.0]
            for j in range(1, len(w) + 1):
                up.append(np.logaddexp.reduce([up[i] + logp[ids[w[i:j]]] for i in range(max(0, j - longest), j) if w[i:j] in ids] or [-np.inf]))
            known[word] = up[-1]
        return known[word]
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        words = (t or "").encode().translate(lattice._LOWER).split()
        want.append((d, len(words) + 1, (sum(map(by_hand, words)) + logp[lattice._END]) / math.log(10)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-9, abs=1e-6)


def test_training_helps_held_out_texts(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    fitted = lattice.lattice_scores(docs).filter("held_out").agg(F.sum("score")).first()[0]
    monkeypatch.setattr(lattice, "PRIOR", 1e15)  # the vocabulary's own weights
    assert fitted > lattice.lattice_scores(docs).filter("held_out").agg(F.sum("score")).first()[0]


# --- queries and pipeline

def test_registered_queries_match_their_sql(spark):
    import check
    assert {re.match(r"op(\d+)_", q)[1] for q in queries.QUERIES} == {str(k) for k in range(1, 14)}
    for name in queries.ORACLE:
        ok, note = check.compare(spark, check.connect(SF), SF, name)
        assert ok, (name, note)


def test_pipeline(spark):
    import corpus_pipeline
    docs = table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    labels, items = table(spark, SF, "labels"), [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        after = stage(spark, docs, SF)
        rows = after.collect()
        if name == "quality rules":
            verdict = quality.quality_report(docs, labels)
            assert {r.doc_id for r in rows} == {r.doc_id for r in verdict.filter("kept").collect()} and 0 < len(rows) < n
        elif name == "simhash near-dedup":
            before.sort()  # ids are distinct here, and each component keeps its least one
            assert sorted(r.doc_id for r in rows) == [before[i][0] for i in sorted(set(near_by_hand([t for _, t, _ in before])))]
        elif name == "benchmark decontamination":
            assert {r.doc_id for r in rows} == {d for d, *_ in before} - {d for d, _ in leaks_by_hand([(d, t) for d, t, _ in before], items)}
        elif name == "source mixing":
            want = Counter({d: taken // size for d, size, _, _, taken in mix_by_hand([(d, s, t) for d, t, s in before]) if size})
            assert Counter(r.doc_id for r in rows) == +want
        else:
            assert after.columns == [*columns, "shard", "slot"] and len(rows) == len(before)
        if name != "sharding":
            assert after.columns == columns
        docs = spark.createDataFrame(rows, after.schema).repartition(3)


def test_pipeline_takes_odd_and_empty_tables(spark, tmp_path, odd, none):
    import corpus_pipeline
    labels, items = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    for k, (docs, rest) in enumerate([(odd, 1000), (none, 1000), (odd, 0)]):
        d = str(tmp_path / str(k))
        docs.drop("shard").write.parquet(f"{d}/documents.parquet")
        labels.limit(rest).write.parquet(f"{d}/labels.parquet")
        items.limit(rest).write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"] and (out.count() > 0) == (k != 1)
