"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary span a lattice over each word (with its word-start mark), and every
path through it is a segmentation. A piece has a probability; the probability of a word is the sum over
all its segmentations, by a forward recursion in log space. A text is its words and an end, each drawn
on its own. The scores of the vocabulary give the starting weights (its merge ranks, read as a power
law); expected piece counts over the training words, from one forward-backward pass, then re-estimate
them with the starting weights as prior. The vocabulary itself is not changed.

Texts meet the corpus through vocabularies. Documents are taken in batches of bounded size; a batch is
kept as its distinct words and, per document, their positions. Words are counted over all batches, scored
once each, and joined back to the batches, so what is shuffled are distinct words per batch, not tokens.
A frequent word has one row per batch, whatever its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_ROWS, BATCH_WORDS = 32_768, 4_000_000  # a batch of documents ends at either
PRIOR = 10_000.0  # tokens that the starting weights count for
_CHUNK = 200_000  # words scored at once
_ROWS = 65_536  # words handed on at once; of documents a sixteenth
_VECTOR = 48  # words of more bytes, or of a rare length, are scored one by one
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_B, _MIX = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_END = 0  # place of the end of text among the weights


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_B, k, 2**64))


def _piece_hash(piece: bytes) -> int:
    h = 0
    for c in piece:
        h = (h * _B + c + 1) % 2**64
    return h


class Lattice:
    """Pieces, their log probabilities and an exact hash table over them."""

    def __init__(self, pieces: list[tuple[bytes, float]]):
        """``pieces``: distinct byte strings and weights; the place 0 is the end of text."""
        self.ids = {p: k + 1 for k, (p, _) in enumerate(pieces)}
        self.start = np.array([1e-3, *(w for _, w in pieces)])
        self.start[1:] *= (1 - self.start[0]) / self.start[1:].sum()
        self.set_weights(self.start)
        self.lengths = sorted({len(p) for p in self.ids})
        self.keys = np.zeros(len(pieces) + 1, np.uint64)
        for p, k in self.ids.items():
            self.keys[k] = _piece_hash(p)
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        self.size = np.array([0, *(len(p) for p in self.ids)])
        # two tables: what finds its place taken in the first goes to the second
        self.first, self.second = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int32)
        for salt in range(1, 1000, 2):
            self.salt, late = np.uint64(_MIX * salt % 2**64), []
            self.first[:], self.second[:] = 0, 0
            for k, s in enumerate(self._slot(self.keys, 20).tolist()):
                if k and self.first[s]:
                    late.append(k)
                elif k:
                    self.first[s] = k
            spots = self._slot(self.keys[late] ^ np.uint64(_B), 16)
            if len(np.unique(spots)) == len(late):
                self.second[spots] = late
                break

    def _slot(self, h: np.ndarray, bits: int) -> np.ndarray:
        return ((h * self.salt) >> np.uint64(64 - bits)).astype(np.int64)

    def set_weights(self, counts: np.ndarray) -> None:
        self.logp = np.log(counts / counts.sum())

    def find(self, h: np.ndarray, length: int) -> np.ndarray:
        """Place of the piece with each hash; 0 where there is none."""
        k = self.first[self._slot(h, 20)]
        k = np.where(self.keys[k] == h, k, self.second[self._slot(h ^ np.uint64(_B), 16)])
        return np.where((self.keys[k] == h) & (self.size[k] == length), k, 0)

    def words(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word, and with ``counts`` the expected counts of the pieces."""
        out, expected = np.zeros(len(words)), np.zeros(len(self.keys))
        length = np.array([len(w) + 1 for w in words], np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            n = int(length[group[0]])
            if n <= _VECTOR and len(group) >= 64:
                raw = np.frombuffer(b"".join(b" " + words[k] for k in group), np.uint8).reshape(len(group), n)
                out[group] = self._many(raw, None if counts is None else counts[group], expected)
            else:
                for k in group:
                    out[k] = self._one(b" " + words[k], None if counts is None else counts[k], expected)
        return out, expected

    def _many(self, raw: np.ndarray, counts, expected) -> np.ndarray:
        n, size = raw.shape
        prefix = np.zeros((size + 1, n), np.uint64)
        for k in range(size):
            prefix[k + 1] = prefix[k] * np.uint64(_B) + raw[:, k].astype(np.uint64) + np.uint64(1)
        up, arcs = np.full((size + 1, n), -np.inf), []
        up[0] = 0
        for j in range(1, size + 1):
            for length in self.lengths:
                i = j - length
                if i < 0:
                    break
                k = self.find(prefix[j] - prefix[i] * _power(length), length)
                at = np.flatnonzero(k)
                if len(at):
                    k = k[at]
                    up[j, at] = np.logaddexp(up[j, at], up[i, at] + self.logp[k])
                    if counts is not None:
                        arcs.append((i, j, at, k))
        if counts is not None:
            down = np.full((size + 1, n), -np.inf)
            down[size] = 0
            for i, j, at, k in sorted(arcs, key=lambda a: -a[0]):
                down[i, at] = np.logaddexp(down[i, at], self.logp[k] + down[j, at])
            for i, j, at, k in arcs:
                share = np.exp(up[i, at] + self.logp[k] + down[j, at] - up[size, at]) * counts[at]
                expected += np.bincount(k, share, len(expected))
        return up[size]

    def _one(self, word: bytes, count, expected) -> float:
        n, ids, logp = len(word), self.ids, self.logp
        up, arcs = [0.0] + [-np.inf] * n, []
        for j in range(1, n + 1):
            terms = []
            for length in self.lengths:
                i = j - length
                if i < 0:
                    break
                k = ids.get(word[i:j])
                if k:
                    terms.append(up[i] + logp[k])
                    arcs.append((i, j, k))
            top = max(terms)
            up[j] = top + float(np.log(sum(np.exp(t - top) for t in terms)))
        if count is not None:
            down = [-np.inf] * n + [0.0]
            for i, j, k in sorted(arcs, key=lambda a: -a[0]):
                down[i] = float(np.logaddexp(down[i], logp[k] + down[j]))
            for i, j, k in arcs:
                expected[k] += np.exp(up[i] + logp[k] + down[j] - up[n]) * count
        return float(up[n])


def load_lattice(model: str = MODEL) -> Lattice:
    """Pieces of a sentencepiece file that can stand in a lower-cased word; each byte is a piece too.

    A merge vocabulary scores a piece by minus its rank; the weight is one over the rank plus 10. Bytes
    without a score weigh least.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    weights: dict[bytes, float] = {}
    n = sp.get_piece_size()
    for k in range(n):
        if sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or sp.is_byte(k):
            continue
        piece = sp.id_to_piece(k).encode()
        raw = piece.replace("▁".encode(), b" ")
        if b" " in raw[1:] or raw != raw.translate(_LOWER) or sp.get_score(k) < -1e8:
            continue
        weights[raw] = 1.0 / (10.0 - min(0.0, sp.get_score(k)))
    for c in range(256):
        weights.setdefault(bytes([c]), 1.0 / (10.0 + n))
    return Lattice(list(weights.items()))


_STORED = "kind int, batch long, place int, word binary, n_train long, doc_id long, held_out boolean, n_words long, at binary"
_STORED_ARROW = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("place", pa.int32()), ("word", pa.binary()), ("n_train", pa.int64()),
                           ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_words", pa.int64()), ("at", pa.binary())])


def _planes(at: np.ndarray) -> bytes:
    """Places by byte: first all lowest bytes, and so on, so that the empty high ones compress to nothing."""
    return at.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _places(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _batched(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: the distinct words of a batch; of kind 1: its documents as places among them."""
    number = TaskContext.get().partitionId() << 32
    vocab: dict[bytes, int] = {}
    held: list[tuple] = []
    seen = 0

    def flush():
        nonlocal vocab, held, seen, number
        words, counts = list(vocab), np.zeros(len(vocab), np.int64)
        vocab = {}
        for _, out, at in held:
            if not out:
                np.add.at(counts, at, 1)
        for k in range(0, len(words), _ROWS):
            some = words[k:k + _ROWS]
            n = len(some)
            yield row(n, kind=[0] * n, batch=[number] * n, place=np.arange(k, k + n), word=some, n_train=counts[k:k + n])
        for k in range(0, len(held), _ROWS // 16):
            some = held[k:k + _ROWS // 16]
            n = len(some)
            yield row(n, kind=[1] * n, batch=[number] * n, doc_id=[d[0] for d in some], held_out=[d[1] for d in some],
                      n_words=[len(d[2]) for d in some], at=[_planes(d[2]) for d in some])
        number, held, seen = number + 1, [], 0

    def row(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _STORED_ARROW], schema=_STORED_ARROW)

    for batch in rows:
        texts = batch.column(2).cast(pa.binary())
        for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            words = (text.as_py() or b"").translate(_LOWER).split()
            place = vocab.setdefault
            held.append((doc_id, out, np.array([place(w, len(vocab)) for w in words], "<u4")))
            seen += len(words)
            if seen >= BATCH_WORDS or len(held) >= BATCH_ROWS:
                yield from flush()
    if held:
        yield from flush()


def _chunks(batches, columns: int):
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _CHUNK:
            yield [pa.concat_arrays([b.column(k) for b in held]) for k in range(columns)]
            held, rows = [], 0
    if held:
        yield [pa.concat_arrays([b.column(k) for b in held]) for k in range(columns)]


def lattice_scores(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Both scores are log10 probabilities. Null and empty texts are the end alone. A null id is in training.
    Repeated rows are counted and scored each. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    stored = materialize(rows.mapInArrow(_batched, _STORED), "batches")
    vocab = stored.filter("kind = 0").select("batch", "place", "word", "n_train")
    texts = stored.filter("kind = 1").select("batch", "doc_id", "held_out", "n_words", "at")
    counted = materialize(vocab.groupBy("word").agg(F.sum("n_train").alias("c")), "words")
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = texts.filter("NOT held_out").count()
    total, kinds = n + ends, v + (ends > 0)

    lattice = load_lattice(model)
    first = spark.sparkContext.broadcast(lattice)  # as large as the vocabulary

    def expect(batches):
        whole = None
        for words, counts in _chunks(batches, 2):
            _, e = first.value.words(words.to_pylist(), counts.to_numpy(zero_copy_only=False).astype(float))
            whole = e if whole is None else whole + e
        if whole is not None:
            at = np.flatnonzero(whole)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(at, pa.int32()), "n": whole[at]})

    expected = counted.filter("c > 0").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).orderBy("piece").collect()
    weights = PRIOR * lattice.start  # one row per piece came back
    for piece, amount in expected:
        weights[piece] += amount
    weights[_END] += ends
    lattice.set_weights(weights)
    fitted = spark.sparkContext.broadcast(lattice)

    def score(batches):
        for words, counts in _chunks(batches, 2):
            logs, _ = fitted.value.words(words.to_pylist())
            yield pa.RecordBatch.from_arrays([words, counts, pa.array(logs, pa.float64())], names=["word", "c", "logp"])

    scored = counted.mapInArrow(score, "word binary, c long, logp double")
    known = vocab.select("batch", "place", "word").join(scored, "word").select(F.col("batch").alias("of"), "place", "c", "logp")
    end = float(lattice.logp[_END])
    log_total = float(np.log10(total + kinds + 1))

    def finish(key, docs_of, words_of):
        size = words_of.num_rows
        c, logp, place = np.zeros(size), np.zeros(size), words_of.column("place").to_numpy()
        c[place], logp[place] = words_of.column("c").to_numpy(), words_of.column("logp").to_numpy()
        base = np.log10(c + 1)
        out = []
        for doc_id, out_of, k, at in zip(*(docs_of.column(x).to_pylist() for x in ("doc_id", "held_out", "n_words", "at"))):
            at = _places(at)
            out.append((doc_id, out_of, k + 1, int((c[at] > 0).sum()) + (ends > 0), total,
                        float(base[at].sum() + np.log10(ends + 1) - (k + 1) * log_total), float((logp[at].sum() + end) / np.log(10))))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), result.types)] if out else [pa.array([], t) for t in result.types], schema=result)

    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return texts.groupBy("batch").cogroup(known.groupBy("of")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
