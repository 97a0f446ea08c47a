"""Conversation structure repair by dynamic programming over a shared grammar.

Every turn becomes a symbol: the initial of its role (user, assistant, system, other) and its fault. The least edits
that make the roles read ``(s?(ua)+)?`` are a shortest path through four states (nothing, system, user, assistant
last), so a run of turns is a min-plus matrix of four by four: least cost and, of equal costs, the ASCII-least audit.
Audits of one run from one state differ before either ends, as each spells one letter per turn that is no insertion
and ends in such a letter. So the least audit of a product is the concatenation of least audits, and where audits of a
run differ, what follows cannot turn the order round.

Re-Pair finds the grammar: in rounds, the pairs of neighbouring symbols that are most frequent over all
conversations, no two of a round sharing a symbol, become rules. Each rule has one matrix, the product of its two, whose
audits are ropes that point into those of its parts. Rules are worked out bottom-up once and serve all conversations. The number of
rules is bounded (``ROUNDS``, ``PER_ROUND``), which bounds what is shipped; results do not depend on it.

Turns are range-sorted by conversation and turn, and cut into segments of bounded length. A conversation inside one
segment is worked out where it lies. Of the others, each segment gives its costs and the rank of its audits, 32 small
numbers; from those the states at the borders follow, backwards by cost and forwards by rank, and then each segment
writes its own audit and turns. SHA-256 has to read a conversation from front to back, so the repaired pieces
of one conversation stream through one task, in order; its audit is one value and ends there too.

Turns are taken by number (nulls first), then by role and text. Null roles and texts count as one blank. A role that
begins with none of ``u``, ``a``, ``s``, or is empty, can be reroled or deleted, not kept. Rows of null ``conv_id`` are one
conversation. Repeated rows are duplicates of the first. Other columns are not read. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, ship_package
from .common import SPACE

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT is added for a truncated turn that stays
ROUNDS, PER_ROUND = 8, 8
SEGMENT, SEGMENT_BYTES = 4096, 4 << 20  # turns, and bytes of text after which a segment ends
HELD = 100_000  # sequences whose result a task remembers
STATES = range(4)  # nothing yet, after system, after user, after assistant
_ACCEPT = (0, 3)
_LEGAL = {"su", "ua", "au"}
_ROLE = {2: "user", 3: "assistant"}  # of an inserted or reroled turn, by the state it leads to

Entry = tuple  # cost and rope; a rope is a string or a pair of ropes
Matrix = list


def flat(rope) -> str:
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += (x[1], x[0])
    return "".join(out)


def _better(x: Entry, y: Entry | None) -> bool:
    return y is None or x[0] < y[0] or (x[0] == y[0] and flat(x[1]) < flat(y[1]))


def after(row: list, m: Matrix) -> list:
    """One row of a min-plus product."""
    out = [None] * 4
    for k, x in enumerate(row):
        if x is not None:
            for j, y in enumerate(m[k]):
                if y is not None:
                    z = (x[0] + y[0], (x[1], y[1]))
                    if _better(z, out[j]):
                        out[j] = z
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return [after(row, b) for row in a]


def _next(state: int, role: str) -> int | None:
    if role == "u":
        return 2 if state != 2 else None
    if role == "a":
        return 3 if state == 2 else None
    return 1 if role == "s" and state == 0 else None


def _insertions() -> Matrix:
    """Any number of insertions, none included."""
    m = [[(0, "") if i == j else None for j in STATES] for i in STATES]
    for _ in range(2):  # a third one never leads to a new state
        for row in m:
            for i in STATES:
                j = 3 if i == 2 else 2
                if row[i] is not None:
                    z = (row[i][0] + INSERT, row[i][1] + "I")
                    if _better(z, row[j]):
                        row[j] = z
    return m


def _turn(symbol: str) -> Matrix:
    """Edits of one turn. Small letters stand for whole turns, capitals for truncated ones, b and d for blank ones and duplicates."""
    m: Matrix = [[None] * 4 for _ in STATES]
    for i in STATES:
        m[i][i] = (DELETE, "D")
        if symbol not in "bd":
            more = CUT if symbol.isupper() else 0
            for j, z in ((_next(i, symbol.lower()), (KEEP + more, "K")), (3 if i == 2 else 2, (REROLE + more, "R"))):
                if j is not None and _better(z, m[i][j]):
                    m[i][j] = z
    return m


BEFORE = _insertions()
END = [min((BEFORE[i][a] for a in _ACCEPT if BEFORE[i][a] is not None), key=lambda z: z) for i in STATES]
TERMINALS = {s: times(BEFORE, _turn(s)) for s in "uasoUASObd"}


class Grammar:
    """Rules, each a pair of symbols, and the matrix of every symbol."""

    def __init__(self):
        self.rules: list[tuple[str, str]] = []
        self.matrices: dict[str, Matrix] = dict(TERMINALS)

    def add(self, pair: str) -> None:
        symbol = chr(0x4E00 + len(self.rules))
        self.rules.append((pair, symbol))
        self.matrices[symbol] = times(self.matrices[pair[0]], self.matrices[pair[1]])

    def compress(self, symbols: str) -> str:
        for pair, symbol in self.rules:
            symbols = symbols.replace(pair, symbol)
        return symbols

    def rows(self, symbols: str, starts=STATES) -> list[list]:
        """The matrix of a sequence, for the states it may begin in."""
        short, out = self.compress(symbols), []
        for i in starts:
            row: list = [None] * 4
            row[i] = (0, "")
            for s in short:
                row = after(row, self.matrices[s])
            out.append([None if x is None else (x[0], flat(x[1])) for x in row])
        return out

    def best(self, symbols: str) -> tuple[int, str]:
        """Least cost of a whole conversation, and the least audit of that cost."""
        row = self.rows(symbols, (0,))[0]
        return min((x[0] + e[0], x[1] + e[1]) for x, e in zip(row, END) if x is not None)


def replay(audit: str, roles: list[str], texts: list[str], state: int = 0) -> list[tuple[str, str]]:
    """Roles and texts that the edits leave."""
    out, k = [], 0
    for edit in audit:
        if edit == "K":
            out.append((roles[k], texts[k]))
            state = _next(state, roles[k][:1])
        elif edit != "D":
            state = 3 if state == 2 else 2
            out.append((_ROLE[state], "" if edit == "I" else texts[k]))
        k += edit != "I"
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` with faults dealt by a checksum of conversation and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(lot == 1, F.lit("")).when(lot == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.when(lot == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"),
                       F.when(lot == 0, F.lit(0)).when(lot == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))


_SEGMENT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("symbols", pa.string()), ("blank", pa.int64()),
                      ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                      ("n_turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_SEGMENT_DDL = ("conv_id long, part long, whole boolean, symbols string, blank long, duplicate long, truncated long, illegal long, first string, last string, "
                "n_turns long, first_turn long, last_turn long, roles array<string>, texts array<string>")


class _Segment:
    def __init__(self, conv):
        self.conv, self.symbols, self.initials, self.roles, self.texts = conv, [], [], [], []
        self.turns, self.first_turn, self.last_turn, self.bytes = 0, None, None, 0

    def add(self, turn, role, text, symbol, initial):
        stays = symbol not in "bd"
        self.symbols.append(symbol)
        self.initials.append(initial)
        self.roles.append(role if stays else "")
        self.texts.append(text if stays else "")
        self.bytes += len(text) if stays else 0
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn

    def row(self, part, whole):
        c, i = Counter(self.symbols), self.initials
        return (self.conv, part, whole, "".join(self.symbols), c["b"], c["d"], sum(c[s] for s in "UASO"), sum(a + b not in _LEGAL for a, b in zip(i, i[1:])),
                i[0] if i else None, i[-1] if i else None, self.turns, self.first_turn, self.last_turn, self.roles, self.texts)


def _batches(rows, schema, size=2000, weight=lambda r: 1, limit=float("inf")):
    """Rows as record batches of bounded number and weight."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += weight(r)
        if len(held) >= size or total >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _segmented(batches):
    """Segments of rows that come sorted. Those at the ends of a partition may go on in the next one."""
    def rows():
        base, n, now, fresh, before = TaskContext.get().partitionId() << 33, 0, None, False, None
        for batch in batches:
            for conv, turn, role, text, copies, symbol, initial in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        yield now.row(base + n, fresh)
                        n += 1
                    now, fresh, before = _Segment(conv), now is not None, None
                for _ in range(copies):
                    key = (turn, role, text)
                    now.add(turn, role, text, "d" if key == before and symbol != "b" else symbol, initial)
                    before = key
                    if len(now.symbols) >= SEGMENT or now.bytes >= SEGMENT_BYTES:
                        yield now.row(base + n, False)
                        n += 1
                        now, fresh = _Segment(conv), False
        if now is not None:
            yield now.row(base + n, False)
    return _batches(rows(), _SEGMENT, weight=lambda r: sum(map(len, r[14])), limit=SEGMENT_BYTES)


def segments(rows: DataFrame) -> DataFrame:
    """Segments of ``conv_id, turn, role, text, copies``; a conversation of which all rows have no copies is an empty one."""
    ship_package(rows.sparkSession)
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    same = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.withColumn("_same", same)
    again = (rows.filter("copies > 0").groupBy("_same").agg(F.min(place).alias("_from"), F.max(place).alias("_to"))
             .filter("_from <> _to").select("_same", "_from"))  # equal turns under one number stand side by side
    again = materialize(again, "again")  # of known size, so that Spark need not shuffle the turns for a short list
    initial = F.when(F.substring("role", 1, 1).isin("u", "a", "s"), F.substring("role", 1, 1)).otherwise("o")
    symbol = (F.when(bare == "", "b").when(F.coalesce(place > F.col("_from"), F.lit(False)), "d")
              .when(F.right(bare, F.lit(1)).isin(".", "!", "?"), initial).otherwise(F.upper(initial)))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.join(again, "_same", "left").select("conv_id", "turn", "role", "text", "copies", symbol.alias("symbol"), initial.alias("initial"))
    dealt = marked.repartitionByRange(shares, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, F.asc("text"))
    return materialize(dealt.mapInArrow(_segmented, _SEGMENT_DDL), "segments")


def _pairs(grammar):
    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for symbols, n in zip(*(c.to_pylist() for c in batch.columns)):
                s, last = grammar.compress(symbols), -1
                for k in range(len(s) - 1):
                    if s[k] != s[k + 1] or last != k - 1 or s[k - 1] != s[k]:  # runs of one symbol hold every other pair
                        seen[s[k:k + 2]] += n
                        last = k
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pair", "n"])
    return count


def learned(parts: DataFrame) -> Grammar:
    """Re-Pair over the sequences of all segments."""
    distinct = materialize(parts.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "sequences")
    grammar = Grammar()
    for _ in range(ROUNDS):
        found = distinct.mapInArrow(_pairs(grammar), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        used: set[str] = set()
        for pair, _ in found.filter("n > 1").orderBy(F.desc("n"), "pair").limit(8 * PER_ROUND).collect():  # a bounded list
            if not used & set(pair) and len(used) < 2 * PER_ROUND:
                used |= set(pair)
                grammar.add(pair)
        if not used:
            break
    return grammar


_REPORT = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                     ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_REPORT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _gaps(first, last, turns) -> int:
    return 0 if first is None else (last - first + 1 - turns + 2**63) % 2**64 - 2**63  # wraps as a long does


def _whole(grammar):
    """Reports of conversations that lie in one segment."""
    def work(batches):
        known: dict = {}
        def rows():
            for batch in batches:
                for conv, symbols, blank, dup, cut, illegal, turns, a, b, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                    if symbols not in known:
                        if len(known) >= HELD:
                            known.clear()
                        known[symbols] = grammar.best(symbols)
                    cost, audit = known[symbols]
                    text = "\n".join(f"{r}:{t}" for r, t in replay(audit, roles, texts))
                    yield conv, _gaps(a, b, turns), blank, dup, cut, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()
        return _batches(rows(), _REPORT)
    return work


def _measured(grammar):
    """Costs and ranks of audits of each segment, row by row; -1 where no path leads."""
    def work(batches):
        for batch in batches:
            costs, ranks = [], []
            for symbols in batch.column(1).to_pylist():
                m = grammar.rows(symbols)
                costs.append([-1 if x is None else x[0] for row in m for x in row])
                order = [sorted(x[1] for x in row if x is not None) for row in m]
                ranks.append([-1 if x is None else o.index(x[1]) for row, o in zip(m, order) for x in row])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int64()))], names=["part", "costs", "ranks"])
    return work


def _joined(parts: list[dict]) -> tuple[dict, list[tuple]]:
    """What the segments of one conversation, in order, come to: its numbers, and per segment its states and the insertions after it."""
    togo = [[e[0] for e in END]]
    for p in reversed(parts):
        togo.append([min(p["costs"][4 * i + k] + togo[-1][k] for k in STATES if p["costs"][4 * i + k] >= 0) for i in STATES])
    togo.reverse()
    sums = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    state, path, last, turn, first, turns = 0, [], None, None, None, 0
    for t, p in enumerate(parts):
        go = [k for k in STATES if p["costs"][4 * state + k] >= 0 and p["costs"][4 * state + k] + togo[t + 1][k] == togo[t][state]]
        k = min(go, key=lambda k: p["ranks"][4 * state + k])
        path.append((p["part"], state, k, END[k][1] if t == len(parts) - 1 else ""))
        state = k
        if p["first"] is not None:
            sums["illegal"] += last is not None and last + p["first"] not in _LEGAL
            last = p["last"]
        if p["first_turn"] is not None:
            turns += p["n_turns"] - (p["first_turn"] == turn)
            turn, first = p["last_turn"], p["first_turn"] if first is None else first
    return sums | {"gaps": _gaps(first, turn, turns), "cost": togo[0][0]}, path


_PATH = pa.schema([("part", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("tail", pa.string()), *[(f.name, f.type) for f in _REPORT if f.name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]])
_PATH_DDL = "part long, start long, stop long, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _paths(batches):
    def rows():
        for batch in batches:
            for parts in batch.column(0).to_pylist():
                sums, path = _joined(parts)
                for step in path:
                    yield (*step, *[sums[f.name] for f in _PATH if f.name in sums])
    return _batches(rows(), _PATH)


_PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), *[(f.name, f.type) for f in _PATH][4:], ("audit", pa.string()), ("text", pa.string())])
_PIECE_DDL = "conv_id long, part long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, text string"


def _written(grammar):
    """Audit and repaired turns of each segment between its states, with the numbers of its conversation."""
    def work(batches):
        def rows():
            for batch in batches:
                for conv, part, symbols, roles, texts, start, stop, tail, *numbers in zip(*(c.to_pylist() for c in batch.columns)):
                    audit = grammar.rows(symbols, (start,))[0][stop][1] + tail
                    yield conv, part, *numbers, audit, "\n".join(f"{r}:{t}" for r, t in replay(audit, roles, texts, start))
        return _batches(rows(), _PIECE, weight=lambda r: len(r[-1]), limit=SEGMENT_BYTES)
    return work


def _hashed(batches):
    """Pieces of conversations that come in order, put together."""
    def rows():
        now, numbers, audits, digest, begun = None, None, [], None, False
        for batch in batches:
            for conv, part, *rest, audit, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or (conv,) != now:
                    if now is not None:
                        yield (*now, *numbers, "".join(audits), digest.hexdigest())
                    now, numbers, audits, digest, begun = (conv,), rest, [], hashlib.sha256(), False
                audits.append(audit)
                if text:
                    digest.update(("\n" + text if begun else text).encode())
                    begun = True
        if now is not None:
            yield (*now, *numbers, "".join(audits), digest.hexdigest())
    return _batches(rows(), _REPORT, weight=lambda r: len(r[7]), limit=SEGMENT_BYTES)


def repair_report(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repaired turns of each conversation.

    ``rows`` has ``conv_id, turn, role, text`` and ``copies``, how often each row stands (as ``damaged`` gives it).
    """
    parts = segments(rows)
    grammar = learned(parts)
    numbers = ["blank", "duplicate", "truncated", "illegal", "first", "last", "n_turns", "first_turn", "last_turn"]
    whole = parts.filter("whole").select("conv_id", "symbols", "blank", "duplicate", "truncated", "illegal", "n_turns", "first_turn", "last_turn", "roles", "texts")
    done = whole.mapInArrow(_whole(grammar), _REPORT_DDL)
    open_ = parts.filter("NOT whole")
    matrices = open_.select("part", "symbols").mapInArrow(_measured(grammar), "part long, costs array<long>, ranks array<long>")
    small = open_.select("conv_id", "part", *numbers).join(matrices, "part")
    listed = small.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "costs", "ranks", *numbers))).alias("parts"))  # some numbers per 4096 turns
    paths = listed.select("parts").mapInArrow(_paths, _PATH_DDL)
    steps = open_.select("conv_id", "part", "symbols", "roles", "texts").join(paths, "part")
    pieces = steps.select("conv_id", "part", "symbols", "roles", "texts", *[f.name for f in _PATH][1:]).mapInArrow(_written(grammar), _PIECE_DDL)
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(shares, "conv_id").sortWithinPartitions("conv_id", "part")
    return done.unionAll(pieces.mapInArrow(_hashed, _REPORT_DDL))
