"""Conversation structure repair: cheapest edits by dynamic programming over a grammar.

Every row of a conversation is one of twelve symbols: its role (system, user, assistant, other) and
what may be done with it (sound, truncated, to be deleted). What a symbol does to the structure is a
min-plus transfer matrix over the four states of ``(s?(ua)+)?``: nothing yet, after system,
after user, after assistant. An entry holds the least cost, the least audit of that cost, and
where it leads through.

Re-Pair replaces the most frequent neighbours in all conversations by new symbols, round after
round. The matrix of such a rule is the product of its two, computed once, bottom-up, and shared
by all conversations. Audits are ropes: an entry refers to one entry of each part. Audits of
one matrix end with the letter of a row, so none is the beginning of another, and their order
in a product follows from the order in its parts: no text is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentarank.functions.arrays import let
from pentarank.llm.common import SPACES, cut, spread

STATES = 4
# The letters of edits and their costs; the extra cost of a truncated row that stays.
COSTS = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED_COST = 1
ROLES = "sua"
# State after a user or an assistant turn from each state; None where the grammar forbids it.
AFTER_USER = (2, 2, None, 2)
AFTER_ASSISTANT = (None, None, 3, None)
# Inserts it takes to end soundly from each state.
CLOSING = (0, 2, 1, 0)
NEXT_ROLE = ("user", "user", "assistant", "user")
AFTER_NEXT = (2, 2, 3, 2)

FIRST_SYMBOL = "a"
FIRST_RULE = 0x4E00
TURN_BITS = 8
SEGMENT_ROWS = 4096
# Rows up to which the table of crowded turns is sent to all executors; a row is under 100 bytes.
BROADCAST_ROWS = 200_000
ROUNDS = 6
PER_ROUND = 16
MEMO = 1 << 14
BLOB = 1 << 20


@dataclass
class Matrix:
    """``cost[i][j]``, the order of audits from state ``i``, and the state they lead through."""

    cost: list[list[float]]
    rank: list[list[int]]
    via: list[list[int]] | None = None
    parts: tuple[str, str] | None = None
    audits: list[list[str]] | None = None


def _ranks(keys: list) -> list[int]:
    order = {k: n for n, k in enumerate(sorted(k for k in keys if k is not None))}
    return [order.get(k, -1) for k in keys]


def _inserts(start: int, end: int) -> int | None:
    """Inserted turns that lead from one state to another, the fewest."""
    count, state = 0, start
    while state != end:
        state, count = AFTER_NEXT[state], count + 1
        if count > 2:
            return None
    return count


def terminal(role: int, fault: int) -> Matrix:
    """Matrix of one row: inserts, then the row kept, reroled or deleted. Fault 1 is truncated, 2 must go."""
    best: list[list[tuple[float, str] | None]] = [[None] * STATES for _ in range(STATES)]
    stay = TRUNCATED_COST if fault == 1 else 0
    kept = {0: (1, None, None, None), 1: AFTER_USER, 2: AFTER_ASSISTANT, 3: (None,) * 4}[role]
    for start in range(STATES):
        for mid in range(STATES):
            count = _inserts(start, mid)
            if count is None:
                continue
            steps = [("D", mid, COSTS["D"])]
            if fault != 2:
                steps += [("K", kept[mid], COSTS["K"] + stay)]
                steps += [("R", after[mid], COSTS["R"] + stay) for after in (AFTER_USER, AFTER_ASSISTANT)]
            for letter, end, cost in steps:
                if end is not None:
                    made = (cost + COSTS["I"] * count, "I" * count + letter)
                    best[start][end] = min(best[start][end] or made, made)
    return Matrix(
        [[b[0] if b else float("inf") for b in row] for row in best],
        [_ranks([b and b[1] for b in row]) for row in best],
        audits=[[b[1] if b else "" for b in row] for row in best],
    )


def product(left: Matrix, right: Matrix, names: tuple[str, str]) -> Matrix:
    cost, rank, via = [], [], []
    for i in range(STATES):
        through, costs = _step(left.cost[i], left.rank[i], right)
        cost.append(costs)
        via.append(through)
        rank.append(_ranks([None if k < 0 else (left.rank[i][k], right.rank[k][j]) for j, k in enumerate(through)]))
    return Matrix(cost, rank, via, names)


def _step(cost: list[float], rank: list[int], right: Matrix) -> tuple[list[int], list[float]]:
    """For each end state the state to go through: least cost, then least audit; -1 if none."""
    through, costs = [], []
    for j in range(STATES):
        options = [(cost[k] + right.cost[k][j], rank[k], k) for k in range(STATES) if rank[k] >= 0 and right.rank[k][j] >= 0]
        total, _, k = min(options, default=(float("inf"), 0, -1))
        through.append(k)
        costs.append(total)
    return through, costs


def symbol(role: int, fault: int) -> str:
    return chr(ord(FIRST_SYMBOL) + 3 * role + fault)


@dataclass
class Grammar:
    """Rules in the order in which they were found, and the matrix of every symbol."""

    rules: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self):
        self.matrices = {symbol(r, f): terminal(r, f) for r in range(len(ROLES) + 1) for f in range(3)}
        # Role of the first and of the last row below a symbol, and the illegal neighbours within.
        self.ends = {symbol(r, f): (r, r, 0) for r in range(len(ROLES) + 1) for f in range(3)}
        found, self.rules = self.rules, []
        self._ropes: dict[tuple[str, int, int], str] = {}
        for pair, name in found:
            self.add(pair, name)

    def add(self, pair: str, name: str) -> None:
        left, right = pair
        self.rules.append((pair, name))
        self.matrices[name] = product(self.matrices[left], self.matrices[right], (left, right))
        (first, a, m), (b, last, n) = self.ends[left], self.ends[right]
        self.ends[name] = (first, last, m + n + _illegal(a, b))

    def audit(self, name: str, start: int, end: int) -> str:
        """Text of a rope."""
        matrix = self.matrices[name]
        if matrix.audits is not None:
            return matrix.audits[start][end]
        key = (name, start, end)
        if key not in self._ropes:
            mid = matrix.via[start][end]
            self._ropes[key] = self.audit(matrix.parts[0], start, mid) + self.audit(matrix.parts[1], mid, end)
        return self._ropes[key]

    def solve(self, codes: tuple[str, ...]) -> tuple[int, int, list[str], list[int]]:
        """``(cost, illegal, audit of each segment, state before each segment)`` of a conversation."""
        cost, rank = [0.0] + [float("inf")] * 3, [0, -1, -1, -1]
        back: list[list[int]] = []
        illegal, last = 0, None
        for code in codes:
            for name in code:
                matrix = self.matrices[name]
                through, costs = _step(cost, rank, matrix)
                rank = _ranks([None if k < 0 else (rank[k], matrix.rank[k][j]) for j, k in enumerate(through)])
                cost = costs
                back.append(through)
                first, ends, within = self.ends[name]
                illegal += within + (0 if last is None else _illegal(last, first))
                last = ends
        total, _, state = min((cost[j] + COSTS["I"] * CLOSING[j], rank[j], j) for j in range(STATES) if rank[j] >= 0)
        audits, starts = ["I" * CLOSING[state]], []
        at = len(back)
        for code in reversed(codes):
            letters = []
            for name in reversed(code):
                at -= 1
                before = back[at][state]
                letters.append(self.audit(name, before, state))
                state = before
            audits.append("".join(reversed(letters)))
            starts.append(state)
        audits.reverse()
        if codes:
            audits[-2:] = ["".join(audits[-2:])]
        return int(total), illegal, audits if codes else [], starts[::-1]


def _illegal(a: int, b: int) -> int:
    """Whether two neighbouring roles are none of system-user, user-assistant, assistant-user."""
    return int((a, b) not in ((0, 1), (1, 2), (2, 1)))


# --- from rows to symbols ---------------------------------------------------


def plain_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text, digest)``; a NULL role or text is one space."""
    blank = F.lit(" ")
    told = rows.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"),
    )
    return told.withColumn("digest", F.sha2("text", 256))


def _segments(plain: DataFrame) -> DataFrame:
    """Adds ``seg``, whose order is that of the rows: 256 turns, or parts of them where rows crowd.

    Where a range of turns of one conversation holds more than 4096 rows, each turn, role and first
    digits of the digest make a segment, with as many digits as that number asks for.
    """
    block = F.shiftright("turn", TURN_BITS)
    counts = plain.groupBy("conv", block.alias("block")).count().filter(F.col("count") > SEGMENT_ROWS)
    hot = counts.select(
        F.struct("conv", "block").alias("here"), F.ceil(F.log(F.col("count") / SEGMENT_ROWS) / F.log(F.lit(16.0))).cast("int").alias("digits")
    )
    # At most one row for 4096 rows of the input, and mostly none: the texts move for them only if they are many.
    hot = cut(hot)
    crowded = hot.count()
    here = F.struct("conv", block.alias("block"))
    if not crowded:
        marked = plain.withColumns({"here": here, "digits": F.lit(None).cast("int")})
    else:
        marked = plain.withColumn("here", here).join(F.broadcast(hot) if crowded <= BROADCAST_ROWS else hot, "here", "left")
    wide = F.struct(F.shiftleft(block, TURN_BITS).alias("first"), F.lit("").alias("role"), F.lit("").alias("digest"))
    narrow = F.struct(
        F.col("turn").alias("first"), F.col("role"), F.substring("digest", F.lit(1), F.col("digits")).alias("digest")
    )
    return marked.withColumn("seg", F.when(F.col("digits").isNull(), wide).otherwise(narrow)).drop("here", "digits")


def _records(placed: DataFrame) -> DataFrame:
    """Equal rows of a turn as one record ``(conv, seg, turn, role, digest, n, fault, seen)``.

    ``seen`` tells that role and text came earlier in the conversation; the other ``n - 1``
    rows of a record are duplicates of its first.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(bare == "", "blank").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    slim = placed.select("conv", "seg", "turn", "role", "digest", fault.alias("fault"))
    same = slim.groupBy("conv", "seg", "turn", "role", "digest", "fault").agg(F.count("*").alias("n"))
    said = F.struct("conv", "role", "digest")
    firsts = same.groupBy(said.alias("said")).agg(F.min(F.struct("turn")).alias("first"))
    return same.withColumn("said", said).join(firsts, "said").withColumn("seen", F.struct("turn") > F.col("first")).drop("said", "first")


def _sequences(records: DataFrame) -> DataFrame:
    """``(conv, seg, seq, n)``: the symbols of a segment's rows in order."""
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.substring("role", 1, 1)).cast("int")
    place = F.when(role > 0, role - 1).otherwise(len(ROLES))
    gone = (F.col("fault") == "blank") | F.col("seen")
    state = F.when(gone, 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    marks = "".join(symbol(r, f) for r in range(len(ROLES) + 1) for f in range(3))

    def mark(fault: Column) -> Column:
        return F.substring(F.lit(marks), (place * 3 + fault + 1).cast("int"), F.lit(1))

    signs = F.concat(mark(state), F.repeat(mark(F.lit(2)), (F.col("n") - 1).cast("int")))
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "digest", signs.alias("signs"))))
    return records.groupBy("conv", "seg").agg(F.array_join(F.transform(listed, lambda r: r["signs"]), "").alias("seq"))


def _compressed(seq: Column, rules: list[tuple[str, str]]) -> Column:
    for pair, name in rules:
        seq = F.replace(seq, F.lit(pair), F.lit(name))
    return seq


def learn_grammar(sequences: DataFrame, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Grammar:
    """Re-Pair over all sequences, several pairs a round.

    Each round counts neighbours in all distinct sequences, as often as they occur, and
    turns the most frequent pairs that share no symbol into rules. The number of rules is bounded, and so
    is what a round sends to the driver; what is left of a sequence is gone through symbol by symbol.
    """
    grammar = Grammar()
    distinct = cut(sequences.groupBy("seq").agg(F.count("*").alias("times")))
    for _ in range(rounds):
        signs = F.split(_compressed(F.col("seq"), grammar.rules), "")
        pairs = let(signs, lambda s: F.transform(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, i: F.concat(a, F.get(s, i + 1))))
        counted = distinct.select(F.explode(pairs).alias("pair"), "times").filter(F.length("pair") == 2)
        top = counted.groupBy("pair").agg(F.sum("times").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(4 * per_round).collect()
        used: set[str] = set()
        for row in top:
            if len(used & set(row.pair)) == 0 and len(used) < 2 * per_round:
                used |= set(row.pair)
                grammar.add(row.pair, chr(FIRST_RULE + len(grammar.rules)))
        if not used:
            break
    return grammar


# --- results ------------------------------------------------------------------


def _solved(sequences: DataFrame, grammar: Grammar) -> DataFrame:
    """``(conv, cost, illegal, audit, parts)``; ``parts`` lists ``(seg, audit, state)`` by segment."""
    rules = list(grammar.rules)
    coded = sequences.select("conv", F.struct("seg", _compressed(F.col("seq"), rules).alias("code")).alias("part"))
    grouped = coded.groupBy("conv").agg(F.sort_array(F.collect_list("part")).alias("parts"))

    @F.pandas_udf("cost long, illegal long, audits array<string>, states array<int>")
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        mine, memo = Grammar(list(rules)), {}
        for codes in batches:
            out = []
            for code in map(tuple, codes):
                if code not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[code] = mine.solve(code)
                cost, illegal, audits, states = memo[code]
                out.append((cost, illegal, audits, states))
            yield pd.DataFrame(out, columns=["cost", "illegal", "audits", "states"])

    done = grouped.withColumn("found", solve(F.transform("parts", lambda p: p["code"])))
    zipped = F.transform("parts", lambda p, i: F.struct(p["seg"].alias("seg"), F.get("found.audits", i).alias("audit"), F.get("found.states", i).alias("state")))
    return done.select("conv", "found.cost", "found.illegal", F.array_join("found.audits", "").alias("audit"), zipped.alias("parts"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, int, str | None, str | None, str]]:
    """Turns of all segments of a sorted partition: ``(segment, single, edit place, role, text, edit)``.

    Each segment starts with its audit; the turn of a segment that has none left is ``None``.
    """
    audit, at, state, place, here, single = "", 0, 0, 0, None, False

    def inserted():
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            yield here, single, place, NEXT_ROLE[state], "", "I"
            at, state, place = at + 1, AFTER_NEXT[state], place + 1

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if here is not None:
                    yield from inserted()
                here, single = (row["conv"], row["seg"]), row["single"]
                audit, at, state, place = row["audit"], 0, row["state"], 0
                yield here, single, -1, None, None, ""
                continue
            yield from inserted()
            edit, role = audit[at], row["role"]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = NEXT_ROLE[state]
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield here, single, place, role, row["text"], edit
            place += 1
    if here is not None:
        yield from inserted()


def _dealt(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """Rows and the audit of their segment, side by side: a sorted stream of segments in every partition."""
    audits = solved.select("conv", F.explode("parts").alias("p"), (F.size("parts") == 1).alias("single"))
    none = F.lit(None)
    heads = audits.select(
        "conv", "p.seg", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"),
        none.cast("string").alias("digest"), none.cast("string").alias("text"), "p.audit", "p.state", "single",
    )
    lines = placed.select(
        "conv", "seg", F.lit(1).alias("kind"), "turn", "role", "digest", "text",
        none.cast("string").alias("audit"), none.cast("int").alias("state"), none.cast("boolean").alias("single"),
    )
    return spread(heads.unionByName(lines), "conv", "seg").sortWithinPartitions("conv", "seg", "kind", "turn", "role", "digest").drop("turn", "digest")


def _digest_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of conversations of one segment; texts of others, in parts, to be hashed in order."""
    rows: list[dict] = []
    here, alone, digest = None, False, hashlib.sha256()
    held: list[bytes] = []
    part, size, total = 0, 0, 0

    def close() -> None:
        if alone:
            rows.append({"conv": here[0], "seg": here[1], "part": 0, "blob": None, "sha": digest.hexdigest()})
        elif held:
            rows.append({"conv": here[0], "seg": here[1], "part": part, "blob": b"".join(held), "sha": None})

    for segment, single, place, role, text, _ in _edited(batches):
        if place < 0:
            close()
            here, alone, digest, held, part, size = segment, single, hashlib.sha256(), [], 0, 0
        else:
            line = f"{role}:{text}".encode()
            if alone:
                digest.update(line if place == 0 else b"\n" + line)
                continue
            held.append(b"\n" + line)
            size, total = size + len(line), total + len(line)
            if size >= BLOB:
                close()
                held, part, size = [], part + 1, 0
        if len(rows) >= 1024 or total >= 4 * BLOB:
            yield _batch(rows)
            rows, total = [], 0
    close()
    yield _batch(rows)


_SEGMENT = pa.struct([("first", pa.int64()), ("role", pa.string()), ("digest", pa.string())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"conv": pa.int64(), "seg": _SEGMENT, "part": pa.int32(), "blob": pa.binary(), "sha": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the parts of each conversation, in order."""
    here, digest, fresh, started = None, None, True, False
    for batch in batches:
        for conv, blob in zip(batch.column("conv").to_pylist(), batch.column("blob").to_pylist()):
            if not started or conv != here:
                if started:
                    yield pa.RecordBatch.from_pydict({"conv": pa.array([here], pa.int64()), "sha": [digest.hexdigest()]})
                here, digest, fresh, started = conv, hashlib.sha256(), True, True
            if blob is not None:
                digest.update(blob[1:] if fresh else blob)
                fresh = False
    if started:
        yield pa.RecordBatch.from_pydict({"conv": pa.array([here], pa.int64()), "sha": [digest.hexdigest()]})


def _digests(placed: DataFrame, solved: DataFrame) -> DataFrame:
    schema = "conv long, seg struct<first: long, role: string, digest: string>, part int, blob binary, sha string"
    made = cut(_dealt(placed, solved).mapInArrow(_digest_segments, schema))
    parts = made.filter("sha is null").repartition("conv").sortWithinPartitions("conv", "seg", "part").select("conv", "blob")
    return made.filter("sha is not null").select("conv", "sha").unionByName(parts.mapInArrow(_chained, "conv long, sha string"))


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    placed = _segments(plain_rows(rows, conv, turn, role, text))
    records = cut(_records(placed))
    sequences = cut(_sequences(records))
    return placed, records, cut(_solved(sequences, learn_grammar(sequences)))


def repair(
    rows: DataFrame,
    ids: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` per conversation.

    Rows are taken by turn, NULL turns first, rows of one turn by role and the SHA-256 of their text;
    a NULL role or text is one space. The first fault of a row counts: blank, duplicate (role and text came
    earlier), truncated (the last character that is no space ends no sentence). The cheapest edits give roles
    whose initials match ``(s?(ua)+)?``: keep (0, with 1 for a truncated row), rerole (2, likewise), delete (3, the
    only choice for blank and duplicate rows), insert an empty turn (2). ``audit`` holds their
    initials in order, the ASCII-least of the cheapest. ``repaired_sha256`` is that of the lines ``role:text``.

    ``gaps`` is ``max - min + 1 - distinct`` of the turns that are not NULL, 0 without any; ``illegal`` counts
    neighbours whose initials are none of su, ua, au. Conversations of ``ids`` without any row get zeros, an
    empty audit and the digest of nothing; a NULL id is a conversation of its own. Empty tables give
    empty results; other columns are ignored. Runs jobs while it builds the result.

    A conversation is worked on in segments of bounded numbers of different rows, of which only symbols meet
    in one task: as much as its audit. Texts are shuffled once, to their segment's task, which
    reads them as a stream; only conversations of several segments send repaired text on to be hashed in order.
    """
    placed, records, solved = _prepared(rows, conv_col, turn_col, role_col, text_col)
    spans = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    again = F.when(F.col("fault") == "blank", 0).when(F.col("seen"), F.col("n")).otherwise(F.col("n") - 1)
    cut_off = (F.col("fault") == "truncated") & ~F.col("seen")
    facts = records.groupBy("conv").agg(
        spans.alias("gaps"), F.sum(F.when(F.col("fault") == "blank", F.col("n"))).alias("blank"),
        F.sum(again).alias("duplicate"), F.count_if(cut_off).alias("truncated"),
    )
    # All that is known of a conversation, side by side; each kind of row fills its own columns.
    known = rows if ids is None else ids
    every = known.select(F.col(conv_col).cast("long").alias("conv")).distinct()
    for part in (facts, solved.drop("parts"), _digests(placed, solved)):
        every = every.unionByName(part, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    told = every.groupBy("conv").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    return told.withColumnRenamed("conv", conv_col)


def repaired_rows(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The repaired conversations: ``(id, segment, place, role, text, edit)``, in the order of these columns.

    ``edit`` is K, R or I; rows that were deleted are gone. Rules and odd inputs as in ``repair``.
    """
    placed, _, solved = _prepared(rows, conv_col, turn_col, role_col, text_col)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for (conv, seg), _, place, role, text, edit in _edited(batches):
            if place >= 0:
                held.append((conv, seg, place, role, text, edit))
            if len(held) >= 1024:
                yield _turns(held)
                held = []
        yield _turns(held)

    schema = f"{conv_col} long, segment struct<first: long, role: string, digest: string>, place long, role string, text string, edit string"
    return _dealt(placed, solved).mapInArrow(turns, schema)


def _turns(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), _SEGMENT, pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["conv", "segment", "place", "role", "text", "edit"]
    return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate(kinds)], names)


def damage(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Conversations with faults planted by ``crc32(conv:turn) % 20``, to try the repair on.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats
    it, 4 makes its role user. A NULL is one space wherever a string is needed.
    """
    blank = F.lit(" ")
    mark = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in (conv_col, turn_col)])
    fate = F.crc32(mark) % 20
    text, role = F.coalesce(F.col(text_col), blank), F.coalesce(F.col(role_col), blank)
    told = rows.select(
        F.col(conv_col), F.col(turn_col), F.when(fate == 4, "user").otherwise(role).alias(role_col),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias(text_col),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1))).alias("_copy"),
    )
    return told.drop("_copy")
