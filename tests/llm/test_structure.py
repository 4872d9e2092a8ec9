"""Hard negatives, conversation repair and fingerprints against plain programs, on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from pentarank.llm import conversations, gnat, merkle, queries

SPACES = "\x20\t\n\x0b\x0c\r"


# --- hard negatives -----------------------------------------------------------


def brute_negatives(rows, low=30, high=90):
    """``rows``: (id, label, integer vector, is an anchor)."""
    out = []
    for a, (anchor, label, v, asked) in enumerate(rows):
        if not asked:
            continue
        scores = [int(v @ w) for _, _, w, _ in rows]
        order = sorted((k for k in range(len(rows)) if k != a), key=lambda k: (-scores[k], rows[k][0]))
        for p in [k for k in order if rows[k][1] == label][:5]:
            fits = [n for n in order if rows[n][1] != label and low * scores[p] <= 100 * scores[n] <= high * scores[p]]
            out += [(anchor, rows[p][0], rank, rows[n][0], scores[p], scores[n]) for rank, n in enumerate(fits[:10], 1)]
    return sorted(out)


def clustered(n, seed, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 4
    return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.2


@pytest.mark.parametrize("leaf_rows, block", [(16, 8), (64, 1000), (10_000, 10_000)])
def test_negatives_match_brute_force(spark, leaf_rows, block):
    points = np.round(clustered(400, 3), 1)
    rows = [(k, k % 4, [float(x) for x in v]) for k, v in enumerate(points)]
    rows += rows[:6] + [(7, 1, rows[9][2]), (20, 2, [0.0] * 8), (40, 3, [float(-x) for x in points[40]])]
    odd = [(None, 1, [1.0] * 8), (60, None, [1.0] * 8), (80, 1, None), (100, 1, [None] + [1.0] * 7), (120, 1, [float("nan")] * 8), (140, 1, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>")
    df = df.selectExpr("*", "'x' as key", "1 as leaf", "2 as cell", "3 as id", "4 as v", "5 as rank").repartition(3)
    got = gnat.mine_negatives(df, F.col("vec_id") % 20 == 0, leaf_rows=leaf_rows, block=block).collect()
    whole = [(k, label, np.floor(np.array(v) * 256).astype(np.int64), k % 20 == 0) for k, label, v in rows]
    assert sorted(map(tuple, got)) == brute_negatives(whole)


def test_negatives_of_few_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    assert gnat.mine_negatives(empty, F.lit(True)).collect() == []
    alone = spark.createDataFrame([(0, 1, [1.0, 2.0])], schema)
    assert gnat.mine_negatives(alone, F.lit(True)).collect() == []
    # Shorter vectors are filled up with zeros; a NULL condition asks for nothing.
    three = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [1.0]), (2, 2, [0.5]), (3, 3, [])], schema)
    got = gnat.mine_negatives(three, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 32768)]
    assert gnat.mine_negatives(three, F.lit(None).cast("boolean")).collect() == []
    with pytest.raises(ValueError):
        gnat.mine_negatives(spark.createDataFrame([(0, 1, [2.0**22] * 16)], schema), F.lit(True))


def test_tree_drops_leaves_and_loses_nothing():
    points = np.floor(clustered(4000, 5) * 256)
    top = float((points**2).sum(1).max())
    tree = gnat.Gnat(points[:1000], top, len(points), 64)
    tree.set_ranges(tree.ranges(points))
    leaf = tree.leaf_of(points)
    asked = points[::100]
    scores = asked @ points.T
    best = np.sort(scores, 1)[:, -5:]
    lows, highs = np.ceil(best[:, :1] * 0.8), np.floor(best[:, :1] * 0.9)
    seen = np.zeros((len(asked), tree.leaves), bool)
    for rows, number in tree.meeting(asked, lows, highs):
        seen[rows, number] = True
    needed = (scores >= lows) & (scores <= highs)
    assert all(seen[k, leaf[n]] for k, n in zip(*np.nonzero(needed)))
    assert tree.leaves > 30 and seen.mean() < 0.5


# --- conversations --------------------------------------------------------------


def brute_repair(rows):
    """Least cost and least audit by trying all edits; ``rows``: (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    roles = [r[:1] for _, r, _ in rows]
    user, assistant = {0: 2, 1: 2, 3: 2}, {2: 3}

    @lru_cache(None)
    def best(i, state, inserts):
        options = [(0, "")] if i == len(rows) and state in (0, 3) else []
        ways = [w[state] for w in (user, assistant) if state in w]
        if inserts < 2:
            options += [(c + 2, "I" + a) for c, a in (best(i, to, inserts + 1) for to in ways)]
        if i < len(rows):
            c, a = best(i + 1, state, 0)
            options.append((c + 3, "D" + a))
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                kept = {"s": 1 if state == 0 else None, "u": user.get(state), "a": assistant.get(state)}.get(roles[i])
                for cost, letter, to in [(0, "K", kept), *[(2, "R", to) for to in ways]]:
                    if to is not None:
                        c, a = best(i + 1, to, 0)
                        options.append((c + cost + extra, letter + a))
        return min(options, default=(10**9, ""))

    cost, audit = best(0, 0, 0)
    lines, state, i = [], 0, 0
    for letter in audit:
        role, text = ("assistant" if state == 2 else "user"), ""
        if letter != "I":
            text, role, i = rows[i][2], role if letter == "R" else rows[i][1], i + 1
        if letter != "D":
            lines.append(f"{role}:{text}")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def brute_damage(rows):
    said, ids = defaultdict(list), set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        said[conv] += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    place = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {c: tuple(sorted(said[c], key=place)) for c in ids}


CONVERSATION = "conv_id long, turn long, role string, text string"
NAMES = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def held(df):
    return {r.conv_id: tuple(r[n] for n in NAMES[1:]) for r in df.collect()}


def test_query_repairs_as_brute_force_does(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*"conv_id turn role text".split()).collect()]
    want = {c: brute_repair(r)[0] for c, r in brute_damage(rows).items()}
    made = queries.op12_conversations(spark, sf_dir)
    assert sorted(made.columns) == sorted(NAMES) and held(made) == want


@pytest.mark.parametrize("limits", [(4096, 8, 1 << 20, 1000), (6, 2, 64, 1000), (6, 2, 64, 0)])
def test_repair_of_odd_conversations(spark, monkeypatch, limits):
    """Also cut into segments of a few rows and turns, and into texts of a few bytes."""
    for name, value in zip(("SEGMENT_ROWS", "TURN_BITS", "BLOB", "BROADCAST_ROWS"), limits):
        monkeypatch.setattr(conversations, name, value)
    pick = random.Random(5).choice
    rows = []
    for conv in [None, 1, 2, 3, 4, 5, 6]:
        for k in range(pick([0, 1, 5, 40, 80]) + 1):
            role = pick(["system", "user", "assistant", "tool", None, "", "user", "assistant"])
            text = pick([None, "", " \t", "hi.", "no", "ok!", "same.", " x? ", f"t{k}.", "漢字。"])
            rows.append((conv, pick([None, None, -3, k, k, k, 7, 10**18]), role, text))
    rows += [(9, 3, "user", "same.")] * 40 + [(9, k, "assistant", "r.") for k in range(30)]
    df = spark.createDataFrame(rows, CONVERSATION).selectExpr("*", "1 as conv", "2 as seg", "3 as digest", "4 as n", "5 as kind", "6 as sha")
    damaged = brute_damage(rows)
    want = {c: brute_repair(r) for c, r in damaged.items()}
    hurt = conversations.damage(df)
    assert held(conversations.repair(hurt, df)) == {c: w[0] for c, w in want.items()}
    lines = defaultdict(list)
    for r in sorted(conversations.repaired_rows(hurt).collect(), key=lambda r: (r.segment.first is not None, r.segment.first or 0, r.segment.role, r.segment.digest, r.place)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {c: w[1] for c, w in want.items() if w[1]}
    assert conversations.repair(df.limit(0)).collect() == []


def test_rules_shorten_sequences_and_keep_costs():
    grammar = conversations.Grammar([("eh", "一"), ("一一", "丁")])
    plain = conversations.Grammar()
    for code, seq in (("丁丁d", "ehehehehd"), ("b一f", "behf")):
        (cost, illegal, audits, _), (c, i, a, _) = grammar.solve((code,)), plain.solve(tuple(seq))
        assert (cost, illegal, "".join(audits)) == (c, i, "".join(a))


# --- fingerprints -----------------------------------------------------------------


def brute_print(text):
    pieces = re.findall(merkle.PARAGRAPH.replace(r"\z", r"\Z"), text)
    assert "".join(pieces) == text
    sections, digests = [], []
    for k, piece in enumerate(pieces):
        digests.append(hashlib.sha256(piece.encode()).hexdigest())
        if digests[-1][0] == "0" or re.search(merkle.BLANK_LINE, piece) or k == len(pieces) - 1:
            sections.append((hashlib.sha256(("s" + "".join(digests)).encode()).hexdigest(), [d[:10] for d in digests]))
            digests = []
    root = hashlib.sha256(("r" + "".join(s for s, _ in sections)).encode()).hexdigest()
    return "/".join([root, *[":".join([s[:10], *under]) for s, under in sections]]), {d for _, under in sections for d in under}


def brute_likeness(a, b):
    (x, p), (y, q) = brute_print(a), brute_print(b)
    return 1.0 if x == y else 2 * len(p & q) / (len(p) + len(q))


def test_fingerprints_of_odd_documents(spark):
    pick = random.Random(3).choice
    noise = "".join(pick("ab c\n.!|é漢😀\t") for _ in range(5000))
    texts = [None, "", "x", "one line.", noise, noise[:4000] + "end", "word " * 9000, "a.\n\nb\n \nc, " * 40, "z" * 1000]
    rows = list(enumerate(texts)) + [(None, "no id")] * 3 + [(4, noise), (4, "another"), (6, texts[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.selectExpr("*", "1 as key", "2 as digest", "3 as id", "4 as n", "5 as copies", "6 as print", "7 as times")
    order = sorted([(d, t or "") for d, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = []
    for k, (doc, text) in enumerate(order):
        follows = order[(k + 1) % len(order)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + follows[:quarter]
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_print(text)[0], brute_print(edited)[0],
                     brute_likeness(text, edited), brute_likeness(text, follows)))
    got = [tuple(r) for r in merkle.compare_edited(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert merkle.compare_edited(df.limit(0)).collect() == []


def test_branches_locate_edits(spark):
    lines = [f"This is line {k} of the text with words enough\n" for k in range(300)]
    new = lines.copy()
    new[100] = "Something else stands here in its place\n"
    new.insert(200, "And this one was not there before as it seems\n")
    df = spark.createDataFrame([(1, "".join(lines), "".join(new)), (2, "same", "same"), (3, "", "new text")], "doc_id long, a string, b string")
    prints = df.select("doc_id", merkle.fingerprint("a").alias("fingerprint"), merkle.fingerprint("b").alias("edited_fingerprint"), "b")
    found = merkle.locate_edits(prints)
    kept = {(r.doc_id, r.section, r.paragraph) for r in found.collect()}
    by_doc = {r.doc_id: r.edited_fingerprint.split("/")[1:] for r in prints.collect()}
    digests = {by_doc[d][s].split(":")[p + 1] for d, s, p in kept if d == 1}
    assert digests == {hashlib.sha256(t.encode()).hexdigest()[:10] for t in (new[100], new[200])}
    assert (3, 0, 0) in kept and not any(d == 2 for d, _, _ in kept)
