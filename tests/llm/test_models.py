"""The learned models against plain programs: the quality classifier, the CRF, and strings that look random."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from pentarank.llm import html_extract, quality, secrets
from test_operators import brute_spans

MASK64 = (1 << 64) - 1
SPACE = b"\x20\t\n\x0b\x0c\r"


# --- quality ------------------------------------------------------------------


def plain_buckets(text, settings):
    """``{family: [bucket, ...]}`` byte by byte, with Python's integers."""

    def code(data):
        return sum((33 if b in SPACE else b + 1) * pow(0x100000001B3, k, 1 << 64) for k, b in enumerate(data)) & MASK64

    def bucket(value, salt):
        mixed = (value + salt) * 0x9E3779B97F4A7C15 & MASK64
        mixed ^= mixed >> 29
        return (mixed * 0x9E3779B97F4A7C15 & MASK64) >> (64 - settings.bits)

    data = text.encode()
    words = [code(w) for w in data.split()]
    found = {0: [bucket(w, 1) for w in words], 1: [bucket(b - a & MASK64, 2) for a, b in zip(words, words[1:])], 2: []}
    raw = b" " + data + b" "
    for n in settings.ngrams:
        for k in range(len(raw) - n + 1):
            gram = raw[k : k + n]
            if not any(b in SPACE for b in gram[1:-1]) and not (gram[0] in SPACE and gram[-1] in SPACE):
                found[2].append(bucket(code(gram), 10 + n))
    return found


def plain_model(rows, settings):
    """One vector per bucket, averaged, softmax, stochastic gradient descent, in plain lists."""
    rng = np.random.default_rng(settings.seed)
    size, dim = 1 << settings.bits, settings.dim
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).tolist()
    layer, shift = [[0.0, 0.0] for _ in range(dim)], [0.0, math.log((sum(y for _, y in rows) + 1) / (len(rows) - sum(y for _, y in rows) + 1))]
    bags = []
    for text, _ in rows:
        bag = collections.Counter()
        for listed in plain_buckets(text, settings).values():
            for b in listed:
                bag[b] += 1 / (3 * len(listed))
        bags.append(bag)
    done = 0
    for _ in range(settings.epochs):
        for k in rng.permutation(len(rows)):
            rate = settings.rate * (1 - done / (len(rows) * settings.epochs))
            done += 1
            hidden = [sum(w * vectors[b][d] for b, w in bags[k].items()) for d in range(dim)]
            logits = [sum(h * row[y] for h, row in zip(hidden, layer)) + shift[y] for y in (0, 1)]
            chance = [math.exp(z - max(logits)) for z in logits]
            chance = [c / sum(chance) for c in chance]
            chance[rows[k][1]] -= 1.0
            back = [sum(row[y] * chance[y] for y in (0, 1)) for row in layer]
            for d in range(dim):
                for y in (0, 1):
                    layer[d][y] -= rate * hidden[d] * chance[y]
            for y in (0, 1):
                shift[y] -= 0.02 * rate * chance[y]
            for b, w in bags[k].items():
                for d in range(dim):
                    vectors[b][d] -= rate * 200.0 * w * back[d]

    def score(text):
        odds = shift[1] - shift[0]
        for listed in plain_buckets(text, settings).values():
            if listed:
                odds += sum(sum(v * (row[1] - row[0]) for v, row in zip(vectors[b], layer)) for b in listed) / (3 * len(listed))
        return 1 / (1 + math.exp(-odds))

    return score


TEXTS = ["", " ", "one", "two words", "a b a b", "été 漢字 x", "tabs\tand\nlines ", "long" * 40, "same same same"]


def test_features_match_a_plain_program(monkeypatch):
    settings = quality.Settings(bits=12)
    for chunk in (quality.CHUNK, 7):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        for text in TEXTS:
            got = collections.defaultdict(list)
            for family, buckets in quality.features(text, settings):
                got[family] += buckets.tolist()
            want = plain_buckets(text, settings)
            assert all(sorted(got[f]) == sorted(want[f]) for f in want), text


def test_training_and_scores_match_a_plain_program(spark):
    settings, rng = quality.Settings(bits=7, dim=3, epochs=2), random.Random(4)
    rows = [(" ".join(rng.choice(["ab", "cd", "xy", "#"] if y else ["ef", "gh", "xy", "!"]) for _ in range(rng.randint(1, 9))) + f" {k}", y) for k, y in enumerate([0, 1] * 20)]
    bags = [quality._bag(t, settings) for t, _ in rows]
    model = quality.fit(bags, np.array([y for _, y in rows]), settings)
    plain = plain_model(rows, settings)
    for text in [*TEXTS, *[t for t, _ in rows]]:
        assert abs(model.score(text) - plain(text)) < 2e-3, text
    trained = quality.train(spark.createDataFrame(rows, "text string, label int"), settings)
    assert sum((trained.score(t) > 0.5) == bool(y) for t, y in rows) >= 36


# --- HTML -----------------------------------------------------------------------


def pages_by_container(seed, count=400):
    """Composed pages, told apart by the container of their article."""
    composer, kinds = html_extract.Composer(seed), collections.defaultdict(list)
    for _ in range(count):
        containers = composer.CONTAINERS
        composer.CONTAINERS = [containers[composer.rng.randrange(len(containers))]]
        made = composer.page()
        kinds[composer.CONTAINERS[0]].append(html_extract.marked(made))
        composer.CONTAINERS = containers
    return kinds


@pytest.mark.parametrize("container", ["<main>|</main>", '<div class="post-body">|</div>', '<section class="story">|</section>', '<table><tr><td>|</td></tr></table>'])
def test_layouts_never_seen_are_read_too(container):
    """All pages of one kind of container are held out of training; precision and recall on them, by characters."""
    kinds = pages_by_container(5)
    model = html_extract.fit([p for kind, pages in kinds.items() if kind != container for p in pages])
    right = said = wanted = 0
    for blocks, labels in kinds[container]:
        got = model.decode(model.odds(blocks, {}))
        for block, label, mine in zip(blocks, labels, got):
            size = len(block.text)
            right, said, wanted = right + size * (label and mine), said + size * mine, wanted + size * label
    print(container, "precision", round(right / said, 4), "recall", round(right / wanted, 4))
    assert right / said > 0.95 and right / wanted > 0.75


def test_odds_are_those_of_the_features():
    """Block by block: the weights of its features, from the page's markup read again element by element."""
    model = html_extract.fit(list(html_extract.composed(60)))
    composer = html_extract.Composer(9)
    for _ in range(20):
        blocks, _ = html_extract.marked(composer.page())
        odds = model.odds(blocks, {})
        for block, worth in zip(blocks, odds):
            path = list(block.path)
            tags, roles = [e[0] for e in path], {html_extract.ROLE_OF[n] for e in path for n in e[1:] if n in html_extract.ROLE_OF}
            found = {f"tag:{t}" for t in tags} | {f"role:{r}" for r in roles} | {f"leaf:{tags[-1] if tags else ''}"}
            for entry in reversed(path):
                said = [html_extract.ROLE_OF[n] for n in entry[1:] if n in html_extract.ROLE_OF]
                if said or entry[0] in ("article", "main", "nav", "aside", "footer", "header", "form"):
                    found.add(f"near:{said[0] if said else entry[0]}")
                    break
            if "article" in tags:
                for entry in path[tags.index("article") + 1 :]:
                    found |= {f"in:{entry[0]}"} if entry[0] in html_extract.INNER_TAGS else set()
                    found |= {f"in:{html_extract.ROLE_OF[n]}" for n in entry[1:] if n in html_extract.ROLE_OF}
            text = html_extract._text_features(block)
            assert abs(worth - sum(model.weights.get(f, 0.0) for f in [*found, *text])) < 1e-9


# --- secrets ----------------------------------------------------------------------


def plain_random(text, model, margin=12.0, per_pair=0.4):
    """Random spans by the rules of the scan: whole candidates, else runs and parts between slashes."""
    base = [(a, b) for a, _, b in brute_spans(text)]

    def ratio(word):
        codes = [ord(c) - secrets.FIRST for c in word]
        return sum(model.ratios[x * secrets.SYMBOLS + y] for x, y in zip(codes, codes[1:]))

    def judged(a, b):
        return not any(x < b and a < y for x, y in base) and ratio(text[a:b]) >= max(margin, per_pair * (b - a - 1)) - 1e-9

    spans = []
    for m in re.finditer(secrets.CANDIDATE, text):
        if judged(m.start(), m.end()):
            spans.append((m.start(), m.end()))
            continue
        if "/" not in m[0]:
            continue
        runs, pieces = [], []
        at = first = last = m.start()
        total = best = 0.0
        for part in m[0].split("/"):
            end = at + len(part)
            total += ratio(part + "/") - per_pair * len(part)
            if total > best:
                best, last = total, end
            elif total <= 0 or total < best - margin:
                runs.append((first, last))
                first = last = end + 1
                total = best = 0.0
            pieces.append((at, end))
            at = end + 1
        runs.append((first, last))
        kept = [r for r in runs if r[1] - r[0] >= secrets.LEAST and judged(*r)]
        kept += [p for p in pieces if p[1] - p[0] >= secrets.LEAST and judged(*p) and not any(r[0] < p[1] and p[0] < r[1] for r in kept)]
        spans += kept
    return sorted(spans)


def test_random_spans_match_a_plain_program(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, rng = secrets.train(secrets.corpus_samples(docs)), random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    made = []
    for _ in range(300):
        parts = [rng.choice([key(rng.randint(5, 60)), "plain words here", "usr/local/share/documents/readme", "src/" + key(40) + "/main", f"token={key(12)}", "é😀", "x" * 30]) for _ in range(rng.randint(1, 6))]
        made.append(rng.choice([" ", "/", "-", "\n"]).join(parts))
    df = docs.unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(made)], "doc_id long, text string"))
    some = 0
    for r in secrets.scan(df, model).collect():
        got = [(s.start, s.end) for s in r.found if s.kind == 3]
        assert got == plain_random(r.text or "", model), r.text
        some += len(got)
    assert some > 150
