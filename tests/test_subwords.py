"""Lossless tokenizers: round trips, and merging against the plain definition."""

from __future__ import annotations

import base64
import os
import random
import time
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from pentarank.functions import subwords, tokens
from pentarank.functions.tokens import SPECIAL_TOKENS
from pentarank.operators import preparation

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ODD = [
    "", " ", "plain words", "  two  spaces \n\t and\r\nlines ", "ñandú 漢字 😀 été", "1234 a1b2_c3", "x" * 300, "[INST]a[/INST]b.</s>",
    "</s></s>[IMG]", "<s", "é‍\U0001f468‍\U0001f469", "_under_ __score__", "\x00\x01 null", "İIıi ß ſ",
]


def naive_merge(word, ranks):
    parts = [word[k : k + 1] for k in range(len(word))]
    if word in ranks:
        return [ranks[word]]
    while True:
        known = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not known:
            return [ranks[p] for p in parts]
        _, k = min(known)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """A file of ranks with all bytes and a few longer tokens."""
    pairs = ["th", "he", "the", " t", " the", "in", "ing", "aa", "aaa", "aaaa", "ab", "ba", "été"]
    known = [bytes([b]) for b in range(256)] + [p.encode() for p in pairs]
    path = tmp_path_factory.mktemp("ranks") / "small.ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(known)))
    return str(path)


def test_merging_follows_the_definition(small):
    ranks, pick = subwords.read_ranks(small), random.Random(1)
    for _ in range(2000):
        word = "".join(pick.choice(["a", "b", "t", "h", "e", "in", "ing", " t", "é"]) for _ in range(pick.randint(0, 30))).encode()
        if word:
            assert subwords.merge_parts(word, ranks) == naive_merge(word, ranks)
    started = time.time()
    assert len(subwords.merge_parts(b"ab" * 200_000, ranks)) == 200_000
    assert time.time() - started < 20


def test_ranks_must_cover_all_bytes(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"%s 0" % base64.b64encode(b"a"))
    with pytest.raises(ValueError, match="255 bytes"):
        subwords.read_ranks(str(path))


def test_subwords_round_trip(spark, small):
    tokenizer = subwords.byte_pair_tokenizer(small)
    df = spark.createDataFrame(list(enumerate([*ODD, None])), "id int, text string")
    rows = df.select("text", tokenizer.encode("text").alias("ids")).select("*", tokenizer.decode("ids").alias("told")).collect()
    assert all(r.told == r.text for r in rows)
    by_text = {r.text: r.ids for r in rows}
    assert by_text["</s></s>[IMG]"] == [tokenizer.special_id(t) for t in ("</s>", "</s>", "[IMG]")]
    assert tokenizer.special_id("[/INST]") in by_text["[INST]a[/INST]b.</s>"]
    masked = spark.range(1).select(tokenizer.decode(F.array(F.lit(-100), F.lit(256), F.lit(9999), F.lit(0xC3))).alias("t")).first()
    assert masked.t == "</s>th�"


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file here")
def test_real_ranks_agree_with_a_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = subwords.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={})
    mine, pick = subwords.BytePairEncoder(ranks, {}), random.Random(2)
    letters = "abcdefghij étö漢字 \n.,!"
    for _ in range(300):
        text = "".join(pick.choice(letters) for _ in range(pick.randint(0, 80)))
        assert mine([text]) == [library.encode_ordinary(text)]


def test_pair_rows_with_subwords(spark, small):
    tokenizer = subwords.byte_pair_tokenizer(small)
    records = spark.createDataFrame([(1, "the thing", "<reasoning>é</reasoning>", "<output>3</output>")], "id int, sentence string, reasoning string, output string")
    row = preparation.pair_rows(records, tokenizer, max_length=None).select("*", tokenizer.decode("labels").alias("told")).first()
    assert row.told.replace("</s>", "") == "<reasoning>é</reasoning>\n\n<output>3</output>"


def test_digits_round_trip(spark):
    tokenizer = subwords.HexTokenizer()
    df = spark.createDataFrame([(t,) for t in [*ODD, None, "long ünd " * 2000]], "text string")
    coded = df.select("text", tokenizer.encode("text").alias("ids"))
    rows = coded.select("*", tokenizer.decode("ids").alias("told"), tokenizer.spoken("ids").alias("spoken")).collect()
    for r in rows:
        assert r.told == r.text and r.spoken == r.ids
        if r.text is not None:
            assert all(0 <= t < tokenizer.vocab_size for t in r.ids)
    assert next(r.ids for r in rows if r.text == "</s></s>[IMG]") == [17, 17, 20]
    assert len(SPECIAL_TOKENS) + 16 == tokenizer.vocab_size
    cut = df.select(tokenizer.encode("text", 4).alias("ids")).collect()
    assert all(r.ids is None or len(r.ids) <= 4 for r in cut)
    told = spark.range(1).select(tokenizer.decode(F.array(*map(F.lit, (-100, 4, 1, 99, -5, 15, 15)))).alias("t")).first()
    assert told.t == "</s>A�"


def test_digits_go_by_whole_batches(spark):
    """One Python step for the whole chain, and nothing evaluated position by position in a lambda."""
    tokenizer = subwords.HexTokenizer()
    chain = tokenizer.decode(tokenizer.spoken(tokenizer.encode("text")))
    df = spark.createDataFrame([(t, t) for t in [*ODD, None]], "text string, label string")
    told = df.select("text", chain.alias("told"), tokenizer.decode(tokenizer.encode("label")).alias("label"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan
    assert all(r.told == r.text == r.label for r in told.collect())


def _plain_ids(text):
    """Ids of a text, byte by byte."""
    ids = []
    while text:
        token = next((t for t in SPECIAL_TOKENS if text.startswith(t.encode())), None)
        ids += [16 + SPECIAL_TOKENS.index(token)] if token else divmod(text[0], 16)
        text = text[len(token or " ") :]
    return ids


def _plain_octets(ids):
    """Bytes of ids, digit by digit."""
    known = [*"0123456789abcdef", *(t.encode().hex() for t in SPECIAL_TOKENS)]
    digits = "".join("3c2f733e" if t == -100 else known[t] if t is not None and 0 <= t < 21 else "" for t in ids)
    return bytes.fromhex("0" * (len(digits) % 2) + digits)


@pytest.mark.parametrize("part", [1, 50, 1 << 20])
def test_batches_and_parts_against_a_plain_program(monkeypatch, part):
    monkeypatch.setattr(subwords, "PART", part)
    monkeypatch.setattr(subwords, "SLICE", 7)
    monkeypatch.setattr(subwords, "EXPANDED", 9)
    pick = random.Random(5)
    pieces = [*SPECIAL_TOKENS, "<", "[", "</", "s>", "INST]", "é", "漢", "\x00", "word ", "\n"]
    texts = [None, "", "</s>" * 20, *("".join(pick.choices(pieces, k=pick.randint(0, 12))) for _ in range(300)), "<", "s>", "[/INST", "]"]
    texts = [t if t is None else t.encode() for t in texts]
    odd = [None, [], *([pick.choice([None, -100, -5, 21, 99, *range(21)]) for _ in range(pick.randint(0, 15))] for _ in range(300))]

    def run(work, rows, lengths):
        out = subwords._by_parts(work, rows, lengths(rows))
        assert out.slice(3, 40).equals(subwords._by_parts(work, rows.slice(3, 40), lengths(rows.slice(3, 40))))
        return out

    told = partial(subwords._hex_octets, ignore_index=-100)
    ids = run(subwords._hex_ids, pa.array(texts, pa.binary()), pc.binary_length)
    assert ids.to_pylist() == [t if t is None else _plain_ids(t) for t in texts]
    assert run(subwords._spoken_ids, ids, pc.list_value_length).equals(ids)
    assert run(told, ids, pc.list_value_length).to_pylist() == texts
    others = pa.array(odd, pa.list_(pa.int32()))
    assert run(told, others, pc.list_value_length).to_pylist() == [r if r is None else _plain_octets(r) for r in odd]
    said = [r if r is None else [t if t is not None and 0 <= t < 21 else None for t in r] for r in odd]
    assert run(subwords._spoken_ids, others, pc.list_value_length).to_pylist() == said
    none = pa.array([], pa.binary())
    assert len(subwords._by_parts(subwords._hex_ids, none, pc.binary_length(none))) == 0


def test_digit_labels_are_masked(spark):
    tokenizer = subwords.HexTokenizer()
    df = spark.createDataFrame([("[INST]ask[/INST]answer é</s>",)], "chat string")
    fixed = tokens.fixed_length(tokenizer.encode("chat", 60), tokenizer.pad_id, 60)
    rows = df.select(fixed.alias("f")).select(tokens.mask_labels("f.input_ids", "f.attention_mask", tokenizer.special_id("[/INST]")).alias("labels"))
    told = rows.select(tokenizer.decode("labels").alias("t")).first().t
    assert told.replace("</s>", "") == "answer é"


@pytest.mark.parametrize("tokenizer", [tokens.HashTokenizer(), subwords.HexTokenizer()])
@pytest.mark.parametrize("max_length", [None, 40, 400])
def test_parts_give_the_ids_of_whole_chats(spark, tokenizer, max_length):
    texts = ["", "plain", "ends with [", "[/INST", "<", "[INST] inside [/INST] it", "</s>", "é[IMG]", "<s", None, "word " * 100]
    rows = [(k, a, b, c) for k, (a, b, c) in enumerate((a, b, c) for a in texts for b in (texts[k] for k in (0, 3, 8, 9)) for c in ("<output>\n\n3", None))]
    df = spark.createDataFrame(rows, "id int, sentence string, reasoning string, output string")
    arguments = (df, tokenizer, "{{SENTENCE}} end", max_length, ("id",), (False, True))
    parts, whole = (sorted(make(*arguments).collect(), key=lambda r: (r.id, r.generation)) for make in (preparation._joined_ids, preparation._rendered_ids))
    cut = lambda ids: ids if ids is None or max_length is None else ids[:max_length]
    assert [(r.id, r.generation, cut(r["_ids"]), cut(r["_answer_ids"])) for r in parts] == [tuple(r) for r in whole]
