from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from pentarank.functions import tokens
from pentarank.operators import batching, preparation

TOKENIZER = tokens.HashTokenizer(vocab_size=50)


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression).first()[0]


def test_label_mask(spark):
    df = spark.createDataFrame(
        [
            ([0, 0, 5, 99, 7, 8], [0, 0, 1, 1, 1, 1]),
            ([0, 0, 5, 6, 7, 8], [0, 0, 1, 1, 1, 1]),
            ([99, 99, 5, 6, 7, 8], [0, 0, 1, 1, 1, 1]),
            ([5, 99, 6, 99, 7, 0], [1, 1, 1, 1, 1, 0]),
            ([0, 0, 5, 6, 7, 99], [0, 0, 1, 1, 1, 1]),
            ([5, 99, 7, 99, 6, 8], [1, 0, 1, 1, 0, 1]),
            ([99, 99], [0, 0]),
            ([], []),
        ],
        "ids array<int>, seen array<int>",
    )
    got = [r[0] for r in df.select(tokens.mask_labels("ids", "seen", 99)).collect()]
    assert got == [
        [-100, -100, -100, -100, 7, 8],
        [-100, -100, 5, 6, 7, 8],
        [-100, -100, 5, 6, 7, 8],
        [-100, -100, 6, 99, 7, -100],
        [-100] * 6,
        [-100, -100, -100, -100, -100, 8],
        [-100, -100],
        [],
    ]


@pytest.mark.parametrize(
    "ids, side, expected, mask",
    [
        ([1, 2, 3], "left", [0, 0, 0, 1, 2, 3], [0, 0, 0, 1, 1, 1]),
        ([1, 2, 3], "right", [1, 2, 3, 0, 0, 0], [1, 1, 1, 0, 0, 0]),
        ([1, 2, 3, 4, 5, 6, 7, 8], "left", [1, 2, 3, 4, 5, 6], [1] * 6),
        ([], "left", [0] * 6, [0] * 6),
    ],
)
def test_fixed_length(spark, ids, side, expected, mask):
    got = one(spark, ids, "array<int>", tokens.fixed_length("x", 0, 6, side))
    assert (got.input_ids, got.attention_mask) == (expected, mask)


def test_pieces_and_ids(spark):
    text = "Ça va,\x0b ok_1!\n[INST]x[/INST]</s>" + "y" * 40 + "😀"
    pieces = one(spark, text, "string", TOKENIZER.pieces("x"))
    assert pieces == ["Ça", "va", ",", "ok_1", "!", "[INST]", "x", "[/INST]", "</s>", "y" * 32, "y" * 8, "😀"]
    ids = one(spark, text, "string", TOKENIZER.encode("x"))
    assert (ids[5], ids[7], ids[8]) == (2, 3, 1)
    expected = zlib.crc32("Ça".encode()) % 45 + 5
    assert ids[0] == expected and all(5 <= i < 50 for i in ids[:5])
    assert one(spark, text, "string", TOKENIZER.encode("x", 3)) == ids[:3]


def test_decode_shows_ignored_positions(spark):
    texts = spark.createDataFrame([("red green blue",), ("green [/INST] red",)], "t string")
    big = tokens.HashTokenizer()
    vocabulary = big.vocabulary(texts, "t")
    rows = texts.select(F.concat(F.array(F.lit(-100)), big.encode("t")).alias("ids"))
    decoded = tokens.decode(rows, "ids", vocabulary, big.vocab_size)
    assert decoded.columns == ["ids", "decoded"]
    assert sorted(r.decoded for r in decoded.collect()) == ["</s> green [/INST] red", "</s> red green blue"]


def test_vocabulary_shares_ids_by_smallest_token(spark):
    tiny = tokens.HashTokenizer(vocab_size=6)
    texts = spark.createDataFrame([("pear apple fig",)], "t string")
    assert dict(tiny.vocabulary(texts, "t").collect())[5] == "apple"


def test_vocabulary_bound_is_checked(spark):
    rows = spark.createDataFrame([([1],)], "ids array<int>")
    outside = spark.createDataFrame([(7, "a")], "token_id int, token string")
    with pytest.raises(Exception, match="outside the vocabulary"):
        tokens.decode(rows, "ids", outside, 7).collect()


def test_greedy_ids(spark):
    logits = [[0.1, 0.9, 0.9], [3.0, 1.0, 2.0]]
    assert one(spark, logits, "array<array<double>>", tokens.greedy_ids("x")) == [1, 0]


def test_plugged_in_tokenizer(spark):
    def make_encoder():
        return lambda batch: [[ord(c) for c in text] for text in batch]

    def make_decoder():
        return lambda rows: ["".join(map(chr, row)) for row in rows]

    df = spark.createDataFrame([("ab",), (None,), ("",)], "x string")
    ids = df.select(tokens.encode_with(make_encoder)("x").alias("ids"))
    assert [r.ids for r in ids.collect()] == [[97, 98], None, []]
    masked = ids.select(F.concat(F.array(F.lit(-100)), "ids").alias("ids"))
    back = masked.select(tokens.decode_with(make_decoder, ignore_id=45)("ids"))
    assert [r[0] for r in back.collect()] == ["-ab", None, "-"]


def test_length_profile(spark):
    df = spark.createDataFrame([("en", "a b c"), ("en", "a"), ("de", "")], "lang string, t string")
    profile = batching.token_length_profile(df, TOKENIZER.pieces("t"), ["lang"])
    german, english = sorted(profile.collect())
    assert tuple(german) == ("de", 1, 0, 0.0, 0.0)
    assert tuple(english)[1:] == pytest.approx((2, 3, 2.0, 2.9))


def char_tokenizer():
    """Every character is a token; the end of the instruction is a control character."""

    def make_encoder():
        return lambda batch: [[ord(c) for c in t.replace("[/INST]", "\x02")] for t in batch]

    def make_decoder():
        return lambda rows: ["".join("[/INST]" if t == 2 else chr(t) for t in row if t != 1) for row in rows]

    return tokens.PluggedTokenizer(make_encoder, 1, {"[/INST]": 2}, make_decoder)


def test_plugged_tokenizer_from_records_to_text(spark):
    plugged = char_tokenizer()
    record = spark.createDataFrame([(1, "a sentence", "<reasoning>r</reasoning>", "<output>o</output>")], "id int, sentence string, reasoning string, output string")
    answer = "<reasoning>r</reasoning>\n\n<output>o</output>"
    rows = preparation.pair_rows(record, plugged, template="{{SENTENCE}}", max_length=100)
    row = rows.withColumn("said", plugged.decode("labels")).first()
    assert row.said == answer + "</s>" and len(row.input_ids) == 100 and sum(row.attention_mask) == len("[INST]a sentence") + 1 + len(answer) + 4
    whole = preparation.pair_rows(record, plugged, template="{{SENTENCE}}", max_length=None).first()
    assert len(whole.input_ids) == sum(whole.attention_mask) == sum(row.attention_mask)
    cut = preparation.similarity_rows(record, plugged, max_length=6, padding=False).first()
    assert cut.input_ids == [ord(c) for c in "a sent"]
    open_row = preparation.pair_rows(record, plugged, template="{{SENTENCE}}", for_generation=True, max_length=None)
    assert open_row.withColumn("said", plugged.decode("partial_labels")).first().said == answer


def test_pixels_travel_with_the_tokens(spark):
    image = ("", 1, 1, 3, 16, bytearray([3, 2, 1]))
    schema = "id int, sentence string, " + ", ".join(
        f"image_{i} struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>" for i in range(1, 6)
    )
    record = spark.createDataFrame([(1, "s", *[image] * 5)], schema)
    row = preparation.similarity_rows(record, pixels=2).first()
    assert row.pixel_values[4] == [1.0] * 4 + [2.0] * 4 + [3.0] * 4 and row.image_error is None


def test_golden_tokens_and_markers():
    """Fixed values, written out once more, so that the twins do not take them from the code alone."""
    assert tokens.SPECIAL_TOKENS == ("<s>", "</s>", "[INST]", "[/INST]", "[IMG]")
    assert tokens.HashTokenizer().pattern == r"[\p{L}\p{N}_]{1,32}|<s>|</s>|\[INST\]|\[/INST\]|\[IMG\]|[^\p{L}\p{N}_\t-\r ]"
