"""Table schemas, index bases and sentinels shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
NUM_CANDIDATES = 5
IGNORE_INDEX = -100  # padded or masked token position
NO_IMAGE = -1  # answer without a usable image number
IGNORE_TOKEN = "</s>"
RESIZED_SIDE = 224
PAIR_MAX_LENGTH = 2144
SIMILARITY_MAX_LENGTH = 64
SIMILARITY_WEIGHTS = (1.5, 1.25, 1.125, 1.0)
SIMILARITY_BATCH = 128
MAP_BATCH = 30
SHUFFLE_SEED = 42

CANDIDATE_NUMBERS = tuple(range(1, NUM_CANDIDATES + 1))
PROMPT_COLUMNS = tuple(f"image_{i}_prompt" for i in CANDIDATE_NUMBERS)
IMAGE_COLUMNS = tuple(f"image_{i}" for i in CANDIDATE_NUMBERS)

_IDENTITY = [
    T.StructField("id", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("compound", T.StringType()),
    T.StructField("sentence_type", T.StringType()),
    T.StructField("sentence", T.StringType()),
    T.StructField("style", T.StringType()),
]


def base_schema(image_type: T.DataType = T.BinaryType()) -> T.StructType:
    """A record before generation: one sentence, five described images."""
    fields = list(_IDENTITY)
    for prompt, image in zip(PROMPT_COLUMNS, IMAGE_COLUMNS):
        fields += [T.StructField(prompt, T.StringType()), T.StructField(image, image_type)]
    return T.StructType(fields)


def sft_schema(image_type: T.DataType = T.BinaryType()) -> T.StructType:
    """The 19 typed columns of a finished fine-tuning record."""
    return T.StructType(
        list(_IDENTITY)
        + [T.StructField("correct_image", T.IntegerType())]
        + [T.StructField(c, T.StringType()) for c in PROMPT_COLUMNS]
        + [T.StructField(c, image_type) for c in IMAGE_COLUMNS]
        + [T.StructField("reasoning", T.StringType()), T.StructField("output", T.StringType())]
    )


def with_split(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField("split", T.StringType())])


METRIC_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
