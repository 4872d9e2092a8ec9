"""Views of the given tables in the shapes the operators take. No row is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pentarank.schemas import (
    CANDIDATE_NUMBERS,
    IGNORE_INDEX,
    IMAGE_COLUMNS,
    NUM_CANDIDATES,
    PROMPT_COLUMNS,
)
from pentarank.session import input_partitions

GROUP = NUM_CANDIDATES + 1  # one sentence (or text vector) and its candidates
SEQUENCE = 8

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows for work that is heavy per row, dealt out only where the session asks for it."""
    count = input_partitions(df.sparkSession)
    return df if count is None else df.repartition(count, *keys)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(table(spark, sf_dir, "documents"), "doc_id")


def _member(value: str, place: int) -> str:
    return f"max(CASE WHEN place = {place} THEN {value} END)"


def _members(value: str) -> str:
    """Values by place; a missing one stays NULL, places after the last are cut off."""
    slots = ", ".join(_member(value, i) for i in CANDIDATE_NUMBERS)
    return f"slice(array({slots}), 1, max(place))"


def candidate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(group_id, text_vec, image_vecs, gold)`` from consecutive embeddings.

    ``gold`` holds a label value per candidate. The last group may have fewer candidates.
    Each place of a group keeps one value, so groups are bounded before the shuffle.
    """
    return spark.sql(
        f"""SELECT group_id, {_member("embedding", 0)} AS text_vec,
              {_members("embedding")} AS image_vecs, {_members("label")} AS gold
            FROM (SELECT vec_id div {GROUP} AS group_id, vec_id % {GROUP} AS place, embedding, label
                  FROM {{embeddings}})
            GROUP BY group_id""",
        embeddings=table(spark, sf_dir, "embeddings"),
    )


def grouped_vectors(embedded: DataFrame) -> DataFrame:
    """``(text_vec, image_vecs)`` of embedded documents ``(doc_id, vec)``, grouped as records are."""
    return embedded.sparkSession.sql(
        f"""SELECT group_id, {_member("vec", 0)} AS text_vec, {_members("vec")} AS image_vecs
            FROM (SELECT doc_id div {GROUP} AS group_id, doc_id % {GROUP} AS place, vec FROM {{embedded}})
            GROUP BY group_id""",
        embedded=embedded,
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base records from consecutive documents: one sentence, five descriptions.

    Image bytes are those of the description. The last record may lack candidates.
    """
    descriptions = [f"{_member('text', i)} AS {p}" for i, p in enumerate(PROMPT_COLUMNS, 1)]
    images = [f"CAST({p} AS BINARY) AS {m}" for p, m in zip(PROMPT_COLUMNS, IMAGE_COLUMNS)]
    return spark.sql(
        f"""SELECT id, language, concat_ws(' ', language, style) AS compound,
              CASE WHEN language = 'en' THEN 'literal' ELSE 'idiomatic' END AS sentence_type,
              sentence, style, {", ".join(PROMPT_COLUMNS)}, {", ".join(images)}
            FROM (
              SELECT id, {_member("lang", 0)} AS language, {_member("text", 0)} AS sentence,
                {_member("source", 0)} AS style, {", ".join(descriptions)}
              FROM (SELECT CAST(doc_id div {GROUP} AS INT) AS id, doc_id % {GROUP} AS place,
                      text, lang, source FROM {{documents}})
              GROUP BY id)""",
        documents=table(spark, sf_dir, "documents"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, reply)``: each whole document as reasoning, the answer its source.

    English replies never close their reasoning, French ones close it twice and German
    ones open the output a second time.
    """
    return documents(spark, sf_dir).selectExpr(
        "doc_id",
        r"""concat('<reasoning>', text,
              CASE lang WHEN 'en' THEN '' WHEN 'fr' THEN '</reasoning></reasoning>'
                ELSE '</reasoning>' END,
              '\n\n', CASE lang WHEN 'de' THEN '<output>\n' ELSE '' END,
              '{"Compound": "', source, '", "Image": "1"}\n</output>') AS reply""",
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, source, prediction, label)``: whole documents as reasoning of tagged answers.

    Predictions come in nine well and badly formed kinds, labels in seven.
    """
    parts = documents(spark, sf_dir).selectExpr(
        "doc_id",
        "source",
        r"concat('<reasoning> ', text, ' </reasoning>\n\n') AS head",
        r"'<output>\n' AS opened",
        r"'\n</output></s>' AS closed",
        """concat('{"Compound": "', source, '", "Image": ') AS start""",
        "string(doc_id div 5 % 5 + 1) AS guess",
        "string(doc_id % 5 + 1) AS truth",
    )
    return parts.selectExpr(
        "doc_id AS id",
        "source",
        r"""concat(head, CASE doc_id % 9
              WHEN 0 THEN concat(opened, start, '"', guess, '"}', closed)
              WHEN 1 THEN concat(opened, start, guess, '}', closed)
              WHEN 2 THEN concat(opened, start, '"three"}', closed)
              WHEN 3 THEN concat(opened, '{"Answer": ', guess, '}', closed)
              WHEN 4 THEN concat(opened, start, '"', guess, '"} ok', closed)
              WHEN 5 THEN concat('<output>', start, guess, '}</s></s>')
              WHEN 6 THEN concat('Image ', guess)
              WHEN 7 THEN concat('<output>\n\n', opened, start, '"', guess, '"}', closed)
              ELSE concat(opened, start, '" ', guess, ' "}', closed) END) AS prediction""",
        """concat(head, CASE doc_id % 11 WHEN 0 THEN 'no answer'
              WHEN 1 THEN concat(opened, '3', closed)
              WHEN 2 THEN concat(opened, 'null', closed)
              WHEN 3 THEN concat(opened, '["Image"]', closed)
              WHEN 4 THEN concat(opened, '["image", 1]', closed)
              WHEN 5 THEN concat(opened, '"An Image"', closed)
              ELSE concat(opened, start, '"', truth, '"}', closed) END) AS label""",
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq_id, pos, logits, target)`` from embeddings; class 0 stands for padding."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        f"vec_id div {SEQUENCE} AS seq_id",
        f"int(vec_id % {SEQUENCE}) AS pos",
        "transform(CAST(embedding AS ARRAY<DOUBLE>), x -> x * 10) AS logits",
        f"CASE WHEN label = 0 THEN {IGNORE_INDEX} ELSE label END AS target",
    )


def logit_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq_id, logits, targets)``, a sequence per row: each embedding cut into 8 positions.

    Targets count up from the label; every fifth of all positions is padding.
    """
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS seq_id",
        f"""transform(sequence(0, {SEQUENCE - 1}), i -> transform(
              slice(CAST(embedding AS ARRAY<DOUBLE>), i * {SEQUENCE} + 1, {SEQUENCE}), x -> x * 10)) AS logits""",
        f"""transform(sequence(0, {SEQUENCE - 1}), i -> CASE WHEN (vec_id + i) % 5 = 0 THEN {IGNORE_INDEX}
              ELSE CAST((label + i) % {SEQUENCE} AS INT) END) AS targets""",
    )


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, user_text, assistant_text)``: user turns with the reply after them.

    Joined on conversation and turn, so a long conversation spreads over all tasks.
    """
    turns = _spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return spark.sql(
        """SELECT asked.conv_id, asked.turn, asked.text AS user_text, answer.text AS assistant_text
           FROM {turns} AS asked
           JOIN (SELECT conv_id, turn - 1 AS turn, text FROM {turns} WHERE role = 'assistant') AS answer
             ON asked.conv_id = answer.conv_id AND asked.turn = answer.turn
           WHERE asked.role = 'user'""",
        turns=turns,
    )


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, image)``: the 64 numbers of each embedding as bytes of a picture.

    Grey ones of 8 by 8 and 16 by 4, and 4 by 4 ones of four channels; every thirteenth has no size.
    """
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id",
        """named_struct('origin', string(vec_id),
              'height', CASE WHEN vec_id % 13 = 12 THEN -1 WHEN vec_id % 3 = 0 THEN 8 ELSE 4 END,
              'width', CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 4 END,
              'nChannels', CASE vec_id % 3 WHEN 2 THEN 4 ELSE 1 END, 'mode', 0,
              'data', unhex(array_join(transform(embedding,
                 x -> lpad(hex(int(pmod(floor(CAST(x AS DOUBLE) * 1000), 256))), 2, '0')), ''))) AS image""",
    )


def picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, content)``: the first bytes of picture files whose sizes are made of the label and the id.

    PNG, JPEG with a segment before its frame, the three kinds of WebP, and files that are no pictures or too short.
    """
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "CAST(1 + vec_id % 700 AS INT) AS w", "1 + label AS h", "vec_id % 7 AS kind"
    ).selectExpr(
        "vec_id",
        """unhex(concat(CASE kind
             WHEN 0 THEN concat('89504E470D0A1A0A0000000D49484452', lpad(hex(w), 8, '0'), lpad(hex(h), 8, '0'), '0802000000')
             WHEN 1 THEN concat('FFD8FFE000104A46494600010100000100010000FFC2001108', lpad(hex(h), 4, '0'), lpad(hex(w), 4, '0'), '03')
             WHEN 2 THEN concat('52494646000000005745425056503858', '0A00000010000000',
               substr(lpad(hex(w - 1), 6, '0'), 5, 2), substr(lpad(hex(w - 1), 6, '0'), 3, 2), '00',
               substr(lpad(hex(h - 1), 6, '0'), 5, 2), '0000')
             WHEN 3 THEN concat('5249464600000000574542505650382000000000000000', '9D012A',
               substr(lpad(hex(w), 4, '0'), 3, 2), substr(lpad(hex(w), 4, '0'), 1, 2), lpad(hex(h), 2, '0'), '00')
             WHEN 4 THEN concat('524946460000000057454250', '5650384C00000000', '2F',
               substr(lpad(hex((w - 1) + (h - 1) * 16384), 8, '0'), 7, 2), substr(lpad(hex((w - 1) + (h - 1) * 16384), 8, '0'), 5, 2),
               substr(lpad(hex((w - 1) + (h - 1) * 16384), 8, '0'), 3, 2), substr(lpad(hex((w - 1) + (h - 1) * 16384), 8, '0'), 1, 2), '0000000000000000')
             WHEN 5 THEN '89504E470D0A1A0A0000000D49484452'
             ELSE hex(CAST(vec_id AS STRING)) END, '00')) AS content""",
    )
