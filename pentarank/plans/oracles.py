"""DuckDB statements with the same results as the queries, written relationally.

Candidates stay in long form here (joins and windows), so the two sides share no method.
"""

from __future__ import annotations

from pentarank.functions import prompts
from pentarank.functions.text import WHITESPACE
from pentarank.functions.tokens import SPECIAL_TOKENS
from pentarank.plans.queries import PICTURE_SIDE, TOKENIZER
from pentarank.schemas import (
    CANDIDATE_NUMBERS,
    IMAGE_COLUMNS,
    MAP_BATCH,
    PAIR_MAX_LENGTH,
    PROMPT_COLUMNS,
    SHUFFLE_SEED,
    SIMILARITY_BATCH,
    SIMILARITY_MAX_LENGTH,
    SIMILARITY_WEIGHTS,
)


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_SPACE = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)

# --- similarity ------------------------------------------------------------

_VECTORS = """vectors AS (
  SELECT vec_id // 6 AS group_id, vec_id % 6 AS place, CAST(embedding AS DOUBLE[]) AS v, label
  FROM embeddings)"""
_SIM = """sim AS (
  SELECT t.group_id, c.place - 1 AS pos, c.label AS gold, list_cosine_similarity(t.v, c.v) AS s
  FROM vectors t JOIN vectors c ON t.group_id = c.group_id
  WHERE t.place = 0 AND c.place > 0)"""
_RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY s DESC, pos) - 1 AS k,
    row_number() OVER (PARTITION BY group_id ORDER BY gold, pos) - 1 AS gold_k,
    count(*) OVER (PARTITION BY group_id) AS n
  FROM sim)"""
_TOP = """top AS (
  SELECT group_id, max(CASE WHEN k = 0 THEN pos END) AS top_pos FROM ranked GROUP BY 1)"""
_RHO = """rho AS (
  SELECT a.group_id,
    1 - 6.0 * sum(power(a.pos - a.k, 2)) / nullif(max(a.n) * (max(a.n) ^ 2 - 1), 0) AS plain,
    1 - 6.0 * sum(power(a.pos - b.pos, 2)) / nullif(max(a.n) * (max(a.n) ^ 2 - 1), 0) AS labeled,
    1 - 6.0 * sum(power(a.k - a.gold_k, 2)) / nullif(max(a.n) * (max(a.n) ^ 2 - 1), 0) AS ranks
  FROM ranked a JOIN ranked b ON a.group_id = b.group_id AND a.k = b.gold_k GROUP BY 1)"""
_LOSS = f"""loss AS (
  SELECT group_id, pos,
    greatest(-d, 0) + ln(1 + exp(-abs(d))) AS plain,
    (greatest(-d, 0) + ln(1 + exp(-abs(d)))) * ([{", ".join(map(str, SIMILARITY_WEIGHTS))}])[pos + 1] AS weighted
  FROM (SELECT group_id, pos, s - lead(s) OVER (PARTITION BY group_id ORDER BY pos) AS d FROM sim)
  WHERE d IS NOT NULL)"""
_SIMILARITY = _with(_VECTORS, _SIM, _RANKED, _TOP, _RHO, _LOSS)

# --- likelihood ------------------------------------------------------------

_LOGITS = """logits AS (
  SELECT vec_id // 8 AS seq_id, CAST(vec_id % 8 AS INTEGER) AS pos,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 10) AS l,
    CASE WHEN label = 0 THEN -100 ELSE label END AS target
  FROM embeddings)"""


def _log_probs(source: str) -> str:
    return f"""scored AS (
  SELECT seq_id, pos, CASE WHEN target <> -100 THEN
    ln(greatest(exp(l[target + 1] - list_max(l))
      / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))), 1e-9)) END AS lp
  FROM {source})"""


_SHIFTED = """shifted AS (
  SELECT seq_id, pos, l, next AS target FROM (
    SELECT *, lead(target) OVER (PARTITION BY seq_id ORDER BY pos) AS next FROM logits)
  WHERE next IS NOT NULL)"""
_PERPLEXITY = """SELECT round(exp(-avg(m)), 6) AS perplexity
FROM (SELECT avg(lp) AS m FROM scored GROUP BY seq_id)"""

# --- tagged answers --------------------------------------------------------

_GENERATIONS = """base AS (
  SELECT doc_id AS id, source, doc_id % 9 AS kind, doc_id % 11 AS said,
    CAST(doc_id // 5 % 5 + 1 AS VARCHAR) AS guess, CAST(doc_id % 5 + 1 AS VARCHAR) AS truth,
    '<reasoning> ' || text || ' </reasoning>' || chr(10) || chr(10) AS head,
    '<output>' || chr(10) AS opened, chr(10) || '</output></s>' AS closed,
    '{"Compound": "' || source || '", "Image": ' AS start
  FROM documents),
generations AS (
  SELECT id, source, said,
    head || CASE kind
      WHEN 0 THEN opened || start || '"' || guess || '"}' || closed
      WHEN 1 THEN opened || start || guess || '}' || closed
      WHEN 2 THEN opened || start || '"three"}' || closed
      WHEN 3 THEN opened || '{"Answer": ' || guess || '}' || closed
      WHEN 4 THEN opened || start || '"' || guess || '"} ok' || closed
      WHEN 5 THEN '<output>' || start || guess || '}</s></s>'
      WHEN 6 THEN 'Image ' || guess
      WHEN 7 THEN '<output>' || chr(10) || chr(10) || opened || start || '"' || guess || '"}' || closed
      ELSE opened || start || '" ' || guess || ' "}' || closed END AS prediction,
    head || CASE said WHEN 0 THEN 'no answer' WHEN 1 THEN opened || '3' || closed
      WHEN 2 THEN opened || 'null' || closed WHEN 3 THEN opened || '["Image"]' || closed
      WHEN 4 THEN opened || '["image", 1]' || closed WHEN 5 THEN opened || '"An Image"' || closed
      ELSE opened || start || '"' || truth || '"}' || closed END AS label
  FROM base)"""


def _strip(value: str) -> str:
    return f"trim({value}, {_SPACE})"


def _tag(value: str, tag: str) -> str:
    after = f"split_part({value}, '<{tag}>', 2)"
    return _strip(f"split_part({after}, '</{tag}>', 1)")


def _image(output: str) -> str:
    return f"""CASE WHEN NOT json_valid({output}) THEN -1.0
      WHEN json_type({output}, '$.Image') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
        THEN CAST(json_extract_string({output}, '$.Image') AS DOUBLE)
      WHEN json_type({output}, '$.Image') = 'VARCHAR'
        AND regexp_full_match({_strip(f"json_extract_string({output}, '$.Image')")}, '[+-]?[0-9]+')
        THEN CAST({_strip(f"json_extract_string({output}, '$.Image')")} AS DOUBLE)
      ELSE -1.0 END"""


_OUTPUTS = f"""outputs AS (
  SELECT *, {_tag("prediction", "output")} AS pred_output, {_tag("label", "output")} AS label_output
  FROM generations),
images AS (
  SELECT *, {_image("pred_output")} AS pred_image, {_image("label_output")} AS label_image
  FROM outputs)"""
_ANSWERS = _with(_GENERATIONS, _OUTPUTS)

# --- records ---------------------------------------------------------------

_MEMBERS = ",\n    ".join(
    f"max(CASE WHEN place = {i} THEN text END) AS {c}" for i, c in enumerate(PROMPT_COLUMNS, 1)
)
_RECORDS = f"""grouped AS (
  SELECT CAST(doc_id // 6 AS INTEGER) AS id,
    max(CASE WHEN place = 0 THEN lang END) AS language,
    max(CASE WHEN place = 0 THEN text END) AS sentence,
    max(CASE WHEN place = 0 THEN source END) AS style,
    {_MEMBERS}
  FROM (SELECT *, doc_id % 6 AS place FROM documents) GROUP BY 1),
records AS (
  SELECT *, language || ' ' || style AS compound,
    CASE WHEN language = 'en' THEN 'literal' ELSE 'idiomatic' END AS sentence_type
  FROM grouped)"""
_PLACED = f"""placed AS (
  SELECT id, idx, prompt,
    CAST(row_number() OVER (PARTITION BY id ORDER BY md5('{SHUFFLE_SEED}-' || id || '-' || idx), idx) AS INTEGER) AS pos
  FROM ({" UNION ALL ".join(f"SELECT id, {i} AS idx, {c} AS prompt FROM records" for i, c in zip(CANDIDATE_NUMBERS, PROMPT_COLUMNS))}))"""
_SHUFFLED_COLUMNS = ",\n    ".join(
    f"max(CASE WHEN pos = {i} THEN prompt END) AS {c}" for i, c in zip(CANDIDATE_NUMBERS, PROMPT_COLUMNS)
)
_SHUFFLED = f"""shuffled AS (
  SELECT id, max(CASE WHEN idx = 1 THEN pos END) AS correct_image,
    string_agg(CAST(idx AS VARCHAR), ',' ORDER BY pos) AS candidate_order,
    {_SHUFFLED_COLUMNS}
  FROM placed GROUP BY id)"""


def _replace_all(template: str, pairs: list[tuple[str, str]]) -> str:
    for placeholder, value in pairs:
        template = f"replace({template}, {_quote(placeholder)}, {value})"
    return template


_PROMPT = _replace_all(
    _quote(prompts.GENERATION_TEMPLATE),
    [(prompts.SENTENCE, "r.sentence")]
    + [(p, f"coalesce(s.{c}, 'None')") for p, c in zip(prompts.DESCRIPTIONS, PROMPT_COLUMNS)]
    + [
        (prompts.COMPOUND_PHRASE, "r.compound"),
        (prompts.COMPOUND_TYPE, "r.sentence_type"),
        (prompts.CORRECT_IMAGE, "CAST(s.correct_image AS VARCHAR)"),
    ],
)
_PROMPTED = f"""prompted AS (
  SELECT id, s.correct_image, {_PROMPT} AS prompt FROM records r JOIN shuffled s USING (id))"""

_REPLIES = """replies AS (
  SELECT doc_id, '<reasoning>' || text
    || CASE lang WHEN 'en' THEN '' WHEN 'fr' THEN '</reasoning></reasoning>' ELSE '</reasoning>' END
    || chr(10) || chr(10) || CASE WHEN lang = 'de' THEN '<output>' || chr(10) ELSE '' END
    || '{"Compound": "' || source || '", "Image": "1"}' || chr(10) || '</output>' AS reply
  FROM documents),
parts AS (
  SELECT doc_id, reply, ok, CASE WHEN ok THEN split_part(reply, '</reasoning>', 1) || '</reasoning>' END AS reasoning,
    CASE WHEN ok THEN '<output>' || split_part(reply, '</reasoning>', 2) END AS output
  FROM (SELECT *, len(string_split(reply, '</reasoning>')) = 2 AS ok FROM replies))"""

# --- tokens ----------------------------------------------------------------

_EXCHANGES = """exchanges AS (
  SELECT u.conv_id, u.turn, u.text AS user_text, a.text AS assistant_text
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
  WHERE u.role = 'user' AND a.role = 'assistant'),
chats AS (
  SELECT conv_id, turn, '[INST]' || user_text || '[/INST]' || assistant_text || '</s>' AS chat,
    '[INST]' || user_text || '[/INST]<reasoning>' AS open_chat
  FROM exchanges)"""


def _pieces(value: str) -> str:
    return f"regexp_extract_all({value}, {_quote(TOKENIZER.pattern)})"


_SPECIALS = "[" + ", ".join(_quote(t) for t in SPECIAL_TOKENS) + "]"
# CRC-32 from its definition: the table of all bytes, then one step per byte.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, step: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS t)"""


def _encoding(source: str, keys: str, text: str, vocab_size: int, max_length: int) -> str:
    """CTEs ``coded`` (token, token_id) of all tokens and ``encoded`` (keys, ids)."""
    count = len(SPECIAL_TOKENS)
    return f"""{_CRC_TABLE},
split AS (SELECT {keys}, {_pieces(text)} AS pieces FROM {source}),
distinct_tokens AS (
  SELECT token, list_transform(range(octet_length(encode(token))),
    lambda i: CAST('0x' || substr(hex(encode(token)), 2 * i + 1, 2) AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT unnest(pieces) AS token FROM split)),
coded AS (
  SELECT token, CASE WHEN list_contains({_SPECIALS}, token) THEN list_position({_SPECIALS}, token) - 1
    ELSE xor(list_reduce(list_prepend(4294967295, bytes),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {vocab_size - count} + {count}
    END AS token_id
  FROM distinct_tokens, crc_table),
flat AS (
  SELECT {keys}, unnest(list_slice(pieces, 1, {max_length})) AS token,
    generate_subscripts(list_slice(pieces, 1, {max_length}), 1) AS i FROM split),
listed AS (
  SELECT {keys}, list(CAST(token_id AS BIGINT) ORDER BY i) AS ids FROM flat JOIN coded USING (token) GROUP BY ALL),
encoded AS (
  SELECT {keys}, coalesce(ids, []::BIGINT[]) AS ids FROM split LEFT JOIN listed USING ({keys}))"""


def _padded_ids(alias: str) -> str:
    ids = f"{alias}ids"
    return f"""md5(array_to_string({ids}, ' ')) AS tokens_md5, CAST(len({ids}) AS INTEGER) AS n_tokens,
  CASE WHEN len({ids}) = 0 THEN 0 ELSE {PAIR_MAX_LENGTH} - len({ids}) + 1 END AS first_token,
  CASE WHEN len({ids}) < {PAIR_MAX_LENGTH} THEN '1' ELSE '' END AS padding, {PAIR_MAX_LENGTH} AS length"""


def _label_columns(labels: str) -> str:
    kept = f"list_filter({labels}, lambda t: t <> -100)"
    return f"""md5(array_to_string({kept}, ' ')) AS labels_md5, CAST(len({kept}) AS INTEGER) AS n_labels,
  CAST(len({labels}) AS INTEGER) AS labels_length"""


def _masked(max_length: int) -> str:
    prompt = "coalesce(list_position(ids, 3), 0)"
    return (
        f"list_concat(list_resize([]::BIGINT[], {max_length} - len(ids) + {prompt}, -100),"
        f" list_slice(ids, {prompt} + 1, len(ids)))"
    )


def _labels(vocab_size: int, max_length: int) -> str:
    return f"""{_encoding("chats", "conv_id, turn", "chat", vocab_size, max_length)},
labels AS (SELECT conv_id, turn, {_masked(max_length)} AS labels FROM encoded)"""


_BATCHES = f"""SELECT doc_id, row_index, row_index // {SIMILARITY_BATCH} AS batch_id,
    CAST(row_index % {SIMILARITY_BATCH} AS INTEGER) AS slot
  FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('{SHUFFLE_SEED}-' || doc_id), doc_id) - 1 AS row_index
    FROM documents)"""


_PICTURES = _with(
    """pictures AS (
  SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 8 ELSE 4 END AS h, CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 4 END AS w,
    vec_id % 3 = 2 AS coloured, list_transform(embedding, lambda x: (CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT) % 256 + 256) % 256) AS d
  FROM embeddings WHERE vec_id % 13 <> 12)""",
    """pixels AS (
  SELECT vec_id, h, w, y, x, c, d[CASE WHEN coloured THEN (y * w + x) * 4 + 3 - c ELSE y * w + x + 1 END] AS p
  FROM pictures, range(8) a(y), range(16) b(x), range(3) e(c) WHERE y < h AND x < w)""",
    f"""shares AS (
  SELECT size, i, k, share / sum(share) OVER (PARTITION BY size, i) AS share FROM (
    SELECT size, i, k, greatest(0.0::DOUBLE, 1 - abs(k + 0.5::DOUBLE - (i + 0.5::DOUBLE) * size / {PICTURE_SIDE}) / greatest(size / {PICTURE_SIDE}, 1)) AS share
    FROM (VALUES (4), (8), (16)) s(size), range({PICTURE_SIDE}) a(i), range(16) b(k) WHERE k < size))""",
    """small AS (
  SELECT vec_id, c, r.i AS i, q.i AS j, CAST(CAST(sum(p * r.share * q.share) AS FLOAT) AS DOUBLE) AS value
  FROM pixels JOIN shares r ON r.size = h AND r.k = y JOIN shares q ON q.size = w AND q.k = x
  GROUP BY ALL)""",
)


def _one(expression: str, name: str, source: str) -> str:
    return f"{_SIMILARITY}SELECT round({expression}, 6) AS {name} FROM {source}"


def statements() -> dict[str, str]:
    top1 = "avg(CAST(top_pos = {} AS DOUBLE))"
    sql: dict[str, str] = {}

    sql["similarity_evaluation"] = f"""{_SIMILARITY}SELECT
  (SELECT round({top1.format(0)}, 6) FROM top) AS top1_first,
  (SELECT round({top1.format(1)}, 6) FROM top) AS top1_second,
  (SELECT round(avg(plain), 6) FROM rho) AS spearman,
  (SELECT round(avg(labeled), 6) FROM rho) AS spearman_labeled,
  (SELECT round(avg(ranks), 6) FROM rho) AS spearman_ranks,
  (SELECT round(avg(weighted), 6) FROM loss) AS pairwise_loss"""
    sql["candidate_similarity"] = (
        _with(_VECTORS, _SIM)
        + "SELECT group_id, CAST(pos AS INTEGER) AS pos, round(s, 6) AS score FROM sim"
    )
    sql["top_image"] = _SIMILARITY + "SELECT group_id, top_pos FROM top"
    sql["rank_candidates"] = (
        _SIMILARITY
        + "SELECT group_id, CAST(k AS INTEGER) AS rank, CAST(pos AS INTEGER) AS pos FROM ranked"
    )
    sql["top_image_accuracy"] = _one(top1.format(1), "top_image_accuracy", "top")
    sql["top_image_accuracy_first"] = _one(top1.format(0), "top_image_accuracy_first", "top")
    sql["spearman"] = _one("avg(plain)", "spearman", "rho")
    sql["spearman_labeled"] = _one("avg(labeled)", "spearman_labeled", "rho")
    sql["pairwise_loss"] = _one("avg(weighted)", "pairwise_loss", "loss")
    sql["pairwise_loss_unweighted"] = _one("avg(plain)", "pairwise_loss_unweighted", "loss")

    sql["target_logprob"] = (
        _with(_LOGITS, _log_probs("logits")) + "SELECT seq_id, pos, round(lp, 6) AS log_prob FROM scored"
    )
    sql["perplexity"] = _with(_LOGITS, _log_probs("logits")) + _PERPLEXITY
    sql["perplexity_shifted"] = _with(_LOGITS, _SHIFTED, _log_probs("shifted")) + _PERPLEXITY
    sql["perplexity_streamed"] = sql["perplexity"].replace("AS perplexity", "AS perplexity_streamed")
    sql["perplexity_strict"] = _with(_LOGITS, _log_probs("logits")) + """SELECT
  CASE WHEN count(*) FILTER (m IS NULL) > 0 THEN 'NaN'::DOUBLE ELSE round(exp(-avg(m)), 6) END AS perplexity_strict
FROM (SELECT avg(lp) AS m FROM scored GROUP BY seq_id)"""
    moved = """rows AS (
  SELECT vec_id AS seq_id, unnest(range(8)) AS pos, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
plain AS (
  SELECT seq_id, pos, list_transform(list_slice(e, pos * 8 + 1, pos * 8 + 8), lambda x: x * 10) AS l,
    CASE WHEN (seq_id + pos) % 5 = 0 THEN -100 ELSE (label + pos) % 8 END AS target FROM rows),
moved AS (
  SELECT seq_id, pos, l, next AS target FROM (
    SELECT *, lead(target) OVER (PARTITION BY seq_id ORDER BY pos) AS next FROM plain) WHERE pos < 7)"""
    both = ", ".join(
        f"(SELECT round(exp(-avg(m)), 6) FROM (SELECT avg(lp) AS m FROM {name} GROUP BY seq_id)) AS {alias}"
        for name, alias in (("scored", "perplexity_rows"), ("scored_moved", "perplexity_rows_shifted"))
    )
    sql["perplexity_sequences"] = _with(
        moved, _log_probs("plain"), _log_probs("moved").replace("scored AS", "scored_moved AS", 1)
    ) + f"SELECT {both}"
    sql["greedy_decode"] = (
        _with(_LOGITS)
        + "SELECT seq_id, pos, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS token_id FROM logits"
    )

    sql["extract_tags"] = _ANSWERS + (
        f"SELECT id, md5({_tag('prediction', 'reasoning')}) AS reasoning_md5,"
        " pred_output AS output FROM outputs"
    )
    sql["extract_image_choice"] = _ANSWERS + "SELECT id, pred_image, label_image FROM images"
    full = _strip("replace({}, '</s>', '')")
    sql["strip_ignore_token"] = _ANSWERS + (
        f"SELECT id, md5({full.format('prediction')}) AS full_md5,"
        f" CAST(length({full.format('prediction')}) AS INTEGER) AS full_chars FROM generations"
    )
    sql["generation_accuracy"] = _ANSWERS + """SELECT round(coalesce(
  count(*) FILTER (pred_image = label_image) / nullif(count(*), 0), 0.0), 6) AS generation_accuracy
FROM images WHERE NOT (pred_image = -1 AND label_image = -1)"""
    sql["generation_analysis"] = _ANSWERS + f"""SELECT id,
  md5({full.format("prediction")}) AS full_prediction, md5({full.format("label")}) AS full_label,
  md5({_tag("prediction", "reasoning")}) AS pred_reasoning, md5({_tag("label", "reasoning")}) AS label_reasoning,
  pred_output, CASE WHEN json_valid(label_output) AND said NOT IN (1, 2, 3, 5) THEN label_output ELSE '' END AS label_output,
  CASE WHEN json_valid(pred_output) THEN pred_output ELSE '{{}}' END AS pred_json,
  CASE WHEN json_valid(label_output) THEN label_output END AS label_json,
  pred_image, label_image
FROM images"""

    sql["analysis_csv"] = f"""SELECT row_number() OVER (ORDER BY id) - 1 AS row_index, *, CAST(NULL AS VARCHAR) AS _corrupt
FROM ({sql["generation_analysis"]})"""
    long = " UNION ALL ".join(
        f"SELECT id, {i} AS idx, md5({c}) AS prompt_md5, md5({c}) AS image_md5 FROM records"
        for i, c in zip(CANDIDATE_NUMBERS, PROMPT_COLUMNS)
    )
    sql["candidates_long"] = _with(_RECORDS) + long
    sql["candidates_shuffled"] = (
        _with(_RECORDS, _PLACED) + "SELECT id, pos, idx, md5(prompt) AS prompt_md5 FROM placed"
    )
    hashed_prompts = [f"md5({c}) AS {c}_md5" for c in PROMPT_COLUMNS]
    hashed_images = [f"md5({p}) AS {m}_md5" for p, m in zip(PROMPT_COLUMNS, IMAGE_COLUMNS)]
    sql["candidates_wide"] = _with(_RECORDS, _PLACED, _SHUFFLED) + (
        f"SELECT id, correct_image, {', '.join(hashed_prompts + hashed_images)} FROM shuffled"
    )
    sql["candidates_reordered"] = sql["candidates_wide"]
    sql["correct_image"] = (
        _with(_RECORDS, _PLACED, _SHUFFLED)
        + "SELECT id, candidate_order, correct_image FROM shuffled"
    )
    sql["render_generation_prompt"] = _with(_RECORDS, _PLACED, _SHUFFLED, _PROMPTED) + (
        "SELECT id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS prompt_chars FROM prompted"
    )
    sql["split_reply"] = (
        _with(_REPLIES) + "SELECT doc_id, ok, md5(reasoning) AS reasoning_md5, output FROM parts"
    )
    sql["route_outcomes"] = _with(_REPLIES) + (
        "SELECT doc_id, md5(reasoning) AS reasoning_md5, md5(output) AS output_md5,"
        " CASE WHEN ok THEN 'ok' ELSE 'malformed reply' END AS route FROM parts"
    )
    sql["retry_failed_only"] = (
        "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents"
        " WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)"
    )
    assembled_prompts = [f"md5(s.{c}) AS {c}" for c in PROMPT_COLUMNS]
    assembled_images = [f"md5(s.{p}) AS {m}" for p, m in zip(PROMPT_COLUMNS, IMAGE_COLUMNS)]
    sql["sft_dataset_assemble"] = _with(_RECORDS, _PLACED, _SHUFFLED) + f"""SELECT
  id, language, compound, sentence_type, md5(sentence) AS sentence, style, s.correct_image,
  {", ".join(assembled_prompts + assembled_images)},
  md5('<reasoning>' || sentence || '</reasoning>') AS reasoning,
  '<output>{{"Image": "' || s.correct_image || '"}}</output>' AS output,
  CASE WHEN language = 'de' THEN 'test' ELSE 'train' END AS split
FROM records JOIN shuffled s USING (id)"""
    sql["training_view"] = _with(_RECORDS, _PLACED, _SHUFFLED) + """SELECT id, md5(sentence) AS sentence,
  s.correct_image, '<output>{"Image": "' || s.correct_image || '"}</output>' AS output
FROM records JOIN shuffled s USING (id) WHERE language IS DISTINCT FROM 'de'"""
    sql["bucketed_join"] = _with(_RECORDS, _PLACED, _SHUFFLED) + """SELECT id, md5(sentence) AS sentence, s.correct_image,
  CAST(s.correct_image % 5 + 1 AS INTEGER) AS answer, CASE WHEN id % 2 = 1 THEN true END AS late
FROM records JOIN shuffled s USING (id) WHERE language IS DISTINCT FROM 'de'"""
    sql["generate_sft"] = _with(_RECORDS, _PLACED, _SHUFFLED, _PROMPTED) + """SELECT id, correct_image,
  CASE WHEN h[1] NOT IN ('0', '1') THEN '<reasoning>' || h || '</reasoning>' END AS reasoning,
  CASE WHEN h[1] NOT IN ('0', '1') THEN '<output>' || chr(10) || chr(10) || '<output>' || chr(10) || '{"Image": "'
    || CAST(CAST('0x' || h[2] AS BIGINT) % 5 + 1 AS VARCHAR) || '"}' || chr(10) || '</output>' END AS output,
  CASE h[1] WHEN '0' THEN 'ValueError: refused' WHEN '1' THEN 'malformed reply' END AS error
FROM (SELECT id, correct_image, md5(prompt) AS h FROM prompted)"""
    sql["generate_resumed"] = sql["generate_sft"]
    sql["generate_with_retries"] = sql["generate_sft"].replace(
        "AS error\nFROM", "AS error,\n  CASE h[1] WHEN '0' THEN 3 WHEN '2' THEN 2 ELSE 1 END AS attempts\nFROM"
    )
    sql["snapshot_records"] = _with(_RECORDS, _PLACED, _SHUFFLED) + """SELECT id, s.correct_image, md5(sentence) AS sentence,
  '<output>{"Image": "' || s.correct_image || '"}</output>' AS output, CAST(2 AS INTEGER) AS version
FROM records JOIN shuffled s USING (id)"""
    sql["failed_ledger"] = """WITH tried AS (
  SELECT user_id AS id, event_id AS attempt, CASE WHEN event_type = 'error' THEN 'timeout' END AS error FROM events
  UNION ALL SELECT doc_id, -1, 'failed before' FROM labels WHERE quality = 0)
SELECT id, error FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempt DESC) AS k FROM tried)
WHERE k = 1 AND error IS NOT NULL"""
    sql["batched_map"] = """SELECT doc_id, lang,
  CAST(len(regexp_extract_all(text, '[aeiou]')) AS INTEGER) AS n_vowels,
  CAST(len(regexp_extract_all(text, '[0-9]')) AS INTEGER) AS n_digits FROM documents"""

    user = _replace_all(
        _quote(prompts.TRAINING_TEMPLATE),
        [(prompts.SENTENCE, "reply")] + [(slot, "'[IMG]'") for slot in prompts.IMAGE_SLOTS],
    )
    prefix = "'<output>' || chr(10) || chr(10)"
    assistant = (
        f"reasoning || chr(10) || chr(10) || CASE WHEN starts_with(output, {prefix})"
        " THEN substr(output, 11) ELSE output END"
    )
    sql["format_training_pair"] = _with(_REPLIES) + f"""SELECT doc_id,
  md5(u) AS user_md5, CAST(length(u) AS INTEGER) AS user_chars,
  md5(a) AS assistant_md5, CAST(length(a) AS INTEGER) AS assistant_chars
FROM (SELECT doc_id, {user} AS u, {assistant} AS a FROM parts)"""
    sql["chat_messages"] = _with(_EXCHANGES) + """SELECT conv_id, turn, false AS generation, md5(chat) AS chat_md5 FROM chats
UNION ALL SELECT conv_id, turn, true AS generation, md5(open_chat) AS chat_md5 FROM chats"""
    sql["tokenize_pad"] = _with(
        _encoding("documents", "doc_id", "text", TOKENIZER.vocab_size, PAIR_MAX_LENGTH)
    ) + f"SELECT doc_id, {_padded_ids('')} FROM encoded"
    sql["mask_labels"] = _with(_EXCHANGES, _labels(TOKENIZER.vocab_size, PAIR_MAX_LENGTH)) + (
        f"SELECT conv_id, turn, {_label_columns('labels')} FROM labels"
    )
    filled = _replace_all(
        _quote(prompts.TRAINING_TEMPLATE),
        [(prompts.SENTENCE, "sentence")] + [(slot, "'[IMG]'") for slot in prompts.IMAGE_SLOTS],
    )
    texts = f"""answers AS (
  SELECT id, sentence, '<reasoning>' || sentence || '</reasoning>' || chr(10) || chr(10)
    || '<output>{{"Image": "' || s.correct_image || '"}}</output>' AS answer
  FROM records JOIN shuffled s USING (id)),
texts AS (
  SELECT id, 'train' AS kind, '[INST]' || {filled} || '[/INST]' || answer || '</s>' AS body FROM answers
  UNION ALL SELECT id, 'open', '[INST]' || {filled} || '[/INST]<reasoning>' FROM answers
  UNION ALL SELECT id, 'answer', answer FROM answers)"""
    sql["pair_rows"] = _with(
        _RECORDS,
        _PLACED,
        _SHUFFLED,
        texts,
        _encoding("texts", "id, kind", "body", TOKENIZER.vocab_size, PAIR_MAX_LENGTH),
    ) + f"""SELECT id, false AS generation, {_padded_ids("")}, {_label_columns("labels")}
FROM (SELECT id, ids, {_masked(PAIR_MAX_LENGTH)} AS labels FROM encoded WHERE kind = 'train')
UNION ALL
SELECT o.id, true AS generation, {_padded_ids("o.")}, {_label_columns("labels")}
FROM encoded o JOIN (
  SELECT id, list_concat(list_resize([]::BIGINT[], {PAIR_MAX_LENGTH} - len(ids), 1), ids) AS labels
  FROM encoded WHERE kind = 'answer') a USING (id)
WHERE o.kind = 'open'"""
    sql["similarity_rows"] = _with(
        _RECORDS,
        _encoding("records", "id", "sentence", TOKENIZER.vocab_size, SIMILARITY_MAX_LENGTH),
    ) + f"""SELECT id,
  array_to_string(list_concat(ids, list_resize([]::BIGINT[], {SIMILARITY_MAX_LENGTH} - len(ids), 1)), ' ') AS input_ids,
  array_to_string(list_concat(list_resize([]::BIGINT[], len(ids), 1),
    list_resize([]::BIGINT[], {SIMILARITY_MAX_LENGTH} - len(ids), 0)), ' ') AS attention_mask
FROM encoded"""
    specials = " UNION ALL ".join(
        f"SELECT {i} AS token_id, {_quote(t)} AS token" for i, t in enumerate(SPECIAL_TOKENS)
    )
    sql["decode_tokens"] = _with(_EXCHANGES, _labels(TOKENIZER.vocab_size, PAIR_MAX_LENGTH)) + f""", vocabulary AS (
  SELECT token_id, min(token) AS token FROM coded WHERE token_id >= {len(SPECIAL_TOKENS)} GROUP BY 1
  UNION ALL {specials}),
places AS (SELECT conv_id, turn, unnest(labels) AS token_id, generate_subscripts(labels, 1) AS i FROM labels)
SELECT conv_id, turn, md5(decoded) AS decoded_md5, CAST(length(decoded) AS INTEGER) AS decoded_chars
FROM (SELECT conv_id, turn,
    string_agg(CASE WHEN p.token_id = -100 THEN '</s>' ELSE v.token END, ' ' ORDER BY i) AS decoded
  FROM places p LEFT JOIN vocabulary v USING (token_id) GROUP BY 1, 2)"""
    sql["answer_chain"] = _ANSWERS + """SELECT round(coalesce(
  count(*) FILTER (pred_image = label_image AND NOT (pred_image = -1 AND label_image = -1))
    / nullif(count(*) FILTER (NOT (pred_image = -1 AND label_image = -1)), 0), 0.0), 6) AS answer_chain,
  CAST(sum(length(prediction)) AS BIGINT) AS spoken_chars,
  bit_xor(CAST('0x' || md5(prediction)[:15] AS BIGINT)) AS spoken_digest
FROM images"""
    sql["subword_round_trip"] = "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS chars FROM documents"
    answer = _strip("replace(assistant_text, '</s>', '')")
    sql["subword_answers"] = _with(_EXCHANGES) + f"""SELECT conv_id, turn,
  md5({answer}) AS answer_md5, CAST(length({answer}) AS INTEGER) AS answer_chars FROM exchanges"""
    # The embedder's counts, word by word: 64 classes by the CRC-32 of lower-cased words.
    sql["embed_similarity"] = _with(
        _CRC_TABLE,
        """spoken AS (
  SELECT doc_id, word, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\\s\\x{00a0}\\x{0085}\\x1c-\\x1f]+')) AS word FROM documents)
  WHERE word <> '' GROUP BY ALL)""",
        """distinct_words AS (
  SELECT word, list_transform(range(octet_length(encode(word))),
    lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT word FROM spoken))""",
        """classes AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, bytes),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 64 AS k FROM distinct_words, crc_table)""",
        """counted AS (SELECT doc_id, k, CAST(sum(n) AS DOUBLE) AS n FROM spoken JOIN classes USING (word) GROUP BY ALL)""",
        """lists AS (SELECT doc_id, list(k ORDER BY k) AS ks, list(n ORDER BY k) AS ns FROM counted GROUP BY 1)""",
        """vectors AS (
  SELECT doc_id // 6 AS group_id, doc_id % 6 AS place, NULL::INTEGER AS label, list_transform(range(64),
    lambda i: CASE WHEN list_position(ks, i) IS NULL THEN 0.0 ELSE ns[list_position(ks, i)] END) AS v
  FROM documents LEFT JOIN lists USING (doc_id))""",
        _SIM, _RANKED, _TOP, _RHO, _LOSS,
    ) + f"""SELECT (SELECT round({top1.format(0)}, 6) FROM top) AS top_image_accuracy,
  (SELECT round(avg(plain), 6) FROM rho) AS spearman, (SELECT round(avg(weighted), 6) FROM loss) AS pairwise_loss"""
    sql["token_length_profile"] = f"""SELECT lang, count(*) AS n_rows, CAST(max(n) AS INTEGER) AS max_tokens,
  round(quantile_cont(n, 0.5), 6) AS p50_tokens, round(quantile_cont(n, 0.95), 6) AS p95_tokens
FROM (SELECT lang, CAST(len({_pieces("text")}) AS DOUBLE) AS n FROM documents) GROUP BY lang"""
    sql["merged_length_profile"] = f"""SELECT lang, count(*) AS n_rows, CAST(max(n) AS BIGINT) AS max_tokens,
  true AS p50_within_1_percent, true AS p95_within_1_percent
FROM (SELECT lang, len({_pieces("text")}) AS n FROM documents) GROUP BY lang"""
    sql["assign_batches"] = _BATCHES
    sql["limit_batches"] = f"SELECT * FROM ({_BATCHES}) WHERE batch_id < 3"
    sql["collate_batches"] = _with(_VECTORS) + f""", ordered AS (
  SELECT group_id, row_number() OVER (ORDER BY md5('{SHUFFLE_SEED}-' || group_id), group_id) - 1 AS i
  FROM (SELECT DISTINCT group_id FROM vectors)),
stacked AS (
  SELECT i // {MAP_BATCH} AS batch_id, i % {MAP_BATCH} AS slot, o.group_id,
    list(label ORDER BY place) FILTER (place > 0) AS gold,
    list(list_sum(v) ORDER BY place) FILTER (place > 0) AS sums
  FROM ordered o JOIN vectors USING (group_id) GROUP BY 1, 2, 3)
SELECT batch_id, CAST(count(*) AS INTEGER) AS batch_rows,
  string_agg(CAST(group_id AS VARCHAR), ',' ORDER BY slot) AS group_ids,
  array_to_string(flatten(list(gold ORDER BY slot)), ',') AS gold_labels,
  CAST(sum(len(sums)) AS INTEGER) AS n_vectors,
  array_to_string(list_transform(flatten(list(sums ORDER BY slot)), lambda s: CAST(round(s * 10000) AS BIGINT)), ',') AS vector_sums
FROM stacked GROUP BY batch_id"""
    sql["resized_pictures"] = _PICTURES + f"""SELECT vec_id, NULL AS image_error, CAST(c * {PICTURE_SIDE**2} + i * {PICTURE_SIDE} + j AS INTEGER) AS at, round(value, 3) AS value FROM small
UNION ALL SELECT vec_id, 'undecodable image', NULL, NULL FROM embeddings WHERE vec_id % 13 = 12"""
    sql["picture_sizes"] = """SELECT vec_id, ['png', 'jpeg', 'webp', 'webp', 'webp', NULL, NULL][vec_id % 7 + 1] AS kind,
  CASE WHEN vec_id % 7 < 5 THEN CAST(1 + vec_id % 700 AS INTEGER) END AS width,
  CASE WHEN vec_id % 7 < 5 THEN CAST(1 + label AS INTEGER) END AS height FROM embeddings"""
    sql["picture_headers"] = f"""SELECT vec_id, kind, width, height, coalesce(least(width, height) >= 3, false) AS usable
FROM ({sql["picture_sizes"]}) WHERE vec_id % 6 = 0"""
    sql["collate_pictures"] = _PICTURES + f""", ordered AS (
  SELECT vec_id, row_number() OVER (ORDER BY md5('{SHUFFLE_SEED}-' || vec_id), vec_id) - 1 AS n FROM embeddings),
per_picture AS (SELECT vec_id, count(*) AS pixels, sum(CAST(round(value * 100) AS BIGINT)) AS total FROM small GROUP BY 1)
SELECT n // {MAP_BATCH} AS batch_id, CAST(count(*) AS INTEGER) AS batch_rows, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY n) AS vec_ids,
  CAST(count(pixels) AS INTEGER) AS n_pictures, CAST(coalesce(sum(pixels), 0) AS INTEGER) AS n_pixels, CAST(coalesce(sum(total), 0) AS BIGINT) AS pixel_sum
FROM ordered LEFT JOIN per_picture USING (vec_id) GROUP BY 1"""
    crc = "xor(list_reduce(list_prepend(4294967295, {}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    text_bytes = "list_transform(range(octet_length(encode({0}))), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))"
    pixels = ", ".join(crc.format(text_bytes.format(f"coalesce({c}, '')")) for c in PROMPT_COLUMNS)
    sql["collate_token_rows"] = _with(
        _RECORDS,
        _encoding("records", "id", "sentence", TOKENIZER.vocab_size, SIMILARITY_MAX_LENGTH),
    ) + f""", ordered AS (
  SELECT id, row_number() OVER (ORDER BY md5('{SHUFFLE_SEED}-' || id), id) - 1 AS i FROM records),
padded AS (
  SELECT i // {MAP_BATCH} AS batch_id, i, id, [{pixels}] AS pixels,
    list_concat(ids, list_resize([]::BIGINT[], {SIMILARITY_MAX_LENGTH} - len(ids), 1)) AS input_ids,
    list_concat(list_resize([]::BIGINT[], len(ids), 1), list_resize([]::BIGINT[], {SIMILARITY_MAX_LENGTH} - len(ids), 0)) AS attention_mask
  FROM ordered JOIN records USING (id) JOIN encoded USING (id), crc_table)
SELECT batch_id, CAST(count(*) AS INTEGER) AS batch_rows, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS ids,
  md5(array_to_string(flatten(list(input_ids ORDER BY i)), ' ')) AS input_ids_md5,
  md5(array_to_string(flatten(list(attention_mask ORDER BY i)), ' ')) AS attention_mask_md5,
  md5(array_to_string(flatten(list(pixels ORDER BY i)), ' ')) AS pixels_md5
FROM padded GROUP BY batch_id"""

    sql["metric_log"] = """WITH epochs AS (
  SELECT event_type AS run_id, CAST(day(ts) AS INTEGER) AS epoch, avg(value) AS loss, count(value) AS steps
  FROM events GROUP BY 1, 2)
SELECT run_id, 'train' AS split, epoch, 'epoch_loss' AS metric, round(loss, 6) AS value FROM epochs
UNION ALL
SELECT run_id, 'train' AS split, epoch, 'steps' AS metric, CAST(steps AS DOUBLE) AS value FROM epochs"""

    versions = """versions AS (
  SELECT 'before' AS run_id, group_id, place, v, label FROM vectors
  UNION ALL
  SELECT 'after' AS run_id, c.group_id, c.place,
    CASE WHEN c.place = 1 THEN list_transform(list_zip(t.v, c.v), lambda p: (p[1] + p[2]) / 2) ELSE c.v END AS v,
    c.label
  FROM vectors c JOIN vectors t ON t.group_id = c.group_id AND t.place = 0),
vectors2 AS (SELECT run_id || '-' || group_id AS group_id, run_id, place, v, label FROM versions)"""
    renamed = [
        part.replace("FROM vectors t JOIN vectors c", "FROM vectors2 t JOIN vectors2 c")
        for part in (_SIM, _RANKED, _TOP, _RHO, _LOSS)
    ]
    sides = " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, split_part(group_id, '-', 1) AS run_id, {value} AS value FROM {source} GROUP BY 2"
        for metric, value, source in (
            ("top_image_accuracy", top1.format(0), "top"),
            ("spearman", "avg(plain)", "rho"),
            ("pairwise_loss", "avg(weighted)", "loss"),
        )
    )
    sql["compare_runs"] = _with(_VECTORS, versions, *renamed, f"sides AS ({sides})") + """SELECT 'test' AS split, b.metric,
  round(b.value, 6) AS before, round(a.value, 6) AS after, round(a.value - b.value, 6) AS change
FROM sides b JOIN sides a USING (metric) WHERE b.run_id = 'before' AND a.run_id = 'after'"""

    in_order = f"""ordered AS (
  SELECT group_id, (row_number() OVER (ORDER BY group_id) - 1) // {MAP_BATCH} AS batch_id
  FROM (SELECT DISTINCT group_id FROM vectors))"""
    sums = " UNION ALL ".join(
        f"SELECT batch_id, '{metric}' AS metric, round(coalesce(sum({value}), 0), 6) AS total,"
        f" CAST(count({value}) AS DOUBLE) AS weight FROM ordered JOIN {source} USING (group_id) GROUP BY 1"
        for metric, value, source in (
            ("top_image_accuracy", "CAST(top_pos = 0 AS DOUBLE)", "top"),
            ("spearman", "plain", "rho"),
            ("pairwise_loss", "weighted", "loss"),
        )
    )
    sql["metric_partials"] = _with(_VECTORS, _SIM, _RANKED, _TOP, _RHO, _LOSS, in_order) + sums
    sql["merged_metrics"] = _SIMILARITY + " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, round({value}, 6) AS value FROM {source}"
        for metric, value, source in (
            ("top_image_accuracy", top1.format(0), "top"),
            ("spearman", "avg(plain)", "rho"),
            ("pairwise_loss", "avg(weighted)", "loss"),
        )
    )
    sql["replayed_metrics"] = _SIMILARITY + " UNION ALL ".join(
        f"SELECT '{run}' AS run_id, '{metric}' AS metric, round({value}, 6) AS value FROM {source} WHERE group_id >= {first}"
        for run, first in (("whole", 0), ("reset", MAP_BATCH))
        for metric, value, source in (
            ("top_image_accuracy", top1.format(0), "top"),
            ("spearman", "avg(plain)", "rho"),
            ("pairwise_loss", "avg(weighted)", "loss"),
        )
    )
    return sql
