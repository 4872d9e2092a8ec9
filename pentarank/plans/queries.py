"""One query per operator, over whole tables.

Each takes ``(spark, sf_dir)``. Long texts and arrays leave as md5 so that results stay
small to compare while every character and element counts.
"""

from __future__ import annotations

import hashlib
import re
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pentarank.functions import pictures, prompts, subwords, text, tokens, vectors
from pentarank.operators import (
    analysis,
    assembly,
    batching,
    candidates,
    generation,
    images,
    lengths,
    mapping,
    metrics,
    preparation,
    routing,
    runs,
)
from pentarank.plans import inputs
from pentarank.schemas import (
    IGNORE_INDEX,
    IMAGE_COLUMNS,
    MAP_BATCH,
    PAIR_MAX_LENGTH,
    PROMPT_COLUMNS,
    SIMILARITY_BATCH,
    SIMILARITY_MAX_LENGTH,
)
from pentarank.session import shared_folder
from pentarank.sources import datasets, images as image_files, ledger, partials, reports, snapshots
from pentarank.streaming import generation as resumable, running, sequences

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = tokens.HashTokenizer()
SCORES = "scores"
HEX_TOKENIZER = subwords.HexTokenizer()
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FAILED_EVENT = "error"
PICTURE_SIDE = 3
STREAM_START = 1_700_000_000


def _md5(value: Column | str) -> Column:
    return F.md5(F.col(value) if isinstance(value, str) else value)


def _array_md5(value: Column | str) -> Column:
    return F.md5(F.array_join(value, " "))


def _padded_ids(fixed: str) -> list[Column]:
    """What a left-padded row holds: its tokens, how many, where they start, the padding."""
    ids, mask = F.col(f"{fixed}input_ids"), F.col(f"{fixed}attention_mask")
    count = F.size(F.array_remove(mask, 0))
    start = F.size(ids) - count
    padding = F.array_distinct(F.slice(ids, 1, start))
    return [
        _array_md5(F.slice(ids, start + 1, count)).alias("tokens_md5"),
        count.alias("n_tokens"),
        F.array_position(mask, F.lit(1)).alias("first_token"),
        F.array_join(padding, " ").alias("padding"),
        F.size(ids).alias("length"),
    ]


def _label_columns(labels: str) -> list[Column]:
    kept = F.array_remove(labels, IGNORE_INDEX)
    return [
        _array_md5(kept).alias("labels_md5"),
        F.size(kept).alias("n_labels"),
        F.size(labels).alias("labels_length"),
    ]


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- similarity evaluation -------------------------------------------------


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = inputs.candidate_vectors(spark, sf_dir)
    return groups.select(
        "group_id", "gold", vectors.cosine_scores("text_vec", "image_vecs").alias(SCORES)
    )


def similarity_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: all similarity metrics of one scoring pass."""
    wanted = [
        metrics.top_image_accuracy(label=0, name="top1_first"),
        metrics.top_image_accuracy(label=1, name="top1_second"),
        metrics.spearman(),
        metrics.spearman(gold="gold", name="spearman_labeled"),
        metrics.spearman(gold="gold", method="ranks", name="spearman_ranks"),
        metrics.pairwise_loss(),
    ]
    result = metrics.evaluate(scored(spark, sf_dir), wanted)
    return _rounded(result, *result.columns)


def candidate_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = scored(spark, sf_dir).select("group_id", F.posexplode(SCORES).alias("pos", "score"))
    return _rounded(long, "score")


def top_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("group_id", vectors.argmax(SCORES).alias("top_pos"))


def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.posexplode(vectors.argsort(SCORES)).alias("rank", "pos")
    return scored(spark, sf_dir).select("group_id", order)


def _one_metric(metric: Callable[[], metrics.Metric]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = metric()
        return _rounded(metrics.evaluate(scored(spark, sf_dir), [made]), made.name)

    return query


# --- likelihood ------------------------------------------------------------


def target_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.logits(spark, sf_dir)
    return rows.select(
        "seq_id", "pos", F.round(vectors.target_log_prob("logits", "target"), 6).alias("log_prob")
    )


def _perplexity(token_rows: DataFrame) -> DataFrame:
    means = metrics.sequence_log_probs(token_rows, skip_empty=True)
    return _rounded(metrics.evaluate(means, [metrics.perplexity()]), "perplexity")


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _perplexity(inputs.logits(spark, sf_dir))


def perplexity_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the default rule: one fully padded sequence makes the whole NaN."""
    means = metrics.sequence_log_probs(inputs.logits(spark, sf_dir))
    result = metrics.evaluate(means, [metrics.perplexity(name="perplexity_strict")])
    return _rounded(result, "perplexity_strict")


def perplexity_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences held in one row each, as they are and shifted: no exchange of logits."""
    rows = inputs.logit_sequences(spark, sf_dir)
    scored_rows = rows.select(
        vectors.mean_log_prob("logits", "targets").alias("plain"),
        vectors.mean_log_prob("logits", "targets", shift=True).alias("moved"),
    )
    wanted = [metrics.perplexity("plain", "perplexity_rows"), metrics.perplexity("moved", "perplexity_rows_shifted")]
    return _rounded(metrics.evaluate(scored_rows, wanted), *[m.name for m in wanted])


def perplexity_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that arrive in three pieces a sequence, one of them twice; state is kept by sequence.

    Each piece is written after the one before and read as batches of its own; a mark at the end
    moves the time past everything, which closes what is open.
    """
    folder = _fresh(spark, "token-pieces")
    rows = inputs.logits(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(STREAM_START) + F.col("pos") % 3 * 60))
    files = len(rows.inputFiles())
    for piece in (0, 1, 2, 1):
        part = rows.filter(F.col("pos") % 3 == piece).repartition(files, "seq_id")
        part.write.mode("append").parquet(f"{folder}/in")
    ddl = "seq_id long, pos int, logits array<double>, target int, ts timestamp"
    end = spark.range(1).selectExpr("cast(null as long) seq_id", "0 pos", "cast(null as array<double>) logits", "0 target", f"timestamp_seconds({STREAM_START} + 86400) ts")
    end.write.mode("append").parquet(f"{folder}/in")
    sums = sequences.sequence_sums(sequences.token_stream(spark, f"{folder}/in", ddl, files))
    # Few sequences of eight tokens: eight tasks of state for each file that they came in.
    sequences.store_sequence_sums(sums, f"{folder}/out", f"{folder}/state", 8 * files).awaitTermination()
    result = running.accumulated_perplexity(spark, f"{folder}/out", skip_empty=True)
    return _rounded(result.withColumnRenamed("perplexity", "perplexity_streamed"), "perplexity_streamed")


def perplexity_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _perplexity(metrics.shift_targets(inputs.logits(spark, sf_dir)))


def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.logits(spark, sf_dir)
    best = F.get(tokens.greedy_ids(F.array("logits")), F.lit(0))
    return rows.select("seq_id", "pos", best.alias("token_id"))


# --- tagged answers --------------------------------------------------------


def extract_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.generations(spark, sf_dir).select(
        "id",
        _md5(text.extract_tag("prediction", text.REASONING_TAG)).alias("reasoning_md5"),
        text.extract_tag("prediction", text.OUTPUT_TAG).alias("output"),
    )


def extract_image_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = analysis.image_pairs(inputs.generations(spark, sf_dir))
    return pairs.select("id", "pred_image", "label_image")


def strip_ignore_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = text.strip_ignore_token("prediction")
    return inputs.generations(spark, sf_dir).select(
        "id", _md5(stripped).alias("full_md5"), F.length(stripped).alias("full_chars")
    )


def generation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = analysis.image_pairs(inputs.generations(spark, sf_dir))
    result = metrics.evaluate(pairs, [metrics.generation_accuracy()])
    return _rounded(result, "generation_accuracy")


def generation_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = analysis.analysis_table(inputs.generations(spark, sf_dir))
    hashed = ("full_prediction", "full_label", "pred_reasoning", "label_reasoning")
    return table.withColumns({c: _md5(c) for c in hashed})


# --- building fine-tuning data ---------------------------------------------


def candidates_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = candidates.candidates_long(inputs.records(spark, sf_dir))
    return long.select(
        "id", "idx", _md5("prompt").alias("prompt_md5"), _md5("image").alias("image_md5")
    )


def candidates_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = candidates.candidates_shuffled(inputs.records(spark, sf_dir))
    return long.select("id", "pos", "idx", _md5("prompt").alias("prompt_md5"))


def candidates_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shuffled long form turned wide again."""
    long = candidates.candidates_shuffled(inputs.records(spark, sf_dir))
    return _wide_md5(candidates.candidates_wide(long))


def candidates_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within the row, without an exchange."""
    return _wide_md5(candidates.shuffle_candidates(inputs.records(spark, sf_dir)))


def _wide_md5(wide: DataFrame) -> DataFrame:
    hashed = [_md5(c).alias(f"{c}_md5") for c in PROMPT_COLUMNS + IMAGE_COLUMNS]
    return wide.select("id", "correct_image", *hashed)


def correct_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = candidates.shuffled_order()
    return inputs.records(spark, sf_dir).select(
        "id",
        F.array_join(order, ",").alias("candidate_order"),
        candidates.correct_position(order).alias("correct_image"),
    )


def render_generation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompted = generation.prepare_prompts(inputs.records(spark, sf_dir))
    return prompted.select(
        "id", _md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars")
    )


def split_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = inputs.replies(spark, sf_dir).withColumn("parts", text.split_reply("reply"))
    return parts.select(
        "doc_id",
        F.col("parts").isNotNull().alias("ok"),
        _md5("parts.reasoning").alias("reasoning_md5"),
        F.col("parts.output").alias("output"),
    )


def route_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = inputs.replies(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    folder = _fresh(spark, "outcomes")
    ok, failed = routing.route_outcomes(generation.split_replies(replies), folder)
    columns = ["doc_id", _md5("reasoning").alias("reasoning_md5"), _md5("output").alias("output_md5")]
    good = ok.select(*columns, F.lit("ok").alias("route"))
    return good.unionByName(failed.select(*columns, F.col("error").alias("route")))


def retry_failed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged of low quality are the failed list."""
    documents = inputs.table(spark, sf_dir, "documents")
    failed = inputs.table(spark, sf_dir, "labels").filter(F.col("quality") == 0)
    again = routing.retry_failed_only(documents, failed, "doc_id")
    return again.select("doc_id", "lang", _md5("text").alias("text_md5"))


def _finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled records, each answered with its right image."""
    shuffled = candidates.shuffle_candidates(inputs.records(spark, sf_dir))
    answer = F.concat(F.lit('<output>{"Image": "'), F.col("correct_image"), F.lit('"}</output>'))
    reasoning = F.concat(F.lit("<reasoning>"), F.col("sentence"), F.lit(text.REASONING_CLOSER))
    return shuffled.withColumns({"reasoning": reasoning, "output": answer})


def sft_dataset_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German records form the test split; those without a language are for training."""
    dataset = assembly.conform_splits(_split_records(spark, sf_dir))
    hashed = ["sentence", *PROMPT_COLUMNS, *IMAGE_COLUMNS, "reasoning"]
    return dataset.withColumns({c: _md5(c) for c in hashed})


def _split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    german = F.coalesce(F.col("language") == "de", F.lit(False))
    split = F.when(german, "test").otherwise("train")
    return _finished(spark, sf_dir).withColumn("split", split)


def training_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training split, with the columns training reads."""
    dataset = assembly.select_split(assembly.conform_splits(_split_records(spark, sf_dir)), "train")
    view = assembly.training_view(dataset, ["id", "sentence", "correct_image", "output"])
    return view.withColumn("sentence", _md5("sentence"))


def _example_generator() -> generation.Generator:
    """Stand-in generator: the prompt's md5 decides on refusal, bad or good reply."""

    def reply(prompt: str) -> str:
        digest = hashlib.md5(prompt.encode()).hexdigest()
        if digest[0] == "0":
            raise ValueError("refused")
        if digest[0] == "1":
            return digest
        image = int(digest[1], 16) % 5 + 1
        return '<reasoning>%s</reasoning>\n\n<output>\n{"Image": "%d"}\n</output>' % (digest, image)

    return lambda batch: [reply(p) for p in batch]


def generate_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = generation.generate_sft(inputs.records(spark, sf_dir), _example_generator)
    return outcomes.select("id", "correct_image", "reasoning", "output", "error")


def _example_client() -> generation.Client:
    """Stand-in client of single prompts: some are always refused, some only the first time."""
    waiting, answer = threading.local(), _example_generator()

    def ask(prompt: str) -> str:
        if hashlib.md5(prompt.encode()).hexdigest()[0] == "2" and getattr(waiting, "prompt", None) != prompt:
            waiting.prompt = prompt
            raise TimeoutError("busy")
        waiting.prompt = None
        return answer([prompt])[0]

    return ask


def generate_with_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight requests at a time, and only failed prompts again."""
    outcomes = generation.generate_sft_one_by_one(inputs.records(spark, sf_dir), _example_client, backoff=0.0)
    return outcomes.select("id", "correct_image", "reasoning", "output", "error", "attempts")


def snapshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished records published in two snapshots; a third write breaks off halfway and leaves no trace."""
    path = _fresh(spark, "snapshots")
    records = _finished(spark, sf_dir).select("id", "correct_image", "sentence", "output")
    snapshots.write_snapshot(records.filter("id % 3 <> 0"), path)
    snapshots.write_snapshot(records.filter("id % 3 = 0"), path)
    broken = F.when(F.col("id") % 2 == 0, F.raise_error(F.lit("the write ends here")).cast("string")).otherwise(F.col("output"))
    try:
        snapshots.write_snapshot(records.withColumn("output", broken), path, mode="replace")
    except PySparkException as broke:
        if "the write ends here" not in str(broke):
            raise
    stored = snapshots.read_snapshot(spark, path)
    return stored.withColumn("sentence", _md5("sentence")).withColumn("version", F.lit(max(snapshots.versions(spark, path))))


def failed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do: an old list of failed ids and the log of all later attempts, folded by id.

    Documents of low quality are on the old list, one array to a file. Every event is an attempt at the user's number;
    those of one kind failed.
    """
    folder = _fresh(spark, "ledger")
    bad = inputs.table(spark, sf_dir, "labels").filter("quality = 0").groupBy((F.col("doc_id") % 8).alias("slot"))
    lists = bad.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.col("doc_id").cast("string")), ", "), F.lit("]")).alias("value"))
    lists.select("value", "slot").write.partitionBy("slot").text(f"{folder}/old")
    tried = inputs.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == FAILED_EVENT, F.lit("timeout")).alias("error")
    )
    ledger.append_events(tried, f"{folder}/log", F.col("attempt"))
    return ledger.remaining(ledger.read_events(spark, f"{folder}/log"), ledger.read_id_array(spark, f"{folder}/old").select("id"))


def generate_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation over record files that fails after its second snapshot and is taken up again."""
    folder = _fresh(spark, "generation")
    records = inputs.records(spark, sf_dir)
    records.repartition(4 * len(records.inputFiles()), "id").write.parquet(f"{folder}/in")

    def stop(batch_id: int) -> None:
        if batch_id == 1:
            raise RuntimeError("the run ends here")

    def run(on_snapshot=None) -> None:
        resumable.run_generation(
            spark, f"{folder}/in", f"{folder}/out", f"{folder}/progress", _example_generator,
            files_per_snapshot=len(records.inputFiles()), on_snapshot=on_snapshot, schema=records.schema,
        ).awaitTermination()

    try:
        run(stop)
    except StreamingQueryException:
        run()
    return resumable.all_outcomes(spark, f"{folder}/out").select("id", "correct_image", "reasoning", "output", "error")


def batched_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    vowels, digits = re.compile("[aeiou]"), re.compile("[0-9]")

    def count(batch: mapping.ListColumns) -> mapping.ListColumns:
        return {
            "n_vowels": [len(vowels.findall(t)) for t in batch["text"]],
            "n_digits": [len(digits.findall(t)) for t in batch["text"]],
        }

    documents = inputs.documents(spark, sf_dir).select("doc_id", "lang", "text")
    return mapping.batched_map(
        documents, count, "n_vowels int, n_digits int", ["text"], remove_columns=["text"]
    )


# --- preparing training rows -----------------------------------------------


def format_training_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one document as sentence and its reply split in two."""
    parts = inputs.replies(spark, sf_dir).withColumn("parts", text.split_reply("reply"))
    user = prompts.user_content(sentence="reply")
    assistant = prompts.assistant_content("parts.reasoning", "parts.output")
    return parts.select(
        "doc_id",
        _md5(user).alias("user_md5"),
        F.length(user).alias("user_chars"),
        _md5(assistant).alias("assistant_md5"),
        F.length(assistant).alias("assistant_chars"),
    )


def _chat(for_generation: bool = False) -> Column:
    messages = prompts.chat_messages("user_text", "assistant_text", for_generation)
    return prompts.render_chat(messages, for_generation)


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.exchanges(spark, sf_dir).select("conv_id", "turn", _chat().alias("chat"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms of each exchange in one pass."""
    forms = [F.struct(F.lit(m).alias("generation"), _md5(_chat(m)).alias("chat_md5")) for m in (False, True)]
    return inputs.exchanges(spark, sf_dir).select("conv_id", "turn", F.inline(F.array(*forms)))


def tokenize_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = inputs.documents(spark, sf_dir)
    ids = TOKENIZER.encode("text", PAIR_MAX_LENGTH)
    fixed = tokens.fixed_length(ids, TOKENIZER.pad_id, PAIR_MAX_LENGTH)
    rows = documents.select("doc_id", fixed.alias("fixed"))
    return rows.select("doc_id", *_padded_ids("fixed."))


def _labels(chats: DataFrame, tokenizer: tokens.Tokenizer, max_length: int | None) -> DataFrame:
    ids = tokenizer.encode("chat", max_length)
    fixed = tokens.fixed_length(ids, tokenizer.pad_id, max_length)
    marker = tokenizer.special_id(prompts.INSTRUCTION_END)
    labels = tokens.mask_labels("fixed.input_ids", "fixed.attention_mask", marker)
    return chats.withColumn("fixed", fixed).select("conv_id", "turn", labels.alias("labels"))


def mask_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(_chats(spark, sf_dir), TOKENIZER, PAIR_MAX_LENGTH)
    return rows.select("conv_id", "turn", *_label_columns("labels"))


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished records as training rows and as generation rows, in one pass."""
    rows = preparation.pair_row_modes(_finished(spark, sf_dir))
    labels = F.coalesce("labels", "partial_labels").alias("labels")
    rows = rows.select("id", "generation", "input_ids", "attention_mask", labels)
    return rows.select("id", "generation", *_padded_ids(""), *_label_columns("labels"))


def similarity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preparation.similarity_rows(inputs.records(spark, sf_dir))
    return rows.select(
        "id",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("attention_mask", " ").alias("attention_mask"),
    )


def decode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked labels back to text, through the vocabulary of the same conversations."""
    chats = _chats(spark, sf_dir)
    vocabulary = TOKENIZER.vocabulary(chats, "chat")
    rows = _labels(chats, TOKENIZER, PAIR_MAX_LENGTH)
    decoded = tokens.decode(rows, "labels", vocabulary, TOKENIZER.vocab_size)
    return decoded.select("conv_id", "turn", _md5("decoded").alias("decoded_md5"), F.length("decoded").alias("decoded_chars"))


def answer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits to accuracy: greedy decoding, text, tags, JSON and the share of right images.

    The whole generation goes through: every digit of its bytes becomes a row of logits, highest at the
    digit, and the text is put together from the most likely ids; labels come as ids. Tags are
    looked for in decoded text alone, whose length and digest are part of the result.
    """
    made = inputs.generations(spark, sf_dir)
    heard = HEX_TOKENIZER.spoken(HEX_TOKENIZER.encode("prediction"))
    texts = made.select(
        "id", HEX_TOKENIZER.decode(heard).alias("prediction"), HEX_TOKENIZER.decode(HEX_TOKENIZER.encode("label")).alias("label")
    )
    accuracy = metrics.generation_accuracy(name="answer_chain")
    digest = F.conv(F.substring(_md5("prediction"), 1, 15), 16, 10).cast("long")
    result = analysis.image_pairs(texts).agg(
        accuracy.value(F.sum(accuracy.term), F.sum(accuracy.weight)).alias("answer_chain"),
        F.sum(F.length("prediction")).alias("spoken_chars"),
        F.bit_xor(digest).alias("spoken_digest"),
    )
    return _rounded(result, "answer_chain")


def _ranks(spark: SparkSession) -> str:
    """File of a byte-level vocabulary: the session may name another one."""
    return spark.conf.get("pentarank.ranks", RANKS)


def subword_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents to subword ids and back."""
    tokenizer = subwords.byte_pair_tokenizer(_ranks(spark))
    coded = inputs.documents(spark, sf_dir).select("doc_id", tokenizer.encode("text").alias("ids"))
    told = coded.select("doc_id", tokenizer.decode("ids").alias("text"))
    return told.select("doc_id", _md5("text").alias("text_md5"), F.length("text").alias("chars"))


def subword_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chats as subword rows with masked labels; the answers, decoded and stripped, come out again."""
    tokenizer = subwords.byte_pair_tokenizer(_ranks(spark))
    rows = _labels(_chats(spark, sf_dir), tokenizer, None)
    answer = text.strip_ignore_token("decoded")
    told = rows.select("conv_id", "turn", tokenizer.decode("labels").alias("decoded"))
    return told.select("conv_id", "turn", _md5(answer).alias("answer_md5"), F.length(answer).alias("answer_chars"))


def embed_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded, scored against the documents of their record, and measured."""
    embedded = mapping.embed_column(
        inputs.documents(spark, sf_dir).select("doc_id", "text"), "text", mapping.hashing_embedder(64), "vec"
    )
    groups = inputs.grouped_vectors(embedded.select("doc_id", "vec"))
    scores = groups.select(vectors.cosine_scores("text_vec", "image_vecs").alias(SCORES))
    wanted = [metrics.top_image_accuracy(label=0), metrics.spearman(), metrics.pairwise_loss()]
    result = metrics.evaluate(scores.filter(F.size(SCORES) > 0), wanted)
    return _rounded(result, *result.columns)


def token_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = inputs.documents(spark, sf_dir)
    profile = batching.token_length_profile(documents, TOKENIZER.pieces("text"), ["lang"])
    return _rounded(profile, "p50_tokens", "p95_tokens")


def merged_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of four runs, one of them stored twice, merged per language and held against exact ranks."""
    path = _fresh(spark, "lengths")
    documents = inputs.documents(spark, sf_dir).select("doc_id", "lang", TOKENIZER.pieces("text").alias("pieces"))
    for run in (0, 1, 2, 3, 1):
        part = documents.filter(F.col("doc_id") % 4 == run)
        lengths.store_sketches(lengths.length_sketches(part, F.col("pieces"), ["lang"]), path, f"run{run}")
    marks = (0.5, 0.95)
    merged = lengths.merged_profile(lengths.read_sketches(spark, path), ["lang"], marks)
    counted = documents.select("lang", F.size("pieces").alias("n")).groupBy("lang", "n").count()
    ranked = counted.join(merged.withColumnRenamed("n_rows", "rows"), counted["lang"].eqNullSafe(merged["lang"])).select(merged["lang"], "rows", "max_tokens", "n", "count", "p50_tokens", "p95_tokens")
    wrong = {}
    for p in marks:
        mark = f"p{round(p * 100)}_tokens"
        below, upto = (F.sum(F.when(c, F.col("count")).otherwise(0)) / F.max("rows") for c in (F.col("n") < F.col(mark), F.col("n") <= F.col(mark)))
        wrong[f"p{round(p * 100)}_within_1_percent"] = (below <= p + 0.01) & (upto >= p - 0.01)
    return ranked.groupBy("lang").agg(F.max("rows").alias("n_rows"), F.max("max_tokens").alias("max_tokens"), *[v.alias(k) for k, v in wrong.items()])


def replayed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two runs stored batch by batch, a third of the batches twice; one run is reset halfway."""
    path = _fresh(spark, "partials")
    wanted = [metrics.top_image_accuracy(label=0), metrics.spearman(), metrics.pairwise_loss()]
    batches = scored(spark, sf_dir).withColumn("batch_id", F.expr(f"group_id div {MAP_BATCH}"))
    parts = metrics.partials(batches, wanted, ["batch_id"])
    for run in ("whole", "reset"):
        partials.upsert_partials(parts.withColumn("run_id", F.lit(run)), path)
    partials.upsert_partials(parts.filter("batch_id % 3 = 0").withColumn("run_id", F.lit("whole")), path)
    partials.reset(spark, path, "reset", 0)
    return _rounded(partials.stored_metrics(spark, path, wanted), "value")


def analysis_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis written as CSV and read again, with its running index."""
    path = _fresh(spark, "analysis")
    reports.write_indexed_analysis(analysis.analysis_table(inputs.generations(spark, sf_dir)), path)
    found = reports.read_indexed_analysis(spark, path)
    hashed = ("full_prediction", "full_label", "pred_reasoning", "label_reasoning")
    return found.withColumns({c: _md5(c) for c in hashed})


def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records joined with later answers, both stored in buckets; answers bring a new column along."""
    folder = _fresh(spark, "buckets")
    name = f"records_{uuid.uuid4().hex}"
    rows = _split_records(spark, sf_dir).select("id", "sentence", "correct_image", "split")
    datasets.save_bucketed(rows.filter("id % 2 = 0"), name, f"{folder}/records", buckets=4)
    datasets.append_bucketed(rows.filter("id % 2 = 1").withColumn("late", F.lit(True)), name)
    answers = rows.select("id", (F.col("correct_image") % 5 + 1).alias("answer"), "split")
    datasets.save_bucketed(answers, f"{name}_answers", f"{folder}/answers", buckets=4)
    stored = assembly.select_split(spark.table(name), "train")
    joined = stored.join(assembly.select_split(spark.table(f"{name}_answers"), "train").drop("split"), "id")
    return joined.select("id", _md5("sentence").alias("sentence"), "correct_image", "answer", "late")


def assign_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = inputs.table(spark, sf_dir, "documents")
    return batching.assign_batches(documents, "doc_id", SIMILARITY_BATCH)


def limit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.limit_batches(assign_batches(spark, sf_dir), 3)


def collate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = inputs.candidate_vectors(spark, sf_dir)
    order = batching.assign_batches(groups, "group_id", MAP_BATCH)
    rows = groups.join(order, "group_id")
    collated = batching.collate_batches(rows, ["group_id", "gold"], ["image_vecs"])
    scaled = F.transform("image_vecs", lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) * 10_000).cast("bigint"))
    return collated.select(
        "batch_id",
        "batch_rows",
        F.array_join("group_id", ",").alias("group_ids"),
        F.array_join(F.flatten("gold"), ",").alias("gold_labels"),
        F.size("image_vecs").alias("n_vectors"),
        F.array_join(scaled, ",").alias("vector_sums"),
    )


def resized_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of pictures of three kinds, brought to 3 by 3 with all old pixels counted."""
    resized = images.resize_images(inputs.pictures(spark, sf_dir), ["image"], PICTURE_SIDE, antialias=True)
    each = resized.select("vec_id", "image_error", F.posexplode_outer(F.get("pixel_values", F.lit(0))).alias("at", "value"))
    return each.select("vec_id", "image_error", "at", F.round(F.col("value").cast("double"), 3).alias("value"))


def picture_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written from the table, one to a picture of every record, and what their headers tell."""
    folder = _fresh(spark, "pictures")
    files = inputs.picture_files(spark, sf_dir).filter(f"vec_id % {inputs.GROUP} = 0")
    files.select("vec_id", F.col("content").cast("string")).write.partitionBy("vec_id").text(folder)
    found = image_files.scan_pictures(spark, folder, "*.txt", least_side=3)
    number = F.regexp_extract("path", "vec_id=([0-9]+)", 1).cast("long")
    return found.select(number.alias("vec_id"), "kind", "width", "height", "usable")


def picture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every picture, from a column of bytes."""
    size = inputs.picture_files(spark, sf_dir).withColumn("size", pictures.picture_size("content"))
    return size.select("vec_id", "size.kind", "size.width", "size.height")


def collate_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures resized and collated by 30: how many pixels a batch has, and what they add up to."""
    rows = images.resize_images(inputs.pictures(spark, sf_dir), ["image"], PICTURE_SIDE, antialias=True)
    order = batching.assign_batches(rows.select("vec_id"), "vec_id", MAP_BATCH)
    held = rows.select("vec_id", F.array_compact("pixel_values").alias("pixel_values")).join(order, "vec_id")
    collated = batching.collate_batches(held, ["vec_id"], ["pixel_values"])
    pixels = F.transform(F.flatten("pixel_values"), lambda x: F.round(x.cast("double") * 100).cast("long"))
    return collated.select(
        "batch_id", "batch_rows", F.array_join("vec_id", ",").alias("vec_ids"), F.size("pixel_values").alias("n_pictures"),
        F.size(pixels).alias("n_pixels"), F.aggregate(pixels, F.lit(0).cast("long"), lambda t, x: t + x).alias("pixel_sum"),
    )


def collate_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows with their pictures' bytes as pixels, collated by 30."""
    records = inputs.records(spark, sf_dir)
    pixels = F.array(*[F.crc32(F.coalesce(c, F.lit("").cast("binary"))) for c in IMAGE_COLUMNS])
    rows = preparation.similarity_rows(records.withColumn("pixels", pixels), keep=("id", "pixels"))
    order = batching.assign_batches(rows.select("id"), "id", MAP_BATCH)
    collated = batching.collate_batches(
        rows.join(order, "id"), ["id", "input_ids", "attention_mask"], ["pixels"]
    )
    joined = {c: F.array_join(F.flatten(c), " ") for c in ("input_ids", "attention_mask")}
    return collated.select(
        "batch_id",
        "batch_rows",
        F.array_join("id", ",").alias("ids"),
        *[F.md5(v).alias(f"{c}_md5") for c, v in joined.items()],
        _array_md5("pixels").alias("pixels_md5"),
    )


# --- logs and runs ---------------------------------------------------------


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged steps: mean loss per run and day, in long form."""
    steps = inputs.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        F.lit("train").alias("split"),
        F.dayofmonth("ts").alias("epoch"),
        F.col("value").alias("loss"),
    )
    epochs = runs.epoch_loss(steps, keys=("run_id", "split", "epoch"))
    return _rounded(runs.metric_log(epochs, ["epoch_loss", "steps"]), "value")


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores before and after moving each first candidate halfway to its text."""
    groups = inputs.candidate_vectors(spark, sf_dir)

    def nearer(text_vec: Column, vec: Column) -> Column:
        return F.zip_with(text_vec, vec, lambda a, b: (a + b) / 2)

    as_double = groups.select(
        "group_id",
        F.col("text_vec").cast("array<double>").alias("text_vec"),
        F.col("image_vecs").cast("array<array<double>>").alias("image_vecs"),
    )
    moved = F.transform(
        "image_vecs",
        lambda v, i: F.when(i == 0, nearer(F.col("text_vec"), v)).otherwise(v),
    )
    versions = F.array(
        F.struct(F.lit("before").alias("run_id"), F.col("image_vecs").alias("vecs")),
        F.struct(F.lit("after").alias("run_id"), moved.alias("vecs")),
    )
    scores = as_double.select("text_vec", F.inline(versions)).select(
        "run_id", vectors.cosine_scores("text_vec", "vecs").alias(SCORES)
    )
    wanted = [metrics.top_image_accuracy(label=0), metrics.spearman(), metrics.pairwise_loss()]
    wide = metrics.evaluate(scores, wanted, ["run_id"]).withColumn("split", F.lit("test"))
    log = runs.metric_log(wide, [m.name for m in wanted], ("run_id", "split"))
    return _rounded(runs.compare_runs(log, "before", "after"), "before", "after", "change")


def metric_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per batch of 30 in test order, from which the final metrics merge."""
    rows = scored(spark, sf_dir)
    order = batching.assign_batches(
        rows.select("group_id"), "group_id", MAP_BATCH, shuffle=False
    )
    wanted = [metrics.top_image_accuracy(label=0), metrics.spearman(), metrics.pairwise_loss()]
    batches = rows.join(order.select("group_id", "batch_id"), "group_id")
    return _rounded(metrics.partials(batches, wanted, ["batch_id"]), "total", "weight")


def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final metrics from partial sums per batch; any split gives the same."""
    wanted = [metrics.top_image_accuracy(label=0), metrics.spearman(), metrics.pairwise_loss()]
    batches = scored(spark, sf_dir).withColumn("batch_id", F.expr(f"group_id div {MAP_BATCH}"))
    parts = metrics.partials(batches, wanted, ["batch_id"])
    return _rounded(metrics.merge_partials(parts, wanted), "value")


def registry() -> dict[str, Query]:
    return {
        "similarity_evaluation": similarity_evaluation,
        "candidate_similarity": candidate_similarity,
        "top_image": top_image,
        "top_image_accuracy": _one_metric(metrics.top_image_accuracy),
        "top_image_accuracy_first": _one_metric(
            lambda: metrics.top_image_accuracy(label=0, name="top_image_accuracy_first")
        ),
        "rank_candidates": rank_candidates,
        "spearman": _one_metric(metrics.spearman),
        "spearman_labeled": _one_metric(
            lambda: metrics.spearman(gold="gold", name="spearman_labeled")
        ),
        "pairwise_loss": _one_metric(metrics.pairwise_loss),
        "pairwise_loss_unweighted": _one_metric(
            lambda: metrics.pairwise_loss(weights=None, name="pairwise_loss_unweighted")
        ),
        "target_logprob": target_logprob,
        "perplexity": perplexity,
        "perplexity_strict": perplexity_strict,
        "perplexity_shifted": perplexity_shifted,
        "perplexity_sequences": perplexity_sequences,
        "perplexity_streamed": perplexity_streamed,
        "greedy_decode": greedy_decode,
        "extract_tags": extract_tags,
        "extract_image_choice": extract_image_choice,
        "strip_ignore_token": strip_ignore_token,
        "generation_accuracy": generation_accuracy,
        "generation_analysis": generation_analysis,
        "analysis_csv": analysis_csv,
        "candidates_long": candidates_long,
        "candidates_shuffled": candidates_shuffled,
        "candidates_wide": candidates_wide,
        "candidates_reordered": candidates_reordered,
        "correct_image": correct_image,
        "render_generation_prompt": render_generation_prompt,
        "split_reply": split_reply,
        "route_outcomes": route_outcomes,
        "retry_failed_only": retry_failed_only,
        "sft_dataset_assemble": sft_dataset_assemble,
        "training_view": training_view,
        "bucketed_join": bucketed_join,
        "generate_sft": generate_sft,
        "generate_resumed": generate_resumed,
        "generate_with_retries": generate_with_retries,
        "snapshot_records": snapshot_records,
        "failed_ledger": failed_ledger,
        "batched_map": batched_map,
        "format_training_pair": format_training_pair,
        "chat_messages": chat_messages,
        "tokenize_pad": tokenize_pad,
        "mask_labels": mask_labels,
        "pair_rows": pair_rows,
        "similarity_rows": similarity_rows,
        "decode_tokens": decode_tokens,
        "answer_chain": answer_chain,
        "subword_round_trip": subword_round_trip,
        "subword_answers": subword_answers,
        "embed_similarity": embed_similarity,
        "token_length_profile": token_length_profile,
        "merged_length_profile": merged_length_profile,
        "assign_batches": assign_batches,
        "limit_batches": limit_batches,
        "collate_batches": collate_batches,
        "collate_token_rows": collate_token_rows,
        "resized_pictures": resized_pictures,
        "picture_headers": picture_headers,
        "picture_sizes": picture_sizes,
        "collate_pictures": collate_pictures,
        "metric_log": metric_log,
        "compare_runs": compare_runs,
        "metric_partials": metric_partials,
        "merged_metrics": merged_metrics,
        "replayed_metrics": replayed_metrics,
    }
