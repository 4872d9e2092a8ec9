"""Generating fine-tuning answers with an injected text generator."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pentarank.functions import prompts, text
from pentarank.operators.candidates import shuffle_candidates
from pentarank.schemas import MAP_BATCH, SHUFFLE_SEED, sft_schema

Generator = Callable[[list[str]], list[str]]
Client = Callable[[str], str | None]

_REPLY = "reply string, error string"


def _attempt(generate: Generator, batch: list[str]) -> list[tuple[str | None, str | None]]:
    try:
        replies = generate(batch)
        if len(replies) == len(batch):
            return [(r, None if r is not None else "no reply") for r in replies]
        problem = "wrong number of replies"
    except Exception as exc:
        problem = f"{type(exc).__name__}: {exc}"
    if len(batch) == 1:
        return [(None, problem)]
    # Find the rows at fault by asking for each alone.
    return [result for prompt in batch for result in _attempt(generate, [prompt])]


def generate_replies(
    df: DataFrame,
    make_generator: Callable[[], Generator],
    prompt_col: str = "prompt",
    batch_size: int = MAP_BATCH,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``reply`` and ``error``; a failing row never fails its batch or task.

    A batch that fails is asked again prompt by prompt, those already answered included: a
    generator that can tell which prompts fail should return None for them instead, and one
    that answers single prompts belongs in ``ask_prompts``, which asks only failed ones again.

    ``make_generator`` is called once per task, so each task holds one client. Only the
    prompt travels to Python. A lost task asks again, so write the result out (see
    ``streaming.generation`` and ``routing.route_outcomes``) before using it twice.
    """

    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        generate = make_generator()
        for texts in batches:
            asked = [(i, t) for i, t in enumerate(texts) if t is not None]
            answers: dict[int, tuple[str | None, str | None]] = {}
            for start in range(0, len(asked), batch_size):
                chunk = asked[start : start + batch_size]
                replies = _attempt(generate, [t for _, t in chunk])
                answers.update(zip([i for i, _ in chunk], replies))
            results = [answers.get(i, (None, "no prompt")) for i in range(len(texts))]
            yield pd.DataFrame(results, columns=["reply", "error"])

    call = F.pandas_udf(ask, _REPLY).asNondeterministic()
    spread = df if num_partitions is None else df.repartition(num_partitions)
    asked = spread.withColumn("_reply", call(prompt_col))
    return asked.withColumns(
        {"reply": F.col("_reply.reply"), "error": F.col("_reply.error")}
    ).drop("_reply")


class RetryLater(Exception):
    """Raised by a client that knows how long to wait before it is asked again."""

    def __init__(self, seconds: float, message: str = "asked to wait"):
        super().__init__(message)
        self.seconds = seconds


def _insist(ask: Client, prompt: str, attempts: int, backoff: float, retry_on: tuple) -> tuple[str | None, str | None, int]:
    """One prompt until it is answered, at most ``attempts`` times."""
    problem = "no reply"
    for attempt in range(1, attempts + 1):
        wait = backoff * 2 ** (attempt - 1)
        try:
            reply = ask(prompt)
            if reply is not None:
                return reply, None, attempt
            problem = "no reply"
        except RetryLater as later:
            problem, wait = f"RetryLater: {later}", later.seconds
        except Exception as exc:
            problem = f"{type(exc).__name__}: {exc}"
            if not isinstance(exc, retry_on):
                return None, problem, attempt
        if attempt < attempts and wait > 0:
            time.sleep(wait)
    return None, problem, attempts


def ask_prompts(
    df: DataFrame,
    make_client: Callable[[], Client],
    prompt_col: str = "prompt",
    concurrency: int = 8,
    attempts: int = 3,
    backoff: float = 0.5,
    retry_on: tuple[type[Exception], ...] = (Exception,),
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``reply``, ``error`` and ``attempts``, asking a client prompt by prompt.

    Each task holds one client and at most ``concurrency`` requests in flight; the whole job has as many
    times that as tasks run at once. A prompt that fails is asked again after ``backoff`` seconds, twice as long each
    time, or as long as ``RetryLater`` says; a prompt that was answered never is. Errors outside
    ``retry_on`` end a prompt's attempts at once. A NULL prompt is not asked: its error is "no prompt", its attempts 0.
    The client is called from several threads. As with batches, a lost task asks again, so write the result out.
    """

    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def one(prompt: str | None) -> tuple[str | None, str | None, int]:
            return (None, "no prompt", 0) if prompt is None else _insist(client, prompt, attempts, backoff, retry_on)

        with ThreadPoolExecutor(concurrency) as window:
            for texts in batches:
                yield pd.DataFrame(window.map(one, texts), columns=["reply", "error", "attempts"])

    call = F.pandas_udf(ask, "reply string, error string, attempts int").asNondeterministic()
    spread = df if num_partitions is None else df.repartition(num_partitions)
    asked = spread.withColumn("_reply", call(prompt_col))
    return asked.withColumns({c: F.col(f"_reply.{c}") for c in ("reply", "error", "attempts")}).drop("_reply")


def split_replies(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Turn ``reply`` into ``reasoning`` and ``output``; a malformed reply becomes an error."""
    parted = replies.withColumn("_parts", text.split_reply(reply_col))
    malformed = F.when(F.col("_parts").isNull(), F.lit("malformed reply"))
    return parted.withColumns(
        {
            "reasoning": F.col("_parts.reasoning"),
            "output": F.col("_parts.output"),
            "error": F.coalesce(F.col("error"), malformed),
        }
    ).drop("_parts", reply_col)


def prepare_prompts(
    records: DataFrame, template: str = prompts.GENERATION_TEMPLATE, seed: int = SHUFFLE_SEED
) -> DataFrame:
    """Shuffle the candidates of each record and render its prompt."""
    shuffled = shuffle_candidates(records, seed=seed).drop("candidate_order")
    return shuffled.withColumn("prompt", prompts.render_generation_prompt(template))


def generate_sft(
    records: DataFrame,
    make_generator: Callable[[], Generator],
    template: str = prompts.GENERATION_TEMPLATE,
    seed: int = SHUFFLE_SEED,
    batch_size: int = MAP_BATCH,
    num_partitions: int | None = None,
) -> DataFrame:
    """Finished records plus ``error``, which is NULL for a success.

    Images never leave the JVM.
    """
    prompted = prepare_prompts(records, template, seed)
    replies = generate_replies(
        prompted, make_generator, batch_size=batch_size, num_partitions=num_partitions
    )
    outcomes = split_replies(replies.drop("prompt"))
    return outcomes.select(*[f.name for f in sft_schema()], "error")


def generate_sft_one_by_one(
    records: DataFrame,
    make_client: Callable[[], Client],
    template: str = prompts.GENERATION_TEMPLATE,
    seed: int = SHUFFLE_SEED,
    **asking,
) -> DataFrame:
    """As ``generate_sft``, with a client of single prompts; adds ``attempts``. ``asking`` goes to ``ask_prompts``."""
    replies = ask_prompts(prepare_prompts(records, template, seed), make_client, **asking)
    outcomes = split_replies(replies.drop("prompt"))
    return outcomes.select(*[f.name for f in sft_schema()], "error", "attempts")
