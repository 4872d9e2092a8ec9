"""Secret scan: fixed patterns, and strings that look random.

Strings that no pattern names are judged by two character Markov models, one of random
strings and one of ordinary identifiers: the log-likelihood ratio of a string is the sum over
its character pairs. The models are counts of pairs in labelled samples.

DataFrame functions only. Positions come from splitting a text at the matches and adding up
the lengths of what lies between them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the named kinds, and the least length of what they find.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
BASE_KINDS = ("assign", "access", "hex")

RANDOM_KIND = "random"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
FIRST, SYMBOLS = 32, 96
MASK = "[SECRET]"


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each pair of printable ASCII characters, row by row."""

    ratios: tuple[float, ...]


def corpus_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled samples ``(sample, random, n)`` from all texts; ``n`` is how often a sample occurs.

    Ordinary: their words of letters, with inner hyphens or underscores and a short number
    at the end, as they are and as parts of a path; numbers of up to four digits as parts of a
    path only. Equal words are counted before they leave a task. Random: digests of the texts in the alphabets
    secrets are written in, one of each for every text.
    """
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    words = F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{3,}(?:[_-][A-Za-z]+)*[0-9]{0,3}\b"), F.lit(0))
    numbers = F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,4}\b"), F.lit(0))
    counted = texts.select(F.explode(F.concat(words, numbers)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    part = F.concat(F.lit("/"), "word", F.lit("/"))
    forms = F.when(F.col("word").rlike("^[0-9]"), F.array(part)).otherwise(F.array("word", part))
    plain = counted.select(F.explode(forms).alias("sample"), F.lit(0).alias("random"), "n")
    raw = F.unhex(F.sha2("text", 256))
    coded = F.regexp_replace(F.base64(raw), "=", "")
    kinds = [coded, F.upper(F.base64(F.unhex(F.md5("text")))), F.lower(F.hex(raw)), F.hex(raw), F.translate(coded, "+/", "-_")]
    made = texts.select(F.explode(F.array(*kinds)).alias("sample"), F.lit(1).alias("random"), F.lit(1).cast("long").alias("n"))
    return plain.unionByName(made)


def train(samples: DataFrame) -> Model:
    """Count character pairs of ``(sample, random)``, and ``n`` where there is one; at most ``2 * SYMBOLS^2`` counts
    reach the driver.

    Add-one smoothing; without samples every ratio is zero.
    """
    times = F.col("n") if "n" in samples.columns else F.lit(1).cast("long")
    pairs = samples.filter("length(sample) > 1").select(
        "random", times.alias("n"), F.explode(F.expr("transform(sequence(1, length(sample) - 1), i -> substring(sample, i, 2))")).alias("pair")
    )
    counts = [[1.0] * SYMBOLS * SYMBOLS for _ in range(2)]
    held = pairs.filter(F.col("pair").rlike("^[ -~]{2}$")).groupBy("random", "pair").agg(F.sum("n")).collect()
    for random, pair, n in held:
        counts[int(random)][(ord(pair[0]) - FIRST) * SYMBOLS + ord(pair[1]) - FIRST] += n
    ratios = []
    for row in range(SYMBOLS):
        part = slice(row * SYMBOLS, (row + 1) * SYMBOLS)
        sums = [sum(c[part]) for c in counts]
        ratios += [math.log(r / sums[1]) - math.log(o / sums[0]) for o, r in zip(counts[0][part], counts[1][part])]
    return Model(tuple(round(r, 4) for r in ratios))


def log_ratio(word: Column, model: Model) -> Column:
    """Log-likelihood ratio of a string of printable ASCII, positive for random ones."""
    table = F.split(F.lit(",".join(map(str, model.ratios))), ",").cast("array<double>")
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c) - FIRST)
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * SYMBOLS + b)
    return F.aggregate(pairs, F.lit(0.0), lambda total, at: total + F.get(table, at))


def _located(matches: str, parts: str) -> Column:
    """Spans ``(start, end)`` in code points of matches, given the texts between them."""
    return F.expr(f"""
        case when size({matches}) > 0 then aggregate(
            sequence(0, size({matches}) - 1),
            struct(0 as pos, cast(array() as array<struct<start: int, end: int>>) as found),
            (acc, i) -> struct(
                acc.pos + length({parts}[i]) + length({matches}[i]) as pos,
                array_append(acc.found, named_struct(
                    'start', acc.pos + length({parts}[i]), 'end', acc.pos + length({parts}[i]) + length({matches}[i]))) as found),
            acc -> acc.found)
        else cast(array() as array<struct<start: int, end: int>>) end""")


def _runs(word: Column, model: Model, margin: float, per_pair: float) -> Column:
    """``(runs, pieces)`` of a candidate with slashes: spans in it that may be random, cut at slashes.

    A run is parts in a row that add up to the most in favour of random; it ends where the sum
    falls to nothing or by ``margin``. A piece is one part. Both are ``LEAST`` long at least.
    """
    spans = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    parts = F.transform(
        F.split(word, "/"),
        lambda p: F.struct(F.length(p).alias("n"), (log_ratio(F.concat(p, F.lit("/")), model) - per_pair * F.length(p)).alias("gain")),
    )

    def kept(done: Column, start: Column, end: Column) -> Column:
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.when(end - start >= LEAST, F.array_append(done, span)).otherwise(done)

    def step(acc: Column, part: Column) -> Column:
        end, total = acc["pos"] + part["n"], acc["total"] + part["gain"]
        grows = total > acc["best"]
        ends = ~grows & ((total <= 0) | (total < acc["best"] - margin))
        return F.struct(
            (end + 1).alias("pos"),
            F.when(ends, end + 1).otherwise(acc["first"]).alias("first"),
            F.when(ends, end + 1).when(grows, end).otherwise(acc["last"]).alias("last"),
            F.when(ends, 0.0).otherwise(total).alias("total"),
            F.when(ends, 0.0).when(grows, total).otherwise(acc["best"]).alias("best"),
            F.when(ends, kept(acc["runs"], acc["first"], acc["last"])).otherwise(acc["runs"]).alias("runs"),
            kept(acc["pieces"], acc["pos"], end).alias("pieces"),
        )

    none = [F.lit(0).alias(c) for c in ("pos", "first", "last")] + [F.lit(0.0).alias(c) for c in ("total", "best")]
    return F.aggregate(
        parts,
        F.struct(*none, spans.alias("runs"), spans.alias("pieces")),
        step,
        lambda acc: F.struct(kept(acc["runs"], acc["first"], acc["last"]).alias("runs"), acc["pieces"].alias("pieces")),
    )


def _digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*BASE_KINDS, RANDOM_KIND)))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, model: Model, margin: float = 12.0, per_pair: float = 0.4, text_col: str = "text") -> DataFrame:
    """Add ``base``, ``found`` (arrays of spans by start, then kind) and the columns told from them.

    Added: ``n_assign, n_access, n_hex, base_sha256, spans``. ``base`` holds the patterns' spans,
    ``found`` these and the strings that look random: at least ``margin`` in favour of random and ``per_pair``
    for each character pair, outside every span of ``base``. A slash may be part of them; where a candidate with
    slashes is not random as a whole, runs of its parts and single parts are judged by the same rule. Positions count code points, ends are
    exclusive. NULL texts are scanned as empty and give no spans. Columns of the added names
    are replaced; repeated rows are all returned. No shuffle.
    """
    # The caller's columns travel in one struct, so their names meet no others.
    found = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("word", CANDIDATE)):
        found = found.withColumn(f"_m_{name}", F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))
        found = found.withColumn(f"_p_{name}", F.when(F.size(f"_m_{name}") > 0, F.split("_t", pattern, -1)))
    found = found.withColumn("_v", F.when(F.size("_m_assign") > 0, F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2))))
    for name in ("assign", "access", "hex", "word"):
        found = found.withColumn(f"_s_{name}", _located(f"_m_{name}", f"_p_{name}"))

    def kind(spans: Column, number: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    assign = F.expr(f"filter(_s_assign, (s, i) -> length(_v[i]) >= {ASSIGN_LEAST})")
    found = found.withColumn("base", F.array_sort(F.concat(kind(assign, 0), kind(F.col("_s_access"), 1), kind(F.col("_s_hex"), 2))))

    def judged(word: Column, start: Column, end: Column) -> Column:
        free = ~F.exists("base", lambda b: (b["start"] < end) & (start < b["end"]))
        return free & (log_ratio(word, model) >= F.greatest(F.lit(margin), per_pair * (F.length(word) - 1)))

    def inner(cand: Column) -> Column:
        """Random spans in a candidate that is not random as a whole."""
        at, word = cand["start"], cand["word"]

        def fits(span: Column) -> Column:
            return judged(F.substring(word, span["start"] + 1, span["end"] - span["start"]), at + span["start"], at + span["end"])

        def spans(cuts: Column) -> Column:
            runs = F.filter(cuts["runs"], fits)
            apart = lambda p: ~F.exists(runs, lambda r: (r["start"] < p["end"]) & (p["start"] < r["end"]))
            return F.concat(runs, F.filter(cuts["pieces"], lambda p: apart(p) & fits(p)))

        found = F.flatten(F.transform(F.array(_runs(word, model, margin, per_pair)), spans))
        return F.transform(found, lambda s: F.struct((at + s["start"]).alias("start"), (at + s["end"]).alias("end")))

    cands = F.zip_with(
        "_m_word", "_s_word",
        lambda w, s: F.struct(w.alias("word"), s["start"].alias("start"), s["end"].alias("end"), judged(w, s["start"], s["end"]).alias("whole")),
    )
    found = found.withColumn("_w", F.when(F.size("_m_word") > 0, cands).otherwise(F.slice(cands, 1, 0)))
    found = found.withColumn("_x", F.filter("_w", lambda c: ~c["whole"] & F.contains(c["word"], F.lit("/"))))
    pieces = F.when(F.size("_x") > 0, F.flatten(F.transform("_x", inner))).otherwise(F.slice("_s_word", 1, 0))
    random = F.concat(F.expr("transform(filter(_w, c -> c.whole), c -> named_struct('start', c.start, 'end', c.end))"), pieces)
    found = found.withColumn("found", F.array_sort(F.concat("base", kind(random, 3))))
    for k, name in enumerate(BASE_KINDS):
        found = found.withColumn(f"n_{name}", F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)"))
    found = found.withColumn("base_sha256", F.sha2(_digest(F.col("base")), 256)).withColumn("spans", _digest(F.col("found")))
    added = ["base", "found", *[f"n_{name}" for name in BASE_KINDS], "base_sha256", "spans"]
    return found.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *added)


def redact(docs: DataFrame, model: Model, mask: str = MASK, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span found in a text replaced by ``mask``; overlapping spans by one.

    Columns are kept; a text without spans, or NULL, stays as it is.
    """
    names = docs.columns
    found = scan(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text")), model, text_col="_text", **options)
    cleaned = F.expr(f"""
        aggregate(found, struct(0 as pos, cast('' as string) as done),
            (acc, s) -> struct(
                greatest(acc.pos, s.end) as pos,
                case when s.start >= acc.pos
                     then concat(acc.done, substring(_text, acc.pos + 1, s.start - acc.pos), '{mask}')
                     else acc.done end as done),
            acc -> concat(acc.done, substring(_text, acc.pos + 1)))""")
    kept = found.withColumn("_text", F.when(F.size("found") > 0, cleaned).otherwise(F.col("_text")))
    return kept.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names])
