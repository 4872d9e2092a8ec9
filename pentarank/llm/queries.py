"""Registered queries of the operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pentarank.llm import (
    conversations,
    cover_tree,
    decontaminate,
    gnat,
    html_extract,
    merkle,
    packing,
    quality,
    secrets,
    simhash,
    substrings,
    token_counts,
    url_filter,
)
from pentarank.llm.common import fresh_folder, table

# The rules of the url query.
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(text, label)`` of labelled documents outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    marks = labels.select("doc_id", F.col("quality").alias("label"))
    return docs.filter(fold != 2).select("doc_id", "text").join(marks, "doc_id").select("text", "label")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, training_rows(docs, table(spark, sf_dir, "labels")), threshold=0.7)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.link_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary, room=4096, end_id=2)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.corpus_samples(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    held = decontaminate.containments(docs, items)
    return held.select("doc_id", "item_id", "n_shared", "n_item", "containment")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so every distinct text is encoded."""
    cache = fresh_folder(spark, "token-cache")
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache, limit=4096
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_extract.extract_text(pages, html_extract.train(pages))
    return found.select("page_id", "url", "text", "n_chars")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return left.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return gnat.mine_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damage(rows), rows)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _url_sql() -> str:
    def hits(terms) -> str:
        return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::int" for t in terms)

    fits = "\n".join(
        f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '/{p}') then '{h}/{p}'"
        for h, _, p in (r[1].partition("/") for r in sorted(URL_RULES, key=lambda r: -len(r[1])))
    )
    said = "\n".join(f"when '{text}' then '{verdict}'" for verdict, text in URL_RULES)
    return f"""
    with parts as (
        select page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') u,
               case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest
        from pages),
    named as (
        select page_id, u,
               translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
        from parts),
    ruled as (
        select *, case {fits} else null end as rule,
               ({hits(url_filter.STRICT_TERMS)})::int strict_hits, ({hits(url_filter.SOFT_TERMS)})::int soft_hits
        from named)
    select page_id, host, path, rule,
           coalesce(case rule {said} end, case when strict_hits >= 1 or soft_hits >= 2 then 'block' else 'allow' end) verdict,
           strict_hits, soft_hits
    from ruled"""


def _containment_sql() -> str:
    def shingles(source: str, key: str) -> str:
        low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"""select distinct {key}, array_to_string(w[i:i+4], ' ') s
                   from (select {key}, w, unnest(generate_series(1, len(w) - 4)) i
                         from (select {key}, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') w from {source}))"""

    return f"""
    with d as ({shingles("documents", "doc_id")}), b as ({shingles("benchmark", "item_id")}),
    sizes as (select item_id, count(*) n_item from b group by item_id),
    hits as (select doc_id, item_id, count(*) n_shared from d join b using (s) group by doc_id, item_id)
    select doc_id, item_id, n_shared::int n_shared, n_item::int n_item, n_shared / n_item containment
    from hits join sizes using (item_id) where n_shared >= 0.8 * n_item"""


def _repeats_sql() -> str:
    return """
    with split as (
        select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
    placed as (select doc_id, unnest(w) word, generate_subscripts(w, 1) pos from split),
    windows as (
        select doc_id, pos, count(*) over next n,
               string_agg(word, ' ') over next said
        from placed window next as (partition by doc_id order by pos rows between current row and 34 following)),
    repeated as (
        select doc_id, pos from (select *, count(*) over (partition by said) times from windows where n = 35) where times > 1),
    covered as (select distinct doc_id, pos + k pos from repeated, range(35) t(k)),
    kept as (
        select doc_id, string_agg(word, ' ' order by pos) said, count(*) n
        from placed anti join covered using (doc_id, pos) group by doc_id)
    select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(said, '')) kept_sha256
    from split left join kept using (doc_id)"""


def _links_sql() -> str:
    return """
    with recursive sound as (
        select vec_id, label, embedding::double[] v from embeddings
        where label is not null and isfinite(list_sum(list_transform(embedding::double[], lambda x: x * x)))
          and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0
          and len(list_filter(embedding, lambda x: x is null)) = 0),
    links as (
        select a.vec_id x, b.vec_id y from sound a join sound b on a.label = b.label and a.vec_id <> b.vec_id
        where list_cosine_similarity(a.v, b.v) >= 0.93),
    reach(vec_id, root) as (
        select vec_id, vec_id from embeddings
        union select reach.vec_id, links.y from reach join links on reach.root = links.x),
    counts as (select x vec_id, count(*) n from links group by x)
    select vec_id, coalesce(any_value(n), 0) n_links, min(root) component_id, vec_id = min(root) kept
    from reach left join counts using (vec_id) group by vec_id"""


def _negatives_sql() -> str:
    return """
    with rows as materialized (
        select row_number() over () k, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as l,
               list_transform(embedding, lambda x: floor(256 * x::double)) v
        from embeddings
        where vec_id is not null and label is not null and embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scores as (
        select a.k, a.vec_id anchor_id, a.l = b.l as same, b.k other, b.vec_id, list_inner_product(a.v, b.v)::bigint score
        from rows a join rows b on a.k <> b.k where a.vec_id % 100 = 0),
    positives as (
        select * from scores where same
        qualify row_number() over (partition by k order by score desc, vec_id) <= 5),
    fits as (
        select p.anchor_id, p.vec_id positive_id, n.vec_id negative_id, p.score positive_score, n.score negative_score,
               row_number() over (partition by p.k, p.other order by n.score desc, n.vec_id) rank
        from positives p join scores n on p.k = n.k
        where not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
    select anchor_id, positive_id, rank::int rank, negative_id, positive_score, negative_score from fits where rank <= 10"""


def _merkle_sql() -> str:
    order = "order by doc_id nulls first, sha256(t)"
    return f"""
    with placed as (
        select doc_id, t, length(t) n, coalesce(lead(t) over ({order}), first_value(t) over ({order})) follows
        from (select doc_id, coalesce(text, '') t from documents)),
    changed as (
        select *, left(t, n - n // 4) || left(follows, n // 4) edited from placed),
    texts as (select t from changed union select edited from changed),
    pieces as (
        select t, unnest(p) piece, generate_subscripts(p, 1) pos
        from (select t, regexp_extract_all(t, '{merkle.PARAGRAPH}') p from texts)),
    marked as (
        select t, pos, sha256(piece) digest,
               coalesce(sum((starts_with(sha256(piece), '0') or regexp_matches(piece, '{merkle.BLANK_LINE}'))::int)
                   over (partition by t order by pos rows between unbounded preceding and 1 preceding), 0) section
        from pieces),
    sections as (
        select t, section, sha256('s' || string_agg(digest, '' order by pos)) digest,
               string_agg(left(digest, {merkle.BRANCH_DIGITS}), ':' order by pos) under
        from marked group by t, section),
    prints as (
        select t, sha256('r' || string_agg(digest, '' order by section))
               || string_agg('/' || left(digest, {merkle.BRANCH_DIGITS}) || ':' || under, '' order by section) print
        from sections group by t
        union all select '', sha256('r')),
    branches as (select t, print, list_distinct(regexp_extract_all(print, ':([0-9a-f]{{{merkle.BRANCH_DIGITS}}})', 1)) b from prints)
    select doc_id, n::bigint n_chars, sha256(edited) edited_sha256, own.print fingerprint, new.print edited_fingerprint,
           case when t = edited then 1.0 else 2 * len(list_intersect(own.b, new.b)) / (len(own.b) + len(new.b)) end::double near_edited,
           case when t = follows then 1.0 else 2 * len(list_intersect(own.b, nxt.b)) / (len(own.b) + len(nxt.b)) end::double near_next
    from changed join branches own using (t) join branches new on new.t = edited join branches nxt on nxt.t = follows"""


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query in globals().items() if name.startswith("op") and callable(query)}


def statements() -> dict[str, str]:
    return {
        "op1_url_filters": _url_sql(),
        "op3_cover_tree": _links_sql(),
        "op7_decontamination": _containment_sql(),
        "op10_substrings": _repeats_sql(),
        "op11_hard_negatives": _negatives_sql(),
        "op13_merkle": _merkle_sql(),
    }
