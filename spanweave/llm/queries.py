"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, licenses, ngram_join, packing, pii, token_counts, token_store, toxicity, url_filter
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 2048, specials=True))


#: A fixed key for the registered query; a real run takes a secret one.
PII_KEY = b"spanweave"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, PII_KEY, kinds_col="kinds")
    return out.select("doc_id", "text", F.size("kinds").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.learn_rows(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.store_digest(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, specials=True).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.section_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), specials=True)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 20, 20)


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


# DuckDB's SQL for the results that it can express on whole tables.
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(" + _LOWER + ", '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _sets(name: str, source: str, key: str, n: int) -> str:
    return f"""{name}_words as (select {key}, {_WORDS.format("text")} as w from {source}),
{name}_sets as (select {key}, case when len(w) >= {n} then list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from {name}_words),
{name} as (select {key}, len(s) as n, unnest(s) as g from {name}_sets)"""


_JACCARD = f"""with recursive {_sets("d", "documents", "doc_id", 4)},
links as (select a.doc_id as a, b.doc_id as b from d a join d b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from d_sets union select reach.a, edges.b from reach join edges on reach.b = edges.a)
select doc_id, len(s) as n_shingles, component_id from d_sets join (select a, min(b) as component_id from reach group by a) on doc_id = a"""

_CONTAINED = f"""with {_sets("d", "documents", "doc_id", 5)}, {_sets("q", "benchmark", "item_id", 5)}
select doc_id, item_id, count(*) as n_common, q.n as n_item, count(*) / q.n as containment from q join d on q.g = d.g group by doc_id, item_id, q.n having 100 * count(*) >= 80 * q.n"""


def _license_sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    rows = [f"({quote(p)}, true, {quote(v)}, {quote(p)})" for p, v in licenses.PHRASES.items()] + [f"({quote(n)}, false, {quote(n)}, {quote(t)})" for n, t in licenses.TEMPLATES.items()]
    words = "list_filter(string_split_regex(" + _LOWER + ", '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    grams = "array_to_string(w[pl + 1:pl + k], ' ')"
    return f"""with t as (select template, base, label, {words.format("body")} as w from (values {", ".join(rows)}) v(template, base, label, body)),
tk as (select *, least(case when base then 2 else 4 end, len(w)) as k from t),
tg as (select template, base, label, k, len(w) - k + 1 as grams, pl, {grams} as g from (select *, unnest(range(0, len(w) - k + 1)) as pl from tk)),
docs as (select row_number() over () as row, doc_id, {words.format("text")} as w from documents),
dg as (select row, pl, k, {grams} as g from (select row, w, k, unnest(range(0, len(w) - k + 1)) as pl from docs, (select distinct k from tg))),
votes as (select row, template, base, label, grams, dg.pl - tg.pl as diagonal, list(tg.pl) as ats, min(dg.pl) as first from dg join tg on dg.k = tg.k and dg.g = tg.g group by all),
marked as (select *, case when not base and diagonal - lag(diagonal) over (partition by row, template order by diagonal) <= 3 then 0 else 1 end as opens from votes),
grouped as (select *, sum(opens) over (partition by row, template order by diagonal rows between unbounded preceding and current row) as grp from marked),
spans as (select row, template, base, label, grams, len(list_distinct(flatten(list(ats)))) as votes, min(first) as start from grouped group by row, template, base, label, grams, grp),
good as (select *, votes / grams as share from spans where case when base then votes = grams else votes / grams >= 0.6::double end)
select doc_id, len(w) as n_words, count(case when base then 1 end) as n_base, min(case when base then start end) as first_word, max(case when base then start end) as last_word,
  coalesce(string_agg(distinct case when base then label end, ',' order by case when base then label end), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label), '') as labels, coalesce(max(case when base then 1.0::double else share end), 0.0::double) as score
from docs left join good on docs.row = good.row group by docs.row, doc_id, w"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.ORACLE, "op4_license_scan": _license_sql(), "op5_ngram_jaccard": _JACCARD, "op9_decontamination": _CONTAINED}
