"""The operators as named queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelgrid.llm import (
    best_fit_packing,
    decontaminate,
    hidden_markov,
    html_crf,
    jaccard_join,
    langid,
    online_packing,
    reply_trees,
    source_divergence,
    toxicity,
    vantage_clusters,
    warc,
    winnowing,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(langid.sample(docs.filter(_fold("doc_id", 3) != 1)))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> toxicity.Model:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_fold("doc_id", 5) != 0)
    rows, _ = toxicity.sample(docs, labels)
    return toxicity.train(rows)


@query("op1_document_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.predict(docs, language_model(docs))
    return found.select("doc_id", (_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query("op3_online_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return found.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


OP5_SQL = r"""
with doc as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), item as (
  select cast(item_id as varchar) as item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), win as (
  select distinct item_id, least(10, len(w)) as size, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') as phrase
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from item where len(w) > 0)
), sizes as (select distinct size from win), spot as (
  select rid, s, size, array_to_string(w[s : s + size - 1], ' ') as phrase
  from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as s from doc, sizes where len(w) >= size)
), hit as (
  select rid, s, spot.size, item_id from spot join win on spot.size = win.size and spot.phrase = win.phrase
), covered as (
  select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + size)) as p from (select distinct rid, s, size from hit)) group by rid
), named as (
  select rid, count(distinct item_id) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from hit) group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join covered using (rid) left join named using (rid)
"""


@query("op5_benchmark_decontamination", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate.report(docs, benchmark)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


OP6_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when first <> page_id then 'revisit' else 'response' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f using (payload_digest)
"""


@query("op6_warc_segments", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = (
    r"""
with c as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r0, text as t0, %s as body from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r0 nulls first, t0 nulls first)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, r0 nulls first, t0 nulls first) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(12 + length(role) + 1 + length(body) + 11) as bigint) as formatted_chars
from t group by conv_id
"""
)


def _escaped_sql(text: str) -> str:
    out = rf"replace({text}, '\', '\\')"
    for mark in reply_trees.CONTROL:
        out = rf"replace({out}, '{mark}', '{mark[0]}\{mark[1:]}')"
    return out


@query("op7_chat_formatting", OP7_SQL % _escaped_sql("coalesce(text, '')"))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    nodes = reply_trees.chains(rows.unionByName(extra))
    return reply_trees.digests(reply_trees.formatted(reply_trees.chosen(nodes)))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_crf.extract(pages, html_crf.learn(pages))


@query("op10_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "n_links")


def _op11_sql(count: int = 16, rounds: int = 3) -> str:
    """Rounds of nearest centroids and floored means, one group of CTEs a round."""
    apart = "cast(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint)"
    steps = [
        f"""v as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda e: cast(floor(64 * cast(e as double)) as bigint)) as x,
    sha256('1:' || coalesce(cast(vec_id as varchar), '')) as h
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
), c0 as materialized (
  select row_number() over (order by h, x) - 1 as k, x from v qualify row_number() over (order by h, x) <= {count}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} as materialized (select rid, min(struct_pack(d := d, k := k)) as b from (select v.rid, c.k, {apart} as d from v, c{i} as c) group by rid)"
        )
        if i < rounds:
            steps.append(
                f"""m{i} as materialized (
  select k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as x
  from (select a.b.k as k, j, cast(sum(v.x[j]) as hugeint) as s, count(*) as n from a{i} as a join v using (rid), range(1, 65) as r(j) group by 1, 2) group by k
), c{i + 1} as materialized (select c.k, coalesce(m.x, c.x) as x from c{i} as c left join m{i} as m using (k))"""
            )
    return (
        "with "
        + ", ".join(steps)
        + f"""
select vec_id, cast(b.k as integer) as cluster, b.d as distance, cast(sum(b.d) over (partition by b.k) as bigint) as cluster_inertia,
  cast(sum(b.d) over () as bigint) as inertia, sha256(array_to_string(list_transform(c.x, lambda e: cast(e as varchar)), ',')) as centroid_sha256
from a{rounds} as a join v using (rid) join c{rounds} as c on c.k = a.b.k
"""
    )


@query("op11_vantage_clusters", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_hidden_markov")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), _fold("doc_id", 10) == 0)


OP13_SQL = r"""
with d as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), t as (
  select rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), vocab as (
  select lang, term, count(*) as n from t group by lang, term having count(distinct rid) >= 3
), size as (select lang, count(*) as v, sum(n) as n from vocab group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t join vocab using (lang, term) group by all),
gn as (select lang, source, sum(n) as n from c group by all),
p as materialized (
  select g.lang, g.source, vocab.term, coalesce(c.n, 0) as n,
    cast(1 + (1000000000 * cast(coalesce(c.n, 0) + 1 as hugeint)) // (coalesce(gn.n, 0) + size.v) as bigint) as p,
    cast(1 + (1000000000 * cast(vocab.n + 1 as hugeint)) // (size.n + size.v) as bigint) as q
  from g join vocab using (lang) join size using (lang) left join c using (lang, source, term) left join gn using (lang, source)
), pair as (
  select a.lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // b.p) as bigint) as value
  from p as a join p as b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), every as (
  select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0) as value
  from g join g as h on g.lang = h.lang and g.source <> h.source left join pair on pair.lang = g.lang and pair.source = g.source and pair.item = h.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // q from p where n > 0 and p > q
), ranked as (
  select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from every
)
select * from ranked where part = 'pair' or rank <= 200
"""


@query("op13_source_divergence", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
