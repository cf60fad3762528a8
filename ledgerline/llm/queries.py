"""Check queries of the corpus operators: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import conversations, embedding_dedup, hard_negatives, language_id, minhash, nearest, packing, pii, quality, resharding, secret_scan, tokenize, toxicity
from ledgerline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.digest_documents(table(spark, folder, "documents"))


@query("op9_secret_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan_documents(table(spark, folder, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@query("op10_mixture_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


#: Key of the check queries; a real run passes a secret of its own.
PII_KEY = "check"


@query("op5_pii_pseudonyms")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = pii.with_pseudonyms(table(spark, folder, "documents").select("doc_id", "text"), PII_KEY, found="found")
    count = lambda kind: F.size(F.filter("found", lambda h: h["kind"] == kind)).cast("bigint")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS], "text")


@query("op3_quality_classifier")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_bagminhash_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.deduplicate(table(spark, folder, "documents"))


@query("op6_hilbert_neighbours")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_projection_forest_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"))


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "pages"), table(spark, folder, "documents"))


@query("op13_hard_negatives", """
with kept as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as vec
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_inner_product(a.vec, b.vec)::bigint as score
  from kept a join kept b on a.vec_id <> b.vec_id and len(a.vec) = len(b.vec) where a.vec_id % 100 = 0),
positive as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score,
  score as negative_score
from positive p join scored s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op11_flow_resharding")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return resharding.shard_documents(resharding.located(spark, f"{folder}/documents.parquet"))


def _repair_sql() -> str:
    """A plain dynamic program from the last row back: states 0 to 3 as in :mod:`ledgerline.llm.conversations`, least "cost, audit" as text."""
    after = conversations.NEXT
    moves = []
    for p in conversations.STATES:
        q = p
        for k in range(3):  # inserted rows before the edit
            moves += [(p, k, "D", "", q), (p, k, "R", "", after[q]), (p, k, "K", conversations.INITIAL[after[q]], after[q])] + ([(p, k, "K", "s", 1)] if q == 0 else [])
            q = after[q]
    return rf"""with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
hashed as (select *, xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(key, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end) end), 4294967295) % 20 as kind from keyed),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy from hashed where kind <> 0),
placed as (select *, left(role, 1) as ini, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i, count(*) over (partition by conv_id) as n from damaged),
o as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else 'good' end as fault, lead(ini) over (partition by conv_id order by i) as follows from placed),
t(p, k, op, ini, q) as (values {", ".join(str(m) for m in moves)}),
r(conv_id, i, p, v) as (
  select distinct conv_id, n + 1, e.p, e.v from o, (values (0, '000000000000'), (1, '000000000010II'), (2, '000000000005I'), (3, '000000000000')) e(p, v)
  union all
  select o.conv_id, o.i, t.p, min(lpad((left(r.v, 12)::bigint + 5 * t.k + case t.op when 'D' then 2 when 'R' then 1 else 0 end + case when t.op <> 'D' and o.fault = 'truncated' then 5 else 0 end)::varchar, 12, '0')
    || repeat('I', t.k) || t.op || substr(r.v, 13))
  from r join o on o.conv_id is not distinct from r.conv_id and o.i = r.i - 1 join t on t.q = r.p
  where (t.op = 'D' or o.fault not in ('blank', 'duplicate')) and (t.op <> 'K' or t.ini = o.ini) group by o.conv_id, o.i, t.p),
best as (select conv_id, left(v, 12)::bigint as cost, substr(v, 13) as audit from r where i = 1 and p = 0),
letters as (select conv_id, unnest(string_split(audit, '')) as op, generate_subscripts(string_split(audit, ''), 1) as pos from best where audit <> ''),
steps as (select *, count(*) filter (where op <> 'I') over w as i, count(*) filter (where op <> 'D') over w as m from letters window w as (partition by conv_id order by pos)),
lines as (select s.conv_id, s.pos, s.op, s.m, o.role, o.text, max(case when s.op = 'K' and s.m = 1 and o.ini = 's' then 1 else 0 end) over (partition by s.conv_id) as has_system
  from steps s left join o on s.op <> 'I' and o.conv_id is not distinct from s.conv_id and o.i = s.i where s.op <> 'D'),
said as (select conv_id, string_agg(case op when 'K' then role || ':' || text else case when (m - has_system) % 2 = 1 then 'user:' else 'assistant:' end || case op when 'R' then text else '' end end, chr(10) order by pos) as body
  from lines group by conv_id),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
  count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where follows is not null and ini || follows not in ('su', 'ua', 'au')) as illegal from o group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join facts f on f.conv_id is not distinct from c.conv_id left join best b on b.conv_id is not distinct from c.conv_id left join said d on d.conv_id is not distinct from c.conv_id"""


@query("op12_conversation_repair", _repair_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.summary(conversations.damaged(turns))
    every = turns.select("conv_id").distinct().withColumn("__conv", conversations.key_of("conv_id"))
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return every.join(found, F.col("__conv") == F.col("conv"), "left").select("conv_id", *[F.coalesce(c, none.get(c, F.lit(0))).alias(c) for c in found.columns[1:]])
