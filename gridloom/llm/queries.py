"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import (
    backoff_lm,
    chat_trees,
    decontaminate,
    fingerprints,
    language_crf,
    licenses,
    line_templates,
    mixing,
    near_dup,
    phrases,
    vectors,
    warc,
    whitening,
)
from gridloom.llm.store import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.curriculum_mix(_table(spark, sf_dir, "documents"))
    return mix.select(
        "doc_id", F.col("size").cast("long"), F.col("source_size").cast("long"), F.round("target", 6).alias("target"), F.col("taken").cast("long"),
        "source", F.size("copies").cast("long").alias("copies"), F.round("position", 9).alias("position"),
    )


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_templates.drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_dropped", "text")


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.get("licenses", F.lit(0))
    return licenses.license_matches(_table(spark, sf_dir, "documents")).select(
        "doc_id", "best_license", F.round(best["dice"], 9).alias("best_dice"), F.size("licenses").cast("long").alias("n_licenses"),
        best["start"].cast("long").alias("start"), best["words"].cast("long").alias("words"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    done = chat_trees.format_branches(chat_trees.chain_replies(turns.unionByName(extra)))
    done = done.withColumn("turns", chat_trees.parse_turns(F.col("formatted"))).withColumn(
        "loss", chat_trees.loss_text(F.col("formatted"), F.col("loss_mask"))
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score_documents(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = language_crf.fit(language_crf.training_sample(docs.filter(~held_out)))
    return language_crf.predict_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).drop("payload", "url")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_line_templates, op3_minhash_near_dup, op4_benchmark_decontamination, op5_license_scan,
        op6_chat_format, op7_embedding_near_dup, op8_lm_score, op9_language_id, op10_warc_archive,
        op11_phrase_collocations, op12_embedding_whitening, op13_document_fingerprints,
    )
}

_CHAT_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
),
marked as (
  select *, '{chat_trees.TURN}' || replace(replace(role, '\\', '\\\\'), '<|', '<\\|') || '{chat_trees.BODY}'
    || replace(replace(text, '\\', '\\\\'), '<|', '<\\|') || '{chat_trees.END}' as piece
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, md5(text))) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, md5(text)), '')) as loss_sha256,
  sum(length(piece))::bigint as formatted_chars
from marked group by conv_id
"""

_WARC_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from d left join f using (payload_digest)
"""


_MIX_SQL = """
with z as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  md5('0:' || coalesce(doc_id::varchar, 'null')) as h from documents),
k as (select source, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from (select distinct source from z)),
p as (select k.source, weight, s as source_size, 2.0::double * s as cap, 2.0::double * s / weight as ratio
  from k join (select source, sum(size)::bigint as s from z group by source) q on k.source is not distinct from q.source),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over o, 0)) / (sum(weight) over () - coalesce(sum(weight) over o, 0)) as level
  from p window o as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select arg_min(level, ratio) as fixed from l where level <= ratio),
t as (select source, weight, source_size, least(cap, weight * fixed) as target from l, f),
r as (select z.doc_id, z.source, size, source_size, weight, target, round(target)::bigint as goal,
  coalesce(sum(size) over (partition by z.source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from z join t on z.source is not distinct from t.source),
w as (select *, greatest(least(size, goal - start), 0) as w1, greatest(least(size, goal - start - source_size), 0) as w2, start / nullif(target, 0) * weight as d from r)
select doc_id, size, source_size, round(target, 6) as target, w1 + w2 as taken, source, ((w1 > 0)::int + (w2 > 0)::int)::bigint as copies,
  case when w1 > 0 then round(case weight when 3 then (-1.5 + sqrt(2.25 + 6 * d)) / 3 when 1 then d else (3 - sqrt(9 - 4 * d)) / 2 end, 9) end as position
from w
"""

_VECTOR_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
u as (select vec_id, e from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a, least(a, min(b)) as component_id from reach group by a),
n as (select a, count(*) as n from l group by a)
select v.vec_id, coalesce(n.n, 0) as n_links, coalesce(component_id, v.vec_id) as component_id, v.vec_id = coalesce(component_id, v.vec_id) as kept
from v left join c on c.a = v.vec_id left join n on n.a = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": _MIX_SQL,
        "op5_license_scan": licenses.dice_sql(),
        "op6_chat_format": _CHAT_SQL,
        "op10_warc_archive": _WARC_SQL,
        "op7_embedding_near_dup": _VECTOR_SQL,
        "op11_phrase_collocations": phrases.collocation_sql(),
        "op13_document_fingerprints": fingerprints.fingerprint_sql(),
    }
