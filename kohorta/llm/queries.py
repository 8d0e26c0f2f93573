"""Queries of the text operators with their production parameters, and SQL for those it can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.llm.common import table
from kohorta.llm.decontamination import contamination
from kohorta.llm.fingerprints import fingerprint_edits
from kohorta.llm.hard_negatives import floored, mine_hard_negatives, usable_rows
from kohorta.llm.language import identify_languages, in_fold
from kohorta.llm.licenses import license_report
from kohorta.llm.line_dedup import dedup_lines
from kohorta.llm.mixing import mix_sources
from kohorta.llm.ngram_join import ngram_components
from kohorta.llm.periodic_runs import detect_runs
from kohorta.llm.quality import score_quality
from kohorta.llm.repeats import remove_repeats
from kohorta.llm.token_counts import TokenLedger, byte_pair_counter, count_changes, deletes, inserts, revisions, without_echoes, word_counter
from kohorta.llm.toxicity import score_toxicity
from kohorta.session import run_dir

#: Documents with fewer characters are deleted from the token ledger again.
SHORT_CHARS = 200


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after inserting all documents, revising those with echoed lines, deleting the short, and a repeated commit."""
    docs = table(spark, sf_dir, "documents")
    tokenizers = {"byte_bpe_50k/1": byte_pair_counter("byte_bpe_50k"), "words/1": word_counter}
    ledger = TokenLedger(spark, f"{run_dir(spark)}/token-ledger-{uuid.uuid4().hex}")
    revised = docs.withColumn("text", without_echoes(F.col("text")))
    batches = {
        "insert": inserts(docs),
        "revise": revisions(docs, without_echoes(F.col("text"))),
        "delete": deletes(revised.where(F.coalesce(F.length("text"), F.lit(0)) < SHORT_CHARS)),
    }
    for batch, changes in batches.items():
        ledger.commit(batch, count_changes(changes, tokenizers))
    ledger.commit("revise", count_changes(batches["revise"], tokenizers))
    return ledger.totals()


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", "text")


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), repetition=1.0, temper=0.5)


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has a label that is off by one."""
    given = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable_rows(given.withColumn("label", label), "vec_id", "embedding", "label").withColumn("vec", floored(F.col("vec")))
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_runs(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 2, 4))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_join": op4_ngram_join,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixture": op8_mixture,
    "op9_contamination": op9_contamination,
    "op10_license_scan": op10_license_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_language": op13_language,
}

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

#: Hash of a text made of a document's parts as a number in [0, 1).
_UNIFORM = "('0x' || substr(md5({}), 1, 13))::bigint / 4503599627370496.0::double"

LLM_ORACLE: dict[str, str] = {
    "op4_ngram_join": """
with recursive docs as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2)::bigint)) as i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
inner_sizes as (
  select a.doc_id as a, b.doc_id as b, count(*) as k
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from inner_sizes join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * k >= 75 * (x.n + y.n - k)),
reach as (select doc_id as start, doc_id as node from docs union select start, b from reach join links on a = node)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from docs join (select start as doc_id, min(node) as component_id from reach group by 1) using (doc_id)
left join sizes using (doc_id)""",
    "op8_mixture": f"""
with recursive sizes as (select source, count(*) as n from documents group by source),
shares as (select source, n, sqrt(n::double) as weight from sizes),
rates as (
  select source, weight / (select sum(weight) from shares) * (select sum(n) from shares) / n as rate from shares),
cdf as (
  select source, rate, 0 as k, exp(-rate) as term, exp(-rate) as below from rates
  union all
  select source, rate, k + 1, term * rate / (k + 1), below + term * rate / (k + 1) from cdf
  where k < rate + sqrt(rate) * 12 + 40),
drawn as (
  select d.*, (select count(*) from cdf c where c.source is not distinct from d.source and c.below <= d.u) as copies
  from (select *, {_UNIFORM.format("concat_ws(':', '8', 'draw', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))")} as u
        from documents) d),
spread as (select *, unnest(range(copies)) as copy from drawn)
select s.doc_id, s.text, s.lang, s.source, s.n_chars, r.rate, s.copies, s.copy,
  {_UNIFORM.format("concat_ws(':', '8', 'order', coalesce(doc_id::varchar, ''), copy::varchar, md5(coalesce(text, '')))")} as shuffle_key
from spread s join rates r on r.source is not distinct from s.source""",
    "op9_contamination": f"""
with docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
items as (select item_id::varchar as item, {_WORDS} as w from benchmark),
windows as (
  select item, 13 as k, array_to_string(w[i : i + 12], ' ') as run
  from (select item, w, unnest(range(1, len(w) - 11)) as i from items where len(w) >= 13)
  union
  select item, len(w), array_to_string(w, ' ') from items where len(w) between 1 and 12),
runs as (
  select r, k, i, array_to_string(w[i : i + k - 1], ' ') as run
  from (select r, w, k, unnest(range(1, (len(w) - k + 2)::bigint)) as i
        from docs, (select distinct k from windows) where len(w) >= k)),
found as (select r, i, runs.k, item from runs join windows using (k, run)),
hits as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from found) group by r),
named as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct r, item from found where item is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hits using (r) left join named using (r)""",
    "op11_hard_negatives": """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as vec
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.vec, b.vec)::bigint as score
  from usable a join usable b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
  (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::integer as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10""",
    "op12_periodic_runs": """
with given as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) as h
  from documents),
cuts as (select *, len(w)::bigint as n, h // 10 as g, h % 10 = 0 and len(w) > 0 as loops from given),
starts as (select *, case when loops then g % n end as a from cuts),
units as (select *, case when loops then 1 + (n - a) // (3 + g % 8) end as p from starts),
texts as (
  select r, doc_id, n, case when loops then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) else w end as w
  from units),
grams as (
  select r, i, w[i + 1 : i + 5] as gram from (select r, w, unnest(range(n - 4)) as i from texts where n >= 6)),
pairs as (
  select a.r, a.i, b.i - a.i as q from grams a join grams b on a.r = b.r and a.gram = b.gram and a.i < b.i),
islands as (select r, q, i, i - row_number() over (partition by r, q order by i) as k from pairs),
stretches as (select r, q, min(i) as start, count(*) + 4 + q as length from islands group by r, q, k),
runs as (
  select r, start, length, min(q) as period from stretches where length >= greatest(6, 4 * q) group by r, start, length),
best as (
  select * from runs
  qualify row_number() over (partition by r order by length::double / period desc, start, period) = 1),
listed as (
  select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as l
  from runs group by r),
gone as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
words as (select r, unnest(range(n)) as i, unnest(w) as word from texts where n > 0),
kept as (
  select r, string_agg(word, ' ' order by i) as t from words left join (select r, i, true as cut from gone) using (r, i)
  where cut is null group by r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, start::bigint as start, length::bigint as length, period::bigint as period,
  (1000 * length // period)::bigint as exponent_milli, sha256(coalesce(l, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from texts left join best using (r) left join listed using (r) left join kept using (r)""",
}
