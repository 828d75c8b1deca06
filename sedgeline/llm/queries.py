"""The queries of the numbered operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.llm import (
    decontamination,
    fill_in_middle,
    hard_negatives,
    jaccard_join,
    language_id,
    line_dedup,
    maxent_lm,
    mixing,
    order_minhash,
    sentencepiece_bpe,
    sharding,
    suffix_dedup,
    warc,
)
from sedgeline.llm.common import documents


def remainder(modulus: int):
    """CRC-32 of doc_id as text, modulo; 0 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(documents(spark, sf_dir), held_out=remainder(7) == 2)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).select("doc_id", "source", "slot", "shard")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    bitmaps = line_dedup.keep_bitmaps(docs, policy=line_dedup.FREQUENT, min_docs=10, min_chars=1)
    kept = line_dedup.apply_bitmaps(docs, bitmaps)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.link_components(documents(spark, sf_dir), n=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (remainder(3) == 1).alias("held_out"))
    model = language_id.train(docs.filter(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.fingerprints(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.as_text(F.col("signature")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        order_minhash.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(documents(spark, sf_dir), benchmark, n=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(documents(spark, sf_dir))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), keep=["page_id"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = fill_in_middle.fill_in_middle(docs, texts=False)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded")
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_maxent_lm": op1_maxent_lm,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_order_minhash": op6_order_minhash,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_sentencepiece": op13_sentencepiece,
}

SQL = {
    "op4_jaccard_join": r"""
with recursive worded as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), shingles as (
  select distinct row, array_to_string(words[i : i + 2], ' ') as shingle
  from (select row, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) as i from worded where len(words) > 0)
), sizes as (
  select row, count(*) as n from shingles group by row
), shared as (
  select a.row as a, b.row as b, count(*) as n from shingles a join shingles b on a.shingle = b.shingle and a.row <> b.row group by all
), links as (
  select s.a, s.b from shared s join sizes x on x.row = s.a join sizes y on y.row = s.b where 100 * s.n >= 90 * (x.n + y.n - s.n)
), reached(row, other) as (
  select row, row from worded union select r.row, l.b from reached r join links l on l.a = r.other
), components as (
  select r.row, min(w.doc_id) as component_id from reached r join worded w on w.row = r.other group by r.row
)
select w.doc_id, coalesce(s.n, 0)::bigint as n_shingles, c.component_id from worded w join components c on c.row = w.row left join sizes s on s.row = w.row
""",
    "op8_suffix_dedup": r"""
with distinct_documents as (
  select distinct doc_id, text from documents
), worded as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from distinct_documents
), windows as (
  select row, doc_id, start, md5(array_to_string(words[start + 1 : start + 50], ' ')) as passage
  from (select row, doc_id, words, unnest(range(len(words) - 49)) as start from worded where len(words) >= 50)
), again as (
  select row, doc_id, start from windows where passage in (select passage from windows group by passage having count(*) > 1)
), marked as (
  select *, case when start <= lag(start) over (partition by row order by start) + 50 then 0 else 1 end as opens from again
), runs as (
  select *, sum(opens) over (partition by row order by start) as run from marked
)
select doc_id, min(start) as start_word, max(start) + 50 as end_word from runs group by row, doc_id, run
""",
    "op3_line_dedup": r"""
with numbered as (
  select row_number() over () as row, doc_id, hash(doc_id, text) as document, string_split(coalesce(text, ''), chr(10)) as lines from documents
), lines as (
  select row, doc_id, document, unnest(range(1, len(lines) + 1)) as pos, unnest(lines) as line from numbered
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), frequent as (
  select key from keyed where length(key) >= 1 group by key having count(distinct document) >= 10
), marked as (
  select k.*, f.key is not null as gone from keyed k left join frequent f on k.key = f.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by row, doc_id
""",
    "op7_decontamination": r"""
with doc_words as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), item_words as (
  select item_id::varchar as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark
), item_windows as (
  select distinct item, array_to_string(words[i : i + 9], ' ') as win, least(len(words), 10) as size
  from (select item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from item_words where len(words) > 0)
), sizes as (
  select distinct size from item_windows
), doc_windows as (
  select row, start, size, array_to_string(words[start : start + size - 1], ' ') as win
  from (select row, words, size, unnest(range(1, len(words) - size + 2)) as start from doc_words cross join sizes where len(words) >= size)
), hits as (
  select d.row, d.start, d.size, w.item from doc_windows d join item_windows w on d.win = w.win and d.size = w.size
), covered as (
  select row, count(distinct pos) as n_hit from (select row, unnest(range(start, start + size)) as pos from (select distinct row, start, size from hits)) group by row
), found as (
  select row, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by row
)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(f.n_items, 0)::bigint as n_items,
       sha256(coalesce(f.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from doc_words d left join covered c on d.row = c.row left join found f on d.row = f.row
""",
    "op10_mixing": r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, '')))) as draw
  from documents
), digits as (
  select *, length(bin(size))::double as w from sizes
), per_source as (
  select source, sum(size)::bigint as source_size from sizes group by source
), weighed as (
  select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
         source_size * 2.0::double as cap, (sum(source_size) over ())::double * 1.5::double as total
  from per_source
), levels as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
            / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from weighed
), common as (
  select arg_min(level, cap / weight) as level from levels where level * weight < cap
), targets as (
  select l.source, l.source_size, case when l.level * l.weight >= l.cap then l.cap else c.level * l.weight end as target
  from levels l cross join common c
), sums as (
  select source, w, sum(size)::bigint as words from digits group by source, w
), tried as (
  select s.*, t.source_size, t.target,
         (t.target - coalesce(sum(words * 2.0::double) over (partition by s.source order by w desc rows between unbounded preceding and 1 preceding), 0.0::double))
         / nullif(sum(words * w) over (partition by s.source order by w desc rows between current row and unbounded following), 0) as c
  from sums s join targets t on s.source is not distinct from t.source
), rates as (
  select source, source_size, target, arg_max(c, w) filter (where c * w < 2) as c from tried group by source, source_size, target
), certain as (
  select t.source, sum(floor(coalesce(least(r.c * t.w, 2), 2)) * t.words) as words from tried t join rates r on t.source is not distinct from r.source group by t.source
), expected as (
  select d.*, r.source_size, r.target, greatest(round(r.target - k.words, 3), 0.0::double) as wanted, coalesce(least(r.c * d.w, 2.0::double), 2.0::double) as e,
         (('0x' || substr(d.draw, 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from digits d join rates r on d.source is not distinct from r.source join certain k on d.source is not distinct from k.source
), quotients as (
  select *, floor(e)::bigint as whole, case when e > floor(e) then u / (1 - u) / ((e - floor(e)) / (1 - (e - floor(e)))) end as q from expected
), ranked as (
  select *, q / (1 + q) as place from quotients
), placed as (
  select *, q is not null and sum(size) over (partition by source, q is null order by place, draw, size rows between unbounded preceding and current row) - size / 2.0::double <= wanted as extra
  from ranked
)
select doc_id, size, source_size, target, whole + extra::bigint as copies, (whole + extra::bigint) * size as taken from placed
""",
    "op11_hard_negatives": r"""
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256.0::double * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as own, list_inner_product(a.v, b.v)::bigint as score
  from usable a join usable b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where own
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id, (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id))::int as rank,
       s.other_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and not s.own
  and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
""",
    "op12_fill_in_middle": r"""
with lines as (
  select doc_id, coalesce(text, '') as body, sha256('7:' || coalesce(doc_id::varchar, '')) as draw, string_split(coalesce(text, ''), chr(10)) as parts from documents
), counted as (
  select *, len(parts) - (parts[-1] = '')::int as n,
         ('0x' || draw[1:8])::bigint as h1, ('0x' || draw[9:16])::bigint as h2, ('0x' || draw[25:32])::bigint as h4
  from lines
), planned as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
         case when body = '' or regexp_matches(body, '<[PSM]>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from counted
), ends as (
  select *, case when low = 0 then 0 else length(array_to_string(parts[1:low], chr(10))) + (low < len(parts))::int end as first,
         case when high = 0 then 0 else length(array_to_string(parts[1:high], chr(10))) + (high < len(parts))::int end as last
  from planned
), made as (
  select *, body[1:first] as prefix, body[first + 1:last] as middle, body[last + 1:] as suffix from ends
)
select doc_id, n, form, case when form <> 'plain' then first end as prefix_chars, case when form <> 'plain' then last - first end as middle_chars,
       sha256(case form when 'plain' then body when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(body) as restored_sha256
from made
""",
}
