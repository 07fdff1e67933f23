"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from linienwerk.llm.centroids import cluster_vectors
from linienwerk.llm.chat import format_chat, masked_text, parse_chat
from linienwerk.llm.common import table
from linienwerk.llm.embed_dedup import embedding_duplicates
from linienwerk.llm.minhash import near_duplicates
from linienwerk.llm.mixing import mix_sources
from linienwerk.llm.packing import pack_documents
from linienwerk.llm.quality_rules import CLASSES, COMMON, SYMBOLS, quality_rules
from linienwerk.llm.rule_ensemble import classify_quality
from linienwerk.llm.suffix_dedup import dedup_repeats
from linienwerk.llm.token_counts import count_tokens
from linienwerk.llm.token_links import link_tokens
from linienwerk.llm.token_records import read_token_records, write_token_records
from linienwerk.llm.warc import read_warc, write_warc
from linienwerk.shared import fresh_dir


def op1_embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op2_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_dir(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(manifest, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_dir(spark, "tokens")
    manifest = write_token_records(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_records(manifest, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op6_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    chats = format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    turns, loss = parse_chat(F.col("formatted")), masked_text(F.col("formatted"), F.col("spans"))
    read = chats.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return found.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op13_ns_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_embedding_itq, op2_warc_writer, op3_source_mix, op4_token_records, op5_dart_minhash, op6_quality_divergence, op7_balanced_packing, op8_chat_format, op9_rule_ensemble, op10_suffix_repeats, op11_token_links, op12_whole_tokens, op13_ns_centroids)}

#: The components of links as SQL, for a table ``links(a, b)`` of both directions and ``nodes(id)``.
_COMPONENTS = """reach(id, other) as (select id, id from nodes union select r.id, l.b from reach r join links l on l.a = r.other),
comp as (select id, min(other) component from reach group by id)"""



def _quality_sql() -> str:
    """Base columns, histograms, references by language and their Jensen-Shannon distances as SQL."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    without = lambda p: f"length(regexp_replace(t, {text(p)}, '', 'g'))"
    listed = "case lang " + " ".join(f"when {text(k)} then [{', '.join(map(text, v))}]" for k, v in COMMON.items()) + " end"
    n_char, n_word = len(CLASSES) + 2, max(map(len, COMMON.values())) + 1
    mean = lambda c, n: "[" + ", ".join(f"coalesce(avg({c}[{k}]), 0)" for k in range(1, n + 1)) + "]"
    part = lambda x, y: f"case when {x} > 0 then {x} * log2(2 * {x} / ({x} + {y})) else 0 end"
    far = lambda p, q, n: f"sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda i: {part(f'{p}[i]', f'{q}[i]')} + {part(f'{q}[i]', f'{p}[i]')})) / 2))"
    return rf"""with d as (select row_number() over () r, doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select r, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') s from (select r, w, unnest(range(1, len(w) - 6)) i from d where len(w) > 8)),
rep as (select r, i from win qualify count(*) over (partition by r, s) > 1), cov as (select r, count(distinct i + k) n from rep, (select unnest(range(0, 8)) k) group by r),
c as (select d.*, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls, length(t) n_chars, length(array_to_string(w, '')) wc, {listed} listed from d),
e as (select *, [{', '.join(without(p) for p in CLASSES.values())}, n_chars - wc] ch, list_transform(listed, lambda x: len(list_filter(w, lambda y: y = x))) hits from c),
s as (select r, doc_id, lang, len(w)::bigint n_words, wc::bigint word_chars, {without(f'[^{SYMBOLS}]+')}::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words, n_chars,
 list_transform(list_append(ch, n_chars - list_sum(ch)::bigint), lambda x: x / greatest(n_chars, 1)) hc, list_transform(list_append(hits, len(w) - list_sum(hits)::bigint), lambda x: x / greatest(len(w), 1)) hw from e left join cov using (r)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, n_words >= 60 and n_chars >= 200 long_ from s),
ref as (select lang, {mean('hc', n_char)} rc, {mean('hw', n_word)} rw from f where not base_failed and long_ group by lang having count(*) >= 5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and not (coalesce(long_ and {far('hc', 'rc', n_char)} > 0.35, false) or coalesce(long_ and {far('hw', 'rw', n_word)} > 0.45, false)) kept
from f left join ref on ref.lang is not distinct from f.lang"""


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's method as SQL, a search of all centroids in each round."""
    parts = [
        """raw as (select vec_id, list_transform(embedding, lambda v: v::double) e from embeddings where len(embedding) = 64),
v as materialized (select row_number() over () r, vec_id, list_transform(e, lambda v: floor(256 * v)::bigint) x from raw where len(list_filter(e, lambda v: v is not null and isfinite(v))) = 64)""",
        f"c0 as materialized (select (row_number() over (order by sha256('2:' || vec_id) nulls last, x) - 1)::int cluster, x from v qualify cluster < {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} as materialized (select r, min(row(d, cluster)) b from (select r, cluster, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::bigint d from v, c{t} c) group by r)""")
        if t < rounds:
            parts.append(f"""m{t} as (select cluster, list(y order by i) x from (select cluster, i, floor(sum(y)::double / count(*))::bigint y from (select b[2] cluster, unnest(v.x) y, unnest(range(1, 65)) i from a{t} join v using (r)) group by all) group by cluster),
c{t + 1} as materialized (select cluster, coalesce(m.x, c.x) x from c{t} c left join m{t} m using (cluster))""")
    last = f"""select vec_id, b[2]::int "cluster", b[1]::bigint distance, (sum(b[1]) over (partition by b[2]))::bigint cluster_inertia, (sum(b[1]) over ())::bigint inertia,
sha256(list_aggregate(list_transform(c.x, lambda y: y::varchar), 'string_agg', ',')) centroid_sha256 from a{rounds} join v using (r) join c{rounds} c on c.cluster = b[2]"""
    return "with " + ",\n".join(parts) + "\n" + last


ORACLE_SQL = {
    "op13_ns_centroids": _centroid_sql(),
    "op6_quality_divergence": _quality_sql(),
    "op1_embedding_itq": f"""with recursive nodes as (select vec_id id, embedding::double[] e from embeddings),
pairs as (select x.id a, y.id b from nodes x join nodes y on x.id < y.id and list_cosine_similarity(x.e, y.e) >= 0.9),
links as (select a, b from pairs union all select b, a from pairs), {_COMPONENTS}
select c.id vec_id, coalesce(n, 0)::bigint n_links, component component_id, c.id = component kept
from comp c left join (select a, count(*) n from links group by a) l on l.a = c.id""",
    "op2_warc_writer": """with p as (select page_id, strlen(coalesce(html, ''))::bigint n, upper(sha1(coalesce(html, ''))) h from pages),
f as (select h, min(page_id) first from p group by h),
d as (select p.*, first, list_transform(range(0, 8), lambda g: ('0x' || substr(p.h, g * 5 + 1, 5))::bigint) v from p join f using (h))
select page_id, n payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v[i // 4 + 1] >> (5 * (3 - i % 4))) & 31) + 1]), 'string_agg', '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type, case when page_id > first then first end refers_to from d""",
    "op3_source_mix": r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
s as (select source, sum(size)::bigint source_size, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double weight from d group by source),
r as (select *, 2.0::double * source_size cap, 2.0::double * source_size / weight r from s),
o as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by r, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by r, source nulls last rows between current row and unbounded following) lv from r),
t as (select source, source_size, least(cap, weight * (max(case when lv <= r then lv end) over ())) target from o),
k as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0 end rate, ('0x' || substr(md5('7:' || coalesce(d.source, '')), 1, 8))::bigint / 4294967296.0::double u,
  row_number() over (partition by d.source order by size, doc_id) - 1 i from d join t on d.source is not distinct from t.source),
c as (select *, least(ceil(rate), floor((i + 1) * rate + u) - floor(i * rate + u))::bigint copies from k)
select doc_id, size, source_size, target, copies * size taken, copies from c""",
    "op5_dart_minhash": rf"""with recursive w as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') w from documents where text is not null),
g as (select doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) s from w where len(w) > 0),
e as (select doc_id, s, count(*) c from g group by all), tot as (select doc_id, sum(c) n from e group by 1),
shared as (select x.doc_id a, y.doc_id b, sum(least(x.c, y.c)) m from e x join e y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
pairs as (select a, b from shared join tot p on p.doc_id = a join tot q on q.doc_id = b where m / (p.n + q.n - m)::double >= 0.8),
nodes as (select doc_id id from documents), links as (select a, b from pairs union all select b, a from pairs), {_COMPONENTS}
select id doc_id, component class_id, id = component kept from comp""",
    "op10_suffix_repeats": """with d as (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, ''))::bigint n from documents),
win as (select doc_id, i, substr(h, 2 * i + 1, 200) s from (select doc_id, h, unnest(range(0, n - 99)) i from d where n >= 100)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) k from win) where k > 1),
isle as (select doc_id, i, sum(case when i <= prev + 100 then 0 else 1 end) over (partition by doc_id order by i) z from (select *, lag(i) over (partition by doc_id order by i) prev from late)),
span as (select doc_id, z, min(i) a, max(i) + 100 b from isle group by all),
gap as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) f, a t from span union all select doc_id, max(b), null from span group by 1),
kept as (select doc_id, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, n) - f)), '' order by f) k from gap join d using (doc_id) group by 1),
cnt as (select doc_id, sum(b - a)::bigint r, count(*)::bigint c from span group by 1)
select d.doc_id, n n_bytes, coalesce(r, 0) n_removed, coalesce(c, 0) n_spans, sha256(unhex(coalesce(k, h))) kept_sha256 from d left join kept using (doc_id) left join cnt using (doc_id)""",
    "op8_chat_format": r"""with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, contains(text, '###') or contains(text, '</turn>') or contains(text, '\') x from t),
f as (select *, '### ' || role || ': ' || case when x then replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') else text end || ' </turn>' || chr(10) p from e)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) loss_sha256, sum(length(p))::bigint formatted_chars from f group by conv_id""",
}
