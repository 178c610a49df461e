"""Registered queries of this subpackage: one per operator, plus the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, chat, decontaminate, html_extract, langid, line_dedup, merkle, simhash, substring, topk, warc

TOKENIZER = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return found.select("doc_id", "text", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"))


_OP2_SQL = r"""
with recursive x as (
  select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents where text is not null
), z as (
  select doc_id, line, raw, folded, list_transform(string_split(folded, ' '), lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as toks
  from (select *, trim(regexp_replace(raw, '[ \t\r\f\x0B]+', ' ', 'g'), ' ') as folded from x)
), p as (
  select doc_id, line, toks, len(toks) as n, case when len(toks) >= 4 then array_to_string(toks, ' ') else folded end as pattern,
    case when len(toks) >= 4 then concat(len(toks), '|', array_to_string(toks[1:3], ' ')) else concat('s|', folded) end as leaf from z where folded <> ''
), pat as (
  select leaf, pattern, any_value(toks) as toks, any_value(n) as n, count(distinct doc_id) as docs from p group by 1, 2
), live(node, tid, pattern, toks, n, docs) as (
  select leaf, cast(null as varchar), pattern, toks, n, docs from pat
  union all
  (
    with a as (
      select node, pattern, toks, n, docs from live where tid is null
    ), sizes as (
      select node, sum(docs) as total from a group by 1 having sum(docs) >= 3 and count(*) > 1
    ), tok as (
      select node, i as pos, toks[i] as token, sum(docs) as docs from (select node, toks, docs, unnest(range(1, n + 1)) as i from a join sizes using (node)) group by 1, 2, 3
    ), top as (
      select node, pos, max_by(token, struct_pack(d := docs, t := token)) as token, max(docs) as docs, count(*) as kinds from tok group by 1, 2
    ), tmpl as (
      select node, list(case when top.docs * 2 >= total then token end order by pos) as template, min(struct_pack(k := kinds, p := pos)) filter (kinds > 1 and top.docs >= 3) as split
      from top join sizes using (node) group by 1
    ), held as (
      select a.*, split.p as pos, toks[split.p] as token, len(list_filter(range(1, n + 1), lambda i: coalesce(template[i] = toks[i], false))) >= n * cast(0.7 as double) as general
      from a join tmpl using (node)
    )
    select case when tok.docs >= 3 then concat(held.node, chr(10), held.pos, ' ', held.token) else concat(held.node, chr(10), held.pos) end, case when general then concat('g', held.node) end, pattern, toks, n, held.docs
    from held left join tok on tok.node = held.node and tok.pos = held.pos and tok.token = held.token where general or held.pos is not null
  )
), named as (
  select leaf, pattern, coalesce(tid, concat('p', pattern)) as tid from pat left join (select pattern, tid from live where tid is not null) using (pattern)
), occ as (
  select doc_id, line, tid from p join named using (leaf, pattern)
), rec as (
  select tid, min(struct_pack(d := doc_id, l := line)) as f from occ group by 1 having count(distinct doc_id) >= 3
), gone as (
  select doc_id, line from occ join rec using (tid) where doc_id <> f.d or line <> f.l
), back as (
  select z.doc_id, count(*) as n_lines, count(gone.line) as n_dropped, coalesce(string_agg(raw, chr(10) order by z.line) filter (gone.line is null), '') as text
  from z left join gone on gone.doc_id = z.doc_id and gone.line = z.line group by 1
)
select d.doc_id, back.text, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped from documents d left join back using (doc_id)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.classify(docs, langid.fit(docs), ["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ESCAPED_CHAT = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = lambda turn, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(ESCAPED_CHAT).alias("text"))
    extra = spark.range(1).select(F.inline(F.array(said(0, "user"), said(1, "assistant"))))
    rendered = chat.render(chat.reconstruct(chat.streamed_events(turns.union(extra))))
    return chat.summary(rendered).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


_OP5_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, length(replace(replace(replace(text, '\', '\0'), '</turn>', '\1/turn>'), '###', '\2')) as n,
    case when role in ('user', 'system', 'assistant') then length(role)
      else 1 + length(replace(replace(replace(replace(role, '\', '\0'), '</turn>', '\1/turn>'), '###', '\2'), ':', '\3')) end as m
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + m + 2 + n + 8) as bigint) as formatted_chars
from sized group by conv_id
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder = warc.archive_folder(pages)
    found = warc.read(warc.write(pages, folder), folder, payloads=False)
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


_OP8_SQL = """
with d as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), k as (
  select payload_digest as kd, max(page_id) as keeper from d where payload_bytes >= 1000 group by 1 having count(*) > 1
)
select page_id, payload_bytes, payload_digest,
  case when keeper <> page_id then 'revisit' else 'response' end as record_type,
  case when keeper <> page_id then keeper end as refers_to
from d left join k on kd = payload_digest
"""


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP10_SQL = f"""
with i as (
  select item_id, {_WORDS} as w from benchmark
), iw as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') as k
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from i where len(w) > 0)
), d as (
  select doc_id, {_WORDS} as w from documents
), dw as (
  select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as s from d cross join (select distinct n from iw))
), m as (
  select doc_id, item_id, s, n from dw join iw using (n, k)
), h as (
  select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + n)) as pos from m) group by 1
), t as (
  select doc_id, count(id) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from m) group by 1
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""

def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_OP11_SQL = """
with v as (
  select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.uid, a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score from v a join v b on a.uid <> b.uid where a.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by uid order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_table(spark, sf_dir, "documents"), *map(tokenizer_path, ALIGNED))


LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*LEAF_COLUMNS)
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    n_chars = F.col("n_chars").cast("decimal(38,0)")
    return merkle.manifest(docs, LEAF_COLUMNS, changed={"n_chars": F.when(struck, n_chars + 1).otherwise(n_chars)})


_OP13_SQL = """
with recursive crc as (
  select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(b as bigint))) as t
), sized as (
  select doc_id, lang, n_chars, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail,
    coalesce(xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda s: cast(ascii(s) as bigint)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295), 4294967295) % 7 = 0, false) as struck
  from documents, crc
), leaves as (
  select row_number() over () as uid, doc_id, lang, sha256(head || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || tail) as leaf,
    sha256(head || coalesce(strlen(cast(n_chars + cast(struck as int) as varchar)) || ':' || (n_chars + cast(struck as int)), '-') || tail) as now
  from sized
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n, dense_rank() over (order by lang nulls first) - 1 as g from leaves
), up as (
  select g, 0 as level, i, n, leaf as h from placed
  union all
  select * from (select g, any_value(level) + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by i)) from up where n > 1 group by g, i // 2)
), roots as (
  select g, h as subroot, count(*) over () as n, level as height from up where n = 1
), top as (
  select 0 as level, g as i, n, subroot as h from roots
  union all
  select * from (select any_value(level) + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by i)) from top where n > 1 group by i // 2)
), step as (
  select p.uid, u.level, case when s.h is not null then (p.i >> u.level) & 1 end as side, s.h as sibling
  from placed p join (select distinct g, level from up where n > 1) u using (g) left join up s on s.g = p.g and s.level = u.level and s.i = xor(p.i >> u.level, 1)
  union all
  select p.uid, r.height + t.level, case when s.h is not null then (p.g >> t.level) & 1 end, s.h
  from placed p join roots r using (g) cross join (select distinct level from top where n > 1) t left join top s on s.level = t.level and s.i = xor(p.g >> t.level, 1)
), path as (
  select uid, list(struct_pack(side := side, h := coalesce(sibling, '')) order by level) as steps from step group by uid
), folded as (
  select p.*, roots.subroot, (select h from top where n = 1) as root, coalesce(steps, []) as steps,
    coalesce(list_reduce(list_transform(steps, lambda s: struct_pack(side := s.side, h := s.h)), lambda acc, s: struct_pack(side := 0, h := sha256(case when s.side = 1 then s.h || acc.h else acc.h || s.h end)), struct_pack(side := 0, h := now)).h, now) as folded_root
  from placed p join roots using (g) left join path using (uid)
)
select doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(steps, lambda s: s.h), 'string_agg', '')) as proof_sha256, folded_root, folded_root = root as verified from folded
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_ann": op4_ann,
    "op5_chat": op5_chat,
    "op6_bpe": op6_bpe,
    "op10_decontaminate": op10_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_substring": op9_substring,
    "op11_exact_topk": op11_exact_topk,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {"op2_line_dedup": _OP2_SQL, "op10_decontaminate": _OP10_SQL, "op5_chat": _OP5_SQL, "op8_warc": _OP8_SQL, "op11_exact_topk": _OP11_SQL, "op13_merkle_manifest": _OP13_SQL}
