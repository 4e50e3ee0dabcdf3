"""The queries of the corpus operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat, collocation, language_id, mixing, ogg, packing, quality, search, shard_tree, simhash, toxicity, trie, warc
from lodestone.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.predict(docs, language_id.fit(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.withColumn("held_out", held_out)


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digests(ogg.media(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_tree.assign(table(spark, sf_dir, "documents"), shard_tree.Tree.even())
    return placed.withColumn("law", F.lit("key"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    settings = packing.Settings(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), settings)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", "valid")


def op9_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), settings=mixing.Settings(budget=None))


def op10_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.search(queries, docs)


def op11_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select * from values (-1L, 0L, 'user', '{ok}'), (-1L, 1L, 'assistant', '{ok}') t(conv_id, turn, role, text)")
    return chat.digests(chat.formatted(turns.unionByName(more)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    family, shared = c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6
    return trie.nodes(table(spark, sf_dir, "conversations"), family, shared)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ogg": op2_ogg,
    "op3_toxicity": op3_toxicity,
    "op4_hash_tree": op4_hash_tree,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_pfair": op9_pfair,
    "op10_bm25_wand": op10_bm25_wand,
    "op11_chat_grammar": op11_chat_grammar,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}

#: A SHA-1 in base32: eight letters for each ten hex digits.
BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {10 * c + 1}, 10))::bigint >> {35 - 5 * k}) & 31) + 1)::int, 1)"
    for c in range(4)
    for k in range(8)
)

#: Models, media digests, checksums and schedules are beyond SQL; see tests/llm for the brute-force versions.
SQL: dict[str, str] = {
    "op6_warc": f"""
with p as (select page_id, url, coalesce(html, '') body from pages),
d as (select *, sha1(encode(body)) h, max(page_id) over (partition by body) latest from p)
select page_id, octet_length(encode(body)) payload_bytes, {BASE32} payload_digest,
  case when page_id = latest then 'response' else 'revisit' end record_type, case when page_id <> latest then latest end refers_to,
  url target, true valid from d""",
    "op10_bm25_wand": r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents),
dt as (select doc_id, len(w) dl, unnest(w) term from d),
tf as (select doc_id, dl, term, count(*) tf from dt group by all),
s as (select count(*) n, sum(coalesce(len(w), 0)) / count(*) mean from d),
idf as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) idf from tf, s group by term, n),
q as (select doc_id query_id, term, tf qtf from tf where doc_id % 50 = 0),
sc as (
  select query_id, doc_id, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) score
  from q join idf using (term) join tf using (term), s group by 1, 2)
select query_id, rank, doc_id, score from (
  select *, row_number() over (partition by query_id order by score desc, doc_id) rank from sc) where rank <= 10
""",
    "op11_chat_grammar": r"""
with c as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, regexp_replace(regexp_replace(r, '(\[)(\\*/?INST\])', '\1\\\2', 'g'), '(<)(\\*/?s>)', '\1\\\2', 'g') er,
    regexp_replace(regexp_replace(t, '(\[)(\\*/?INST\])', '\1\\\2', 'g'), '(<)(\\*/?s>)', '\1\\\2', 'g') et from c)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) turns_sha256,
  coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (r = 'assistant'), '')) loss_sha256,
  (3 + sum(17 + length(er) + length(et)))::bigint formatted_chars, count(*) filter (er <> r or et <> t) n_escaped, true identical
from e group by conv_id
""",
    "op12_collocations": r"""
with p as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
g as (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) phrase
  from w, (values (1), (2), (3)) t(m) where len(w) >= m),
f as (select lang, m, phrase, count(*) f from g group by all having count(*) >= 10),
cuts as (
  select lang, m, phrase, f a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') lp, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') rp
  from f, (values (1), (2)) t(k) where k < m),
sc as (
  select cuts.*, x.f l, y.f r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint score
  from cuts join f x on x.lang = cuts.lang and x.phrase = lp join f y on y.lang = cuts.lang and y.phrase = rp),
c as (select * from sc qualify row_number() over (partition by lang, phrase order by score, k) = 1),
sub as (
  select lang, inner_phrase phrase, max(a) longer from (
    select lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) inner_phrase from c where m = 3)
  group by all),
kept as (select c.* from c left join sub using (lang, phrase) where longer is null or 100 * longer < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join (select lang, sum(len(w))::bigint n from w group by lang) using (lang) where rank <= 2000
""",
    "op13_prefix_trie": r"""
with own as (
  select conv_id c, row_number() over (partition by conv_id order by turn nulls first) - 1 i, coalesce(role, '') r, coalesce(text, '') t
  from conversations where conv_id is not null),
convs as (
  select c, c - c % 100 base, n, (4294967295 - list_reduce(list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint), lambda s, b:
    xor(s >> 8, list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(s, b) & 255)), 4294967295)) % 6 h
  from (select c, count(*) n from own group by c)),
re as (
  select a.c, i, r, t from convs a join own b on b.c = a.base and b.i < a.h
  union all select a.c, i - a.h + least(a.h, coalesce(z.n, 0)), r, t from convs a join own b on b.c = a.c and b.i >= a.h left join convs z on z.c = a.base),
keyed as (
  select c, i + 1 d, length(t) last, sha256(string_agg(sha256(length(r) || ':' || r || t), '') over (partition by c order by i)) k from re
  union all select c, 0, 0, '' from convs),
p as (select *, max(d) over (partition by c) turns from keyed),
n as (select d, k, min(c) conv_id, count(*) n, max(last) last, max(turns) = d leaf,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (turns = d), '')) ends from p group by d, k),
up as (select distinct a.d, a.k, b.d bd, b.k bk from p a join p b on a.c = b.c and b.d >= a.d),
su as (select up.d, up.k, sum(leaf::int) leaves, sum((n - 1) * last) saved, sum((bd = up.d + 1)::int) kids
  from up join n on n.d = bd and n.k = bk group by all)
select n.conv_id, n.d depth, m.conv_id parent_conv_id, n.n n_convs, kids::bigint n_children, leaves::bigint n_leaves,
  saved::bigint saved_tokens, n.ends ends_sha256
from n join su using (d, k) left join (select distinct b.d, b.k, a.d ad, a.k ak from p a join p b on a.c = b.c and a.d = b.d - 1) e on e.d = n.d and e.k = n.k
left join n m on m.d = ad and m.k = ak
""",
}
