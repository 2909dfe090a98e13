"""The opN_ queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.llm import byte_bpe, html_text, importance, jaccard, licences, media, packing, pii, quality_classifier, quality_rules, simhash, spelling, token_files
from skycat.llm.common import table, tokenizer_file, written


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), ids=False)
    return packing.pack(written(pieces, "pieces")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    where = tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *where)
    return byte_bpe.digests(byte_bpe.decode(encoded, *where))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return token_files.digests(token_files.read_tokens(manifest))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(media.text_media(table(spark, sf_dir, "documents")), "media")
    return media.media_features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.sha2("tile", 256).alias("tile_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_personal_data(docs, count="n_replaced")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base_failed = ~quality_rules.BASE.keeps()
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), quality_rules.STRICT.keeps().alias("kept"), F.col("failed").alias("failed_bits"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_packing, op2_byte_bpe, op3_quality_classifier, op4_token_files, op5_media, op6_simhash, op7_pii, op8_quality_rules, op9_html_text, op10_licences, op11_importance, op12_spelling, op13_jaccard, pipeline)}


#: op8: the whole ledger as DuckDB SQL, from the words and windows of each text.
OP8_SQL = r"""
with d as (select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as l from documents),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3),
v as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as s from g),
c as (select doc_id, i, count(*) over (partition by doc_id, s) as n from v),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i+1, i+2]) as p from c where n > 1) group by doc_id),
m as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(len(l) as bigint) as n_lines,
    cast(coalesce(r.n_repeat_words, 0) as bigint) as n_repeat_words,
    length(regexp_replace(body, '\P{Lu}+', '', 'g')) as n_upper, length(regexp_replace(body, '\P{L}+', '', 'g')) as n_letters,
    cast(len([i for i in range(2, len(w) + 1) if w[i] = w[i-1]]) as bigint) as n_runs
  from d left join r using (doc_id)),
b as (select *, cast((case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
  + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when 3 * n_dup_lines > n_lines then 8 else 0 end)
  + (case when 2 * n_upper > word_chars then 16 else 0 end) + (case when word_chars > 14 * n_words then 32 else 0 end)
  + (case when 10 * n_letters < 6 * word_chars then 64 else 0 end) + (case when 20 * n_runs > n_words then 128 else 0 end) as bigint) as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 as base_failed, failed_bits = 0 as kept, failed_bits from b
"""


#: CRC-32 of the bytes of a text, from the 256 values of its table.
_CRC = """tab as (select list(c order by i) as t from (select i, list_reduce([cast(i as bigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) r(i)))"""
_CRC_OF = "xor(list_reduce([4294967295] || [cast('0x' || substr(hex(encode({0})), 2*k+1, 2) as bigint) for k in range(octet_length(encode({0})))], lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: op11: every occurrence joined to the gain of its bucket, and one global window for the ranks.
OP11_SQL = f"""
with {_CRC}, d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW}, {_ALNUM}) as w from documents),
o as (select r, unnest(w) as w from d), b as (select unnest(regexp_extract_all({_LOW}, {_ALNUM})) as w from benchmark),
v as (select w, {_CRC_OF.format("w")} % 10000 as slot from (select w from o union select w from b), tab),
s as (select slot, count(*) as n from o join v using (w) group by 1), t as (select slot, count(*) as n from b join v using (w) group by 1),
g as (select x.slot, cast(floor(1000*ln(cast((coalesce(t.n,0)+1)*((select coalesce(sum(n),0) from s)+10000) as double)/cast((coalesce(s.n,0)+1)*((select coalesce(sum(n),0) from t)+10000) as double))) as bigint) as gain from range(10000) x(slot) left join s on s.slot=x.slot left join t on t.slot=x.slot),
k as (select r, cast(sum(gain) as bigint) as weight from o join v using (w) join g using (slot) group by r),
c as (select d.r, d.doc_id, cast(len(w) as bigint) as n_features, coalesce(weight, 0) as weight, cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h from d left join k using (r)),
e as (select *, weight + cast(floor(-1000*ln(-ln((h+0.5e0)/4294967296e0))) as bigint) as score from c),
p as (select r, row_number() over (order by score desc, doc_id, weight, n_features) as place from e where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= (select count(*) * 10 // 100 from p) then place end as rank from e left join p using (r)
"""

#: op12: all words with one letter left out, joined to each other and to the words, and the chain followed by recursion.
OP12_SQL = f"""
with recursive {_CRC}, d as (select coalesce(cast(doc_id as varchar), '') as doc_id, unnest(regexp_extract_all({_LOW}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as w from documents),
a as (select doc_id, w, count(*) as n from d group by 1, 2), h as (select w, n, {_CRC_OF.format("(doc_id || ':' || w)")} as h from a, tab),
x as (select case when h % 97 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from h),
w as materialized (select word, cast(sum(n) as bigint) as n from x where length(word) >= 5 group by 1 having sum(n) >= 3),
l as materialized (select word, k, substr(word, 1, k) || substr(word, k + 2) as rest from w, range(64) r(k) where k < length(word)),
p as (select a.word, b.word as near from l a join l b on a.k = b.k and a.rest = b.rest and a.word <> b.word union select word, rest from l join w using (word) where rest in (select word from w) union select rest, word from l where rest in (select word from w)),
q as (select p.word, near, w.n as near_n, row_number() over (partition by p.word order by w.n desc, near) as rn, count(*) over (partition by p.word) as n_near from p join w on w.word = p.near),
f as materialized (select w.word, w.n, cast(coalesce(n_near, 0) as bigint) as n_near, case when near_n >= 2 * w.n then near end as form, case when near_n >= 2 * w.n then near_n end as form_n from w left join q on w.word = q.word and rn = 1),
c(word, goal) as (select word, word from f union all select c.word, f.form from c join f on f.word = c.goal where f.form is not null)
select f.word, form, root, n, n_near, form_n from f join (select c.word, c.goal as root from c join f on f.word = c.goal where f.form is null) using (word)
"""

#: op13: all pairs of documents that share a shingle, counted in full.
OP13_SQL = f"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as materialized (select distinct r, unnest(case when len(w) >= 4 then [w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] for i in range(1, len(w) - 2)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
z as (select r, count(*) as n from s group by r), o as materialized (select g, r from s where g in (select g from s group by g having count(*) > 1)),
b as (select a.r as u, c.r as v, count(*) as common from o a join o c on a.g = c.g and a.r <> c.r group by 1, 2),
e as materialized (select u, v from b join z x on x.r = u join z y on y.r = v where 100 * common >= 85 * (x.n + y.n - common)),
t(r, c) as (select r, doc_id from d union select e.v, t.c from t join e on e.u = t.r)
select d.doc_id, coalesce(z.n, 0) as n_shingles, k.c as component_id from d left join z using (r) join (select r, min(c) as c from t group by r) k using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": OP8_SQL, "op11_importance": OP11_SQL, "op12_spelling": OP12_SQL, "op13_jaccard": OP13_SQL}
