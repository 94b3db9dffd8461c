"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fingerprint, lm, neardup, packing, phrases, quality, repair, sharding, simhash, toxicity, urlfilter
from .tables import small_batches, table

SHARDS = [f"shard-{i:03d}" for i in range(64)]
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The tables have no list of URLs; the pages whose id is divisible by this stand in for one.
LISTED_EVERY = 50


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(packing.TOKENIZER))


def categories() -> dict:
    """The categories that the labels have, in the chain's order."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), categories())
    return toxicity.score(docs, chain, list(categories()))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), text.alias("text"))
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in URL_RULES])))
    listed = pages.where(F.col("page_id") % LISTED_EVERY == 0).select(urlfilter.canonical(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))).alias("url"))
    return urlfilter.judge(pages, rules, listed)


OP6_SQL = f"""
with split_up as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
judged as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from split_up),
keyed as (select *, host || regexp_replace(path, '/+$', '') as canon from judged),
listed as (select distinct canon from keyed where page_id % {LISTED_EVERY} = 0 and canon <> ''),
rules(rule_host, rule_path, act) as (values {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)}),
fits as (
  select k.host, k.path, max(struct_pack(n := length(rule_host || rule_path), act := act, rule := rule_host || rule_path)) as won
  from (select distinct host, path from keyed) k join rules on (k.host = rule_host or ends_with(k.host, '.' || rule_host)) and starts_with(k.path, rule_path)
  group by k.host, k.path)
select page_id, k.host as host, k.path as path, won.rule as rule,
  coalesce(won.act, case when k.canon in (select canon from listed) then 'block' else 'allow' end) as verdict,
  k.canon in (select canon from listed) as listed
from keyed k left join fits f on k.host = f.host and k.path = f.path
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.fit(docs, 3, bits=12))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with faults made by the checksum of a row's ids."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("code") == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    parses, fixed = repair.repair(damaged(turns))
    hashes = repair.digests(fixed)
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    same = lambda df: ids.id.eqNullSafe(df.conv_id)
    found = ids.join(parses, same(parses), "left").drop("conv_id").join(hashes, same(hashes), "left").drop("conv_id")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select(
        F.col("id").alias("conv_id"), *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return phrases.collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = f"""
with piece as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '[.,;:!?\\n-\\r]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^ \\t]+') as w from piece),
spot as (select lang, w, unnest(range(1, len(w) + 1)) as i from words where len(w) > 0),
grams as (
  select lang, 1 as k, w[i] as phrase from spot
  union all select lang, 2, w[i] || ' ' || w[i + 1] from spot where i + 1 <= len(w)
  union all select lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from spot where i + 2 <= len(w)),
f as (select lang, k, phrase, count(*) as a from grams group by lang, k, phrase having count(*) >= {phrases.LEAST}),
total as (select lang, count(*) as n from grams where k = 1 group by lang),
candidate as (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1),
cut as (
  select lang, k, phrase, a, 1 as c, w[1] as x, case when k = 2 then w[2] else w[2] || ' ' || w[3] end as y from candidate
  union all select lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] from candidate where k = 3),
scored as (
  select cut.lang, cut.k, cut.phrase, cut.a, c, p.a as l, q.a as r,
    cast(1000000 * cast(cut.a as hugeint) * cut.a // (cast(p.a as hugeint) * q.a) as bigint) as score
  from cut join f p on p.lang = cut.lang and p.phrase = cut.x join f q on q.lang = cut.lang and q.phrase = cut.y),
best as (select *, row_number() over (partition by lang, phrase order by score, c) as nth from scored),
inner_pairs as (
  select lang, w[1] || ' ' || w[2] as phrase, a from candidate where k = 3
  union all select lang, w[2] || ' ' || w[3], a from candidate where k = 3),
longer as (select lang, phrase, max(a) as most from inner_pairs group by lang, phrase),
kept as (
  select b.* from best b left join longer o on o.lang = b.lang and o.phrase = b.phrase and b.k = 2
  where nth = 1 and (most is null or 100 * most < {phrases.COVERED} * b.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select ranked.lang as lang, rank, phrase, a, l, r, n, score from ranked join total on total.lang = ranked.lang where rank <= {phrases.MOST}
"""


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


ALL = (
    op1_toxicity, op2_minhash_near_dedup, op3_benchmark_decontamination, op4_chat_formatting, op5_sharding, op6_url_filters, op7_quality_classifier, op8_lm_scoring,
    op9_document_fingerprints, op10_best_fit_packing, op11_conversation_repair, op12_phrase_collocations, op13_simhash_near_dedup,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": OP6_SQL, "op12_phrase_collocations": OP12_SQL}
