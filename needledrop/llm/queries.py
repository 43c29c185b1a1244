"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.llm import op1_mixture, op2_runindex, op3_rules, op4_decontaminate, op5_orderminhash, op6_compression, op7_warc, op8_kdtree, op9_reputation, op10_lines, op11_negatives, op12_tokens, op13_centroids

#: The source tree of the mixture: domains by the number in a source's name.
DOMAINS = ("web", "books", "news")
MIX_WEIGHTS = {"domain": {"web": 0.5, "books": 0.3, "news": 0.2}, "lang": {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}}
MIX_SEED = 17
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of_source() -> Column:
    """The domain of a source by its last number, of which the last 18 digits count; ``-`` for a null source or one that ends in no digit."""
    digits = F.nullif(F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,18})$", 1), F.lit(""))
    return F.coalesce(F.get(F.array(*map(F.lit, DOMAINS)), F.pmod(digits.cast("bigint"), F.lit(3)).cast("int")), F.lit("-"))


def op1_mixture_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and epochs that a mixture of half of all tokens takes, two epochs at most."""
    return op1_mixture.mix(table(spark, sf_dir, "documents"), domain_of_source(), MIX_WEIGHTS, fraction=0.5, max_epochs=2, seed=MIX_SEED)


def op2_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document under 50-byte strings of earlier documents, and the hash of what is left."""
    return op2_runindex.drop_repeats(table(spark, sf_dir, "documents"), width=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each text, base rules and the verdict of the learned list."""
    judged = op3_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of an item's shingles."""
    return op4_decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), containment=0.8)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of each document."""
    return op5_orderminhash.near_duplicates(table(spark, sf_dir, "documents"), similarity=0.8)


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all texts."""
    return op6_compression.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of pages written as archives and read back."""
    back = op7_warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0, chunk_bytes=1 << 15)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes."""
    return op8_kdtree.shard_documents(table(spark, sf_dir, "documents"), n_shards=16)


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and verdicts of every url."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good"))
    return op9_reputation.filter_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES, threshold=0.5).select("page_id", "host", "path", "rule", "verdict")


def op10_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that repeat or resemble earlier ones."""
    return op10_lines.drop_lines(table(spark, sf_dir, "documents"), texts=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the positives of every fiftieth vector; every seventh vector's label is moved on by one."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return op11_negatives.mine_negatives(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the word vocabulary of 49 thousand entries."""
    import public_tokenizers

    return op12_tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op13_heap_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors of 64 components after ten rounds."""
    found = op13_centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, dims=64, seed="3")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture_of_sources": op1_mixture_of_sources,
    "op2_run_length_index": op2_run_length_index,
    "op3_decision_list": op3_decision_list,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_order_minhash": op5_order_minhash,
    "op6_compression_quality": op6_compression_quality,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_kdtree_shards": op8_kdtree_shards,
    "op9_host_reputation": op9_host_reputation,
    "op10_line_join": op10_line_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_heap_centroids": op13_heap_centroids,
}

_SHARE = """
{out} as (
  select *, case when short then supply else least(supply, weight * max(case when not short then lvl_key end) over (partition by {parent})) end as given
  from (select *, ratio <= lvl as short, case when ratio > lvl and ratio = min(case when ratio > lvl then ratio end) over (partition by {parent}) then lvl end as lvl_key
    from (select *, case when rest > 0 then remaining / rest else 0.0 end as lvl
      from (select *, greatest(parent_given - coalesce(sum(supply) over (partition by {parent} order by ratio, {child} rows between unbounded preceding and 1 preceding), 0.0), 0.0) as remaining,
          sum(weight) over (partition by {parent} order by ratio, {child} rows between current row and unbounded following) as rest
        from (select *, case when weight > 0 then supply / weight else 'inf'::double end as ratio from {src})))))
"""

OP1_SQL = (
    r"""
with meta as (
  select doc_id, case when regexp_extract(source, '([0-9]+)$', 1) = '' then '-' else coalesce(['web', 'books', 'news'][cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 3 + 1], '-') end as domain,
    coalesce(lang, '-') as lang, coalesce(source, '-') as source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as tokens
  from documents),
leaves as (select domain, lang, source, sum(tokens)::bigint as tokens, (sum(tokens) * 2)::double as supply from meta group by all),
d0 as (select domain, sum(supply) as supply, case domain when 'web' then 0.5::double when 'books' then 0.3::double when 'news' then 0.2::double else 1.0::double end as weight,
  (select 0.5::double * sum(tokens) from leaves) as parent_given from leaves group by domain),
"""
    + _SHARE.format(out="d1", src="d0", parent="1", child="domain")
    + r""",
l0 as (select a.*, d1.given as parent_given from (select domain, lang, sum(supply) as supply,
  case lang when 'en' then 0.55::double when 'de' then 0.15::double when 'es' then 0.15::double when 'fr' then 0.15::double else 1.0::double end as weight from leaves group by domain, lang) a join d1 using (domain)),
"""
    + _SHARE.format(out="l1", src="l0", parent="domain", child="lang")
    + r""",
s0 as (select a.domain, a.lang, a.source, a.supply, 1.0::double as weight, a.tokens, l1.given as parent_given from leaves a join l1 using (domain, lang)),
"""
    + _SHARE.format(out="s1", src="s0", parent="domain, lang", child="source")
    + r""",
b as (select domain, lang, source, tokens as leaf_tokens, least(floor(given)::bigint, tokens * 2) as budget from s1 where tokens > 0),
e as (select *, (budget // leaf_tokens)::int as epochs, budget % leaf_tokens as rest from b),
k as (select m.*, e.epochs, e.rest, ('0x' || substr(md5('17:' || e.epochs || ':' || coalesce(m.doc_id::varchar, '-')), 1, 15))::bigint as key from meta m join e using (domain, lang, source) where m.tokens > 0),
c as (select *, sum(tokens) over (partition by domain, lang, source order by key) <= rest as partly from k)
select doc_id, domain, lang, source, tokens, unnest(range(epochs + case when partly then 1 else 0 end))::int as epoch from c
"""
)

OP4_SQL = r"""
with w as (select doc_id as id, false as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\x00-\x7F])+') as ws from documents
  union all select item_id, true, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\x00-\x7F])+') from (select distinct item_id, text from benchmark)),
s as (select distinct item, id, array_to_string(ws[i:i + 4], ' ') as shingle from (select item, id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
n as (select id, count(*) as n from s where item group by id)
select d.id as doc_id, i.id as item_id, count(*)::bigint as n_shared, any_value(n.n)::bigint as n_shingles
from s d join s i on d.shingle = i.shingle and not d.item and i.item join n on n.id = i.id
group by d.id, i.id having count(*) >= 0.8 * any_value(n.n) - 1e-9
"""

OP7_SQL = r"""
with d as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as code from pages),
b as (select page_id, payload_bytes, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(code, (k // 8) * 10 + 1, 10))::bigint >> (35 - 5 * (k % 8))) & 31) + 1)::int, 1), '' order by k) as payload_digest
  from d, (select unnest(range(32))::int as k) group by page_id, payload_bytes),
r as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as response_id from b)
select page_id, payload_bytes, payload_digest, case when page_id = response_id then 'response' else 'revisit' end as record_type,
  case when page_id <> response_id then response_id end as refers_to from r
"""

_RHO = "case when sum(n) is null or sum(n) <= count(*) then 99.0::double else 1 / least(greatest((sum(n * pow(k / n - least(greatest(parent, 1e-6), 1 - 1e-6), 2) / (least(greatest(parent, 1e-6), 1 - 1e-6) * (1 - least(greatest(parent, 1e-6), 1 - 1e-6)))) - count(*)) / (sum(n) - count(*)), 0.001), 0.5) - 1 end as s"
OP9_SQL = rf"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path from pages),
o as (select doc_id as page_id, count(*) as n, count(*) filter (where quality = 1) as k from labels where doc_id is not null and quality is not null group by 1),
c as (select host, string_split(host, '.') as l, coalesce(sum(n), 0)::double as n, coalesce(sum(k), 0)::double as k from p left join o using (page_id) group by host),
h as (select host, n, k, case when array_to_string(l[-2:], '.') in ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') then array_to_string(l[-2:], '.') else l[-1] end as suffix,
  case when array_to_string(l[-2:], '.') in ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end as domain from c),
d as (select suffix, domain, sum(n) as n, sum(k) as k from h group by 1, 2), x as (select suffix, sum(n) as n, sum(k) as k from d group by 1),
x1 as (select *, (select coalesce(sum(k) / nullif(sum(n), 0), 0.5) from x) as parent from x), xs as (select {_RHO} from x1 where n > 0),
xm as (select suffix, (k + s * parent) / (n + s) as parent from x1, xs), d1 as (select d.*, xm.parent from d join xm using (suffix)), ds as (select {_RHO} from d1 where n > 0),
dm as (select domain, (k + s * parent) / (n + s) as parent from d1, ds), h1 as (select h.*, dm.parent from h join dm using (domain)), hs as (select {_RHO} from h1 where n > 0),
b as (select host, k + s * parent as a, n - k + s * (1 - parent) as b from h1, hs),
g as (select host, a, b, greatest(a, b) as p, least(a, b) as q from b where a > 0 and b > 0),
t as (select host, p, q, exp(sum(ln((p + q + i - 1) * 0.5 / (p + i))) over (partition by host order by i)) as term from g, (select unnest(range(1, 3001)) as i)),
i as (select host, exp((p + q) * ln(0.5) - lgamma(p) - lgamma(q) + lgamma(p + q)) / p * (1 + sum(term)) as below from t group by host, p, q),
v as (select b.host, case when b.a <= 0 then false when b.b <= 0 then true when b.a >= b.b then below <= 0.05 else 1 - below <= 0.05 end as good from b left join i using (host)),
r as (select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(act, rh, rp)),
m as (select distinct host, path, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(act, length(rh || rp)) as act from (select distinct host, path from p) join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by host, path)
select page_id, host, path, rule, coalesce(act, case when good then 'allow' else 'block' end) as verdict from p join v using (host) left join m using (host, path)
"""

_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
OP11_SQL = rf"""
with r as materialized (select row_number() over () as k, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where label is not null and {_FINITE}),
s as materialized (select a.k as ak, a.vec_id as anchor_id, r.k as k, r.vec_id as id, a.label = r.label as same, coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda z: coalesce(z[1] * z[2], 0))), 0)::bigint as score
  from r a join r on a.vec_id % 50 = 0 and a.k <> r.k),
p as (select * from s where same qualify row_number() over (partition by ak order by score desc, id nulls last, k) <= 5),
n as (select p.ak, p.k as pk, p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.ak, p.k order by s.score desc, s.id nulls last, s.k)::int as rank
  from p join s on s.ak = p.ak and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""

_OP13_ROUND = """
a{i} as materialized (select k, any_value(vec_id) as vec_id, any_value(v) as v, arg_min(j, (d, j)) as j, min(d) as d from (
  select k, vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from v, c{i}) group by k),
"""
_OP13_MOVE = """
m{i} as (select j, list(q order by p) as c from (select j, p, ((s - mod(mod(s, n) + n, n)) // n)::bigint as q from (select j, p, sum(x)::bigint as s, count(*)::bigint as n from (select j, unnest(v) as x, unnest(range(len(v))) as p from a{i}) group by j, p)) group by j),
c{next} as materialized (select c{i}.j, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} using (j)),
"""
OP13_SQL = (
    rf"""
with v as materialized (select row_number() over () as k, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and {_FINITE}),
c0 as materialized (select row_number() over (order by sha256('3:' || vec_id) nulls last, v) - 1 as j, v as c from v qualify j < 8),
"""
    + "".join(_OP13_ROUND.format(i=i) + _OP13_MOVE.format(i=i, next=i + 1) for i in range(10))
    + _OP13_ROUND.format(i=10)
    + """
i as (select j, sum(d)::bigint as cluster_inertia from a10 group by j)
select vec_id, j::int as cluster, d::bigint as distance, cluster_inertia, (select sum(d)::bigint from a10) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a10 join i using (j) join c10 using (j)
"""
)

ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": OP11_SQL, "op13_heap_centroids": OP13_SQL, "op1_mixture_of_sources": OP1_SQL, "op4_benchmark_leaks": OP4_SQL, "op7_warc_round_trip": OP7_SQL, "op9_host_reputation": OP9_SQL}
