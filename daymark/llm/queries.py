"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from hashlib import sha256

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.llm import audit, bpe, centroids, exact, language, lines, mixing, near, personal, pitman, quality, topk, toxicity
from daymark.llm.common import fold, read_table


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; rows whose fold is 0 stay out of training."""
    docs = read_table(spark, folder, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = language.train(docs.filter(~F.col("held_out")))
    return language.identify(docs, model, keep=["doc_id", "held_out"])


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; labels of rows whose fold is 1 stay out of training."""
    docs = read_table(spark, folder, "documents").withColumn("held_out", fold("doc_id", 3) == 1)
    labels = read_table(spark, folder, "labels").filter(fold("doc_id", 3) != 1)
    model = toxicity.train(docs, labels)
    return toxicity.score_toxicity(docs, model, keep=["doc_id", "held_out"])


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; labels of rows whose fold is 0 stay out of training."""
    docs = read_table(spark, folder, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    labels = read_table(spark, folder, "labels").filter(fold("doc_id", 5) != 0)
    model = quality.train(docs, labels)
    return quality.score_quality(docs, model, keep=["doc_id", "held_out"])


def op4_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every page without the lines that more than 0.3 of its host's pages hold."""
    pages = read_table(spark, folder, "pages")
    return lines.drop_boilerplate(pages, "page_id", lines.host_of(F.col("url")), lines.page_lines(F.col("html")))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes from every document."""
    mixed = mixing.copies(read_table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def op6_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Exact copies of every document, dropped ones too."""
    return exact.find_copies(read_table(spark, folder, "documents"))


def op7_personal(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    docs = read_table(spark, folder, "documents")
    found = personal.find_personal(docs, personal.train(docs), keep=["doc_id"])

    def kind_is(kind):
        return lambda s: s.kind == kind

    def listed(spans):
        told = F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string")))
        return F.array_join(told, ",")

    base = F.filter("spans", lambda s: s.base)
    counts = {f"n_{k}": F.size(F.filter(base, kind_is(k))).cast("long") for k in personal.KINDS}
    return found.select(
        "doc_id",
        *(c.alias(n) for n, c in counts.items()),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op8_near(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents linked by 4-word shingles at a similarity of 0.85."""
    return near.near_duplicates(read_table(spark, folder, "documents"), width=4, percent=85)


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded again, as digests."""
    model = bpe.WordBpe.load(tokenizer_path("word_bpe_49k.json"))
    numbers = {i: str(i) for i in model.tokens}

    def digest(ids, decoded):
        told = " ".join([numbers[i] for i in ids])
        return len(ids), sha256(told.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()

    docs = read_table(spark, folder, "documents")
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bpe.round_trip(docs, model, digest, added, keep=["doc_id"])


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 best other rows of every 50th vector, by integer inner product."""
    return topk.top_k(read_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_pitman(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probability of every document; rows whose fold is 1 stay out of training."""
    docs = read_table(spark, folder, "documents")
    scored = pitman.score_texts(docs, F.coalesce(fold("doc_id", 5) != 1, F.lit(True)))
    return scored.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op12_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of five filters in all their orders, by source."""
    return audit.audit(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of all vectors of 64 components around 40 centroids, after five rounds."""
    return centroids.cluster(read_table(spark, folder, "embeddings"))


def _clusters_sql(k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64) -> str:
    """The rounds written out one after the other."""
    gap = "list_dot_product(e, e) - 2 * list_dot_product(e, c) + list_dot_product(c, c)"
    parts = [
        f"""with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
c0 as (select row_number() over (order by h) - 1 as k, e as c from (
  select sha256('{seed}:' || vec_id) as h, e from v order by h limit {k}
))"""
    ]
    for i in range(rounds + 1):
        # Distance and number in one integer: the smallest distance, of several the smallest number.
        parts.append(f"a{i} as (select vec_id, any_value(e) as e, min(({gap})::hugeint * 64 + k) as m from v, c{i} group by vec_id)")
        if i < rounds:
            parts.append(
                f"""s{i} as (select k, list(floor(s / n) order by d) as c from (
  select (m % 64)::int as k, d, sum(e[d]) as s, count(*) as n from a{i}, range(1, {width + 1}) t(d) group by 1, 2
) group by k),
c{i + 1} as (select c{i}.k, coalesce(s{i}.c, c{i}.c) as c from c{i} left join s{i} using (k))"""
            )
    parts.append(
        f"""f as (select vec_id, (m % 64)::int as cluster, (m // 64)::bigint as distance from a{rounds})
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
       (sum(distance) over ())::bigint as inertia,
       sha256(array_to_string(list_transform(c, lambda x: x::bigint), ',')) as centroid_sha256
from f join c{rounds} on k = cluster"""
    )
    return ",\n".join(parts[:-1]) + ",\n" + parts[-1]


REGISTRY = {
    "op1_language": op1_language,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_lines": op4_lines,
    "op5_mixing": op5_mixing,
    "op6_exact": op6_exact,
    "op7_personal": op7_personal,
    "op8_near": op8_near,
    "op9_bpe": op9_bpe,
    "op10_topk": op10_topk,
    "op11_pitman": op11_pitman,
    "op12_audit": op12_audit,
    "op13_centroids": op13_centroids,
}

ORACLE: dict[str, str] = {
    "op4_lines": r"""
with rows as (
  select page_id,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') as host,
         list_filter(list_transform(string_split(regexp_replace(html,
           '(?i)</?(?:p|div|br|li|ul|ol|nav|h[1-6]|article|footer|header|section|title|table|tr|td|script|style'
           || '|head|body|html)(?:\s[^>]*)?/?>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls
  from pages
),
held as (select host, unnest(list_distinct(ls)) as line from rows where host is not null),
counts as (select host, line, count(*) as n from held group by 1, 2),
totals as (select host, count(*) as pages from rows where host is not null group by 1),
drops as (
  select host, list(line) as gone from counts join totals using (host)
  where pages >= 10 and n > 0.3::double * pages group by 1
),
kept as (
  select page_id, r.host, ls,
         case when gone is null then ls else list_filter(ls, lambda x: not list_contains(gone, x)) end as ks
  from rows r left join drops d on r.host = d.host
)
select page_id, host, coalesce(len(ls), 0)::bigint as n_lines, coalesce(len(ls) - len(ks), 0)::bigint as n_dropped,
       array_to_string(ks, chr(10)) as text
from kept
""",
    "op8_near": """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') as w from documents
),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
  from words
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * c >= 85 * (x.n + y.n - c)
),
both_ways as (select a, b from links union select b, a from links),
reach as (
  select doc_id as a, doc_id as b from documents
  union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a
)
select d.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(r.b) as component_id
from documents d join reach r on r.a = d.doc_id left join sizes s on s.doc_id = d.doc_id group by d.doc_id
""",
    "op10_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
""",
    "op6_exact": """
with body as (
  select doc_id, regexp_replace(coalesce(text, ''), '[ \\x09-\\x0D]+', ' ', 'g') as t from documents
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
from body window w as (partition by t)
""",
    "op12_audit": """
with body as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') as w
  from documents
),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
fails as (
  select part, coalesce(good, 0) = 1 as good, coalesce(toxic, 0) = 1 as toxic,
         case when len(w) < 200 then 'A' else '' end
         || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
         || case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) then 'C' else '' end
         || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
         || case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end as fail
  from body left join marks using (doc_id)
),
counted as (select part, good, toxic, fail, count(*) as n from fails group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps as (
  select filter_order, step::int as step, substr(filter_order, step::int, 1) as f,
         substr(filter_order, 1, step::int - 1) as earlier
  from orders, range(1, 6) r(step)
),
told as (
  select part, filter_order, step, f, n, good, toxic, fail, contains(fail, f) as fails,
         length(translate(fail, earlier, '')) = length(fail) as here
  from counted, steps
),
sums as (
  select part, filter_order, step, f,
         sum(case when here and not fails then n else 0 end)::bigint as kept,
         sum(case when here and fails then n else 0 end)::bigint as removed,
         sum(case when not here and fails then n else 0 end)::bigint as redundant,
         sum(case when fail = f then n else 0 end)::bigint as unique_fails,
         sum(case when here and fails and good then n else 0 end)::bigint as good_lost,
         sum(case when here and fails and toxic then n else 0 end)::bigint as toxic_lost
  from told group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, f))::bigint as shapley
from sums
""",
    "op13_centroids": _clusters_sql(),
}
