"""The registered queries of this subpackage, with the parameters of production, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, jaccard_join, language_id, line_dedup, nearest, packing, quality_rules, token_counts, url_filter, warc

TOKENIZER = "byte_bpe_50k.json"
RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def tokenizer(name: str = TOKENIZER) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), 1024, 2)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.repetition_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    models = language_id.learn(docs.where("not held_out"))
    return language_id.identify(docs.select("doc_id", "text", "held_out"), models).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer())


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(), 1024)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_language_id, op4_line_dedup, op5_bpe_encoding, op6_nearest_neighbours, op7_url_filters, op8_token_counts, op9_ngram_jaccard_join, op10_warc_derivatives)}

_KEY = r"translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES_SQL = f"""
lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from {{docs}}),
keyed as (select doc_id, pos, l, {_KEY} as k from lines),
shared as (select k, min(doc_id) as lead from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
judged as (select keyed.doc_id, pos, l, coalesce(lead <> keyed.doc_id, false) as gone from keyed left join shared using (k))"""

OP4_SQL = f"""with {LINES_SQL.format(docs="documents")}
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(l, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id"""

OP7_SQL = """with cut as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
rules(v, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as verdict
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join best using (page_id)"""

_W = r"'[^\x20\x09-\x0D]+'"


def repetition_sql(docs: str) -> str:
    """with-clauses that end in `ruled`: doc_id with the columns of op2."""
    sizes = sorted(quality_rules.COVERAGE)
    cov = ", ".join(f"coalesce(c.chars_in_{n}, 0)::bigint as chars_in_{n}" for n in sizes)
    sums = ", ".join(f"sum(chars) filter (s_{n}) as chars_in_{n}" for n in sizes)
    flags = ", ".join(f"bool_or(hit_{n}) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as s_{n}" for n in sizes)
    hits = ", ".join(f"coalesce(i + {n} <= n_words + 1 and count(*) over (partition by doc_id, gram_{n}) > 1, false) as hit_{n}" for n in sizes)
    window = lambda n: "hash(concat_ws(' ', w, " + ", ".join(f"lead(w, {j}) over o" for j in range(1, n)) + "))"
    grams = ", ".join(f"case when i + {n} <= n_words + 1 then {window(n)} else i end as gram_{n}" for n in sizes)
    limits = " and ".join([f"chars_in_{n} <= {most} * word_chars" for n, most in sorted(quality_rules.COVERAGE.items())] + [f"chars_in_lines <= {quality_rules.LINE_COVERAGE} * word_chars"])
    return f"""
base as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_W}) as ws from {docs}),
sized as (select *, len(ws) as n_words from base),
words as (select doc_id, n_words, unnest(ws) as w, generate_subscripts(ws, 1) as i from sized),
gramed as (select doc_id, n_words, i, length(w) as chars, {grams} from words window o as (partition by doc_id order by i)),
hit as (select doc_id, i, chars, {hits} from gramed),
covered as (select doc_id, i, chars, {flags} from hit),
c as (select doc_id, sum(chars) as word_chars, count(*) filter (s_5) as n_repeat_words, {sums} from covered group by doc_id),
textlines as (select doc_id, unnest(string_split(t, chr(10))) as l, generate_subscripts(string_split(t, chr(10)), 1) as pos from sized),
told as (select doc_id, l, pos, row_number() over (partition by doc_id, l order by pos) > 1 as again, regexp_extract_all(l, {_W}) as lw from textlines),
d as (select doc_id, count(*) filter (again and len(lw) > 0) as n_dup_lines, sum(length(array_to_string(lw, ''))) filter (again) as chars_in_lines from told group by doc_id),
counted as (select s.doc_id, n_words::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, {cov}, coalesce(chars_in_lines, 0)::bigint as chars_in_lines
  from sized s left join c using (doc_id) left join d using (doc_id)),
failed as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted),
ruled as (select *, not base_failed and {limits} as kept from failed)"""


OP2_SQL = f"with {repetition_sql('documents')} select * from ruled"

OP9_SQL = f"""with recursive base as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_W}) as ws from documents),
sets as (select doc_id, case when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')))
  when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as s from base),
tokens as (select doc_id, unnest(s) as w from sets),
meets as (select a.doc_id as a, b.doc_id as b, count(*) as n from tokens a join tokens b on a.w = b.w and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from meets o join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
edges as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from sets union select r.a, e.b from reach r join edges e on r.b = e.a)
select sets.doc_id, len(s)::bigint as n_shingles, c.root as component_id from sets join (select a, min(b) as root from reach group by a) c on c.a = sets.doc_id"""

ORACLE_SQL = {"op2_quality_rules": OP2_SQL, "op4_line_dedup": OP4_SQL, "op7_url_filters": OP7_SQL, "op9_ngram_jaccard_join": OP9_SQL}
