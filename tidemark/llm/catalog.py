"""The thin queries op1 to op13 with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bloom_lookup, collocations, decontamination, gru_lm, license_templates, line_blocks, packing, secret_trigrams, sharding, toxicity, warc_index, whitening
from tidemark.llm.common import table, work_dir
from tidemark.llm.simhash_pivots import simhash_components


def op1_bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lookup.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=3, radius=2)


def op6_size_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), work_dir(spark, "shards")
    sharding.append(docs, path)
    sharding.compact(spark, path)
    run = "__shard_run"
    return sharding.read(spark, path).select(
        "doc_id", F.octet_length("text").cast("long").alias("bytes"), F.col(f"{run}.first.arrival").alias("shard"), F.col(f"{run}.tier").cast("long").alias("tier"),
        F.col(f"{run}.bytes").alias("shard_bytes"), F.col(f"{run}.rows").alias("shard_rows"),
    )


def held_out(modulus: int, remainder: int) -> Column:
    """crc32 of the id as text has this remainder; false for a row without id."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def op7_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    scored = toxicity.score(docs.select("doc_id", "text"), model, ["doc_id"])
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_trigrams.scan(table(spark, sf_dir, "documents"))
    base = len(secret_trigrams.BASE)
    count = lambda kind: F.size(F.filter("__found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(r.kind) for r in secret_trigrams.BASE],
        F.sha2(secret_trigrams.span_text(F.filter("__found", lambda s: s.order < base)), 256).alias("base_sha256"),
        secret_trigrams.span_text(F.col("__found")).alias("spans"),
    )


def op9_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = gru_lm.score_documents(table(spark, sf_dir, "documents"), ~held_out(7, 2))
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = warc_index.mark_revisits(table(spark, sf_dir, "pages"))
    index = warc_index.write_archives(marked, work_dir(spark, "warc"))
    return warc_index.read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("license")
    joined = lambda labels: F.array_join(labels, ",")
    return license_templates.scan(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", found.n_words.alias("n_words"), found.n_base.alias("n_base"), found.first_word.alias("first_word"), found.last_word.alias("last_word"),
        joined(F.array_sort(found.base_labels)).alias("base_labels"), joined(license_templates.labels(found)).alias("labels"), license_templates.score(found).alias("score"),
    )


def op13_stream_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.best(collocations.mine(table(spark, sf_dir, "documents").select("text", "lang")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bloom_lookup": op1_bloom_lookup,
    "op2_packing": op2_packing,
    "op3_simhash_windows": op3_simhash_windows,
    "op4_line_blocks": op4_line_blocks,
    "op5_simhash_pivots": op5_simhash_pivots,
    "op6_size_tiers": op6_size_tiers,
    "op7_boosted_trees": op7_boosted_trees,
    "op8_secret_trigrams": op8_secret_trigrams,
    "op9_gru": op9_gru,
    "op10_warc_index": op10_warc_index,
    "op11_incremental_whitening": op11_incremental_whitening,
    "op12_license_templates": op12_license_templates,
    "op13_stream_collocations": op13_stream_collocations,
}

def _ascii_either_case(regex: str) -> str:
    """The regex with its words spelled for both cases: some engines fold more than A-Z under (?i)."""
    head, rest = regex.removeprefix("(?i)").split(")", 1)
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" + rest


def _secret_sql() -> str:
    kinds = []
    for k, r in enumerate(secret_trigrams.RULES):
        regex = (_ascii_either_case(r.regex) if r.regex.startswith("(?i)") else r.regex).replace("'", "''")
        kinds.append(f"""select rid, {k} as ord, '{r.kind}' as kind, {r.least} as least, string_split_regex(t, '{regex}') as gaps,
            regexp_extract_all(t, '{regex}', 0) as hits, regexp_extract_all(t, '{regex}', {r.group}) as parts from docs where regexp_matches(t, '{regex}')""")
    return f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(kinds)}),
each as (select rid, ord, kind, least, unnest(range(1, len(hits) + 1)) as i, gaps, hits, parts from found),
spans as (
    select rid, ord, kind, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as bigint) as s, length(hits[i]) as n
    from each where length(parts[i]) >= least),
per as (
    select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, ord) filter (ord < {len(secret_trigrams.BASE)}), '') as base,
        string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, ord) as spans
    from spans group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join per using (rid)"""


def _shard_sql() -> str:
    """Arrivals of SPAN ids merge FANOUT at a time by tier; a table without oversized arrivals, which alone have pieces."""
    s = sharding
    tier = " + ".join(f"cast(bytes >= {s.LOWEST * s.FANOUT**k} as bigint)" for k in range(s.TIERS))
    steps = [f"""r0 as (
    select floor(arrival / {s.STREAM}.0) as stream, arrival as f, bytes, n, [arrival] as members, {tier} as tier
    from (select coalesce(cast(floor(doc_id / {s.SPAN}.0) as bigint), -{1 << 62}) as arrival, cast(sum(octet_length(encode(coalesce(text, '')))) as bigint) as bytes, count(*) as n from documents group by 1))"""]
    for k in range(s.ROUNDS):
        steps.append(f"""g{k} as (select *, (row_number() over (partition by stream, tier order by f) - 1) // {s.FANOUT} as grp from r{k}),
c{k} as (select *, count(*) over (partition by stream, tier, grp) = {s.FANOUT} and tier < {s.TIERS} as full_group from g{k}),
r{k + 1} as (
    select stream, f, bytes, n, members, {tier} as tier from (
        select stream, min(f) as f, cast(sum(bytes) as bigint) as bytes, cast(sum(n) as bigint) as n, flatten(list(members)) as members
        from c{k} group by stream, full_group, case when full_group then tier end, case when full_group then grp else f end))""")
    return "with " + ",\n".join(steps) + f""",
m as (select unnest(members) as arrival, f, tier, bytes as shard_bytes, n as shard_rows from r{s.ROUNDS})
select d.doc_id, cast(octet_length(encode(d.text)) as bigint) as bytes, m.f as shard, m.tier, m.shard_bytes, m.shard_rows
from documents d join m on coalesce(cast(floor(d.doc_id / {s.SPAN}.0) as bigint), -{1 << 62}) = m.arrival"""


def _license_sql() -> str:
    places = " union all ".join(
        f"select rid, '{label}' as label, unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i:i + {len(p.split()) - 1}] = {p.split()})) - 1 as place from w" for p, label in license_templates.PHRASES
    )
    sure = " union ".join(f"select rid, '{label}' as label from w where regexp_matches(line, ' {license_templates.regex(license_templates.parse(t))}')" for label, t in license_templates.TEMPLATES)
    return f"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
w as (select *, ' ' || array_to_string(ws, ' ') || ' ' as line from d),
places as ({places}),
sure as ({sure}),
b as (select rid, count(*) as n, min(place) as lo, max(place) as hi, string_agg(distinct label, ',' order by label) as labels from places group by rid),
m as (select rid, string_agg(label, ',' order by label) as labels, count(*) as n, count(*) filter (by_template) as n_sure
    from (select rid, label, bool_or(sure) as by_template from (select rid, label, false as sure from places union all select rid, label, true from sure) group by rid, label) group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(b.n, 0) as n_base, b.lo as first_word, b.hi as last_word, coalesce(b.labels, '') as base_labels, coalesce(m.labels, '') as labels,
    case when m.n is null then 0.0 else (m.n + m.n_sure) / (2.0 * m.n) end::double as score
from w left join b using (rid) left join m using (rid)"""


def _collocation_sql() -> str:
    c = collocations
    grams = " union all ".join(
        f"select lang, ws[i:i + {m - 1}] as g from (select lang, ws, unnest(range(1, len(ws) - {m - 2})) as i from w where len(ws) >= {m})" for m in range(1, c.LONGEST + 1)
    )
    return f"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
f as (select lang, g, count(*) as f from ({grams}) group by lang, g having count(*) >= {c.LEAST}),
n as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
cuts as (select lang, g, f as a, unnest(range(1, len(g))) as k from f where len(g) > 1),
scored as (
    select c.lang, c.g, c.a, c.k, lf.f as l, rt.f as r, n.n, cast(1000 * c.a::hugeint * n.n // (lf.f::hugeint * rt.f) as bigint) as score
    from cuts c join f lf on lf.lang = c.lang and lf.g = c.g[1:c.k] join f rt on rt.lang = c.lang and rt.g = c.g[c.k + 1:] join n on n.lang = c.lang),
one as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
inside as (
    select distinct o.lang, o.g from one o join
    (select lang, f, len(g) as m, unnest(list_transform(range(1, len(g) + 1), lambda i: g[i:])) as s from f where len(g) > 2) x
    on x.lang = o.lang and len(x.s) >= len(o.g) and x.s[1:len(o.g)] = o.g and x.m > len(o.g) and 100 * x.f >= {c.SHARE} * o.a),
kept as (select one.*, array_to_string(one.g, ' ') as phrase from one anti join inside on inside.lang = one.lang and inside.g = one.g)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= {c.TOP}"""


ORACLES: dict[str, str] = {
    "op12_license_templates": _license_sql(),
    "op13_stream_collocations": _collocation_sql(),
    "op6_size_tiers": _shard_sql(),
    "op8_secret_trigrams": _secret_sql(),
    "op10_warc_index": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, cast(octet_length(b) as bigint) as payload_bytes, sha1(b) as payload_digest from p),
m as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) end as t from d)
select page_id, payload_bytes, payload_digest, case when t <> page_id then 'revisit' when t is not null and page_id is null then 'revisit' else 'response' end as record_type,
    case when page_id is null or t <> page_id then t end as refers_to
from m""",
}
