"""Queries of the operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, hilbert_packing, jump_shards, license_scan, line_templates, merkle_manifest, quality_classifier, quality_rules, simhash_trie, source_mix, streaming_dedup, url_filter, word_runs
from .common import table

# The rules of the URL query.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.swapped_pairs(table(spark, sf_dir, "conversations"))
    return chat_format.preference_rows(turns)


def op2_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, action string")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


def op4_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = source_mix.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie at source/lang/doc_id.txt."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat(part("source"), F.lit("/"), part("lang"), F.lit("/"), part("doc_id"), F.lit(".txt")).alias("path"), "text")
    found = license_scan.license_scan(files)
    doc_id = F.regexp_extract("path", r"/([^/]*)\.txt$", 1)
    return found.select(F.when(doc_id != "", doc_id.cast("long")).alias("doc_id"), "path", "license", "score", "is_license_file", "origin", "from_dir")


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trie.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines.n_lines").alias("n_lines"), F.col("_lines.n_dropped").alias("n_dropped"), F.md5("text").alias("text_md5"))


def op10_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streaming_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op11_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = 24
    found = jump_shards.shard_rows(table(spark, sf_dir, "documents"), shards)
    grown = jump_shards.grown(F.col("shard"), F.col("moves_at"), shards)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"), "moves_at")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row by checksum is presented with a lower-cased text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", upper, upper.lower()))
    found = merkle_manifest.manifest(table(spark, sf_dir, "documents"), tampered)
    folded = merkle_manifest.folded(F.coalesce("claim", "leaf"), "proof", "places", "runs")
    hexed = merkle_manifest.hexed
    out = found.select(F.col("key").alias("doc_id"), hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"), F.sha2(hexed("proof"), 256).alias("proof_sha256"), folded.alias("folded"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", hexed("folded").alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tenth text by checksum repeats itself from some word on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", word_runs.planted().alias("text"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(line, lambda s: F.concat(s, F.lit("\n"))), "")
    return word_runs.word_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_preference_format, op2_weak_label_quality, op3_url_filter, op4_cube_mix, op5_license_scan,
        op6_hilbert_packing, op7_simhash_trie, op8_quality_votes, op9_line_templates, op10_streaming_dedup,
        op11_jump_shards, op12_merkle_manifest, op13_word_runs, pipeline,
    )
}

#: White space, word and lower case as the operators define them.
_SPACE = r"[\x20\x09-\x0D]+"
ORACLES: dict[str, str] = {
    "op3_url_filter": """
with rules(h, p, a) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end as r from pages),
parts as (
  select page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') as path from rest),
places as (select distinct host, path from parts),
best as (
  select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(a, length(h || p)) as verdict
  from places join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join best using (host, path)
""",
    "op10_streaming_dedup": f"""
with norm as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) as text_sha256 from documents),
found as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from norm group by text_sha256)
select doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) as kept, text_sha256 from norm join found using (text_sha256)
""",
    "op1_preference_format": """
with own as (select conv_id, coalesce(turn, -1) as turn, role, text from conversations where conv_id is not null),
last as (select conv_id, max(turn) as final, arg_max(text, turn) as last_text from own where role = 'assistant' group by conv_id),
rows as (
  select o.*, l.final, d.last_text as other, d.conv_id is not null as given
  from own o left join last l using (conv_id) left join last d on d.conv_id = l.conv_id + 1),
sided as (
  select conv_id as pair_id, 'chosen' as side, turn, coalesce(role, '') as role, coalesce(text, '') as text from rows
  union all
  select conv_id, 'rejected', turn, coalesce(role, ''), coalesce(case when role = 'assistant' and turn = final then other else text end, '')
  from rows where not coalesce(role = 'assistant' and turn = final, false) or given),
once as (select pair_id, turn, role, text, count(*) filter (where side = 'chosen') as c, count(*) filter (where side = 'rejected') as r from sided group by all),
stops as (select pair_id, min(turn) filter (where c <> r) as stop from once group by pair_id),
placed as (select o.*, stop is null or turn < stop as common from once o join stops using (pair_id)),
parts as (
  select pair_id, 'prompt' as part, turn, role, text, false as loss, unnest(range(c)) as k from placed where common
  union all select pair_id, 'chosen', turn, role, text, role = 'assistant', unnest(range(c)) from placed where not common
  union all select pair_id, 'rejected', turn, role, text, role = 'assistant', unnest(range(r)) from placed where not common),
shown as (select *, '<|' || role || '|>' || chr(10) || text || chr(10) as out from parts),
spans as (select *, sum(length(out)) over (partition by pair_id, part order by turn, role, text, k) as stop from shown),
folded as (
  select pair_id, part, string_agg(out, '' order by turn, role, text, k) as text, count(*) as n,
    coalesce(string_agg((stop - length(out))::bigint || ':' || stop::bigint, ',' order by turn, role, text, k) filter (where loss), '') as mask
  from spans group by pair_id, part)
select pair_id,
  coalesce(max(text) filter (where part = 'prompt'), '') as prompt, coalesce(max(n) filter (where part = 'prompt'), 0) as prompt_turns,
  coalesce(max(text) filter (where part = 'chosen'), '') as chosen, coalesce(max(n) filter (where part = 'chosen'), 0) as chosen_turns,
  coalesce(max(mask) filter (where part = 'chosen'), '') as chosen_mask,
  coalesce(max(text) filter (where part = 'rejected'), '') as rejected, coalesce(max(n) filter (where part = 'rejected'), 0) as rejected_turns,
  coalesce(max(mask) filter (where part = 'rejected'), '') as rejected_mask
from folded group by pair_id
""",
}


def _merkle_sql(fanout: int = 8, levels: int = 7, top: int = 3) -> str:
    """The manifest level by level; parts of up to fanout^levels rows, fanout^top parts."""
    enc = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    row = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    parts = [f"""rows as (select row_number() over () as r, doc_id, dense_rank() over (order by lang nulls first) as g, {row('text')} as d,
 {row("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as changed, coalesce({crc} % 3 = 0, false) as tampered from documents),
l0 as (select *, count(*) over (partition by g) as n from (select r, g, row_number() over (partition by g order by doc_id nulls first, d, r) - 1 as i, d from rows)),
p0 as (select l0.r, l0.g, l0.i, '' as proof, case when tampered then changed else l0.d end as node from l0 join rows using (r))"""]

    def climb(name: str, walk: str, k: int) -> str:
        run = f"x.g = p.g and x.i // {fanout} = p.i // {fanout}"
        return f"""{name}{k + 1} as (select *, count(*) over (partition by g) as n from (select g, case when n > 1 then i // {fanout} else i end as i, case when n > 1 then sha256(string_agg(d, '' order by i)) else min(d) end as d
 from {name}{k} group by g, n, case when n > 1 then i // {fanout} else i end)),
{walk}{k + 1} as (select p.r, p.g, case when x.n > 1 then p.i // {fanout} else p.i end as i, proof || coalesce(string_agg(x.d, '' order by x.i) filter (where x.i <> p.i), '') as proof,
 case when x.n > 1 then sha256(string_agg(case when x.i = p.i then p.node else x.d end, '' order by x.i)) else p.node end as node from {walk}{k} p join {name}{k} x on {run} group by p.r, p.g, p.i, p.proof, p.node, x.n)"""

    parts += [climb("l", "p", k) for k in range(levels)]
    parts.append(f"t0 as (select 0 as g, g - 1 as i, d, count(*) over () as n from l{levels}), u0 as (select r, 0 as g, g - 1 as i, proof, node from p{levels})")
    parts += [climb("t", "u", k) for k in range(top)]
    return "with " + ",\n".join(parts) + f"""
select doc_id, rows.d as leaf, s.d as subroot, o.d as root, sha256(proof) as proof_sha256, node as folded_root, node = o.d as verified from rows join u{top} using (r) join l{levels} s on s.g = rows.g, t{top} o"""


ORACLES["op12_merkle_manifest"] = _merkle_sql()
