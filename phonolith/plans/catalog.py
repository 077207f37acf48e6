"""Queries on catalogues: data sets, vocabularies, files, backends, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from phonolith.functions import nested, text as T
from phonolith.operators import catalog
from phonolith.sources import datasets, vocabulary

from .registry import query


@query("r005_splits", "select distinct lang as config, source as split from documents", "documents")
def _(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("lang").alias("config"), F.col("source").alias("split")).distinct()


@query("r006_page", "select doc_id, n_chars from documents order by doc_id limit 100 offset 150", "documents")
def _(documents: DataFrame) -> DataFrame:
    return datasets.page(documents.select("doc_id", "n_chars"), "doc_id", 150, 500)


@query("r007_sequential", "select doc_id, n_chars from documents order by doc_id limit 230 offset 40", "documents")
def _(documents: DataFrame) -> DataFrame:
    return datasets.rows(documents.select("doc_id", "n_chars"), "doc_id", 40, 230)


@query("r077_configs_splits", "select lang as config, string_agg(source, ',' order by first) as splits from (select lang, source, min(doc_id) as first from documents where trim(lang) <> '' group by all) group by lang", "documents")
def _(documents: DataFrame) -> DataFrame:
    return datasets.configs(documents.select(F.col("lang").alias("config"), F.col("source").alias("split"), F.col("doc_id").alias("pos"))).withColumn("splits", F.array_join("splits", ","))


@query("r010_vocabulary", "select p_partkey as pos, case when p_partkey % 2 = 0 then p_partkey * 3 else p_partkey end as id, p_name as piece from part", "part")
def _(part: DataFrame) -> DataFrame:
    """Lines of a vocabulary: a piece and its id after the last space, or a piece alone, whose id is its place."""
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_name", (F.col("p_partkey") * 3).cast("string"))).otherwise(F.col("p_name"))
    return vocabulary.parse(part.select(F.col("p_partkey").alias("pos"), line.alias("line")))


@query("r011_aggregate_vocabulary", "select p_partkey + case p_size % 3 when 0 then 0 when 1 then 1000000 else 2000000 end as id, p_name as piece, case p_size % 3 when 0 then 'a' when 1 then 'b' else 'c' end as part from part", "part")
def _(part: DataFrame) -> DataFrame:
    """Vocabularies placed one after another by offset."""
    name = F.element_at(F.array(*map(F.lit, "abc")), (F.col("p_size") % 3 + 1).cast("int"))
    pieces = part.select(name.alias("part"), F.col("p_partkey").alias("id"), F.col("p_name").alias("piece"))
    return vocabulary.aggregate(pieces, {"a": 0, "b": 1000000, "c": 2000000})


@query("r065_token_lookup", "select l_orderkey, l_linenumber, coalesce(p_name, '') as piece from lineitem left join part on p_partkey = l_partkey + l_linenumber", "lineitem", "part")
def _(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    ids = lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.col("l_linenumber")).alias("id"))
    return vocabulary.lookup(ids, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("piece")))


@query("r066_control_lookup", "select n_nationkey as grp, row_number() over (partition by n_nationkey order by i) - 1 as pos, r_name as label from nation, range(0, 8) t(i) join region on r_regionkey = (n_nationkey + i) % 8", "nation", "region")
def _(nation: DataFrame, region: DataFrame) -> DataFrame:
    """A group's fields with their definitions, in order; unknown fields are left out."""
    fields = nation.select(F.col("n_nationkey").alias("grp"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("n_nationkey") + i) % 8)).alias("i", "field"))
    known = fields.join(region, F.col("field") == F.col("r_regionkey"))
    return known.select("grp", (F.row_number().over(Window.partitionBy("grp").orderBy("i")) - 1).cast("long").alias("pos"), F.col("r_name").alias("label"))


@query("r012_revisions", "select n_regionkey as repo, string_agg(n_name, ',' order by n_nationkey) filter (where n_nationkey > 10) as names, coalesce(string_agg(n_name, ',' order by n_nationkey) filter (where n_nationkey > 22), 'main') as revisions from nation group by n_regionkey", "nation")
def _(nation: DataFrame) -> DataFrame:
    """Names of a repository's branches; main where none are listed."""
    listed = lambda least: F.transform(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") > least, F.struct("n_nationkey", "n_name")))), lambda x: x["n_name"])
    d = nation.groupBy(F.col("n_regionkey").alias("repo")).agg(listed(10).alias("names"), listed(22).alias("r"))
    return d.select("repo", F.when(F.size("names") > 0, F.array_join("names", ",")).alias("names"), F.when(F.size("r") > 0, F.array_join("r", ",")).otherwise("main").alias("revisions"))


@query("r013_providers", "select page_id, case when page_id % 4 = 0 then 'blob' when page_id % 4 = 1 then 'path' when page_id % 4 = 2 then 'hub' else 'url' end as provider from pages", "pages")
def _(pages: DataFrame) -> DataFrame:
    """The first provider that can serve a request."""
    k = F.col("page_id") % 4
    has = {"blob": k == 0, "path": k <= 1, "hub": k <= 2, "url": F.col("url").startswith("http")}
    return pages.select("page_id", catalog.first_provider(has).alias("provider"))


FILES = "case p_size % 4 when 0 then ['enc.onnx', 'dir/enc.int8.onnx'] when 1 then ['enc.fp16.onnx', 'vocab.txt'] when 2 then ['other.onnx'] else ['a/enc.int8.onnx', 'a/enc.fp16.onnx', 'mel80.onnx'] end"
MODES = "case p_size % 4 when 0 then ['fp32', 'int8'] when 1 then ['fp16'] when 2 then ['fp32'] else ['fp16', 'int8'] end"


def listing(part: DataFrame) -> DataFrame:
    kinds = [["enc.onnx", "dir/enc.int8.onnx"], ["enc.fp16.onnx", "vocab.txt"], ["other.onnx"], ["a/enc.int8.onnx", "a/enc.fp16.onnx", "mel80.onnx"]]
    files = F.element_at(F.array(*[F.array(*map(F.lit, k)) for k in kinds]), (F.col("p_size") % 4 + 1).cast("int"))
    return part.select("p_partkey", files.alias("files"))


@query("r102_quantisations", f"select p_partkey, array_to_string({MODES}, ',') as modes from part", "part")
def _(part: DataFrame) -> DataFrame:
    return listing(part).select("p_partkey", F.array_join(catalog.quantisations(F.col("files"), "enc"), ",").alias("modes"))


@query("r101_preferred_quantisation", f"select p_partkey, case p_size % 4 when 0 then 'int8' when 1 then 'fp16' when 2 then 'fp32' else 'int8' end as cpu, case p_size % 4 when 0 then 'fp32' when 1 then 'fp16' when 2 then 'fp32' else 'fp16' end as gpu from part", "part")
def _(part: DataFrame) -> DataFrame:
    modes = catalog.quantisations(F.col("files"), "enc")
    return listing(part).select("p_partkey", catalog.preferred(modes, "wasm").alias("cpu"), catalog.preferred(modes, "webgpu-hybrid").alias("gpu"))


@query("r015_local_entries", "select p_brand, count(*) as files, string_agg(distinct p_type, ',' order by p_type) as types from part group by p_brand", "part")
def _(part: DataFrame) -> DataFrame:
    return part.groupBy("p_brand").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("r109_distinct_names", "select distinct p_name as name from part where trim(p_name) <> ''", "part")
def _(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_name").alias("name")).filter(F.trim("name") != "").distinct()


#: The first numbers of the generator seeded by a hash of 'fixed-seed', as (pos, number). 32-bit words in 64-bit ones.
LOW = "4294967295::ubigint"
DRAWS = f"""(select pos, (xor(t, t >> 14) & {LOW})::double / 4294967296 as number
from (select pos, xor(t, (t + ((xor(t, t >> 7) * (t | 61)) & {LOW})) & {LOW}) as t
from (select pos, (xor(s, s >> 15) * (s | 1)) & {LOW} as t
from (select pos, (h + (pos + 1) * 1831565813)::ubigint & {LOW} as s
from (select list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split('fixed-seed', ''), lambda c: ord(c)::hugeint)), lambda h, c: (xor(h::uhugeint, c::uhugeint)::hugeint * 16777619) % 4294967296)::bigint as h), range(0, 1000) p(pos)))))"""


#: Backends of the catalogue: suppliers, with properties derived from their keys.
BACKENDS = "(select s_suppkey as reg, s_name as id, s_suppkey % 5 > 0 as available, s_suppkey % 3 = 0 as experimental, case when s_suppkey % 2 = 0 then ['fp32', 'fp16'] else ['fp32'] end as precisions, case s_suppkey % 4 when 0 then ['npu'] when 1 then ['gpu'] when 2 then ['hybrid'] else ['cpu'] end as acceleration, s_suppkey % 7 = 0 as shared_buffer, s_suppkey % 2 = 1 as fallback, s_nationkey as priority from supplier)"


def backends(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    acceleration = F.array(F.element_at(F.array(*map(F.lit, ("npu", "gpu", "hybrid", "cpu"))), (k % 4 + 1).cast("int")))
    return supplier.select(
        k.alias("reg"), F.col("s_name").alias("id"), (k % 5 > 0).alias("available"), (k % 3 == 0).alias("experimental"),
        F.when(k % 2 == 0, F.array(F.lit("fp32"), F.lit("fp16"))).otherwise(F.array(F.lit("fp32"))).alias("precisions"), acceleration.alias("acceleration"),
        (k % 7 == 0).alias("shared_buffer"), (k % 2 == 1).alias("fallback"), F.col("s_nationkey").alias("priority"), F.array(F.lit("node")).alias("environments"),
    )


@query("r053_backend_criteria", f"select reg, id from {BACKENDS} where available and not experimental and list_contains(precisions, 'fp16') and not shared_buffer", "supplier")
def _(supplier: DataFrame) -> DataFrame:
    c = catalog.Criteria(precision="fp16", environment="node", shared_buffer=False)
    return backends(supplier).filter(catalog.matches(c)).select("reg", "id")


@query("r099_backend_ranking", f"select id, row_number() over (order by coalesce(list_position([6, 2, 4], reg), 99), reg) as rank from {BACKENDS} where available", "supplier")
def _(supplier: DataFrame) -> DataFrame:
    b = backends(supplier).filter("available")
    preferred = [r["id"] for r in b.filter("reg in (2, 4, 6)").orderBy(F.expr("array_position(array(6, 2, 4), reg)")).limit(3).collect()]
    return catalog.ranked(b, preferred).select("id", "rank")


@query("r099_declared_ranking", f"select id, row_number() over (order by case when list_contains(precisions, 'fp16') then 0 else 1 end, case acceleration[1] when 'npu' then 0 when 'gpu' then 1 when 'hybrid' then 2 else 3 end, shared_buffer, not fallback, priority desc, reg) as rank from {BACKENDS} where available", "supplier")
def _(supplier: DataFrame) -> DataFrame:
    return catalog.ranked(backends(supplier).filter("available"), [], "fp16", declared=True).select("id", "rank")


@query("r054_classification", "select p_partkey from part where p_brand = (select min(p_brand) from part) and p_size > 10", "part")
def _(part: DataFrame) -> DataFrame:
    """Rows that agree with every requested key that isn't null."""
    brand = part.agg(F.min("p_brand").alias("brand"))
    wanted = F.struct("brand", F.lit(None).cast("string").alias("type"))
    d = part.filter("p_size > 10").join(F.broadcast(brand.select(wanted.alias("wanted"))))
    agrees = lambda key, own: F.col(f"wanted.{key}").isNull() | (F.col(f"wanted.{key}") == F.col(own))
    return d.filter(agrees("brand", "p_brand") & agrees("type", "p_type")).select("p_partkey")


@query("r140_language_names", "select doc_id, case lang when 'de' then 'German' when 'en' then 'English' else lang end as name from documents", "documents")
def _(documents: DataFrame) -> DataFrame:
    """The name of the first resolver that changes the code; the code itself if none does."""
    tables = [{"de": "German"}, {"de": "Deutsch", "en": "English"}]
    named = [F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in t.items()]) for t in tables]
    return documents.select("doc_id", F.coalesce(F.when(F.col("lang") == "auto", "Auto"), *named, "lang").alias("name"))


@query("r141_descriptor_lookup", "select n_nationkey, n_name from nation where lower(n_name) = lower((select n_name from nation where n_nationkey = 7)) or n_regionkey = 2", "nation")
def _(nation: DataFrame) -> DataFrame:
    """Models by trimmed, case-insensitive id or alias."""
    name = nation.filter("n_nationkey = 7").select(F.lower(F.trim("n_name")).alias("k"))
    d = nation.withColumn("aliases", F.array(F.concat(F.lit("Alias-"), "n_regionkey")))
    one = d.join(F.broadcast(name), F.lower("n_name") == F.col("k"), "left_semi")
    return one.union(d.filter(catalog.named("alias-2 ", "n_name", "aliases"))).select("n_nationkey", "n_name").distinct()


@query("r084_word_timing_diff", "select a.l_orderkey, count(*) as words, round(max(abs(a.l_discount - b.l_tax)), 6) as max_diff, count(*) filter (where abs(a.l_discount - b.l_tax) > 0.04) as over_40, count(*) filter (where abs(a.l_discount - b.l_tax) > 0.08) as over_80 from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as p from lineitem) a join (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as p from lineitem) b on a.l_orderkey = b.l_orderkey and b.p = a.p + 1 group by 1", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    """Words of two runs by place: a line's discount against the next line's tax."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    d = lineitem.select("l_orderkey", F.abs(F.col("l_discount") - F.lead("l_tax").over(w)).alias("d")).filter("d is not null")
    over = lambda s: F.count_if(F.col("d") > s)
    return d.groupBy("l_orderkey").agg(F.count("*").alias("words"), F.round(F.max("d"), 6).alias("max_diff"), over(0.04).alias("over_40"), over(0.08).alias("over_80"))


@query("r112_seeded_sample", f"""with n as (select count(*) as n from documents), d as (select pos, floor(number * n)::bigint as place from {DRAWS}, n where pos < least(3 * n, n + 500)),
o as (select place, min(pos) as pos from d group by place order by 2 limit 25)
select (row_number() over (order by place // 100, pos) - 1)::int as ord, doc_id, n_chars from o join (select doc_id, n_chars, row_number() over (order by doc_id) - 1 as place from documents) using (place)""", "documents")
def _(documents: DataFrame) -> DataFrame:
    return datasets.sample(documents.select("doc_id", "n_chars"), "doc_id", 25, "fixed-seed")


#: A request with the page's id for 7: keys out of order at each level, numbers in several forms, arrays kept in order.
REQUEST = '{"model": {"options": {"z": 1.50, "é": null, "a": [3, {"y": true, "x": "q\\"z"}, 1e3]}, "id": 7}, "b": "7", "10": 1e-7, "9": [], "A": {}}'
SORTED = '{"9":[],"10":1e-7,"A":{},"b":"7","model":{"id":7,"options":{"a":[3,{"x":"q\\"z","y":true},1000],"z":1.5,"é":null}}}'


@query("r142_canonical_key", f"""select page_id, case when page_id % 5 < 4 then replace('{SORTED}', '7,"o', page_id || ',"o') end as cache_key from pages""", "pages")
def _(pages: DataFrame) -> DataFrame:
    """A key from nested values, sorted at every level; null where a value isn't JSON."""
    request = F.replace(F.lit(REQUEST), F.lit("7}"), F.concat(F.col("page_id").cast("string"), F.lit("}")))
    request = F.when(F.col("page_id") % 5 < 4, request).otherwise(F.substring(request, F.lit(1), F.length(request) - 1))
    return pages.select("page_id", nested.canonical(request, nested.deepest(pages, request)).alias("cache_key"))


@query("r144_repo_path", "select page_id, 'a%20b/' || page_id || '/c%3Fd' as path from pages", "pages")
def _(pages: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/a b//"), F.col("page_id").cast("string"), F.lit("/c?d/"))
    return pages.select("page_id", catalog.repo_path(path).alias("path"))


@query("r189_control_values", "select l_orderkey, l_linenumber, least(40.0::double, greatest(5.0, 5 + floor((least(40, greatest(5, l_quantity)) - 5) / 2.5 + 0.5) * 2.5)) as value from lineitem", "lineitem")
def _(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", catalog.snap(F.col("l_quantity"), 5.0, 40.0, 2.5).alias("value"))


@query("r190_feature_cache", "select embedding[1] > 0 as key, count(*) as lookups, count(*) - 1 as hits from embeddings group by 1", "embeddings")
def _(embeddings: DataFrame) -> DataFrame:
    """Content-keyed reuse: the first of equal keys is computed, the others are hits."""
    return embeddings.groupBy((F.get("embedding", F.lit(0)) > 0).alias("key")).agg(F.count("*").alias("lookups"), (F.count("*") - 1).alias("hits"))


#: A name with characters within and beyond 16 bits, and its UTF-16 units: 𝄞 is a pair.
UNITS = "list_concat(list_transform(string_split(r_name, ''), lambda c: ord(c)::hugeint), [233, 55348, 56606])"


@query("r110_seed_numbers", f"select r_regionkey, r_name, list_reduce(list_prepend(2166136261::hugeint, {UNITS}), lambda h, c: (xor(h::uhugeint, c::uhugeint)::hugeint * 16777619) % 4294967296)::bigint as seed from region", "region")
def _(region: DataFrame) -> DataFrame:
    """FNV-1a of names over UTF-16 units, as Columns."""
    return region.select("r_regionkey", "r_name", T.fnv1a(F.concat("r_name", F.lit("é𝄞"))).alias("seed"))


def _draws_sql(name: str, table: str, count: int) -> str:
    """DRAWS for each row of a table, seeded by a name of its own."""
    seed = "(select list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split('fixed-seed', ''), lambda c: ord(c)::hugeint)), lambda h, c: (xor(h::uhugeint, c::uhugeint)::hugeint * 16777619) % 4294967296)::bigint as h)"
    return DRAWS.replace(seed, seed.replace("select list_reduce", "select c_custkey, list_reduce").replace("'fixed-seed'", name).replace(" as h)", f" as h from {table})")).replace("select pos", "select c_custkey, pos").replace("range(0, 1000)", f"range(0, {count})")


@query("r111_random_numbers", f"select c_custkey, pos::int as pos, number from {_draws_sql('c_name', 'customer', 5)}", "customer")
def _(customer: DataFrame) -> DataFrame:
    """The first numbers of a seeded generator, one seed for each customer's name."""
    return customer.select("c_custkey", F.posexplode(T.draws(T.fnv1a(F.col("c_name")), 5)).alias("pos", "number"))


PROFILE_SQL = """with p as (select * from (values ('realtime', 680::double, 3600::double, 0.55::double, 240::double, 320::double, 320::double, 240::double), ('generic', 680, 3600, 0.55, 240, 320, 320, 240), ('aggressive', 680, 3600, 0.42, 160, 128, 320, 240), ('conservative', 680, 3600, 0.6, 240, 256, 480, 240)) v(name, a, b, t, c, d, e, f)),
c as (select c_custkey, ['realtime', 'generic', 'aggressive', 'conservative', 'none'][c_nationkey % 5 + 1] as name, case when c_acctbal > 0 then c_acctbal / 10 end as silence from customer)
select c_custkey, name, ceil(a / 16) * 16 as preroll, ceil(b / 16) * 16 as most, t as threshold, ceil(c / 16) * 16 as speech, case when a is not null then greatest(16, ceil(coalesce(silence, d) / 16) * 16) end as silence, ceil(e / 16) * 16 as hangover, ceil(f / 16) * 16 as lookback from c left join p using (name)"""


@query("r188_profiles", PROFILE_SQL, "customer")
def _(customer: DataFrame) -> DataFrame:
    """Each customer's profile, by name, with a pause of its own where it has one; an unknown name has no settings."""
    from dataclasses import asdict

    from phonolith.streaming.session import PROFILES

    names = F.array(*map(F.lit, [*PROFILES, "none"]))
    rows = customer.select("c_custkey", F.get(names, (F.col("c_nationkey") % 5).cast("int")).alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10).alias("wish"))
    d = catalog.with_settings(rows, "name", [asdict(p) for p in PROFILES.values()], {"silence": F.col("wish")}, 16.0, ("threshold",))
    return d.drop("wish")


@query("r100_backend_choice", f"select id from {BACKENDS} where available and not experimental and list_contains(precisions, 'fp16') order by reg limit 1", "supplier")
def _(supplier: DataFrame) -> DataFrame:
    return catalog.choice(backends(supplier), catalog.Criteria(precision="fp16", environment="node"), []).select("id")
