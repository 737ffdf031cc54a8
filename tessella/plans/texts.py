"""Text normalising, similarity, JSON, arrays and number formats."""

from pyspark.sql import functions as F

from tessella.functions.similarity import damerau_levenshtein, jaro_winkler
from tessella.operators.fuzzy import best_match
from tessella.plans.registry import query

c = F.col


@query(r"select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '\b(e|a)', '', 'g'), 'green', ' gr', 'g'), '-', '', 'g')) as name from part")
def regex_normalize_street(t):
    x = F.lower("p_name")
    for a, b in ((r"\b(e|a)", ""), ("green", " gr"), ("-", "")):
        x = F.regexp_replace(x, a, b)
    return t.part.select("p_partkey", F.trim(x).alias("name"))


@query(r"select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (old) [3]'), '\(.*?\)', '', 'g'), '\[\d+\]', '', 'g')) as name from part")
def regex_normalize_changes(t):
    x = F.lower(F.concat("p_name", F.lit(" (old) [3]")))
    return t.part.select("p_partkey", F.trim(F.regexp_replace(F.regexp_replace(x, r"\(.*?\)", ""), r"\[\d+\]", "")).alias("name"))


@query(r"select s_suppkey, nullif(regexp_extract(s_name, '^(\w+)#(\d+)$', 1), '') as head, nullif(regexp_extract(s_name, '^(\w+)#(\d+)$', 2), '') as tail from supplier")
def regex_extract_groups(t):
    g = lambda k: F.nullif(F.regexp_extract("s_name", r"^(\w+)#(\d+)$", k), F.lit(""))
    return t.supplier.select("s_suppkey", g(1).alias("head"), g(2).alias("tail"))


@query(r"select s_suppkey, try_cast(regexp_extract(s_name, '(\d+)', 1) as bigint) as number from supplier")
def extract_number(t):
    return t.supplier.select("s_suppkey", F.regexp_extract("s_name", r"(\d+)", 1).try_cast("bigint").alias("number"))


@query(r"select p_partkey, case when coalesce(regexp_matches(p_type, '[A-Z] [A-Z]'), false) then null else p_type end as type from part")
def rlike_to_null(t):
    return t.part.select("p_partkey", F.when(~F.coalesce(c("p_type").rlike("[A-Z] [A-Z]"), F.lit(False)), c("p_type")).alias("type"))


@query(r"select n_nationkey, regexp_extract(lower(n_name) || ' nw', '^(.*?)\s*(nw|ne|sw|se|n|s|e|w)?$', 1) as street, coalesce(regexp_extract(lower(n_name) || ' nw', '\s(nw|ne|sw|se|n|s|e|w)$', 1), '') as direction from nation")
def split_direction(t):
    x = F.concat(F.lower("n_name"), F.lit(" nw"))
    return t.nation.select("n_nationkey", F.regexp_extract(x, r"^(.*?)\s*(nw|ne|sw|se|n|s|e|w)?$", 1).alias("street"), F.coalesce(F.regexp_extract(x, r"\s(nw|ne|sw|se|n|s|e|w)$", 1), F.lit("")).alias("direction"))


@query("select c_custkey, case when c_custkey % 3 = 0 then '' else cast(c_custkey as varchar) end || ' ' || coalesce(case when c_custkey % 5 = 0 then null else c_mktsegment end, '') as address from customer")
def concat_address(t):
    number = F.when(c("c_custkey") % 3 == 0, "").otherwise(c("c_custkey").cast("string"))
    return t.customer.select("c_custkey", F.concat_ws(" ", number, F.coalesce(F.when(c("c_custkey") % 5 != 0, c("c_mktsegment")), F.lit(""))).alias("address"))


@query("select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def split_explode(t):
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("select p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: case x when 'red' then '1st' when 'blue' then '2nd' else x end), 'string_agg', ' ') as name from part")
def ordinal_words(t):
    words = F.transform(F.split("p_name", " "), lambda x: F.when(x == "red", "1st").when(x == "blue", "2nd").otherwise(x))
    return t.part.select("p_partkey", F.array_join(words, " ").alias("name"))


def _names(t):
    return t.part.select("p_name").distinct()


@query("select p_name, round(jaro_winkler_similarity(p_name, 'small blue widget'), 6) as score from (select distinct p_name from part)")
def similarity_jw(t):
    return _names(t).select("p_name", F.round(jaro_winkler("p_name", F.lit("small blue widget")), 6).alias("score"))


@query("select p_name, round(1 - damerau_levenshtein(p_name, 'small blue widget') / greatest(length(p_name), 17), 6) as score from (select distinct p_name from part)")
def similarity_dl(t):
    return _names(t).select("p_name", F.round(damerau_levenshtein("p_name", F.lit("small blue widget")), 6).alias("score"))


_DICT = "with d as (select p_name as entry, min(p_partkey) as pos from part group by 1), l as (select distinct substr(p_name, 2) || 'x' as dirty from part) "


def _dictionary(t):
    entries = t.part.groupBy(c("p_name").alias("entry")).agg(F.min("p_partkey").alias("pos"))
    return t.part.select(F.concat(F.expr("substr(p_name, 2)"), F.lit("x")).alias("dirty")), entries


@query(_DICT + "select dirty, entry as match, round(score, 6) as score from (select *, row_number() over (partition by dirty order by score desc, pos) as n from (select dirty, entry, pos, 1 - damerau_levenshtein(dirty, entry) / greatest(length(dirty), length(entry)) as score from l, d) where score >= 0.6) where n = 1")
def fuzzy_best_match_dl(t):
    dirty, entries = _dictionary(t)
    return best_match(dirty, "dirty", entries, "dl", 0.6).withColumn("score", F.round("score", 6))


@query(_DICT + "select dirty, entry as match, round(score, 6) as score from (select *, row_number() over (partition by dirty order by round(score, 12) desc, pos) as n from (select dirty, entry, pos, jaro_winkler_similarity(dirty, entry) as score from l, d) where score >= 0.8) where n = 1")
def fuzzy_best_match_jw(t):
    dirty, entries = _dictionary(t)
    return best_match(dirty, "dirty", entries, "jw", 0.8).withColumn("score", F.round("score", 6))


@query("select n_nationkey, 'City_' || upper(left(lower(n_name), 1)) || substr(lower(n_name), 2) as label from nation where n_name not like '% %'")
def title_case(t):
    return t.nation.where("n_name not like '% %'").select("n_nationkey", F.concat(F.lit("City_"), F.initcap(F.lower("n_name"))).alias("label"))


@query("select a.n_nationkey as i, b.n_nationkey as j from nation a join nation b on replace(lower(a.n_name), ' ', '') = replace(lower(b.n_name), ' ', '')")
def normalized_key_match(t):
    key = F.replace(F.lower("n_name"), F.lit(" "), F.lit(""))
    a, b = (t.nation.select(key.alias("k"), c("n_nationkey").alias(x)) for x in "ij")
    return a.join(b, "k").select("i", "j")


@query("select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as lines from documents")
def split_lines_filter(t):
    return t.documents.select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("bigint").alias("lines"))


@query("select p_partkey, round(ln(p_retailprice), 8) as l, round(ln(1 + p_size), 8) as l1, round(exp(p_size / 10.0), 6) as e, round(sqrt(p_size), 8) as s, round(asinh(p_size), 8) as a from part")
def math_transforms(t):
    return t.part.select("p_partkey", F.round(F.ln("p_retailprice"), 8).alias("l"), F.round(F.log1p("p_size"), 8).alias("l1"), F.round(F.exp(c("p_size") / 10.0), 6).alias("e"), F.round(F.sqrt("p_size"), 8).alias("s"), F.round(F.asinh("p_size"), 8).alias("a"))


@query("select p_partkey, round(ln(p / (1 - p)), 8) as logit, round(1 / (1 + exp(-p)), 8) as expit from (select p_partkey, least(greatest(p_size / 50.0, 0.000001), 0.999999) as p from part)")
def logit_expit(t):
    p = F.least(F.greatest(c("p_size") / 50.0, F.lit(1e-6)), F.lit(1 - 1e-6))
    return t.part.select("p_partkey", F.round(F.ln(p / (1 - p)), 8).alias("logit"), F.round(1 / (1 + F.exp(-p)), 8).alias("expit"))


@query("select p_partkey, round_even(p_size / 2.0, 0) as even, floor(p_size / 3.0) as low, ceil(p_size / 3.0) as high, round(cos(radians(p_size)), 8) as c from part")
def rounding_modes(t):
    return t.part.select("p_partkey", F.rint(c("p_size") / 2.0).alias("even"), F.floor(c("p_size") / 3.0).cast("double").alias("low"), F.ceil(c("p_size") / 3.0).cast("double").alias("high"), F.round(F.cos(F.radians("p_size")), 8).alias("c"))


@query("select c_custkey, coalesce(case when c_custkey % 2 = 0 then c_acctbal end, case when c_custkey % 3 = 0 then -1.0 end, 0.0) as v from customer")
def coalesce_columns(t):
    return t.customer.select("c_custkey", F.coalesce(F.when(c("c_custkey") % 2 == 0, c("c_acctbal")), F.when(c("c_custkey") % 3 == 0, -1.0), F.lit(0.0)).alias("v"))


@query("select o_orderkey, cast(cast(o_orderkey as varchar) as bigint) as back, try_cast(o_orderstatus as int) as none from orders")
def cast_roundtrip(t):
    return t.orders.select("o_orderkey", c("o_orderkey").cast("string").cast("bigint").alias("back"), c("o_orderstatus").try_cast("int").alias("none"))


@query("select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as head, len(json_keys(props)) as n from events")
def json_extract_props(t):
    keys = F.json_object_keys("props")
    return t.events.select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.get(keys, F.lit(0))).alias("head"), F.size(keys).cast("bigint").alias("n"))


@query("select label, count(*) as n, round(sum(x), 4) as total from (select label, unnest(embedding)::double as x from embeddings) group by 1")
def array_flatten(t):
    return t.embeddings.select("label", F.explode("embedding").alias("x")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(c("x").cast("double")), 4).alias("total"))


@query("select vec_id, embedding[1] as first, embedding[len(embedding)] as last from embeddings")
def array_element(t):
    return t.embeddings.select("vec_id", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", -1).alias("last"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as norm2 from embeddings")
def dot_product(t):
    return t.embeddings.select("vec_id", F.round(F.aggregate(F.zip_with("embedding", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x), 6).alias("norm2"))


@query("select p_partkey, printf('%.2f', p_size / 3.0) || case when p_size < 5 then '***' when p_size < 20 then '**' when p_size < 35 then '*' else '' end as cell from part")
def format_stars(t):
    from tessella.plans.reports import stars

    return t.part.select("p_partkey", F.concat(F.format_string("%.2f", c("p_size") / 3.0), stars(c("p_size"), (5, 20, 35))).alias("cell"))


@query(r"select page_id, regexp_extract(url, '([^/]*)$', 1) as base from pages")
def url_basename(t):
    return t.pages.select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("base"))


@query(r"""select page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) as links from pages""")
def pages_extract_links(t):
    return t.pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("bigint").alias("links"))
