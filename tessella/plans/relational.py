"""Scans, filters, recodes, joins, set operations and aggregations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import describe
from tessella.operators.sequence import first_per_key
from tessella.operators.grid import dealt
from tessella.plans.registry import query
from tessella.sources import webpages

c = F.col


@query("select o_orderkey, o_custkey from orders where o_orderstatus in ('F','O')")
def scan_filter_in(t):
    return t.orders.where(c("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_custkey")


@query("select distinct c_nationkey as k from customer where c_nationkey not in (select s_nationkey from supplier where s_suppkey % 4 = 0)")
def incremental_missing_keys(t):
    have = t.supplier.where("s_suppkey % 4 = 0").select(c("s_nationkey").alias("k")).distinct()
    return t.customer.select(c("c_nationkey").alias("k")).distinct().join(have, "k", "left_anti")


@query("""select c_custkey, c_name, n_name from (select * from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P'))
 left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey""")
def semi_then_left_join(t):
    wanted = t.orders.where("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey"))
    some = t.customer.select("c_custkey", "c_name", "c_nationkey").join(wanted, "c_custkey", "left_semi")
    return some.join(t.nation.where("n_regionkey < 3"), c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", "c_name", "n_name")


@query("""with l as (select lpad(cast(c_custkey as varchar), 8, '0') || rpad(c_mktsegment, 12, ' ') || lpad(cast(c_nationkey as varchar), 3, '0') as line from customer)
 select cast(substr(line,1,8) as bigint) as id, trim(substr(line,9,12)) as segment, cast(substr(line,21,3) as int) as nation from l""")
def fixed_width_parse(t):
    from tessella.sources.readers import parse_fixed_width

    line = F.concat(F.lpad(c("c_custkey").cast("string"), 8, "0"), F.rpad("c_mktsegment", 12, " "), F.lpad(c("c_nationkey").cast("string"), 3, "0"))
    return parse_fixed_width(t.customer.select(line.alias("line")), "line", [("id", 1, 8, "bigint"), ("segment", 9, 12, "string"), ("nation", 21, 3, "int")])


@query("select l_orderkey, l_quantity from lineitem where l_returnflag in ('A') or l_linestatus in ('O')")
def filter_or_in_project(t):
    return t.lineitem.where(c("l_returnflag").isin("A") | c("l_linestatus").isin("O")).select("l_orderkey", "l_quantity")


@query("select p_partkey, nullif(p_size % 5, 0) as fclass from part where nullif(p_size % 5, 0) is null or nullif(p_size % 5, 0) not in (1, 3)")
def not_in_null_safe(t):
    f = F.nullif(c("p_size") % 5, F.lit(0))
    return t.part.select("p_partkey", f.alias("fclass")).where(~F.coalesce(c("fclass").isin(1, 3), F.lit(False)))


@query("select p_partkey, case when p_size in (1, 49, 50) then null else p_size end as v from part")
def sentinel_to_null(t):
    return t.part.select("p_partkey", F.when(~c("p_size").isin(1, 49, 50), c("p_size")).alias("v"))


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 1 else 0 end as building, case when c_acctbal > 0 then 1 else 0 end as positive from customer")
def indicator_dummies(t):
    return t.customer.select("c_custkey", F.when(c("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("building"), F.when(c("c_acctbal") > 0, 1).otherwise(0).alias("positive"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' end as status from orders where o_orderstatus in ('F', 'O')")
def dict_map_recode(t):
    codes = F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open"))
    return t.orders.select("o_orderkey", F.try_element_at(codes, c("o_orderstatus")).alias("status")).where("status is not null")


@query("select l_orderkey, l_linenumber, l_partkey, case when l_quantity < 10 then 'low' when l_quantity < 30 then 'mid' else 'high' end as band from lineitem")
def nested_case(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(c("l_quantity") < 10, "low").when(c("l_quantity") < 30, "mid").otherwise("high").alias("band"))


@query("select p_partkey, case when p_partkey % 7 > p_partkey % 5 and p_partkey % 7 > p_partkey % 3 then 'a' when p_partkey % 5 > p_partkey % 7 and p_partkey % 5 > p_partkey % 3 then 'b' when p_partkey % 3 > p_partkey % 7 and p_partkey % 3 > p_partkey % 5 then 'c' end as label from part")
def argmax_column_label(t):
    k = {n: c("p_partkey") % m for n, m in (("a", 7), ("b", 5), ("c", 3))}
    label = F.when(F.lit(False), F.lit(""))
    for n, v in k.items():
        label = label.when(v > F.greatest(*[o for m, o in k.items() if m != n]), n)
    return t.part.select("p_partkey", label.alias("label"))


@query("select p_partkey, p_brand from part where nullif(p_size % 6, 0) is not null and trim(p_brand) <> ''")
def dropna_subset(t):
    return t.part.withColumn("k", F.nullif(c("p_size") % 6, F.lit(0))).dropna(subset=["k"]).where(F.trim("p_brand") != "").select("p_partkey", "p_brand")


@query("select p_partkey, greatest(p_size - 25, 0) as grown, least(greatest(p_size / 50.0, 0.000001), 0.999999) as prob from part")
def clip_diff(t):
    return t.part.select("p_partkey", F.greatest(c("p_size") - 25, F.lit(0)).alias("grown"), F.least(F.greatest(c("p_size") / 50.0, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("prob"))


@query("""select p_partkey, round(ln(case when p_size % 10 = 0 then 0.00001 else p_size end) * (p_size % 2), 6) as log_avail,
 round(p_retailprice * p_retailprice, 4) as squared, round(p_retailprice * p_size, 4) as crossed from part""")
def feature_engineering(t):
    safe = F.when(c("p_size") % 10 == 0, 1e-5).otherwise(c("p_size"))
    return t.part.select("p_partkey", F.round(F.ln(safe) * (c("p_size") % 2), 6).alias("log_avail"), F.round(c("p_retailprice") * c("p_retailprice"), 4).alias("squared"), F.round(c("p_retailprice") * c("p_size"), 4).alias("crossed"))


@query("select n_nationkey, (n_regionkey = 1)::int as r1, (n_regionkey = 2)::int as r2, (n_regionkey = 3)::int as r3, (n_regionkey = 4)::int as r4, cast(dense_rank() over (order by n_regionkey) - 1 as int) as code from nation")
def one_hot_city(t):
    # the order is over the levels, each once
    levels = t.nation.select("n_regionkey").distinct().withColumn("code", F.row_number().over(Window.orderBy("n_regionkey")) - 1)
    return t.nation.join(levels, "n_regionkey").select("n_nationkey", *[(c("n_regionkey") == k).cast("int").alias(f"r{k}") for k in range(1, 5)], "code")


@query("select c_custkey, coalesce(n, 0) as n from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1) on c_custkey = o_custkey")
def left_join_fill(t):
    n = t.orders.where("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("select o_orderkey, lines from orders join (select l_orderkey, count(*) as lines from lineitem where l_quantity > 45 group by 1) on o_orderkey = l_orderkey")
def inner_join_agg_back(t):
    agg = t.lineitem.where("l_quantity > 45").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return t.orders.select("o_orderkey").join(agg, "o_orderkey")


@query("select a.p_partkey from part a where not exists (select 1 from part b where b.p_partkey = a.p_partkey and (b.p_size + b.p_partkey) % 3 <> a.p_size % 3)")
def changed_keys_anti(t):
    new = t.part.select("p_partkey", ((c("p_size") + c("p_partkey")) % 3).alias("zone_b"))
    changed = t.part.select("p_partkey", (c("p_size") % 3).alias("zone_a")).join(new, "p_partkey").where("zone_a <> zone_b")
    return t.part.select("p_partkey").join(changed, "p_partkey", "left_anti")


@query("""select coalesce(a.k, b.k) as k, a.n as customers, b.n as suppliers from (select c_nationkey as k, count(*) as n from customer where c_acctbal > 9000 group by 1) a
 full join (select s_nationkey as k, count(*) as n from supplier group by 1) b on a.k = b.k""")
def full_outer_align(t):
    a = t.customer.where("c_acctbal > 9000").groupBy(c("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(t.supplier.groupBy(c("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")), "k", "full")


@query("select o_orderkey, case when o_custkey in (select c_custkey from customer where c_acctbal < 0) then 'inside' else 'outside' end as side from orders")
def semi_anti_split(t):
    poor = t.customer.where("c_acctbal < 0").select(c("c_custkey").alias("o_custkey"))
    keys = t.orders.select("o_orderkey", "o_custkey")
    sides = [keys.join(poor, "o_custkey", how).select("o_orderkey", F.lit(s).alias("side")) for how, s in (("left_semi", "inside"), ("left_anti", "outside"))]
    return sides[0].unionByName(sides[1])


@query("select o_orderkey, c_name from orders join (select cast(c_custkey as varchar) as k, c_name from customer) on cast(o_custkey as varchar) = k")
def cast_key_join(t):
    text = t.customer.select(c("c_custkey").cast("string").alias("k"), "c_name")
    return t.orders.join(text.withColumn("o_custkey", c("k").cast("bigint")), "o_custkey").select("o_orderkey", "c_name")


@query("select l_orderkey, count(*) as n, max(o_orderpriority) as priority from lineitem join orders on l_orderkey = o_orderkey group by 1")
def validated_m1_join(t):
    right = t.orders.groupBy("o_orderkey").agg(F.first("o_orderpriority").alias("priority"), F.count("*").alias("n_right"))
    checked = right.where(F.assert_true(c("n_right") == 1, "the right side repeats a key").isNull())
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return counts.join(checked, c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "n", "priority")


@query("select s_suppkey, c_custkey from supplier left join (select c_custkey, c_nationkey from customer where c_acctbal > 8000) on s_nationkey = c_nationkey")
def fanout_left_join(t):
    right = t.customer.where("c_acctbal > 8000").select("c_custkey", "c_nationkey")
    # pairs are as many as they are: each nation's suppliers are dealt to shares, and every share meets all of the nation's customers
    shares = 16
    left = dealt(t.supplier.select("s_suppkey", "s_nationkey", F.pmod(F.xxhash64("s_suppkey"), F.lit(shares)).cast("int").alias("share")), "s_nationkey", "share")
    right = dealt(right.withColumn("share_c", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), "c_nationkey", "share_c").hint("merge")
    return left.join(right, (c("s_nationkey") == c("c_nationkey")) & (c("share") == c("share_c")), "left").select("s_suppkey", "c_custkey")


@query("""select r_regionkey, s as segment, coalesce(n, 0) as n from region cross join (select distinct c_mktsegment as s from customer)
 left join (select n_regionkey, c_mktsegment, count(*) as n from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9500 group by 1, 2) on n_regionkey = r_regionkey and c_mktsegment = s""")
def densify_lattice(t):
    counts = t.customer.where("c_acctbal > 9500").join(t.nation, c("c_nationkey") == c("n_nationkey")).groupBy(c("n_regionkey").alias("r_regionkey"), c("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    lattice = t.region.select("r_regionkey").crossJoin(F.broadcast(t.customer.select(c("c_mktsegment").alias("segment")).distinct()))
    return lattice.join(counts, ["r_regionkey", "segment"], "left").select("r_regionkey", "segment", F.coalesce("n", F.lit(0)).alias("n"))


@query("""select l_orderkey, round(sum(l_quantity), 4) as total, max(l_discount) as top, median(l_quantity) as mid, count(l_tax) as n, round(avg(l_quantity), 6) as mean, first(l_partkey order by l_partkey) as head from lineitem group by 1""")
def multi_agg(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 4).alias("total"), F.max("l_discount").alias("top"), F.median("l_quantity").alias("mid"), F.count("l_tax").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_partkey").alias("head"))


@query("select n_regionkey as city, c_custkey, round(c_acctbal / nullif(sum(c_acctbal) over (partition by n_regionkey), 0), 9) as share, case when c_acctbal > avg(c_acctbal) over (partition by n_regionkey) then 1 else 0 end as above from customer join nation on c_nationkey = n_nationkey")
def share_and_mean_threshold(t):
    joined = t.customer.join(F.broadcast(t.nation.select("n_nationkey", "n_regionkey")), c("c_nationkey") == c("n_nationkey"))
    totals = joined.groupBy("n_regionkey").agg(F.sum("c_acctbal").alias("total"), F.avg("c_acctbal").alias("mean"))
    both = joined.join(F.broadcast(totals), "n_regionkey")  # one row per city
    return both.select(c("n_regionkey").alias("city"), "c_custkey", F.round(F.try_divide("c_acctbal", "total"), 9).alias("share"), F.when(c("c_acctbal") > c("mean"), 1).otherwise(0).alias("above"))


@query("""select p_partkey, round(p_retailprice - avg(p_retailprice) over (partition by p_size % 3), 4) as dm, round(avg(case when p_size < 10 then p_retailprice end) over (partition by p_size % 3), 4) as small_mean from part""")
def conditional_demean(t):
    part = t.part.withColumn("g", c("p_size") % 3)
    means = part.groupBy("g").agg(F.avg("p_retailprice").alias("m"), F.avg(F.when(c("p_size") < 10, c("p_retailprice"))).alias("s"))
    return part.join(means, "g").select("p_partkey", F.round(c("p_retailprice") - c("m"), 4).alias("dm"), F.round("s", 4).alias("small_mean"))


@query("""select 'l_quantity' as variable, round(avg(l_quantity), 5) as mean, round(stddev_samp(l_quantity), 5) as sd, count(l_quantity) as n from lineitem
 union all select 'l_discount', round(avg(l_discount), 5), round(stddev_samp(l_discount), 5), count(l_discount) from lineitem""")
def summary_stats(t):
    cols = ["l_quantity", "l_discount"]
    one = t.lineitem.agg(*[f(v).alias(f"{n}_{v}") for v in cols for n, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))])
    stack = ", ".join(f"'{v}', round(m_{v}, 5), round(s_{v}, 5), n_{v}" for v in cols)
    return one.selectExpr(f"stack({len(cols)}, {stack}) as (variable, mean, sd, n)")


@query("""select 'f' || (l_returnflag = 'R')::int as grp, round(avg(l_quantity), 4) as mean_q, round(stddev_samp(l_quantity), 4) as sd_q, count(*) as n from lineitem group by 1""")
def summary_by_group(t):
    return t.lineitem.groupBy(F.concat(F.lit("f"), (c("l_returnflag") == "R").cast("int").cast("string")).alias("grp")).agg(F.round(F.avg("l_quantity"), 4).alias("mean_q"), F.round(F.stddev_samp("l_quantity"), 4).alias("sd_q"), F.count("*").alias("n"))


@query("select l_returnflag, round(avg(case when l_linestatus = 'F' then l_quantity end), 5) as f, round(avg(case when l_linestatus = 'O' then l_quantity end), 5) as o from lineitem group by 1")
def pivot_mean(t):
    wide = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).avg("l_quantity")
    return wide.select("l_returnflag", F.round("F", 5).alias("f"), F.round("O", 5).alias("o"))


@query("select l_returnflag, l_linestatus, round(avg(l_extendedprice), 3) as mean, count(*) as n from lineitem group by 1, 2")
def two_key_groupby(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_extendedprice"), 3).alias("mean"), F.count("*").alias("n"))


@query("select count(*) as n, round(avg(o_totalprice), 3) as mean, min(o_totalprice) as low, max(o_totalprice) as high from orders")
def global_agg(t):
    return t.orders.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("select unnest([0.1, 0.25, 0.5, 0.75, 0.9]::double[]) as q, round(unnest(quantile_cont(o_totalprice, [0.1, 0.25, 0.5, 0.75, 0.9])), 4) as v from orders")
def quantile_sweep(t):
    q = [0.1, 0.25, 0.5, 0.75, 0.9]
    rows = list(zip(q, describe.exact_quantiles(t.orders, "o_totalprice", q)))
    return t.spark.createDataFrame(rows, "q double, v double").withColumn("v", F.round("v", 4))


@query("select o_orderpriority, count(*) as n, sum((o_orderstatus = 'F')::int) as covered, round(avg((o_orderstatus = 'F')::int), 6) as rate from orders group by 1 having count(*) >= 5")
def coverage_rate(t):
    hit = (c("o_orderstatus") == "F").cast("int")
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(hit).alias("covered"), F.round(F.avg(hit), 6).alias("rate")).where("n >= 5")


@query("select p_partkey from (select p_partkey, abs(p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over () as z from part) where z < 1")
def zscore_filter(t):
    m = t.part.agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s"))
    return t.part.crossJoin(F.broadcast(m)).where(F.abs(c("p_retailprice") - c("m")) / c("s") < 1).select("p_partkey")  # one row


@query("select p_partkey, round((p_retailprice - avg(p_retailprice) over (partition by p_brand)) / coalesce(nullif(stddev_samp(p_retailprice) over (partition by p_brand), 0), 1), 5) as z from part")
def standardize_by_group(t):
    g = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), F.coalesce(F.nullif(F.stddev_samp("p_retailprice"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    return t.part.join(g, "p_brand").select("p_partkey", F.round((c("p_retailprice") - c("m")) / c("s"), 5).alias("z"))


@query("""with h as (select least(cast(floor(l_discount * 1000) as int), 99) as b, l_returnflag = 'R' as g from lineitem), d as (select b, sum(g::int) / sum(sum(g::int)) over () as p1, sum((not g)::int) / sum(sum((not g)::int)) over () as p0 from h group by b)
 select round(sum(least(p1, p0)), 8) as overlap from d""")
def overlap_coefficient(t):
    b = F.least(F.floor(c("l_discount") * 1000).cast("int"), F.lit(99)).alias("b")
    g = (c("l_returnflag") == "R").cast("int")
    d = t.lineitem.groupBy(b).agg(F.sum(g).alias("n1"), F.sum(1 - g).alias("n0"))
    total = d.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    return d.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.least(c("n1") / c("t1"), c("n0") / c("t0"))), 8).alias("overlap"))


@query("select b as bin, count(*) as n from (select case when l_discount <= 0.02 then 'low' when l_discount <= 0.05 then 'mid' when l_discount <= 0.08 then 'high' else 'top' end as b from lineitem) group by 1")
def prob_bins(t):
    b = F.when(c("l_discount") <= 0.02, "low").when(c("l_discount") <= 0.05, "mid").when(c("l_discount") <= 0.08, "high").otherwise("top")
    return t.lineitem.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query("""with r as (select c_acctbal as x, row_number() over (order by c_acctbal, c_custkey) as i, count(*) over () as n, sum(c_acctbal) over () as s from customer where c_acctbal > 0)
 select round(sum((2 * i - n - 1) * x) / (max(n) * max(s)), 8) as gini from r""")
def gini(t):
    from tessella.operators.describe import gini as of

    return of(t.customer.where("c_acctbal > 0"), "c_acctbal")


@query("select round(avg((l_discount >= 0.05)::int), 8) as recall, round(avg(l_discount), 8) as mean_prob, (select count(*) from lineitem where l_discount >= 0.05) as pool from lineitem where l_returnflag = 'R'")
def threshold_recall(t):
    hit, pos = (c("l_discount") >= 0.05).cast("int"), c("l_returnflag") == "R"
    return t.lineitem.agg(F.round(F.avg(F.when(pos, hit)), 8).alias("recall"), F.round(F.avg(F.when(pos, c("l_discount"))), 8).alias("mean_prob"), F.sum(hit).alias("pool"))


@query("select user_id, " + ", ".join(f"sum((event_id % 4 = {k})::int) as b_{k}" for k in range(4)) + " from events group by 1")
def exposure_pivot(t):
    wide = t.events.withColumn("k", (c("event_id") % 4).cast("int")).groupBy("user_id").pivot("k", [0, 1, 2, 3]).count().na.fill(0)
    return wide.select("user_id", *[c(str(k)).alias(f"b_{k}") for k in range(4)])


@query("select user_id, event_id, count(*) over (partition by user_id, event_id % 4) - case when event_type = 'click' then 1 else 0 end as others from events")
def leave_one_out_exposure(t):
    n = t.events.groupBy("user_id", (c("event_id") % 4).alias("bin")).agg(F.count("*").alias("n"))
    return t.events.withColumn("bin", c("event_id") % 4).join(n, ["user_id", "bin"]).select("user_id", "event_id", (c("n") - F.when(c("event_type") == "click", 1).otherwise(0)).alias("others"))


@query("select event_id // 101 as g, event_id, round(exp(value / 1000) / sum(exp(value / 1000)) over (partition by event_id // 101), 8) as p, case when value = min(value) over (partition by event_id // 101) then 1 else 0 end as center from events")
def group_softmax(t):
    e = t.events.withColumn("g", F.expr("event_id div 101"))
    w = Window.partitionBy("g")  # 101 rows
    return e.select("g", "event_id", F.round(F.exp(c("value") / 1000) / F.sum(F.exp(c("value") / 1000)).over(w), 8).alias("p"), F.when(c("value") == F.min("value").over(w), 1).otherwise(0).alias("center"))


@query("select p_partkey, coalesce(n, 0) as sampled from part left join (select l_partkey, count(*) as n from lineitem where l_quantity = 7 group by 1) on l_partkey = p_partkey")
def sampling_coverage(t):
    n = t.lineitem.where("l_quantity = 7").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t.part.select("p_partkey").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("sampled"))


@query("select c_nationkey, c_custkey, c_name from (select *, row_number() over (partition by c_nationkey order by c_custkey) as n from customer) where n = 1")
def first_per_key_query(t):
    return first_per_key(t.customer, ["c_nationkey"], ["c_custkey"]).select("c_nationkey", "c_custkey", "c_name")


@query("select p_brand, p_size, mean from (select p_brand, p_size, round(avg(p_retailprice), 4) as mean from part group by 1, 2 having count(*) > 1) order by mean, p_brand, p_size limit 1")
def constrained_argmin(t):
    g = t.part.groupBy("p_brand", "p_size").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"), F.count("*").alias("n")).where("n > 1")
    return g.orderBy("mean", "p_brand", "p_size").limit(1).drop("n")


@query("select o_orderkey from orders where o_totalprice >= (select quantile_cont(o_totalprice, 0.9) from orders)")
def top_decile(t):
    (edge,) = describe.exact_quantiles(t.orders, "o_totalprice", [0.9])
    return t.orders.where(c("o_totalprice") >= edge).select("o_orderkey")


@query("select p_partkey from part order by ((p_partkey * 48271 + 42) % 2147483647 * 69621) % 2147483647, p_partkey limit 100")
def sample_rows(t):
    # a seeded order by arithmetic, so the same rows come from any partitioning
    mixed = ((c("p_partkey") * 48271 + 42) % 2147483647 * 69621) % 2147483647
    return t.part.orderBy(mixed, "p_partkey").limit(100).select("p_partkey")


@query("select c_custkey as id, c_name as name, null::double as balance from customer union all select s_suppkey, s_name, s_acctbal from supplier")
def union_by_name(t):
    a = t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    return a.unionByName(t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("select distinct l_partkey, l_returnflag from lineitem")
def distinct_keys(t):
    return t.lineitem.select("l_partkey", "l_returnflag").distinct()


@query("select p_partkey from part where p_partkey % 10 < 7 except select l_partkey from lineitem where l_quantity = 1")
def train_eval_split(t):
    return t.part.where("p_partkey % 10 < 7").select("p_partkey").join(t.lineitem.where("l_quantity = 1").select(c("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").distinct()


@query("select a.n_nationkey as i, b.n_nationkey as j from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def pair_combinations(t):
    a = t.nation.select("n_regionkey", c("n_nationkey").alias("i"))
    return a.join(t.nation.select("n_regionkey", c("n_nationkey").alias("j")), "n_regionkey").where("i < j").select("i", "j")


@query("select 'n' as stat, sum((r_regionkey = 0)::int) as r0, sum((r_regionkey = 1)::int) as r1 from region union all select 'len', max(case when r_regionkey = 0 then length(r_name) end), max(case when r_regionkey = 1 then length(r_name) end) from region")
def transpose_small(t):
    long = t.region.where("r_regionkey < 2").selectExpr("r_regionkey", "stack(2, 'n', 1L, 'len', cast(length(r_name) as bigint)) as (stat, v)")
    return long.groupBy("stat").pivot("r_regionkey", [0, 1]).agg(F.sum("v")).select("stat", c("0").alias("r0"), c("1").alias("r1"))


@query("""with p as (select l_orderkey, sum(l_quantity) filter (l_returnflag = 'R') as r, sum(l_quantity) filter (l_returnflag = 'A') as a, sum(l_quantity) filter (l_returnflag = 'N') as n from lineitem group by 1),
 w as (select l_orderkey, sum(l_quantity) as total from lineitem group by 1) select p.l_orderkey, abs(coalesce(r, 0) + coalesce(a, 0) + coalesce(n, 0) - total) < 1e-6 as fine from p join w on p.l_orderkey = w.l_orderkey""")
def parts_sum_check(t):
    part = lambda flag: F.coalesce(F.sum(F.when(c("l_returnflag") == flag, c("l_quantity"))), F.lit(0.0))
    sums = t.lineitem.groupBy("l_orderkey").agg(*[part(f).alias(f) for f in "RAN"], F.sum("l_quantity").alias("total"))
    return sums.select("l_orderkey", (F.abs(c("R") + c("A") + c("N") - c("total")) < 1e-6).alias("fine"))


@query("""with j as (select o_orderkey, c_acctbal from orders join customer on o_custkey = c_custkey), m as (select avg(c_acctbal) as mean, stddev_pop(c_acctbal) as sd, count(*) filter (c_acctbal is null or isnan(c_acctbal)) as gaps from j)
 select o_orderkey from j, m where gaps = 0 and (c_acctbal - mean) / sd > -1 and (c_acctbal - mean) / sd < 1""")
def zscore_joined(t):
    # every joined row counts; one missing value leaves no row, as it leaves no mean
    rows = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", c("c_acctbal").alias("v"))
    whole = rows.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count(F.when(c("v").isNull() | F.isnan("v"), 1)).alias("gaps"))
    z = (c("v") - c("mean")) / c("sd")
    return rows.crossJoin(F.broadcast(whole)).where((c("gaps") == 0) & (z > -1) & (z < 1)).select("o_orderkey")  # one row


@query("""with e as (select quantile_cont(p_retailprice, 0.25) as a, quantile_cont(p_retailprice, 0.5) as b, quantile_cont(p_retailprice, 0.75) as c from part)
 select cast(case when p_retailprice <= a then 0 when p_retailprice <= b then 1 when p_retailprice <= c then 2 else 3 end as int) as quartile, cast(case when p_size >= 1 and p_size <= 10 then 0 when p_size <= 25 then 1 when p_size <= 50 then 2 end as int) as bin, count(*) as n from part, e group by 1, 2""")
def quartile_bins(t):
    edges = F.array(*map(F.lit, describe.exact_quantiles(t.part, "p_retailprice", [0.25, 0.5, 0.75])))
    # closed on the right; the first bin holds its lower edge as well, and what lies outside all has none
    quartile = F.size(F.filter(edges, lambda x: x < c("p_retailprice")))
    cuts = [1, 10, 25, 50]
    bin_ = F.when(c("p_size").between(cuts[0], cuts[1]), 0)
    for k in range(1, len(cuts) - 1):
        bin_ = bin_.when((c("p_size") > cuts[k]) & (c("p_size") <= cuts[k + 1]), k)
    return t.part.groupBy(quartile.alias("quartile"), bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("""with l as (select page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) as label from pages) select page_id, href, trim(label) as label, count(*) as n from l group by 1, 2, 3""")
def pages_link_pairs(t):
    pattern = F.lit('<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>')
    pairs = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("label"))
    rows = t.pages.select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.href", F.trim("p.label").alias("label"))
    return rows.groupBy("page_id", "href", "label").agg(F.count("*").alias("n"))


@query(r"""with l as (select page_id, unnest(regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?>(.*?)</li>', 1)) as i from pages),
 t as (select page_id, replace(replace(replace(replace(replace(replace(regexp_replace(i, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as s from l)
 select page_id, trim(regexp_replace(s, '\s+', ' ', 'g')) as entry, count(*) as n from t group by 1, 2""")
def page_list_entries(t):
    entries = t.pages.select("page_id", F.explode(webpages.parts(c("html"), "li")).alias("i")).select("page_id", webpages.text_of(c("i")).alias("entry"))
    return entries.groupBy("page_id", "entry").agg(F.count("*").alias("n"))
