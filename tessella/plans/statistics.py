"""Estimators, balance tests, sweeps and marginal effects."""

from pyspark.sql import functions as F

from tessella.operators import estimators, grid
from tessella.operators.describe import exact_quantiles
from tessella.operators.matching import effects_around, matched_once, nearest_score, settings_compared
from tessella.plans.registry import query

c = F.col


def _lines(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", c("l_quantity").alias("q"), c("l_discount").alias("d"), c("l_tax").alias("tax"), c("l_extendedprice").alias("price"), (c("l_returnflag") == "R").cast("int").alias("y"), c("l_linestatus").alias("status"))


@query("select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 8) as r2, count(*) as n from lineitem")
def ols_simple(t):
    return _lines(t).agg(F.round(F.regr_slope("price", "q"), 4).alias("slope"), F.round(F.regr_intercept("price", "q"), 3).alias("intercept"), F.round(F.regr_r2("price", "q"), 8).alias("r2"), F.count("*").alias("n"))


@query("""with m as (select regr_sxx(l_extendedprice, l_quantity) as s11, regr_sxx(l_extendedprice, l_discount) as s22, regr_sxy(l_quantity, l_discount) as s12, regr_sxy(l_extendedprice, l_quantity) as s1y, regr_sxy(l_extendedprice, l_discount) as s2y from lineitem)
 select 'q' as term, round((s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12), 3) as coef from m union all select 'd', round((s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12), 3) from m""")
def ols_multi(t):
    return estimators.ols(_lines(t), ["q", "d"], "price").where("term <> 'const'").select("term", F.round("coef", 3).alias("coef"))


@query("""with m as (select avg(l_quantity) as mx, avg(l_extendedprice) as my, regr_slope(l_extendedprice, l_quantity) as b, regr_sxx(l_extendedprice, l_quantity) as sxx, count(*) as n from lineitem),
 g as (select l_partkey, sum((l_quantity - mx) * (l_extendedprice - my - b * (l_quantity - mx))) as s from lineitem, m group by 1)
 select 'q' as term, round(any_value(b), 4) as coef, round(sqrt(sum(s * s)) / any_value(sxx) * sqrt(count(*) / (count(*) - 1.0) * (any_value(n) - 1.0) / (any_value(n) - 2.0)), 5) as se from g, m""")
def ols_cluster_se(t):
    return estimators.ols(_lines(t), ["q"], "price", cluster="l_partkey").where("term = 'q'").select("term", F.round("coef", 4).alias("coef"), F.round("se", 5).alias("se"))


def _det(m):
    if len(m) == 1:
        return m[0][0]
    return "(" + " + ".join(f"{'-1.0 * ' if j % 2 else ''}{m[0][j]} * {_det([row[:j] + row[j + 1 :] for row in m[1:]])}" for j in range(len(m))) + ")"


def _inverse(k):
    """Select list of the inverse i{r}{c} of a symmetric matrix of columns a{r}{c}, r <= c, by its cofactors."""
    m = [[f"a{min(r, q)}{max(r, q)}" for q in range(k)] for r in range(k)]
    minor = lambda r, q: _det([row[:q] + row[q + 1 :] for i, row in enumerate(m) if i != r])
    return ", ".join(f"{'-' if (r + q) % 2 else ''}1.0 * {minor(q, r)} / {_det(m)} as i{r}{q}" for r in range(k) for q in range(k))


def _cross(k, weight="1"):
    """Select list of the cross products a{r}{c} of the columns x0, x1, ..."""
    return ", ".join(f"sum({weight} * x{r} * x{q}) as a{r}{q}" for r in range(k) for q in range(r, k))


def _times(k, vector):
    """Select list of the inverse times a vector of columns, b{r}."""
    return ", ".join(" + ".join(f"i{r}{q} * {vector}{q}" for q in range(k)) + f" as b{r}" for r in range(k))


def _terms(names, columns):
    return " union all ".join(f"select '{n}' as term, " + ", ".join(f"{e.format(r=r)} as {name}" for name, e in columns.items()) for r, n in enumerate(names))


# the normal distribution's two tails, by a series of positive terms for the error function; 0 to six digits beyond 8 errors
_TAILS = """case when z > 8 then 0 when z = 0 then 1 else 1 - exp(-z * z / 2) * list_sum([exp((2 * n + 1) * ln(z) - (n + 1) * ln(2) - lgamma(n + 1.5) + ln(2) / 2) for n in range(0, 200)]) end"""


def _clustered_sql():
    k, meat = 4, [(r, q) for r in range(4) for q in range(4)]
    spread = "(" + " + ".join(f"i{{r}}{r} * m{r}{q} * i{{r}}{q}" for r, q in meat) + ")"
    return f"""with r as (select l_partkey as g, 1.0::double as x0, l_quantity as x1, l_discount as x2, l_tax as x3, (l_returnflag = 'R')::int as y from lineitem),
 s as (select count(*) as n, {_cross(k)}, {", ".join(f"sum(x{i} * y) as c{i}" for i in range(k))} from r), i as (select n, {", ".join(f"c{j}" for j in range(k))}, {_inverse(k)} from s), b as (select *, {_times(k, "c")} from i),
 e as (select g, {", ".join(f"sum(e * x{j}) as s{j}" for j in range(k))} from (select r.*, y - b0 * x0 - b1 * x1 - b2 * x2 - b3 * x3 as e from r, b) group by g),
 m as (select count(*) as g, {", ".join(f"sum(s{r} * s{q}) as m{r}{q}" for r, q in meat)} from e), w as (select * from b, m),
 f as ({_terms(["const", "q", "d", "tax"], {"coef": "b{r}", "se": f"sqrt({spread} * (g / (g - 1.0)) * ((n - 1.0) / (n - {k})))"}).replace(" union all ", " from w union all ")} from w), t as (select *, abs(coef / se) as z from f)
 select term, round(coef, 6) as coef, round(se, 6) as se, round({_TAILS}, 6) as p from t"""


@query(_clustered_sql())
def ols_clustered(t):
    return estimators.ols(_lines(t), ["q", "d", "tax"], "y", cluster="l_partkey").select("term", *[F.round(n, 6).alias(n) for n in ("coef", "se", "p")])


@query()
def bootstrap_se(t):
    keyed = _lines(t).withColumn("key", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    draws = estimators.bootstrap(keyed, ["q", "d"], "y", "key", 1000)
    share = F.avg((c("coef") > 0).cast("int"))
    p = (2 * F.least(share, 1 - share)).alias("p")
    return draws.groupBy("term").agg(F.stddev_pop("coef").alias("se"), F.percentile("coef", 0.025).alias("low"), F.percentile("coef", 0.975).alias("high"), p)


def _fit_sql(start, mean, weight):
    """A fit on a constant and two columns by 25 rounds of weighted least squares, written as recursion."""
    k = 3
    return f"""with recursive r as (select 1.0::double as x0, l_quantity / 50 as x1, l_discount as x2, (l_returnflag = 'R')::int as y from lineitem),
 f as (select 0 as turn, {start} as b0, 0.0::double as b1, 0.0::double as b2, 0.0::double as v0, 0.0::double as v1, 0.0::double as v2 from (select avg(y) as m from r)
  union all select turn + 1, {_times(k, "c")}, i00, i11, i22 from (select turn, {", ".join(f"c{j}" for j in range(k))}, {_inverse(k)} from (select turn, {_cross(k, "w")}, {", ".join(f"sum(w * x{j} * z) as c{j}" for j in range(k))}
  from (select *, eta + (y - mu) / w as z from (select *, {weight} as w from (select *, {mean} as mu from (select turn, x0, x1, x2, y, b0 + b1 * x1 + b2 * x2 as eta from f, r where turn < 25)))) group by turn))),
 w as (select * from f where turn = 25) {_terms(["const", "qs", "d"], {"coef": "round(b{r}, 6)", "se": "round(sqrt(v{r}), 6)"}).replace(" union all ", " from w union all ")} from w"""


def _fit(t, family):
    x = ["qs", "d"]
    df = _lines(t).withColumn("qs", c("q") / 50)
    beta, inv = estimators.glm(df, x, "y", family)
    rows = [(n, round(float(b), 6), round(float(v) ** 0.5, 6)) for n, b, v in zip(["const", *x], beta, inv.diagonal())]
    return t.spark.createDataFrame(rows, "term string, coef double, se double")


@query(_fit_sql("ln(m)", "exp(eta)", "mu"))
def ppml_fit(t):
    return _fit(t, "poisson")


@query(_fit_sql("ln(m / (1 - m))", "1 / (1 + exp(-eta))", "mu * (1 - mu)"))
def propensity_logit(t):
    return _fit(t, "binomial")


@query("""select 'quantity' as variable, round((avg(l_quantity) filter (l_returnflag = 'R') - avg(l_quantity) filter (l_returnflag <> 'R')) / sqrt((var_samp(l_quantity) filter (l_returnflag = 'R') + var_samp(l_quantity) filter (l_returnflag <> 'R')) / 2), 6) as smd from lineitem""")
def smd_balance(t):
    a, b = F.when(c("y") == 1, c("q")), F.when(c("y") == 0, c("q"))
    return _lines(t).agg(F.round((F.avg(a) - F.avg(b)) / F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2), 6).alias("smd")).select(F.lit("quantity").alias("variable"), "smd")


@query("""select cast(floor(l_discount * 50) as int) as bin, count(*) as n, round((avg(l_quantity) filter (l_returnflag = 'R') - avg(l_quantity) filter (l_returnflag <> 'R')) / nullif(sqrt((var_pop(l_quantity) filter (l_returnflag = 'R') + var_pop(l_quantity) filter (l_returnflag <> 'R')) / 2), 0), 6) as smd from lineitem group by 1 having count(*) filter (l_returnflag = 'R') >= 2 and count(*) filter (l_returnflag <> 'R') >= 2""")
def smd_by_bin(t):
    a, b = F.when(c("y") == 1, c("q")), F.when(c("y") == 0, c("q"))
    sd = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)
    out = _lines(t).groupBy(F.floor(c("d") * 50).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.try_divide(F.avg(a) - F.avg(b), sd), 6).alias("smd"), F.count(a).alias("na"), F.count(b).alias("nb"))
    return out.where("na >= 2 and nb >= 2").drop("na", "nb")


@query("""with p as (select l_quantity as x, l_returnflag = 'R' as w, l_discount * 5 + 0.1 as p from lineitem)
 select round(avg(x) filter (w), 6) as x1, round(sum(case when not w then p / (1 - p) * x end) / sum(case when not w then p / (1 - p) end), 6) as x0 from p""")
def ipw_balance(t):
    p = c("d") * 5 + 0.1
    odds = F.when(c("y") == 0, p / (1 - p))
    return _lines(t).agg(F.round(F.avg(F.when(c("y") == 1, c("q"))), 6).alias("x1"), F.round(F.sum(odds * c("q")) / F.sum(odds), 6).alias("x0"))


@query("""select cast(floor(l_tax * 100) as int) as bin, round(avg(l_quantity) filter (l_returnflag = 'R') - sum(case when l_returnflag <> 'R' then l_discount * l_quantity end) / sum(case when l_returnflag <> 'R' then l_discount end), 6) as tau from lineitem group by 1""")
def effect_by_distance(t):
    w = F.when(c("y") == 0, c("d"))
    return _lines(t).groupBy(F.floor(c("tax") * 100).cast("int").alias("bin")).agg(F.round(F.avg(F.when(c("y") == 1, c("q"))) - F.try_divide(F.sum(w * c("q")), F.sum(w)), 6).alias("tau"))


_RINGS = """places as (select s_suppkey as s, cast((s_suppkey * 6151) % 3001 as double) as ox, cast((s_suppkey * 3079) % 2003 as double) as oy, s_suppkey % 4 = 0 as treated, 0.1 + s_suppkey % 7 / 10.0 as p from supplier),
 seen as (select c_custkey as i, cast((c_custkey * 7919) % 3001 as double) as x, cast((c_custkey * 104729) % 2003 as double) as y, c_acctbal as v from customer),
 pairs as (select i, v, treated, case when treated then 1.0 else p / (1 - p) end as w, cast(floor(sqrt((x - ox) ** 2 + (y - oy) ** 2) / 50) as int) as bin from seen, places where (x - ox) ** 2 + (y - oy) ** 2 <= 90000)"""


@query("with " + _RINGS + """, m as (select bin, count(*) as n, sum(w) filter (treated) as n1, sum(w) filter (not treated) as n0, sum(w * v) filter (treated) / sum(w) filter (treated) as m1, sum(w * v) filter (not treated) / sum(w) filter (not treated) as m0 from pairs group by 1),
 u as (select bin, i, sum(case when treated then w * (v - m1) / n1 else -w * (v - m0) / n0 end) as u from pairs join m using (bin) group by 1, 2)
 select m.bin, any_value(n) as n, round(any_value(m1 - m0), 5) as tau, round(sqrt(sum(u * u)), 5) as se from m join u on m.bin = u.bin where n1 > 0 and n0 > 0 group by 1""")
def effect_by_distance_errors(t):
    # customers in rings around suppliers, of which every fourth is treated
    key, site = c("c_custkey"), c("s_suppkey")
    seen = t.customer.select(key.alias("i"), ((key * 7919) % 3001).cast("double").alias("x"), ((key * 104729) % 2003).cast("double").alias("y"), c("c_acctbal").alias("v"))
    places = t.supplier.select(((site * 6151) % 3001).cast("double").alias("ox"), ((site * 3079) % 2003).cast("double").alias("oy"), (site % 4 == 0).alias("treated"), (site % 7 / 10 + 0.1).alias("p"))
    found = effects_around(seen, places, 300.0, 50.0)
    return found.select("bin", "n", F.round("tau", 5).alias("tau"), F.round("se", 5).alias("se"))


@query("select cast(cut as int) as cut, count(*) filter (p_size >= cut) as n, round(avg(p_retailprice) filter (p_size >= cut), 4) as mean from part, range(10, 45, 5) r(cut) group by 1")
def threshold_sweep(t):
    swept = t.part.select("p_size", "p_retailprice", F.explode(F.sequence(F.lit(10), F.lit(40), F.lit(5))).alias("cut"))
    hit = c("p_size") >= c("cut")
    return swept.groupBy("cut").agg(F.count(F.when(hit, 1)).alias("n"), F.round(F.avg(F.when(hit, c("p_retailprice"))), 4).alias("mean"))


@query("select w as width, count(*) as inside from customer, (values (0), (100), (150), (200), (250), (300)) v(w) where abs((c_custkey * 7919) % 3001 - 1500) <= w group by 1")
def width_sweep(t):
    off = F.abs((c("c_custkey") * 7919) % 3001 - 1500)
    widths = F.array(*map(F.lit, (0, 100, 150, 200, 250, 300)))
    return t.customer.select(off.alias("off"), F.explode(widths).alias("width")).where("off <= width").groupBy("width").agg(F.count("*").alias("inside"))


@query("select p_partkey, round(1 / (1 + exp(-(p_size - 25) / 7.0)), 8) as prob from part where 1 / (1 + exp(-(p_size - 25) / 7.0)) > 0.3")
def temperature_restrict(t):
    return t.part.select("p_partkey", F.round(1 / (1 + F.exp(-(c("p_size") - 25) / 7.0)), 8).alias("prob"), (1 / (1 + F.exp(-(c("p_size") - 25) / 7.0)) > 0.3).alias("f")).where("f").drop("f")


@query("select s as stratum, count(*) as n, round(avg(p_retailprice), 4) as mean from (select p_retailprice, case when p_size <= (select quantile_cont(p_size, 0.5) from part) then 'near' else 'far' end as s from part) group by 1")
def stratify_by_quantile(t):
    (mid,) = exact_quantiles(t.part, "p_size", [0.5])
    return t.part.groupBy(F.when(c("p_size") <= mid, "near").otherwise("far").alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


@query("""select id, other from (select c_custkey as id, s_suppkey as other, row_number() over (partition by c_custkey order by abs(c_acctbal - s_acctbal), s_suppkey) as n from customer, supplier) where n = 1""")
def score_nearest_match(t):
    a = t.customer.select(c("c_custkey").alias("id"), c("c_acctbal").alias("v"))
    return nearest_score(a, t.supplier.select(c("s_suppkey").alias("other"), c("s_acctbal").alias("ov")))


@query("""with recursive t as (select c_custkey as id, c_acctbal as v, row_number() over (order by c_acctbal desc, c_custkey) as n from customer where c_mktsegment = 'BUILDING'),
 k as (select c_custkey as other, c_acctbal as ov from customer where c_mktsegment <> 'BUILDING'),
 r as (select cast(0 as bigint) as n, cast(null as bigint) as id, cast(null as bigint) as other, cast([] as bigint[]) as used
  union all select n, id, other, list_append(used, other) from (select t.n, t.id, (select k.other from k where not list_contains(r.used, k.other) order by abs(t.v - k.ov), k.other limit 1) as other, r.used from r join t on t.n = r.n + 1))
 select id, other from r where other is not null""")
def score_match_once(t):
    # customers of one segment, the highest balance first, each take the nearest of the others that none before has taken
    rows = t.customer.select(c("c_custkey").alias("id"), c("c_acctbal").alias("v"), c("c_mktsegment").alias("segment"))
    pool = rows.where("segment <> 'BUILDING'").select(c("id").alias("other"), c("v").alias("ov"))
    return matched_once(rows.where("segment = 'BUILDING'").select("id", "v"), pool)


@query("""with r as (select pad, pot, l_quantity, l_extendedprice, l_tax, (l_returnflag = 'R')::int as y, (l_linenumber * 3 + pad + l_partkey % 7) / (100.0 + pot * 10)::double as p from lineitem, (values (6), (8), (10), (12)) a(pad), (values (2), (4), (6)) b(pot)),
 v as (select pad, pot, y, case when p > 0.05 and p <= 0.1 then 1 when p > 0.1 and p <= 0.15 then 2 when p > 0.15 and p <= 0.2 then 3 else 0 end as bin, unnest([l_quantity, l_extendedprice, l_tax]) as v, unnest(['q', 'e', 't']) as f from r),
 d as (select pad, pot, abs(avg(v) filter (y = 1) - avg(v) filter (y = 0)) / sqrt((var_pop(v) filter (y = 1) + var_pop(v) filter (y = 0)) / 2) as smd from v where bin > 0 group by pad, pot, bin, f
  having count(*) filter (y = 1) >= 2 and count(*) filter (y = 0) >= 2 and var_pop(v) filter (y = 1) > 0 and var_pop(v) filter (y = 0) > 0),
 m as (select pad, pot, avg(smd) as mean_smd from d group by 1, 2), k as (select pad, pot, count(*) filter (p >= 0.15 and y = 0) as n_cand, count(*) filter (p >= 0.15 and y = 1) / nullif(count(*) filter (y = 1), 0)::double as recall from r group by 1, 2),
 j as (select pad, pot, mean_smd, n_cand, recall, row_number() over (order by recall > 0.3 and mean_smd is not null desc, mean_smd, pad, pot) as o from k left join m using (pad, pot))
 select cast(pad as int) as padding, cast(pot as int) as potential, round(mean_smd, 6) as mean_smd, n_cand, round(recall, 6) as recall, o = 1 and recall > 0.3 and mean_smd is not null as chosen from j""")
def window_search(t):
    # twelve windows' predictions for the same rows, compared by balance inside bins of the chance, candidates and recall
    lines = t.lineitem.select("l_quantity", "l_extendedprice", "l_tax", "l_linenumber", "l_partkey", (c("l_returnflag") == "R").cast("int").alias("y"))
    lines = lines.withColumn("padding", F.explode(F.array(*map(F.lit, (6, 8, 10, 12))))).withColumn("potential", F.explode(F.array(*map(F.lit, (2, 4, 6)))))
    lines = lines.withColumn("p", (c("l_linenumber") * 3 + c("padding") + c("l_partkey") % 7) / (c("potential") * 10 + 100.0))
    found = settings_compared(lines, ["padding", "potential"], "p", "y", ["l_quantity", "l_extendedprice", "l_tax"], 0.15, 0.3)
    return found.select("padding", "potential", F.round("mean_smd", 6).alias("mean_smd"), "n_cand", F.round("recall", 6).alias("recall"), "chosen")
