"""Queries on rows in order: events by event_id stand for an enumeration."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import sequence
from tessella.plans.registry import query

c = F.col
_E = "with e as (select event_id as id, event_id // 40 as page, case when event_id % 3 = 0 then event_type end as street, case when event_id % 11 = 0 then null else (event_id * 5) % 17 end as num, user_id % 2 as own from events) "


def _rows(t):
    num = F.when(c("event_id") % 11 != 0, (c("event_id") * 5) % 17)
    return t.events.select(c("event_id").alias("id"), F.expr("event_id div 40").alias("page"), F.when(c("event_id") % 3 == 0, c("event_type")).alias("street"), num.alias("num"), (c("user_id") % 2).alias("own"))


@query(_E + """, l as (select *, coalesce(abs(num - lag(num) over w) > 6 or num is null or lag(num) over w is null, true) as cut from e window w as (partition by page order by id)),
 s as (select *, sum(cut::int) over (partition by page order by id) as seg, row_number() over (partition by page order by id) as r from l),
 k as (select a.id, a.street, b.street as v, row_number() over (partition by a.id order by abs(a.r - b.r), b.r) as n from s a join s b on a.page = b.page and a.seg = b.seg and b.street is not null)
 select s.id, k.v as filled from s left join k on k.id = s.id and k.n = 1""")
def gap_fill_nearest(t):
    return sequence.fill_nearest(_rows(t), "street", "num", ["page"], "id", 6).select("id", "filled")


@query(_E + """, s as (select *, sum(case when abs(num - lag_num) <= 6 then 0 else 1 end) over (partition by page order by id) as seg from (select *, lag(num) over (partition by page order by id) as lag_num from e))
 select id, last_value(street ignore nulls) over (partition by page, seg order by id rows between 31 preceding and current row) as carried from s""")
def propagate_match(t):
    rows = _rows(t).withColumn("before", F.lag("num").over(Window.partitionBy("page").orderBy("id")))
    similar = F.coalesce(F.abs(c("num") - c("before")) <= 6, F.lit(False))
    return sequence.propagate(rows, "street", similar, ["page"], "id").select("id", "carried")


@query(_E + "select id, p as filled from (select id, street, lag(street) over w as p, lead(street) over w as n from (select id, page, case when id % 3 = 0 then id // 12 end as street from e) window w as (partition by page order by id)) where street is null and p = n".replace("id % 3 = 0", "id % 2 = 0"))
def sandwich_fill(t):
    rows = _rows(t).withColumn("street", F.when(c("id") % 2 == 0, F.expr("id div 12")))
    return sequence.sandwich(rows, "street", ["page"], "id").select("id", "filled")


@query(_E + """, t as (select *, case when id % 13 <> 0 then id // 6 end as road from e), a as (select *, coalesce(road = lag(road) over w, false) as same, lag(num) over w as before from t window w as (partition by page order by id)),
 b as (select *, case when num is null and own is distinct from 1 and same then before else num end as x from a)
 select id, case when x is null and own = 1 and same then lag(x) over (partition by page order by id) + 2 else x end as number from b""")
def lag_fill_conditional(t):
    rows = _rows(t).withColumn("road", F.when(c("id") % 13 != 0, F.expr("id div 6")))
    return sequence.fill_numbers(rows, "num", "road", c("own") == 1, ["page"], "id").select("id", c("filled").alias("number"))


@query("select user_id, event_id, round(case when n >= 10 then m end + 0.00000001, 6) as mean from (select user_id, event_id, avg(value) over w as m, count(value) over w as n from events window w as (partition by user_id % 5 order by event_id rows between 25 preceding and 24 following))")
def rolling_mean_centered(t):
    rows = t.events.select("user_id", "event_id", "value", (c("user_id") % 5).alias("g"))
    means = sequence.centred_mean(rows, "value", ["g"], ["event_id"], least=50, part=1 << 60)
    return means.select("user_id", "event_id", F.round(c("mean") + 0.00000001, 6).alias("mean"))


@query("""with n as (select event_type, count(*) as n from events group by 1), e as (select events.*, event_id // 3 as tied, greatest(50, n // 20) as width from events join n using (event_type))
 select event_id, round(case when k >= 10 then m end + 0.00000001, 6) as mean from (select event_id, avg(value) over w as m, count(value) over w as k from e window w as (partition by event_type order by tied, event_id desc rows between width // 2 preceding and (width - 1) // 2 following))""")
def rolling_mean_sized(t):
    # the order ties in threes; what tells rows apart runs the other way
    rows = t.events.select("event_id", "event_type", "value", F.expr("event_id div 3").alias("tied"), (-c("event_id")).alias("then"))
    means = sequence.centred_mean(rows, "value", ["event_type"], ["tied", "then"])
    return means.select("event_id", F.round(c("mean") + 0.00000001, 6).alias("mean"))


@query(_E.replace("with e as", "with recursive e as") + """, k as (select id, page, (id * 7) % 101 as a, (id * 13) % 97 as b, row_number() over (partition by page order by id) as n from e),
 r as (select id, page, n, a as chosen from k where n = 1 union all select k.id, k.page, k.n, case when abs(k.a - r.chosen) <= abs(k.b - r.chosen) then k.a else k.b end from r join k on k.page = r.page and k.n = r.n + 1)
 select id, chosen from r""")
def resolve_ties(t):
    """Sequential: a tied coordinate takes the candidate nearer to the row before it, page by page."""
    import pandas as pd

    def resolve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        before, out = None, []
        for a, b in zip(frame["a"], frame["b"]):
            before = a if before is None or abs(a - before) <= abs(b - before) else b
            out.append(before)
        return pd.DataFrame({"id": frame["id"], "chosen": out})

    rows = _rows(t).select("id", "page", ((c("id") * 7) % 101).alias("a"), ((c("id") * 13) % 97).alias("b"))
    return rows.groupBy("page").applyInPandas(resolve, "id bigint, chosen bigint")
