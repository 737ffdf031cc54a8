"""Street names: normalising, ordinals, entries with hotels and notes, the match in rounds, and ties between geocoded places."""

from pyspark.sql import functions as F

from tessella.operators import geodesy, sequence, streets
from tessella.plans.registry import query
from tessella.plans.spatial import _P, _points

c = F.col

_SUFFIX = "['avenue', 'street', 'road', 'drive', 'place', 'court', 'boulevard']"
_NAMED = f"with n as (select p_partkey, p_name || ' ' || {_SUFFIX}[1 + p_partkey % 7] || case p_partkey % 3 when 0 then ' NW' when 1 then ' (Old''s) [2]' else '-End' end as street from part)"


def _named(t):
    suffix = F.element_at(F.array(*map(F.lit, ("avenue", "street", "road", "drive", "place", "court", "boulevard"))), (c("p_partkey") % 7 + 1).cast("int"))
    tail = F.when(c("p_partkey") % 3 == 0, " NW").when(c("p_partkey") % 3 == 1, " (Old's) [2]").otherwise("-End")
    return t.part.select("p_partkey", F.concat("p_name", F.lit(" "), suffix, tail).alias("street"))


def _sql_chain(words):
    out = "lower(street)"
    for pattern, by in words:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return f"trim({out})"


@query(_NAMED + f" select p_partkey, {_sql_chain(streets.STREET_WORDS)} as street from n")
def street_normalize(t):
    return _named(t).select("p_partkey", streets.replaced(c("street"), streets.STREET_WORDS).alias("street"))


@query(_NAMED + f" select p_partkey, {_sql_chain(streets.RENAMED_WORDS)} as street from n")
def street_changes_normalize(t):
    return _named(t).select("p_partkey", streets.replaced(c("street"), streets.RENAMED_WORDS).alias("street"))


_ENTRY = "with e as (select p_partkey, case p_partkey % 4 when 0 then 'Grand Hotel ' else '' end || p_name || case p_partkey % 3 when 0 then ' (rear, ' || p_size || ')' when 1 then '' else ' )x' end as entry from part)"


@query(_ENTRY + r""" select p_partkey, case when ok then nullif(regexp_extract(entry, f, 1, 'i'), '') end as hotel, case when ok then nullif(regexp_extract(entry, f, 2, 'i'), '') end as street, case when ok then nullif(regexp_extract(entry, f, 3, 'i'), '') end as note
 from (select *, regexp_matches(entry, f, 'i') as ok from (select *, '""" + streets.ENTRY + r"""' as f from e))""")
def street_entry_groups(t):
    tail = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit(" (rear, "), c("p_size").cast("string"), F.lit(")"))).when(c("p_partkey") % 3 == 1, "").otherwise(" )x")
    entry = F.concat(F.when(c("p_partkey") % 4 == 0, "Grand Hotel ").otherwise(""), c("p_name"), tail)
    return t.part.select("p_partkey", *streets.street_parts(entry))


_HOUSE = "case c_custkey % 6 when 0 then c_custkey || ' a' when 1 then c_custkey || '-b' when 2 then 'apt ' || c_custkey when 3 then 'x-' || c_custkey when 4 then null else cast(c_custkey as varchar) end"


@query(f"select c_custkey, case when coalesce(regexp_matches(number, '{streets.NOT_A_NUMBER}'), false) then null else number end as number from (select c_custkey, {_HOUSE} as number from customer)")
def house_number_hotels(t):
    k, number = c("c_custkey").cast("string"), c("c_custkey") % 6
    raw = F.when(number == 0, F.concat(k, F.lit(" a"))).when(number == 1, F.concat(k, F.lit("-b"))).when(number == 2, F.concat(F.lit("apt "), k)).when(number == 3, F.concat(F.lit("x-"), k)).when(number == 5, k)
    return t.customer.select("c_custkey", F.when(~F.coalesce(raw.rlike(streets.NOT_A_NUMBER), F.lit(False)), raw).alias("number"))


_WORDS = "[" + ", ".join(f"'{w}'" for w in streets.ORDINALS) + "]"
_NUMBERS = "[" + ", ".join(f"'{n}{streets.ENDINGS.get(n, 'th')}'" for n in range(1, 21)) + "]"


@query(f"""with w as (select p_partkey, {_WORDS}[1 + p_partkey % 20] as o from part), d as (select p_partkey, left(o, cast(p_partkey // 20 % length(o) as int)) || substr(o, cast(p_partkey // 20 % length(o) as int) + 2) as word from w),
 m as (select word, min(k) as k from (select distinct word from d), range(1, 21) r(k) where jaro_winkler_similarity(word, {_WORDS}[k]) > 0.8 group by 1)
 select p_partkey, coalesce({_NUMBERS}[m.k], d.word) || ' ave' as street from d left join m on d.word = m.word""")
def ordinal_words_fuzzy(t):
    o = F.element_at(F.array(*map(F.lit, streets.ORDINALS)), (c("p_partkey") % 20 + 1).cast("int"))
    cut = (F.floor(c("p_partkey") / 20) % F.length("o")).cast("int")
    word = F.concat(F.expr("left(o, k)"), F.expr("substring(o, k + 2)"))
    typed = t.part.withColumn("o", o).withColumn("k", cut).select("p_partkey", F.concat(word, F.lit(" ave")).alias("street"))
    return streets.with_ordinals(typed, "street").select("p_partkey", "street")


# every third street has letters of its own, and every seventh row no page
_ROWS = """with k as (select p_name as entry, min(p_partkey) as pos from part group by 1),
 r as (select c_custkey as id, n_regionkey as city, case when c_custkey % 7 = 0 then null else c_custkey // 40 end as page, case c_custkey % 5 when 0 then p_name when 1 then p_name || 's' when 2 then substr(p_name, 2) when 3 then null
  else case c_custkey % 3 when 0 then 'zq' || c_custkey % 11 || 'xx' when 1 then left(p_name, 6) else p_name end end as street from customer join nation on c_nationkey = n_nationkey join part on p_partkey = 1 + (c_custkey // 3) % 50) """


@query(_ROWS + """, a as (select r.*, k.entry as known, lag(street) over (partition by city order by id) as prev from r left join k on street = k.entry),
 s as (select *, sum(case when street is not null and prev is not null and jaro_winkler_similarity(street, prev) >= 0.8 then 0 else 1 end) over (partition by city order by id) as seg from a),
 v as (select *, last_value(known ignore nulls) over (partition by city, seg order by id rows between 31 preceding and current row) as carried from s),
 b as (select street as o, entry as best, score from (select street, entry, score, row_number() over (partition by street order by round(score, 12) desc, pos) as n
  from (select street, entry, pos, 1 - damerau_levenshtein(street, entry) / greatest(length(street), length(entry)) as score from (select distinct street from v where carried is null and street is not null), k)) where n = 1)
 select id, case when street is not null then coalesce(known, carried, case when page is not null or round(score, 12) >= 0.6 then best end, street) end as match,
  cast(case when street is null then null when known is not null then 1 when carried is not null then 2 when page is not null then 3 when round(score, 12) >= 0.6 then 4 else 0 end as int) as round from v left join b on street = o""")
def street_resolver(t):
    known = t.part.groupBy(c("p_name").alias("entry")).agg(F.min("p_partkey").alias("pos"))
    names = t.part.select("p_partkey", "p_name")
    city = F.broadcast(t.nation.select("n_nationkey", c("n_regionkey").alias("city")))  # one row per nation
    key = c("c_custkey")
    own = F.when(key % 3 == 0, F.concat(F.lit("zq"), (key % 11).cast("string"), F.lit("xx"))).when(key % 3 == 1, F.expr("left(p_name, 6)")).otherwise(c("p_name"))
    street = F.when(key % 5 == 0, c("p_name")).when(key % 5 == 1, F.concat("p_name", F.lit("s"))).when(key % 5 == 2, F.expr("substr(p_name, 2)")).when(key % 5 == 4, own)
    rows = t.customer.join(city, c("c_nationkey") == c("n_nationkey")).withColumn("p_partkey", 1 + F.expr("c_custkey div 3") % 50).join(names, "p_partkey")
    rows = rows.select(key.alias("id"), "city", F.when(key % 7 != 0, F.expr("c_custkey div 40")).alias("page"), street.alias("street"))
    return streets.resolve(rows, known, ["city"], "id", "page").select("id", "match", "round")


_MATCHES = _P + """, h as (select id, x / 100 as ax, y / 100 as ay, y / 100 as bx, x / 100 as by_, lag(x) over (order by id) / 100 as px, lag(y) over (order by id) / 100 as py from p), g as (select * from h where px is not null)"""
_FIRST = geodesy.geodesic_sql("g", ("px", "py", "ax", "ay"), "d1")


@query(f"""{_MATCHES} select id, case when round(d1, 4) < round(d2, 4) then ax else bx end as x, case when round(d1, 4) < round(d2, 4) then ay else by_ end as y from ({geodesy.geodesic_sql(f"({_FIRST})", ("px", "py", "bx", "by_"), "d2")})""")
def geocoder_tiebreak(t):
    # of two matches of an address the one nearer to the row before it on the ellipsoid; the second if neither is
    now = sequence.row_before(_points(t).select("id", "x", "y"), "id", ["x", "y"]).where("before is not null")
    ax, ay = c("x") / 100, c("y") / 100
    d1, d2 = (F.round(geodesy.geodesic(c("before.x") / 100, c("before.y") / 100, a, b), 4) for a, b in ((ax, ay), (ay, ax)))
    now = now.withColumn("d1", d1).withColumn("d2", d2)
    return now.select("id", F.when(c("d1") < c("d2"), ax).otherwise(ay).alias("nx"), F.when(c("d1") < c("d2"), ay).otherwise(ax).alias("ny")).withColumnsRenamed({"nx": "x", "ny": "y"})
