"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Equal lines are found by their hashes (128 bits). Lines are also joined by edit distance: two lines are alike within one edit for
every ``PER_EDIT`` code points of the shorter one, ``EDITS`` at most, so lines under ``PER_EDIT`` only if equal. For a threshold
a line is cut into threshold + 1 even segments; if two lines are within it, one segment of the shorter
one stands unchanged in the longer one, near its own place. Each line's segments are indexed by length and
number, and each line probes the lengths just under its own at the few places that the edits allow. Candidates
whose counts of letters or pairs of letters rule the distance out are dropped in the join; the others are verified on whole lines by
a banded bit-parallel edit distance: one word of 2 * EDITS + 1 bits holds the band's column.

A line is removed if an equal line stands before it (by doc_id and place) or if its first copy lies
within the threshold of another text whose first copy stands before it. One such text is enough, so lines that share a key
are not paired off: in ``ROUNDS`` rounds each is compared with the first line of its key that is still open, and what is found like
it is settled. Lines still open then meet all lines before them that have a key in common.

Defined results: null texts count as empty; lines without a word are never removed; a row's null id stays
null and comes first in order; rows equal in id and text count as one document and are cut alike; texts
whose lines are all removed stay as empty ones; other columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.native import opaque, sketch
from tessella.session import discard, settle

#: Edits at most, code points of the shorter line to each, and rounds of comparing with the first line of a key.
EDITS, PER_EDIT, ROUNDS = 2, 15, 2
#: Letters whose counts are compared before a candidate is verified; each edit changes two counts by one at most.
COUNTED = "enai"
_BLANK = " \t\n\x0b\f\r"


def specs(edits: int) -> Column:
    """What makes the keys of a threshold: for each its number of segments, how much shorter the line is whose segment it is, which segment, and by how
    much that may be shifted. Own segments are marked ``mine``.

    Lines have several times ``edits`` letters, so no place falls before their start.
    """
    out = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            low = max(-i, shorter - (edits - i))
            high = min(i, shorter + (edits - i))
            for shift in range(low, high + 1):
                values = {"parts": edits + 1, "shorter": shorter, "i": i, "shift": shift, "mine": int(shorter == 0 and shift == 0)}
                out.append(F.struct(*[F.lit(v).alias(n) for n, v in values.items()]))
    return F.array(*out)


def with_keys(lines: DataFrame, line: str, chars: str, edits: int, per_edit: int) -> DataFrame:
    """Columns h1 and ``key``: a row for each key of each threshold that a line can have together with another.

    Keys are of a line's own segments (odd), and of those of lines 0 to ``edits`` shorter where they might stand in it (even). The last segments of a line
    are the longer ones. The kinds of keys are rows, so that one short expression makes them all: written out side by side they
    come to a method too large for the JVM to compile.
    """
    length = F.col(chars)
    wanted = F.when(length < per_edit, F.array_except(specs(1), specs(1)))
    for e in range(1, edits):  # a longer line of a pair may have e letters more
        wanted = wanted.when(length < per_edit * (e + 1), specs(e)).when(length < per_edit * (e + 1) + e, F.concat(specs(e), specs(e + 1)))
    # letters of one byte each are cut by their place; any others are counted from the line's start. The hashes are the same
    plain = F.when(F.octet_length(line) == length, F.col(line).cast("binary"))
    rows = lines.withColumn("_raw", opaque(plain)).select("h1", line, chars, "_raw", F.inline(wanted.otherwise(specs(edits))))
    rows = rows.withColumn("_of", opaque(length - F.col("shorter")))
    rows = rows.withColumn("_base", opaque(F.expr("_of div parts").cast("int")))
    rows = rows.withColumn("_past", opaque(F.col("i") - F.col("parts") + F.col("_of") - F.col("_base") * F.col("parts")))
    start = F.col("_base") * F.col("i") + F.greatest(F.lit(0), F.col("_past")) + F.col("shift") + 1
    rows = rows.withColumn("_start", opaque(start)).withColumn("_size", opaque(F.col("_base") + (F.col("_past") >= 0).cast("int")))
    of = lambda x: F.xxhash64((F.col("parts") - 1) * 16 + F.col("i"), "_of", F.substring(x, F.col("_start"), F.col("_size")))
    key = opaque(F.when(F.col("_raw").isNotNull(), of("_raw")).otherwise(of(line)))
    return rows.withColumn("_key", key).select("h1", F.when(F.col("mine") == 1, F.col("_key").bitwiseOR(F.lit(1))).otherwise(F.col("_key").bitwiseAND(F.lit(-2))).alias("key"))


def within(a: Column, b: Column, edits: int, allowed: Column) -> Column:
    """Whether two strings are within ``allowed`` edits, of ``edits`` at most: Hyyro's banded bit-vectors, a column of the band in one word.

    Bit r of the band stands for the row r - edits from the diagonal. The band slides one row down with each
    letter of ``b``; ``vp`` and ``vn`` mark where the column rises and falls, and the score follows the
    diagonal's end of the band.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    top = 1 << (width - 1)
    left, right = F.split(a, ""), F.split(b, "")
    m, n = F.length(a), F.length(b)

    def step(s: Column, j: Column) -> Column:
        letter = F.get(right, j)
        eq = F.lit(0).cast("bigint")
        for r in range(width):
            row = j + (r - edits)
            same = F.coalesce(F.when((row >= 0) & (row < m), F.get(left, row)) == letter, F.lit(False))
            eq = eq + F.when(same, F.lit(1 << r).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["score"].alias("score"), eq.alias("eq"))

    def carried(s: Column) -> Column:
        d0 = ((s["eq"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(s["eq"]).bitwiseOR(s["vn"])
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["score"].alias("score"), d0.bitwiseAND(F.lit(full).cast("bigint")).alias("d0"))

    def moved(s: Column, j: Column) -> Column:
        vp, vn, d0 = s["vp"], s["vn"], s["d0"]
        everything = F.lit(full).cast("bigint")
        hp = vn.bitwiseOR(everything.bitwiseAND(F.bitwise_not(d0.bitwiseOR(vp))))
        hn = d0.bitwiseAND(vp)
        slid = F.shiftright(d0, 1)
        # down the band's last row until it meets the end of ``a``, then along the column to the end of ``b``
        inside = j + edits < m
        down = F.when(d0.bitwiseAND(F.lit(top).cast("bigint")) != 0, 0).otherwise(1)
        bit = F.lit(width - 2).cast("int") - (j + edits - m).cast("int")
        at = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(0), bit))
        along = F.when(hp.bitwiseAND(at) != 0, 1).when(hn.bitwiseAND(at) != 0, -1).otherwise(0)
        return F.struct(
            hn.bitwiseOR(everything.bitwiseAND(F.bitwise_not(slid.bitwiseOR(hp)))).alias("vp"),
            slid.bitwiseAND(hp).alias("vn"),
            (s["score"] + F.when(inside, down).otherwise(along)).alias("score"),
        )

    def advance(s: Column, j: Column) -> Column:
        # each stage's value is bound once, by transform over one element
        first = F.transform(F.array(step(s, j)), carried)
        return F.get(F.transform(first, lambda x: moved(x, j)), F.lit(0))

    # before the first letter the band's rows above the diagonal don't exist: row r holds r - edits
    begin = F.struct(
        F.lit(full - ((1 << edits) - 1)).cast("bigint").alias("vp"), F.lit((1 << edits) - 1).cast("bigint").alias("vn"), F.lit(edits).alias("score")
    )
    final = F.aggregate(F.sequence(F.lit(0), n - 1), begin, advance, lambda s: s["score"])
    # strings that end inside the first band have no such column to begin with
    tiny = F.least(m, n) <= edits
    return (F.abs(m - n) <= allowed) & (F.when(tiny, F.levenshtein(a, b)).otherwise(final) <= allowed)


def common_start(a: Column, b: Column) -> Column:
    """Letters that two strings have in common before they first differ."""
    unlike = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
    return F.when(unlike == 0, F.length(a)).otherwise(unlike - 1).cast("int")


def unlike_middles(pairs: DataFrame) -> DataFrame:
    """Columns la and lb without what they begin and end with alike, which changes no edit distance."""
    for _ in range(2):
        pairs = pairs.withColumn("n", opaque(common_start(F.col("la"), F.col("lb"))))
        pairs = pairs.withColumn("la", F.reverse(F.expr("substring(la, n + 1)"))).withColumn("lb", F.reverse(F.expr("substring(lb, n + 1)")))
    return pairs.drop("n")


def _lines(texts: DataFrame) -> DataFrame:
    """One row per line that has a word, with its place and hashes."""
    parts = texts.select("doc_id", "k1", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return parts.where(F.ltrim("line", F.lit(_BLANK)) != "").select(
        "doc_id", "k1", "place", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    )


def _packed(line: Column) -> Column:
    """The counts of ``COUNTED``, 15 bits each; larger ones count as the greatest, which can only make lines look more alike."""
    out = F.lit(0).cast("bigint")
    for c in COUNTED:
        n = F.least(F.length(line) - F.length(F.replace(line, F.lit(c))), F.lit(32767))
        out = F.shiftleft(out, 15).bitwiseOR(n.cast("bigint"))
    return out


def _apart(a: Column, b: Column) -> Column:
    """By how much the packed counts differ in all; an edit adds two at most."""
    each = [[F.shiftright(x, 15 * i).bitwiseAND(F.lit(32767)) for x in (a, b)] for i in range(len(COUNTED))]
    return sum((F.abs(x - y) for x, y in each), F.lit(0))


def _toggled(lines: DataFrame) -> DataFrame:
    """``lines`` with t0 and t1: 64 bits in which every pair of adjacent letters turns one over. An edit touches four pairs at most."""
    lines = lines.withColumn("_letters", opaque(F.split("line", "")))
    pairs = F.zip_with("_letters", F.slice("_letters", 2, F.greatest(F.lit(1), F.size("_letters"))), lambda x, y: F.xxhash64(x, y))
    lines = lines.withColumn("_pairs", opaque(pairs))

    def bits(shift: int) -> Column:
        one = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, shift).bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate("_pairs", F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(one(h)))

    return lines.withColumn("t0", bits(0)).withColumn("t1", bits(20)).drop("_pairs", "_letters")


def _possible(edits: int) -> Column:
    """Whether a line and another, whose columns begin with o_, may be within ``edits`` by their letters and pairs of letters."""
    near = _apart(F.col("packed"), F.col("o_packed")) <= 2 * edits
    for t in ("t0", "t1"):
        near = near & (F.bit_count(F.col(t).bitwiseXOR(F.col(f"o_{t}"))) <= 4 * edits)
    return near


def _verified(pairs: DataFrame, texts: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """Those of the lines h1, h2 that are alike with the line o1, o2 they are paired with."""
    spark = texts.sparkSession
    left = texts.select("h1", "h2", F.col("line").alias("la"))
    right = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("lb"))
    met = pairs.join(left, ["h1", "h2"]).join(right, ["o1", "o2"])
    met = met.withColumn("allowed", F.least(F.lit(edits), F.floor(F.least(F.length("la"), F.length("lb")) / per_edit)).cast("int"))
    # few rows with much work each: dealt out by number, not by size
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h1", "o1")
    met = unlike_middles(met)
    return met.withColumn("fine", opaque(within(F.col("la"), F.col("lb"), edits, F.col("allowed")))).where("fine").select("h1", "h2").distinct()


def _near(lines: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """Lines (h1, h2) that are alike with one whose first copy stands before theirs."""
    long = lines.withColumn("chars", opaque(F.length("line"))).where(F.col("chars") >= per_edit)
    keyed = settle(with_keys(long, "line", "chars", edits, per_edit), "line-keys", plain=True)
    rows = keyed.select("h1", F.shiftright("key", 1).alias("key"), F.col("key").bitwiseAND(F.lit(1)).alias("mine"))
    # lines that share a key are told from the keys alone
    often = rows.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("mine").alias("indexed"))
    often = settle(often.where("low < high and indexed = 1").select("key"), "line-keys-often")
    may = sketch(often, F.col("key"))
    shared = settle(rows.where(may(F.col("key"))).select("key", "h1").distinct().join(often, "key", "left_semi"), "line-keys-shared")
    discard(keyed, often)
    wanted = settle(shared.select("h1").distinct(), "lines-wanted")
    may = sketch(wanted, F.col("h1"))
    first = F.min(F.struct("doc_id", "k1", "place")).alias("first")
    texts = long.where(may(F.col("h1"))).join(wanted, "h1", "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line"), first)
    texts = settle(_toggled(texts).withColumn("packed", _packed(F.col("line"))), "line-texts")
    known = ["h1", "h2", "first", "packed", "t0", "t1"]
    members = settle(shared.join(texts.select(*known), "h1"), "line-members")
    discard(shared, wanted)
    line, found, heads = ["h1", "h2"], [], []
    left = members
    for _ in range(ROUNDS):
        head = left.groupBy("key").agg(F.min(F.struct("first", *[c for c in known if c != "first"])).alias("x"))
        head = head.select("key", F.col("x.h1").alias("o1"), F.col("x.h2").alias("o2"), *[F.col(f"x.{c}").alias(f"o_{c}") for c in ("packed", "t0", "t1")])
        head = settle(head, "line-heads")
        own = (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2"))
        met = left.join(head, "key").where(~own & _possible(edits))
        alike = settle(_verified(met.select("h1", "h2", "o1", "o2").distinct(), texts, edits, per_edit), "line-near")
        found.append(alike)
        heads.append(head)
        used = head.select("key", F.col("o1").alias("h1"), F.col("o2").alias("h2"))
        after = settle(left.join(used, ["key", *line], "left_anti").join(alike, line, "left_anti"), "line-left")
        if left is not members:
            discard(left)
        left = after
    done = reduce(DataFrame.unionByName, found).distinct()
    used = reduce(DataFrame.unionByName, heads).select("key", F.col("o1").alias("h1"), F.col("o2").alias("h2"))
    open_ = members.join(done, line, "left_anti")
    # a head has met all that stand behind it
    before = members.join(used, ["key", *line], "left_anti").select(
        "key", F.col("h1").alias("o1"), F.col("h2").alias("o2"), *[F.col(c).alias(f"o_{c}") for c in ("first", "packed", "t0", "t1")]
    )
    on = (open_["key"] == before["key"]) & (F.col("o_first") < F.col("first")) & _possible(edits)
    rest = open_.join(before, on).select("h1", "h2", "o1", "o2").distinct()
    rest = settle(_verified(rest, texts, edits, per_edit), "line-near")
    result = settle(done.unionByName(rest), "lines-near")
    discard(members, texts, left, rest, *found, *heads)
    return result


def dedup_lines(
    docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None
) -> DataFrame:
    """Every text without the lines that repeat, exactly or nearly, a line before them; k1 is the hash of the text as it was.

    ``carry``, a column over ``docs``, comes along as ``carried``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = [] if carry is None else [carry.alias("carried")]
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("k1"), text.alias("text"), *more)
    lines = _lines(texts)
    order = F.struct("doc_id", "k1", "place")
    near = _near(lines, edits, per_edit)
    places = settle(lines.select("doc_id", "k1", "place", "h1", "h2"), "line-places")
    often = places.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2", F.lit(False).alias("late"))
    # only lines that have an equal or near one play a part
    marked = often.unionByName(near.withColumn("late", F.lit(True))).groupBy("h1", "h2").agg(F.max("late").alias("late"))
    some = settle(places.join(marked, ["h1", "h2"]), "line-places-some")
    discard(places)
    firsts = settle(some.where(~F.col("late")).groupBy("h1", "h2").agg(F.min(order).alias("first")), "line-firsts")
    later = some.where(~F.col("late")).join(firsts, ["h1", "h2"]).where(~order.eqNullSafe(F.col("first")))
    gone = some.where("late").select("doc_id", "k1", "place").unionByName(later.select("doc_id", "k1", "place"))
    by_doc = gone.groupBy(F.col("doc_id").alias("g_id"), F.col("k1").alias("g1")).agg(F.collect_set("place").alias("gone"))
    joined = texts.join(by_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("k1") == F.col("g1")), "left")
    kept = [] if carry is None else ["carried"]
    parts = joined.select("doc_id", "k1", "text", *kept, F.split("text", "\n").alias("parts"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone"), lambda i: F.get(F.col("parts"), i))
    return parts.select(
        "doc_id",
        F.size("parts").cast("bigint").alias("n_lines"),
        F.size("gone").cast("bigint").alias("n_removed"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
        "k1",
        *kept,
    )
