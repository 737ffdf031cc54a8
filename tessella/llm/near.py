"""MinHash near-deduplication with improved consistent weighted sampling over TF-IDF shingles.

A text is its shingles of five words (lower case), each weighed by its count times the inverse
frequency of its feature: shingles are hashed into ``FEATURES`` features, whose counts cover all
documents and are one small array however large the corpus is. Consistent weighted samples are banded;
texts that share a band are candidates; candidates are verified by exact weighted Jaccard similarity
on whole texts. Classes are the connected components of the verified links.

A band that many texts share is not paired off. Every member is first compared with one leader of its band, the member that shares
most with others (the one whose bands are largest), and what is linked so counts as one from then on. In a group of near
copies that is most of it. Members of a band that are still in unlike classes are paired: in bands of up to ``FEW`` members
at once; in larger ones where a bound on their similarity allows it. The bound is exact: shingles that no other text of any large band
holds can't be common to two of them, so of two texts of weight v and w, with shared weights r and s, the similarity is at
most min(r, s) / (v + w - min(r, s)). No pair is given up but those, and those inside one class, which could add nothing.

Each text carries one byte of each of its samples. Of candidates, those in which under half of these agree aren't read
any further: a pair at 0.8 looks like that with a probability of 2e-8.

A feature's weight is the log of all features' counts over its own, which is the inverse document frequency
log(N / n) plus the log of the mean number of shingles of a text. The share of a feature doesn't change as the corpus grows,
so weights are the same at every size: a shingle that a third of all texts hold weighs about half as much as a rare one.

Defined results: equal texts are one class, empty and null ones among them; texts of under five words are
one shingle of all their words; a row's null id stays null and is not a class id unless the class has no other; rows equal in id
and text are in one class and kept alike; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.groups import bring_back
from tessella.llm.native import sketch
from tessella.llm.words import coded, mixed, slices, texts
from tessella.session import discard, settle, ship

WORDS = 5
FEATURES = 1 << 17
SAMPLES, BANDS = 64, 16
#: Guests that a host's text is read for at a time, on average.
GUESTS = 500
#: Leaders that the members of a large band are compared with, one after the other.
LEADERS = 3
#: Members of a band up to which those that its leader hasn't linked are paired without a bound.
FEW = 32
_GRAIN = 16
_SAMPLER: list = []


def shingles(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles (64-bit, ascending) of each text, and how often each occurs."""
    parts = pc.utf8_split_whitespace(pc.utf8_lower(texts(column)))
    bounds = np.asarray(parts.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]
    index, words = coded(parts.flatten())
    spelled = words.to_pylist()
    each = pd.util.hash_array(np.array(spelled, dtype=object), categorize=False) if spelled else np.zeros(0, np.uint64)
    real = np.fromiter((bool(w) for w in spelled), dtype=bool, count=len(spelled))
    full = real[index]
    bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
    hashed = each[index][full]
    factors = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(hashed) - WORDS + 1)
    windows = np.zeros(n, dtype=np.uint64)
    for j in range(WORDS):
        windows += hashed[j : j + n] * factors[j]
    windows = mixed(windows)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= WORDS:
            yield np.unique(windows[low : high - WORDS + 1], return_counts=True)
        elif high > low:
            yield mixed((hashed[low:high] * factors[: high - low]).sum(keepdims=True)), np.ones(1, dtype=np.int64)
        else:
            yield np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)


def feature(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def sampler() -> tuple:
    """Tables of the samples' random numbers: Gamma(2, 1) for r and c, uniform for beta; and a factor for each sample."""
    if not _SAMPLER:
        u = np.random.Generator(np.random.PCG64(20)).random((5, 1 << _GRAIN))
        u = np.maximum(u, 1e-12)
        r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
        factor = mixed(np.arange(1000, 1000 + SAMPLES, dtype=np.uint64)) | np.uint64(1)
        _SAMPLER.extend([r.astype(np.float32), np.log(c).astype(np.float32), u[4].astype(np.float32), factor])
    return tuple(_SAMPLER)


def signature(shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bands of a weighted set, a hash for each of SAMPLES / BANDS consistent samples, and a byte of each sample, eight to a number."""
    r_table, c_table, b_table, factor = sampler()
    least = np.full(SAMPLES, np.inf, dtype=np.float32)
    who = np.zeros(SAMPLES, dtype=np.uint64)
    level = np.zeros(SAMPLES, dtype=np.float32)
    log_weight = np.log(weight).astype(np.float32)
    columns = np.arange(SAMPLES)
    for at in range(0, len(shingle), 2048):
        s = shingle[at : at + 2048]
        cell = ((s[:, None] * factor) >> np.uint64(64 - _GRAIN)).astype(np.int32)
        r, beta = r_table[cell], b_table[cell]
        t = np.floor(log_weight[at : at + 2048, None] / r + beta)
        a = c_table[cell] - r * (t - beta + np.float32(1))
        best = a.argmin(axis=0)
        value = a[best, columns]
        better = value < least
        least = np.where(better, value, least)
        who = np.where(better, s[best], who)
        level = np.where(better, t[best, columns], level)
    sample = mixed(who + mixed(level.astype(np.int64).astype(np.uint64) + factor))
    rows = sample.reshape(BANDS, -1)
    bands = mixed((rows * (mixed(np.arange(7, 7 + rows.shape[1], dtype=np.uint64)) | np.uint64(1))).sum(axis=1))
    return bands.view(np.int64), sample.astype(np.uint8).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total > 0 else 0.0


def frequencies(docs: DataFrame) -> np.ndarray:
    """Weight of each feature: log of all features' counts over its own. FEATURES numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm import near as own

        counts = np.zeros(own.FEATURES, dtype=np.int64)
        for batch in own.slices(batches, "text"):
            found = [s for s, _ in own.shingles(batch.column("text"))]
            counts += np.bincount(own.feature(np.concatenate(found)), minlength=own.FEATURES)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["f", "n"])

    counts = docs.select("text").mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    own = np.zeros(FEATURES)
    own[counts["f"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=float)
    return np.log((own.sum() + 2.0) / (own + 1.0)).astype(np.float32)


def _signatures(docs: DataFrame, weights) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm import near as own

        rarity = weights.value
        for batch in own.slices(batches, "text"):
            bands, marks = [], []
            for shingle, count in own.shingles(batch.column("text")):
                b, m = own.signature(shingle, count * rarity[own.feature(shingle)]) if len(shingle) else ((), ())
                bands.append(list(b))
                marks.append(list(m))
            columns = [pa.array(x, pa.list_(pa.int64())) for x in (bands, marks)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), *columns], ["doc_id", "node", "bands", "marks"])

    return docs.mapInArrow(run, "doc_id bigint, node binary, bands array<bigint>, marks array<bigint>")


def alike(marks: Column, others: Column) -> Column:
    """Whether half of the samples' bytes agree, or more."""
    unlike = F.lit(0)
    for i in range(SAMPLES // 8):
        x = F.get(marks, i).bitwiseXOR(F.get(others, i))
        for bits in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, bits))
        unlike = unlike + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return unlike <= SAMPLES // 2


def _verified(pairs: DataFrame, held: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as ``threshold`` or more.

    In each pair b is the host. A task reads a host's text and behind it those of up to some ``GUESTS`` guests, one after the other, so a
    leader's text is neither copied for each of its members nor are a hot leader's members read by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm import near as own

        rarity, host = weights.value, (np.zeros(0, np.uint64), np.zeros(0))
        for batch in own.slices(batches, "text"):
            fine = []
            for guest, (s, n) in zip(batch.column("a"), own.shingles(batch.column("text"))):
                weighted = s, (n * rarity[own.feature(s)]).astype(np.float64)
                if not guest.is_valid:
                    host = weighted
                fine.append(guest.is_valid and own.similarity(weighted, host) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    hosts = settle(pairs.groupBy("b").agg(F.count("*").alias("guests")), "hosts")
    total = hosts.agg(F.coalesce(F.sum("guests"), F.lit(0))).first()[0]
    dealt = bring_back(pairs, hosts, "b", "guests", total).withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("guests") / GUESTS)))
    dealt = settle(dealt.select("a", "b", "part"), "pairs-dealt")
    texts_of = lambda name: held.select(F.col("node").alias(name), "text")
    first = dealt.select("b", "part").distinct().join(texts_of("b"), "b").select("b", "part", F.lit(None).cast("binary").alias("a"), "text")
    rows = first.unionByName(dealt.join(texts_of("a"), "a").select("b", "part", "a", "text"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return ordered.select("a", "b", "text").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node it is connected with. Each round halves the labels' chains."""
    both = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        jumped = hooked.join(labels.select(F.col("node").alias("low"), F.col("label").alias("next")), "low", "left")
        after = settle(jumped.select("node", "label", F.least("low", F.coalesce("next", "low")).alias("new")), "labels")
        changed = after.where("new <> label").limit(1).count()
        discard(labels)
        labels = after.select("node", F.col("new").alias("label"))
        labels.settled_at = after.settled_at
        if not changed:
            discard(both)
            return labels


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the bands in which classes are still apart, with their labels and the band's size."""
    now = members.withColumn("label", F.col("node"))
    if labels is not None:
        now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        apart = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
        now = now.join(apart, "band", "left_semi")
    return now


def _led(members: DataFrame) -> DataFrame:
    """Pairs of each member and the leader of its band (b) that are in different classes."""
    shares = members.groupBy("node").agg(F.sum("n").alias("share"))
    most = F.max(F.struct("share", "node", "marks", "label")).alias("x")
    leaders = members.join(shares, "node").groupBy("band").agg(most).select("band", F.col("x.node").alias("b"), F.col("x.marks").alias("others"), F.col("x.label").alias("o_label"))
    led = members.join(leaders, (members["band"] == leaders["band"]) & (F.col("label") != F.col("o_label")) & alike(F.col("marks"), F.col("others")))
    return led.select(F.col("node").alias("a"), "b")


def _paired(now: DataFrame, more: Column | None = None) -> DataFrame:
    """All pairs of a band's members that are in different classes and for which ``more`` holds."""
    other = now.select(*[F.col(n).alias(f"o_{n}") for n in now.columns])
    on = (F.col("band") == F.col("o_band")) & (F.col("label") < F.col("o_label")) & alike(F.col("marks"), F.col("o_marks"))
    met = now.join(other, on if more is None else on & more)
    return met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"))


def _shared_weights(held: DataFrame, weights, threshold: float) -> DataFrame:
    """Of these texts, those that can be like another of them: their weight and that of the shingles they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm import near as own

        rarity = weights.value
        for batch in own.slices(batches, "text", 1 << 20):
            found = list(own.shingles(batch.column("text")))
            sizes = [len(s) for s, _ in found]
            shingle = np.concatenate([s for s, _ in found]) if found else np.zeros(0, np.uint64)
            count = np.concatenate([n for _, n in found]) if found else np.zeros(0, np.int64)
            node = batch.column("node").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays(
                [node, pa.array(shingle.view(np.int64)), pa.array((count * rarity[own.feature(shingle)]).astype(np.float64))], ["node", "shingle", "w"]
            )

    parts = settle(held.mapInArrow(run, "node binary, shingle bigint, w double"), "shingles")
    alone = parts.groupBy("shingle").agg(F.count("*").alias("n"), F.first("node").alias("node"), F.first("w").alias("w")).where("n = 1")
    alone = alone.groupBy("node").agg(F.sum("w").alias("alone"))
    whole = parts.groupBy("node").agg(F.sum("w").alias("weight")).join(alone, "node", "left")
    whole = whole.select("node", "weight", (F.col("weight") - F.coalesce("alone", F.lit(0.0))).alias("common"))
    # sums may round differently
    alive = settle(whole.where(F.col("common") >= (threshold - 1e-6) * F.col("weight")), "alive")
    discard(parts)
    return alive


def classes(
    docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", with_node: bool = False
) -> DataFrame:
    """Every document with its class: the class's least doc_id and size, and whether the document stays for it."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    all_ = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    weights = spark.sparkContext.broadcast(frequencies(all_))
    signed = settle(_signatures(all_, weights), "signatures")
    nodes = settle(signed.groupBy("node").agg(F.first("bands").alias("bands"), F.first("marks").alias("marks")), "nodes")
    keyed = lambda *more: nodes.select("node", *more, F.posexplode("bands").alias("i", "h")).withColumn("band", F.xxhash64("i", "h"))
    shared = settle(keyed().groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands-shared")
    may = sketch(shared, F.col("band"))
    members = settle(keyed("marks").where(may(F.col("band"))).join(shared, "band").select("band", "node", "marks", "n"), "members")
    discard(shared)
    wanted = members.select("node").distinct()
    may = sketch(wanted, F.xxhash64("node"))
    held = all_.where(may(F.xxhash64("node"))).join(wanted, "node", "left_semi").select("node", "text").dropDuplicates(["node"])
    held = settle(held, "candidates")
    links: list[DataFrame] = []
    labels = None

    def link(pairs: DataFrame) -> None:
        nonlocal labels
        # a pair that was made both ways round stays one way
        one = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("b").alias("b"))
        one = one.select(F.when(F.col("b") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("a"), "b")
        found = settle(_verified(settled := settle(one, "pairs"), held, weights, threshold), "verified")
        discard(settled)
        links.append(found)
        if found.limit(1).count():
            if labels is not None:
                discard(labels)
            labels = components(reduce(DataFrame.unionByName, links))

    link(_led(members.withColumn("label", F.col("node"))))
    now = settle(_open(members, labels), "now")
    discard(members)
    for _ in range(LEADERS - 1):
        # those of a large band that are in no class with its leaders get another one from among themselves
        large = now.where(F.col("n") > FEW)
        if not large.limit(1).count():
            break
        sizes = large.groupBy("band", "label").agg(F.count("*").alias("m"))
        led = sizes.groupBy("band").agg(F.max(F.struct("m", "label")).alias("x")).select("band", F.col("x.label").alias("most"))
        rest = large.join(led, "band").where(F.col("label") != F.col("most")).drop("most")
        link(_led(rest))
        before, now = now, settle(_open(now.drop("label"), labels), "now")
        discard(before)
    large = now.where(F.col("n") > FEW)
    alive = _shared_weights(held.join(large.select("node").distinct(), "node", "left_semi"), weights, threshold)
    common = F.least("common", "o_common")
    possible = common >= (threshold - 1e-6) * (F.col("weight") + F.col("o_weight") - common)
    # a pair is made in the first of its common bands alone
    own = nodes.select("node", F.transform("bands", lambda h, i: F.xxhash64(i.cast("int"), h)).alias("all"))
    first = F.coalesce(*[F.when(F.get("all", F.lit(i)) == F.get("o_all", F.lit(i)), F.get("all", F.lit(i))) for i in range(BANDS)])
    large = large.join(alive, "node").join(own, "node")
    link(_paired(now.where(F.col("n") <= FEW)).unionByName(_paired(large, possible & (first == F.col("band")))))
    discard(now, nodes, alive)
    discard(held, *links)
    placed = signed.select("doc_id", "node")
    if labels is not None:
        placed = placed.join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))
    else:
        placed = placed.withColumn("label", F.col("node"))
    heads = placed.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct("doc_id", "node")).alias("x"),
                                        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "node"))).alias("y"))
    heads = heads.select("label", "class_id", "class_size", F.coalesce("y", "x").alias("head"))
    out = placed.join(heads, "label").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("node") == F.col("head.node"))
    )
    return out.select("doc_id", "class_id", "class_size", "kept", *(["node"] if with_node else []))
