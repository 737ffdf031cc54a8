"""Every stage of the pipeline against a plain version on what the stage before it kept, with odd rows and clashing columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from tessella.llm import quality
from tessella.llm.queries import tokenizer_path
from tests.llm.test_lines_plain import plain as plain_lines
from tests.llm.test_near_plain import plain_classes
from tests.llm.test_suffixes import plain as plain_suffixes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 bigint, node string, _row int, carried int, _own int, _id int, _node int"


def said(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(n))


def rows():
    rng = np.random.default_rng(8)
    passage = said(rng, 90)
    line = said(rng, 12)
    out = [said(rng, 60) + "\n" + line + "\n" + said(rng, 40) for _ in range(6)]
    out += [said(rng, 50) + " " + passage + " " + said(rng, 50) for _ in range(5)]
    near = said(rng, 200).split()
    for k in range(5):
        other = list(near)
        other[7 * k] = f"changed{k}"
        out.append(" ".join(other))
    out += [said(rng, 55) + "\n" + line[:-1] + "x", said(rng, 20), "a b c " * 40, "x" * 30_000 + " " + said(rng, 80), out[0], "", " \n ", None]
    out += ["  ".join(["JUNK%%", "##", "$$$"] * 5) + said(rng, 60, "QXZ%$#") for _ in range(3)]
    made = [(i * 2, t, "en", None if i % 7 == 0 else "s", None if t is None else len(t), i, "n", 1, 2, 3, 4, 5) for i, t in enumerate(out)]
    return made + [(None, out[1], "en", "s", 1, 5, "n", 1, 2, 3, 4, 5), made[3], made[3]]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(docs before, docs after) of each stage; docs as rows of dicts."""
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("tables")
    labels = [(i, 1, 0) for i in range(0, 20, 2)] + [(r[0], 0, 0) for r in rows()[-6:-3]] + [(2, None, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.createDataFrame(rows(), SCHEMA), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, str(folder)).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "best-fit packing":
            assert after.columns == docs.columns
        out.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()]))
        docs = after
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain_scores(docs, trusted):
    """The mean log ratio of each text, by hashes and logs written out anew."""
    words = lambda t: (t or "").split()
    one = lambda v, seed: xxhash.xxh64_intdigest(v, seed)

    def buckets(t):
        h = [one(w.encode(), 42) for w in words(t)]
        pairs = [one(b.to_bytes(8, "little"), one(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
        return [signed(x) % quality.BUCKETS for x in h + (pairs if len(h) > 1 else [])]

    raw, good = Counter(), Counter()
    for d in docs:
        for b in buckets(d["text"]):
            raw[b] += 1
            good[b] += d["doc_id"] in trusted
    n, m = sum(raw.values()), sum(good.values())
    more = quality.PRIOR * n / m
    weigh = lambda b: np.log((good[b] + quality.PRIOR) / (m + quality.PRIOR * quality.BUCKETS)) - np.log((raw[b] + more) / (n + more * quality.BUCKETS))
    return [np.mean([weigh(b) for b in buckets(d["text"])]) if words(d["text"]) else None for d in docs]


def base_failed(t):
    words = (t or "").split()
    seen, covered = Counter(zip(words, words[1:], words[2:])), set()
    for k in range(len(words) - 2):
        if seen[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    return len(words) < 50 or 100 * len(covered) > 50 * len(words)


def key(d):
    return tuple(sorted((k, repr(v)) for k, v in d.items()))


def test_quality_rules(stages):
    before, after = stages[0]
    scores = plain_scores(before, set(range(0, 20, 2)))
    want = [d for d, s in zip(before, scores) if not base_failed(d["text"]) and s >= quality.THRESHOLD]
    assert all(s is None or abs(s - quality.THRESHOLD) > 1e-4 for s in scores)
    assert Counter(map(key, after)) == Counter(map(key, want)) and 0 < len(after) < len(before)


def test_line_dedup(stages):
    before, after = stages[1]
    new = plain_lines([(d["doc_id"], d["text"]) for d in before])
    want = [d | {"text": new[d["doc_id"]], "n_chars": len(new[d["doc_id"]])} for d in before if new[d["doc_id"]].strip()]
    assert Counter(map(key, after)) == Counter(map(key, want))
    assert any(d["text"] != new[d["doc_id"]] for d in before)


def test_near_dedup(stages):
    before, after = stages[2]
    label, margin = plain_classes([(d["doc_id"], d["text"]) for d in before])
    assert margin > 1e-6
    least = {}
    for d in before:
        least.setdefault(label[d["text"] or ""], []).append(d["doc_id"])
    heads = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    assert sorted((d["doc_id"] for d in after), key=repr) == sorted(heads.values(), key=repr)
    assert all(key(d) in set(map(key, before)) for d in after) and len(after) < len(before)


def test_suffix_dedup(stages):
    before, after = stages[3]
    want = {i: (size - gone, digest) for i, size, gone, _, digest in plain_suffixes([(d["doc_id"], d["text"]) for d in before], 400)}
    for d in after:
        assert hashlib.sha256(d["text"].encode()).hexdigest() == want[d["doc_id"]][1] and d["n_chars"] == len(d["text"])
    gone = {d["doc_id"] for d in before} - {d["doc_id"] for d in after}
    assert all(want[i][0] == 0 for i in gone) and sum(len(d["text"]) for d in after) < sum(len(d["text"]) for d in before)


def test_suffix_dedup_takes_passages_of_over_50_words(spark):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    passage, short = said(rng, 55), said(rng, 40)
    assert 200 <= len(short) and len(passage) < 400
    texts = [said(rng, 60) + f" {p} " + said(rng, 60) for p in (passage, passage, short, short)] + [said(rng, 120)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert passage not in got[0] and passage not in got[1]
    assert all(len(got[i]) > 600 and texts[i].startswith(got[i][:300]) and texts[i].endswith(got[i][-300:]) for i in (0, 1))
    assert all(got[i] == texts[i] for i in (2, 3, 4))


def test_packing(stages):
    before, after = stages[4]
    coder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for d in before:
        ids = np.array([*coder.encode(d["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        begin, end, k = 0, len(ids) % 2048 or 2048, 0
        while begin < len(ids):
            want[(d["doc_id"], k, begin, end - begin, zlib.crc32(ids[begin:end].tobytes()))] += 1
            begin, end, k = end, end + 2048, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == want
    used = {}
    for r in after:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
