"""Each operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, byte_tokens, licenses, lines, near, packing, quality, sentences, substrings, token_counts, topk
from tessella.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, k1 bigint, node string, a int, n int, words string, place int, h1 int"
PASSAGE = " ".join(f"Word{i} goes on and here it ends{'.' if i % 3 == 0 else ''}" for i in range(40))


def plain_docs():
    base = " ".join(f"token{i * i % 97} again" for i in range(120))
    texts = [
        None, "", " ", "\n\n", "one", base, base, base.replace("token4 ", "tokenX "), "pre " + PASSAGE + " post", "other " + PASSAGE,
        "ab" * 1500, "the same line stands here with many words\n" * 5 + "the sane line stands here with many words",
        "Licensed under the Apache License, Version 2.0.\nMIT License; cc-by GNU  General Public LICENSE", "x" * 20_000,
        "é ü <|endoftext|> ΑΣ don't  tab\tend \n", "a   b  \n  c  ",
    ]
    return [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(5, base)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, "n", 2, 3, "w", 4, 5) for i, t in plain_docs()]
    return spark.createDataFrame(rows, SCHEMA)


def collected(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for f in (
        lambda d: packing.pack(d, tokenizer_path("byte_bpe_50k.json")),
        lambda d: token_counts.count_tokens(d, tokenizer_path("piece_bpe_32k.model")),
        lambda d: quality.assess(d, [0.0] * quality.BUCKETS),
        lambda d: bpe.round_trip(d, tokenizer_path("word_bpe_49k.json")),
        licenses.scan, sentences.remove_repeated_sentences, lines.dedup_lines, substrings.remove_repeats, near.classes,
    ):
        assert f(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(vectors, "vec_id % 50 = 0").count() == 0


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 5)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(60)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [0.0] * 8), (None, [1.0] * 8)]
    got = defaultdict(list)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1)).withColumn("bound", F.lit(1))
    for r in topk.top_k(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows if i is not None and v and None not in v and not np.isnan(v).any()}
    for q in (i for i in fine if i % 50 == 0):
        want = sorted(((-int(fine[q] @ v), i) for i, v in fine.items() if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in want]


def test_packing(docs):
    out = [r.asDict() for r in packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=256).collect()]
    coder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in plain_docs():
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        begin, end, k = 0, len(ids) % 256 or 256, 0
        while begin < len(ids):
            want[(i, k, begin, end - begin, zlib.crc32(ids[begin:end].tobytes()))] += 1
            begin, end, k = end, end + 256, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    used = defaultdict(list)
    for r in out:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256


@pytest.mark.parametrize("seed", range(3))
def test_plans_hold_every_length_once(seed):
    counts = np.random.default_rng(seed).integers(0, 40, 101)
    counts[0] = 0
    chosen = packing.plan(counts, 100, rounds=30)
    held = np.zeros(101, dtype=int)
    for times, config in chosen:
        assert sum(s * n for s, n in config.items()) <= 100
        for s, n in config.items():
            held[s] += times * n
    assert (held == counts).all()
    assert sum(t for t, _ in chosen) <= sum(t for t, _ in packing.best_fit(counts, 100))
    least = max(-(-(counts * np.arange(101)).sum() // 100), counts[51:].sum())
    assert sum(t for t, _ in chosen) <= 1.03 * least


def test_most_sequences_are_the_linear_programs():
    counts = np.random.default_rng(7).integers(20, 60, 257)
    counts[0] = 0
    chosen, of_program, gap = packing.planned(counts, 256)
    held = np.zeros(257, dtype=int)
    for times, config in chosen:
        assert sum(s * n for s, n in config.items()) <= 256
        for s, n in config.items():
            held[s] += times * n
    assert (held == counts).all() and gap <= 0.05
    short = sum(t for t, _ in chosen) - counts[256]
    assert of_program >= 0.7 * short
    assert sum(t for t, _ in chosen) <= 1.03 * max(-(-(counts * np.arange(257)).sum() // 256), counts[129:].sum())


def test_bpe(docs):
    coder = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t in plain_docs():
        ids = coder.encode(t or "", add_special_tokens=False).ids
        spelled = coder.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), spelled))))
    assert collected(bpe.round_trip(docs, tokenizer_path("word_bpe_49k.json"))) == sorted(want, key=repr)


def test_token_counts(docs):
    counter = token_counts.opened(tokenizer_path("piece_bpe_32k.model"))

    def tokens(word):
        score, count = [0.0], [0]
        counter._extend(token_counts.BLANK + word, score, count, 0)
        return count[-1]

    want = [(i, len(w), sum(map(tokens, w))) for i, t in plain_docs() for w in [(t or "").split()]]
    assert collected(token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model"))) == sorted(want, key=repr)


def test_quality(docs):
    want = []
    for i, t in plain_docs():
        words = regex.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, covered = Counter(zip(words, words[1:], words[2:])), set()
        for k in range(len(words) - 2):
            if seen[tuple(words[k : k + 3])] > 1:
                covered |= {k, k + 1, k + 2}
        full = [x for x in (t or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(full) - len(set(full)), len(covered), failed, not failed))
    assert collected(quality.assess(docs, [0.0] * quality.BUCKETS).drop("llr")) == sorted(want, key=repr)


def test_quality_tells_junk_from_trusted(spark):
    good = " ".join(f"word{i % 61} and" for i in range(80))
    junk = " ".join(f"JUNK{i * 7 % 83}!!" for i in range(80))
    docs = spark.createDataFrame([(i, f"{good} g{i}" if i % 2 else f"{junk} j{i}") for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 30, 2)], "doc_id bigint, quality int, toxic int")
    scores = {r["doc_id"]: r["llr"] for r in quality.assess(docs, quality.fit(docs, labels)).collect()}
    assert min(v for i, v in scores.items() if i % 2) > max(v for i, v in scores.items() if not i % 2)


def test_licenses(docs):
    got = {r["n_words"]: r for r in licenses.scan(docs).where("doc_id = 12").collect()}
    (row,) = got.values()
    assert (row["n_base"], row["base_labels"], row["first_word"]) == (4, "apache,cc-by,gpl,mit", 3)
    assert row["score"] == 1.0


def test_licenses_find_every_notice_of_a_file(spark):
    filler = " any can code copy form free source following conditions published all work " * 20
    text = filler.join(t for _, _, t in licenses.TEMPLATES)
    rows = [(0, text)] + [(i, t) for i, (_, _, t) in enumerate(licenses.TEMPLATES, 1)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0]["labels"] == ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    assert got[0]["score"] == 1.0
    assert all(label in got[i]["labels"].split(",") for i, (label, _, _) in enumerate(licenses.TEMPLATES, 1))


def test_sentences(docs):
    got = {r["doc_id"]: r for r in sentences.remove_repeated_sentences(docs).collect()}
    assert "".join(sentences.sentences(PASSAGE)) == PASSAGE
    assert got[8]["n_removed"] == 0 and got[8]["text"] == "pre " + PASSAGE + " post"
    assert got[9]["n_removed"] >= got[9]["n_sentences"] - 2
    assert got[1]["n_sentences"] == 0
    # one sentence, and one that is too short for a run
    assert got[6]["text"] == dict(plain_docs())[6] and got[6]["n_sentences"] == 1


def said(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n)) + ". "


def test_sentences_cover_the_ends_of_texts_and_passages(spark):
    text = said("a", 25) + said("b", 5)
    passage = said("p", 12) + said("q", 12) + said("r", 3)
    rows = [
        (1, text), (2, text), (3, said("c", 30) + passage + said("d", 30)), (4, said("e", 30) + passage + said("f", 30)),
        (5, "\n\nshort. text"), (6, "\n\nshort. text"), (7, "\n\n" + said("g", 25) + said("h", 1)), (8, "\n\n" + said("g", 25) + said("h", 1)),
        (9, said("i", 30)), (10, said("i", 30)),
    ]
    got = {r["doc_id"]: r["text"] for r in sentences.remove_repeated_sentences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = dict(rows) | {2: "", 4: said("e", 30) + said("f", 30), 8: ""}
    assert got == want


def test_runs_are_the_shortest_from_and_to_every_sentence():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = rng.integers(1, 15, rng.integers(1, 9)).tolist()
        k, want = len(sizes), set()
        for a in range(k):
            for b in range(a + 2, k + 1):
                if sum(sizes[a:b]) >= 20 and (b - a == 2 or sum(sizes[a : b - 1]) < 20 or sum(sizes[a + 1 : b]) < 20):
                    want.add((a, b))
        assert {(a, b) for a, b, _ in sentences.runs([said("w", n) for n in sizes], 20)} == want


def test_a_sentence_alone_is_no_run(spark):
    shared = said("s", 25)
    rows = [(1, said("a", 30) + shared + said("b", 30)), (2, said("c", 30) + shared + said("d", 30)), (3, said("e", 30) + shared + said("d", 30))]
    got = {r["doc_id"]: r["text"] for r in sentences.remove_repeated_sentences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # the second and third texts share two sentences in a row
    assert got == dict(rows) | {3: said("e", 30)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark, docs):
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[11]["text"] == "the same line stands here with many words"
    assert got[6]["text"] == "" and got[5]["text"] == got[6]["text"] + plain_docs()[5][1]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        seed = "".join(rng.choice(list("abc d"), 40))
        for _ in range(3):
            other = list(seed)
            for _ in range(rng.integers(0, 4)):
                other[rng.integers(0, len(other))] = rng.choice(list("xyz"))
            if rng.random() < 0.5:
                del other[rng.integers(0, len(other))]
            rows.append((len(rows), "".join(other)))
    out = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        assert out[i] == int(any(edits(t, s) <= 2 for s_id, s in rows[:i])), (i, t)


def test_lines_of_very_many_equal_letters(spark):
    rows = [(1, "e" * 40_000), (2, "e" * 40_000), (3, "e" * 39_999 + "x"), (4, "e" * 40_000 + "some more of other letters")]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_substrings(docs):
    raw = [(i, (t or "").encode()) for i, t in plain_docs()]
    seen = Counter(b[k : k + 400] for _, b in raw for k in range(len(b) - 399))
    want = []
    for i, b in raw:
        spans = substrings.spans_of([k for k in range(len(b) - 399) if seen[b[k : k + 400]] > 1], 400)
        gone = bytearray(len(b))
        for low, high in spans:
            gone[low:high] = b"\1" * (high - low)
        left = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), len(b) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    assert collected(substrings.remove_repeats(docs)) == sorted(want, key=repr)


def test_near(docs):
    got = collected(near.classes(docs).select("doc_id", "class_id", "kept"))
    classes = {i: c for i, c, _ in got if i is not None}
    assert classes[5] == classes[6] == classes[7] == 5
    assert classes[0] == classes[1] == 0 and classes[8] != classes[5]
    assert [k for i, _, k in got if i == 6] == [False]


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 2048


def test_byte_tokens_equal_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    rng = np.random.default_rng(1)
    parts = [" ", " ", "a", "B", "\n", "\t", "é", "1", ",", "'s", "Ġ", "\u3000", "<|endoftext|>"]
    odd = ["", " ", "a  b", " lead", "x\n y", "Ġ Ġx ĠĠ", " \nbar foo"] + ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(500)]
    got = [x.tolist() for x in byte_tokens.ByteTokens(path).encode(pa.array(odd))]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)]
