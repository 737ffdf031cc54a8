"""Suffix sorting and the removal of repeated strings against plain versions, with unlike strings that hash alike."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import substrings, suffixes


def test_products_and_prefix_hashes_are_modular():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**61 - 1, 500, dtype=np.uint64) for _ in range(2))
    assert suffixes.times(a, b).tolist() == [x * y % (2**61 - 1) for x, y in zip(a.tolist(), b.tolist())]
    data = rng.integers(0, 256, 70_000).astype(np.uint8)
    hashes = suffixes.PrefixHashes(data)
    start = rng.integers(0, 69_000, 200)
    end = start + rng.integers(1, 900, 200)
    base = suffixes.BASES[0]
    want = [sum((int(x) + 1) * pow(base, k, 2**61 - 1) for k, x in enumerate(data[s:e])) % (2**61 - 1) for s, e in zip(start, end)]
    assert hashes.of(start, end).tolist() == want


def test_suffixes_are_sorted():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    at = np.arange(2900)
    order, _ = suffixes.sort(data, suffixes.PrefixHashes(data), at, at % 3, 40)
    assert [(int(i) % 3, data[i : i + 40].tobytes()) for i in order] == sorted((int(i) % 3, data[i : i + 40].tobytes()) for i in at)


def ranges_at_random(rng, count):
    length = int(rng.integers(20, 60))
    bases = [rng.integers(97, 97 + int(rng.integers(1, 4)), 120).astype(np.uint8) for _ in range(3)]
    rows, far, near, group = [], [], [], []
    for _ in range(count):
        b = bases[rng.integers(0, 3)].copy()
        if rng.random() < 0.6:
            b[rng.integers(0, 120)] = rng.integers(97, 100)
        low = int(rng.integers(0, 8))
        high = low + int(rng.integers(0, 8))
        rows.append(b[30 - high : 30 - low + length])
        far.append(high)
        near.append(low)
        group.append(int(rng.integers(0, 2)))
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return np.concatenate(rows), bounds, *map(np.array, (far, near, group)), length


@pytest.mark.parametrize("weak", [False, True])
def test_repeated_strings_of_ranges(monkeypatch, weak):
    if weak:  # sums of bytes: any strings of the same letters hash alike
        monkeypatch.setattr(suffixes, "BASES", (1,))
        monkeypatch.setattr(suffixes, "_POWERS", {})
    rng = np.random.default_rng(3)
    for _ in range(40):
        data, bounds, far, near, group, length = ranges_at_random(rng, int(rng.integers(1, 12)))
        row, back, _, found = suffixes.repeated(data, bounds, far, near, far, group, length)
        keys = [(group[r], d, data[bounds[r] + far[r] - d :][:length].tobytes()) for r, d in zip(row, back)]
        seen = Counter(keys)
        assert found.tolist() == [seen[k] > 1 for k in keys]


def plain(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        spans = substrings.spans_of([k for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1], length)
        gone = bytearray(len(b))
        for low, high in spans:
            gone[low:high] = b"\1" * (high - low)
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), len(b) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, length):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((tuple(r) for r in substrings.remove_repeats(df, length=length).collect()), key=repr)


def test_groups_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "TOGETHER", 4)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = word(130)
    rows = [(i, word(60) + passage[: 100 + i % 30] + word(70)) for i in range(40)] + [(99, None), (None, passage), (100, "x" * 300), (101, "x" * 300)]
    assert found(spark, rows, 80) == plain(rows, 80)


def test_strings_alike_under_any_polynomial_modulo_a_power_of_two(spark):
    t = np.array([1])
    for i in range(1, 7):
        factor = np.zeros(2**i + 1, dtype=int)
        factor[0], factor[-1] = 1, -1
        t = np.convolve(t, factor)
    d = np.convolve(t, t)
    rng = np.random.default_rng(5)
    pre, post = ("".join(rng.choice(list("abcdefghijklmnop"), 200)) for _ in range(2))
    rows = [(k, pre + bytes((48 + np.maximum(s * d, 0)).astype(np.uint8)).decode("latin1") + post) for k, s in ((1, 1), (2, -1))]
    assert all(n == 0 for _, _, n, _, _ in found(spark, rows, 400))


def test_shorter_repetitions_of_many_words(spark):
    rng = np.random.default_rng(6)
    said = lambda n, size: " ".join("".join(rng.choice(list("abcdefghijklmnop"), size)) for _ in range(n))
    many, few, long, one = said(13, 5), said(11, 6), said(7, 20), said(12, 6)
    rows = [(k, "\n".join([said(20, 6), *some, said(9, 6)])) for k, some in enumerate([[many], [few], [long, many], [few], [one], [long], [few + said(1, 40), one]])]
    rows += [(90, None), (91, "x" * 300), (92, "xy" + many), (93, many + "xy"), (94, "\u00e9" * 100 + " " + one), (None, rows[0][1][:40])]

    def plain_words(length, words):
        raw = [(i, (t or "").encode()) for i, t in rows]
        seen = Counter(b[k : k + 4 * words] for _, b in raw for k in range(len(b) - 4 * words + 1))
        out = {}
        for i, b in raw:
            spans = substrings.spans_of([k for k in range(len(b) - 4 * words + 1) if seen[b[k : k + 4 * words]] > 1], 4 * words)
            whole = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)]
            spans = [(x, y) for x, y in spans if y - x >= length or sum(x <= w and z <= y for w, z in whole) >= words]
            out[i] = b"".join(b[x:y] for x, y in zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), len(b)]))
        return out

    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in substrings.remove_repeats(df, length=120, words=12, with_text=True).collect()}
    want = plain_words(120, 12)
    assert {i: r["kept_sha256"] for i, r in got.items()} == {i: hashlib.sha256(b).hexdigest() for i, b in want.items()}
    assert many not in got[0]["kept"] and long not in got[2]["kept"] and few in got[1]["kept"] and one not in got[4]["kept"]


def test_whole_words():
    data = b" ab  cd ef\n"
    for low in range(len(data) + 1):
        for high in range(low, len(data) + 1):
            want = sum(low <= m.start() and m.end() <= high for m in re.finditer(rb"[^\x20\x09-\x0d]+", data))
            assert substrings.whole_words(data, low, high) == want
