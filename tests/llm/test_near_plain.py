"""Near-duplicate classes against all pairs of a small corpus with groups, chains, hot bands, ties and odd rows."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tessella.llm import near


def shingles(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def plain_classes(rows, threshold=0.8):
    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    known = sorted({s for x in sets for s in x})
    hashed = [h[0] for h, _ in near.shingles(pa.array([" ".join(s) for s in known], pa.large_string()))]
    feature = dict(zip(known, near.feature(np.array(hashed, dtype=np.uint64)).tolist()))
    number = Counter()
    for t in [t or "" for _, t in rows]:
        number.update(feature[s] for s in shingles(t))
    total = sum(number.values())
    weigh = {s: np.log((total + 2) / (number[feature[s]] + 1)) for s in known}
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    margin = []
    for i in range(len(texts)):
        for j in range(i):
            both = sum(min(sets[i][s], sets[j][s]) * weigh[s] for s in sets[i] if s in sets[j])
            either = sum(max(sets[i][s], sets[j][s]) * weigh[s] for s in sets[i] | sets[j])
            share = both / either if either else 1.0
            margin.append(abs(share - threshold))
            if share >= threshold and (sets[i] or sets[j] or texts[i] == texts[j]):
                parent[find(i)] = find(j)
    return {t: find(i) for i, t in enumerate(texts)}, min(margin)


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    rows = []
    for _ in range(6):  # groups of near copies of one text, some too unlike
        base = [word() for _ in range(150)]
        for _ in range(rng.integers(2, 9)):
            other = list(base)
            for _ in range(rng.integers(0, 6)):
                other[rng.integers(0, 150)] = word()
            rows.append(" ".join(other))
    common = [word() for _ in range(60)]
    rows += [" ".join([word() for _ in range(30)] + common + [word() for _ in range(40)]) for _ in range(60)]
    hot = [word() for _ in range(120)]
    for _ in range(90):  # one large group whose members are mostly alike only with the text in its middle
        other = list(hot)
        for at in rng.integers(0, 120, rng.integers(1, 4)):
            other[at] = word()
        rows.append(" ".join(other))
    rows += [rows[0], rows[3], "", "", "one two", "one two", "ONE two", " ".join(hot)]
    out = [(i * 3, t) for i, t in enumerate(rows)]
    return out + [(None, rows[0]), (7, None)]


def test_classes_equal_all_pairs(spark):
    for seed in (1, 7):
        rows = corpus(seed)
        want, margin = plain_classes(rows)
        got = near.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), with_node=True).collect()
        ids = {(r["doc_id"], bytes(r["node"])): r["class_id"] for r in got}
        labelled = {}
        for i, t in rows:
            labelled.setdefault(want[t or ""], set()).add(ids[(i, hashlib.md5((t or "").encode()).digest())])
        # features are hashed and samples drawn, so pairs right at the threshold may fall to either side
        assert margin > 1e-6
        assert all(len(x) == 1 for x in labelled.values())
        assert len(labelled) == len({r["class_id"] for r in got})
        kept = Counter(r["class_id"] for r in got if r["kept"])
        assert set(kept.values()) == {1} and len(kept) == len(labelled)
