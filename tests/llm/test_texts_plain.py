"""Token counts, license scans and sentence spans against plain versions on odd and random texts."""

import math
import re
from collections import Counter

import numpy as np
import sentencepiece

from tessella.llm import licenses, sentences, token_counts
from tessella.llm.queries import tokenizer_path
from tests.llm.test_operators import SCHEMA, plain_docs


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "n", 2, 3, "w", 4, 5) for i, t in rows], SCHEMA)


def random_texts(seed, parts, n, most):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(parts, rng.integers(0, most))) for _ in range(n)]


def test_token_counts(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = -math.log(2 - model.get_score(i))
    floor = min(pieces.values()) - 1

    def tokens(word):
        text = "▁" + word
        best = {0: (0.0, 0)}
        for end in range(1, len(text) + 1):
            size = len(text[end - 1].encode())
            options = [(best[end - 1][0] + size * floor, 0, best[end - 1][1] + size)]
            options += [(best[b][0] + pieces[text[b:end]], end - b, best[b][1] + 1) for b in range(end) if text[b:end] in pieces]
            score, _, count = max(options, key=lambda o: (o[0], o[1]))
            best[end] = score, count
        return best[len(text)][1]

    parts = [" ", " ", "the", "ing", "un", "able", "é", "ß", "日本", "▁", "a", "Q", "7", "\n", "-", "\U0001f600"]
    rows = [(i, t) for i, t in plain_docs() if len(t or "") < 5000] + list(enumerate(random_texts(1, parts, 150, 25), 100))
    want = sorted(((i, len((t or "").split()), sum(map(tokens, re.findall(r"[^ \t\n\x0b\f\r]+", t or "")))) for i, t in rows), key=repr)
    got = sorted((tuple(r) for r in token_counts.count_tokens(made(spark, rows), path).collect()), key=repr)
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want]


def plain_scan(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))) for i, t in rows]
    number = Counter(w for _, words in texts for w in set(words))
    out = []
    for i, words in texts:
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        base, labels, best = sorted({x for _, x in places}), {x for _, x in places}, 0.0
        for label, key, text in licenses.TEMPLATES:
            form, key = text.split(), key.split()
            rarest = sorted(set(form), key=lambda w: (number[w], w))[: licenses.INDEXED]
            key_at = next((k for k in range(len(form)) if form[k : k + len(key)] == key), 0)
            for begin in range(-len(form), len(words)):
                at = lambda k: words[begin + k] if 0 <= begin + k < len(words) else None  # noqa: E731, B023
                if begin + key_at < 0 or words[begin + key_at :][: len(key)] != key:
                    continue
                if len({w for k, w in enumerate(form) if w in rarest and at(k) == w}) >= min(licenses.AGREEING, len(rarest)):
                    labels.add(label)
                    best = max(best, sum(at(k) == w for k, w in enumerate(form)) / len(form))
        starts = [k for k, _ in places]
        out.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(labels)), round(best, 6)))
    return sorted(out, key=repr)


def test_licenses(spark):
    words = sorted({w for _, _, t in licenses.TEMPLATES for w in t.split()})
    notices = [t for _, _, t in licenses.TEMPLATES]
    parts = [f" {w} " for w in words] + [f" {n} " for n in notices * 2] + [f" {k}, " for _, k, _ in licenses.TEMPLATES] + [" MIT License", "İ ", " K", " cc-by ", "\n"]
    rows = [(i, t) for i, t in plain_docs() if len(t or "") < 25_000] + list(enumerate(random_texts(2, parts, 120, 14), 100))
    rows += [(300 + k, " ".join(n.split()[1:])) for k, n in enumerate(notices)] + [(400 + k, "x " + n[: len(n) // 2] + " mit " + n[len(n) // 2 :]) for k, n in enumerate(notices)]
    got = sorted((tuple(r) for r in licenses.scan(made(spark, rows)).collect()), key=repr)
    assert got == plain_scan(rows)


def test_licenses_of_a_text_of_many_hits(spark):
    # every second word is one that all templates are looked up by; a notice stands at the end
    words = sorted({w for _, _, t in licenses.TEMPLATES for w in t.split()})
    text = " ".join(f"{words[k % len(words)]} {'x' * (k % 5 + 1)}" for k in range(50_000)) + " " + licenses.TEMPLATES[0][2]
    rows = [(1, text), (2, "plain text"), (3, licenses.TEMPLATES[1][2])]
    got = {r["doc_id"]: r for r in licenses.scan(made(spark, rows)).collect()}
    assert got[1]["n_words"] == 100_000 + len(licenses.TEMPLATES[0][2].split())
    assert licenses.TEMPLATES[0][0] in got[1]["labels"].split(",") and got[1]["score"] == 1.0
    assert got[2]["labels"] == "" and licenses.TEMPLATES[1][0] in got[3]["labels"].split(",")


def plain_sentences(rows, span=20):
    texts = sorted({((i is not None, i or 0), t or "") for i, t in rows})
    spans, firsts = [], {}
    for key, t in texts:
        parts = sentences.sentences(t)
        assert "".join(parts) == t
        said = [" ".join(p.lower().split()) for p in parts]
        real = [k for k, p in enumerate(said) if p]
        size = {k: len(said[k].split()) for k in real}
        total = lambda a, b: sum(size[k] for k in real[a : b + 1])  # noqa: E731, B023
        fits = {(a, b) for a in range(len(real)) for b in range(a + 1, len(real)) if total(a, b) >= span}
        found = {(a, b) for a, b in fits if (a, b - 1) not in fits or (a + 1, b) not in fits}
        for a, b in sorted(found):
            text = " ".join(said[k] for k in real[a : b + 1])
            low = 0 if a == 0 else real[a]
            high = real[b + 1] if b + 1 < len(real) else len(parts)
            spans.append((key, t, low, high, text))
    # of equal documents' runs the table has one copy; ties in place go by the document
    order = lambda s: (s[0], s[2])
    for s in spans:
        if s[4] not in firsts or order(s) < firsts[s[4]]:
            firsts[s[4]] = order(s)
    gone = {}
    for s in spans:
        if order(s) != firsts[s[4]]:
            gone.setdefault((s[0], s[1]), set()).update(range(s[2], s[3]))
    out = []
    for i, t in rows:
        parts = sentences.sentences(t or "")
        cut = gone.get(((i is not None, i or 0), t or ""), set())
        out.append((i, len(parts), len(cut), "".join(p for k, p in enumerate(parts) if k not in cut)))
    return sorted(out, key=repr)


def test_sentence_spans(spark):
    rng = np.random.default_rng(3)
    stock = [" ".join("".join(rng.choice(list("abc"), 3)) for _ in range(rng.integers(1, 25))) + str(rng.choice([". ", "! ", "?\n", "\n\n", ".\n"])) for _ in range(25)]
    rows = [(i, "".join(stock[k] for k in rng.integers(0, 25, rng.integers(0, 12)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\n "), (None, rows[5][1]), (503, rows[7][1].upper()), (504, rows[7][1])]
    got = sorted((tuple(r) for r in sentences.remove_repeated_sentences(made(spark, rows)).collect()), key=repr)
    assert got == plain_sentences(rows)
