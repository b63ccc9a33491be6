"""Language ID, toxicity and quotation linking against plain versions that share no code with them."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, quotes, toxicity
from tessera.llm._chars import grams


def gram_set(text, sizes):
    t = " " + "".join(c.lower() if c.isalpha() else "0" if c.isdigit() else " " for c in text) + " "
    return {t[i : i + n] for n in sizes for i in range(len(t) - n + 1)}


def invented(r, syllables, n):
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def packed(texts, sizes, bits):
    return [g.astype("<i4").tobytes() for g, _ in grams(pa.array(texts), sizes, bits)]


@pytest.mark.parametrize("longest", [12, 3000])
def test_language_against_exact_kernel_ridge(longest):
    """With every training row as a landmark the Nystrom features are exact; repeated rows, ties and long texts among them."""
    r = random.Random(longest)
    of = {"aa": ["tha", "ing", "er", "wo"], "bb": ["sch", "ung", "er", "ei"], "cc": ["eau", "wo", "oi", "qu"]}
    labels = [r.choice(list(of)) for _ in range(90)]
    texts = [invented(r, of[x], r.randint(1, longest if i % 30 == 0 else 12)) for i, x in enumerate(labels)]
    texts[5:8], labels[5:8] = [texts[4]] * 3, [labels[4]] * 3  # repeated rows
    texts[10], labels[10], texts[11], labels[11] = "wo er", "aa", "wo er", "bb"  # a tie
    tests = [invented(r, of[r.choice(list(of))], r.randint(1, 12)) for _ in range(60)] + ["wo er", texts[0]]
    model = language.fit(list(zip(labels, packed(texts, language.SIZES, language.BITS), strict=True)), n_landmarks=10_000)
    names, scores = language.scored(model, pa.array(tests))

    every = [gram_set(t, language.SIZES) for t in texts]
    vocab = {g for s in every for g in s if sum(g in x for x in every) >= 2}
    kernel = lambda a, b: np.array([[len(x & y & vocab) / np.sqrt(max(len(x & vocab), 1) * max(len(y & vocab), 1)) for y in b] for x in a])
    k, langs = kernel(every, every), sorted(of)
    y = np.array([langs.index(x) for x in labels])
    weight = (len(y) / len(langs) / np.bincount(y, minlength=3))[y]
    value = np.linalg.eigvalsh(k)
    rank = int((value > 1e-6 * value.max()).sum())
    alpha = np.linalg.solve(k + np.diag(language.RIDGE * len(y) / rank / weight), np.eye(3)[y])
    f = np.maximum(kernel([gram_set(t, language.SIZES) for t in tests], every) @ alpha, 0)
    share = f.max(1) / f.sum(1)
    clear = np.sort(f, 1)[:, -1] - np.sort(f, 1)[:, -2] > 0.02
    assert clear.sum() > 40
    assert all(n == langs[b] for n, b, c in zip(names, f.argmax(1), clear, strict=True) if c)
    assert np.abs(share - scores).max() < 0.03


def test_toxicity_against_a_plain_classifier():
    r = random.Random(3)
    good, bad = ["ri", "ver", "sto", "ne", "an", "der"], ["idi", "ot", "scu", "m"]
    y = np.array([int(r.random() < 0.4) for _ in range(240)])
    texts = [invented(r, good, r.randint(3, 400 if i % 40 == 0 else 25)) + (" " + invented(r, bad, 3) if t else "") for i, t in enumerate(y)]
    texts[3:6], y[3:6] = [texts[2]] * 3, y[2]  # repeated rows
    tests = [invented(r, good, r.randint(1, 20)) + (" " + invented(r, bad, r.randint(1, 3)) if i % 2 else "") for i in range(100)] + ["", texts[0]]
    rows = list(zip(y.tolist(), packed(texts, toxicity.SIZES, toxicity.BITS), strict=True))
    got = toxicity.scores(toxicity.fit(rows, {0: 1.0, 1: 1.0}), pa.array(tests))

    every = [gram_set(t, toxicity.SIZES) for t in texts]
    n1, n0 = y.sum(), (1 - y).sum()
    ratio = {}
    for g in set().union(*every):
        a, b = sum(g in s for s, t in zip(every, y, strict=True) if t), sum(g in s for s, t in zip(every, y, strict=True) if not t)
        x = np.log((a + 1) / (n1 + 2) * (n0 + 2) / (b + 1))
        if a + b >= toxicity.LEAST_DOCS and abs(x) >= 0.5:
            ratio[g] = x
    names = sorted(ratio)

    def matrix(sets):
        out = np.array([[ratio[g] if g in s else 0.0 for g in names] for s in sets])
        return out / np.sqrt(np.maximum((out != 0).sum(1, keepdims=True), 1))

    x, weight = matrix(every), np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(names)), 0.0
    for _ in range(60_000):  # plain gradient descent
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight
        w, b = w - 1.0 * (x.T @ g + toxicity.L2 * w), b - 1.0 * g.sum()
        if _ % 1000 == 0 and np.abs(x.T @ g + toxicity.L2 * w).max() < 2e-5:
            break
    want = 1 / (1 + np.exp(-(matrix([gram_set(t, toxicity.SIZES) for t in tests]) @ w + b + 0.5 * np.log(n1 / n0))))
    far = np.abs(want - 0.5) > 0.2
    assert far.sum() > 80 and ((got >= 0.5) == (want >= 0.5))[far].all()
    assert np.abs(got - want).mean() < 0.08 and np.corrcoef(got, want)[0, 1] > 0.97


MARKS = re.compile(r"^((?:[ \t]*>)+)")


def plain_links(rows):
    """Reply order by the definitions, message by message."""
    norm = lambda t: re.sub(r"\s+", " ", t.lower()).strip(" ")
    told, said, quoted = {}, {}, {}
    for conv, turn, role, text in rows:
        lines = text.split("\n")
        has = any(MARKS.match(x) for x in lines)
        own = "\n".join(x for x in lines if not MARKS.match(x)).strip(" \t\r\n") if has else text
        told[conv, turn] = (role, own)
        for body in (own, *own.split("\n")):
            if norm(body):
                said.setdefault(norm(body), set()).add((conv, turn))
        runs, before = [], -1
        for x in lines if has else ():
            m = MARKS.match(x)
            level, body = (m[1].count(">"), x[m.end() :]) if m else (0, x)
            if level != before:
                runs.append((level, []))
            runs[-1][1].append(body)
            before = level
        quoted[conv, turn] = [q for q in runs if q[0]]
    parent, n_linked = {}, {}
    for (conv, turn), runs in quoted.items():
        found, n = [], 0
        for level, bodies in runs:
            some = [(0, " ".join(bodies)), *((1, x) for x in bodies)]
            links = []
            for kind, body in some:
                at = said.get(norm(body), set()) if norm(body) else set()
                here = min((t for c, t in at if c == conv), default=None)
                if here is not None and here < turn:
                    links.append((-level, -kind, True, (conv, here)))
                elif at and min(at)[0] != conv and min(at) < (conv, turn):
                    links.append((-level, -kind, False, min(at)))
            found += links
            n += bool(links)
        n_linked[conv, turn] = n
        if found:
            parent[conv, turn] = max(found)[3]
    out, threads = {}, {}
    for key, (role, own) in told.items():
        root, depth = key, 0
        while root in parent:
            root, depth = parent[root], depth + 1
        threads.setdefault(root[0], []).append((root[1], key))
        levels = [q[0] for q in quoted[key]]
        out[key] = [role, own, max(levels, default=0), len(levels), n_linked[key], *parent.get(key, (None, None)), root[0], depth]
    for members in threads.values():
        for i, (_, key) in enumerate(sorted(members)):
            out[key].append(i)
    return {k: tuple(v) for k, v in out.items()}


def test_quotes_against_a_plain_linker(spark):
    r, rows = random.Random(12), []
    word = lambda n: " ".join(r.choice(["yes", "no", "Ok", "why", "stone", "river", "so"]) for _ in range(r.randint(1, n)))
    for conv in range(60):
        for turn in range(r.randint(1, 7)):
            text = "\n".join(word(4) for _ in range(r.randint(0, 3)))
            for _ in range(r.randint(0, 2)):
                earlier = r.choice(rows)[3].split("\n") if rows and r.random() < 0.8 else [word(5)]
                at = r.randrange(len(earlier))
                some = earlier[at : at + r.randint(1, 3)] if r.random() < 0.6 else earlier
                text = "\n".join(r.choice([">", "> ", ">> ", " > > "]) + x.upper() for x in some) + "\n" + text
            if r.random() < 0.05:
                text = text + " word" * 20_000  # a very long message
            rows.append((conv, turn, r.choice(["user", "assistant"]), text))
    df = spark.createDataFrame([(*x, 1) for x in rows] + [(*rows[3], 1)], "conv_id long, turn int, role string, text string, depth int").repartition(3)
    columns = ("role", "text", "max_level", "n_quotes", "n_linked", "parent_conv", "parent_turn", "thread_id", "depth", "position")
    got = {(x["conv_id"], x["turn"]): tuple(x[c] for c in columns) for x in quotes.reply_ordered(df).collect()}
    want = plain_links(rows)
    assert got == want
    assert sum(v[5] is not None for v in want.values()) > 60 and max(v[8] for v in want.values()) >= 3


def test_training_is_bounded_in_bytes(spark):
    r = random.Random(1)
    rows = [(i, invented(r, list("abcdef") if i % 2 else list("uvwxyz"), 40), "a" if i % 2 else "b", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    taken = docs.select(F.col("lang").alias("label"), "text").mapInArrow(language.features(language.SIZES, language.BITS), "label string, ids binary")
    every = language.bounded(taken, 1 << 30)
    some = language.bounded(taken, sum(len(x[1]) for x in every) // 4)
    assert len(every) == 400 and 50 < len(some) < 150 and set(some) <= set(every)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"), F.lit("x").alias("text"), F.lit(1).alias("ids"))
    model = toxicity.train(docs, labels)  # clashing names
    assert (toxicity.scores(model, pa.array([t for _, t, _, _ in rows])) >= 0.5).tolist() == [i % 2 == 1 for i in range(400)]
