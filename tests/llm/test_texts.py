"""Operators that SQL can't express, against plain versions of them."""

import collections
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import awkward, components, frame, prose, repeated, shingle_set, words

from pyspark.sql import functions as F
from tideline.llm import decontaminate, graph, hmm, importance, jaccard, licenses, suffixes, toxicity
from tideline.llm.words import runs
from tideline.llm.words import words as split

EMPTY = "doc_id long, text string"


def test_words_are_those_of_python():
    texts = [r[1] for r in awkward()] + ["ab\x1cc", "a" * 1000]
    w = split(pa.array(texts))
    for i, t in enumerate(texts):
        own = [bytes(w.data[w.start[k] : w.end[k]]) for k in range(w.splits[i], w.splits[i + 1])]
        assert own == words(t)
    names = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end, strict=True)]
    assert len(set(names)) == len(set(w.hash.tolist())) == len(set(zip(names, w.hash.tolist(), strict=True)))


# --- 1 toxicity ------------------------------------------------------------------


def test_toxicity_holds_out_and_separates(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.12
        w = prose(rng, rng.randrange(20, 80)).split()
        for _ in range(rng.randrange(2, 5) * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["vilefool", "badword", "nastything"]))
        docs.append((i, " ".join(w), "en", "a", 0))
        if i % 2:
            labels.append((i, int(bad)))
    docs += [(5000, None, None, None, 0), (5001, "", None, None, 0), (None, "badword vilefool", None, None, 0), (5002, "x " * 9000, "en", "a", 0)]
    got = {r.doc_id: r for r in toxicity.op1(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(docs)
    truth = {d[0]: any(x in d[1] for x in ("vilefool", "badword", "nastything")) for d in docs[:1500]}
    held = [i for i in truth if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert got[5000].score == got[5001].score and 0 <= got[5000].score < 0.5


def test_toxicity_without_labels(spark):
    docs = frame(spark, awkward())
    out = toxicity.op1(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert out.filter("predicted = 1").count() == 0 and out.count() == docs.count()


def test_risk_gradient_is_that_of_differences():
    rng = np.random.default_rng(3)
    y = (rng.random(60) < 0.3).astype(int)
    rows, cols = np.nonzero(rng.random((60, 7)) < 0.4)
    w, b, h = rng.normal(size=7), 0.3, 1e-6
    g = np.array([w[cols[rows == i]].sum() for i in range(60)]) + b
    loss = lambda z: math.log1p(math.exp(-z))
    gain = 0.2 * np.mean([loss(g[i]) for i in range(60) if y[i]])
    rest = np.mean([loss(-g[i]) for i in range(60) if not y[i]]) - 0.2 * np.mean([loss(-g[i]) for i in range(60) if y[i]])
    parts = toxicity.risk(w, b, rows, cols, y, 0.2)
    assert [x[0] for x in parts] == pytest.approx([gain, rest])
    for k in range(8):
        step = np.eye(8)[k] * h
        up, down = (toxicity.risk(w + d * step[:7], b + d * step[7], rows, cols, y, 0.2) for d in (1, -1))
        for part in range(2):
            assert (up[part][0] - down[part][0]) / (2 * h) == pytest.approx(parts[part][1][k], abs=1e-6)


def test_toxicity_scores_and_counts_by_hand(spark):
    rng = random.Random(5)
    rows = [(i, f"{prose(rng, 30)} {'Vile-fool, BADWORD!' if i % 5 == 0 else ''}", "en", "a", 0) for i in range(200)] + [(300, None, None, None, 0), (301, "", "en", "a", 0)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 200, 2)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, toxicity.fold("doc_id") != 1)

    def features(text):
        plain = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "")).encode().lower().split()
        out = set()
        for x in plain:
            w = split(pa.array([x.decode()]))
            out.add(int(w.hash[0] >> np.uint64(64 - toxicity.BITS)))
            for k in toxicity.BEGINNINGS:
                if len(x) > k:
                    h = split(pa.array([x[:k].decode()])).hash[0] ^ np.uint64(0x5851F42D4C957F2D)
                    out.add(int(h >> np.uint64(64 - toxicity.BITS)))
        return out

    weight = dict(zip(model["features"].tolist(), model["weights"].tolist(), strict=True))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text, *_ in rows:
        z = model["offset"] + sum(weight.get(f, 0.0) for f in features(text))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))
    counts, n = toxicity.feature_counts(docs)
    want = collections.Counter(f for r in rows for f in features(r[1]))
    assert n == len(rows) and {int(f): int(counts[f]) for f in np.flatnonzero(counts)} == dict(want)


def test_toxicity_sample_is_bounded_by_rows(spark):
    rows = [(7, f"text {k % 50}", "en", "a", 0) for k in range(3000)] + [(i, "w", "en", "a", 0) for i in range(10, 60)]
    labels = spark.createDataFrame([(7, 1)] * 40 + [(i, 0) for i in range(10, 30)], "doc_id long, toxic int")
    got, prior = toxicity.sample(frame(spark, rows), labels, F.lit(True), 20, 30)
    kept = got.collect()
    assert len(kept) <= 50 and [r.text for r in kept if r.positive] == ["text 0"] and prior == pytest.approx(40 / 60)


def test_nnpu_gradient_lowers_the_risk():
    rng = np.random.default_rng(0)
    y = np.repeat([1, 0], [200, 800])
    hidden = np.concatenate([np.ones(200, bool), rng.random(800) < 0.2])
    rows, cols = np.nonzero(np.column_stack([hidden, ~hidden, rng.random((1000, 3)) < 0.5]))
    w, b = toxicity.nnpu(rows, cols, y, 5, 0.2)
    assert w[0] + b > 0 > w[1] + b


# --- 2 licences ------------------------------------------------------------------


def test_license_lines_and_paragraphs(spark):
    mit = licenses.TEMPLATES[2][1]
    half = " ".join(mit.split()[:30])
    docs = [
        (1, f"intro text here\nReleased under the MIT license\nmore"), (2, "words\n\n" + "\n".join(mit[k : k + 60] for k in range(0, len(mit), 60)).replace("\n", "\n") + "\n\nend"),
        (3, "nothing of the kind, only prose about licenses"), (4, half), (5, None), (6, ""), (7, "LICENSED UNDER CC-BY-NC 4.0!!"), (7, "LICENSED UNDER CC-BY-NC 4.0!!"),
    ]
    got = [(r.doc_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame(docs, EMPTY)).collect()]
    assert (1, "MIT") in got and collections.Counter(got)[7, "CC-BY-NC-4.0"] == 2
    assert not {3, 4, 5, 6} & {i for i, _ in got}


def plain_words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).lower().split()


def license_places(text):
    """(license, unit, dice, n_units) by all units and all windows, each compared with each template."""
    numbers, k = [], 0
    for line_no, line in enumerate(text.split("\n")):
        numbers += [line_no] * len(plain_words(line))
    w = plain_words(text)
    pairs = lambda x: {tuple(x[i : i + 2]) for i in range(max(len(x) - 1, 1))} if x else set()
    paragraph = [sum(b - a > 1 for a, b in zip(numbers[: i + 1], numbers[1 : i + 1], strict=False)) for i in range(len(w))]
    units = []
    for kind, of in enumerate((numbers, paragraph, [0] * len(w))):
        for u in sorted(set(of)):
            at = [i for i, x in enumerate(of) if x == u]
            units.append((at[0], at[-1] + 1, kind, None))
    found = []
    for name, template in licenses.TEMPLATES:
        t = plain_words(template)
        size, mine = len(pairs(t)), pairs(t)
        dice = lambda a, b: 2 * len(pairs(w[a:b]) & mine) / (len(pairs(w[a:b])) + size)  # noqa: B023, E731
        found += [(dice(a, b), a, b, kind, name, size) for a, b, kind, _ in units if dice(a, b) >= licenses.THRESHOLD]
        best, end = [], -1
        for p in range(len(w) - len(t) + 1):
            x = dice(p, p + len(t))
            if x < licenses.THRESHOLD:
                continue
            if p >= end:
                best.append((x, p))
            elif x > best[-1][0]:
                best[-1] = (x, p)
            end = p + len(t)
        found += [(x, p, p + len(t), 3, name, size) for x, p in best]
    kept = []
    for x in sorted(found, key=lambda f: (-f[0], -f[5], f[1], f[2] - f[1], f[3], f[4])):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
            kept.append(x)
    out = {}
    for x in kept:
        out.setdefault(x[4], [licenses.KINDS[x[3]], x[0], 0])[2] += 1
    return {(name, u, round(d, 9), n) for name, (u, d, n) in out.items()}


def test_license_places_are_those_of_all_windows(spark):
    rng = random.Random(4)
    docs, planted = [], {}
    for k in range(60):
        name, template = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        w = template.split()
        for _ in range(rng.randrange(1 + len(w) // 25)):  # altered
            w[rng.randrange(len(w))] = rng.choice(["a", "of", "free", "code"])
        body = " ".join(w)
        if k % 3 == 0:  # wrapped, with comment marks and line ends of other systems
            body = "\r\n".join(" * " + " ".join(w[i : i + 9]) for i in range(0, len(w), 9))
        gap = ["\n \t\n", "\r\n\r\n", " ", "\n"][k % 4]  # embedded where there is no border
        docs.append((k, f"{prose(rng, rng.randrange(30, 90))}{gap}{body}{gap}{prose(rng, 40)}"))
        planted[k] = name
    docs.append((900, "\n".join(t for _, t in licenses.TEMPLATES)))
    docs.append((901, prose(rng, 400)))
    got = collections.defaultdict(set)
    for r in licenses.scan_licenses(spark.createDataFrame(docs, EMPTY).repartition(3)).collect():
        got[r.doc_id].add((r.license, r.unit, round(r.dice, 9), r.n_units))
    assert dict(got) == {k: x for k, t in docs if (x := license_places(t))}
    assert sum(name in {x[0] for x in got[k]} for k, name in planted.items()) >= 0.95 * len(planted)
    assert {x[0] for x in got[k] if k == 16} <= {licenses.TEMPLATES[16][0]} and not got[901]


def test_license_texts_are_told_apart(spark):
    whole = [(k, f"Copyright (c) 2020 Someone\n\n{t}\n") for k, (_, t) in enumerate(licenses.TEMPLATES) if len(t) > 400]
    got = collections.defaultdict(set)
    for r in licenses.scan_licenses(spark.createDataFrame(whole, EMPTY)).collect():
        got[r.doc_id].add(r.license)
    assert got == {k: {licenses.TEMPLATES[k][0]} for k, _ in whole}


# --- 3 near duplicates -------------------------------------------------------------


def random_copies(seed, n=260):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 60), ["a", "b", "c", "d", "e", "f"]) for _ in range(12)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        rows.append((i, " ".join(w), "en", "a", 0))
    return rows


@pytest.mark.parametrize("rows", [awkward(), random_copies(1)], ids=["awkward", "random"])
def test_jaccard_join(spark, rows):
    got = jaccard.op3(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = components(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    sizes = collections.Counter((r[0], len({tuple(words(r[1])[k : k + 5]) for k in range(max(1, len(words(r[1])) - 4))}) if words(r[1]) else 0) for r in rows)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == sizes


def test_jaccard_links(spark, monkeypatch):
    rng = random.Random(8)
    base = [prose(rng, n).split() for n in (120, 200)]
    rows = [(k, " ".join(base[k % 2]), "en", "a", 0) for k in range(4)]
    for k in range(40):
        w = list(base[k % 2])
        for _ in range(1 + k % 3):
            w[rng.randrange(len(w))] = f"changed{k}"
        rows.append((100 + k, " ".join(w), "en", "a", 0))
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    classes = set(sets.values())
    want = {i: sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in classes) for i, x in sets.items()}
    assert max(want.values()) > 10
    for block in (1000, 7):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "MEMBERS", block)
        assert {r.doc_id: r.n_links for r in jaccard.op3(frame(spark, rows)).collect()} == want


def test_postings_in_any_batches():
    rng = random.Random(0)
    rows = sorted((rng.randrange(12), rng.randrange(30), 5, 0) for _ in range(80))
    want = []
    for t in range(12):
        run = [r for r in rows if r[0] == t]
        want += [(*r, run[0][1]) for r in run] if len(run) > 1 else []
    for size in (1, 2, 7, 80):
        batches = [pa.record_batch([pa.array(c) for c in zip(*rows[k : k + size], strict=True)], names=["token", "doc_id", "n", "pos"]) for k in range(0, 80, size)]
        got = [tuple(r.values()) for b in jaccard._shared(iter(batches)) for r in b.to_pylist()]
        assert got == want


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500 + k, 501 + k) for k in range(40)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(a, a) == find(a) for a in root)


# --- 5 repeated passages -----------------------------------------------------------


def test_repeats(spark):
    rows = [r for r in awkward() if r[0] not in (0, None, 406, 407)]
    got = collections.defaultdict(set)
    for r in suffixes.op5(frame(spark, rows)).collect():
        got[r.doc_id, r.repeat].update(range(r.word_start, r.word_end))
    want = repeated(rows)
    every = lambda x: {i: x[i, True] | x[i, False] for i, _ in list(x)}
    assert every(got) == every(want)
    first = min(i for i, _ in want if i >= 300)
    assert not got[first, True] and all(got[i, True] for i in range(301, 306))


def test_repeats_of_the_shortest_passages(spark):
    rng = random.Random(21)
    rows = []
    for n in range(50, 61):  # each passage whole in some documents, a part of it in others, by no order of ids
        w = prose(rng, n).split()
        for k in range(9):
            begin, end = (0, n) if k % 3 else (rng.randrange(12), n - rng.randrange(12))
            rows.append((rng.randrange(10**6), f"{prose(rng, 20)} {' '.join(w[begin:end])} {prose(rng, 20)}", "en", "a", 0))
    got = collections.defaultdict(set)
    for r in suffixes.op5(frame(spark, rows)).collect():
        got[r.doc_id, r.repeat].update(range(r.word_start, r.word_end))
    assert got == repeated(rows)


def test_repeats_leave_texts_alone_that_only_repeat_themselves(spark):
    rng = random.Random(1)
    line = prose(rng, 60)
    assert suffixes.op5(frame(spark, [(1, f"{line}\n{line}\n{line}", "en", "a", 0), (2, prose(rng, 200), "en", "a", 0)])).count() == 0
    assert suffixes.op5(frame(spark, [(1, "of " * 300, "en", "a", 0), (2, "of " * 200, "en", "a", 0)])).select("doc_id").distinct().count() == 2


def test_repeats_are_cut_out(spark):
    rng = random.Random(9)
    shared, a, b = prose(rng, 60), prose(rng, 30, ["p", "q", "r"]), prose(rng, 30, ["s", "t", "u"])
    rows = [(1, f"{a}\n{shared} end", "en", "a", 0), (2, f"{b}  {shared}\ttail é", "en", "a", 0), (3, None, "en", "a", 0), (None, shared, "en", "a", 7)]
    got = {r.doc_id: r for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == f"{b}  \ttail é" and got[2].n_chars == len(got[2].text)
    assert got[3].text is None and got[None].text == shared


def test_neighbours_in_any_batches():
    rng = random.Random(3)
    rows = sorted((rng.randrange(6), 0, rng.randrange(5), rng.randrange(9)) for _ in range(60))
    want = set()
    for k, (h, _, doc, place) in enumerate(rows):
        for step in (-1, 1):
            j = k
            while 0 <= j < 60 and rows[j][0] == h and rows[j][2] == doc:
                j += step
            if 0 <= j < 60 and rows[j][0] == h:
                want.add(tuple(sorted([(doc, place), (rows[j][2], rows[j][3])])))
    for size in (1, 2, 9, 60):
        batches = [pa.record_batch([pa.array(c) for c in zip(*rows[k : k + size], strict=True)], names=["h", "more", "doc", "place"]) for k in range(0, 60, size)]
        out = [r for b in suffixes._neighbours(iter(batches)) for r in b.to_pylist()]
        assert {((r["a"], r["pa"]), (r["b"], r["pb"])) for r in out if not r["edge"]} == want
        ends = {side: sorted((r["h"], r["a"], r["pa"]) for r in out if r["edge"] == side) for side in (-1, 1)}
        for side, (h, _, doc, _) in ((-1, rows[0]), (1, rows[-1])):
            assert ends[side] == [(x[0], x[2], x[3]) for x in rows if (x[0], x[2]) == (h, doc)]


def test_a_passage_of_very_many_documents_is_matched_across_tasks(spark):
    rng = random.Random(12)
    w = prose(rng, 55)
    rows = [(rng.randrange(10**6), f"{prose(rng, 20)} {w} {prose(rng, 20)}", "en", "a", 0) for _ in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = collections.defaultdict(set)
        for r in suffixes.op5(frame(spark, rows)).collect():
            got[r.doc_id, r.repeat].update(range(r.word_start, r.word_end))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == repeated(rows)


# --- 6 language model --------------------------------------------------------------


def test_base_scores_and_counts(spark):
    rows = awkward()
    got = hmm.op6(frame(spark, rows)).collect()
    key = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts, n = collections.Counter(), 0
    for r in rows:
        if not key(r[0]):
            counts.update(words(r[1]))
            n += 1
    total, distinct = sum(counts.values()) + n, len(counts) + 1
    den = math.log10(total + 0.1 * (distinct + 1))
    want = collections.Counter()
    for r in rows:
        w = words(r[1])
        base = sum(math.log10(counts[x] + 0.1) for x in w) + math.log10(n + 0.1) - den * (len(w) + 1)
        want[r[0], key(r[0]), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total, round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_forward_recursion_is_exact(monkeypatch):
    monkeypatch.setattr(hmm, "WINDOW", 5)
    model = hmm.Model.first(3, seed=1)
    rng = np.random.default_rng(2)
    x = [rng.integers(0, 50, n) for n in (1, 4, 5, 6, 23, 11)]
    want = []
    for seq in x:
        a = model.start * model.emit[seq[0]]
        for k in seq[1:]:
            a = (a @ model.move) * model.emit[k]
        want.append(math.log(a.sum()))
    got = hmm.likelihoods(model, np.concatenate(x), np.concatenate([[0], np.cumsum([len(s) for s in x])]))
    assert got == pytest.approx(want)


def test_expected_counts_are_those_of_the_whole_texts(monkeypatch):
    monkeypatch.setattr(hmm, "WINDOW", 5)
    model = hmm.Model.first(3, seed=1)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 50, n) for n in (1, 4, 5, 6, 23, 11)]
    x, splits = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, start, length = hmm._windows(splits)
    sums = np.zeros(3 + 9 + hmm.CLASSES * 3)
    log = hmm.expected(model, x, start, length, sums, *hmm.borders(model, x, text, start, length))
    want, total = np.zeros_like(sums), 0.0
    emit = want[12:].reshape(hmm.CLASSES, 3)
    for seq in texts:  # forward and backward over each whole text
        alpha = [model.start * model.emit[seq[0]]]
        for k in seq[1:]:
            alpha.append((alpha[-1] @ model.move) * model.emit[k])
        beta = [np.ones(3)]
        for k in seq[:0:-1]:
            beta.insert(0, model.move @ (model.emit[k] * beta[0]))
        p = alpha[-1].sum()
        total += math.log(p)
        want[:3] += alpha[0] * beta[0] / p
        for t, k in enumerate(seq):
            emit[k] += alpha[t] * beta[t] / p
            if t:
                want[3:12] += (np.outer(alpha[t - 1], model.emit[k] * beta[t]) * model.move / p).ravel()
    assert log == pytest.approx(total) and sums == pytest.approx(want)


def test_training_raises_the_likelihood(spark):
    rng = random.Random(0)
    seqs = [([rng.randrange(1, 20) + 20 * (i % 2) for _ in range(30)],) for i in range(60)]
    _, log = hmm.train(spark.createDataFrame(seqs, "classes array<short>"), 2, 5)
    assert all(b >= a for a, b in zip(log, log[1:], strict=False)) and log[-1] > log[0]


def test_scores_are_those_of_a_model_with_emissions_for_each_word(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", 7)  # the other words meet their counts in the join
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randrange(0, 40), [f"{'ab'[i % 2]}{k}" for k in range(12)]) + (f" once{i}" if i % 3 else ""), "en", "s", 0) for i in range(60)]
    rows += [(61, None, "en", "s", 0), (None, "a1 b2 a1 never", "en", "s", 0), (0, "a1 never never", "en", "s", 0), (60, prose(rng, 600, ["a1", "b2", "c3"]), "en", "s", 0)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    docs = frame(spark, rows).select("doc_id", "text").withColumn("held_out", F.expr("coalesce(crc32(cast(doc_id as string)), 0) % 10 = 0"))
    training = docs.filter("not held_out")
    v = hmm.Vocabulary(hmm.word_counts(training), training.count())
    seqs = hmm.sequences(docs, spark.sparkContext.broadcast(v))
    model, _ = hmm.train(seqs.filter("not held_out"))
    assert 0 < len(v.words) <= 7

    s, count, sums = hmm.STATES, collections.Counter(), collections.defaultdict(lambda: np.zeros(hmm.STATES))
    start, move = np.full(s, 1e-3), np.full((s, s), 1e-3)
    texts = [[*words(r[1]), None] for r in rows]  # None: the end mark
    classes = {}  # of a text, those that the first iterations tied its tokens to
    for of, r in zip([x.classes for x in seqs.orderBy("row").collect()], docs.collect(), strict=True):
        classes[(*words(r.text), None)] = of
    for r, t in zip(rows, texts, strict=True):
        if held(r[0]):
            continue
        e = [model.emit[k] for k in classes[tuple(t)]]
        alpha, beta = [model.start * e[0]], [np.ones(s)]
        alpha[0] /= alpha[0].sum()
        for x in e[1:]:
            alpha.append((alpha[-1] @ model.move) * x)
            alpha[-1] /= alpha[-1].sum()
        for x in e[:0:-1]:
            beta.insert(0, model.move @ (x * beta[0]))
            beta[0] /= beta[0].sum()
        for k, w in enumerate(t):
            gamma = alpha[k] * beta[k]
            sums[w] += gamma / gamma.sum()
            count[w] += 1
            if k:
                xi = np.outer(alpha[k - 1], e[k] * beta[k]) * model.move
                move += xi / xi.sum()
            else:
                start += gamma / gamma.sum()
    start, move = start / start.sum(), move / move.sum(1, keepdims=True)
    total, share = sum(count.values()), sum(sums.values()) / sum(count.values())
    den = total + 0.1 * (len(count) + 1)
    weigh = lambda w: (count[w] + 0.1) / den * ((sums[w] if w in sums else 0) + share) / (count[w] + 1)
    norm = sum(weigh(w) for w in list(count)) + weigh("never")
    want = collections.Counter()
    for r, t in zip(rows, texts, strict=True):
        a, log = start * weigh(t[0]) / norm, 0.0
        for k, w in enumerate(t):
            a = (a @ move) * weigh(w) / norm if k else a
            log += math.log10(a.sum())
            a = a / a.sum()
        want[r[0], len(t), round(log, 5)] += 1
    got = hmm.op6(frame(spark, rows))
    assert collections.Counter((r.doc_id, r.n_tokens, round(r.score, 5)) for r in got.collect()) == want

    found = hmm.word_sums(seqs.filter("not held_out"), model, spark.sparkContext.broadcast(v))
    assert found.filter(F.col("kind") == hmm.WORD).count() == len(count) - 1  # a row for each training word
    e = hmm.Emissions(found, v, s)
    per_word = [e.of(np.array([count[w]]), sums[w][None])[0] for w in count]
    assert sum(per_word) + e.unknown == pytest.approx(np.ones(s))


def test_scores_without_training_documents(spark):
    got = hmm.op6(frame(spark, [(None, "a b", "en", "s", 0), (None, None, "en", "s", 0)])).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)] * 2


# --- 9 importance ------------------------------------------------------------------


def test_importance_prefers_the_target(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, 60) if i % 4 else prose(rng, 60, ["zz", "qq", "xx"]), "en", "a", 0) for i in range(600)]
    docs += [(900, None, None, None, 0), (901, "", None, None, 0), (None, "zz", None, None, 0)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 600, 3)], "doc_id long, quality int")
    got = importance.op9(frame(spark, docs), labels).collect()
    assert len(got) == len(docs)
    assert np.mean([r.selected == (r.doc_id % 4 > 0) for r in got if r.doc_id is not None and r.doc_id < 600]) > 0.97
    assert sum(r.selected for r in got) == round(len(docs) * 0.75)


def test_importance_by_hand(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 40)), "en", "a", 0) for i in range(120)] + [(200, None, "en", "a", 0), (201, "", "en", "a", 0), (3, "again the", "en", "a", 0)]
    good = set(range(0, 60, 4))
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(60)], "doc_id long, quality int")

    def grams(text):
        w = [split(pa.array([x.decode()])).hash for x in words(text)]
        h = [int(x[0]) for x in w] + [int(runs(np.concatenate([x, y]), 2)[0]) for x, y in zip(w, w[1:], strict=False)]
        return [x >> (64 - importance.BITS) for x in h]

    raw, target = collections.Counter(), collections.Counter()
    for i, text, *_ in rows:
        raw.update(grams(text))
        target.update(grams(text) if i in good else [])
    size, scale = 1 << importance.BITS, sum(raw.values()) / sum(target.values())

    def ratio(g):
        one = math.log((target[g] + 1) / (sum(target.values()) + size))
        return one - math.log((raw[g] + scale) / (sum(raw.values()) + scale * size))

    def noise(i):
        h = xxhash.xxh64(struct.pack("<q", i), 42).intdigest()
        u = ((xxhash.xxh64(struct.pack("<i", importance.SEED), h).intdigest() >> 11) + 0.5) / (1 << 53)
        return -math.log(-math.log(u))

    got = importance.op9(frame(spark, rows), labels).collect()
    want = [(i, len(grams(t)), sum(map(ratio, grams(t)))) for i, t, *_ in rows]
    keys = sorted((w + noise(i) for i, _, w in want), reverse=True)
    least = keys[round(len(rows) * len(good) / 60) - 1]
    near = lambda x: tuple(round(v, 6) if isinstance(v, float) else v for v in x)
    assert sorted(near(r) for r in ((r.doc_id, r.n_grams, r.log_weight, r.key, r.selected) for r in got)) == sorted(near((i, n, w, w + noise(i), w + noise(i) >= least)) for i, n, w in want)


def test_kth_largest(spark):
    rng = random.Random(8)
    values = [rng.choice([rng.gauss(0, 1), 1.5, -40.0]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 1500, 3000):
        assert importance.kth_largest(df, "v", k, least=50, ways=16) == sorted(values)[-k]


# --- 10 decontamination ------------------------------------------------------------


def test_leaks_straight_and_shuffled(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, 40)) for k in range(20)] + [(20, "too short"), (21, None), (22, "")]
    w = items[3][1].split()
    parts = [w[k : k + 8] for k in range(0, 40, 8)]
    rng.shuffle(parts)
    clean = prose(rng, 300, ["p1", "p2", "p3", "p4", "p5", "p6"])
    docs = [
        (1, f"{clean} {items[0][1].upper()}\n{clean}"), (2, " ".join(" ".join(p) + " zz" for p in parts)), (3, clean), (4, None), (5, ""),
        (6, " ".join(items[5][1].split()[:10]) + " " + clean), (7, items[7][1]), (7, items[7][1]), (None, items[8][1]),
    ]
    df = spark.createDataFrame(docs, EMPTY)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.op10(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 3), (7, 7)}
    assert got[1, 0].coverage == 1 and got[1, 0].n_tiles == 1 and got[2, 3].n_tiles >= 3
    assert sorted(str(r.doc_id) for r in decontaminate.clean(df, bench).collect()) == ["3", "4", "5", "6", "None"]


def greedy(doc, item, size):
    marked_d, marked_i, out = set(), set(), []
    while True:
        best = None
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in marked_d and q + n not in marked_i:
                    n += 1
                if n >= size and (best is None or n > best[2]):
                    best = (p, q, n)
        if not best:
            return out
        out.append(best)
        marked_d.update(range(best[0], best[0] + best[2]))
        marked_i.update(range(best[1], best[1] + best[2]))


def test_tiles_are_those_of_greedy_string_tiling():
    rng = random.Random(1)
    for _ in range(60):
        doc, item = ([rng.choice("abcd") for _ in range(rng.randrange(5, 40))] for _ in range(2))
        seeds = [(p, q) for p in range(len(doc) - 2) for q in range(len(item) - 2) if doc[p : p + 3] == item[q : q + 3]]
        if seeds:
            d, i = (np.array(c) for c in zip(*seeds, strict=True))
            assert sorted(decontaminate.tiles(d, i, 3)) == sorted(greedy(doc, item, 3))


# --- all -------------------------------------------------------------------------------


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (toxicity.op1(docs, labels), licenses.op2(docs), jaccard.op3(docs), suffixes.op5(docs), hmm.op6(docs), importance.op9(docs, labels), decontaminate.op10(docs, bench)):
        assert out.count() == 0


def test_extra_columns_change_nothing(spark):
    df = frame(spark, awkward()).selectExpr("*", "1 AS score", "2 AS n", "3 AS tokens", "4 AS component", "5 AS _row", "6 AS word_start", "7 AS _id", "8 AS _spans", "9 AS rep", "10 AS item_id")
    plain_df = frame(spark, awkward())
    bench = spark.createDataFrame([(1, awkward()[0][1])], "item_id long, text string")
    for keep in (jaccard.keep_one, suffixes.remove_repeats, lambda x: decontaminate.clean(x, bench)):
        kept = keep(df)
        assert kept.columns == df.columns
        own = ["doc_id", "text", "n_chars"]
        assert sorted(map(str, kept.select(*own).collect())) == sorted(map(str, keep(plain_df).select(*own).collect()))
        assert kept.filter("score <> 1 OR _id <> 7 OR _spans <> 8").count() == 0
    for scan in (licenses.op2, hmm.op6):
        assert sorted(map(str, scan(df).drop("score").collect())) == sorted(map(str, scan(plain_df).drop("score").collect()))
    assert "tokens" in toxicity.score(df, {"features": np.zeros(0, np.int64), "weights": np.zeros(0), "offset": 0.0}).columns
