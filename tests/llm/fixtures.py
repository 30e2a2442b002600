"""Small tables with the awkward cases, and plain versions of the operators."""

from __future__ import annotations

import collections
import random

import duckdb
import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().lower().split()


def prose(rng, n, vocabulary=None):
    names = vocabulary or [f"{a}{b}" for a in "the an re to in of on er st wh".split() for b in "a e i o u na ne ta te".split()] + "the of and in".split() * 5
    return " ".join(rng.choice(names) for _ in range(n))


def awkward(copies: int = 6):
    """Rows of documents: copies, near copies, shared passages, repeated rows,
    nulls, empty, short and long texts, ties."""
    rng = random.Random(11)
    base = [prose(rng, n) for n in (80, 120, 200, 60, 300)]
    shared = prose(rng, 57)
    rows = [(i, t, "en", "a") for i, t in enumerate(base)]
    for k in range(copies):
        w = base[k % 3].split()
        w[rng.randrange(len(w))] = f"changed{k}"
        rows.append((100 + k, " ".join(w), "en", "a"))
        rows.append((200 + k, base[1], "en", "b"))
        rows.append((300 + k, f"{prose(rng, 40 + k)} {shared.upper()}\n{prose(rng, 30)}", "en", "b"))
    rows += [
        (400, None, None, None), (401, "", "en", "a"), (402, " \t\n\x0b\x0c\r ", "en", "c"), (403, "one two", "en", None), (404, "One  TWO", "en", "c"),
        (405, "x", None, "c"), (406, "of " * 300, "en", "c"), (407, "of " * 200, "en", "c"), (408, "é ñ ß 中文 \u00a0 \u2003 emoji😀", "fr", "c"),
        (409, prose(rng, 20000), "en", "c"), (0, base[0], "en", "a"), (None, base[4], "en", "a"), (410, "a\nb\na\n\n \na b a b a b", "en", "c"),
    ]
    return [(*r, len(r[1] or "")) for r in rows]


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def duck(**tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con


def as_pandas(rows):
    df = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    df["doc_id"] = df["doc_id"].astype("Int64")
    for c in ("text", "lang", "source"):
        df[c] = df[c].astype(object).where(df[c].notna(), None)
    return df


def plain(rows):
    clean = lambda x: "~" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(clean(x) for x in r) for r in rows)


def same_as_sql(df, con, sql):
    want = con.sql(sql)
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(want.project(", ".join(columns)).fetchall())


def shingle_set(text, size=5):
    w = words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows, size=5, percent=80):
    """doc_id -> smallest doc_id reachable; every pair is compared."""
    sets = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            sets[r[0]].append(shingle_set(r[1], size))
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def repeated(rows, length=50):
    """(doc_id, repeat) -> word places under windows that another document, or
    one with a smaller id, has too."""
    where = collections.defaultdict(set)
    texts = {r[0]: words(r[1]) for r in rows if r[0] is not None}
    for i, w in texts.items():
        for p in range(len(w) - length + 1):
            where[tuple(w[p : p + length])].add(i)
    out = collections.defaultdict(set)
    for i, w in texts.items():
        for p in range(len(w) - length + 1):
            others = where[tuple(w[p : p + length])] - {i}
            if others:
                out[i, min(others) < i].update(range(p, p + length))
                if max(others) > i and min(others) < i:
                    out[i, False].update(range(p, p + length))
    return out
