"""The whole pipeline against a plain version of each stage."""

import re

import corpus_pipeline
import duckdb
from fixtures import as_pandas, awkward, components, duck, frame, plain, repeated, words
from test_texts import greedy

from tideline.llm import decontaminate, mixing, quality_rules

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id, text, lang, source, n_chars"


def without(text, places):
    """text without the words at these places, as cut out stretch by stretch."""
    data, out, at, spans = text.encode(), b"", 0, [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
    for k in range(len(spans)):
        if k in places:
            if k - 1 not in places:
                out += data[at : spans[k][0]]
            at = spans[k][1]
    return (out + data[at:]).decode()


def leaked(text, items):
    doc, size = words(text), decontaminate.MIN_MATCH
    grams = {tuple(doc[k : k + size]) for k in range(len(doc) - size + 1)}
    for item in items:
        w = words(item)
        hit = {j for k in range(len(w) - size + 1) if tuple(w[k : k + size]) in grams for j in range(k, k + size)}
        if hit and len(hit) >= decontaminate.COVERAGE * len(w) and sum(t[2] for t in greedy(doc, w, size)) >= decontaminate.COVERAGE * len(w):
            return True
    return False


def expected_rows():
    con = duckdb.connect()
    rows = con.sql(f"SELECT {COLUMNS} FROM '{SF}/documents.parquet'").fetchall()
    items = [r[0] for r in con.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    kept = {r[0] for r in duck(documents=as_pandas(rows)).sql(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept").fetchall()}
    good = [r for r in rows if r[0] in kept]
    root = components(good)
    single = [r for r in good if root[r[0]] == r[0]]
    gone = repeated(single)
    cut = [(r[0], t, r[2], r[3], len(t)) for r in single for t in [without(r[1], gone[r[0], True])]]
    clean = [r for r in cut if not leaked(r[1], items)]
    assert len(rows) > len(good) > len(single) > len(clean) > 0
    want = duck(documents=as_pandas(clean)).sql(f"SELECT m.*, d.text, d.lang, d.n_chars FROM ({mixing.SQL}) m JOIN documents d USING (doc_id)")
    columns = sorted(want.columns)
    return columns, plain(want.project(", ".join(columns)).fetchall())


def test_run(spark):
    columns, expected = expected_rows()
    got = corpus_pipeline.run(spark, SF).select(*columns).collect()
    assert plain(tuple(r) for r in got) == expected


def test_stages_on_awkward_rows(spark):
    docs = frame(spark, awkward())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            empty = stage(spark, docs.limit(0), SF)
            assert empty.count() == 0
        assert out.count() > 0
