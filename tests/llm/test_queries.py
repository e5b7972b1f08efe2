"""Registered queries and the pipeline on the driver's smallest tables."""

import hashlib
import importlib.util
import os
import re
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from larder.llm import langid, mixing
from larder.llm.common import table

SF = "/root/testdata/sf0.001"
_spec = importlib.util.spec_from_file_location("oracle", os.path.join(os.path.dirname(__file__), "..", "oracle.py"))
oracle = importlib.util.module_from_spec(_spec)
sys.modules.setdefault("oracle", oracle)
_spec.loader.exec_module(oracle)

NAMES = sorted(n for n in entry.queries() if n.startswith("op"))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_query_equals_sql(spark, name):
    assert oracle.compare(spark, SF, name)["status"] == "match"


@pytest.mark.parametrize("name", [n for n in NAMES if n not in entry.oracle_sql()])
def test_query_covers_its_table(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    if name == "op12_whitening":
        assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted(
            (r["vec_id"], k) for r in table(spark, SF, "embeddings").collect() for k in range(1, 9))
        return
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in table(spark, SF, "documents").collect())


def test_pipeline_stages(spark, tmp_path):
    """Each stage keeps the columns of documents and decides as its operator does."""
    docs = table(spark, SF, "documents")
    odd = docs.limit(3).selectExpr("doc_id + 100000 as doc_id", "cast(null as string) as text", "lang", "source", "n_chars") \
        .union(docs.limit(2).selectExpr("doc_id + 200000", "'12 34 ...'", "lang", "source", "n_chars"))
    now = docs.union(odd).selectExpr("*", "'mine' as kept", "7 as score")
    first = now
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == now.columns
        path = str(tmp_path / name)
        after.write.parquet(path)
        read = spark.read.parquet(path)
        ids = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert {r["doc_id"] for r in read.select("doc_id").collect()} <= ids
        if name == "language_id":
            assert read.where("doc_id >= 100000").count() == 0
            assert read.count() >= 0.95 * docs.count()
        if name == "near_dedup":
            assert read.count() < now.count()
        now = read
    assert {r["kept"] for r in now.select("kept").collect()} == {"mine"}
    assert first.count() > now.select("doc_id").distinct().count()


def _words(text, pattern="[^\x20\x09-\x0d]+", fold=False):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "") if fold else text or ""
    return re.findall(pattern, text)


def _brute_near(docs):
    sets = {}
    for d, t in docs.items():
        w = _words(t, fold=True)
        k = min(5, len(w))
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    where, part = {}, {d: d for d in docs}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)

    def root(x):
        while part[x] != x:
            x = part[x]
        return x
    for d, s in sets.items():
        for e in {e for x in s for e in where[x] if e > d}:
            if 100 * len(s & sets[e]) >= 80 * len(s | sets[e]):
                a, b = sorted((root(d), root(e)))
                part[b] = a
    return {d: t for d, t in docs.items() if root(d) == d}


def _brute_cut(docs):
    first, out = {}, {}
    for d in sorted(docs):
        w = _words(docs[d])
        gone = set()
        for s in range(len(w) - 49):
            if first.setdefault(tuple(w[s:s + 50]), d) < d:
                gone |= set(range(s, s + 50))
        if len(gone) < len(w) or not w:
            out[d] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else docs[d]
    return out


def _brute_clean(docs, items):
    cut = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    wins = {}
    for t in items:
        w = _words(t, cut, True)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            wins.setdefault(k, set()).add(tuple(w[s:s + k]))
    out = {}
    for d, t in docs.items():
        w = _words(t, cut, True)
        if not any(tuple(w[s:s + k]) in group for k, group in wins.items() for s in range(len(w) - k + 1)):
            out[d] = t
    return out


def test_pipeline_equals_brute_force(spark):
    """run() against plain programs for the stages after the (learned) first."""
    docs = table(spark, SF, "documents")
    kept = {r["doc_id"]: r for r in corpus_pipeline.language_stage(spark, docs, SF).collect()}
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert set(kept) <= letters and len(kept) >= 0.98 * len(letters)
    left = _brute_clean(_brute_cut(_brute_near({d: r["text"] for d, r in kept.items()})),
                        [r["text"] for r in table(spark, SF, "benchmark").collect()])
    size = {}
    for d, t in left.items():
        size[kept[d]["source"]] = size.get(kept[d]["source"], 0) + len(t)
    goal, live = sum(size.values()), sum(v > 0 for v in size.values())
    want = []
    for d, t in left.items():
        m = hashlib.md5(t.encode()).hexdigest()
        u = (int(hashlib.md5(f"17|{d}|{m}".encode()).hexdigest()[:12], 16) + 0.5) / 2 ** 48
        n = mixing.poisson_copies(u, goal / live / size[kept[d]["source"]])
        want += [(d, t, k) for k in range(n)]
    got = [(r["doc_id"], r["text"], r["copy"]) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 50


def test_pipeline_of_an_empty_table(spark, tmp_path):
    now = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert now.count() == 0


def test_learned_languages_only(spark):
    model = langid.train(langid.training_rows(table(spark, SF, "documents")))
    assert model.langs == sorted({r["lang"] for r in table(spark, SF, "documents").collect() if r["lang"]})
