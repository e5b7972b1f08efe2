"""Divergence audit, whitening and web archives against brute force, with nulls, ties,
empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import divergence, warc, whitening
from larder.llm.common import Scratch

LETTERS = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return LETTERS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# ---------------------------------------------------------- 11 divergence audit

def corpus(seed, n=160, langs=("en", "de", None), sources=9):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "Lo", "mi", "é", "日") for b in ("", "s", "to", "vén", "X")]
    rows = []
    for i in range(n):
        lang = langs[i % len(langs)] if i % 11 else "rare"
        # One source holds a third of the rows; each prefers words of its own.
        src = None if i % 13 == 12 else f"s{0 if i % 3 == 0 else i % sources}"
        words = [vocab[min(len(vocab) - 1, int(rng.expovariate(0.2)) + (hash_of(src) % 5))] for _ in range(rng.randint(0, 40))]
        rows.append((i, None if i % 17 == 16 else rng.choice([" ", "\n", "--1_"]).join(words), lang, src))
    rows += [rows[0], rows[3], (None, "", "empty", "a"), (900, None, "empty", "b"), (901, "the the " * 30_000, "en", "long"),
             (902, "solo " * 5, "one", "alone")]
    return rows


def hash_of(text):
    return int(hashlib.md5(str(text).encode()).hexdigest()[:6], 16)


def brute_audit(rows, least=10, top=10):
    docs = [(terms_of(t), lang or "", src or "") for _, t, lang, src in rows]
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for words, lang, src in docs:
        seen[lang].update(set(words))
        count[lang, src].update(words)
        groups[lang].add(src)
    out = []
    for lang, sources in groups.items():
        kept = [w for w, c in seen[lang].items() if c >= least]

        def shares(counter):
            total, size = sum(counter[w] for w in kept), len(kept)
            return {w: 1 + 10 ** 9 * (counter[w] + 2) // (total + 2 * size) for w in kept}
        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            parts = {"pair": [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in sources if o != s],
                     "term": [(w, f(p[s][w], q[w])) for w in kept if count[lang, s][w] and p[s][w] > q[w]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                items = items if part == "pair" else items[:top]
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(items, 1)]
    return sorted(out)


DOC = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("group_block,term_block", [(32, 4096), (2, 3), (1, 1)])
def test_audit_equals_brute_force(spark, group_block, term_block):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, DOC).repartition(5).withColumns({"p": F.lit(1), "term": F.lit("x"), "value": F.lit(2)})
    got = divergence.audit(docs, group_block=group_block, term_block=term_block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows)


def test_audit_ties_and_empty(spark):
    # Two equal sources and a language without a kept term.
    rows = [(i, "alpha beta gamma", "en", f"s{i % 2}") for i in range(20)] + [(30, "few", "fr", "a"), (31, "", "fr", "b")]
    docs = spark.createDataFrame(rows, DOC)
    got = sorted(tuple(r) for r in divergence.audit(docs).collect())
    assert got == brute_audit(rows)
    assert ("fr", "a", "pair", "b", 0, 1) in got and not [r for r in got if r[2] == "term"]
    assert divergence.audit(docs.limit(0)).collect() == []


def test_counts_do_not_depend_on_flushes(spark, monkeypatch):
    rows = corpus(9)
    monkeypatch.setattr(divergence, "HELD_TERMS", 7)
    held = [b for b in divergence._count_task(iter(spark.createDataFrame(rows, DOC).select("text", "lang", "source")
                                                   .toArrow().to_batches()))]
    n, docs = Counter(), Counter()
    for b in held:
        for r in b.to_pylist():
            n[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["term"]] += r["docs"]
    want, seen = Counter(), Counter()
    for _, t, lang, src in rows:
        want[lang or "", src or "", None] += 0
        want.update((lang or "", src or "", w) for w in terms_of(t))
        seen.update((lang or "", w) for w in set(terms_of(t)))
    assert len(held) > 5 and dict(n) == dict(want)
    assert all(docs[k] == v for k, v in seen.items())


def test_share_is_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (5, 7, 3), (9 * 10 ** 12, 9 * 10 ** 13, 10 ** 6), (10 ** 13, 10 ** 13, 1), (3, 10 ** 14, 77)]
    df = spark.createDataFrame(cases, "c long, t long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("c"), F.col("t"), F.col("v"))).collect()]
    assert got == [1 + 10 ** 9 * (c + 2) // (t + 2 * v) for c, t, v in cases]


# ----------------------------------------------------------------- 12 whitening

def test_inertia_counts_signs():
    rng = np.random.default_rng(3)
    for k in range(200):
        n = int(rng.integers(1, 12))
        a = rng.standard_normal((n, n))
        a = a + a.T
        if k % 3 == 0:
            np.fill_diagonal(a, 0.0)          # needs 2x2 pivots
        if k % 7 == 0:
            a[:, 0] = a[0, :] = 0.0
        e = np.linalg.eigvalsh(a)
        below, zero = whitening.inertia(a)
        if np.abs(e[np.abs(e) > 0]).min(initial=1) > 1e-10:
            assert below == (e < -1e-12).sum() and zero <= (np.abs(e) < 1e-12).sum()


@pytest.mark.parametrize("spectrum", [
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0.5], [1 + k * 1e-5 for k in range(20)], [5, 5, 5, 2, 2, 1, 1, 1, 1], [3, 1, 0, 0, 0, 0],
    [7], [1e12, 1, 1e-9], [1.0] * 12, [2, 2, 1, 0]])
def test_leading_equals_dense_solver(spectrum):
    rng = np.random.default_rng(len(spectrum))
    q, _ = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))
    m = (q * np.array(spectrum, float)) @ q.T
    m = (m + m.T) / 2
    values, vectors = whitening.leading(m)
    want = np.sort(np.linalg.eigvalsh(m))[::-1][:8]
    size = want[0]
    live = want > 1e-14 * size * len(m)
    assert np.allclose(values, np.where(live, want, 0), rtol=0, atol=1e-13 * size * len(m))
    assert np.allclose(vectors[live] @ vectors[live].T, np.eye(live.sum()), atol=1e-7)
    assert np.abs(m @ vectors.T - vectors.T * values).max() <= 1e-10 * size


def exact_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:8]
    dev = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, dev, values[order], c @ axes[:, order] / np.sqrt(np.maximum(values[order], 1e-300)), values.sum()


def vectors_fixture(spark, d=12, n=150, seed=1):
    rng = np.random.default_rng(seed)
    good = (rng.standard_normal((n, d)) * np.linspace(0.6, 0.1, d)).astype(np.float32).astype(float).tolist()
    rows = [(i, v, "x") for i, v in enumerate(good)]
    good += [good[0], good[0]]
    rows += [(0, good[0], "x"), (None, good[0], None)]
    rows += [(901, None, "x"), (902, [None] + good[0][1:], "x"), (903, [float("nan")] + good[0][1:], "x"),
             (904, [float("inf")] + good[0][1:], "x"), (905, [], "x"), (906, [0.5, 0.25], "x"), (907, [0.5], "x")]
    return good, spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string").repartition(3)


def test_whitening_equals_dense_solver(spark):
    good, df = vectors_fixture(spark)
    got = whitening.whiten(df, carry=["vec_id"]).collect()
    n, dev, values, white, trace = exact_whitening(good)
    by = defaultdict(dict)
    for r in got:
        by[r["vec_id"], r["n"]].setdefault(r["component"], []).append(r)
    assert len([r for r in got if r["n"] == n]) == 8 * n
    sign = [1] * 8
    for k in range(1, 9):
        mine = by[7, n][k][0]["whitened"]
        sign[k - 1] = 1 if mine * white[7][k - 1] > 0 else -1
    for i in range(1, 150):
        for k in range(1, 9):
            (r,) = by[i, n][k]
            assert r["deviation"] == dev[i] == int(r["deviation_digits"])
            assert abs(r["whitened"] - sign[k - 1] * white[i][k - 1]) < 1e-8
            assert abs(r["explained"] - values[k - 1] / trace) < 1e-12
            assert r["identity_error"] < 1e-10
    # id 0 twice and a null id: rows like others
    assert len(by[0, n][1]) == 2 and len(by[None, n][1]) == 1
    assert not {901, 902, 903, 904, 905} & {r["vec_id"] for r in got}
    # other lengths are fits of their own: a single vector has no variance
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got if r["vec_id"] == 906] == [
        (1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)]
    assert len([r for r in got if r["vec_id"] == 907]) == 1


def test_whitening_carries_columns_and_takes_odd_tables(spark):
    good, df = vectors_fixture(spark)
    out = whitening.whiten(df.withColumn("odd.name", F.lit(3)))
    assert out.columns == ["vec_id", "odd.name", *whitening.OUTPUT]
    assert out.count() == 8 * len(good) + 3
    assert whitening.whiten(df.limit(0)).collect() == []
    huge = spark.createDataFrame([(1, [3e38, -3e38]), (2, [1.0, 2.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(huge).collect()
    assert len(rows) == 6 and all(r["deviation"] is None or r["deviation"] == int(r["deviation_digits"]) for r in rows)
    assert any(r["deviation"] is None for r in rows)


def test_tiles_add_up(spark):
    good, df = vectors_fixture(spark, d=10)
    a, b = (whitening.fit(df, tile=t)[10] for t in (128, 3))
    assert np.allclose(a.values, b.values, rtol=1e-12) and a.sums == b.sums and a.trace == pytest.approx(b.trace)


# ---------------------------------------------------------------------- 13 WARC

def pages_fixture():
    rng = random.Random(4)
    fake = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nX-Page-Id: 666\r\n"
            "Content-Type: application/http;msgtype=response\r\nContent-Length: {n}\r\n\r\n{b}\r\n\r\n")
    block = warc.HTTP_HEAD + "inside"
    whole = fake.format(n=len(block), b=block)
    big = "é" * 800 + "tail"
    rows = [(1, "http://a/1", "x"), (2, None, None), (3, "http://a/ b\r\nX: 1\t\x00", ""), (4, "http://a/4", "WARC/1." * 40),
            (5, "http://a/5", whole), (6, "http://a/6", whole * 60), (7, "http://a/7", "y" * 5000 + whole + "z" * 3000),
            (8, "http://a/8", "WARC/1.1\r\nContent-Length: 7\r\n\r\n" + "q" * 1500), (9, "u", big), (10, "u", big), (11, "u", big),
            (None, "u", big), (11, "v", big), (12, "w", whole * 60), (13, "u", "s" * 999), (14, "u", "s" * 999),
            (15, "u", "t" * 1000), (16, "u", "t" * 1000), (17, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (18, "u", "WARC/1"), (1, "http://a/1", "x")]
    rows += [(100 + i, f"http://b/{i}", "".join(rng.choice(["<p>", "word ", "\r\n", "WARC/1.", "é"]) for _ in range(rng.randint(0, 400))))
             for i in range(60)]
    return rows


def brute_pages(rows):
    top = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if i is not None and len(b) >= 1000:
            top[b] = max(top.get(b, i), i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        other = top.get(b) if i is not None and i < top.get(b, i) else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if other is None else "revisit", other))
    return sorted(out, key=repr)


def round_trip(spark, df):
    scratch = Scratch(spark)
    found = warc.read_archives(spark, warc.write_archives(df, f"{scratch.root}/archives"))
    return scratch, found


@pytest.mark.parametrize("split", ["128m", "9000"])
def test_round_trip(spark, split):
    """Magic and whole records inside payloads, at any cut of the files."""
    rows = pages_fixture()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumns(
        {"digest": F.lit("mine"), "id": F.lit(1), "bytes": F.lit(2)})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1" if split != "128m" else cost)
        scratch, found = round_trip(spark, df)
        got = [(None if r["page_id"] is None else int(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"],
                None if r["refers_to"] is None else int(r["refers_to"]))
               for r in warc.resolve_revisits(found, scratch).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sorted(got, key=repr) == brute_pages(rows)


def test_headers_and_digests(spark):
    import base64
    rows = pages_fixture()
    scratch, found = round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    by = {r["page_id"]: r for r in found.collect()}
    assert by["3"]["target"] == "http://a/%20b%0D%0AX:%201%09%00" and by["2"]["target"] is None
    for i, _, html in rows:
        if i is not None and i < 19:
            want = hashlib.sha1((html or "").encode())
            assert by[str(i)]["digest"] == "sha1:" + base64.b32encode(want.digest()).decode()
    starts = defaultdict(list)
    for r in found.collect():
        starts[r["file"]].append(r["at"])
    for file, at in starts.items():
        with open(file.removeprefix("file:"), "rb") as f:
            data = f.read()
        place, want = 0, []
        while place < len(data):                                   # a plain sequential reader
            want.append(place)
            end = data.index(b"\r\n\r\n", place) + 4
            size = int(re.search(rb"Content-Length: (\d+)", data[place:end]).group(1))
            assert data[end + size:end + size + 4] == b"\r\n\r\n"
            place = end + size + 4
        assert sorted(at) == want


def test_broken_archives_stop_at_the_break(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: {n}\r\n\r\n{b}\r\n\r\n"
    good = record.format(n=3, b="abc")
    files = {"whole": good * 5, "cut": good * 2 + good[:-6], "wrong_length": good * 2 + record.format(n=2, b="abc") + good,
             "garbage": "no archive " + good, "tail": good + "rest", "empty": "", "no_length": "WARC/1.0\r\nWARC-Type: x\r\n\r\n" + good}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    got = Counter(r["file"].rsplit("/", 1)[1] for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert got == {"whole": 5, "cut": 2, "wrong_length": 2, "tail": 1}


def test_empty_pages_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    scratch, found = round_trip(spark, df)
    assert warc.resolve_revisits(found, scratch).count() == 0
