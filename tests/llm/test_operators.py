"""The training-data operators against brute force on small fixtures, with
nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import bisect
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import (common, components, decontamination, embedding_dedup, langid, lm_scoring, minhash, mixing,
                        quality, substring_dedup, token_counts, url_filter)

DOC = "doc_id long, text string, lang string, source string"
SPACE = re.compile("[^\x20\x09-\x0d]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=3, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "Lo", "mi", "nu", "é", "ra") for b in ("", "s", "to", "ven", "X")] + ["the", "of"]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage = words(60)
    out = []
    for i in range(n):
        kind, text = i % 6, None
        if kind == 0:
            text = words(rng.randint(1, 90))
        elif kind == 1 and out:
            text = list(rng.choice([t for t in out if t] or [words(5)]))
        elif kind == 2:
            base = list(rng.choice([t for t in out if t and len(t) > 30] or [words(120)]))
            base[rng.randrange(len(base))] = "changed"
            text = base
        elif kind == 3:
            text = words(rng.randint(0, 30)) + passage + words(rng.randint(0, 30))
        elif kind == 4:
            text = words(rng.randint(0, 4))
        else:
            text = words(rng.randint(60, 130))
        out.append(text)
    rows = [(i, None if i % 17 == 16 else rng.choice([" ", "\n", "\t "]).join(t), "xx" if i % 2 else "yy",
             f"s{i % 3}" if i % 7 else None) for i, t in enumerate(out)]
    rows += [rows[0], rows[3], (None, " ".join(passage), None, "s0"), (None, None, None, None),
             (1000, " ".join(words(6000)), "xx", "s1"), (1001, "", "yy", "s1"), (1002, " \n\t ", None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(5)


def results(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- components

def test_components_chain_star_and_empty(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(500, 500), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(results(components.connected_components(df, common.Scratch(spark)), "node", "component"))
    assert got == {**{i: 100 for i in range(100, 141)}, **{k: 7 for k in range(7, 30)}}
    assert components.connected_components(df.limit(0), common.Scratch(spark)).count() == 0


def test_bloom_holds_nothing_back(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    size = common.bloom_blocks(1000)
    probed = common.bloom_probe(spark.range(6000), F.col("id"), common.bloom_table(keys, "k", size), "maybe", size)
    got = {r["id"]: r["maybe"] for r in probed.collect()}
    assert len(got) == 6000 and all(got[i] for i in range(0, 3000, 3))
    assert sum(got.values()) < 1150
    tiny = common.bloom_probe(spark.range(100), F.col("id"), common.bloom_table(keys, "k", 1), "maybe", 1)
    assert tiny.where("maybe").count() == 100  # a full filter lets all through


@pytest.mark.parametrize("limit", [common.BLOOM_BROADCAST, 0])  # 0: joined by block, not broadcast
def test_bloom_grows_with_its_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BLOOM_BROADCAST", limit)
    n = 10_000_000 if limit else 200_000
    size = common.bloom_blocks(n)
    bloom = common.bloom_table(spark.range(n).withColumnRenamed("id", "k"), "k", size)
    probed = common.bloom_probe(spark.range(n - 1000, n + 99_000), F.col("id"), bloom, "maybe", size)
    hits = [r["id"] for r in probed.where("maybe").collect()]
    assert set(range(n - 1000, n)) <= set(hits) and len(hits) - 1000 < 0.02 * 99_000


def test_salted_join_equals_join(spark):
    many = spark.createDataFrame([("a" if i % 3 else f"k{i % 7}", i) for i in range(900)] + [(None, -1), ("none", -2)], "k string, v int")
    few = spark.createDataFrame([("a", 1), ("k0", 2), ("k5", 3), ("unused", 4), (None, 5)], "k string, w int")
    for hot in (["a"], ["a", "k0", "absent"], []):
        x, y = common.salted(many, few, "k", spark.createDataFrame([(h,) for h in hot], "k string"))
        assert results(x.join(y, ["k", "__salt"]), "k", "v", "w") == results(many.join(few, "k"), "k", "v", "w")
        if hot:
            assert x.where("k = 'a'").select("__salt").distinct().count() > 32


# -------------------------------------------------------------- 1 token counts

def test_segment_tree_equals_full_count():
    count = token_counts.Counter(token_counts.read_vocabulary(token_counts.VOCABULARY))
    rng = random.Random(1)
    parts = ["a", "b ", " ", "\n", "  ", "'s", "é", "1", "!!", " the", "\t\n ", "日本", "."]
    for k in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 600 if k % 30 == 0 else 20)))
        tree = token_counts.SegmentTree(count.split(text), count)
        for _ in range(rng.randint(1, 5)):
            a = rng.randint(0, len(text) + 1)
            b, new = a + rng.randint(0, 6), "".join(rng.choices(parts, k=rng.randint(0, 4)))
            lo = min(a, len(text))
            text = text[:lo] + new + text[min(max(lo, b), len(text)):]
            tree.replace(a, b, new)
            assert tree.text() == text and tree.chars == len(text)
            assert tree.tokens == count.tokens(count.split(text))


def test_edit_reencodes_a_small_region():
    count = token_counts.Counter(token_counts.read_vocabulary(token_counts.VOCABULARY))
    text = "some words of prose, repeated. " * 5000
    tree = token_counts.SegmentTree(count.split(text), count)
    assert tree.replace(70_000, 70_010, "other") < 10 * token_counts.LEAF
    new = text[:70_000] + "other" + text[70_010:]
    assert tree.tokens == count.tokens(count.split(new))


def test_count_tokens_with_edit_rows(spark, docs):
    edits = spark.createDataFrame([(0, 1, 0, 3, "Hello, "), (0, 2, 5, 99999, None), (3, 1, None, None, "x"), (77, 1, 0, 1, "")],
                                  "doc_id long, seq int, start int, end int, replacement string")
    with_edits = token_counts.attach_edits(docs.withColumn("n_tokens", F.lit("clash")), edits)
    got = token_counts.count_tokens(with_edits, edits="edits", carry=["doc_id", "text", "edits", "n_tokens"])
    count = token_counts.Counter(token_counts.read_vocabulary(token_counts.VOCABULARY))
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        assert r["n_tokens"] == count.tokens(count.split(text)) == len(count.encoding.encode_ordinary(text))
        for e in r["edits"] or []:
            s = min(e["start"] or 0, len(text))
            end = (e["start"] or 0) if e["end"] is None else e["end"]
            text = text[:s] + (e["replacement"] or "") + text[min(max(s, end), len(text)):]
        assert r["n_tokens_after"] == len(count.encoding.encode_ordinary(text))
    assert token_counts.count_tokens(docs.limit(0), carry=["doc_id"]).count() == 0


def test_redactions():
    text = "mail a.b@c.org or 10.1.2.3, card 1234567890123 and " + "ab" * 20
    for s, e, new in token_counts.redactions(text):
        text = text[:s] + new + text[e:]
    assert text == "mail <MAIL> or <IP>, card <NUMBER> and <SECRET>"


def test_redactions_of_letters_only():
    secret = "abcdefAB" * 4
    assert token_counts.redactions(f"key {secret} end") == [(4, 36, "<SECRET>")]
    assert token_counts.redactions(f"key {secret[1:]} end") == []


# ------------------------------------------------------------ 2 decontamination

def brute_hits(text, items, window):
    cut = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    w = cut.findall(fold(text))
    hit, ids = set(), set()
    for item, t in items:
        b = cut.findall(fold(t))
        size = min(window, len(b))
        if not b:
            continue
        wins = {tuple(b[s:s + size]) for s in range(len(b) - size + 1)}
        for s in range(len(w) - size + 1):
            if tuple(w[s:s + size]) in wins:
                hit |= set(range(s, s + size))
                ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_decontamination_equals_brute_force(spark, docs, block_bytes):
    texts = [t for _, t, _, _ in corpus() if t]
    items = [(0, " ".join(texts[3].split()[5:40])), (1, texts[5]), (10, "the of"), (2, None), (3, " ,. "),
             (4, texts[5]), (12, texts[9].upper().replace(" ", "--"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_matches(docs.withColumn("matches", F.lit(1)), bench, block_bytes=block_bytes,
                                         shard_words=400)
    got = decontamination.summary(found, ["doc_id", "text"])
    cols = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = got.collect()
    assert len(rows) == docs.count() and any(r["contaminated"] for r in rows)
    for r in rows:
        assert tuple(r[c] for c in cols) == brute_hits(r["text"], items, 10), r["doc_id"]
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r["contaminated"] for r in rows)


def test_longest_matches_and_empty_tables(spark, docs):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([("q", " ".join(words[5:35]))], "item_id string, text string")
    d = spark.createDataFrame([(1, "x y " + " ".join(words[10:30]) + " z " + " ".join(words[5:16]))], "doc_id long, text string")
    m = decontamination.find_matches(d, bench).first()["matches"]
    assert sorted((x["item_start"], x["doc_start"], x["length"]) for x in m) == [(0, 23, 11), (5, 2, 20)]
    assert decontamination.find_matches(d, bench.limit(0)).first()["matches"] == []
    assert decontamination.find_matches(d, bench.union(bench)).first()["matches"] == m
    assert decontamination.find_matches(docs.limit(0), bench).count() == 0


# ----------------------------------------------------------- 5 MinHash dedup

def brute_near(rows, size, similarity):
    sets = []
    for doc, text in rows:
        w = SPACE.findall(fold(text))
        sets.append({tuple(w[i:i + min(size, len(w))]) for i in range(len(w) - min(size, len(w)) + 1)} if w else set())
    part = {doc: doc for doc, _ in rows if doc is not None}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x
    for (i, (a, _)), (j, (b, _)) in itertools.combinations(enumerate(rows), 2):
        if a is not None and b is not None and a != b and sets[i] and sets[j] \
                and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            x, y = sorted((root(a), root(b)))
            part[y] = x
    return [(doc, len(s), None if doc is None else root(doc)) for (doc, _), s in zip(rows, sets)]


@pytest.mark.parametrize("size,similarity", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, docs, size, similarity):
    got = minhash.near_duplicates(docs.withColumn("kept", F.lit("clash")), shingle=size, similarity=similarity)
    want = brute_near([(d, t) for d, t, _, _ in corpus()], size, similarity)
    assert results(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got.collect())
    assert any(r[0] != r[2] for r in want if r[0] is not None)


def test_near_copies_of_one_text_in_small_tiles(spark, monkeypatch):
    """A group whose members differ from the hub by more than allowed, met tile by tile and band by band."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(70):
        w = list(base)
        for k in range(rng.randint(0, 8)):
            w[rng.randrange(150)] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute_near(rows, 3, 85), key=repr)
    assert 1 < len({r[2] for r in want}) < 70
    for whole in (10_000, 8):
        monkeypatch.setattr(minhash, "WHOLE_GROUP", whole)
        got = minhash.near_duplicates(df, shingle=3, similarity=85, tile=8)
        assert results(got, "doc_id", "n_shingles", "component_id") == want
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_bands_miss_few_pairs(spark, monkeypatch):
    used = []
    monkeypatch.setattr(minhash, "_sketch_task", lambda size, bands, rows, real=minhash._sketch_task: (
        used.append((bands, rows)), real(size, bands, rows))[1])
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    for similarity in (80, 85):
        minhash.near_duplicates(df, similarity=similarity).count()
        bands, rows = used[-1]
        assert (1 - (similarity / 100) ** rows) ** bands < 1e-6


def test_sketch_fills_and_estimates():
    s = minhash.Sketcher(140)
    rng = np.random.default_rng(2)
    for n in (1, 3, 30, 300, 3000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert (s.of(x) < np.iinfo(np.uint64).max).all()
        assert (s.of(x) == s.of(x[::-1])).all()
    errors = []
    for _ in range(60):
        u = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        errors.append((s.of(u[:360]) == s.of(u[40:])).mean() - 320 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


# ------------------------------------------------------------------ 6 mixing

def test_mixing_counts_follow_the_hash(spark, docs):
    want, rows = [], corpus()
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(t or "")
    goal, live = sum(size.values()), [s for s in size if size[s]]
    h = lambda seed, *p: (int(hashlib.md5("|".join([str(seed), *p]).encode()).hexdigest()[:12], 16) + 0.5) / 2 ** 48
    for d, t, _, s in rows:
        m = hashlib.md5((t or "").encode()).hexdigest()
        i = "" if d is None else str(d)
        n = mixing.poisson_copies(h(17, i, m), goal / len(live) / size[s] if size[s] else 0.0)
        want += [(d, s, k, h(18, i, m, str(k))) for k in range(n)]
    got = mixing.mix_sources(docs.withColumn("copy", F.lit(9)))
    assert results(got, "doc_id", "source", "copy", "shuffle_key") == sorted(want, key=repr)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_reaches_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("12345").alias("text"),
                                    F.when(F.col("id") % 10 == 0, "rare").otherwise("big").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mix_sources(
        df, {"rare": 3.0, "big": 1.0, "absent": 5.0}, total=40_000 * 5.0).groupBy("source").count().collect()}
    assert abs(got["rare"] - 30_000) < 900 and abs(got["big"] - 10_000) < 500
    huge = mixing.mix_sources(df.where("doc_id < 5"), total=5 * 5 * 2000.0)
    assert abs(huge.count() - 10_000) < 600


@pytest.mark.parametrize("rate", [650.0, 1500.0, 20_000.0])
def test_mixing_draws_of_a_large_rate(spark, rate):
    """Counts of each document against a plain inversion in logarithms, and their spread."""
    n = 200
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("12345").alias("text"), F.lit("one").alias("source"))
    got = {r["doc_id"]: r["count"] for r in mixing.mix_sources(df, total=n * 5 * rate).groupBy("doc_id").count().collect()}
    m = hashlib.md5(b"12345").hexdigest()
    top = int(rate + 12 * math.sqrt(rate) + 24)
    cdf = list(itertools.accumulate(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(top)))
    for d in range(n):
        u = (int(hashlib.md5(f"17|{d}|{m}".encode()).hexdigest()[:12], 16) + 0.5) / 2 ** 48
        assert got[d] == bisect.bisect_left(cdf, u)
        assert rate > 700 or got[d] == mixing.poisson_copies(u, rate)
    values = np.array(list(got.values()))
    assert abs(values.mean() / rate - 1) < 4 / math.sqrt(rate * n) and 0.7 < values.var() / rate < 1.4


# ------------------------------------------------------------- 7 language ID

def language_rows(n=240):
    rng = random.Random(4)
    sound = {"aa": ["ba", "do", "gi", "zu"], "bb": ["sch", "pf", "ung", "eit"], "cc": ["éau", "oui", "ç", "tion"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(sound))
        rows.append((i, " ".join("".join(rng.choices(sound[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 40))), lang))
    return rows


def test_language_id_on_held_out_rows(spark):
    rows = language_rows()
    df = spark.createDataFrame(rows + [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !!", "bb"), (None, "schpf ung", "bb"),
                                       (5, rows[5][1], rows[5][2])], "doc_id long, text string, lang string")
    model = langid.train(langid.training_rows(df.where("doc_id % 3 <> 0")), landmarks=32)
    got = langid.predict(df.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(rows) + 5
    for r in got:
        assert 0.0 <= r["score"] <= 1.0
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None and r["doc_id"] % 3 == 0:
            assert r["lang_pred"] == r["lang"]
    # Rows of one id are one landmark; nothing but bits of its presence comes to the driver.
    one = langid.train(langid.training_rows(df.where("doc_id = 0").crossJoin(spark.range(5)).drop("id")))
    assert one.landmarks.shape == (langid.DIM, 1)
    empty = langid.train(langid.training_rows(df.limit(0)))
    assert {r["lang_pred"] for r in langid.predict(df, empty).collect()} == {"und"}


def test_language_of_texts_of_several_megabytes(spark):
    rng = random.Random(11)
    rows = language_rows()
    model = langid.train(langid.training_rows(spark.createDataFrame(
        rows, "doc_id long, text string, lang string")))
    words = {}
    for _, text, lang in rows:
        words.setdefault(lang, []).extend(text.split())
    # Letters beside the language's own words, so that a long text meets nearly all n-grams.
    odd = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5))
    text = lambda lang, k: " ".join(odd() if rng.random() < 0.1 else rng.choice(words[lang]) for _ in range(k))
    for lang in words:
        short = [model.predict([text(lang, 2000).encode()[:langid.PIECE - 8].decode("utf-8", "ignore").encode()])[1][0] for _ in range(20)]
        long = text(lang, 500_000).encode()
        assert len(long) > 2_500_000
        got = spark.createDataFrame([(1, long.decode())], "doc_id long, text string")
        r = langid.predict(got, model).first()
        assert r["lang_pred"] == lang and abs(r["score"] - np.mean(short)) < 0.03 and r["score"] > 0.5


def test_pieces_hold_every_ngram():
    text = " ".join(f"wört{i}" for i in range(3000)).encode()
    parts = langid.pieces(text)
    assert len(parts) > 4 and max(map(len, parts)) <= langid.PIECE + 3
    assert set(np.concatenate([langid.places(p) for p in parts]).tolist()) == set(langid.ngrams(text).tolist())


def test_presence_kernel_equals_set_kernel():
    a, b = b"Der Hund, 12 laeuft", "l'été où".encode()
    x = langid.presence([a, b])
    s = [set(langid.ngrams(t).tolist()) for t in (a, b)]
    assert math.isclose(float(x[0] @ x[1]), len(s[0] & s[1]) / math.sqrt(len(s[0]) * len(s[1])), rel_tol=1e-5)


# ------------------------------------------------------------- 3 quality

def test_quality_ratios_count_all_training_rows(spark):
    rows = [(i, f"own{i} both here", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    n = np.full((2, quality.DIM), quality.SMOOTHING)
    for _, text, label in rows:
        n[label, quality.features(text.encode().split(), quality.Words())] += 1
    assert np.allclose(model.ratio, np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum()))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = rng.choices(vocab, k=rng.randint(20, 60))
        good = rng.random() < 0.8
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x for x in w for _ in range(4)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows + [(None, "w1 w2"), (900, None), (901, ""), rows[0]], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [labels[0], (None, 1), (900, 1), (7777, 0), (3, None), (4, 5)], "doc_id long, quality int")
    model = quality.train(docs, lab, train_when=F.col("doc_id") % 5 != 0)
    got = quality.score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == 604 and all(0.0 <= r["score"] <= 1.0 for r in got)
    truth = dict(labels)
    held = [r for r in got if r["doc_id"] in truth and r["doc_id"] % 5 == 0]
    assert np.mean([(r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in held]) > 0.95
    nothing = quality.train(docs, lab.limit(0))
    assert quality.score(docs.limit(0), nothing).count() == 0


def test_quality_of_very_long_texts(spark):
    rng = random.Random(3)
    good, bad = [f"g{i}" for i in range(4000)], [f"B{i}!" for i in range(4000)]
    mixed = lambda own, n: " ".join(rng.choices(own, k=n // 2) + rng.choices(good + bad, k=n // 2))
    rows = [(i, mixed(good if i % 2 else bad, 80)) for i in range(500)]
    rows += [(1000 + i, mixed(good if i % 2 else bad, 60_000)) for i in range(6)]     # long ones to learn from
    long = [(2000 + i, mixed(good if i % 2 else bad, 600_000)) for i in range(4)]     # 3 MB, not learned from
    docs = spark.createDataFrame(rows + long, "doc_id long, text string")
    lab = spark.createDataFrame([(d, d % 2) for d, _ in rows], "doc_id long, quality int")
    model = quality.train(docs, lab)
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, model, carry=["doc_id"]).collect()}
    assert all((score[d] > 0.8) if d % 2 else (score[d] < 0.2) for d, _ in long)
    assert len(quality.pieces(long[0][1].encode(), quality.Words())) > 200


def test_scores_do_not_depend_on_carried_text(spark):
    docs = spark.createDataFrame([(1, "good words here", "x"), (2, None, "y"), (3, "", "z")], "id long, text string, score string")
    model = quality.Model(np.ones(quality.DIM), np.linspace(-1, 1, quality.DIM + 1), 1.0, 0.0)
    got = quality.score(docs, model)
    assert got.columns == ["id", "text", "score"]
    assert results(got, "id", "score") == results(quality.score(docs, model, carry=["id"]), "id", "score")
    tongue = langid.Model(np.zeros((langid.DIM, 0), np.float32), None, [])
    assert results(langid.predict(docs, tongue), "id", "text", "lang_pred") == [(1, "good words here", "und"), (2, None, "und"), (3, "", "und")]


def test_dual_coordinate_descent_reaches_the_dense_optimum():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 12, 4)).astype(np.int32) for _ in range(60)]
    y = np.where(rng.random(60) < 0.6, 1.0, -1.0)
    ratio = rng.normal(size=12)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, -1] = 1.0
    bound = 60 / (2.0 * np.array([(y < 0).sum(), (y > 0).sum()])[(y > 0).astype(int)])
    primal = lambda w: w @ w / 2 + (bound * np.maximum(0, 1 - y * (x @ w))).sum()
    alpha = np.zeros(60)
    q = (x @ x.T) * np.outer(y, y)
    for _ in range(200_000):                      # projected gradient on the dense dual
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, bound)
    dual = alpha.sum() - alpha @ q @ alpha / 2
    w = quality.dual_coordinate_descent(rows, y, ratio, epochs=3000)
    assert dual - 1e-3 <= primal(w) <= dual * 1.001 + 1e-3


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.r_[rng.integers(0, 5) + (0 if k % 2 else 10), rng.integers(20, 40, 3)]).astype(np.int32) for k in range(200)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(200)])
    w = quality.dual_coordinate_descent(rows, y, np.ones(40), epochs=30)
    assert all(np.sign(w[r].sum() / math.sqrt(len(r)) + w[-1]) == t for r, t in zip(rows, y))


# ------------------------------------------------------------- 4 LM scoring

def log_forward(m, seq):
    a = m.start * m.emit[seq[0]]
    total = math.log(a.sum())
    a = a / a.sum()
    for s in seq[1:]:
        a = (a @ m.step) * m.emit[s]
        total += math.log(a.sum())
        a = a / a.sum()
    return total / math.log(10)


def test_segmented_forward_is_exact():
    rng = np.random.default_rng(1)
    m = lm_scoring.random_model(np.full(30, 1 / 30), 4)
    seqs = [rng.integers(0, 30, n) for n in (1, 2, 7, 50, 8, 16, 33, 200)]
    want = [log_forward(m, s) for s in seqs]
    for segment in (8, 1000):
        assert np.allclose(lm_scoring.log10_likelihood(m, seqs, segment), want)


def test_baum_welch_counts_equal_enumeration():
    rng = np.random.default_rng(3)
    m = lm_scoring.random_model(np.full(5, 0.2), 2)
    seqs = [rng.integers(0, 5, n) for n in (3, 1, 4)]
    start, step, emit, log = lm_scoring.expected_counts(m, seqs)
    s2, t2, e2, l2 = np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2)), 0.0
    for seq in seqs:
        paths = {}
        for path in itertools.product(range(2), repeat=len(seq)):
            p = m.start[path[0]] * m.emit[seq[0], path[0]]
            for a, b, x in zip(path, path[1:], seq[1:]):
                p *= m.step[a, b] * m.emit[x, b]
            paths[path] = p
        z = sum(paths.values())
        l2 += math.log(z)
        for path, p in paths.items():
            s2[path[0]] += p / z
            for x, k in zip(seq, path):
                e2[x, k] += p / z
            for a, b in zip(path, path[1:]):
                t2[a, b] += p / z
    for got, want in ((start, s2), (step, t2), (emit, e2)):
        assert np.allclose(got, want, atol=1e-5)
    assert math.isclose(log, l2, rel_tol=1e-6)


@pytest.mark.parametrize("head", [lm_scoring.HEAD, 12])
def test_scores_and_base(spark, docs, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)  # 12: most words are joined
    got = lm_scoring.score_documents(docs, common.id_crc("doc_id", 7) == 2).collect()
    rows = corpus()
    assert len(got) == len(rows)
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    toks = lambda t: SPACE.findall(fold(t)) + ["<end>"]
    count = {}
    for d, t, _, _ in rows:
        for w in toks(t) if not out(d) else []:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted(((d, out(d), len(toks(t)), sum(w in count for w in toks(t)), n) for d, t, _, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got), key=repr) == want
    base = sorted(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in toks(t)) for _, t, _, _ in rows)
    assert np.allclose(sorted(r["base_score"] for r in got), base)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_score_equals_forward_and_long_hot_words(spark, monkeypatch):
    """Score of every text against a plain forward recursion on the trained model, with a separator too
    long for the head in every text, salted."""
    monkeypatch.setattr(lm_scoring, "HOT_LEAST", 20)
    monkeypatch.setattr(lm_scoring, "HEAD", 30)
    kept = {}
    train = lm_scoring.baum_welch
    monkeypatch.setattr(lm_scoring, "baum_welch", lambda *a: kept.setdefault("models", []).append(train(*a)) or kept["models"][-1])
    rng = random.Random(4)
    rule = "=" * 90
    texts = {i: " ".join(rng.choices([f"v{k}" for k in range(60)], k=20) + [rule] + [f"once{i}"]) for i in range(200)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, score string")
    held = common.id_crc("doc_id", 7) == 2
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, held).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = {"\n": 0}
    for i, t in texts.items():
        for w in t.split() + ["\n"] if not out[i] else []:
            count[w] = count.get(w, 0) + 1
    n, v, m = sum(count.values()), len(count), kept["models"][-1]
    top = sorted((w for w in count if len(w) <= 64 and w != "\n"), key=lambda w: (-count[w], w))[:29]
    head = ["\n"] + top
    groups = {}
    for w in count:
        if w not in head:
            b = lm_scoring.bucket_of(w.encode())
            groups[b] = groups.get(b, [0, 0])
            groups[b][0] += count[w]
            groups[b][1] += 1
    for i, t in texts.items():
        words = t.split() + ["\n"]
        base = sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words)
        assert math.isclose(got[i]["base_score"], base, rel_tol=1e-9)
        assert got[i]["n_known"] == sum(w in count for w in words)
        a, want = None, 0.0
        for w in words:
            if w in head:
                s, share = head.index(w), 1.0
            else:
                b = lm_scoring.bucket_of(w.encode())
                c, d = groups.get(b, (0, 0))
                s, share = len(head) + b, (count.get(w, 0) + 1) / (c + d + 1)
            a = (m.start if a is None else a @ m.step) * m.emit[s]
            want += math.log10(a.sum()) + math.log10(share)
            a = a / a.sum()
        assert math.isclose(got[i]["score"], want, rel_tol=1e-6), (got[i]["score"], want)


def test_empty_corpus_and_all_held_out(spark, docs):
    assert lm_scoring.score_documents(docs.limit(0), F.lit(False)).count() == 0
    got = lm_scoring.score_documents(docs.limit(3), F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in got)


# ---------------------------------------------------------------- 8 URLs

def test_url_filter(spark):
    rules = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"),
             url_filter.Rule("org", "/fr/", "allow")]
    urls = ["http://a.Example.NET/en/x?y", "https://example.net/de", "http://notexample.net/en/1", "http://bad.com/p.html#z",
            "https://www.BAD.com/p/", "http://ok.com/P", "http://x.org/fr/", "http://org/fr/a", "no scheme", "", None, "://",
            "a://b?c://d/e", "http://bad.com/p"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x"), (None, None, None)],
                                  "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("bad.com/p",), (None,), ("",), ("bad.com/p",)], "canonical string")
    for blocks in (1, 1 << 10):
        got = url_filter.filter_urls(pages, listed, rules, blocks=blocks)
        rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
        assert got.count() == len(urls) + 2
        assert [rows[i] for i in range(len(urls))] == [
            ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de", "net/", "block"),
            ("notexample.net", "/en/1", "net/", "block"), ("bad.com", "/p.html", None, "block"),
            ("www.bad.com", "/p/", None, "block"), ("ok.com", "/P", None, "allow"), ("x.org", "/fr/", "org/fr/", "allow"),
            ("org", "/fr/a", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
            ("", "", None, "allow"), ("b", "", None, "allow"), ("bad.com", "/p", None, "block")]
    assert url_filter.filter_urls(pages.limit(0), listed, rules).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0), rules).where("verdict = 'block'").count() == 2


def test_url_filter_removes_false_positives_and_splits_hot_urls(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "HOT_LEAST", 50)
    long = "http://long.com/" + "a" * 1_000_000
    urls = [f"http://site{i}.com/p" for i in range(4000)] + ["http://www.hot.com/x.html"] * 500 + [long, long + "b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    names = [f"site{i}.com/p" for i in range(0, 4000, 4)] + ["hot.com/x", long[7:]]
    listed = spark.createDataFrame([(c,) for c in names], "canonical string")
    parts = pages.select("page_id", url_filter.canonical(*url_filter.url_parts(F.col("url"))).alias("canonical"))
    probed, _ = url_filter.probe_list(parts, listed, common.Scratch(spark))
    maybe = {r["page_id"] for r in probed.where("__maybe").select("page_id").collect()}
    got = {r["page_id"] for r in url_filter.filter_urls(pages, listed, []).where("verdict = 'block'").select("page_id").collect()}
    assert got == set(range(0, 4000, 4)) | set(range(4000, 4501))
    assert got < maybe and len(maybe - got) < 0.03 * 3000  # false positives occur, and only the join removes them


# ----------------------------------------------------------- 9 embeddings

def brute_vectors(rows, threshold):
    ok = {}
    for k, (i, v, lab) in enumerate(rows):
        if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            a = np.array(v, float)
            ok[k] = a / np.sqrt(((a / np.abs(a).max()) ** 2).sum()) / np.abs(a).max()
    part, links = {i: i for i, _, _ in rows if i is not None}, {k: 0 for k in range(len(rows))}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x
    for a, b in itertools.combinations(ok, 2):
        if rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold:
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(rows[a][0]), root(rows[b][0])))
            part[y] = x
    return sorted(((i, links[k], None if i is None else root(i)) for k, (i, _, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("tile", [5, 1024])
def test_embeddings_equal_brute_force(spark, tile):
    rng = np.random.default_rng(6)
    rows, base = [], rng.normal(size=(12, 20))
    for i in range(150):
        v = base[i % 12] + rng.normal(size=20) * (0.0, 0.08, 0.15, 0.6)[i % 4]
        rows.append((i, [float(c) for c in np.float32(v * (1 + i % 3))], i % 2))
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 20, 1), (203, [float("nan")] + [1.0] * 19, 1), (204, [None] + [1.0] * 19, 0),
             (205, rows[0][1], None), (None, rows[0][1], 0), (206, rows[0][1][:10], 0), (207, rows[0][1][:10], 0), (208, [3.0], 0),
             (209, [float("inf")] * 20, 0), (210, [2.0], 0), rows[0], (211, [1e200, 0.0, 0.0], 0), (212, [1e-200, 0.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = embedding_dedup.near_duplicates(df.repartition(4), tile=tile)
    assert results(got, "vec_id", "n_links", "component_id") == brute_vectors(rows, 0.98)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("first, second", [(0, 0), (0, 1)])
def test_blocks_of_two_tiles_hold_every_link(monkeypatch, first, second):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    monkeypatch.setattr(embedding_dedup, "REACH", 11)
    rng, n, dim = np.random.default_rng(3), 120, 12
    x = rng.normal(size=(9, dim))[np.arange(n) % 9] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.5], (n, 1))
    tile, home = (np.zeros(n, int), np.ones(n, bool)) if first == second else (np.arange(n) % 2, np.arange(n) % 2 == 0)
    copies = rng.integers(1, 4, n)
    ids = rng.permutation(n)
    rows = pa.table({"vec": ids, "dim": np.full(n, dim), "copies": copies, "home": home, "tile": tile,
                     "embedding": pa.array(list(x), pa.list_(pa.float64()))})
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    run = embedding_dedup._tile_task({dim: axes}, 0.98, math.sqrt(0.04) + 1e-7, 2)
    got = run((pa.scalar(first), pa.scalar(second)), rows).to_pylist()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links, near = {}, {int(i): {int(i)} for i in ids}
    for a, b in itertools.combinations(range(n), 2):
        if unit[a] @ unit[b] >= 0.98 and (first == second or tile[a] != tile[b]):
            links[int(ids[a])] = links.get(int(ids[a]), 0) + int(copies[b])
            links[int(ids[b])] = links.get(int(ids[b]), 0) + int(copies[a])
            both = near[int(ids[a])] | near[int(ids[b])]
            for i in both:
                near[i] = both
    assert {r["a"]: r["links"] for r in got} == links and len(links) > 20
    assert {r["a"]: r["b"] for r in got} == {i: min(near[i]) for i in links}


# ---------------------------------------------------------- 10 substrings

def brute_cut(rows, window):
    words = [SPACE.findall(t or "") for _, t in rows]
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if d is not None and any(e is not None and e < d and any(
                    x[k:k + window] == w[s:s + window] for k in range(len(x) - window + 1)) for (e, _), x in zip(rows, words)):
                gone |= set(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((d, len(w), len(gone), " ".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,piece", [(50, 16), (12, 5), (4, 4)])
def test_substrings_equal_brute_force(spark, window, piece):
    rows = [(d, t) for d, t, _, _ in corpus(n=40) if not t or len(t) < 5000]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string").repartition(3)
    got = substring_dedup.drop_repeats(df, window=window, piece=piece)
    want = brute_cut(rows, window)
    assert results(got, "doc_id", "n_words", "n_removed", "kept_text") == want
    assert any(r[2] for r in want)
    for r in got.collect():
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
    assert substring_dedup.drop_repeats(df.limit(0)).count() == 0
