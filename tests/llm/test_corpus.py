"""Each corpus operator against a brute-force version, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import chat, decontam, licenses, lines, neardup, pieces, quality, sharding, topk, toxicity
from tidemark.llm import queries as registered
from tidemark.llm.base import crc_of_id

FOLDER = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    """Ids and texts: random ones, exact and near copies, empty, null, blank, long and repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".\n", "!"]) for _ in range(n))
    rows = [(i, make(rng.randint(1, 90))) for i in range(120)]
    base = make(80)
    for i in range(120, 190):  # near copies of one text
        changed = base.split(" ")
        changed[rng.randrange(80)] = "x"
        rows.append((i, " ".join(changed)))
    rows += [(i, rows[3][1]) for i in range(190, 210)]
    rows += [(210, ""), (211, None), (212, " \n\t "), (213, make(6000)), (214, "AbC"), (215, "abc"), (216, "one two three")]
    rows += [rows[7], (None, "a null id"), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    extra = [(i, t, "en", "score", 1, "k") for i, t in texts]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, score string, shard int, text_hash string").repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    marks = [(i, i % 2, i % 3 == 0) for i in range(200)] + [(None, 1, True), (3, None, None)]
    return spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in marks], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "of", "held"), [(quality.quality, 4, 2), (toxicity.toxicity, 5, 0)])
def test_classifiers(spark, docs, none, labels, texts, operator, of, held):
    out = operator(docs, labels).collect()
    assert sorted(r["doc_id"] or -1 for r in out) == sorted(i or -1 for i, _ in texts)
    for r in out:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % of == held)
    assert operator(none, labels).count() == 0
    for r in operator(docs, labels.filter("false")).collect():
        assert r["score"] == pytest.approx(0.5)


def test_classifiers_learn_from_training_rows_only(spark):
    rng = random.Random(1)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(1200):
        body = [rng.choice(filler) for _ in range(30)]
        bad = i % 3 == 0
        if bad:
            body[rng.randrange(30)] = rng.choice(["rotten", "vile"])
        rows.append((i, " ".join(body) + ("" if not bad else " $$$ ###"), int(not bad), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    for operator, of, held, mark in ((quality.quality, 4, 2, 2), (toxicity.toxicity, 5, 0, 3)):
        # held-out labels turned around must not change a score
        turned = labels.withColumns({c: labels[c] if held is None else __import__("pyspark.sql.functions", fromlist=["when"]).when(crc_of_id("doc_id") % of == held, 1 - labels[c]).otherwise(labels[c]) for c in ("quality", "toxic")})
        got = {r["doc_id"]: r for r in operator(docs, labels).collect()}
        again = {r["doc_id"]: r["score"] for r in operator(docs, turned).collect()}
        assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i in got)
        right = [got[r[0]]["predicted"] == r[mark] for r in rows if got[r[0]]["held_out"]]
        assert sum(right) / len(right) > 0.95


def spelt_grams(word):
    spelt = "^" + word + "$"
    return [spelt[max(0, k - toxicity.ORDER) : k + 1] for k in range(1, len(spelt))]


def brute_steps(rows):
    """Kneser-Ney steps of every symbol behind its context, of rows (text, toxic) over plain dictionaries, and what is left for unseen symbols."""
    counts = collections.defaultdict(lambda: [0, 0])
    for text, bad in rows:
        for word in words(text):
            for gram in spelt_grams(word):
                counts[gram][bad] += 1
    grams = {n: collections.Counter() for n in range(1, toxicity.LOWER + 1)}
    tails = {g: g[-min(len(g) - 1, toxicity.LOWER) :] for g in counts}
    for n in range(toxicity.LOWER, 0, -1):
        for t in tails.values():
            if len(t) == n:
                grams[n][t] += 1
        if n < toxicity.LOWER:
            for g in grams[n + 1]:
                grams[n][g[1:]] += 1

    def discount(one, two):
        return one / (one + 2 * two) if one else 0.5

    likely = {}
    for n in range(1, toxicity.LOWER + 1):
        values = list(grams[n].values())
        cut = discount(values.count(1), values.count(2))
        for g, c in grams[n].items():
            same = [x for h, x in grams[n].items() if h[:-1] == g[:-1]]
            lower = likely[g[1:]] if n > 1 else 1 / (len(grams[1]) + 1)
            likely[g] = (c - cut) / sum(same) + cut * len(same) / sum(same) * lower
    cuts = []
    for c in (0, 1):
        n = [max(sum(v[c] == k for v in counts.values()), 1) for k in (1, 2, 3, 4)]
        y = discount(n[0], n[1])
        cuts.append([0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1 * k), 0.9 * k) for k in (1, 2, 3))])
    after = collections.defaultdict(list)
    for g, v in counts.items():
        after[g[:-1]].append(v)
    left, out = {}, {}
    for parent, some in after.items():
        free = [sum(cuts[c][min(v[c], 3)] for v in some) / n if (n := sum(v[c] for v in some)) else 1.0 for c in (0, 1)]
        left[parent] = (free, [sum(v[c] for v in some) for c in (0, 1)])
    for g, v in counts.items():
        free, total = left[g[:-1]]
        p = [(v[c] - cuts[c][min(v[c], 3)]) / max(total[c], 1) + free[c] * likely[tails[g]] for c in (0, 1)]
        out[g] = math.log(p[1]) - math.log(p[0])
    return out, {g: math.log(free[1] / free[0]) for g, (free, _) in left.items()}


@pytest.mark.parametrize(("part", "known"), [(4_000_000, 4_000_000), (300, 20), (4_000_000, 0)])
def test_toxicity_is_kneser_ney(spark, texts, monkeypatch, part, known):
    monkeypatch.setattr(toxicity, "PART", part)
    monkeypatch.setattr(toxicity, "WORDS", known)
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij") for _ in range(1000))
    some = ["ärger", "abcdefghijklmnop", "abd", "ab", "xyz", "日本", long]
    rows = [(t, rng.random() < 0.3) for _, t in texts[:60]] + [(" ".join(rng.choice(some) for _ in range(9)), k % 2 == 0) for k in range(30)] + [(None, True), ("", False), ("abcdefghijklmnzz", True), ("abcdefghijklmnyy", False)]
    table = toxicity.steps(toxicity.count(spark.createDataFrame(rows, "text string, toxic boolean").repartition(3)))
    want, left = brute_steps(rows)
    got = collections.defaultdict(lambda: (0.0, 0.0))
    for r in table.collect():
        got[r["gram"]] = (got[r["gram"]][0] + r["gain"], got[r["gram"]][1] + r["left"])
    assert got.keys() == want.keys() | left.keys()
    for g in got:
        assert got[g] == pytest.approx((want[g] - left[g[:-1]] if g in want else 0.0, left.get(g, 0.0)), abs=1e-9)

    def value(word):
        return sum(want.get(g, left.get(g[:-1], 0.0)) for g in spelt_grams(word)) * min(1, toxicity.ORDER / len(spelt_grams(word)))

    asked = [*texts[50:80], *texts[-12:], (7, "abcdefghijklmnoq"), (7, "abcdefghijklmnoq"), (8, "zzz"), (9, long), (10, "abcdefghijklmnzz"), (11, "abcdefghijklmnyy"), (12, long[300:] + "q")]
    docs = spark.createDataFrame(asked, "doc_id long, text string")
    found = toxicity.features(docs, toxicity.word_values(docs, table)).collect()
    expected = []
    for i, t in asked:
        values = [value(w) for w in words(t)]
        expected.append((i or 0, max(values, default=0.0), sum(values) / len(values) if values else 0.0, math.log1p(len(values))))
    for mine, theirs in zip(sorted((r["doc_id"] or 0, r["peak"], r["mean"], r["length"]) for r in found), sorted(expected), strict=True):
        assert mine == pytest.approx(theirs, rel=1e-5, abs=1e-4)
    peaks = {r["doc_id"]: r["peak"] for r in found}
    assert peaks[10] > peaks[11]  # words that differ behind their fourteenth symbol


def test_toxicity_learns_from_few_toxic_rows(spark):
    """2 toxic rows in 3000, and none among the rows that would fit the curve: scores still differ."""
    rng = random.Random(3)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    train = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5]
    bad = set([i for i in train if zlib.crc32(str(i).encode()) // 5 % toxicity.FOLDS][:2])
    make = lambda last: " ".join([*(rng.choice(filler) for _ in range(11)), last])
    rows = [(i, make("vileword" if i in bad else rng.choice(filler))) for i in range(3000)] + [(9000, make("vileword")), (9001, make(filler[0]))]
    labels = spark.createDataFrame([(i, int(i in bad)) for i in range(3000)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert len({round(x, 9) for x in got.values()}) > 100
    assert got[9000] > 10 * got[9001]


def test_quality_sample_passes_over_what_does_not_fit(spark, monkeypatch):
    """A row beyond the bound is passed over and the next ones are taken; a row that repeats counts once."""
    monkeypatch.setattr(quality, "SAMPLE_INDICATORS", 2_000)
    rng = random.Random(2)
    huge = " ".join(str(rng.random()) for _ in range(3_000))
    rows = [(f"some words {i}", i % 2, i) for i in range(40)] + [(huge, 1, -5), *[("again and again", 0, 90)] * 500]
    sample = quality._sample(spark.createDataFrame(rows, "text string, good int, turn long").repartition(3))
    assert sample.num_rows == 41 and max(map(len, sample.column("buckets").to_pylist())) < 2_000
    assert quality._sample(spark.createDataFrame([], "text string, good int, turn long")).num_rows == 0


def test_quality_learns_from_one_row_of_a_class(spark):
    """1 row of label 0 in 6000, which a sample without regard to class would miss."""
    rng = random.Random(8)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    bad = next(i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 16 in (0, 1))
    rows = [(i, " ".join(rng.choice(filler) for _ in range(8)) + (" ### $$$ ###" if i == bad else "")) for i in range(6000)] + [(9000, "aaaa ### $$$ ###"), (9001, "aaaa bbbb cccc")]
    labels = spark.createDataFrame([(i, int(i != bad)) for i in range(6000)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert 1 - got[9000] > 10 * (1 - got[9001]) and got[bad] < got[9001]


def test_quality_scales_indicators_by_the_ratio_of_class_counts(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(4)), rng.randrange(2)) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    crc = lambda i: zlib.crc32(str(i).encode())
    from pyspark.sql import functions as F

    model = quality.fit(docs, labels, F.col("crc") % 4 != 2, F.col("crc") % 16 == 3)
    import pyarrow as pa

    counts = np.ones((2, quality.BUCKETS))
    for i, t, good in rows:
        if crc(i) % 4 != 2 and crc(i) % 16 != 3:
            counts[good][quality.indicators(pa.array([t]))[1]] += 1
    want = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.abs(model.ratios - want).max() < 1e-12


def test_dual_descent_meets_the_dual_conditions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.where(x[:, 0] > 0, 1.0, -1.0)
    w = quality.dual_descent([np.arange(4)] * 60, list(x), y, np.full(60, 10.0), 4)
    assert ((x @ w[:4] + w[4]) * y > 0).mean() > 0.95


def brute_scan(text):
    w = words(text)
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    more, best = set(), 0.0
    for label, template in licenses.TEMPLATES:
        tokens, width = set(template.split()), licenses.REACH * len(template.split())
        share = max((len(tokens & set(w[i : i + width])) / len(tokens) for i in range(len(w)) if w[i] in tokens), default=0.0)
        if share >= licenses.CONTAINMENT - 1e-12:
            more.add(label)
            best = max(best, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else best


def test_license_scan(spark, docs, none, texts):
    special = [(500, "Code, ALL\nrights (reserved). cc-by CC BY; General Public License"), (501, "Licensed under the Apache License, Version 2.0."), (502, "released under the Mit thing license"), (503, "Licensed under CC BY-NC 4.0. and more\nall rights"), (504, "KC BY"), (None, "all rights reserved"), (505, "permission is hereby granted free of charge to any person obtaining a copy of this software and documentation")]
    mit = "Permission is hereby granted, free of charge,\n# to any person obtaining a copy of this\n# software and associated documentation files"
    special += [(506, f"#!/bin/sh\n# {mit}\nx = 1"), (507, mit.replace(" of ", "\n")), (508, mit.replace("\n", "\n" + "word " * 20)), (509, "released\n\nunder the\nMIT license")]
    eight = "".join(f"/// dnl {w}\n" if k % 3 == 0 else f"{w} " for k, w in enumerate(mit.replace("#", "").split()))  # eight lines, each marked as a comment
    special += [(510, eight), (511, "x " * 400 + mit + " y" * 400 + " released under no license"), (512, "the of and to " * 2000)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(special, "doc_id long, text string"))
    assert [brute_scan(special[k][1])[5] for k in range(7, 14)] == ["mit", "mit", "", "mit", "mit", "mit", ""]
    got = collections.Counter(tuple(r) for r in licenses.scan(rows).collect())
    assert got == collections.Counter((i, *brute_scan(t)) for i, t in texts + special)
    assert licenses.scan(none).count() == 0
    plan = licenses.scan(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pieces_match_the_library_and_restore_every_text(spark, docs, none, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    special = [(900, "  two  spaces "), (901, "▁ a marker ▁▁"), (902, "日本\x00\t<s></s> <0x0A>\r\n"), (903, "aaaaaaaaaaaaaaa" * 30)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(special, "doc_id long, text string"))
    every = texts + special
    plain = pieces.encode(rows, rate=0.0).collect()
    by_id = collections.defaultdict(list)
    for i, t in every:
        by_id[i].append(t or "")
    for r in plain:
        if r["doc_id"] is not None and r["doc_id"] != 901:
            assert list(r["tokens"]) == library.encode(by_id[r["doc_id"]][0])
    for rate in (0.0, 0.3, 1.0):
        tokens = pieces.encode(rows, rate=rate)
        back = collections.Counter((r["doc_id"], r["text"]) for r in pieces.decode(tokens).collect())
        assert back == collections.Counter((i, t or "") for i, t in every)
    one, two, other = (sorted((r["doc_id"] or -1, tuple(r["tokens"])) for r in pieces.encode(d, rate=0.3, seed=s).collect()) for d, s in ((rows, 1), (rows.repartition(2), 1), (rows, 2)))
    assert one == two != other
    assert pieces.encode(none).count() == 0


def brute_dropout(vocabulary, text, limit, key):
    """The agenda of each chunk, one merge after another, over plain lists."""
    out = []
    for chunk in re.findall(r" +[^ ]*|[^ ]+", " " + text):
        symbols = [(vocabulary.of_point[ord(c)], i, i + 1) for i, c in enumerate(chunk)]
        mark = pieces.mix(pieces.Spans(np.frombuffer(chunk.encode(), np.uint8), fold=False).hashes(np.array([0]), np.array([len(chunk.encode())])) ^ key)
        while True:
            found = []
            for a, b in itertools.pairwise(symbols):
                piece = vocabulary.joined(np.array([a[0]]), np.array([b[0]]))[0]
                span = np.array([(a[1] << 42) + (b[1] << 21) + b[2]], np.uint64)
                if piece >= 0 and not pieces.mix(span ^ mark)[0] < limit:
                    found.append((vocabulary.rank[piece], a[1], piece))
            if not found:
                break
            _, at, piece = min(found)
            k = next(i for i, s in enumerate(symbols) if s[1] == at)
            symbols[k : k + 2] = [(piece, at, symbols[k + 1][2])]
        out += [int(s[0]) for s in symbols]
    return out


def test_dropout_skips_the_candidates_that_the_hash_names():
    import pyarrow as pa

    with open(pieces.MODEL, "rb") as f:
        vocabulary = pieces.Pieces.load(f.read())
    key = pieces.mix(np.array([12], np.uint64))
    for text in ("the theory of everything", "unbelievable  internationalization of ab"):
        ids, _ = vocabulary.encode(pa.array([text]), key, 0.4)
        assert ids.tolist() == brute_dropout(vocabulary, text, np.uint64(int(0.4 * 2.0**64)), key)


def brute_leaks(docs, items, threshold):
    w = {i: words(t) for i, t in items}
    n = len(items)
    df = collections.Counter(x for v in w.values() for x in set(v))
    idf = {x: math.log1p((n - c + 0.5) / (c + 0.5)) for x, c in df.items()}
    mean = sum(map(len, w.values())) / n
    stride = max(8, max(map(len, w.values())))
    found = set()
    for d, t in docs:
        own = words(t)
        for k in range(len(own) // stride + 1):
            window = set(own[k * stride : (k + 2) * stride])
            for i, v in w.items():
                impact = {x: idf[x] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(v) / mean)) for x, c in collections.Counter(v).items()}
                if window and impact and sum(s for x, s in impact.items() if x in window) / sum(impact.values()) >= threshold:
                    found.add((d, i, k * stride))
    return found


@pytest.mark.parametrize("most", [20_000, 9])
def test_decontamination(spark, docs, none, texts, monkeypatch, most):
    """One index and several parts find the same."""
    monkeypatch.setattr(decontam, "ITEMS", most)
    rng = random.Random(9)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 30)))) for i in range(60)] + [(60, texts[5][1]), (61, texts[5][1]), (62, "a b c d e f")]
    leaked = [(700 + k, texts[k][1] + " " + items[k][1].upper() + ". " + texts[k + 9][1]) for k in range(20)]
    every = texts + leaked
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(leaked, "doc_id long, text string"))
    table = spark.createDataFrame(items, "item_id long, text string")
    for threshold in (0.5, 0.6):
        got = {(r["doc_id"], r["item_id"], r["first_word"]) for r in decontam.leaks(rows, table, threshold).collect()}
        assert got == brute_leaks(every, items, threshold)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(rows, table).collect()}
    assert {(700 + k, k) for k in range(20)} <= found
    assert {(5, 60), (5, 61)} <= found
    assert decontam.contaminated(none, table).count() == 0
    assert decontam.contaminated(rows, table.filter("false")).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (None, items[3][1])], "item_id long, text string")
    assert decontam.leaks(rows, odd).filter("item_id is not null").count() == 0


def test_sharding_is_minimax_and_gapless(spark, docs, none, texts, monkeypatch):
    from pyspark.sql import functions as F

    keyed = docs.select(F.xxhash64("text").alias("k"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("s")).groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()
    sizes = [r["s"] for r in keyed]
    for cell, shards in ((50_000, 16), (3, 5), (3, 400)):
        monkeypatch.setattr(sharding, "CELL_ROWS", cell)
        out = sharding.shard(docs, shards).collect()

        def fits(capacity, shards=shards):
            used, left = 1, capacity
            for s in sizes:
                if s > capacity:
                    return False
                if s > left:
                    used, left = used + 1, capacity
                left -= s
            return used <= shards

        best = next(c for c in range(sum(sizes) // shards, sum(sizes) + 1) if fits(c))
        bytes_, slots, places = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
        for r in out:
            bytes_[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
            places[r["size"], r["text_crc32"]].add(r["shard"])
        assert max(bytes_.values()) == best
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert all(len(v) == 1 for (size, _), v in places.items() if size > 1)
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sharding.shard(none).count() == 0


def brute_repair(roles):
    nxt = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
    best = None

    def go(i, state, cost, turns):
        nonlocal best
        if i == len(roles):
            end = (cost + chat.ENDS[state][0], turns + chat.ENDS[state][1])
            best = min(best, end) if best else end
            return
        for to in (1, 2, 3):
            own = 0 if roles[i] == to else 2 if roles[i] == 0 else 3
            if to == state:
                go(i + 1, to, cost + own + 1, turns)
            for k in range(3):
                for inserted in itertools.product((1, 2, 3), repeat=k):
                    s, legal = state, True
                    for x in (*inserted, to):
                        legal &= x in nxt[s]
                        s = x
                    if legal:
                        go(i + 1, to, cost + own + 4 * k, turns + 1 + k)

    go(0, 0, 0, 0)
    return best


def test_chat_repair_costs_least_and_renders_legal_turns(spark):
    rng = random.Random(2)
    short = {c: [rng.randrange(4) for _ in range(rng.randrange(1, 5))] for c in range(60)}
    long = [rng.randrange(4) for _ in range(4000)]
    names = ("tool", "system", "User", "gpt")
    rows = [(c, i, names[r], None if i % 7 == 6 else f"t{i}", "x") for c, v in {**short, 99: long}.items() for i, r in enumerate(v)]
    rows += [(None, 0, None, None, "x"), (None, None, "user", "hi", "x"), (98, 1, "user", "same", "x"), (98, 1, "user", "same", "x")]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string").repartition(6)
    out = chat.repair(turns).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["conv_id"]].append(r)
    for c, v in short.items():
        assert sum(r["cost"] for r in by[c]) == brute_repair(v)[0]
    whole = chat.product(long)
    assert sum(r["cost"] for r in by[99]) == min(whole[0][s][0] + chat.ENDS[s][0] for s in range(4))
    for c, some in by.items():
        text = "".join(r["piece"] for r in sorted(some, key=lambda r: (r["turn"] is not None, r["turn"] or 0)))
        if c == 98:
            continue
        roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert roles[-1] == "assistant" and "system" not in roles[1:]
        assert all(a != b for a, b in itertools.pairwise(roles))
        assert text.count("<|im_end|>\n") == len(roles)
    assert chat.repair(turns.filter("false")).count() == 0


def brute_lines(rows, min_docs, keep_first):
    strip = " \t\n\x0b\x0c\r"
    keys = collections.defaultdict(set)
    order = {}
    distinct = {(i, t) for i, t in rows}
    for i, t in distinct:
        for n, line in enumerate((t or "").split("\n")):
            keys[line.strip(strip).translate(LOWER)].add((i, t))
    out = {}
    for i, t in distinct:
        for n, line in enumerate((t or "").split("\n")):
            key = line.strip(strip).translate(LOWER)
            order.setdefault(key, []).append((i, t, n))
    for i, t in distinct:
        kept = [line for line in (t or "").split("\n") if not (key := line.strip(strip).translate(LOWER)) or len(keys[key]) < min_docs]
        out[i, t] = "\n".join(kept)
    return out, keys


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_line_dedup(spark, docs, none, texts, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = [(800 + i, "Hot line\n" + f"own {i}\n \thOT lINE  \n") for i in range(60)] + [(870, "nine\nx"), *((871 + i, "nine") for i in range(8))]
        rows = docs.unionByName(spark.createDataFrame([(i, t, None, None, None, None) for i, t in hot], docs.schema))
        every = texts + hot
        bitmaps = lines.line_bitmaps(rows, 10, keep_first=False)
        got = collections.Counter((r["doc_id"], r["text"] or "") for r in lines.apply(rows, bitmaps).collect())
        want, keys = brute_lines(every, 10, False)
        assert got == collections.Counter((i, want[i, t]) for i, t in every)
        kept = lines.apply(rows, lines.line_bitmaps(rows, 10, keep_first=True)).select("doc_id", "text").distinct().collect()
        left = collections.Counter(k for r in kept for line in (r["text"] or "").split("\n") if (k := line.strip(" \t\n\x0b\x0c\r").translate(LOWER)))
        assert all(left[k] == 1 for k, where in keys.items() if k and len(where) >= 10)
        assert all(left[k] >= len(where) for k, where in keys.items() if k and len(where) < 10)
        once = lines.apply(rows, lines.line_bitmaps(rows)).select("doc_id", "text").distinct().collect()
        left = collections.Counter(k for r in once for line in (r["text"] or "").split("\n") if (k := line.strip(" \t\n\x0b\x0c\r").translate(LOWER)))
        assert set(left) == {k for k in keys if k} and set(left.values()) == {1}
        assert lines.apply(none, lines.line_bitmaps(none)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_components(rows, n, least):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("leaf", "node"), [(48, 20_000), (4, 20_000), (4, 10)])
def test_near_duplicates(spark, docs, none, texts, monkeypatch, leaf, node):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "NODE", node)
    got = neardup.near_duplicates(docs).collect()
    want = brute_components([(i, t) for i, t in texts if i is not None], 4, 80)
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_an_id_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (9, a + " x"), (3, b + " x"), (7, c)] + [(8, c)] * 30
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(3, 3, True), (5, 3, False), (5, 3, False), (5, 5, True), (7, 7, True)] + [(8, 7, False)] * 30 + [(9, 5, False)]
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == want


def test_near_duplicates_of_a_large_family_that_is_a_chain(spark):
    """2,000 texts of one template at 0.7; each is linked to its two neighbours only, so no link may be missed by the exact join."""
    rng = random.Random(3)
    ids = rng.sample(range(2_000), 2_000)
    template = [f"t{k}" for k in range(70)]
    rows = [(i, " ".join([*template, *(f"w{7 * at + k}" for k in range(15))])) for at, i in enumerate(ids)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 1).collect()
    assert len(got) == 2_000 and {r["component_id"] for r in got} == {0}


def joined(pairs, nodes):
    """The sets of nodes that pairs join."""
    of = {n: {n} for n in nodes}
    for a, b in pairs:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for n in of[b]:
                of[n] = of[a]
    return {frozenset(s) for s in of.values()}


@pytest.mark.parametrize("size", [2_048, 20])
def test_exact_links(spark, monkeypatch, size):
    """Links that are given are links, and with the components that are known they join what all links join."""
    monkeypatch.setattr(neardup, "BLOCK_SETS", size)
    rng = random.Random(8)
    sets = []
    for i in range(150):
        base = set(range(20)) if i % 2 else rng.choice(sets)[2] if sets else set(range(5))
        sets.append((i, i % 40, {*rng.sample(sorted(base), len(base) - rng.randint(0, 2)), *rng.sample(range(20, 40), rng.randint(0, 3))}))
    got = neardup.exact_links(spark.createDataFrame([(i, c, sorted(s)) for i, c, s in sets], "doc long, component long, shingles array<long>"), 80).collect()
    every = [(a, b) for (a, x, s), (b, y, t) in itertools.combinations(sets, 2) if 100 * len(s & t) >= 80 * len(s | t)]
    known = [(i, i % 40) for i, _, _ in sets]
    assert every and {tuple(sorted(g)) for g in got} <= set(every)
    assert joined([tuple(g) for g in got] + known, range(150)) == joined(every + known, range(150))


@pytest.mark.parametrize(("often", "columns"), [(8, 4_096), (1, 3), (1_000, 3), (3, 5)])
def test_common_shingles_of_two_blocks(monkeypatch, often, columns):
    monkeypatch.setattr(neardup, "OFTEN", often)
    monkeypatch.setattr(neardup, "COLUMNS", columns)
    rng = random.Random(2)
    blocks = [[set(rng.sample(range(60), rng.randint(0, 40))) | {99} for _ in range(n)] for n in (17, 23)]
    one, two = (neardup.Block(list(range(len(b))), [0] * len(b), [np.array(sorted(s), np.uint64) for s in b]) for b in blocks)
    assert neardup._common(one, two).tolist() == [[len(s & t) for t in blocks[1]] for s in blocks[0]]
    assert neardup._common(one, one).tolist() == [[len(s & t) for t in blocks[0]] for s in blocks[0]]


def test_near_duplicates_of_a_dense_family(spark):
    """1,200 texts that all share about 0.77 with one another, and 40 pairs of them just above the limit: all are found, nothing else."""
    rng = random.Random(4)
    common = [f"t{k}" for k in range(87)]
    own = [[f"w{i}x{k}" for k in range(13)] for i in range(1_200)]
    for i in range(0, 80, 2):
        own[i + 1][:3] = own[i][:3]
    order = rng.sample(range(1_200), 1_200)
    rows = [(place, " ".join(common + own[i])) for place, i in enumerate(order)]
    place = {i: p for p, i in enumerate(order)}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 1).collect()}
    want = {p: p for p in range(1_200)}
    for i in range(0, 80, 2):
        want[place[i]] = want[place[i + 1]] = min(place[i], place[i + 1])
    assert got == want


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[100] == got[95] == 90


def test_top_k_skips_blocks(spark):
    import pyarrow as pa

    rng = random.Random(7)
    sets = [[f"w{g}x{i}" for i in range(60)] for g in range(40)]
    rows = [" ".join(rng.choice(sets[k % 40]) for _ in range(30)) + " every text" for k in range(1_200)]
    word, _, _, sizes = topk._distinct(pa.array(rows))
    vocabulary, df = np.unique(word, return_counts=True)
    idf = np.log1p((len(rows) - df + 0.5) / (df + 0.5))
    shard = topk.Shard(np.arange(len(rows)), pa.array(rows), vocabulary, idf, sizes.mean())
    queries = [np.searchsorted(vocabulary, topk._distinct(pa.array([rows[k]]))[0]) for k in range(25)]
    got = {q: dict(zip(ids.tolist(), scores.tolist(), strict=True)) for q, ids, scores in shard.search(queries, np.zeros(25), 5)}
    counts = [collections.Counter(words(t)) for t in rows]
    weight = {w: math.log1p((len(rows) - n + 0.5) / (n + 0.5)) for w, n in collections.Counter(w for c in counts for w in c).items()}
    for q in range(25):
        scores = sorted((-round(sum(weight[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / sizes.mean())) for w in set(words(rows[q])) if w in c), 9), d) for d, c in enumerate(counts))[:5]
        assert got[q] == pytest.approx({d: -s for s, d in scores})
    assert shard.read < 0.2 * shard.all


def test_top_k_bounds_frequent_words_together(monkeypatch):
    """Every block has both words, but only few rows do: a bound by the sum of both maxima would read all blocks."""
    import pyarrow as pa

    every = min((f"w{k}" for k in range(100)), key=lambda w: topk._distinct(pa.array([w]))[0][0])  # the first by hash, by which rows are laid in blocks
    rows = [f"{every} red bolt"] * 16 + [f"{every} red rod" if k % 2 else f"{every} old bolt" for k in range(1_600)]
    word, _, _, sizes = topk._distinct(pa.array(rows))
    vocabulary, df = np.unique(word, return_counts=True)
    idf = np.log1p((len(rows) - df + 0.5) / (df + 0.5))
    shard = topk.Shard(np.arange(len(rows)), pa.array(rows), vocabulary, idf, sizes.mean())
    asked = np.searchsorted(vocabulary, topk._distinct(pa.array(["red bolt"]))[0])
    first = list(shard.search([asked], np.zeros(1), 10))
    shard.read = shard.all = 0
    again = list(shard.search([asked], np.array([first[0][2].min()]), 10))
    assert [x[1].tolist() for x in (*first, *again)] == [list(range(10))] * 2
    assert shard.read < 0.1 * shard.all
    monkeypatch.setattr(topk, "IMPACTS", 2_000)
    few = topk.Shard(np.arange(len(rows)), pa.array(rows), vocabulary, idf, sizes.mean())
    assert few.exact.size <= 2_000 and [x[1].tolist() for x in few.search([asked], np.zeros(1), 10)] == [list(range(10))]


@pytest.mark.parametrize("most", [4_000_000, 400])
def test_top_k_is_exact(spark, docs, none, texts, monkeypatch, most):
    """One block of queries and several find the same."""
    monkeypatch.setattr(topk, "QUERY_WORDS", most)
    monkeypatch.setattr(topk, "SHARD_BYTES", 3_000)
    queries = docs.filter("doc_id % 10 = 0")
    got = collections.defaultdict(list)
    for r in topk.top_k(docs, queries, 5).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    rows = [(i, t) for i, t in texts if i is not None]
    counts = [collections.Counter(words(t)) for _, t in rows]
    mean = sum(sum(c.values()) for c in counts) / len(rows)
    df = collections.Counter(w for c in counts for w in c)
    for i, t in dict(rows).items():
        if i % 10:
            continue
        scores = []
        for (d, _), c in zip(rows, counts, strict=True):
            s = sum(math.log1p((len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set(words(t)) if w in c)
            if s > 0:
                scores.append((-s, d))
        best = sorted((round(s, 8), d) for s, d in scores)[:5]
        mine = [(round(-s, 8), d) for _, d, s in sorted(got[i])]
        assert [s for s, _ in mine] == pytest.approx([s for s, _ in best])
        assert [d for _, d in sorted(mine)] == [d for _, d in best]
    assert topk.top_k(none, none).count() == 0
    assert topk.top_k(docs, none).count() == 0


@pytest.mark.parametrize("known", [False, True])
def test_top_k_of_a_shard_in_small_steps(monkeypatch, known):
    """Rows of three vocabularies in many groups, and every list, product and sum cut small: the same rows as by brute force, whatever is skipped."""
    import pyarrow as pa

    for name, value in {"GROUP": 50, "AT_ONCE": 7, "TOGETHER": 3, "SUMS": 200, "POSTINGS": 40, "MOST": 20}.items():
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(9)
    rows = [" ".join(f"{'abc'[k % 3]}{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([1, 5, 30, 30, 400]))) for k in range(600)] + ["", None, "only"]
    rows += rows[:20]
    ids = np.array(rng.sample(range(5_000), len(rows)))
    word, row, times, sizes = topk._distinct(pa.array(rows))
    vocabulary, df = np.unique(word, return_counts=True)
    idf, mean = np.log1p((len(rows) - df + 0.5) / (df + 0.5)), sizes.mean()
    impact = np.zeros((len(rows), len(vocabulary)))
    term = np.searchsorted(vocabulary, word)
    impact[row, term] = idf[term] * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * sizes[row] / mean))
    queries = [np.unique(term[row == k]) for k in range(0, len(rows), 4)]
    scores = np.array([np.round(impact[:, q].sum(1), 9) for q in queries])
    least = np.sort(scores, 1)[:, -12] if known else np.zeros(len(queries))
    index = next(topk._indices(topk._index(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows)], ["doc_id", "text"])]))))
    shard = topk.Shard.of(index, vocabulary, idf, mean)
    got = {q: list(zip(np.round(values, 7).tolist(), found.tolist(), strict=True)) for q, found, values in shard.search(queries, least, 10)}
    for q, own in enumerate(scores):
        want = [(round(own[d], 7), int(ids[d])) for d in np.lexsort((ids, -own))[:10] if own[d] > 0]
        assert got.get(q, []) == want
    assert len(shard.parts) > 10 and shard.read < (0.25 if known else 0.5) * shard.all


def test_top_k_takes_texts_apart_once(spark, docs, monkeypatch):
    """However many blocks the queries make, each text is read as often."""
    counts = []
    for most in (4_000_000, 200):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        monkeypatch.setattr(topk, "QUERY_WORDS", most)
        watched = docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string")
        assert topk.top_k(watched, docs.filter("doc_id % 10 = 0"), 5).count() > 0
        counts.append(seen.value)
    assert counts[0] == counts[1] > 0


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path, docs, labels, texts):
    import corpus_pipeline

    from pyspark.sql import functions as F

    items = [(0, texts[11][1]), (1, None)]
    docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    assert 11 not in ids
    assert len({i for i in ids if i is not None and 190 <= i < 210}) <= 1
    assert all(r["n_tokens"] > 0 for r in out if r["n_bytes"])
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, str(tmp_path))
        assert after.columns == rows.columns, name
        assert stage(spark, rows.filter("false"), str(tmp_path)).count() == 0
    sha = {r["doc_id"]: r["text_sha256"] for r in corpus_pipeline.tokenize(spark, rows, str(tmp_path)).collect()}
    assert all(sha[i] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts if i is not None)


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_query_matches_its_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got, want = registered.QUERIES[name](spark, FOLDER), connection.execute(registered.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
