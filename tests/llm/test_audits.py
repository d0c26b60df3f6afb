"""Divergence, collocations and quality rules against brute-force versions, with nulls, empties, ties, repeats and clashing columns."""

import collections
import math
import random
import re
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import base, divergence, lines, neardup, phrases, rules, toxicity
from tidemark.llm.runs import Runs

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


@pytest.fixture(scope="module")
def rows():
    """doc_id, lang, source and text: few words, so that phrases repeat and ties are common."""
    rng = random.Random(11)
    vocabulary = ["the", "of", "The", "red", "Fox", "naïve", "x1", "a_b", "Äpfel", "zu", "k"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(n))
    out = [(i, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s4", "é", None]), make(rng.randint(0, 60))) for i in range(150)]
    out += [(200, "en", "s1", None), (201, "en", "empty", ""), (202, "fr", "only", "un deux. trois"), (203, None, None, None), (None, "en", "s2", make(30)), (None, None, "s9", " \n\t"), (204, "de", "long", make(6000)), (205, "xx", "s1", "1 2 3"), (205, "xx", "s2", None)]
    return out + [out[3], out[3], out[4]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(*r, 7, "t", 3, "k") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, lang string, source string, text string, n long, term string, rank int, key string").repartition(5)


def sorted_rows(frame, columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def brute_phrases(rows, least, covered, top):
    f = collections.defaultdict(collections.Counter)
    for _, lang, _, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for w, c in counts.items() if len(w) == 1)
        good = {w: c for w, c in counts.items() if len(w) > 1 and c >= least}
        found = []
        for w, a in good.items():
            if any(len(x) == 3 > len(w) and w in (x[:2], x[1:]) and 100 * c >= covered * a for x, c in good.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[w[:k]] * counts[w[k:]]), k) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "covered", "top"), [(3, 50, 12), (10, 50, 2000), (2, 101, 7)])
def test_collocations(docs, rows, least, covered, top):
    got = sorted_rows(phrases.collocations(docs, least, covered, top), ["lang", "rank", "phrase", "a", "l", "r", "n", "score"])
    assert got == brute_phrases(rows, least, covered, top)


def test_collocations_of_nothing(docs):
    assert phrases.collocations(docs.filter("false")).count() == 0
    assert phrases.collocations(docs.filter("doc_id = 201")).count() == 0


def test_words_are_numbered_anew_after_a_clash(docs, monkeypatch):
    right = phrases.Numbered.__init__

    def clash(self, langs, texts, seed):
        right(self, langs, texts, seed)
        if seed == 0:
            self.numbers = self.numbers % 3

    monkeypatch.setattr(phrases.Numbered, "__init__", clash)
    found = phrases._roots(0)
    assert found is not None
    table, seed = phrases.words(docs)
    assert seed in (0, 1)  # workers that were forked before the patch number rightly
    assert table.count() == table.select("number").distinct().count()


def test_gate_never_denies_a_member(spark):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 4000)
    gate = phrases.gate(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert gate.holds(keys).all()
    assert gate.holds(np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 4000)).mean() < 0.1
    assert not phrases.gate(spark.createDataFrame([], "key long")).holds(keys).any()


def test_runs_add_up_what_they_merge():
    rng, want, runs = np.random.default_rng(3), collections.Counter(), Runs(2, merge=50, send=20)
    got = collections.Counter()
    for _ in range(40):
        pair, times = np.unique(rng.integers(0, 6, (9, 2)), axis=0, return_counts=True)
        for (a, b), n in zip(pair.tolist(), times.tolist(), strict=True):
            want[a, b] += n
        for (a, b, n), _ in runs.add([pair[:, 0], pair[:, 1], times]):
            got.update({(x, y): z for x, y, z in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)})
    for (a, b, n), _ in runs.rest():
        got.update({(x, y): z for x, y, z in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)})
    assert got == want


def brute_divergence(rows, least_docs, top):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, lang, source, text in rows]
    out = []
    for lang in {x[0] for x in texts}:
        own = [(s, w) for g, s, w in texts if g == lang]
        in_docs = collections.Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t, n in in_docs.items() if n >= least_docs)
        count = collections.defaultdict(collections.Counter)
        for s, w in own:
            count[s].update(t for t in w if t in set(kept))
        for s, w in own:
            count[None].update(t for t in w if t in set(kept))
        share = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in ((s, count[s]) for s in {None, *(s for s, _ in own)})}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in share:
            if s is None:
                continue
            pairs = sorted((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in share if o not in (None, s))
            out += [(lang, s, "pair", o.decode(), -v, rank) for rank, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-f(share[s][t], share[None][t]), t.encode()) for t in kept if count[s][t] and share[s][t] > share[None][t])
            out += [(lang, s, "term", t.decode(), -v, rank) for rank, (v, t) in enumerate(terms[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least_docs", "block"), [(10, 256), (2, 2), (1, 1), (1000, 3)])
def test_divergence(docs, rows, least_docs, block):
    got = sorted_rows(divergence.divergence(docs, least_docs, 3, block), ["lang", "source", "part", "item", "value", "rank"])
    assert got == brute_divergence(rows, least_docs, 3)


def test_divergence_of_nothing(docs):
    assert divergence.divergence(docs.filter("false")).count() == 0


def test_pairs_are_priced_in_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 3)
    got = sorted_rows(divergence.divergence(docs, 2, 3, 3), ["lang", "source", "part", "item", "value", "rank"])
    assert got == brute_divergence(rows, 2, 3)


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    under = {k + d for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for d in range(8)}
    how_many = lambda signs: sum(text.count(c) for c in signs)
    base = (len(w), sum(map(len, w)), how_many("#*$%&|<>"), again, len(under), len(w) < 20 or 100 * len(under) > 30 * len(w))
    if base[-1]:
        return base, None
    root = lambda k: math.asin(math.sqrt(k / base[1]))
    return base, [math.log(base[1]) - math.log(len(w)), root(base[2]), root(how_many(UPPER)), root(how_many(".,;:!?")), math.log(len(set(w))) / math.log(len(w))]


def brute_estimate(x):
    """Centre and inverse scatter of the rows of x by concentration steps from both starts."""
    floor = np.array(rules.FLOOR)

    def middle(bins):
        return np.sort(bins)[-(-len(bins) // 2) - 1]

    bins = np.floor(x / rules.BIN).astype(int)
    centre = np.array([middle(b) for b in bins.T])
    wide = np.maximum(1.4826 * rules.BIN * np.array([middle(np.abs(b - c)) for b, c in zip(bins.T, centre, strict=True)]), floor)
    m = (centre + 0.5) * rules.BIN
    z = (x - m) / wide
    signs = 5 * (z / np.sqrt(np.maximum((z**2).sum(1), 1e-12))[:, None]).T @ (z / np.sqrt(np.maximum((z**2).sum(1), 1e-12))[:, None]) / len(x)
    best = []
    for c in (np.diag(wide**2), signs * np.outer(wide, wide) + np.diag(floor**2)):
        best.append((0, m, c))
    for step in range(rules.STEPS):
        after = []
        for _, m, c in best:
            p = np.linalg.inv(c)
            bin = np.floor(16 * np.log2(np.maximum(np.einsum("ij,jk,ik->i", x - m, p, x - m), 1e-6)))
            order = np.sort(bin)
            inner = x[bin <= order[math.ceil(rules.INNER * len(x)) - 1]]
            c = rules.NORMAL * np.cov(inner.T, bias=True) + np.diag(floor**2)
            after.append((np.linalg.slogdet(c)[1], inner.mean(0), c))
        fall = max(a[0] - b[0] for a, b in zip(best, after, strict=True))
        best = after
        if step and fall < rules.FALL:
            break
    _, m, c = min(best, key=lambda b: b[0])
    return m, np.linalg.inv(c)


def brute_rules(rows):
    told = [(lang or "", source or "", *brute_counts(text)) for _, lang, source, text in rows]
    sizes = collections.Counter((g, s) for g, s, _, x in told if x is not None)
    langs = collections.Counter()
    for (g, _), n in sizes.items():
        langs[g] += n if n < rules.LEAST_ROWS else 0
    rest = sum(n for n in langs.values() if n < rules.LEAST_ROWS)

    def key(g, s):
        return (g, s) if sizes[g, s] >= rules.LEAST_ROWS else (g,) if langs[g] >= rules.LEAST_ROWS else () if rest >= rules.FEWEST else None

    groups = collections.defaultdict(list)
    for g, s, _, x in told:
        if x is not None and key(g, s) is not None:
            groups[key(g, s)].append(x)
    fitted = {k: brute_estimate(np.array(x)) for k, x in groups.items()}
    out = []
    for g, s, base, x in told:
        kept = not base[-1]
        if kept and key(g, s) is not None:
            m, p = fitted[key(g, s)]
            kept = (np.array(x) - m) @ p @ (np.array(x) - m) * base[0] / (base[0] + rules.SHORT) <= rules.CUT
        out.append((*base, bool(kept)))
    return out


@pytest.fixture(scope="module")
def prose():
    """Texts of a large, a middling and many small sources, with junk of several kinds."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(500)]

    def make(n):
        w = [rng.choice(vocabulary) for _ in range(n)]
        return "".join(x + ("." if rng.random() < 0.15 else "") + ("\n" if rng.random() < 0.05 else " ") for x in w)

    out = []
    for i in range(700):
        lang, source = ("en", "big") if i % 3 else rng.choice([("en", f"s{i % 20}"), ("de", f"s{i % 9}"), (None, None), ("xx", "tiny")] if i < 680 else [("yy", "y")])
        text = make(rng.randint(10, 120))
        junk = rng.random()
        if junk < 0.05:
            text = text.upper()
        elif junk < 0.1:
            text = " ".join(w + rng.choice(["###", "$$$"]) for w in text.split())
        elif junk < 0.15:
            text = text + " " + text
        elif junk < 0.2:
            text = "same line of text here\n" * rng.randint(1, 9) + text
        out.append((i, lang, source, text))
    out += [(900, "en", "big", None), (901, "en", "big", ""), (902, "en", "big", " \n\x0b "), (903, "en", "big", make(9000)), (None, "en", "big", make(50)), (None, None, None, None), out[1], out[1]]
    return out


def test_rules(spark, prose):
    docs = spark.createDataFrame([(*r, "x", 1.5, True) for r in prose], "doc_id long, lang string, source string, text string, key string, distance double, kept boolean").repartition(4)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted_rows(rules.judge(docs), columns)
    want = brute_rules(prose)
    assert got == sorted(((r[0], *w) for r, w in zip(prose, want, strict=True)), key=repr)
    assert sum(not w[-1] and not w[-2] for w in want) > 40  # junk that only the distance finds


def test_rules_of_few_rows(spark, prose):
    docs = spark.createDataFrame(prose, "doc_id long, lang string, source string, text string")
    assert rules.judge(docs.filter("false")).count() == 0
    few = rules.judge(docs.filter("doc_id < 15")).collect()
    assert len(few) == 17
    assert all(r["kept"] != r["base_failed"] and r["distance"] is None for r in few)


def test_rules_of_equal_texts(spark):
    text = "one two three four five six seven eight nine ten a b c d e f g h i j k."
    docs = spark.createDataFrame([(i, "en", "s", text if i else "# " * 30 + text) for i in range(150)], "doc_id long, lang string, source string, text string")
    assert [r["doc_id"] for r in rules.judge(docs).filter("not kept").collect()] == [0]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_collocations_of_many_texts_fit_a_task(depth):
    """A task's own arrays stay below 90 MB, however many texts it counts (99 to 128 MB with slices of 2 MB)."""
    rng = random.Random(3)
    known = [f"w{k}" for k in range(20_000)]
    texts = [" ".join(rng.choices(known, k=600)) for _ in range(2_000)]
    batches = (pa.RecordBatch.from_arrays([pa.array(["en"] * 500), pa.array(texts[k : k + 500])], ["lang", "text"]) for k in range(0, len(texts), 500))
    every = phrases.Gate(np.full(1 << 10, -1, np.int64).view(np.uint64))
    task = phrases._roots(0) if depth == 1 else phrases._paths(depth, 0, types.SimpleNamespace(value=every))
    tracemalloc.start()
    try:
        found = sum(batch.column("times").to_numpy().sum() for batch in task(batches))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == len(texts) * (601 - depth)
    assert peak < 90e6


@pytest.mark.parametrize(("step", "most"), [(lines._lines(1), 60e6), (toxicity._counts, 60e6), (toxicity._distinct, 60e6), (neardup._profiles(5), 60e6)], ids=["lines", "counts", "distinct", "profiles"])
def test_memory_of_a_step_over_texts(step, most):
    """A step of the pipeline holds little besides the batch that it was sent, of 8 MB here; with lines in slices of 4 MB it was 196 MB."""
    rng = random.Random(5)
    known = [f"w{k}" for k in range(5_000)]
    texts = ["\n".join(" ".join(rng.choices(known, k=60)) for _ in range(12)) for _ in range(1_900)]
    columns = {"doc_id": pa.array(range(1_900)), "text_hash": pa.array(range(1_900)), "text": pa.array(texts), "toxic": pa.array([k % 9 == 0 for k in range(1_900)])}
    names = ["text", "toxic"] if step is toxicity._counts else ["text"] if step is toxicity._distinct else ["doc_id", "text_hash", "text"]
    batch = pa.RecordBatch.from_arrays([columns[n] for n in names], names)
    tracemalloc.start()
    try:
        found = sum(one.num_rows for one in step(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found
    assert peak < most, peak


def test_kept_lines_of_a_long_batch():
    """Cut texts come back in slices, in order, with nulls and texts that lose nothing."""
    texts = [None, "", *("\n".join(f"{k} {j} " + "x" * 2_000 for j in range(50)) for k in range(20)), "a\nb"]
    gone = [np.zeros(1 if not t else t.count("\n") + 1, bool) for t in texts]
    for k in range(2, 22):
        gone[k][k % 50 :: 3] = True
    packed = pa.array([lines.zlib.compress(np.packbits(~g).tobytes()) for g in gone], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), *(pa.array([int(f(g)) for g in gone]) for f in (len, np.sum)), packed], ["rest", "text", "n_lines", "n_dropped", "keep"])
    found = list(lines._kept(iter([batch])))
    assert len(found) > 2
    assert [x for one in found for x in one.column("rest").to_pylist()] == list(range(len(texts)))
    assert [x for one in found for x in one.column("text").to_pylist()] == [t if not g.any() else "\n".join(x for x, cut in zip(t.split("\n"), g, strict=True) if not cut) for t, g in zip(texts, gone, strict=True)]


def test_texts_are_sent_by_bytes(spark):
    """Long texts come to Python some 2 MB at a time, whole, and the session's setting stays as it was."""
    before = spark.conf.get(base._BYTES)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    texts = spark.range(0, 120, 1, 1).selectExpr("repeat(cast(id % 10 as string), 100000) as text")
    sent = base.written_by_bytes(texts.mapInArrow(sizes, "n long, bytes long")).collect()
    assert sum(r["n"] for r in sent) == 120 and sum(r["bytes"] for r in sent) >= 12_000_000
    assert max(r["bytes"] for r in sent) < 2 * base.SENT
    assert spark.conf.get(base._BYTES) == before
