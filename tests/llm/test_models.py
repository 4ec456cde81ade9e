"""Context mixing, lattice hashing and top-k search against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lattice, mixing, topk


def test_mixing_counts_and_probabilities(spark, monkeypatch):
    monkeypatch.setattr(mixing, "VOCABULARY", 20)
    monkeypatch.setattr(mixing, "WORDS_A_POWER", 0)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(60)] + ["É", "A\tB"], rng.integers(0, 60)))) for i in range(300)] + [(300, None), (301, ""), (None, "w1 w2"), (7, "x" * 70_000), (303, "W1 " * 20_000)]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(5)
    got = mixing.score(frame).collect()
    assert len(got) == len(rows)
    split = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split() + [b" "]
    counts = Counter(w for i, t in rows if not split(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), split(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert mixing.score(frame.limit(0)).count() == 0


def test_mixing_learns_what_repeats(spark):
    rng = np.random.default_rng(8)
    fresh = [" ".join(rng.choice([f"v{k}" for k in range(3000)], 60)) for _ in range(120)]
    rows = [(i, "the same few words come again and again") for i in range(80)] + [(1000 + i, fresh[i]) for i in range(120)] + [(2000 + i, fresh[i]) for i in range(30)]
    got = {r.doc_id: r for r in mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert max(got[i].bits_per_byte for i in range(80)) < 0.5
    assert all(got[i].score > got[i].base_score for i in range(80))
    assert len({round(got[i].score, 4) for i in range(80) if not got[i].held_out}) == 1
    # copies stand out from texts that are there once, since a text's own counts are taken out
    once = min(got[1000 + i].bits_per_byte for i in range(30, 120))
    twice = [got[k + i].bits_per_byte for i in range(30) for k in (1000, 2000) if not got[3000 - k + i].held_out]
    assert max(twice) < once


def plain_state(zeros, ones, less):
    """Log odds and level of two counts, without one occurrence of the bit ``less`` where they are few."""
    if zeros + ones > mixing.EXACT:
        ratio = round(math.log((ones + 0.2) / (zeros + 0.2)) / mixing.STEP)
        return min(max(ratio, -(mixing.RATIOS // 2)), mixing.RATIOS - 1 - mixing.RATIOS // 2) * mixing.STEP, 3
    level = lambda n: 0 if n < 0.5 else 1 if n < 2.5 else 2 if n < 12.5 else 3
    n = zeros + ones
    if less is not None:
        zeros, ones, n = max(0, zeros - (less == 0)), max(0, ones - (less == 1)), max(0, n - 1)
    return math.log((ones + 0.2) / (zeros + 0.2)), level(n)


def plain_score(docs, held, book, weights, table):
    """Each text's cost in nats by dictionaries and loops over bits."""
    vocabulary = {}
    for words in docs:
        for w in words:
            s = int(book.symbols(mixing.words_in([w])[3])[0])
            vocabulary[w] = s
    code = lambda kind, s: [divmod(int(book.paths[kind][1][i]), 2) for i in range(book.paths[kind][0][s], book.paths[kind][0][s + 1])]
    symbol = lambda w: book.escape if vocabulary[w] < 0 else vocabulary[w]

    def tokens(words):
        """(symbol, marker, two words before, bytes) of each token."""
        marker = 0
        for i, w in enumerate([*words, None]):
            s = book.end if w is None else symbol(w)
            yield s, marker, (words[i - 1] if i > 0 else None, words[i - 2] if i > 1 else None), (w + b" " if w is not None and vocabulary[w] < 0 else b"")
            if w is not None and 0 <= vocabulary[w] < mixing.MARKERS:
                marker = vocabulary[w] + 1

    pairs, marked, spelt = {}, Counter(), Counter()
    nodes = [Counter(), Counter()]
    for s, c in enumerate(book.counts):
        for node, bit in code(0, s):
            nodes[0][node, bit] += max(1, int(c))
    letters = np.zeros(256, int) + 1
    for words in docs if not held else [d for d, h in zip(docs, held, strict=True) if not h]:
        letters += np.bincount(np.frombuffer(b"".join(w + b" " for w in words) or b"", "u1"), minlength=256)
    for words, h in zip(docs, held, strict=True):
        if h:
            continue
        for s, m, two, raw in tokens(words):
            pairs.setdefault(two, Counter())[s] += 1
            for node, bit in code(0, s):
                marked[m, node, bit] += 1
            for i, c in enumerate(raw):
                for node, bit in code(1, c):
                    for k in mixing.SPANS:
                        spelt[k, raw[max(0, i - k) : i], node, bit] += 1
    out = []
    for words, h in zip(docs, held, strict=True):
        own_pairs, last, streams = {}, {}, [[], [], []]
        for s, _, two, _ in tokens(words):
            own_pairs.setdefault(two, Counter())[s] += 1
        for place, (s, m, two, raw) in enumerate(tokens(words)):
            step = 0 if place < mixing.STEP_WORDS else (place // mixing.STEP_WORDS).bit_length()
            share = lambda x: math.log(book.counts[x] / (book.counts.sum() - book.counts[x]))
            seen = pairs.get(two, Counter())
            guess, kind, run = -1, 0, 0.0
            if seen:
                most = max(seen.values())
                top = min(x for x, c in seen.items() if c == most)
                c, o = min(15, most), min(15, sum(seen.values()) - most)
                if not h and c < 15 and o < 15:
                    c, o = max(0, c - own_pairs[two][top]), max(0, o - (sum(own_pairs[two].values()) - own_pairs[two][top]))
                if c:
                    guess = top
                    kind = (1 if c == 1 else 2 if c < 4 else 3) if o == 0 else 4 if c >= 2 * o else 5
                    run = max(0.1, math.log((c + 0.5) / (o + 0.5)))
            again = last.get(two, -1)
            last[two] = s
            if guess >= 0:
                agree = 0 if again < 0 else 1 if again == guess else 2
                streams[0].append((step, kind * 3 + agree, [share(guess), 1.0, run, 1.5 * (0, 1, -1)[agree]], int(guess == s), None))
            if again >= 0 and again != guess and guess != s:
                streams[0].append((step, 18 + (guess >= 0), [share(again), 1.0, 0.0, 1.5], int(again == s), None))
            if s not in (guess, again):
                for depth, (node, bit) in enumerate(code(0, s)):
                    less = None if h else bit
                    zero, one = nodes[0][node, 0] - (less == 0), nodes[0][node, 1] - (less == 1)
                    x, level = plain_state(marked[m, node, 0], marked[m, node, 1], less)
                    streams[1].append((step, mixing.FLAG_GATES + min(depth // 2, 3) * 4 + level, [math.log((max(0, one) + 0.2) / (max(0, zero) + 0.2)), x], bit, (node, 0)))
            for i, c in enumerate(raw):
                for node, bit in code(1, c):
                    less = None if h else bit
                    count = [int(sum(letters[y] for y in range(256) if (node, z) in code(1, y))) - (less == z) for z in (0, 1)]
                    xs = [plain_state(spelt[k, raw[max(0, i - k) : i], node, 0], spelt[k, raw[max(0, i - k) : i], node, 1], less) for k in mixing.SPANS]
                    gate = mixing.FLAG_GATES + mixing.WORD_GATES + sum(x[1] << (2 * (len(xs) - 1 - j)) for j, x in enumerate(xs))
                    streams[2].append((step, gate, [math.log((count[1] + 0.2) / (count[0] + 0.2)), *(x[0] for x in xs)], bit, (node, 1)))
        cost = 0.0
        for stream in streams:
            fix = np.zeros(4)
            for step in sorted({x[0] for x in stream}):
                slope, square = np.zeros(4), np.zeros(4)
                for _, gate, x, bit, context in (y for y in stream if y[0] == step):
                    x = np.array([*x, 0, 0][: max(4, len(x))] if len(x) < 4 else x)
                    mixed = float((weights[:, gate] + fix) @ x)
                    p = 1 / (1 + math.exp(-max(-30, min(30, mixed))))
                    where = gate if context is None else ((context[0] * 2 + context[1]) * 0x9E3779B1 & 0xFFFFFFFF) >> 22
                    at = (max(-mixing.REACH, min(mixing.REACH - 1e-3, mixed)) + mixing.REACH) * (mixing.POINTS - 1) / (2 * mixing.REACH)
                    near = table[where, int(at)] + (table[where, int(at) + 1] - table[where, int(at)]) * (at - int(at))
                    cost -= math.log(abs(1 - bit - (near + p) / 2))
                    slope += (bit - p) * x
                    square += x * x
                fix += float(mixing.OWN_RATE) * slope / (square + float(mixing.OWN_HOLD))
        out.append(cost)
    return out


def test_mixing_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(mixing, "VOCABULARY", 30)
    monkeypatch.setattr(mixing, "WORDS_A_POWER", 0)
    rng = np.random.default_rng(6)
    lines = [" ".join(rng.choice([f"w{k}" for k in range(12)] + ["alpha", "beta", "ing", "tion"] * 2 + [f"rare{k}x" for k in range(30)], 7)) for _ in range(12)]
    texts = [" ".join(rng.choice(lines, rng.integers(0, 24))) for _ in range(60)] + ["", "w1", "w1 w1 w1 w1 w1 w1 w1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in mixing.score(rows).collect()}
    held = [got[i].held_out for i in range(len(texts))]
    assert any(held) and not all(held)
    training = rows.where(~F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)).eqNullSafe(2))
    _, folder, weights, table, _, _ = mixing.learn(training, slots=5000)  # so many that no two contexts meet
    book = mixing.Book(folder)
    costs = mixing.costs(book, mixing.tokens_of(book, [t.encode() for t in texts]), ~np.array(held), weights, table)
    want = plain_score([t.encode().split() for t in texts], held, book, weights.astype("f8"), table)
    assert np.allclose(costs, want, rtol=1e-4, atol=1e-3)
    assert np.allclose([-got[i].score * math.log(10) for i in range(len(texts))], want, rtol=0.02, atol=0.1)


def test_mixing_learns_from_every_bit(spark, tmp_path):
    texts = ["a b c a b", "", "c c zz", "b a"] * 20
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    _, folder, _, _, n, v = mixing.learn(rows)
    assert (n, v) == (sum(len(t.split()) + 1 for t in texts), 5)
    book = mixing.Book(folder)
    streams = mixing.bits_of(book, mixing.tokens_of(book, [t.encode() for t in texts]), np.ones(len(texts), bool))
    got = mixing.lessons(rows.coalesce(1), folder).collect()
    assert sum(r.n for r in got if r.i >= 0) == mixing.INPUTS * sum(len(b.bit) for b in streams)
    assert sum(r.n for r in got if r.i < 0) == sum(len(b.bit) for b in streams)


def test_mixing_corrections_follow_a_text():
    rng = np.random.default_rng(1)
    bit = rng.integers(0, 2, 6000).astype("i1")
    runs = np.array([[0, 0, 1, 2, 3], [0, 1, 0, 0, 0], [500, 1000, 500, 1000, 3000]])
    odds = np.stack([np.zeros(6000), np.where(bit == 1, 2.0, -2.0)]).astype("f4")  # the second input is right
    got = mixing.along_texts(np.zeros((2, 4), "f4"), mixing.Bits(runs, bit, np.zeros(6000, "i8"), odds, np.zeros(6000, "i8")), 2)
    assert (got[:1500] == 0).all()
    assert ((got[1500:] > 0) == (bit[1500:] == 1)).all() and np.abs(got[3000:]).min() > np.abs(got[1500:2000]).min()


def test_mixing_refinement_corrects_what_is_too_sure():
    counts = np.zeros((mixing.REFINED, mixing.POINTS, 2))
    empty = mixing.refinement(counts)
    x = np.linspace(-6, 6, 50).astype("f4")
    assert np.allclose(mixing.refined(x, np.zeros(50, "i8"), empty), 1 / (1 + np.exp(-x)), atol=0.02)
    counts[3, :] = 500, 500
    assert abs(mixing.refined(np.array([4.0], "f4"), np.array([3]), mixing.refinement(counts))[0] - (0.5 + 0.982) / 2) < 0.01


def test_states_keep_two_counts():
    zeros, ones = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    s = mixing.states(zeros, ones).astype(int)
    for less in (None, 0, 1):
        base = 0 if less is None else 256 * (1 + less)
        want = [plain_state(int(a), int(b), less) for a, b in zip(zeros, ones, strict=True)]
        assert np.allclose(mixing.STATE_ODDS[base + s], [w[0] for w in want], atol=mixing.STEP / 2 + 1e-6)
        assert (mixing.STATE_LEVEL[base + s] == [w[1] for w in want]).all()


def test_code_is_complete():
    starts, ways = mixing.huffman(np.array([5, 1, 1, 9, 3]))
    assert sum(2.0 ** -(b - a) for a, b in zip(starts[:-1], starts[1:], strict=True)) == 1.0
    assert len({tuple(ways[a:b] & 1) for a, b in zip(starts[:-1], starts[1:], strict=True)}) == 5
    assert (mixing.way_counts((starts, ways), np.array([5, 1, 1, 9, 3])).sum(axis=1).max(), len({w >> 1 for w in ways})) == (19, 4)


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 8)) * 2
    point = lattice.nearest_e8(x) / 2
    around = np.concatenate([point[:, None] + lattice.NEIGHBOURS[None]], axis=1)
    best = np.square(x - point).sum(axis=1)
    assert (best[:, None] <= np.square(x[:, None] - around).sum(axis=2) + 1e-9).all() and best.max() <= 1.0 + 1e-9


@pytest.mark.parametrize("block", [1024, 9])
def test_lattice_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = []
    for family in range(20):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.standard_normal(32) * rng.choice([0.0, 0.1, 0.25, 0.3])], int(family % 3)))
    plain = list(rows)
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] + [1.0] * 31, 1), (903, rows[0][1], None), (904, [None] + [1.0] * 31, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, rows[0][1], 0), (907, rows[0][1], 0), (None, rows[0][1], 0)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))).collect()
    assert len(got) == len(rows)
    ids = [r[0] for r in plain] + [907, 907]
    x = np.array([r[1] for r in plain] + [rows[0][1]] * 2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in plain] + [0, 0])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    links, component = near.sum(axis=1) - 1, np.arange(len(ids))
    for _ in ids:
        component = np.where(near, component[None, :], len(ids)).min(axis=1)
    want = {i: (int(n), ids[c]) for i, n, c in zip(ids, links, component, strict=True)}
    found = {r.vec_id: r for r in got if r.vec_id is not None}
    assert sum((found[i].n_links, found[i].component_id) == w for i, w in want.items()) >= 0.97 * len(want)
    assert all(found[i].n_links <= w[0] for i, w in want.items())
    for i in (900, 901, 902, 903, 904, 905, 906):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((260, 19)).astype("f4")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(i, [float(x) for x in vectors[5]]) for i in range(300, 320)]
    rows += [(400, None), (401, [float("inf")] + [0.0] * 18), (402, [None] + [0.0] * 18), (403, []), (500, [1e6] * 19), (501, [3e7] * 19), (None, rows[0][1]), (600, [1.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("score", F.lit(1)), F.col("vec_id") % 100 == 0, block=3).collect()
    whole = [(i, [math.floor(1024 * np.float32(x).astype("f8")) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in whole:
        if q % 100 == 0:
            best = sorted((-min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in whole if i != q and len(a) == len(b))[:10]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0
