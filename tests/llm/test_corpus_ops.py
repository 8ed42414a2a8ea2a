"""Operators over the whole corpus against brute force: near-duplicates,
language-model scores, packing, archives, toxicity, media, the pipeline."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvlume.llm import components, lm_score, media, packing, queries, simhash, toxicity, warc
from kvlume.llm.arrow import SPACED, Words, give_back, share_arrays

ODD = [None, "", " \n\t", "a", "a b", "É é ÉÉ", "x" * 50_000, "word " * 3_000, "A b\tc\x0bd"]


def low_words(t):
    return (t or "").encode().lower().split()


# --- SimHash ---


def brute_fp(t):
    import xxhash

    w = low_words(t)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(pairs):
    """(id, fingerprint) to the smallest id reachable."""
    fps = sorted({f for _, f in pairs})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for _, f in pairs]


def test_fingerprints():
    texts = [*ODD, *("w%d " % (i % 40) * 1 for i in range(3)), " ".join(f"t{i}" for i in range(1000))]
    got = simhash.majority_bits(*simhash.shingle_hashes(Words(pa.array(texts), SPACED)))
    assert got.tolist() == [brute_fp(t) for t in texts]


def test_shingle_hash_is_sparks(spark):
    want = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    h, _ = simhash.shingle_hashes(Words(pa.array(["One two  three"]), SPACED))
    assert int(h.view(np.int64)[0]) == want


def test_masks_cover_every_pair():
    m = simhash.masks()
    assert len(m) == 7
    for i in range(64):
        for j in range(64):
            assert any(not (x >> i & 1) and not (x >> j & 1) for x in m)


@pytest.mark.parametrize("small", [1, 3, 24])
def test_links_keep_components(spark, small):
    """Chains, stars and hot buckets, by the pairs and by the linear way."""
    r = random.Random(small)
    fps = {0}
    centres = [r.getrandbits(64) for _ in range(12)]
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    x = r.getrandbits(64)
    for i in range(40):  # a chain of single steps
        x ^= 1 << i
        fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.links(df, small=small)
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    groups = collections.defaultdict(set)
    for s in signed:
        groups[found.get(s, s)].add(s % (1 << 64))
    want = collections.defaultdict(set)
    ids = list(fps)
    for i, c in enumerate(brute_components(list(enumerate(ids)))):
        want[c].add(ids[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert all((a["a"] ^ a["b"]) % (1 << 64) and ((a["a"] ^ a["b"]) % (1 << 64)).bit_count() <= 2 for a in links.collect())


def test_components_shapes(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[301] == got[300] == 300 and 200 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op3(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [(r["doc_id"], brute_fp(r["text"])) for r in docs]
    comp = brute_components(want)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op3_simhash(spark, sf).collect()}
    assert got == {i: (f, c) for (i, f), c in zip(want, comp, strict=True)}


def test_near_duplicates_odd_rows(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(3, "a", "s"), (None, "a", "s"), (None, "only null", "s"), (None, "only null", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == collections.Counter(zip([r[0] for r in rows], brute_components([(r[0], brute_fp(r[1])) for r in rows]), strict=True))
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.deduplicate(docs.limit(0)).count() == 0


# --- language-model scores ---


def test_op6_base(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    c = collections.Counter()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in docs}
    for r in docs:
        if not held[r["doc_id"]]:
            c.update([*low_words(r["text"]), None])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in queries.op6_lm_score(spark, sf).collect()}
    for r in docs:
        w = [*low_words(r["text"]), None]
        g = got[r["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert g["score"] < 0


def naive_scores(texts, train, head, min_count, context_count, least):
    """Scores of texts by the model's definition, in plain dictionaries."""
    uni = collections.Counter(w for t, k in zip(texts, train, strict=True) if k for w in [*low_words(t), None])
    total = sum(uni.values()) + 0.5 * (len(uni) + 1)
    share = {w: (c + 0.5) / total for w, c in uni.items() if w in head or w is None}
    share[0] = 1 - sum(share.values())
    code = lambda t: [w if w in share else 0 for w in [*low_words(t), None]]
    pair, triple = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for t, k in zip(texts, train, strict=True):
        a, b = 0, "start"
        for x in code(t) if k else ():
            if b != 0:
                pair[b][x] += 1
            triple[a, b][x] += 1
            a, b = b, x
    few = lambda c: {x: n for x, n in c.items() if n >= min_count}
    pair = {b: few(c) for b, c in pair.items()}
    often = {(a, b) for a, c in pair.items() for b, n in c.items() if n >= context_count and b not in (0, None)}
    triple = {k: few(c) for k, c in triple.items() if k in often}
    k_ = lambda m: 2 * m**0.8
    apart = lambda c, q: sum(n / sum(c.values()) * math.log2(n / sum(c.values()) / q(x)) for x, n in c.items()) >= least
    one = {b: c for b, c in pair.items() if c and apart(c, share.get)}

    def after(b, x):
        c = one.get(b)
        return share[x] if c is None else (c.get(x, 0) + k_(sum(c.values())) * share[x]) / (sum(c.values()) + k_(sum(c.values())))

    two = {k: c for k, c in triple.items() if c and apart(c, lambda x, k=k: after(k[1], x))}
    out = []
    for t in texts:
        a, b, s = 0, "start", 0.0
        for w, x in zip([*low_words(t), None], code(t), strict=True):
            p, c = after(b, x), two.get((a, b))
            if c is not None:
                m = sum(c.values())
                p = (c.get(x, 0) + k_(m) * p) / (m + k_(m))
            s += math.log10(p) + (math.log10((uni[w] + 0.5) / total / share[0]) if x == 0 else 0)
            a, b = b, x
        out.append(s)
    return out, len(one), len(two)


@pytest.mark.parametrize("head_words", [4, 1000])
@pytest.mark.parametrize("grams", [2, 1000])
def test_suffix_tree_equals_naive(spark, head_words, grams):
    """Also where pairs and words have to be joined."""
    r = random.Random(1)
    vocab = ["the", "cat", "sat", "on", "a", "mat", "é", "dog"]
    texts = [" ".join(w for k in range(r.randrange(1, 12)) for w in r.choice([["the", "cat"], ["on", "a", "mat"], [r.choice(vocab)], [f"rare{r.randrange(30)}"]])) for _ in range(60)] + [None, "", "unseen words of a text"]
    train = [i % 5 != 1 and i < 60 for i in range(len(texts))]
    rows = [(i, t, k) for i, (t, k) in enumerate(zip(texts, train, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {x["doc_id"]: x["score"] for x in lm_score.score(docs, F.col("train"), head_words=head_words, min_count=2, context_count=3, grams=grams).collect()}
    every = collections.Counter(w for t in texts for w in low_words(t))
    bucket = lambda n: math.floor(math.log2(n) * 8)
    sizes, taken, least = collections.Counter(bucket(n) for n in every.values()), 0, None
    for b in sorted(sizes, reverse=True):
        taken += sizes[b]
        if taken > head_words:
            break
        least = b
    learnt = {w for t, k in zip(texts, train, strict=True) if k for w in low_words(t)}
    head = {w for w, n in every.items() if least is not None and bucket(n) >= least and w in learnt}
    want, one, two = naive_scores(texts, train, head, 2, 3, lm_score.MIN_DIVERGENCE)
    if grams == 1000:
        assert one > 1 and (two > 1 or head_words == 4)
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-6)
    else:  # contexts of two words lack room, pairs are joined
        assert all(got[i] < 0 for i in range(len(texts)))
        symbols = [w for t, k in zip(texts, train, strict=True) if k for w in low_words(t)]
        assert len(symbols) > 100
        full = {x["doc_id"]: x["score"] for x in lm_score.score(docs, F.col("train"), head_words=head_words, min_count=2, context_count=10**6, grams=1000).collect()}
        few = {x["doc_id"]: x["score"] for x in lm_score.score(docs, F.col("train"), head_words=head_words, min_count=2, context_count=10**6, grams=2).collect()}
        assert few == pytest.approx(full, rel=1e-6)


@pytest.mark.parametrize("room", [{"contexts": 1}, {"contexts": 2, "grams": 5}, {"grams": 2}])
def test_contexts_beyond_the_model_are_joined(spark, room):
    """Scores do not depend on how many contexts and counts the model has room for."""
    r = random.Random(2)
    texts = [" ".join(w for k in range(r.randrange(1, 12)) for w in r.choice([["the", "cat"], ["on", "a", "mat"], ["a", "cat", "sat"], ["dog"], [f"rare{r.randrange(30)}"]])) for _ in range(60)]
    train = [i % 5 != 1 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, train boolean")
    learnt = {w for t, k in zip(texts, train, strict=True) if k for w in low_words(t)}
    want, _, two = naive_scores(texts, train, learnt, 2, 3, lm_score.MIN_DIVERGENCE)
    assert two > 4
    got = {x["doc_id"]: x["score"] for x in lm_score.score(docs, F.col("train"), min_count=2, context_count=3, **room).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-6)


def test_free_memory_goes_back_between_tasks():
    """A worker that Spark keeps does not stay as large as its largest task."""
    rss = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    held = [bytes(1000) for _ in range(200_000)]
    last = held.pop()  # above the others, so that they are not given back by themselves
    del held
    before = rss()
    give_back()
    assert rss() < before - 100e6 and len(last) == 1000


def test_a_worker_holds_the_model_once(spark):
    """Its tasks look into the arrays that the broadcast brought; none copies them."""
    shared = share_arrays(spark, lm_score.Symbols(pa.array(["a ", "b "], pa.large_string()), np.array([3, 2]), 9, 3, 4))

    def run(batches):
        one, two = shared(), shared()
        same = all(np.shares_memory(getattr(one, k), getattr(two, k)) and not getattr(one, k).flags.writeable for k in ("counts", "number", "share"))
        same = same and one.words.buffers()[2].address == two.words.buffers()[2].address and one.words.to_pylist() == ["a ", "b "]
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([same and one.counts.tolist() == [3, 2]] * b.num_rows)], names=["ok"])

    assert [r["ok"] for r in spark.range(4).mapInArrow(run, "ok boolean").collect()] == [True] * 4


def test_symbols_meet_the_contexts_left_in_tables_in_one_exchange(spark):
    at = lambda *x: sum(s << 20 * (len(x) - 1 - i) for i, s in enumerate(x))
    asked = [(0, at(1, 2, 3), 5), (1, at(1, 2, 3), -1), (1, at(1, 2, 9), 0), (2, at(7, 3, 4), 1)]
    contexts = spark.createDataFrame([(at(1, 2), 10.0), (at(1, 3), 5.0)], "c long, m double")
    triples = spark.createDataFrame([(at(1, 2, 3), 4), (at(1, 2, 4), 6), (at(1, 3, 9), 5)], "gram long, n long")
    before = spark.createDataFrame([(2, 2.0, 6.0, True), (3, 2.0, 6.0, False)], "b long, weight double, seen double, state boolean")
    share = spark.createDataFrame([(3, 0.5), (4, 0.25), (9, 0.125)], "x long, share double")
    k = 2 * 10**0.8
    long = lambda n, pair, share: (n + k * (pair + 2 * share) / 8) / (10 + k)
    for pairs in (None, spark.createDataFrame([(at(2, 3), 2)], "gram long, n long")):
        own = [r for r in asked if pairs is not None or r[2] >= 0]
        got = lm_score.far(spark.createDataFrame(own, "_row long, _triple long, _n long"), lm_score.Rest(pairs, contexts, triples, before, share))
        want = [(0, long(4, 5, 0.5)), (1, long(0, 0, 0.125)), (2, 0.25)] + ([(1, long(4, 2, 0.5))] if pairs is not None else [])
        assert sorted((r["_row"], r["_p"]) for r in got.collect()) == [(r, pytest.approx(p)) for r, p in sorted(want)]
        if pairs is None:
            plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
            assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_the_room_is_filled_count_by_count(spark):
    """46 and 47 fall into one eighth of an octave; only 47 has room."""
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([5000, 5000, 47, 47, 46, 46, 46])], "c long, n long")
    assert [lm_score._most(counts, room) for room in (1, 2, 3, 4, 6, 7)] == [1 << 62, 5000, 5000, 47, 47, 46]


def test_tree_distributions_sum_to_one(spark):
    words = ["abra", "cad", "bra", "x", "abra cad"]
    docs = spark.createDataFrame([(" ".join(words * 3), True), ("abra cad bra", True), ("zz", False)], "text string, train boolean")
    counts = collections.Counter(w for t in (" ".join(words * 3), "abra cad bra") for w in t.split())
    names = sorted(counts)
    symbols = lm_score.Symbols(pa.array([f"{w} " for w in names], pa.large_string()), np.array([counts[w] for w in names]), sum(counts.values()) + 2, len(names) + 1, 2)
    tree, rest = lm_score.grow(docs, symbols, min_count=1, context_count=2, min_divergence=0.0)
    assert rest is None and len(tree.contexts) > 2
    k = len(symbols.share)
    every = np.array([i for i in range(k) if i != symbols.start], np.uint64)
    for before in range(1, k):
        for context in range(-1, len(tree.contexts)):
            if context < 0 or int(tree.contexts[context]) & 0xFFFFF == before:
                p, _, _ = tree.probability(every, np.uint64(before) << lm_score.SYMBOL | every, np.full(len(every), context))
                assert p.sum() == pytest.approx(1)


def test_op6_beats_its_baseline_on_new_texts(spark, sf):
    for folder in (sf, sf.replace("sf0.001", "sf0.01")):
        r = queries.op6_lm_score(spark, folder).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        assert r[0] > r[1] + (0.03 * r[2] if folder != sf else 0)


def test_scores_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    for train, n in ((F.lit(True), sum(len(low_words(t)) + 1 for _, t in rows)), (F.lit(None).cast("boolean"), 0)):
        got = lm_score.score(docs, train, head_words=2).collect()
        assert sorted(r["n_tokens"] for r in got) == sorted(len(low_words(t)) + 1 for _, t in rows)
        assert {r["train_tokens"] for r in got} == {n} and all(r["n_known"] == (r["n_tokens"] if n else 0) for r in got)
    assert lm_score.score(docs.limit(0), F.lit(True)).count() == 0


# --- packing ---


def test_tokens_of_both_libraries():
    t = packing.Tokens(queries.byte_bpe()["tokenizer_path"], queries.byte_bpe()["ranks_path"], queries.byte_bpe()["pattern"])
    r = random.Random(2)
    texts = ["", "Hello  world\n\n it's", "<|endoftext|> x", "日本語 text", "a" * 3000, "\u0085  x", *("".join(chr(r.choice([32, 10, 9, 39, 48, 57, 65, 97, 122, 0xE9, 0xDF, 0x17F, 0x24F, 0x85, 0xA0, 0xAD, 0x3000, 0x1F600])) for _ in range(60)) for _ in range(300))]
    for text in texts:
        assert t.ids(text).tolist() == t.slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_tokens_over_documents(spark, sf):
    t = packing.Tokens(queries.byte_bpe()["tokenizer_path"], queries.byte_bpe()["ranks_path"], queries.byte_bpe()["pattern"])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert t.ids(r["text"]).tolist() == t.slow.encode(r["text"], add_special_tokens=False).ids


def check_packed(rows, total=2048):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= total
    return len(by)


def test_op10(spark, sf):
    t = packing.Tokens(queries.byte_bpe()["tokenizer_path"])
    rows = queries.op10_packing(spark, sf).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    tokens = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.append(t.ids(d["text"] or ""), 0).astype("<u4")
        tokens += len(ids)
        own = sorted(pieces.pop(d["doc_id"]), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == 2048 or r["piece"] == 0
            at += r["length"]
        assert at == len(ids) and len(own) == -(-len(ids) // 2048)
    assert not pieces
    assert check_packed(rows) <= 1.03 * math.ceil(tokens / 2048)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), min_size=1, max_size=30))
def test_plan(counts):
    total = 64
    h = np.zeros(total + 1, np.int64)
    for k, n in counts.items():
        h[k] = n
    plan = packing.Plan.best(h, total)
    used = collections.defaultdict(list)
    seq = collections.defaultdict(list)
    for length, first, n, s, offset in plan.runs:
        used[length] += range(first, first + n)
        for i in range(n):
            seq[s + i].append((offset, length))
    assert {k: sorted(v) for k, v in used.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert sorted(seq) == list(range(plan.sequences))
    for own in seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= total


def test_fit_minimises():
    h = np.zeros(17)
    h[[4, 6, 8, 10, 12]] = [50, 30, 40, 30, 50]
    patterns = packing.exact_patterns(np.flatnonzero(h), 16)
    assert {tuple(p) for p in patterns.tolist()} == {(0, 4, 12), (0, 6, 10), (0, 8, 8), (4, 4, 8), (4, 6, 6)}
    x = packing.fit(h, patterns, least=1e-9)
    a = np.zeros((17, len(patterns)))
    for j, p in enumerate(patterns):
        for v in p[p > 0]:
            a[v, j] += 1
    grad = a.T @ (a @ x - h)
    assert (x >= 0).all() and (grad > -1e-5).all() and abs(grad @ x) < 1e-3


def test_packing_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "a"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit(1))
    out = packing.pack(docs, **queries.byte_bpe(), with_ids=True)
    got = out.collect()
    check_packed(got)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["piece"] == 0) == sorted((i is None, i or 0) for i, _ in rows)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in got)
    assert packing.pack(docs.limit(0), **queries.byte_bpe()).count() == 0


# --- archives ---


def test_op5_equals_sql(spark, duck, sf):
    same(queries.op5_warc(spark, sf), duck, queries.SQL["op5_warc"])


@given(st.binary(max_size=3000), st.integers(1, 500))
@settings(max_examples=80, deadline=None)
def test_chunked_round_trip(payload, size):
    assert warc.unchunk(warc.chunked(payload, size)) == payload


def test_records_round_trip():
    payload = bytes(range(256)) * 300
    digest = hashlib.sha256(payload).hexdigest()
    recs = list(warc.page_records("<urn:uuid:1>", "7", "http://x/a b\n", payload, digest, None, "2024-01-01T00:00:00Z", 1000))
    data = warc.END.join([*recs, b""])
    parsed = list(warc.parse(data))
    assert len(parsed) == len(recs) > 70 and parsed[0][0]["warc-target-uri"] == "http://x/a%20b%0A"
    pieces = [(int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, b) for f, b in parsed]
    random.Random(1).shuffle(pieces)
    assert warc.http_payload(warc.join_segments(pieces)) == payload
    for bad in (pieces[1:], [*pieces, pieces[0]], [(n, t + 1 if t else None, b) for n, t, b in pieces]):
        with pytest.raises(warc.BadRecord):
            warc.join_segments(bad)
    assert list(warc.parse(data[:-9]))[-1][0]["error"] and list(warc.parse(b"junk"))[0][0]["error"]
    for bad in (b"5\r\nabc", b"zz\r\n", b"", b"3\r\nabc\r\n", b"3\r\nabcX0\r\n\r\n"):
        with pytest.raises(warc.BadRecord):
            warc.unchunk(bad)


def test_archives_odd_rows(spark, tmp_path):
    big = "é<html>\r\n\r\nWARC/1.1\r\n" * 4000
    same_ = "s" * 100
    rows = [(1, "http://a", big), (2, None, None), (3, "http://b", ""), (4, "http://c", same_), (5, "http://c", same_), (5, "http://c", same_), (None, "http://d", same_), (None, "u", "short"), (9, "v", "short"), (1, "http://a", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = str(tmp_path / "arc")
    warc.write_archives(pages, path, segment_bytes=5000, records_per_file=7)
    got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], bytes(r["payload"] or b"").decode(), r["error"]) for r in warc.read_archives(spark, path, with_payload=True).collect())
    n = len(big.encode())
    want = [(1, "response", None, n, big, None)] * 2 + [(2, "response", None, 0, "", None), (3, "response", None, 0, "", None), (4, "response", None, 100, same_, None), *[(5, "revisit", 4, 100, "", None)] * 2, (None, "revisit", 4, 100, "", None), (None, "response", None, 5, "short", None), (9, "response", None, 5, "short", None)]
    assert got == collections.Counter(want)
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_damaged_archives(spark, tmp_path):
    ok = b"".join(r + warc.END for r in warc.page_records("<urn:a>", "1", "u", b"x" * 3000, hashlib.sha256(b"x" * 3000).hexdigest(), None, "d", 1000))
    lost = [r + warc.END for r in warc.page_records("<urn:b>", "2", "u", b"y" * 3000, hashlib.sha256(b"y" * 3000).hexdigest(), None, "d", 1000)]
    wrong = b"".join(r + warc.END for r in warc.page_records("<urn:c>", "3", "u", b"z", "00", None, "d"))
    (tmp_path / "a.warc").write_bytes(ok + lost[0] + lost[2] + lost[3] + wrong + b"WARC/1.1\r\ncut")
    got = {r["page_id"]: (r["payload_bytes"], r["error"]) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got[1] == (3000, None) and got[2] == (None, "a segment is missing or repeated") and got[3][1] == "payload differs from its digest" and got[None][1] == "not a record"


def test_archives_in_pieces():
    """Any cut of an archive, plain or gzip members, gives the same records."""
    import gzip

    records = [*warc.page_records("<urn:a>", "1", "u", b"x" * 3000, "d", None, "d", 1000), *warc.page_records("<urn:b>", "2", "u", b"", "d", None, "d")]
    data = b"".join(r + warc.END for r in records)
    want = list(warc.parse(data))
    assert len(want) == len(records)
    for n in (1, 3, 7, 100, len(data)):
        assert list(warc.parse(data[i : i + n] for i in range(0, len(data), n))) == want
        assert list(warc.parse(warc._inflated(gzip.compress(data), n))) == want
        assert list(warc.parse(warc._inflated(b"".join(gzip.compress(r + warc.END) for r in records), n))) == want
        assert list(warc.parse(data[i : min(i + n, len(data) - 9)] for i in range(0, len(data) - 9, n)))[-1][0]["error"]


def test_revisits_of_lost_responses(spark, tmp_path):
    good, bad = b"x" * 200, b"y" * 200
    records = [
        *warc.page_records("<urn:a>", "1", "u", good, hashlib.sha256(good).hexdigest(), None, "d"), *warc.page_records("<urn:b>", "2", "u", good, hashlib.sha256(good).hexdigest(), "1", "d"),
        *warc.page_records("<urn:c>", "3", "u", bad, "00", None, "d"), *warc.page_records("<urn:d>", "4", "u", bad, hashlib.sha256(bad).hexdigest(), "3", "d"),
        *warc.page_records("<urn:e>", "5", "u", good, hashlib.sha256(good).hexdigest(), "77", "d"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(r + warc.END for r in records))
    got = {r["page_id"]: r["error"] for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: None, 3: "payload differs from its digest", 4: "no readable response has this payload", 5: "no readable response has this payload"}


def test_pages_of_one_text(spark, tmp_path):
    """Nine tenths of the pages are one text, a third of the ids null."""
    rows = [(None if i % 3 == 0 else i, f"u{i}", "same " * 40 if i % 10 else f"own {i} " * 30) for i in range(1, 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    assert sum(r["record_type"] == "revisit" for r in got) == sum(i % 10 != 0 for i in range(1, 400)) - 1 and {r["refers_to"] for r in got} == {None, 1}


# --- toxicity ---


def test_chain_finds_toxic_texts(spark, sf):
    r = random.Random(3)
    neutral = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        bad = i % 6 == 0
        w = r.choices(neutral, k=40) + (r.choices(["idiotic", "trashy", "scummy"], k=3) if bad else []) + (["junk|"] * 3 if i % 5 == 0 else [])
        r.shuffle(w)
        rows.append((i, " ".join(w), int(i % 5 != 0), int(bad)))
    all_ = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    chain = toxicity.train(all_.where("doc_id < 400").select("doc_id", "text"), all_.select("doc_id", "quality", "toxic"), {"low": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    p = F.col("toxicity")["toxic"]
    got = toxicity.predict(all_.where("doc_id >= 400"), chain).select("toxic", (p >= chain.thresholds["toxic"]).alias("found")).collect()
    assert sum(bool(g["toxic"]) != g["found"] for g in got) <= 2


def test_chain_uses_out_of_fold_logits():
    """A category that no feature tells must not look certain to later models."""
    r = np.random.default_rng(0)
    n = 300
    x = toxicity.Rows(n, np.repeat(np.arange(n), 5), r.integers(0, 1000, 5 * n), np.ones(5 * n))
    noise = r.random(n) < 0.5
    chain = toxicity.Chain(x, {"noise": noise, "copy": noise}, np.arange(n) % 3)
    assert abs(chain.models[1].v[0]) < 1.5


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "a")], "doc_id long, text string").withColumn("toxicity", F.lit(1))
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels, {"toxic": F.col("toxic") == 1})
    out = toxicity.predict(docs, chain).collect()
    assert len(out) == len(ODD) + 1 and all(0 <= r["toxicity_"]["toxic"] <= 1 for r in out) and out[0]["toxicity_"]["toxic"] == 0
    assert toxicity.train(docs, labels.limit(0), {"toxic": F.lit(True)}) is None
    assert {r["toxicity_"]["toxic"] for r in toxicity.predict(docs, None).collect()} == {0.0}
    assert toxicity.predict(docs.limit(0), chain).count() == 0


def test_sample_is_exact(spark):
    """The labelled rows learned from: the first by hash, each id once, whole
    texts however long; the same whatever the partitions."""
    rows = [(i, f"w{i % 7} " * (1 + i % 3) + ("x" * 50_000 if i == 9 else ""), i % 4 == 0) for i in range(300)]
    docs = spark.createDataFrame([*rows, rows[3], (3, "zz", False)], "doc_id long, text string, toxic boolean")
    labels = docs.select("doc_id", "toxic")
    one, two = (toxicity.train(d.select("doc_id", "text"), x, {"toxic": F.col("toxic")}, rows=n) for d, x, n in ((docs, labels, 300), (docs.repartition(5), labels.repartition(3), 300)))
    assert one.thresholds == two.thresholds and (one.models[0].w == two.models[0].w).all() and one.models[0].b == two.models[0].b
    few = toxicity.train(docs.select("doc_id", "text"), labels, {"toxic": F.col("toxic")}, rows=40)
    assert few is not None


def test_op4(spark, sf):
    """The query against the same chain applied text by text."""
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(got) == {r["doc_id"] for r in docs}
    chain = queries.toxicity_chain(spark, sf)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = wrong = 0
    for r in docs:
        token, ids = toxicity.word_features(Words(pa.array([r["text"]]), toxicity.LETTERS))
        tokens = collections.Counter(f for t in token.tolist() for f in set(ids[t].tolist()) if f >= 0)
        logits = []
        for m in chain.models:
            s = m.b + sum(w * math.log1p(tokens[f]) for f, w in zip(m.features.tolist(), m.w.tolist(), strict=True)) + sum(v * x for v, x in zip(m.v.tolist(), logits, strict=True))
            logits.append(max(-15, min(15, s)))
        want = 1 / (1 + math.exp(-logits[1])) if len(token) else 0.0
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-5)
        if r["doc_id"] in labels:
            ok = (labels[r["doc_id"]] == 1) == got[r["doc_id"]]["toxic"]
            right, wrong = right + ok, wrong + (not ok)
    assert wrong < sum(x == 1 for x in labels.values())  # better than calling none toxic


# --- media ---


def pgm(a):
    return b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + np.clip(a, 0, 255).astype(np.uint8).tobytes()


def png(a, kind):
    a = np.clip(a, 0, 255).astype(np.uint8)
    rows, prev = [], np.zeros(a.shape[1], int)
    for line in a.astype(int):
        left = np.concatenate(([0], line[:-1]))
        up_left = np.concatenate(([0], prev[:-1]))
        p = left + prev - up_left
        near = np.where((abs(p - left) <= abs(p - prev)) & (abs(p - left) <= abs(p - up_left)), left, np.where(abs(p - prev) <= abs(p - up_left), prev, up_left))
        rows.append(bytes([kind]) + ((line - [0 * left, left, prev, (left + prev) // 2, near][kind]) & 255).astype(np.uint8).tobytes())
        prev = line
    block = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    head = a.shape[1].to_bytes(4, "big") + a.shape[0].to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", head) + block(b"IDAT", zlib.compress(b"".join(rows))) + block(b"IEND", b"")


def test_decode():
    a = np.arange(12 * 9).reshape(9, 12) * 2.0 % 256
    for data in (pgm(a), *(png(a, k) for k in range(5))):
        assert np.array_equal(media.decode(data), a.astype(np.uint8))
    rgb = b"P6\n# note\n2 1 255\n" + bytes([255, 0, 0, 10, 10, 10])
    assert media.decode(rgb)[0] == pytest.approx([76.245, 10], rel=1e-3)
    for bad in (None, b"", b"P5", b"P5 9 9 255\nxx", b"GIF89a", png(a, 0)[:40]):
        assert media.decode(bad) is None


def edited(n, step=4):
    """``n`` mosaics, edits of every ``step``-th of the first 120, and whose they are."""
    r = np.random.default_rng(7)
    base = [queries.mosaic(r.normal(size=64)) for _ in range(n)]
    rows, truth = list(enumerate(base)), {}
    for i in range(0, 120, step):
        a = media.decode(base[i])
        edits = [a + r.normal(0, 10, a.shape), a * 0.6 + 50, a[12:84, 12:84], np.rot90(a), media._resize(a[None], 144, 144)[0]]
        for k, e in enumerate(edits):
            truth[10**6 + i * 10 + k] = i
            rows.append((10**6 + i * 10 + k, pgm(np.ascontiguousarray(e))))
    return rows, truth


@pytest.mark.parametrize("n", [120, 3_000])
def test_edited_copies_are_found(spark, n):
    """Each kind of edit, whatever the size of the table."""
    rows, truth = edited(n)
    df = spark.createDataFrame(rows, "id long, image binary").repartition(8)
    got = media.search(df, F.col("id") >= 10**6).collect()
    pairs = {(g["query_class"], g["id"]) for g in got if g["query_class"] is not None}
    pairs |= {(b, a) for a, b in pairs}
    for k in range(5):
        of = [(e, i) for e, i in truth.items() if e % 10 == k]
        assert sum(p in pairs for p in of) >= 0.9 * len(of), k
    origin = lambda x: truth.get(x, x)
    assert sum(origin(a) != origin(b) for a, b in pairs) <= 0.02 * len(pairs)


def brute_consensus(q, m, side):
    """Most different corners, on both sides, that one match's transform explains."""
    best = 0
    for k in range(len(q)):
        grow, turn = q[k, 3] / m[k, 3], m[k, 2] - q[k, 2]
        turned = grow * np.array([[math.cos(turn), -math.sin(turn)], [math.sin(turn), math.cos(turn)]])
        shift = m[k, :2] - turned @ q[k, :2]
        good = []
        for j in range(len(q)):
            off = np.hypot(*(turned @ q[j, :2] + shift - m[j, :2]))
            bend = abs((turn - (m[j, 2] - q[j, 2]) + math.pi) % (2 * math.pi) - math.pi)
            if off <= media.TOLERANCE * side * max(1, grow) and bend <= 0.5 and abs(math.log(grow / (q[j, 3] / m[j, 3]))) <= 0.5:
                good.append(j)
        best = max(best, min(len({tuple(np.round(z[j, :2])) for j in good}) for z in (q, m)))
    return best


def test_search_equals_brute_force(spark, monkeypatch):
    """All pairs of corners of all pairs of images, with one block, with several
    and with little in hand."""
    rows, _ = edited(120, 12)
    rows = rows[:30] + rows[120:]
    points = [np.concatenate(media.features(media.decode(x)[None])) for _, x in rows]
    asked = lambda i: i >= 10**6 and i % 2 == 0
    want = set()
    for (i, _), p in zip(rows, points, strict=True):
        for (j, x), o in zip(rows, points, strict=True):
            if not asked(i) or i == j:
                continue
            gap = sum(np.bitwise_count((p[:, None, k] ^ o[:, k]).view(np.uint64)).astype(int) for k in (0, 1))
            key = np.zeros(gap.shape, bool)
            for k in (0, 1):
                both = (p[:, None, k] ^ o[:, k]).view(np.uint64)
                key |= (both >> np.uint64(32) == 0) | (both & np.uint64(0xFFFFFFFF) == 0)
            a, b = np.nonzero((gap <= media.MAX_DISTANCE) & key)
            least = max(media.MIN_INLIERS, media.MIN_SHARE * min(len(p), len(o)))
            if len(a) >= least:
                n = brute_consensus(media.unpack_point(p[a, 2]), media.unpack_point(o[b, 2]), min(media.decode(x).shape))
                if n >= least:
                    want.add((i, j, n, len(a)))
    assert len(want) > 60
    df = spark.createDataFrame(rows, "id long, image binary").repartition(4)
    for blocks in (media.BLOCK_POINTS, 400):
        got = media.search(df, (F.col("id") >= 10**6) & (F.col("id") % 2 == 0), block_points=blocks).where("query_class IS NOT NULL").collect()
        assert sorted((g["query_class"], g["id"], g["inliers"], g["n_matches"]) for g in got) == sorted(want)
    monkeypatch.setattr(media, "IN_HAND", 50)
    of = [k for k, (i, _) in enumerate(rows) if asked(i)]
    data = [p.astype("<i8").tobytes() for p in points]
    block = media.Block(np.array(of), [data[k] for k in of])
    found = media.matches(np.arange(len(rows)), np.array([min(media.decode(x).shape) for _, x in rows]), data, block)
    assert sorted((rows[of[q]][0], rows[k][0], i, n) for r in found for k, q, n, i in zip(*(x.tolist() for x in r[:4]), strict=True)) == sorted(want)


def test_media_odd_rows(spark):
    r = np.random.default_rng(1)
    one = queries.mosaic(r.normal(size=64))
    rows = [(1, one), (2, one), (2, one), (3, None), (4, b""), (5, b"junk"), (6, pgm(np.zeros((3, 3)))), (7, pgm(np.full((96, 96), 9.0))), (None, one)]
    df = spark.createDataFrame(rows, "id long, image binary").withColumn("digest", F.lit("clash")).withColumn("row", F.lit("clash"))
    got = collections.Counter((g["id"], g["class_id"], g["query_class"]) for g in media.search(df, F.lit(True)).collect())
    assert got[1, 1, None] == 1 and got[2, 1, None] >= 2 and got[3, None, None] == got[4, None, None] == got[5, None, None] == 1 and got[7, 6, None] == 1
    assert media.search(df.limit(0), F.lit(True)).count() == 0


def test_pictures_on_white_are_searched(spark):
    r = np.random.default_rng(11)
    rows = []
    for i in range(6):  # a drawing in the middle of a white page, its copy and its crop
        a = np.full((192, 192), 255.0)
        a[56:136, 56:136] = np.kron(r.integers(0, 200, (8, 8)), np.ones((10, 10)))
        rows += [(i, pgm(a)), (100 + i, pgm(a)), (200 + i, pgm(np.ascontiguousarray(a[8:184, 8:184])))]
    got = media.search(spark.createDataFrame(rows, "id long, image binary"), F.col("id") >= 200).collect()
    cls = {g["id"]: g["class_id"] for g in got}
    pairs = {frozenset((g["query_class"], g["id"])) for g in got}
    assert all(frozenset((200 + i, i)) in pairs for i in range(6))
    assert all(cls[i] == cls[100 + i] == i and cls[200 + i] == 200 + i for i in range(6))


def test_op9_classes(spark, sf):
    got = queries.op9_media(spark, sf).collect()
    assert {g["vec_id"] for g in got} == {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}


# --- pipeline ---


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.schema, docs
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, seen, sf)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in columns], name
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        before = {r["doc_id"]: r["text"] for r in seen.collect()}
        assert set(rows) <= set(before)
        if name.startswith("SimHash"):
            from test_near_copies import brute_kept

            assert set(rows) == brute_kept(list(before.items()))
        if name.startswith("benchmark"):
            from test_text_ops import words

            items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + 8]) for w in items for i in range(max(1, len(w) - 7))}
            for i, t in before.items():
                w = words(t)
                assert (i in rows) == (not any(tuple(w[k : k + 8]) in windows for k in range(len(w))))
        if name == "PII":
            from test_text_ops import brute_pii

            assert set(rows) == set(before)
            assert all((rows[i] == before[i]) or brute_pii(before[i]) or "<" in rows[i] for i in rows)
            assert not any(k == "email" for t in rows.values() for k, *_ in brute_pii(t))
        seen = spark.createDataFrame(out.collect(), out.schema)
    packed = c.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in seen.collect()}
    check_packed(packed)
