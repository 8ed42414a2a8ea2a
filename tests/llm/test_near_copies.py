"""Near copies by 5-word shingles against brute force."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from kvlume.llm import near_copies, simhash


def brute_kept(rows):
    """Ids that stay: the smallest of each component of pairs at 0.8 or more."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i for i in ids if find(i) == i}


def test_similar_texts_of_the_table(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(c.STAGES)["SimHash near-dedup"]
    got = {r["doc_id"] for r in stage(spark, docs, sf).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got == brute_kept(rows)
    # texts that two bits of SimHash do not reach
    assert not {145, 177} & got


def test_groups_of_edited_copies(spark):
    r = random.Random(5)
    base = [[f"w{r.randrange(3000)}" for _ in range(200)] for _ in range(3)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a"), (4, "A"), (5, "a b")]
    for k in range(60):
        w = list(base[k % 3])
        for _ in range(k % 7):
            w[r.randrange(200)] = f"x{k}"
        rows.append((10 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.deduplicate(docs)
    assert kept.schema == docs.schema
    assert {x["doc_id"] for x in kept.collect()} == brute_kept(rows)
    assert near_copies.deduplicate(docs.limit(0)).count() == 0


def test_repeated_rows_and_ids(spark):
    """Of repeated rows one stays, null ids come last, names may clash."""
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (None, "a b c d e f", 3), (None, "only null", 4), (None, "only null", 5), (7, None, 6), (8, "", 7), (9, "x", 8), (9, "y", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int").withColumn("fp", F.lit(1)).withColumn("found", F.lit("z")).withColumn("_id", F.lit(0))
    kept = simhash.deduplicate(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"]) for r in kept.collect()) == [((False, 1), "a b c d e f"), ((False, 7), None), ((False, 9), "x"), ((False, 9), "y"), ((True, 0), "only null")]


def test_covering_keys_guarantee():
    """Fingerprints within two bits share a key in some covering table."""
    import numpy as np

    r = random.Random(1)
    a = [r.getrandbits(64) for _ in range(300)]
    b = [x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in a]
    one, two = (near_copies.covering_keys(np.array(z, np.uint64)) for z in (a, b))
    assert (one == two).any(axis=1).all() and one.shape == (300, 7)
    sets, _, prints = near_copies.shingle_sets(pa.array(["a b c d e f", "A  b c d e f", "", None]))
    assert prints[0] == prints[1] and [len(s) for s in sets] == [2, 2, 0, 0] and prints[2] == prints[3] == 0


def test_sketches_rule_out_without_error():
    """Sketches never differ in more bits than there are members of one set only."""
    import numpy as np

    r = np.random.default_rng(3)
    for n in (1, 30, 300, 5_000):
        base = r.integers(0, 1 << 63, n, np.uint64)
        for k in (0, 1, n // 9, n // 2):
            other = np.concatenate([base[k:], r.integers(0, 1 << 63, k, np.uint64)])
            words = near_copies.sketches([np.unique(base), np.unique(other), np.zeros(0, np.uint64)])
            turned = sum(int(np.bitwise_count(np.uint64(w.view(np.uint64)[0] ^ w.view(np.uint64)[1]))) for w in words)
            assert turned <= 2 * k and (n > 300 or k < 9 or turned > k) and all(w[2] == 0 for w in words)


def test_edited_copies_leave_few_pairs(spark, monkeypatch):
    """Copies of one text with up to six edits: what the leaders do not join is
    few pairs, not a share of the group's square."""
    r, seen = random.Random(8), []
    base = [f"w{r.randrange(3000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        w = list(base)
        for at in r.sample(range(150), 1 + k % 6):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda docs, text_col, pairs: (seen.append(pairs.count()), verified(docs, text_col, pairs))[1])
    kept = near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"] for x in kept.collect()} == brute_kept(rows)
    assert sum(seen[1:]) < len(rows) / 3, seen
