"""Row-local operators against brute force: decontamination, licences, personal
data, language ID."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import pyarrow as pa
import pytest
from helpers import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvlume.llm import decontam, lang_id, license_scan, ngrams, pii, queries
from kvlume.llm.arrow import ALNUM, SPACED, Words

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t", "a", "É é ÉÉ", "x" * 50_000, "word " * 30_000, "1 2 3  z", "tab\tsep\rcr", "a-b_c.d,e"]


def words(t):
    return WORDS.findall((t or "").translate(LOW))


def test_words_of_chunks():
    w = Words(pa.array(ODD), ALNUM)
    got = [x.as_py()[:-1] for x in w.array()]
    assert got == [x for t in ODD for x in words(t)]
    assert w.counts.tolist() == [len(words(t)) for t in ODD]
    w = Words(pa.array(ODD), SPACED)
    assert [x.as_py()[:-1] for x in w.array()] == [x.decode() for t in ODD for x in (t or "").encode().lower().split()]
    assert Words(pa.array([], pa.string()), ALNUM).n == 0
    sliced = pa.array(["no", "A b", "C"]).slice(1)
    assert [x.as_py() for x in Words(sliced, ALNUM).array()] == ["a ", "b ", "c "]


# --- decontamination ---


def brute_leak(text, items, window=8):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        iw = words(t)
        n = min(window, len(iw))
        for k in range(len(iw) - n + 1) if iw else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == iw[k : k + n]:
                    found.add(i)
                    hit |= set(range(p, p + n))
    return len(w), len(hit), sorted(found)


def longest(text, items, window=8):
    """The longest run of an item's words in a text, a window at least, and where."""
    w, best = words(text), None
    for i, t in items:
        iw = words(t)
        for a in range(len(w)):
            for b in range(len(iw)):
                n = 0
                while a + n < len(w) and b + n < len(iw) and w[a + n] == iw[b + n]:
                    n += 1
                if n >= min(window, len(iw)):
                    best = min(best or (0,), (-n, i, b, a))
    return best and (-best[0], *best[1:])


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_search(seed):
    r = random.Random(seed)
    vocab = ["a", "b", "c", "d"][: 2 + seed % 3]
    docs = [" ".join(r.choices(vocab, k=r.randrange(0, 60))) for _ in range(12)]
    items = [(str(i), " ".join(r.choices([*vocab, "z"], k=r.randrange(0, 14)))) for i in range(8)] + [("long", docs[3]), ("none", ""), ("null", None)]
    docs += [docs[3], f"x {docs[3]} y", " ".join(docs[3].split()[1:]), " ".join(docs[3].split()[:-1])]
    block = decontam.Items([i for i, _ in items], [t for _, t in items])
    hits, found, best = decontam.match_shard(Words(pa.array(docs), ALNUM), block, 8)
    for d, t in enumerate(docs):
        n, n_hit, ids = brute_leak(t, items)
        assert (sum(hits[d][1::2]) - sum(hits[d][::2]), sorted(found[d])) == (n_hit, ids)
        assert best[d] == longest(t, items)


def test_suffix_array_is_sorted():
    import numpy as np

    r = random.Random(0)
    x = np.array([r.choice([0, 1, 1, 2, 3]) for _ in range(500)])
    sa, _ = decontam.suffix_array(x)
    upto = lambda i: next((tuple(x[i:j]) for j in range(i, len(x)) if x[j] == 0), tuple(x[i:]))
    suffixes = [upto(i) for i in sa.tolist()]
    assert sorted(sa.tolist()) == list(range(500)) and all(a <= b or a[: len(b)] == b for a, b in zip(suffixes, suffixes[1:], strict=False))


def test_op7_equals_sql(spark, duck, sf):
    same(queries.op7_decontamination(spark, sf), duck, queries.SQL["op7_decontamination"])


def test_decontamination_in_blocks_and_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(50, "one two three four five six seven eight nine", "y"), (50, "one two three four five six seven eight nine", "y"), (51, "short item", "z"), (None, "short item", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leak string")
    bench = spark.createDataFrame([(1, "zero one two three four five six seven eight"), (2, "Short ITEM"), (3, None), (4, ""), (5, "two three four five six seven eight nine ten")], "item_id long, text string")
    for size in (16_000_000, 60):
        out = decontam.scan(docs, bench, block_bytes=size)
        assert out.columns == [*docs.columns, "leak_"]
        rows_ = out.collect()
        got = collections.Counter((r["doc_id"], r["leak_"]["n_words"], tuple(r["leak_"]["hit_spans"]), tuple(r["leak_"]["items"])) for r in rows_)
        place = lambda r: tuple(r["leak_"][c] for c in ("longest_match", "longest_item", "longest_item_start", "longest_doc_start"))
        assert {place(r) for r in rows_ if r["doc_id"] == 50} == {(8, "1", 1, 0)} and {place(r) for r in rows_ if r["doc_id"] == 51} == {(2, "2", 0, 0)} and {place(r) for r in rows_ if r["doc_id"] == 3} == {(None,) * 4}
        assert got[50, 9, (0, 9), ("1", "5")] == 2 and got[51, 2, (0, 2), ("2",)] == 1 and got[None, 2, (0, 2), ("2",)] == 1
        assert sum(got.values()) == len(rows)
    left = decontam.remove_contaminated(docs, bench)
    assert left.count() == len(ODD) and left.columns == docs.columns
    assert decontam.remove_contaminated(docs.limit(0), bench).count() == 0
    assert decontam.remove_contaminated(docs, bench.limit(0)).count() == len(rows)


# --- licences ---


def brute_base(text):
    w = words(text)
    out = []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        out += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return out


def test_licence_base_and_fuzzy(spark):
    texts = [
        *ODD, "Released Under the MIT License.", "under the mit license under the mit license", "under the mit\n\nlicense", "understand the mit license", "Apache License, Version 2.0", "apache license version 3", "CC-BY-NC 4.0", "cc by nd", "ccby nc",
        "undr the mit licence here", "GNU Lesser General Public License", "gnu general pubic license", "nothing at all", "All rights reservd",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("licence", F.lit(1))
    got = {r["doc_id"]: r["licence_"] for r in license_scan.scan(docs).collect()}
    assert license_scan.scan(docs.limit(0)).count() == 0
    for i, t in enumerate(texts):
        base = brute_base(t)
        assert got[i]["n_words"] == len(words(t))
        assert got[i]["base_words"] == sorted(k for k, _ in base)
        assert got[i]["base_labels"] == sorted({x for _, x in base})
        assert set(got[i]["base_labels"]) <= set(got[i]["labels"])
    of = {t: got[i] for i, t in enumerate(texts)}
    assert of["undr the mit licence here"]["labels"] == ["mit"] and of["undr the mit licence here"]["spans"][0]["errors"] == 2
    assert of["undr the mit licence here"]["score"] == pytest.approx(1 - 2 / 21)
    assert of["apache license version 3"]["labels"] == [] and of["cc by nd"]["labels"] == ["cc-by-nd"]
    assert of["GNU Lesser General Public License"]["labels"] == ["lgpl"] and of["gnu general pubic license"]["labels"] == ["gpl"]
    assert of["nothing at all"]["score"] == 0 and of["All rights reservd"]["labels"] == ["all-rights-reserved"]
    assert of["Released Under the MIT License."]["score"] == 1


def test_every_edited_notice_is_found():
    r, search = random.Random(4), license_scan.Searcher()
    for notice, _label, errors in license_scan.NOTICES:
        for _ in range(30 if errors else 1):
            s = list(notice)
            for _ in range(errors):  # edits inside words keep the words apart
                inner = [i for i in range(1, len(s) - 1) if " " not in (s[i - 1], s[i], s[i + 1])]
                if inner:
                    at = r.choice(inner)
                    s[at : at + 1] = [[], [r.choice("qxz")], [s[at], r.choice("qxz")]][r.randrange(3)]
            text = f"aa bb {''.join(s)} cc dd "
            found = {license_scan.NOTICES[i][0] for i, *_ in search.spans(text)[1]}
            assert notice in found or "".join(s) in search.exact, (notice, text)


def test_worse_notices_beside_better_ones():
    search = license_scan.Searcher()
    found = search.spans("under the mit licence " * 5 + "under the mit license ")[1]
    assert sorted((s, errors) for _, s, _, errors in found) == [(22 * k, 1) for k in range(5)] + [(110, 0)]
    found = search.spans("apache licens vrsion 2 apache license version 3 ")[1]
    assert [(license_scan.NOTICES[i][1], s, errors) for i, s, _, errors in found] == [("apache-2", 0, 2)]
    found = search.spans("ccby nc cc by nc ccby nc ")[1]
    assert sorted((s, errors) for _, s, _, errors in found) == [(0, 1), (8, 0), (17, 1)]
    assert len(search.spans("undr the mit license apache license version 3 " * 3_000)[1]) == 3_000


def test_op2_counts(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_license_scan(spark, sf).collect():
        base = brute_base(docs[r["doc_id"]])
        at = sorted(k for k, _ in base)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words(docs[r["doc_id"]])), len(base), at[0] if at else None, at[-1] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))


# --- personal data ---

PATTERNS = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(d):
    twice = [int(c) * 2 for c in d[-2::-2]]
    return (sum(int(c) for c in d[-1::-2]) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def brute_pii(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in p.finditer(t):
            d = "".join(c for c in m[0] if c in "0123456789")
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


AUTOMATON = pii._automaton()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["@", "a", "b.", ".", "1", "22", "9", "+", " ", "-", "(", ")", "é", "255", "0", "4111111111111111", "%", "1.2.3.4", "x@y.z", "iban ", "token = "]), max_size=40).map("".join))
def test_base_spans(text):
    assert [s for s in pii.find(text, AUTOMATON) if s[0] in pii.BASE_KINDS] == brute_pii(text)


@pytest.mark.parametrize("text", ["1" * 100_000, "a" * 100_000 + "@", "a@" * 50_000, "1." * 50_000, "+1" * 50_000, "a@b" + ".c" * 50_000, "http://" * 20_000, "token = " * 20_000])
def test_linear_on_hostile_texts(text):
    import time

    start = time.process_time()
    pii.find(text, AUTOMATON)
    assert time.process_time() - start < 5


def test_added_kinds_and_redaction(spark):
    text = 'Mail a.b@x.org, IBAN DE89 3704 0044 0532 0130 00, account no. 12345678; token = "0123456789abcdef0123" see https://x.org/a?b. Card 4111 1111 1111 1111 +1 (555) 123-4567 at 10.0.0.1'
    spans = pii.find(text, AUTOMATON)
    assert {k: text[a:b] for k, a, b in spans} == {"email": "a.b@x.org", "ip": "10.0.0.1", "card": "4111 1111 1111 1111", "phone": "+1 (555) 123-4567", "iban": "DE89 3704 0044 0532 0130 00", "account": "12345678", "secret": "0123456789abcdef0123", "url": "https://x.org/a?b"}
    docs = spark.createDataFrame([(1, text, 7), (2, None, 0), (3, "", 0), (4, "clean", 5), (4, "clean", 5)], "doc_id long, text string, n_chars int").withColumn("pii", F.lit("mine"))
    out = pii.redact(docs)
    assert out.schema == docs.schema
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    clean = 'Mail <EMAIL>, IBAN <IBAN>, account no. <ACCOUNT>; token = "<SECRET>" see https://x.org/a?b. Card <CARD> <PHONE> at <IP>'
    assert (rows[0]["text"], rows[0]["n_chars"]) == (clean, len(clean))
    assert [(r["text"], r["n_chars"]) for r in rows[1:]] == [(None, 0), ("", 0), ("clean", 5), ("clean", 5)]
    assert pii.redact(docs.limit(0)).count() == 0
    assert pii.scan(docs).columns == [*docs.columns, "pii_"] and pii.scan(docs.limit(0)).count() == 0


def test_kinds_without_limits():
    one = lambda t: {(k, t[a:b]) for k, a, b in pii.find(t, AUTOMATON)}
    for n in (100, 513, 100_000):
        assert one(f'Api_Key="{"k7" * n}"') == {("secret", "k7" * n)}
    assert one("ApiKey: abcdefghijklmnop1") == {("secret", "abcdefghijklmnop1")}
    far = "x " * 500
    assert one(f"iBan {far}DE89370400440532013000 BIC COBADEFF and GB29 NWBK 6016 1331 9268 19.") == {("iban", "DE89370400440532013000"), ("iban", "GB29 NWBK 6016 1331 9268 19")}
    assert one("DE89370400440532013001 XDE89370400440532013000 DE893704004405320130001 ZZ89370400440532013000") == set()
    assert one("İ PASSWORD=abcdefghijklmnop1") == {("secret", "abcdefghijklmnop1")}


def test_a_language_of_one_long_text(spark):
    """The only text of a language may be long; ties in hash go by text."""
    r = random.Random(9)
    long_ = " ".join("".join(r.choices("äöüqxz", k=6)) for _ in range(12_000))
    assert len(long_.encode()) > 85_000
    docs = spark.createDataFrame([(i, "the cat and the dog in the house", "en") for i in range(20)] + [(30, long_, "xx")], "doc_id long, text string, lang string")
    model = lang_id.train(docs, order_by=F.col("doc_id"))
    assert model.langs == ["en", "xx"]
    assert {r["doc_id"]: r["language"]["lang"] for r in lang_id.predict(docs, model).collect()}[30] == "xx"
    whole = lang_id.Contexts.of([long_])
    assert all((a == b).all() for a, b in zip(model.trees[1].levels[4], whole.levels[4], strict=True))


def test_op8_digest(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op8_pii(spark, sf).collect():
        base = brute_pii(docs[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in base) for k in pii.BASE_KINDS]
        assert set(joined.split(",")) <= set(r["spans"].split(","))


# --- language ---


def naive_bits(texts, order, s):
    counts = collections.defaultdict(collections.Counter)
    code = lambda t: b" " * order + b"".join(w + b" " for w in t.encode().translate(lang_id.LETTERS).split())
    for t in texts:
        b = code(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k : i]][b[i]] += 1
    b, total = code(s), 0.0
    for i in range(order, len(b)):
        ruled = set()
        for k in range(order, -1, -1):
            c = {x: n for x, n in counts.get(b[i - k : i], {}).items() if x not in ruled}
            n = sum(c.values()) + len(c)
            if b[i] in c:
                total += math.log2(n / c[b[i]])
                break
            if c:
                total += math.log2(n / len(c))
            ruled |= set(c)
        else:
            total += math.log2(256 - len(ruled))
    return total


@pytest.mark.parametrize("order", [1, 2, 4])
def test_ppm_is_exact(order):
    texts = ["der hund und die katze", "das ist ein haus", "und und und", "ÄÖ ü"]
    tree = lang_id.Contexts.of(texts, order)
    probe = ["der mann", "zxq und é katze", "", "und", "1 2 3", "das ist das haus ä" * 20]
    code, off = ngrams.grams(Words(pa.array(probe), lang_id.LETTERS), order, lang_id.SPACE)
    got = ngrams.sums(tree.bits(code)[:, None], off)[:, 0]
    assert got == pytest.approx([naive_bits(texts, order, p) for p in probe])


def test_language_odd_rows(spark):
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(100, "12 34 %%", "en"), (101, "the cat and the dog", "en"), (102, "der hund und die katze", "de"), (103, "—…“", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit(1))
    model = lang_id.train(docs)
    assert model.langs == ["de", "en"]
    got = {r["doc_id"]: r["language_"] for r in lang_id.predict(docs, model).collect()}
    for i in (0, 1, 2, 100, 103):
        assert (got[i]["lang"], got[i]["score"]) == ("und", 0.0)
    assert got[101]["lang"] == "en" and got[102]["lang"] == "de" and all(0 <= g["score"] <= 1 for g in got.values())
    empty = lang_id.train(docs.limit(0))
    assert {r["language_"]["lang"] for r in lang_id.predict(docs, empty).collect()} == {"und"}
    kept = lang_id.reject(docs, model)
    assert kept.columns == docs.columns and 100 not in {r["doc_id"] for r in kept.collect()}


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = queries.op1_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(r) > 20 and sum(x["lang_pred"] == x["lang"] for x in r) >= 0.97 * len(r)


def edit_distance_spans(text, notice, errors):
    """Ends of all runs of whole words within so many edits of a notice."""
    w = text.split()
    starts = [sum(len(x) + 1 for x in w[:k]) for k in range(len(w) + 1)]
    out = set()
    for a in range(len(w)):
        for b in range(a + 1, min(len(w), a + len(notice.split()) + errors) + 1):
            s = " ".join(w[a:b])
            if abs(len(s) - len(notice)) <= errors:
                row = list(range(len(notice) + 1))
                for i, c in enumerate(s, 1):
                    row, up = [i], row
                    for j, d in enumerate(notice, 1):
                        row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (c != d)))
                if row[-1] <= errors:
                    out.add((starts[a], starts[a] + len(s), row[-1]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_neighbouring_notices_by_edit_distance(seed):
    """Every run of words within the allowed edits overlaps a reported span with
    no more errors than it, and every reported span is such a run."""
    r = random.Random(seed)
    notices = (("mozilla public license", "mpl", 2), ("eclipse public license", "epl", 2))
    search = license_scan.Searcher(base={}, notices=notices)
    for _ in range(25):
        parts = []
        for _ in range(r.randrange(1, 6)):
            s = list(r.choice(notices)[0])
            for _ in range(r.randrange(3)):
                k = r.randrange(1, len(s) - 1)
                s[k : k + 1] = r.choice([[], ["q"], [s[k], "z"]])
            parts += ["".join(s), *r.choices(["x", "yy", ""], k=r.randrange(2))]
        text = " ".join(" ".join(parts).split()) + " "
        for i, (notice, _, errors) in enumerate(notices):
            want = {x for x in edit_distance_spans(text, notice, errors) if text[x[0] : x[1]] not in search.exact - {notice}}
            got = {(s, e, n) for k, s, e, n in search.spans(text)[1] if k == i}
            assert got <= want
            for s, e, n in want:
                assert any(a < e and s < b for a, b, m in got if m <= n), (text, notice, (s, e, n), got)


def test_many_notices_in_one_text():
    import time

    start = time.process_time()
    base, found = license_scan.Searcher().spans("under the mit license " * 100_000)
    assert len(base) == len(found) == 100_000 and time.process_time() - start < 60


def test_workers_need_no_installed_package(sf, tmp_path):
    """All that is shared travels with its code: workers that can't import the
    package run every query that shares something."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[4]').config('spark.sql.shuffle.partitions', '4').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "def there(batches):\n    import importlib.util\n    assert importlib.util.find_spec('kvlume') is None\n    yield from batches\n"
        "spark.range(1).mapInArrow(there, 'id long').count()\n"
        "from kvlume import catalog\nfrom kvlume.llm import queries\n"
        "for f in (*(queries.QUERIES[n] for n in ('op1_language_id', 'op2_license_scan', 'op4_toxicity', 'op6_lm_score', 'op7_decontamination', 'op8_pii', 'op9_media')), catalog.QUERIES['predicted_loads']):\n"
        f"    assert len(f(spark, {sf!r}).collect()) > 0\n"
        "print('all ran')\n"
    )
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "all ran" in done.stdout, done.stderr[-1500:]
