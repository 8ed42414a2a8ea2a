"""Licence notices: exact phrases, and short notices with a few errors.

Texts are reduced to words (A-Z lower-cased) with one space between them.  A
notice that may have k errors is split in k + 1 pieces: one of them must occur
unchanged (pigeonhole).  One Aho-Corasick pass finds the pieces; around each
place the regex library's bounded-error matching verifies the notice and
reports the span and the number of errors.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kvlume.llm.arrow import ALNUM, Words, add_result, as_string

# The exact phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices, their labels and the errors allowed.
NOTICES = (
    ("under the mit license", "mit", 2),
    ("permission is hereby granted free of charge", "mit", 4),
    ("apache license version 2", "apache-2", 2),
    ("cc by nc", "cc-by-nc", 1),
    ("cc by nd", "cc-by-nd", 0),
    ("cc by sa", "cc-by-sa", 0),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("redistribution and use in source and binary forms", "bsd", 5),
    ("released into the public domain", "public-domain", 3),
    ("all rights reserved", "all-rights-reserved", 2),
)

SPAN = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("end_word", T.LongType()),  # exclusive
    T.StructField("errors", T.LongType()),
    T.StructField("found", T.StringType()),
])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("base_words", T.ArrayType(T.LongType())),  # starts of exact phrases
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("score", T.DoubleType()),
])


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length, with their offsets."""
    cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Searcher:
    def __init__(self, base=None, notices=NOTICES):
        import ahocorasick
        import regex

        self.base = BASE if base is None else base
        self.notices = notices
        self.exact = {n for n, _, _ in notices} | set(self.base)
        seeds: dict[str, list] = {}
        for i, (notice, _, errors) in enumerate(notices):
            for off, piece in pieces(notice, errors):
                seeds.setdefault(piece, []).append((i, off))
        for phrase in self.base:
            seeds.setdefault(f"{phrase} ", []).append((-1, phrase))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()
        self.check = [regex.compile(rf"(?b)(?<![^ ])(?:{notice}){{e<={errors}}}(?![^ ])") for notice, _, errors in notices]

    def spans(self, text: str):
        """Places of a text of words that each end in one space: ``(phrase,
        start)`` of the exact ones, ``(notice, start, end, errors)`` of the others."""
        base, windows, places = [], set(), set()
        for last, (size, where) in self.seeds.iter(text):
            at = last + 1 - size
            for i, off in where:
                if i < 0:
                    if at == 0 or text[at - 1] == " ":
                        base.append((off, at))
                    continue
                notice, _, k = self.notices[i]
                begin = at - off
                if text.startswith(notice, max(begin, 0)) and begin >= 0 and (begin == 0 or text[begin - 1] == " ") and text[begin + len(notice) : begin + len(notice) + 1] in (" ", ""):
                    # whatever else stands beside an exact notice has pieces of its own
                    places.add((i, 0, begin, begin + len(notice)))
                    continue
                # whole words; a window of its own for each piece, so work is linear in repeated notices
                hi = text.find(" ", min(at - off + len(notice) + k, len(text)))
                windows.add((i, text.rfind(" ", 0, max(0, at - off - k)) + 1, len(text) if hi < 0 else hi))
        todo, seen = list(windows), windows
        while todo:
            i, lo, hi = todo.pop()
            m = self.check[i].search(text, lo, hi)
            if m is None:
                continue
            (s, e), got, notice = m.span(), m[0], self.notices[i][0]
            # another notice's own words, or other version digits, are no misspelling
            good = (s == 0 or text[s - 1] == " ") and text[e : e + 1] in (" ", "") and (got == notice or got not in self.exact) and [c for c in got if c.isdigit()] == [c for c in notice if c.isdigit()]
            if good:
                places.add((i, sum(m.fuzzy_counts), s, e))
                rest = ((i, lo, s - 1), (i, e + 1, hi))
            else:  # a worse match may overlap the one rejected
                after = text.find(" ", s + 1, hi)
                rest = ((i, lo, text.rfind(" ", lo, e - 1)), (i, after + 1 if after >= 0 else hi, hi))
            for w in rest:
                if w[1] < w[2] and w not in seen:
                    seen.add(w)
                    todo.append(w)
        found, taken = [], {}
        for i, errors, s, e in sorted(places):  # fewest errors first; those that overlap one kept go
            own = taken.setdefault(i, [])
            k = bisect.bisect(own, (s, e))
            if not ((k and own[k - 1][1] > s) or (k < len(own) and own[k][0] < e)):
                own.insert(k, (s, e))
                found.append((i, s, e, errors))
        return base, found


def scan(docs: DataFrame, text_col: str = "text", name: str = "licence", base=None, notices=NOTICES) -> DataFrame:
    """``docs`` with a struct column ``name`` (see RESULT); underscores are added
    to a name that a column has already.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased.
    ``score`` is the best found notice's share of unchanged characters: 1 for an
    exact one, 0 without any. Null and empty texts have no words, no labels and
    score 0; rows are judged one by one; an empty table gives an empty result.
    """
    docs = as_string(docs, text_col)
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("errors", pa.int64()), ("found", pa.string())]))

    def start():
        search = Searcher(base, notices)

        def one(texts):
            w = Words(texts, ALNUM)
            n = len(w.doc) - 1
            starts, base_labels, labels, spans, score = ([[] for _ in range(n)], [set() for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)], [0.0] * n)
            begin = w.start[w.doc]
            raw = w.buf.tobytes()
            for d in range(n):
                if w.doc[d] == w.doc[d + 1]:
                    continue
                text = raw[begin[d] : begin[d + 1]].decode()
                exact, found = search.spans(text)
                if not exact and not found:
                    continue
                # words before a place: spaces before it
                spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
                before = lambda at, spaces=spaces: int(np.searchsorted(spaces, at))
                for phrase, at in exact:
                    starts[d].append(before(at))
                    base_labels[d].add(search.base[phrase])
                    score[d] = 1.0
                for i, s, e, errors in found:
                    notice, label, _ = notices[i]
                    spans[d].append({"label": label, "first_word": before(s), "end_word": before(e) + 1, "errors": errors, "found": text[s:e]})
                    labels[d].add(label)
                    score[d] = max(score[d], 1 - errors / len(notice))
                spans[d].sort(key=lambda x: (x["first_word"], x["end_word"], x["label"]))
                labels[d] |= base_labels[d]
            return [w.counts, pa.array([sorted(x) for x in starts], pa.list_(pa.int64())), pa.array([sorted(x) for x in base_labels], pa.list_(pa.string())), pa.array([sorted(x) for x in labels], pa.list_(pa.string())), pa.array(spans, span_type), np.array(score)]

        return one

    return add_result(docs, text_col, start, RESULT, name)
