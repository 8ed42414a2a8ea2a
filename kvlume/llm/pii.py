"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus signs,
digits, URL schemes and identifier cues.  From each anchor a deterministic
parser expands to the boundaries and validates what it found.  The parsers give
what leftmost, non-overlapping matching of the patterns below gives, but take
time linear in the text, however it is made:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)   each part at most 255
    card   [0-9]([\\x20-]?[0-9])+                   13 to 19 digits, Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]              9 to 15 digits

A match that fails its test is dropped and not tried again shorter.  Further
kinds: ``iban`` (a country's letters before a digit anchor it; its length and
mod 97 must fit), and anchored by cues or schemes ``account`` (a number after a
cue), ``secret`` (a quoted or bare value after a cue) and ``url``.
"""

from __future__ import annotations

import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlume.llm.arrow import add_result, as_string, column_name

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "account", "secret", "url")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
RESULT = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())])

# Cues in lower case; texts are searched without regard to case.
ACCOUNT_CUES = ("account", "acct", "ssn", "passport", "customer no")
SECRET_CUES = ("token", "api_key", "apikey", "secret", "password", "passwd")
SCHEMES = ("http://", "https://", "ftp://")
# Lengths of international account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_CAPITALS_DIGITS = frozenset(string.ascii_uppercase + string.digits)
_WORDLIKE = frozenset(string.ascii_letters + string.digits)
_ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9.]*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE_TAIL = re.compile(r"[0-9][ ().0-9-]++")
_ACCOUNT = re.compile(r"(?i:(?: ?(?:number|no\.?|nr\.?|id))?)[ \t]{0,2}[:#=]?[ \t]{0,2}([0-9](?:[ -]?[0-9]){5,19})(?![A-Za-z0-9])")
_SECRET = re.compile(r"[ \t]{0,2}[:=][ \t]{0,2}([\"']?)([A-Za-z0-9_/+.=-]{16,}+)\1(?![A-Za-z0-9])")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]++")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for s in "@+0123456789":
        a.add_word(s, (s if s in "@+" else "0", 1))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("url", SCHEMES)):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in string.digits)


def _iban(text: str, at: int) -> int:
    """The end of an account number that begins at ``at``, or -1: its country's
    length of capitals and digits, single spaces between them, mod 97."""
    n, out, end = IBAN_LENGTHS.get(text[at : at + 2], 0), [], at
    while len(out) < n and end < len(text):
        c = text[end]
        if c in _CAPITALS_DIGITS:
            out.append(c)
        elif c != " " or text[end - 1] == " ":
            return -1
        end += 1
    if not n or len(out) < n or text[end : end + 1] in _WORDLIKE:
        return -1
    return end if int("".join(str(int(c, 36)) for c in out[4:] + out[:4])) % 97 == 1 else -1


def _lower(text: str) -> str:
    """Lower case, of equal length."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def _part_ok(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def _ips(text: str, at: int, end: int, out: list) -> None:
    """Groups of four among the dotted parts of a maximal run of digits and dots."""
    parts = text[at:end].split(".")
    i, starts = 0, [at]
    for p in parts[:-1]:
        starts.append(starts[-1] + len(p) + 1)
    while i + 4 <= len(parts):
        gap = next((j for j in range(i + 3, i - 1, -1) if not parts[j]), None)
        if gap is not None:
            i = gap + 1
            continue
        if all(_part_ok(p) for p in parts[i : i + 4]):
            out.append(("ip", starts[i], starts[i + 3] + len(parts[i + 3])))
        i += 4


def find(text: str, automaton) -> list[tuple[str, int, int]]:
    """All spans of a text in code points, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    email_from = at_from = dotted_to = card_to = iban_to = url_to = 0
    last_cue = {"account": 0, "secret": 0}
    for last, (kind, size) in automaton.iter(_lower(text)):
        at = last + 1 - size
        if kind == "0":
            if at - 2 >= iban_to and text[at - 2 : at] in IBAN_LENGTHS and text[at - 3 : at - 2] not in _WORDLIKE and (end := _iban(text, at - 2)) > 0:
                out.append(("iban", at - 2, end))
                iban_to = end
            if at >= dotted_to:
                end = _DOTTED.match(text, at).end()
                if text.find(".", at, end) >= 0:
                    # dots before the first digit belong to no match
                    _ips(text, at, end, out)
                dotted_to = end
            if at >= card_to:
                m = _CARD.match(text, at)
                card_to = m.end() if m else last + 1
                if m and m.end() - at >= 13:
                    d = _digits(m[0])
                    if 13 <= len(d) <= 19 and luhn(d):
                        out.append(("card", at, m.end()))
        elif kind == "@":
            low = max(email_from, at_from)
            before = text[low:at]
            start = low + len(before.rstrip(_LOCAL))
            at_from = last + 1
            if start < at and (m := _DOMAIN.match(text, last + 1)):
                out.append(("email", start, m.end()))
                email_from = m.end()
        elif kind == "+":
            if m := _PHONE_TAIL.match(text, last + 1):
                tail = m[0].rstrip(" ().-")
                if len(tail) >= 3 and 9 <= len(_digits(tail)) <= 15:
                    out.append(("phone", at, last + 1 + len(tail)))
        elif kind == "url":
            if at >= url_to:
                body = _URL.match(text, last + 1)
                url_to = last + 1
                if body and (kept := body[0].rstrip(".,;:!?)]")):
                    url_to = last + 1 + len(kept)
                    out.append(("url", at, url_to))
        elif at >= last_cue[kind] and (at == 0 or not text[at - 1].isalnum()):
            m = (_ACCOUNT if kind == "account" else _SECRET).match(text, last + 1)
            if m:
                k = 1 if kind == "account" else 2
                out.append((kind, m.start(k), m.end(k)))
                last_cue[kind] = m.end()
    order = {k: i for i, k in enumerate(KINDS)}
    out.sort(key=lambda s: (order[s[0]], s[1]))
    return out


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by their kind; of overlapping ones the first names them."""
    out, at, until, kind = [], 0, -1, ""
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < until:
            until = max(until, e)
            continue
        if until >= 0:
            out.append(f"<{kind.upper()}>")
            at = until
        out.append(text[at:s])
        until, kind = e, k
    if until >= 0:
        out.append(f"<{kind.upper()}>")
        at = until
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text_col: str = "text", name: str = "pii", redact: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with a struct column ``name`` (underscores are added where a column
    has it already): all spans, and the text with the kinds in ``redact`` replaced
    (null if there are none or the text is null).

    A null or empty text has no spans. Rows are judged one by one, so repeated
    rows get equal results; an empty table gives an empty result.
    """
    docs = as_string(docs, text_col)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def start():
        automaton = _automaton()

        def one(texts):
            spans, clean = [], []
            for t in texts.to_pylist():
                s = find(t, automaton) if t else []
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in s])
                chosen = [x for x in s if x[0] in redact]
                clean.append(redact_text(t, chosen) if chosen else (t if redact else None))
            return [pa.array(spans, span_type), pa.array(clean, pa.string())]

        return one

    return add_result(docs, text_col, start, RESULT, name)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", kinds: tuple[str, ...] = KINDS[:-1]) -> DataFrame:
    """The documents with personal data replaced by ``<KIND>``; ``length_col``,
    where there is one, follows the new text. No document is dropped."""
    docs = as_string(docs, text_col)
    name = column_name(docs, "pii")
    out = scan(docs, text_col, name, kinds)
    text = F.col(name)["redacted"]
    new = {text_col: text}
    if length_col in docs.columns:
        kind = dict(docs.dtypes)[length_col]
        new[length_col] = F.when(text.eqNullSafe(F.col(text_col)), F.col(length_col)).otherwise(F.length(text).cast(kind))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
