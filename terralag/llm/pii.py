"""Personal data by anchor expansion.

One Aho-Corasick pass per text finds anchors: at-signs, plus signs, digits, URL schemes and identifier
cues. Each anchor is expanded by a parser of its kind to the boundaries of an email, address or account and
validated. Parsers work on maximal runs and start behind what they read last, so time is linear in the text
whatever it holds, and they give exactly the leftmost non-overlapping matches of

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 13 to 19 digits that pass the Luhn test
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

These are the base spans. Two kinds are added: ``login``, the ``user[:password]@host`` of a URL or the
address behind ``mailto:``, ``sip:`` or ``xmpp:`` where it is no base email; and ``account``, the identifier
behind a cue (IBAN with a valid check number, a nine-digit social security number, an account or passport
number of 6 to 17 letters and digits with 6 digits or more). Spans are in code points, end exclusive.

Defined cases: null is the empty text, without spans; repeated rows are read one by one; a null doc_id stays;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralag.llm.common import slices, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEMES = ("http://", "https://", "ftp://", "ftps://", "ssh://", "sftp://", "mailto:", "sip:", "xmpp:")
_AUTHORITY = re.compile(r"[A-Za-z0-9._%+-]+(?::[^\s/@:]{1,128})?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "number", "acct": "number", "passport": "number"}
_AFTER_CUE = r"(?i: ?(?:number|no|nr|num|id|#))?[.:#=]{0,2} ?"
_PARSERS = {
    "iban": re.compile(_AFTER_CUE + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])"),
    "ssn": re.compile(_AFTER_CUE + r"([0-9]{3}-?[0-9]{2}-?[0-9]{4})(?![0-9-])"),
    "number": re.compile(_AFTER_CUE + r"([A-Za-z]{0,3}[0-9]{6,17})(?![A-Za-z0-9])"),
}


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(d) if i % 2 == 0 else double[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def iban_valid(text: str) -> bool:
    x = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789@+":
        a.add_word(c, (c if c in "@+" else "digit", 1))
    for kind, words in (("scheme", _SCHEMES), ("cue", _CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize(), w.title()}:
                a.add_word(form, (kind if kind == "scheme" else _CUES[w], len(w)))
    a.make_automaton()
    return a


_automaton = None


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans, by kind as in ``KINDS`` and then by start."""
    global _automaton
    if _automaton is None:
        _automaton = _anchors()
    found = {k: [] for k in KINDS}
    ends = dict.fromkeys((*BASE, "dotted"), 0)
    for last, (kind, length) in _automaton.iter(text):
        if kind == "digit":
            if last >= ends["dotted"]:
                ends["dotted"] = _dotted(text, last, found["ip"])
            if last >= ends["card"]:
                m = _CHAIN.match(text, last)
                ends["card"] = m.end() if m else last + 1
                if m and 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d):
                    found["card"].append((last, m.end()))
        elif kind == "@":
            start = last
            while start > ends["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                found["email"].append((start, m.end()))
                ends["email"] = m.end()
        elif kind == "+":
            if last >= ends["phone"] and (m := _PHONE.match(text, last)):
                ends["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif kind == "scheme":
            if m := _AUTHORITY.match(text, last + 1):
                found["login"].append(m.span())
        elif (last + 1 - length == 0 or not text[last - length].isalnum()) and (m := _PARSERS[kind].match(text, last + 1)):
            if kind != "iban" or iban_valid(m.group(1)):
                found["account"].append(m.span(1))
    emails = set(found["email"])
    found["login"] = [x for x in found["login"] if x not in emails]
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def _dotted(text: str, start: int, ips: list) -> int:
    """The addresses of the chain of dotted numbers at ``start``, four numbers each; where it ends."""
    m = _DOTTED.match(text, start)
    parts, at = m.group().split("."), start
    for i in range(0, len(parts) - 3, 4):
        end = at + sum(map(len, parts[i : i + 4])) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[i : i + 4]):
            ips.append((at, end))
        at = end + 1
    return m.end()


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``; spans are ``(kind, start, end)`` in the order of ``spans()``."""

    def run(batches):
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in slices(batches):
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t)] for t in texts(part)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, struct)], names=["doc_id", "spans"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``personal_data``."""
    is_base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(is_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
