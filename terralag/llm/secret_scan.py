"""Secrets in texts, with credentials linked from their parts.

Three kinds are secrets by themselves, each the leftmost non-overlapping matches of its pattern that are long enough:

* assign ``(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)``, 6+ characters in group 2
* access ``AKIA[A-Z0-9]+``, 20+ characters
* hex ``[0-9a-f]+``, 24+ characters

Four kinds are weak candidates, too common to be reported alone: ``account`` (an assigned user, login, client or account
id), ``phrase`` (an assigned passphrase, pin or private key), ``bare`` (a run of 20+ letters and digits that mixes upper
case, lower case and digits) and ``endpoint`` (a URL's scheme and host, or an assigned host). A weak candidate that
overlaps one of the three kinds is none, nor is a bare run that overlaps another weak candidate.

Linking is an interval join inside a scope, the text between blank lines. The intervals of candidates, widened by
``reach`` code points, are joined with the nearest part of another role: identifiers (access, account) with secrets
(assign, hex, phrase, bare), and endpoints with both. An account is reported beside a secret, a phrase or bare run
beside an identifier, an endpoint beside an identifier and a secret. Both sides of the join come from one text, so it runs
where the text is, without a shuffle, over sorted arrays: n log n in a text's candidates, never all pairs. Each
identifier gives one credential: itself, its nearest secret and its nearest endpoint.

Defined cases: null is the empty text, without spans; repeated rows are read one by one; a null doc_id stays; among
parts equally near the earlier one counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralag.llm.common import slices, texts

REACH = 240


def _assigned(cues: str, value: str) -> str:
    """A cue in either case, a sign and a value as group 2."""
    either = re.sub("[a-z]", lambda m: f"[{m.group().upper()}{m.group()}]", cues)
    return rf"""({either})["']?\x20*[:=]\x20*["']?({value})"""


#: Kinds in the order of the digests; both regular expression engines in use read these patterns alike.
PATTERNS = {
    "assign": _assigned("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+"),
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "account": _assigned("user|username|user_name|login|client_?id|account_?id|access_?id", "[A-Za-z0-9@._+-]+"),
    "phrase": _assigned("pass|pwd|passphrase|pin|credentials?|private_?key", r"""[^\x00-\x20"',;]+"""),
    "bare": "[A-Za-z0-9+/_-]+",
    "endpoint": r"(https?|ftps?|sftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:@-]+|" + _assigned("host|hostname|server|endpoint", "[A-Za-z0-9.-]+").replace("(", "(?:"),
}
BASE, KINDS = ("assign", "access", "hex"), tuple(PATTERNS)
#: Least length, of group 2 for assigned kinds and of the match for the others.
LEAST = {"assign": 6, "access": 20, "hex": 24, "account": 3, "phrase": 4, "bare": 20, "endpoint": 1}
_GROUPED = ("assign", "account", "phrase")
BLANK = r"\n(?:[\x20\t\r]*\n)+"
#: A run that is too short is skipped by the pattern itself: the same matches, found faster.
FINDERS = PATTERNS | {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "bare": "[A-Za-z0-9+/_-]{20,}"}
_COMPILED = {k: re.compile(p) for k, p in FINDERS.items()}
_BLANK = re.compile(BLANK)
_MIXED = tuple(re.compile(x) for x in ("[A-Z]", "[a-z]", "[0-9]"))

Span = tuple[str, int, int]


def _find(kind: str, text: str) -> list[Span]:
    group, least, out = 2 if kind in _GROUPED else 0, LEAST[kind], []
    for m in _COMPILED[kind].finditer(text):
        a, b = m.span(group)
        if b - a >= least and (kind != "bare" or all(x.search(m.group()) for x in _MIXED)):
            out.append((kind, *m.span()))
    return out


class Intervals:
    """Spans by start, to be asked for the one nearest to another span of the same scope."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans, key=lambda s: (s[1], s[2], KINDS.index(s[0])))
        self.starts = [s[1] for s in self.spans]
        # the span that reaches furthest among those up to each place; the first one of equals
        self.furthest = list(accumulate(range(len(self.spans)), lambda i, j: j if self.spans[j][2] > self.spans[i][2] else i))

    def nearest(self, span: Span, low: int, high: int) -> Span | None:
        """The span nearest to ``span`` that meets ``[low, high]``."""
        _, a, b = span
        at = bisect_right(self.starts, b)
        best, gap = None, None
        if at:
            s = self.spans[self.furthest[at - 1]]
            if s[2] >= low:
                best, gap = s, max(a - s[2], 0)
        if at < len(self.spans) and self.starts[at] <= high and (best is None or self.starts[at] - b < gap):
            best = self.spans[at]
        return best

    def overlaps(self, span: Span) -> bool:
        at = bisect_left(self.starts, span[2])
        return at > 0 and self.spans[self.furthest[at - 1]][2] > span[1]


def scan(text: str, reach: int = REACH) -> tuple[list[Span], list[tuple[int, int, int | None]]]:
    """All reported spans by kind and start, and the starts of each credential's identifier, secret and endpoint."""
    found = {k: _find(k, text) for k in BASE}
    base = Intervals([s for k in BASE for s in found[k]])
    found["account"] = [s for s in _find("account", text) if not base.overlaps(s)]
    identifiers = Intervals(found["access"] + found["account"])
    if not identifiers.spans:  # nothing that a weak candidate could complement
        return [s for k in BASE for s in found[k]], []
    for kind in ("phrase", "endpoint"):
        found[kind] = [s for s in _find(kind, text) if not base.overlaps(s)]
    others = Intervals([s for k in ("account", "phrase", "endpoint") for s in found[k]])
    found["bare"] = [s for s in _find("bare", text) if not base.overlaps(s) and not others.overlaps(s)]
    secrets = Intervals([s for k in ("assign", "hex", "phrase", "bare") for s in found[k]])
    endpoints = Intervals(found["endpoint"])
    begins, ends = [0], []
    for m in _BLANK.finditer(text):
        ends.append(m.start())
        begins.append(m.end())
    ends.append(len(text))

    def beside(span: Span, side: Intervals) -> Span | None:
        scope = bisect_right(begins, span[1]) - 1
        return side.nearest(span, max(span[1] - reach, begins[scope]), min(span[2] + reach, ends[scope]))

    found["account"] = [s for s in found["account"] if beside(s, secrets)]
    for kind in ("phrase", "bare"):
        found[kind] = [s for s in found[kind] if beside(s, identifiers)]
    found["endpoint"] = [s for s in found["endpoint"] if beside(s, identifiers) and beside(s, secrets)]
    credentials = []
    for s in identifiers.spans:
        secret = beside(s, secrets)
        if secret:
            endpoint = beside(s, endpoints)
            credentials.append((s[1], secret[1], endpoint[1] if endpoint else None))
    return [s for k in KINDS for s in found[k]], credentials


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``(doc_id, spans, credentials)``; spans are ``(kind, start, end)`` in code points, end exclusive."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    parts = pa.list_(pa.struct([(x, pa.int64()) for x in ("identifier", "secret", "endpoint")]))

    def run(batches):
        for part in slices(batches):
            spans, credentials = [], []
            for t in texts(part):
                found, linked = scan(t, reach)
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
                credentials.append([dict(zip(("identifier", "secret", "endpoint"), c, strict=True)) for c in linked])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, span), pa.array(credentials, parts)], names=["doc_id", "spans", "credentials"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>, credentials array<struct<identifier:long,secret:long,endpoint:long>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts and joined spans of :func:`secrets`; the joined spans go by start, then by kind."""

    def joined(kinds):
        place = F.array(*map(F.lit, KINDS))
        keyed = F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.struct(s["start"].alias("a"), F.array_position(place, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind")))
        return F.concat_ws(",", F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))))

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(BASE), 256).alias("base_sha256"), joined(KINDS).alias("spans"), F.size("credentials").cast("long").alias("n_credentials"))
