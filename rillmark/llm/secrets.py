"""Secrets in texts: strong patterns by themselves, weak ones only beside their complement.

Strong spans are assignments, access identifiers and long hex runs. Weak candidates are identifiers
(`client_id`, `user` and the like with a value, e-mail addresses), bare values (long mixed runs that
look random) and endpoints (URLs, host settings). None of them is worth a report alone.

Linking is an interval join. A scope is a stretch of text between blank lines; two parts join when
they lie in one scope and the gap between them is at most `GAP` code points. Parts are kept in
order of their start, and the sweep drops a part from its window once it lies further back than
GAP, so the join costs about as many steps as there are parts. A bare value is reported if an
identifier joins it, an identifier or an endpoint only if a strong or a bare secret joins it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, transposed, whole_row

GAP = 200
Span = tuple[int, int, str]

# fixed values: the three base kinds, in the order in which ties are listed
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# weak candidates
_IDENT = re.compile(r"""\b(?:client_?id|account|user(?:name)?|login|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(r"""\b(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""", re.IGNORECASE | re.ASCII)
_VALUE = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}")
_SCOPE = re.compile(r"\n[\x20\t]*\n")
_ORDER = {k: i for i, k in enumerate((*BASE, "ident", "value", "endpoint"))}


def base_spans(text: str) -> list[Span]:
    """Maximal runs make the length a part of the pattern for access and hex; an assignment that is too short still uses up its text."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def looks_random(value: str) -> bool:
    """Upper case, lower case and digits, and at least 3.5 bits a character."""
    if not (re.search(r"[A-Z]", value) and re.search(r"[a-z]", value) and re.search(r"[0-9]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 3.5


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    out = [(m.start(), m.end(), "ident") for m in _IDENT.finditer(text)]
    out += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    out += [(m.start(), m.end(), "value") for m in _VALUE.finditer(text) if looks_random(m[0])]
    base = sorted(base)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))

    def inside(span: Span) -> bool:
        """Within a base span: of those that begin no later, one reaches as far."""
        i = bisect_right(starts, span[0])
        return i > 0 and reach[i - 1] >= span[1]

    return [s for s in out if not inside(s)]


def _joins(parts: list[Span], wanted: set[str], others: set[str], scope_of, gap: int) -> set[Span]:
    """Parts of a wanted kind that have a part of another kind in their scope within the gap."""
    found: set[Span] = set()
    window: list[Span] = []
    for part in sorted(parts):
        window = [p for p in window if part[0] - p[1] <= gap and scope_of(p[0]) == scope_of(part[0])]
        for p in window:
            if p[2] in wanted and part[2] in others:
                found.add(p)
            if part[2] in wanted and p[2] in others:
                found.add(part)
        # of those that are of one kind and settled, the one that reaches furthest is enough
        window = [p for p in window if p[2] != part[2] or p[1] > part[1] or (p[2] in wanted and p not in found)] + [part]
    return found


def linked_spans(text: str, base: list[Span], gap: int = GAP) -> list[Span]:
    """The weak candidates whose complementary parts occur."""
    weak = weak_parts(text, base)
    if not weak or not (base or any(k == "value" for _, _, k in weak)):
        return []
    breaks = [m.start() for m in _SCOPE.finditer(text)]

    def scope_of(at: int) -> int:
        return bisect_right(breaks, at)

    parts = base + weak
    values = _joins(parts, {"value"}, {"ident", "access"}, scope_of, gap)
    certain = [p for p in parts if p[2] != "value" or p in values]
    return sorted(values | _joins(certain, {"ident", "endpoint"}, {*BASE, "value"}, scope_of, gap))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]], s[1])))


def scan(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """doc_id, counts of the base kinds, n_linked, base_sha256, spans for each row of docs; whole texts.

    Places are code points, the end excluded. A null or an empty text has no spans: counts 0, an
    empty list and the digest of the empty string. Repeated rows stay.
    """

    def spans(texts: list[str | None]):
        rows = []
        for text in texts:
            base = base_spans(text or "")
            linked = linked_spans(text or "", base, gap)
            n = Counter(k for _, _, k in base)
            rows.append((*(n[k] for k in BASE), len(linked), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + linked)))
        return transposed(rows, 6)

    found = each_text(lambda: spans, "n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string")
    return docs.select("doc_id", found(F.col("text").cast("string")).alias("_r")).select("doc_id", "_r.*")


def redacted(text: str, gap: int = GAP) -> str:
    """The text with each secret replaced by [kind]; overlapping spans become one, named by the first.

    Identifiers and endpoints only point at a secret and stay.
    """
    base = base_spans(text)
    spans = sorted(s for s in base + linked_spans(text, base, gap) if s[2] in (*BASE, "value"))
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += (text[at:a], f"[{kind}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """docs with the secrets taken out of text, and n_chars of the new text. A null text stays null."""
    clean = each_text(lambda: lambda texts: ([t if t is None else redacted(t, gap) for t in texts],), "text string")
    done = docs.select(clean(F.col("text").cast("string")).alias("_new"), whole_row(docs).alias("_row"))
    new = {"text": F.col("_new.text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        same = F.col("_new.text").eqNullSafe(F.col("_row.text"))
        new["n_chars"] = F.when(same, F.col("_row.n_chars")).otherwise(F.length("_new.text")).cast(docs.schema["n_chars"].dataType)
    return done.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
