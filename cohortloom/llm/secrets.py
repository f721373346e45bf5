"""Secret scans: strong patterns, and weak parts of credentials that co-occur.

Strong spans (kinds assign, access, hex) are found by pattern alone. Weak parts are
identifiers (short access ids, user and client names), secrets (short assigned values, long
mixed tokens) and endpoints (URLs and host names). Each part spans an interval; its scope is the
interval widened by ``reach`` code points. An interval join of the sorted parts reports

- ``weak_secret`` if an identifier or an endpoint lies in its scope,
- ``weak_id`` if a secret lies in its scope,
- ``endpoint`` if both an identifier and a secret lie in its scope.

Strong access spans count as identifiers, strong assign spans as secrets. Weak spans that
overlap a strong one are not reported again.

Host names end in one of a few usual last labels (fixed values below): other names, such as those of countries, count as prose, where a full stop without a
blank after it joins words.

Defined cases: a null text counts as empty and gives no spans; every row gives one result, also rows that repeat; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "weak_id", "weak_secret", "endpoint")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAME = re.compile(r"""(?:user(?:_?name)?|login|client_?id|access_?key_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}")
#: Both look at a run of their characters from its start only, and give nothing back, so a run is read once.
_URL = re.compile(r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\s\"'<>]++)", re.IGNORECASE | re.ASCII)
_DOTTED = re.compile(r"(?<![a-z0-9_.-])[a-z0-9-]++\.[a-z0-9.-]*+", re.IGNORECASE | re.ASCII)
_PORT = re.compile(r":[0-9]+", re.ASCII)
#: Last labels of host names.
_LAST_LABELS = ("com", "net", "org", "io", "cloud", "internal", "local")

Span = tuple[str, int, int]


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Strong spans, and the matches of their patterns that are too short."""
    strong: list[Span] = []
    short: list[Span] = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        for m in _ASSIGN.finditer(text):
            (strong if len(m[2]) >= 12 else short).append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            (strong if len(m[0]) >= 18 else short).append(("access", m.start(), m.end()))
    strong += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return strong, short


class _Intervals:
    """Sorted intervals that answer whether one meets [a, b)."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends: list[int] = []
        for _, b in spans:
            self.ends.append(max(b, self.ends[-1] if self.ends else 0))

    def meets(self, a: int, b: int) -> bool:
        """Among those that start before b, the largest end is after a."""
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, and host names outside of them.

    A host name is a part of a run of letters, digits, hyphens and points: labels without an empty one among them, up to the last that is one of _LAST_LABELS.
    """
    urls = [m.span(1) for m in _URL.finditer(text)] if "://" in text else []
    low, inside, hosts = text.lower(), _Intervals(urls), []
    if not any(f".{label}" in low for label in _LAST_LABELS):
        return urls
    for m in _DOTTED.finditer(text):
        labels = m[0].lower().split(".")
        last = next((k for k in range(len(labels) - 1, 0, -1) if labels[k] in _LAST_LABELS and labels[k - 1].strip("-")), 0)
        if not last or (last == len(labels) - 1 and text[m.end() : m.end() + 1] == "_"):
            continue
        first = last
        while first and labels[first - 1].strip("-"):
            first -= 1
        a = m.start() + sum(len(x) + 1 for x in labels[:first]) + len(labels[first]) - len(labels[first].lstrip("-"))
        b = m.start() + sum(len(x) + 1 for x in labels[: last + 1]) - 1
        if port := _PORT.match(text, b):
            b = port.end()
        if not inside.meets(a, b):
            hosts.append((a, b))
    return urls + hosts


def linked_spans(text: str, strong: list[Span], short: list[Span], reach: int) -> list[Span]:
    """Weak parts with complementary parts in scope."""
    low = text.lower()
    names = [m.span() for m in _NAME.finditer(text)] if any(k in low for k in ("user", "login", "client", "access", "account")) else []
    weak_ids = [(a, b) for kind, a, b in short if kind == "access" and b - a >= 8] + names
    ids = [(a, b) for kind, a, b in strong if kind == "access"] + weak_ids
    weak_secrets = [(a, b) for kind, a, b in short if kind == "assign"] + [m.span() for m in _TOKEN.finditer(text)]
    secrets = [(a, b) for kind, a, b in strong if kind == "assign"] + weak_secrets
    if not secrets:  # every weak span needs one
        return []
    ends = endpoints(text)
    taken, by_id, by_secret, by_end = _Intervals([(a, b) for _, a, b in strong]), _Intervals(ids), _Intervals(secrets), _Intervals(ends)
    found = [("weak_id", a, b) for a, b in weak_ids if by_secret.meets(a - reach, b + reach)]
    found += [("weak_secret", a, b) for a, b in weak_secrets if by_id.meets(a - reach, b + reach) or by_end.meets(a - reach, b + reach)]
    found += [("endpoint", a, b) for a, b in ends if by_id.meets(a - reach, b + reach) and by_secret.meets(a - reach, b + reach)]
    return [x for x in set(found) if not taken.meets(x[1], x[2])]


def find_secrets(text: str | None, reach: int = 200) -> tuple[list[Span], list[Span]]:
    """Strong spans and all spans, by start, then kind."""
    text = text or ""
    strong, short = base_spans(text)
    key = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(strong, key=key), sorted(strong + linked_spans(text, strong, short, reach), key=key)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def scan_secrets(docs: DataFrame, reach: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    rows = pick(docs, id=id_column, text=text_column)
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in batch["text"]:
                strong, every = find_secrets(text.as_py(), reach)
                for k, name in enumerate(BASE_KINDS):
                    n[k].append(sum(s[0] == name for s in strong))
                digests.append(sha256(joined(strong).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(x, pa.int64()) for x in n), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    out = rows.mapInArrow(scan, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_column)
