"""Secret scan with multipart credential linking.

Base findings are patterns that are telling by themselves (assign, access, hex). The method adds what is telling only
together: weak access identifiers, weak secrets and endpoints are joined as intervals within a scope (a paragraph, parts
at most REACH code points apart) and reported only when complementary parts co-occur:

* a weak identifier or a weak secret, if an identifier and a secret (weak or base) are within reach of each other;
* an endpoint, if such a linked pair is within its reach.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_batches

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
REACH = 200

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
# Weak parts: an identifier under a telling name or a short access key; a secret that is short, or a bare mixed token
# of 40 characters, or under a shorter name; an endpoint with a scheme, or under a telling name.
_ID_NAMED = re.compile(r"""(?ai)\b(?:access_?key_?id|client_?id|key_?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""")
_SECRET_NAMED = re.compile(r"""(?ai)\b(?:pwd|pass(?:phrase)?|private_?key|access_?key|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""")
_SECRET_BARE = re.compile(r"(?a)(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
_ENDPOINT = re.compile(r"""(?ai)\b(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>|]+|(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,})""")
_ID_WORDS = ("client", "key", "user", "login", "account")
_SECRET_WORDS = ("pwd", "pass", "private", "access", "auth")
_PARAGRAPH = re.compile(r"\n[\t \r]*\n")


def base_spans(text: str, low: str | None = None) -> tuple[list, list]:
    """((start, kind number, end) of the base findings; assign and access matches that were too short)."""
    low = text.lower() if low is None else low
    found, failed = [], []
    if any(x in low for x in _NAMED):
        for m in _ASSIGN.finditer(text):
            (found if m.end(2) - m.start(2) >= 6 else failed).append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            (found if m.end() - m.start() >= 20 else failed).append((m.start(), 1, m.end()))
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found, failed


def _within(parts: list, spans: list, scope) -> list[bool]:
    """For each of parts, whether another one of spans in the same scope is at most REACH away: an interval join.

    Of each scope's spans in order of their starts, the furthest end so far and the furthest of another span are kept, so
    a part is answered by one binary search, however dense or long the spans are.
    """
    spans = sorted(set(spans))
    starts, scopes = [s for s, _ in spans], [scope(s) for s, _ in spans]
    upto, best, second = [], None, -1
    for i, (s, e) in enumerate(spans):
        if not i or scopes[i] != scopes[i - 1]:
            best, second = None, -1
        if best is None or e > best[1]:
            best, second = (s, e), best[1] if best else -1
        else:
            second = max(second, e)
        upto.append((best, second))
    out = []
    for s, e in parts:
        own = scope(s)
        i = min(bisect_right(starts, e + REACH), bisect_right(scopes, own)) - 1
        if i < 0 or scopes[i] != own:
            out.append(False)
            continue
        far, other = upto[i]
        out.append((other if far == (s, e) else far[1]) >= s - REACH)
    return out


def scan(text: str | None) -> tuple[list, list]:
    """(base findings, all findings), each (start, kind number, end) in order. Null and empty texts have none."""
    if not text:
        return [], []
    low = text.lower()
    base, failed = base_spans(text, low)
    base.sort()
    ids = [(s, e) for s, k, e in failed if k == 1]
    if ":" in low or "=" in low:
        if any(x in low for x in _ID_WORDS):
            ids += [m.span() for m in _ID_NAMED.finditer(text)]
    secrets = [(s, e) for s, k, e in failed if k == 0]
    strong_ids = [(s, e) for s, k, e in base if k == 1]
    strong_secrets = [(s, e) for s, k, e in base if k != 1]
    if not (ids or strong_ids):
        return base, base
    if any(x in low for x in _SECRET_WORDS):
        secrets += [m.span() for m in _SECRET_NAMED.finditer(text)]
    if any(c.isdigit() for c in low):
        secrets += [m.span() for m in _SECRET_BARE.finditer(text)]
    if not (secrets or strong_secrets):
        return base, base
    breaks = [m.start() for m in _PARAGRAPH.finditer(text)]

    def scope(at: int) -> int:
        return bisect_right(breaks, at)

    all_ids, all_secrets = strong_ids + ids, strong_secrets + secrets
    linked_ids = [x for x, ok in zip(all_ids, _within(all_ids, all_secrets, scope), strict=True) if ok]
    linked_secrets = [x for x, ok in zip(all_secrets, _within(all_secrets, all_ids, scope), strict=True) if ok]
    out, known_ids, known_secrets = set(base), set(strong_ids), set(strong_secrets)
    out |= {(s, 3, e) for s, e in linked_ids if (s, e) not in known_ids}
    out |= {(s, 4, e) for s, e in linked_secrets if (s, e) not in known_secrets}
    if linked_ids and ("://" in low or "host" in low or "endpoint" in low or "server" in low):
        ends = [m.span() for m in _ENDPOINT.finditer(text)]
        near_id, near_secret = _within(ends, linked_ids, scope), _within(ends, linked_secrets, scope)
        out |= {(s, 5, e) for (s, e), a, b in zip(ends, near_id, near_secret, strict=True) if a and b}
    return base, sorted(out)


def shown(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None, spans: list) -> str | None:
    """text with every finding replaced by its kind in brackets; overlapping findings become one, named after the first."""
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_spans, spans (strings, kind:start:end in code points) and redacted.

    A null text counts as empty: no findings, and its redacted text stays null. Repeated rows are scanned alike. Other
    columns pass through, except such with an output's name, which are replaced.
    """
    bounded_batches(docs.sparkSession)
    made = [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_spans", "string"), ("spans", "string"), ("redacted", "string")]
    keep = [c for c in docs.columns if c not in dict(made)]
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep] + [T.StructField(n, T.LongType() if t == "long" else T.StringType()) for n, t in made])
    at = keep.index(text)

    def run(batches):
        for b in batches:
            cols = [[] for _ in made]
            for t in b.column(at).to_pylist():
                base, spans = scan(t)
                n = [0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                for c, v in zip(cols, (*n, shown(base), shown(spans), redact(t, spans)), strict=True):
                    c.append(v)
            yield pa.record_batch([*b.columns, *[pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(cols, made, strict=True)]], [*b.schema.names, *dict(made)])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def op6_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_secrets(docs)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


__all__ = ["find_secrets", "op6_credential_links", "redact", "scan"]
