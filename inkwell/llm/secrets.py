"""Secret scans: Boolean trigram queries derived from each rule, a trigram index for each block of texts, verification."""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser

#: (kind, pattern, group whose length counts, least length), on UTF-8 bytes. The first three are the base kinds.
#: A run of 16 hex digits or more is what is left of all runs when shorter ones are dropped. No pattern reads a run of
#: characters again from within: what precedes a run is none of its characters, so time grows with the text's length.
RULES = (
    ("assign", rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", rb"AKIA[A-Z0-9]+", 0, 18),
    ("hex", rb"[0-9a-f]{16,}", 0, 16),
    ("github", rb"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", rb"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", rb"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("jwt", rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("private_key", rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", 0, 27),
    ("url_login", rb"://[^\s/:@]+:[^\s/@]+@", 0, 7),
    ("bearer", rb"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{20,}", 0, 27),
)
BASE = 3
#: Literal alternatives followed at once when a query is derived, and members of a class taken as alternatives.
EXACT_LIMIT, CLASS_LIMIT = 128, 8
#: Bytes of text in one block of the index.
BLOCK_BYTES = 4 << 20


def _all(*queries):
    """AND of queries; True is the query that every text meets."""
    parts = {q for q in queries if q is not True}
    return True if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def _any(*queries):
    """OR of queries."""
    parts = set(queries)
    return True if True in parts or not parts else parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def _grams(strings):
    """Query that one of the strings occurs: all its trigrams do. A shorter string asks nothing."""
    return _any(*(_all(*(s[i:i + 3] for i in range(len(s) - 2))) for s in strings))


def _class(items):
    """Members of a small positive class, folded to lower case, or None."""
    out = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(arg)
        elif op is sre.RANGE and arg[1] - arg[0] < CLASS_LIMIT:
            out |= set(range(arg[0], arg[1] + 1))
        else:
            return None
    return {bytes([c]).lower() for c in out if c < 256} if len(out) <= CLASS_LIMIT else None


def _node(op, arg):
    """(all strings that the node can match, or None if they are many; query that holds wherever it matches)."""
    if op is sre.LITERAL:
        return {bytes([arg]).lower()}, True
    if op is sre.IN:
        return _class(arg), True
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(p[0] is not None for p in parts):
            joined = set().union(*(p[0] for p in parts))
            if len(joined) <= EXACT_LIMIT:
                return joined, True
        return None, _any(*(_all(q, _grams(s)) if s is not None else q for s, q in parts))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and high <= 1:
            return strings | {b""} if low == 0 else strings, True
        return None, True if low == 0 else query if strings is None else _grams(strings)
    if op is sre.AT:
        return {b""}, True
    return None, True


def _sequence(nodes):
    done, run, exact = True, {b""}, True
    for op, arg in nodes:
        strings, query = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= EXACT_LIMIT:
            run = {a + b for a, b in product(run, strings)}
            continue
        exact = False
        done = _all(done, _grams(run), query)
        run = strings if strings is not None else {b""}
    return (run, done) if exact else (None, _all(done, _grams(run)))


def trigram_query(pattern: bytes):
    """Boolean query over lower-cased trigrams that every text with a match meets; True if there is none.

    Nested ("and" | "or", {queries}) with bytes as leaves.
    """
    strings, query = _sequence(parser.parse(pattern))
    return query if strings is None else _grams(strings)


def leaves(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(leaves, query[1]))


class Rules:
    """Compiled rules with their queries and the trigrams that these ask for."""

    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(p), group, least, trigram_query(p)) for kind, p, group, least in rules]
        self.grams = sorted(set().union(*(leaves(r[4]) for r in self.rules)))
        self.pairs = np.zeros(1 << 16, bool)
        self.pairs[[g[0] << 8 | g[1] for g in self.grams]] = True
        self.codes = np.array([int.from_bytes(g, "big") for g in self.grams], np.int64)

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Trigram -> which texts hold it, as a bitmap, for the trigrams that the rules ask for."""
        out = {g: np.zeros(len(texts), bool) for g in self.grams}
        flat = np.frombuffer(b"\n\n".join(texts).lower(), np.uint8)
        if len(flat) > 2 and len(self.grams):
            first = np.flatnonzero(self.pairs[flat[:-2].astype(np.uint16) << np.uint16(8) | flat[1:-1]])
            code = flat[first].astype(np.int64) << 16 | flat[first + 1].astype(np.int64) << 8 | flat[first + 2]
            which = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[which] == code
            ends = np.cumsum([len(t) + 2 for t in texts])
            held = np.searchsorted(ends, first[hit], side="right")
            for g, text in set(zip(which[hit].tolist(), held.tolist())):
                out[self.grams[g]][text] = True
        return out

    def candidates(self, query, postings, n: int) -> np.ndarray:
        if query is True:
            return np.ones(n, bool)
        if isinstance(query, bytes):
            return postings[query]
        parts = [self.candidates(q, postings, n) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end) in code points, by start and then rule."""
        postings, found = self.postings(texts), [[] for _ in texts]
        for k, (_, regex, group, least, query) in enumerate(self.rules):
            for i in np.flatnonzero(self.candidates(query, postings, len(texts))).tolist():
                for m in regex.finditer(texts[i]):
                    if m.end(group) - m.start(group) >= least:
                        found[i].append((m.start(), k, m.end()))
        return [_points(t, sorted(f)) if f else f for t, f in zip(texts, found)]


def _points(text: bytes, spans):
    """Byte offsets to code points. A byte that doesn't begin a character isn't one."""
    if text.isascii():
        return spans
    begins = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    at = lambda i: int(begins[i - 1]) if i else 0
    return [(at(a), k, at(b)) for a, k, b in spans]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(doc_id, spans) for every row: spans of (kind, start, end), code points, end exclusive, by start and rule order.

    The rules' matches are leftmost and non-overlapping for each rule; those too short are dropped. Texts are taken in
    blocks; each block has its own trigram index, a rule's query intersects its postings, and only candidates are
    searched. A rule without mandatory trigrams searches every text. Null is the empty text; a very long text is a block
    of its own and is searched whole. Repeated rows give equal results, an empty table an empty one; other columns are ignored. No shuffle.
    """

    def run(batches):
        made = Rules(rules)
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            sizes = np.cumsum([len(t) for t in texts])
            cuts = np.flatnonzero(np.diff(sizes // BLOCK_BYTES)) + 1
            spans = [s for part in np.split(np.arange(len(texts)), cuts) if len(part) for s in made.scan(texts[part[0]:part[-1] + 1])]
            rows = [[{"kind": rules[k][0], "start": a, "end": z} for a, k, z in s] for s in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_col, "UTF-8").alias("t"))
    return src.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans, and all spans as text."""
    told = lambda xs: F.concat_ws(",", F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r[0] for r in RULES[:BASE]]
    return found.select(
        "doc_id", *[count(k) for k in base],
        F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact(text: str | None, spans, mark: str = "[secret]") -> str | None:
    """A text with its spans replaced; overlapping spans become one mark."""
    if text is None:
        return None
    out, at = [], 0
    for a, z in sorted((s["start"], s["end"]) for s in spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join(out) + text[at:]


