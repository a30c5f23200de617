"""Secret scans through a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that every match must hold.
Documents are indexed in segments (a slice of an Arrow batch): the case-folded bytes of all
texts of a segment are looked up trigram by trigram, which gives a posting list for each
trigram that some query names. A rule's query intersects and unites postings, and only the
documents left are verified with the regex. Rules without a mandatory trigram scan all
documents. Segments are independent, so there is no shuffle and nothing grows with the corpus.

Defined cases: null is the empty text; spans are code points with exclusive end, leftmost
and non-overlapping within a kind; spans of different kinds may overlap, and spans of equal start
stand in the order of the rules; a private key reaches over its base64 lines to its end line, or
as far as they go; a text of any length is scanned whole, in a segment of its own if it is longer
than one; rows that repeat an id are scanned each; an empty table gives no rows; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from parallax.llm.common import map_arrow

#: Sets of strings larger than this are cut to prefixes and suffixes; segments have so many bytes or rows at most.
MAX_SET, SEGMENT_BYTES, SEGMENT_ROWS = 24, 4 << 20, 1024

ALL = ("all",)


def conj(*queries: tuple) -> tuple:
    parts = {p for q in queries if q != ALL for p in (q[1] if q[0] == "and" else (q,))}
    return ALL if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def disj(*queries: tuple) -> tuple:
    if ALL in queries:
        return ALL
    parts = {p for q in queries for p in (q[1] if q[0] == "or" else (q,))}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def grams(strings: frozenset[bytes]) -> tuple:
    """What a text must hold if it holds one of the strings."""
    return disj(*(conj(*(("gram", s[i : i + 3]) for i in range(len(s) - 2))) for s in strings))


@dataclass(frozen=True)
class Part:
    """What is known of a sub-pattern: all its strings, or how they begin and end, and a query."""

    exact: frozenset[bytes] | None
    starts: frozenset[bytes]
    ends: frozenset[bytes]
    query: tuple = ALL

    @staticmethod
    def of(strings: frozenset[bytes]) -> Part:
        return Part(strings, strings, strings)

    def known(self) -> tuple:
        return grams(self.exact) if self.exact is not None else self.query


ANY = Part(None, frozenset([b""]), frozenset([b""]))


def _bounded(part: Part) -> Part:
    if part.exact is not None and len(part.exact) <= MAX_SET:
        return part
    cut = lambda some, keep: frozenset([b""]) if len(out := frozenset(map(keep, some))) > MAX_SET else out
    return Part(None, cut(part.starts, lambda s: s[:3]), cut(part.ends, lambda s: s[-3:]), conj(part.known(), grams(part.starts), grams(part.ends)))


def _then(x: Part, y: Part) -> Part:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MAX_SET:
        return _bounded(Part.of(frozenset(a + b for a in x.exact for b in y.exact)))
    across = grams(frozenset(a + b for a in x.ends for b in y.starts)) if len(x.ends) * len(y.starts) <= MAX_SET**2 else ALL
    starts = frozenset(a + b for a in x.exact for b in y.starts) if x.exact is not None else x.starts
    ends = frozenset(a + b for a in x.ends for b in y.exact) if y.exact is not None else y.ends
    return _bounded(Part(None, starts, ends, conj(x.known(), y.known(), across)))


def _either(x: Part, y: Part) -> Part:
    exact = x.exact | y.exact if x.exact is not None and y.exact is not None else None
    return _bounded(Part(exact, x.starts | y.starts, x.ends | y.ends, disj(x.known(), y.known())))


def _chars(codes: set[int] | None) -> Part:
    folded = frozenset(chr(c).lower().encode() for c in codes) if codes is not None and all(c < 128 for c in codes) else None
    return Part.of(folded) if folded and len(folded) <= MAX_SET else ANY


def _class(items: list) -> set[int] | None:
    found: set[int] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(value)
        elif op is C.RANGE:
            found |= set(range(value[0], value[1] + 1))
        else:
            return None
    return found


def _analyse(tree: list) -> Part:
    out = Part.of(frozenset([b""]))
    for op, value in tree:
        if op is C.LITERAL:
            part = _chars({value})
        elif op is C.IN:
            part = _chars(_class(value))
        elif op is C.BRANCH:
            branches = [_analyse(x) for x in value[1]]
            part = branches[0]
            for other in branches[1:]:
                part = _either(part, other)
        elif op is C.SUBPATTERN:
            part = _analyse(value[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value[0], value[1], _analyse(value[2])
            if (low, high) == (0, 1):
                part = _either(inner, Part.of(frozenset([b""])))
            elif low == 0:
                part = ANY
            else:
                part = inner
                for _ in range(min(low, 4) - 1):
                    part = _then(part, inner)
                if high != low or low > 4:
                    part = _then(_then(part, ANY), inner)
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            part = ANY
        out = _then(out, part)
    return out


def trigram_query(pattern: str) -> tuple:
    """A Boolean query over folded trigrams that holds for every text with a match: ALL, ("gram", b"abc"), ("and", parts) or ("or", parts)."""
    part = _analyse(list(parser.parse(pattern)))
    return conj(part.known(), grams(part.starts), grams(part.ends)) if part.exact is None else part.known()


def grams_of(query: tuple) -> set[bytes]:
    return set() if query == ALL else {query[1]} if query[0] == "gram" else set().union(*map(grams_of, query[1]))


def evaluate(query: tuple, postings: dict[bytes, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Sorted ordinals of the documents that the query lets through."""
    if query == ALL:
        return everything
    if query[0] == "gram":
        return postings.get(query[1], everything[:0])
    parts = sorted((evaluate(q, postings, everything) for q in query[1]), key=len)
    out = parts[0]
    for other in parts[1:]:
        out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
    return out


class TrigramIndex:
    """Posting lists of the trigrams that some query names."""

    def __init__(self, wanted: set[bytes]):
        letters = sorted({c for g in wanted for c in g})
        if len(letters) > 63:
            raise ValueError("the rules' trigrams use more than 63 different bytes")
        self.grams = sorted(wanted)
        code = {c: i + 1 for i, c in enumerate(letters)}
        self._fold = np.zeros(256, np.uint32)
        for c, i in code.items():
            self._fold[c] = i
            if 97 <= c <= 122:
                self._fold[c - 32] = i
        self._gram = np.full(1 << 18, -1, np.int16)
        for n, g in enumerate(self.grams):
            self._gram[code[g[0]] << 12 | code[g[1]] << 6 | code[g[2]]] = n

    def postings(self, data: np.ndarray, ends: np.ndarray) -> dict[bytes, np.ndarray]:
        """data: the bytes of all texts on end; ends: where each text ends."""
        if len(data) < 3 or not self.grams:
            return {}
        codes = self._fold[data]
        found = self._gram[codes[:-2] << 12 | codes[1:-1] << 6 | codes[2:]]
        at = np.flatnonzero(found >= 0)
        doc = np.searchsorted(ends, at, side="right")
        inside = at + 3 <= ends[doc]
        pairs = np.unique(found[at[inside]].astype(np.int64) * len(ends) + doc[inside])
        gram, doc = pairs // len(ends), pairs % len(ends)
        cuts = np.searchsorted(gram, np.arange(len(self.grams) + 1))
        return {g: doc[cuts[n] : cuts[n + 1]] for n, g in enumerate(self.grams)}


@dataclass(frozen=True)
class Rule:
    """kind, regex, the group that holds the secret itself, and the least length of that group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: Patterns of the base kinds, then those that this method adds. Fixed values.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:\s{1,4}(?:Proc-Type|DEK-Info):[^\r\n]{0,100})*(?:(?:\s|\\[nr]){1,4}[A-Za-z0-9+/=]{16,})*(?:(?:(?:\s|\\[nr]){1,4}[A-Za-z0-9+/=]{1,15})?(?:\s|\\[nr]){1,4}-----END [A-Z ]{0,32}PRIVATE KEY-----)?"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

Span = tuple[int, int, str, int, int]


class Scanner:
    """Rules with their queries; one index serves all of them."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = TrigramIndex(set().union(*map(grams_of, self.queries)))
        self._find = [self._finder(r) for r in rules]

    @staticmethod
    def _finder(rule: Rule) -> Callable[[str], list[Span]]:
        pattern = rule.pattern
        if rule.least and rule.group == 0 and (run := re.fullmatch(r"(\w*)(\[[^]]+\])\+", pattern)):
            # a run that is too short fails at every later start in it too, so the least length can be part of the pattern
            pattern = f"{run[1]}{run[2]}{{{rule.least - len(run[1])},}}"
        compiled = re.compile(pattern)
        return lambda text: [(*m.span(), rule.kind, *m.span(rule.group)) for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]

    def segment(self, texts: pa.Array) -> list[list[Span]]:
        """The spans of each text, by start and then rule: start, end, kind, start and end of the secret."""
        if not len(texts):
            return []
        texts = texts.fill_null("") if texts.null_count else texts
        ends = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        postings = self.index.postings(raw, (ends[1:] - ends[0]).astype(np.int64))
        everything = np.arange(len(texts))
        values: dict[int, str] = {}
        found: list[list[Span]] = [[] for _ in everything]
        for query, find in zip(self.queries, self._find, strict=True):
            for i in evaluate(query, postings, everything).tolist():
                if (text := values.get(i)) is None:
                    text = values[i] = texts[i].as_py()
                found[i] += find(text)
        for spans in found:
            if len(spans) > 1:
                spans.sort(key=lambda s: s[0])  # stable: kinds stay as listed
        return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _, _ in spans)


def redacted(text: str | None, spans: list[Span], mark: str = "[SECRET]") -> str | None:
    """The text with each secret replaced; overlapping secrets share one mark."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for start, end in sorted((s[3], s[4]) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _segments(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(column).cast(pa.large_string())).fill_null(0)))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = min(max(start + 1, int(np.searchsorted(sizes, before + SEGMENT_BYTES, side="right"))), start + SEGMENT_ROWS, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): all spans of each text, by start and then kind as listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for rows in _segments(batch, 1):
                found = [[{"kind": s[2], "start": s[0], "end": s[1]} for s in spans] for spans in own.segment(rows.column(1))]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of scan()'s rows; columns for each base kind."""
    base = [r.kind for r in rules if r.base]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with all its columns; secrets in `text` are replaced by a mark, a numeric n_chars follows if there is one."""
    schema, names = docs.schema, docs.columns
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names and isinstance(schema["n_chars"].dataType, IntegralType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(rules)
        for batch in batches:
            for rows in _segments(batch, at):
                found = own.segment(rows.column(at))
                columns = list(rows.columns)
                if any(found):
                    texts = [redacted(t, s) for t, s in zip(columns[at].to_pylist(), found, strict=True)]
                    columns[at] = pa.array(texts, rows.schema.field(at).type)
                    if counted is not None:
                        sizes = [len(t) if s and t is not None else n for t, s, n in zip(texts, found, columns[counted].to_pylist(), strict=True)]
                        columns[counted] = pa.array(sizes, rows.schema.field(counted).type)
                yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return map_arrow(docs, run, schema)


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> str:
    """The joined spans of one text without any index."""
    spans = []
    for n, r in enumerate(rules):
        spans += [(m.start(), n, m.end(), r.kind) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
