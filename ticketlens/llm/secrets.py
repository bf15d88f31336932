"""Secret scan: one Aho-Corasick pass finds keywords, anchored patterns run only where one begins, checksums decide.

Kinds. Base: ``assign`` (a keyword, a separator, a value of 6 or more), ``access`` (``AKIA`` and 16 or more), ``hex`` (24 or more
hexadecimal digits; it has no keyword, a run of its class is its prefilter). Further ones need an inner proof: ``github`` and ``npm``
tokens carry a CRC-32 of their body in base 62, ``jwt`` a header that decodes to JSON with an ``alg``, ``pem`` a closing line.

Positions are code points, ends exclusive. Matches of a kind are leftmost and do not overlap; what fails its length or checksum is dropped.
Defined results: null text is empty and has no span; repeated rows give repeated results; whole texts are read, however long.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketlens.llm.common import arrow_map, ascii_lower, texts_of

# ---- fixed values: kinds in their order, keywords and patterns
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----"),
}
HEX_RE = re.compile(r"[0-9a-f]{24,}")
RUNS = {"jwt": re.compile(r"eyJ[A-Za-z0-9_-]*")}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = "spans array<struct<kind: string, begin: long, stop: long>>"


def keyword_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    return automaton


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` as six digits of base 62."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def _is_json_header(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):  # no JSON, or nested too deep for a header
        return False
    return isinstance(header, dict) and "alg" in header


def valid(kind: str, match: re.Match) -> bool:
    found = match.group()
    if kind == "assign":
        return len(match.group(2)) >= 6
    if kind == "access":
        return len(found) >= 20
    if kind in ("github", "npm"):
        return base62_crc(found[4:-6]) == found[-6:]
    return _is_json_header(found) if kind == "jwt" else True


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed.

    A pattern of ``RUNS`` begins with a run of one class and fails for what follows that run, so where it fails at a hit it fails at all
    hits in the rest of the run; they are passed over, and the time stays in proportion to the text.
    """
    hits: dict[str, list[int]] = {}
    for last, (length, kind) in automaton.iter(ascii_lower(text)):
        hits.setdefault(kind, []).append(last - length + 1)
    spans = [("hex", m.start(), m.end()) for m in HEX_RE.finditer(text)]
    for kind, starts in hits.items():
        free, pattern = 0, PATTERNS[kind]
        for start in sorted(starts):
            if start < free:
                continue
            if match := pattern.match(text, start):
                free = match.end()
                if valid(kind, match):
                    spans.append((kind, start, match.end()))
            elif kind in RUNS and (run := RUNS[kind].match(text, start)):
                free = run.end()
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of ``docs`` and ``spans``: array of (kind, begin, stop); a column of that name is replaced."""
    docs = docs.drop("spans")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("stop", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = keyword_automaton()
        spans = [[{"kind": k, "begin": a, "stop": b} for k, a, b in find_spans(t, automaton)] for t in texts_of(batch, text)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{fields}, {SCHEMA}")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, checksum of the base spans, all spans as text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = keyword_automaton()
        every = [find_spans(t, automaton) for t in texts_of(batch)]
        base = [[s for s in spans if s[0] in KINDS[:3]] for spans in every]
        counts = [[sum(s[0] == kind for s in spans) for spans in base] for kind in KINDS[:3]]
        sums = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(sums), pa.array([joined(s) for s in every])],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return arrow_map(docs.select("doc_id", "text"), run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``<kind>``; overlapping spans are taken out as one, under the first kind. ``n_chars``, where
    the table has it, is the length of the new text. No document goes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, texts, lengths = keyword_automaton(), [], []
        old_lengths = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * batch.num_rows
        for text, n in zip(batch.column("text").to_pylist(), old_lengths):
            spans = find_spans(text, automaton) if text else []
            if spans:
                pieces, at = [], 0
                for kind, begin, stop in spans:
                    if begin >= at:
                        pieces += [text[at:begin], f"<{kind}>"]
                    at = max(at, stop)
                text = "".join([*pieces, text[at:]])
                n = len(text)
            texts.append(text)
            lengths.append(n)
        new = {"text": pa.array(texts, pa.string())}
        if "n_chars" in batch.schema.names:
            new["n_chars"] = pa.array(lengths, batch.schema.field("n_chars").type)
        names = batch.schema.names
        return pa.RecordBatch.from_arrays([new.get(name, batch.column(i)) for i, name in enumerate(names)], names)

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
