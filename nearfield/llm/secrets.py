"""Secrets in text: fixed patterns, and strings that a tokenizer finds improbable.

Base kinds: assign (password=...), access (AKIA...), hex (24 digits or more).
The token-efficiency test adds kind `token`: a run of MIN_RUN or more key-like
characters, of whatever classes, is random if a tiktoken vocabulary needs many
tokens for it (under MAX_RATIO characters a token). Excluded are known digests
(all hex of a usual length, with or without a prefix such as sha256-), UUIDs,
numbers, identifiers and paths (every part between separators is a number or
one that the vocabulary knows well), and runs inside a base span.

A null or empty text has no spans. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "token")
MAX_RATIO = 2.2
MIN_RUN = 20

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_DIGEST = re.compile(r"(?i:(?:md5|sha1|sha224|sha256|sha384|sha512)[-_:=]?)?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_SEPARATOR = re.compile(r"[/_=+-]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")


class RandomTest:
    def __init__(self, vocabulary: str, pattern: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, run: str) -> float:
        return len(run) / len(self.encoding.encode_ordinary(run))

    def _named(self, run: str) -> bool:
        parts = [p for p in _SEPARATOR.split(run) if p]
        return len(parts) > 1 and all(p.isdigit() or self.ratio(p) >= min(MAX_RATIO, len(p)) for p in parts)

    def __call__(self, run: str) -> bool:
        if _DIGEST.fullmatch(run) or _UUID.fullmatch(run) or not any(c.isalpha() for c in run):
            return False
        return self.ratio(run) < MAX_RATIO and not self._named(run)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and not overlapping within a kind, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def token_spans(text: str, base: list[tuple[int, int, int]], is_random) -> list[tuple[int, int, int]]:
    return [(m.start(), 3, m.end()) for m in _RUN.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in base) and is_random(m[0])]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_random = RandomTest(vocabulary, pattern)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                base = base_spans(text)
                every = sorted(base + token_spans(text, base, is_random))
                n = [sum(k == j for _, k, _ in every) for j in range(4)]
                out.append((doc, *n[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), n[3]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, _TYPES)], names=_NAMES)

    return run


_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def secret_spans(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Counts and spans of every row; `pattern` is the vocabulary's splitting rule."""
    return docs.select("doc_id", "text").mapInArrow(_scan(vocabulary, pattern), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long")
