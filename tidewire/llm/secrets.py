"""Secret scans: fixed patterns, and runs of characters that a tokenizer can hardly shorten."""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.common import read_table

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Runs that may be random strings; a line break, space or other mark ends them.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_PART = re.compile(r"[A-Za-z0-9]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)

#: A run with fewer characters to a token than this is random.
MAX_CHARS_PER_TOKEN = 2.1
#: Fewest characters of a part of a joined run that is judged on its own.
PART_CHARS = 16
#: Longer runs (encoded files) are judged by pieces of so many characters.
PIECE_CHARS = 4096


def load_encoding(path: str):
    """A tiktoken encoding from a file of ranks, cut by the pattern that belongs to it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns; an assignment of fewer than 6 characters counts as none, but its text is passed over."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def is_known_identifier(run: str) -> bool:
    """Digests, UUIDs and numbers, which are no secrets however they are cut."""
    core = run.strip("-_=+/")
    if re.fullmatch(r"[0-9a-fA-F]+", core) and len(core) in DIGESTS:
        return True
    return bool(_UUID.fullmatch(core)) or not re.search("[A-Za-z]", core)


def is_plain(part: str) -> bool:
    """A number, or letters in the case of a word."""
    return part.isdigit() or part.isalpha() and (part.islower() or part.istitle() or part.isupper())


def random_spans(text: str, encoding, limit: float = MAX_CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """Runs of 20 or more characters that take many tokens for their length.

    Where a run is joined of words and numbers only, or passes as a whole, its
    parts are judged one by one, as a key can stand between words.
    """

    def is_random(run: str) -> bool:
        tokens = sum(len(encoding.encode_ordinary(run[i : i + PIECE_CHARS])) for i in range(0, len(run), PIECE_CHARS))
        return len(run) < limit * tokens

    found = []
    for m in _RUN.finditer(text):
        run = m[0]
        if is_known_identifier(run):
            continue
        parts = [*_PART.finditer(run)]
        joined = len(parts) > 1 and all(is_plain(p[0]) for p in parts)
        if not joined and is_random(run):
            found.append(("random", *m.span()))
        elif len(parts) > 1:
            long_ = (p for p in parts if len(p[0]) >= PART_CHARS and not is_known_identifier(p[0]))
            found += [("random", m.start() + p.start(), m.start() + p.end()) for p in long_ if is_random(p[0])]
    return found


def all_spans(text: str, encoding) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: base ones and random runs that overlap none of them; by start, then kind."""
    by_start = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=by_start)
    starts = [b[1] for b in base]
    # Ends of the spans so far: spans of different kinds may overlap, so the furthest counts.
    reach = [0, *itertools.accumulate((b[2] for b in base), max)]
    more = []
    for r in random_spans(text, encoding):
        if reach[bisect.bisect_left(starts, r[2])] <= r[1]:
            more.append(r)
    return base, sorted(base + more, key=by_start)


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_ENCODINGS: dict[str, object] = {}


def scan_secrets(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Each row's counts and spans by its whole ``text``; one pass, no shuffle.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Null and empty
    texts have none; repeated rows get a row each.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks_path not in _ENCODINGS:
            _ENCODINGS[ranks_path] = load_encoding(ranks_path)
        encoding = _ENCODINGS[ranks_path]
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, spans = all_spans(text.as_py() or "", encoding)
                kinds = [k for k, _, _ in base]
                rows.append(
                    (*map(kinds.count, KINDS[:3]), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base))
                )
            columns = [*zip(*rows)] or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    )


def op6_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document."""
    import public_tokenizers

    return scan_secrets(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
