"""Secret scan: base patterns and a token-efficiency test.

A vocabulary learnt on ordinary text spends few characters per token on random strings. A
run of key characters is flagged when its characters per token fall below a limit, unless
it is a known digest or an identifier whose words are cheap in tokens. Letters of one case
are judged by what their tokens cost, rare tokens more than common ones. Flags are added to the
spans of the base patterns, never put in their place.

Bytes of a whole batch are searched at once for what a pattern cannot do without (a
keyword, a prefix, a long run of its characters); only texts that hold it are matched.

Defined results: a null text is empty and has no span; spans are in code points, end
exclusive; a run that overlaps a base span is not flagged again; rows that repeat are
scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import utf8_view

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = (b"passw", b"secret", b"token", b"api")

RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Hex digits of md5, sha1, sha224, sha256, sha384 and sha512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: Words joined by marks, or in camel case with at most a number at the end: a name, not a key, if its words are cheap in tokens.
NAME = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[_/-](?:[A-Za-z]+|[0-9]+))*=?|[a-z]*(?:[A-Z][a-z]+)*[0-9]*")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Letters of one case but for capitals at the start of words: no camel case.
ONE_CASE = re.compile(r"[^A-Za-z]*(?:[A-Z]?[a-z]+[^A-Za-z]+)*(?:[A-Z]?[a-z]+)?|[^a-z]+")
#: Letters of one case are words or keys, and long or foreign words cost many tokens too, so their tokens are weighed: a vocabulary
#: lists its tokens by how often they come, about as one over the place. Per letter, what the letters would cost at random less
#: what the tokens cost, in natural logarithms; at or under these limits a run of small letters, or of capitals, is a key.
SMALL_LIMIT, CAPITAL_LIMIT = -1.60, -2.355
TIME = re.compile(r"[0-9]{8}T[0-9]{6}Z?")


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _rows_with_runs(data: np.ndarray, offsets: np.ndarray, allowed: bytes, least: int) -> np.ndarray:
    """Rows that hold `least` bytes in a row of those allowed. A run over a row's end counts for both; matching decides."""
    table = np.zeros(256, bool)
    table[np.frombuffer(allowed, np.uint8)] = True
    found, step = [], 1 << 24
    for a in range(0, len(data), step):
        part = table[data[a : a + step + least]]
        edge = np.flatnonzero(np.diff(part.view(np.int8), prepend=0, append=0))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= least
        for s, e in zip(starts[long] + a, ends[long] + a):
            first, last = np.searchsorted(offsets, [s, e - 1], "right") - 1
            found.append(np.arange(first, last + 1))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _rows_with(blob: bytes, offsets: np.ndarray, words) -> set[int]:
    rows: set[int] = set()
    for w in words:
        at = blob.find(w)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right") - 1)
            rows.add(row)
            at = blob.find(w, max(at + 1, int(offsets[row + 1]) - len(w) + 1))
    return rows


def _letters_per_token(run: str, encoding) -> float:
    """Of the words of a run alone, in camel case or between marks."""
    words = PART.findall(run)
    return sum(map(len, words)) / max(1, sum(len(encoding.encode_ordinary(w)) for w in words))


def token_gain(run: str, encoding) -> float:
    """Of the words of a run: cost of random letters less cost of the tokens by their places, for each letter."""
    words = PART.findall(run)
    letters = sum(map(len, words))
    all_places = math.log(math.log(encoding.n_vocab) + 0.5772)  # so that the shares of all places sum to one
    cost = sum(math.log(t + 1) + all_places for w in words for t in encoding.encode_ordinary(w))
    return math.log(26) - cost / max(1, letters)


def looks_random(run: str, encoding, limit: float) -> bool:
    """Whether a run of key characters takes more tokens than words would."""
    digits = sum(c.isdigit() for c in run)
    letters = any(c.isalpha() for c in run)
    if not letters or UUID.fullmatch(run) or TIME.fullmatch(run):
        return False
    if len(run) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return False
    if digits < 2 and ONE_CASE.fullmatch(run):
        return token_gain(run, encoding) <= (SMALL_LIMIT if any(c.islower() for c in run) else CAPITAL_LIMIT)
    if NAME.fullmatch(run) and _letters_per_token(run, encoding) >= limit:
        return False
    return len(run) / len(encoding.encode_ordinary(run)) < limit


def scan_text(text: str, encoding, least: int, limit: float, has=(True, True, True, True)) -> list[tuple[int, int, int]]:
    """Spans (start, kind's place in KINDS, end), sorted."""
    spans = []
    if has[0]:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if has[1]:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if has[2]:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    if has[3]:
        base = list(spans)
        for m in RUN.finditer(text):
            if len(m[0]) >= least and not any(s < m.end() and m.start() < e for s, _, e in base) and looks_random(m[0], encoding, limit):
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scanner(path: str, least: int, limit: float):
    letters = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

    def run(batches):
        encoding = _encoding(path)
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            data, offsets = utf8_view(batch.column(1))
            blob = data.tobytes()
            rows = [_rows_with(blob.lower(), offsets, KEYWORDS), _rows_with(blob, offsets, [b"AKIA"]), set(_rows_with_runs(data, offsets, b"0123456789abcdef", 32).tolist()), set(_rows_with_runs(data, offsets, letters, least).tolist())]
            n = batch.num_rows
            counts, sha, text = [[0] * n for _ in range(3)], [nothing] * n, [""] * n
            for i in set().union(*rows):
                spans = scan_text(blob[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"), encoding, least, limit, [i in r for r in rows])
                base = [x for x in spans if x[1] < 3]
                for k in range(3):
                    counts[k][i] = sum(x[1] == k for x in base)
                sha[i], text[i] = hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(text, pa.string())], names=names)

    return run


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, least: int = 16, limit: float = 2.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, then kind)."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scanner(vocabulary, least, limit), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
