"""Token ids of texts with a `tokenizers` vocabulary, by caches of chunks and words bounded in bytes.

The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are
those of its white-space-delimited chunks in order. Most chunks of a corpus repeat. A new
chunk of plain Latin characters is lower-cased and split like the pre-tokenizer does, and
its words, which repeat more often than chunks, go to the vocabulary's model alone; any other
chunk goes through the tokenizer whole. So do texts with the separators 0x1C to 0x1F, which
Python splits at and the vocabulary does not. A vocabulary of another make than
`LOWER_CASE_WORDS` is used through its tokenizer only.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np

#: Bytes that a worker's cache of chunks, and that of words, may take. Then the newer half goes: what repeats most comes first.
CACHE = 96 << 20
#: What an entry takes beside its characters and ids, and the longest key that is kept.
ENTRY, KEPT = 220, 64
#: Characters of text between looks at the caches' sizes; longer texts are taken in parts of about as many.
PART = 1 << 20
SPACE = re.compile(r"\s")
ODD_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Chunks whose lower case and Unicode form need no tables: ASCII and Latin letters with marks.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# The pre-tokenizer's pattern of that vocabulary, and the same for plain chunks in lower case.
LOWER_CASE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as the character of its code if that shows, else as the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = itertools.count(256)
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


@functools.lru_cache(maxsize=2)
def _chunks(path: str) -> _Chunks:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path) as f:
        plan = json.load(f)
    normal = [n.get("type") for n in (plan.get("normalizer") or {}).get("normalizers", [])]
    split = [p.get("pattern", {}).get("Regex") for p in (plan.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    special = any("<" not in t["content"] for t in plan.get("added_tokens", []))
    known = normal == ["NFC", "Replace", "Lowercase"] and split == [LOWER_CASE_WORDS, None] and not special
    tokenizer = Tokenizer.from_file(path)
    return _Chunks(tokenizer, tokenizer.model if known else None)


def forget() -> None:
    """Drop vocabularies and their caches; the next text reads them again."""
    _chunks.cache_clear()


def _ids(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()


class _Cache(dict):
    """Ids by text, bounded in bytes. A key of more than KEPT characters is not kept."""

    size = 0

    def keep(self, key: str, ids: bytes) -> bytes:
        if len(key) <= KEPT:
            self[key] = ids
            self.size += ENTRY + len(key) + len(ids)
        return ids

    def bound(self) -> None:
        if self.size > CACHE:
            for key in list(itertools.islice(self, len(self) // 2, None)):
                self.size -= ENTRY + len(key) + len(self.pop(key))


class _Words(_Cache):
    """Ids of words in lower case; a new one goes to the model."""

    def __init__(self, model):
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return self.keep(word, b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(spelt)]))


class _Chunks(_Cache):
    """Ids of chunks; a new one is made of its words' where it is plain. The vocabulary's special tokens hold '<'."""

    def __init__(self, tokenizer, model):
        self.tokenizer, self.words = tokenizer, _Words(model) if model is not None else None

    def __missing__(self, chunk: str) -> bytes:
        if self.words is not None and "<" not in chunk and PLAIN.fullmatch(chunk):
            ids = b"".join(map(self.words.__getitem__, PLAIN_WORDS.findall(chunk.lower())))
        else:
            ids = _ids(self.tokenizer, chunk)
        return self.keep(chunk, ids)


def _parts(text: str):
    """A text in parts of about PART characters, cut at white space."""
    at = 0
    while len(text) - at > PART:
        gap = SPACE.search(text, at + PART)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def encode(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    chunks = _chunks(path)
    out: list[bytes] = []
    done = 0
    for text in texts:
        if ODD_SEPARATORS.search(text):
            out.append(_ids(chunks.tokenizer, text))
            continue
        ids = []
        for part in _parts(text):
            ids.append(b"".join(map(chunks.__getitem__, part.split())))
            done += len(part)
            if done > PART:
                done = 0
                chunks.bound()
                if chunks.words is not None:
                    chunks.words.bound()
        out.append(ids[0] if len(ids) == 1 else b"".join(ids))
    return out
