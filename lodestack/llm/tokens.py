"""Tokens of whole columns by public vocabularies, encoding each distinct word of a batch once.

Neither kind of vocabulary has a piece that crosses from a non-space to a space, so a text whose words are divided by
single spaces encodes as its words do, one by one. Texts with other spacing are encoded whole.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

DEFAULT_DIR = "/opt/tokenizers"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """encode(words) -> token ids of each; space: what stands before a word that isn't the first; fallback: by id."""

    def __init__(self, path: str):
        self.known: dict[str, list[int]] = {}
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size, self.space = sp.get_piece_size(), ""
            self.encode = lambda words: sp.encode(words, num_threads=1)
            self.fallback = np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(self.size)])
        elif path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size, self.space = max(ranks.values()) + 1, " "
            self.encode = lambda words: [enc.encode_ordinary(w) for w in words]
            self.fallback = np.zeros(self.size, bool)
            for raw, i in ranks.items():
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    self.fallback[i] = True
        else:
            raise ValueError(f"unknown kind of vocabulary: {path}")


#: Words whose tokens a worker remembers, first come; the most frequent come first.
REMEMBERED = 50_000


def _recall(vocab: Vocabulary, words: list[str]) -> list[list[int]]:
    """vocab.encode(words), for words that batches share."""
    known = vocab.known
    out = [known.get(w) for w in words]
    new = [i for i, x in enumerate(out) if x is None]
    for i, x in zip(new, vocab.encode([words[i] for i in new])):
        out[i] = x
        if len(known) < REMEMBERED and len(words[i]) <= 32:
            known[words[i]] = x
    return out


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _flat(encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, encoded), np.int64, len(encoded))
    return np.fromiter((x for e in encoded for x in e), np.int32, int(n.sum())), n


def _gather(ids: np.ndarray, start: np.ndarray, n: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The concatenation of the ragged rows ``rows``."""
    own = n[rows]
    ends = np.cumsum(own)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[rows] - (ends - own), own)
    return ids[at]


#: Rows whose words are encoded together, and rows whose tokens are held at a time.
ROWS_OF_WORDS = 1_000
ROWS_OF_TOKENS = 100


def encode(texts: pa.Array, vocab: Vocabulary):
    """Tokens of successive groups of rows: (rows, number of tokens of each, index into rows and id of every token).

    Each row comes once; the tokens of a group are in no certain order. Null and empty texts have no tokens.
    """
    for first in range(0, len(texts), ROWS_OF_WORDS):
        for rows, n, row, ids in _encode(texts.slice(first, ROWS_OF_WORDS), vocab, True):
            yield rows + first, n, row, ids


def count(texts: pa.Array, vocab: Vocabulary) -> np.ndarray:
    """Number of tokens of each text."""
    total = np.zeros(len(texts), np.int64)
    for first in range(0, len(texts), ROWS_OF_WORDS):
        for rows, n, _, _ in _encode(texts.slice(first, ROWS_OF_WORDS), vocab, False):
            total[rows + first] = n
    return total


def _encode(texts: pa.Array, vocab: Vocabulary, want_ids: bool):
    texts = texts.cast(pa.large_string()).fill_null("")
    odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))).to_numpy(zero_copy_only=False)
    some = pc.binary_length(texts).to_numpy() > 0
    none = np.zeros(0, np.int32)
    if not some.all():
        at = np.flatnonzero(~some)
        yield at, np.zeros(len(at), np.int64), none, none
    strange = np.flatnonzero(odd & some)
    for k in range(0, len(strange), ROWS_OF_TOKENS):
        at = strange[k : k + ROWS_OF_TOKENS]
        flat, n = _flat(vocab.encode(texts.take(pa.array(at)).to_pylist()))
        yield at, n, np.repeat(np.arange(len(at), dtype=np.int32), n), flat
    plain = np.flatnonzero(~odd & some)
    if not len(plain):
        return
    split = pc.split_pattern(texts.take(pa.array(plain)), " ")
    off = np.asarray(split.offsets)
    words = split.values.dictionary_encode()
    del split
    codes = words.indices.to_numpy(zero_copy_only=False)
    unique = words.dictionary.to_pylist()
    del words
    lead_ids, lead_n = none, np.zeros(len(plain), np.int64)
    if vocab.space:
        lead_ids, lead_n = _flat(_recall(vocab, [unique[c] for c in codes[off[:-1]]]))
        unique = [vocab.space + w for w in unique]
    ids, n = _flat(_recall(vocab, unique))
    start, lead_off = np.cumsum(n) - n, np.concatenate(([0], np.cumsum(lead_n)))
    skip = 1 if vocab.space else 0
    for k in range(0, len(plain), ROWS_OF_TOKENS):
        e = min(k + ROWS_OF_TOKENS, len(plain))
        own = codes[off[k] : off[e]]
        doc = np.repeat(np.arange(e - k, dtype=np.int32), np.diff(off[k : e + 1]))
        if skip:
            rest = np.ones(len(own), bool)
            rest[off[k:e] - off[k]] = False
            own, doc = own[rest], doc[rest]
        each = n[own]
        total = np.bincount(doc, each, e - k).astype(np.int64) + lead_n[k:e]
        if not want_ids:
            yield plain[k:e], total, none, none
            continue
        row = np.concatenate((np.repeat(np.arange(e - k, dtype=np.int32), lead_n[k:e]), np.repeat(doc, each)))
        yield plain[k:e], total, row, np.concatenate((lead_ids[lead_off[k] : lead_off[e]], _gather(ids, start, n, own)))


def count_tokens(paths: str):
    """A mapInArrow function from (text, *rest) to (n_tokens, *rest)."""

    def run(batches):
        vocab = vocabulary(paths)
        for b in batches:
            n = count(b.column(0), vocab)
            yield pa.record_batch([pa.array(n), *b.columns[1:]], names=["n_tokens", *b.schema.names[1:]])
            C.trim()

    return run
