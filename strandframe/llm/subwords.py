"""Subword ids from the files of public byte-pair tokenizers. Tokenizers are read, never trained; their path is a parameter."""

from __future__ import annotations

import base64
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern and the size of the vocabulary without specials. The next id ends a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
#: White space beyond ASCII's, which the pattern's \s has too.
_GAP = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Texts with a space beside another white space or at a border, or with a zero byte, are encoded whole. The others are
#: cut where the pattern always parts: before a space, after letters before . and , and around a lone line break.
_KNOTTY = rf"^ | $|{_GAP} | {_GAP}|\x00"
_CUTS = [(r"([a-zA-Z])([.,])", "\\1\x00\\2"), (r"([a-zA-Z.,])\n([a-zA-Z])", "\\1\x00\n\x00\\2")]
LONGEST = 512  # characters of one piece in the cache
CACHED = 100_000

_encoders: dict = {}
_cache: dict[str, bytes] = {}


def ranks_of(path: str = RANKS) -> bytes:
    """The file's content, for a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """The tokenizer, once a worker."""
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        _cache.clear()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def encode(enc, text: str) -> bytes:
    """The text's ids as 16-bit numbers. A text without spaces is cut, so that merging stays fast."""
    return array("H", enc.encode_ordinary(text)).tobytes()


def encode_words(enc, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the words, and where each word's begin (with the end). Words met before come from a cache of bounded size."""
    out = []
    for w in words:
        ids = _cache.get(w)
        if ids is None:
            ids = encode(enc, w)
            if len(w) <= LONGEST:
                if len(_cache) >= CACHED:
                    _cache.clear()
                _cache[w] = ids
        out.append(ids)
    begin = np.zeros(len(out) + 1, np.int64)
    np.cumsum([len(x) // 2 for x in out], out=begin[1:])
    return np.frombuffer(b"".join(out), np.uint16), begin


@cache
def starts_of(enc) -> np.ndarray:
    """Which ids begin with a space."""
    return np.array([enc.decode_single_token_bytes(i).startswith(b" ") for i in range(END)])


def encode_spaced(enc, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """encode_words of the words with a space before each, in one call of the tokenizer: a lone space always begins a piece, and only a
    word's first id begins with one. Words with other white space in them, which could join that space, are encoded one by one."""
    if len(words):
        gap = pc.match_substring_regex(words, _GAP)
        plain = words if not pc.any(gap).as_py() else words.filter(pc.invert(gap))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), " ")[0].as_py()
        ids = enc.encode_to_numpy(" " + joined).astype(np.uint16) if len(plain) else np.zeros(0, np.uint16)
        begin = np.append(np.flatnonzero(starts_of(enc)[ids]), len(ids))
        if len(begin) == len(words) + 1:
            return ids, begin
        if len(plain) < len(words) and len(begin) == len(plain) + 1:
            gap = gap.to_numpy(zero_copy_only=False)
            rest, at = encode_words(enc, [" " + w for w in words.filter(pa.array(gap)).to_pylist()])
            first, size = np.zeros(len(gap), np.int64), np.zeros(len(gap), np.int64)
            first[~gap], size[~gap] = begin[:-1], np.diff(begin)
            first[gap], size[gap] = len(ids) + at[:-1], np.diff(at)
            ends = np.cumsum(size)
            every = np.concatenate([ids, rest])
            return every[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]))], np.append(0, ends)
    return encode_words(enc, [" " + w for w in words.to_pylist()])


def spread(ids: np.ndarray, begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of entries which, in order, and the number of ids of each."""
    size = np.diff(begin)[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(begin[:-1][which] - (ends - size), size) + np.arange(total)], size


def encode_texts(enc, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by END, and how many each has with it. Null is an empty text."""
    texts = pc.fill_null(texts, "")
    knotty = pc.match_substring_regex(texts, _KNOTTY).to_numpy(zero_copy_only=False)
    cut = pc.replace_substring(pc.if_else(pa.array(knotty), "", texts), " ", "\x00 ")
    for pattern, parted in _CUTS:
        cut = pc.replace_substring_regex(cut, pattern, parted)
    parts = pc.split_pattern(cut, "\x00")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    coded = parts.flatten().dictionary_encode()
    ids, begin = encode_words(enc, coded.dictionary.to_pylist())
    stream, size = spread(ids, begin, coded.indices.to_numpy())
    text = np.repeat(np.arange(len(texts)), counts)
    per = np.bincount(text, weights=size, minlength=len(texts)).astype(np.int64)
    ends = np.cumsum(per)
    if not knotty.any():
        return np.insert(stream, ends, END), per + 1
    out, sizes = [], []
    for i, t in enumerate(texts.to_pylist()):
        own = np.frombuffer(encode(enc, t), np.uint16) if knotty[i] else stream[ends[i] - per[i] : ends[i]]
        out += [own, np.array([END], np.uint16)]
        sizes.append(len(own) + 1)
    return np.concatenate(out), np.array(sizes, np.int64)
