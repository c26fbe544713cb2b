"""Pre-token spans of many texts at once, by character classes in numpy.

Two splitting rules, as the tokenizers' files state them:
  "word":  's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+   (white space dropped)
  "byte":  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
# White_Space of Unicode (fixed values).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        found = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):  # the library's own tables
            for run, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
                found[np.frombuffer(run.encode("utf-32-le"), np.uint32)] = kind
        found[WHITE] = SPACE
        _CLASSES = found
    return _CLASSES


def _cuts(texts: list[str], rule: str):
    """(joined text, its code points, begins of all runs, which of them are
    pre-tokens, positions of the texts' ends); a run ends where the next begins."""
    joined = "\0".join([*texts, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.cumsum(sizes + 1) - 1
    kind = classes()[code]
    kind[edges] = EDGE
    n = len(code)
    before = np.empty(n, np.uint8)
    before[:1], before[1:] = EDGE, kind[:-1]
    after = np.empty(n, np.uint8)
    after[-1:], after[:-1] = EDGE, kind[1:]
    begins = kind != before
    begins[kind == EDGE] = True  # two empty texts in a row
    if rule == "word":
        begins |= kind == NUMBER
    # contractions: an apostrophe that starts a match, then these letters
    quote = np.flatnonzero((code == 39) & begins & (after == LETTER))
    if rule == "byte" and len(quote):
        quote = quote[~((quote > 0) & (code[quote - 1] == 32) & (before[quote] == SPACE))]
    if len(quote):
        second = code[quote + 1]
        third = np.where(quote + 2 < n, code[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(second, [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            two |= (second == ord(pair[0])) & (third == ord(pair[1]))
        for picked, size in ((quote[one], 2), (quote[two], 3)):
            begins[picked + 1] = False
            rest = picked + size
            begins[rest[kind[rest] == LETTER]] = True
    if rule == "byte":
        inner = (kind == SPACE) & (after != SPACE) & (after != EDGE)  # last white space before a match
        begins |= inner
        joins = np.flatnonzero(inner & (code == 32)) + 1
        begins[joins] = False
        at = np.flatnonzero(begins)
        keep = kind[at] != EDGE
    else:
        at = np.flatnonzero(begins)
        keep = (kind[at] != EDGE) & (kind[at] != SPACE)
    return joined, code, at, keep, edges


def spans(texts: list[str], rule: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(joined text, start, end, row) of every pre-token, in order."""
    joined, code, at, keep, edges = _cuts(texts, rule)
    ends = np.append(at[1:], len(code))
    at, ends = at[keep], ends[keep]
    return joined, at, ends, np.searchsorted(edges, at)


def distinct_words(texts: list[str], rule: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct pre-tokens in UTF-8, which of them, row) of every pre-token, in order.

    The runs cover the joined text without gaps, so their begins are the offsets
    of an Arrow array over its bytes; Arrow finds the distinct ones without a
    Python object per word."""
    joined, code, at, keep, edges = _cuts(texts, rule)
    raw = joined.encode("utf-8", "surrogatepass")
    width = np.ones(len(code), np.int64)
    for bound in (0x7F, 0x7FF, 0xFFFF):
        width += code > bound
    ends = np.cumsum(width)
    small = len(raw) < 1 << 31
    offsets = np.append(ends[at] - width[at], len(raw)).astype(np.int32 if small else np.int64)
    runs = pa.Array.from_buffers(pa.binary() if small else pa.large_binary(), len(at),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    which = runs.indices.to_numpy()[keep]
    used = np.zeros(len(runs.dictionary), bool)
    used[which] = True
    return runs.dictionary.filter(pa.array(used)).to_pylist(), (np.cumsum(used) - 1)[which], np.searchsorted(edges, at[keep])
