"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens.  It starts with one state that allows every base
symbol; the merges are then compiled in, one gadget each and in their order.
The gadget of ``u v -> w``: the state q that u-arcs lead to is copied without
its v-arc, u-arcs now lead to the copy (u is never followed by v any more),
and every state with a u-arc gets a w-arc to where v-arcs lead.  The state an
arc leads to depends on its token only, so the machine is two tables:

  per token: its state, the left part it was merged from, the time of the merge;
  per state: the state it was copied from, the token removed, the time.

Whether state s has an x-arc follows from these tables: x stood for the left
parts it was merged from at the times before its merge, and is missing where
the copy chain of s removed what x stood for at that time.  Of all paths that
spell a word exactly one is accepted: its BPE encoding.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, slices, text_bytes
from tidemark.llm.pretoken import LETTER, classes, distinct_words

# Entries of a worker's caches (words, arcs); a full cache starts anew.
CACHE_WORDS = 500_000
CACHE_ARCS = 400_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files:
    printable Latin-1 stands for itself, the rest for U+0100 onwards."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown, extra = [], 0
    for b in range(256):
        if b in plain:
            shown.append(chr(b))
        else:
            shown.append(chr(256 + extra))
            extra += 1
    return shown


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        size = max(vocab.values()) + 1
        self.label = [""] * size
        for text, i in vocab.items():
            self.label[i] = text
        self.left, self.born, self.state = [-1] * size, [0] * size, [0] * size
        self.copied, self.removed, self.time = [0], [-1], [0]
        self._arcs: dict[tuple[int, int], bool] = {}
        base = set(byte_characters())
        usable = {i for t, i in vocab.items() if t in base or (suffix and t.endswith(suffix) and t[:-len(suffix)] in base)}
        for when, (a, b) in enumerate(merges, 1):
            joined = a + b
            if a not in vocab or b not in vocab or joined not in vocab:
                continue
            u, v, w = vocab[a], vocab[b], vocab[joined]
            if u not in usable or v not in usable or w in usable:
                continue
            usable.add(w)
            after_v = self.state[v]
            self.copied.append(self.state[u])
            self.removed.append(v)
            self.time.append(when)
            self.state[u] = len(self.copied) - 1
            self.left[w], self.born[w], self.state[w] = u, when, after_v
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for i in usable:
            text = self.label[i]
            if suffix and text.endswith(suffix):
                self.final[text[:-len(suffix)]] = i
            else:
                self.inner[text] = i
        if not suffix:
            self.final = self.inner
        # the longest label that starts with these three characters
        self.reach: dict[str, int] = {}
        for text in [*self.inner, *self.final]:
            if len(text) > 2:
                self.reach[text[:3]] = max(self.reach.get(text[:3], 0), len(text))

    def allows(self, token: int, nxt: int) -> bool:
        """Whether the state after ``token`` has an arc ``nxt``."""
        found = self._arcs.get((token, nxt))
        if found is None:
            if len(self._arcs) >= CACHE_ARCS:
                self._arcs.clear()
            found = self._arcs[token, nxt] = self._walk(self.state[token], nxt)
        return found

    def _walk(self, s: int, x: int) -> bool:
        left, born, copied, removed, time = self.left, self.born, self.copied, self.removed, self.time
        while s:
            when = time[s]
            while born[x] >= when:
                x = left[x]
            if removed[s] == x:
                return False
            s = copied[s]
        return True

    def encode_word(self, word: str) -> list[int]:
        """The accepted path that spells ``word`` (in byte characters): longest
        arcs first, stepping back where no arc goes on."""
        n, path, at, dead = len(word), [], 0, set()
        inner, final, reach = self.inner, self.final, self.reach
        tries = [min(reach.get(word[:3], 2), n)] if n else []
        marks = []
        while at < n:
            size, last = tries[-1], path[-1] if path else -1
            step = -1
            if (at, last) not in dead:
                while size:
                    end = at + size
                    x = (final if end == n else inner).get(word[at:end], -1)
                    if x >= 0 and (last < 0 or self.allows(last, x)):
                        step = x
                        break
                    size -= 1
            if step >= 0:
                tries[-1] = size - 1
                marks.append(at)
                path.append(step)
                at += size
                if at < n:
                    tries.append(min(reach.get(word[at:at + 3], 2), n - at))
            else:
                dead.add((at, last))
                tries.pop()
                if not path:
                    raise ValueError("the vocabulary lacks a byte")
                path.pop()
                at = marks.pop()
        return path


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Automaton, dict[str, int]]:
    """(automaton, special tokens) of a tokenizer file; kept by each worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
    automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
    specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    automaton.label += [""] * (max([-1, *specials.values()]) + 1 - len(automaton.label))
    for content, i in specials.items():
        automaton.label[i] = content
    return automaton, specials


@lru_cache(maxsize=1)
def newer_lower() -> dict[str, str]:
    """Lower case of letters that are newer than Python's own tables."""
    from tokenizers.normalizers import Lowercase

    known = classes()
    newer = [chr(c) for c in np.flatnonzero(known == LETTER).tolist() if unicodedata.category(chr(c)) == "Cn"]
    found = {c: Lowercase().normalize_str(c) for c in newer}
    return {c: low for c, low in found.items() if c != low}


def normalize(text: str) -> str:
    """NFC, then lower case letter by letter (no word-final form of sigma)."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")
        for capital, small in newer_lower().items():
            text = text.replace(capital, small)
    return text.lower()


def split_specials(text: str, specials: dict[str, int]) -> list[str | int]:
    """Pieces of ordinary text and ids of special tokens, leftmost first."""
    out: list[str | int] = []
    while True:
        found = [(at, s) for s in specials if (at := text.find(s)) >= 0]
        if not found:
            out.append(text)
            return out
        at, s = min(found)
        out += [text[:at], specials[s]]
        text = text[at + len(s):]


class WordCoder:
    """Words to their encodings (any value per word), through a bounded cache.

    Two generations: when the newer is full it becomes the older one, and words
    met again move back to the newer; so frequent words are coded once.
    """

    def __init__(self, code, most: int = CACHE_WORDS):
        self.code, self.most, self.known, self.older = code, most, {}, {}

    def look_up(self, words: list[bytes]) -> list:
        """The encodings of distinct words."""
        known, older = self.known, self.older
        found = list(map(known.get, words))
        missing = [w for w, f in zip(words, found, strict=True) if f is None]
        if missing:
            if len(known) + len(missing) > self.most:
                self.older, older, kept = known, known, {w: known[w] for w in words if w in known}
                known = self.known = kept
            new = []
            for w in missing:
                value = older.get(w)
                if value is None:
                    new.append(w)
                else:
                    known[w] = value
            known.update(zip(new, self.code(new), strict=True))
            found = [known[w] for w in words]
        return found


def encoded_rows(texts: list[str], path: str, coder: WordCoder) -> list[tuple[int, bytes, str]]:
    """(number of ids, decimal ids joined by spaces, labels joined by spaces) per text."""
    automaton, specials = load(path)
    pieces, owner, fixed = [], [], {}
    for row, text in enumerate(texts):
        parts = split_specials(text, specials) if any(s in text for s in specials) else [text]
        for part in parts:
            if isinstance(part, int):
                fixed[len(pieces)] = (1, str(part).encode(), automaton.label[part])
                part = ""
            pieces.append(normalize(part))
            owner.append(row)
    words, which, row = distinct_words(pieces, "word")
    codes = coder.look_up(words)
    coded = [codes[k] for k in which.tolist()]
    cuts = np.searchsorted(row, np.arange(len(pieces) + 1)).tolist()
    parts_of: list[list] = [[] for _ in texts]
    for k, r in enumerate(owner):
        if k in fixed:
            parts_of[r].append(fixed[k])
        else:
            parts_of[r].extend(coded[cuts[k]:cuts[k + 1]])
    return [(sum(p[0] for p in parts), b" ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]))
            for parts in parts_of]


@lru_cache(maxsize=1)
def word_coder(path: str) -> WordCoder:
    """Kept by each worker, so words that one task coded are known to its next."""
    automaton, _ = load(path)
    shown = byte_characters()

    def code(words: list[bytes]) -> list[tuple[int, bytes, str]]:
        out = []
        for w in words:
            ids = automaton.encode_word("".join([shown[b] for b in w]))
            out.append((len(ids), " ".join(map(str, ids)).encode(), " ".join([automaton.label[i] for i in ids])))
        return out

    return WordCoder(code)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded) per document: ``ids`` in decimal, joined by
    spaces, ``decoded`` the labels of the arcs in order, joined by spaces (the
    file names no decoder).  ``digests``: SHA-256 of both, in hexadecimal, as
    ids_sha256 and decoded_sha256 in their place, so that a digest alone leaves
    the worker.

    Null and empty texts have no tokens and empty strings.  Rows that repeat an
    id are rows of their own, null ids stay null, an empty table gives an empty
    result, and other columns play no part.
    """
    import hashlib

    spark = docs.sparkSession
    prepare(spark)
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches):
        coder = word_coder(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                texts = [bytes(data[offsets[k]:offsets[k + 1]]).decode("utf-8", "replace") for k in range(i, j)]
                rows = encoded_rows(texts, path, coder)
                if digests:
                    first = [hashlib.sha256(r[1]).hexdigest() for r in rows]
                    second = [hashlib.sha256(r[2].encode()).hexdigest() for r in rows]
                else:
                    first, second = [r[1].decode() for r in rows], [r[2] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array(first, pa.string()), pa.array(second, pa.string())],
                    names=[id_col, "n_tokens", *names])

    picked = docs.select(F.col(id_col), F.col(text_col))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {names[0]} string, {names[1]} string")


def decode_labels(ids: list[int], path: str) -> str:
    """Labels of the arcs ``ids``, joined by spaces."""
    automaton, _ = load(path)
    return " ".join(automaton.label[i] for i in ids)
