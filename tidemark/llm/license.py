"""License scans: template-markup matching.

A template is license wording in which ``[[ ... ]]`` encloses an optional region and
``{{n}}`` a replaceable one of at most n words (a name, a version).  All
templates are compiled into one deterministic token automaton; a text is
accepted from a word on if its words spell a template's mandatory wording
exactly, optional regions present whole or absent, replaceable ones any words.

Documents are scanned where they lie, as arrays of word hashes; the automaton
runs only in documents that hold a word which every one of its templates
cannot do without.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, prepare, slices, text_bytes

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license wording, one template per label.
TEMPLATES = {
    "mit-text": """[[the]] [[mit license]] [[copyright {{12}}]] permission is hereby granted free of charge to any
        person obtaining a copy of this software and associated documentation files the software to deal in the
        software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions""",
    "isc-text": """permission to use copy modify and or distribute this software for any purpose with or without fee
        is hereby granted provided that the above copyright notice and this permission notice appear in all copies""",
    "bsd-text": """redistribution and use in source and binary forms with or without modification are permitted
        provided that the following conditions are met""",
    "apache-notice": """[[this {{3}} is]] licensed under the apache license [[version {{2}}]]
        [[the license you may not use this file except in compliance with the license]]""",
    "gpl-notice": """[[this {{3}} is]] licensed under the [[terms of the]] [[gnu]] [[lesser]] [[affero]] general public
        license [[version {{2}}]] [[or any later version]]""",
    "cc-notice": """[[this {{3}} is]] licensed under [[a]] [[the]] cc by [[nc]] [[sa]] [[nd]] {{2}}""",
    "mit-notice": """[[this {{3}} is]] licensed under the [[terms of the]] mit license""",
}

# Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
SEPARATORS = np.ones(256, bool)
SEPARATORS[0x30:0x3A] = False
SEPARATORS[0x61:0x7B] = False
SEPARATORS[0x80:] = False


def word_hashes(words: list[str]) -> np.ndarray:
    """The hash each word has in a scanned text."""
    data = " ".join(words).encode()
    return Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0, 1, SEPARATORS, lower=True).hash


class Automaton:
    """Deterministic automaton over words for all templates at once."""

    def __init__(self, templates: dict[str, str]):
        self.labels = sorted(templates)
        self.skips: list[list[int]] = []  # states reached without a word
        self.steps: list[list[tuple[str | None, int]]] = []  # (word, or None for any; state)
        self.accepts: dict[int, str] = {}
        begins = []
        for label in self.labels:
            first = self._state()
            begins.append(first)
            tokens = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", templates[label])
            self.accepts[self._chain(first, tokens)] = label
        self.words = sorted({w for s in self.steps for w, _ in s if w is not None})
        self.number = {w: k + 1 for k, w in enumerate(self.words)}  # 0: any other word
        self.start = self._closed(begins)
        self.table: dict[tuple[frozenset, int], frozenset] = {}

    def _state(self) -> int:
        self.skips.append([])
        self.steps.append([])
        return len(self.steps) - 1

    def _chain(self, at: int, tokens: list[str]) -> int:
        opened = []
        for t in tokens:
            if t == "[[":
                opened.append(at)
            elif t == "]]":
                self.skips[opened.pop()].append(at)
            elif t.startswith("{{"):
                end = self._state()
                self.skips[at].append(end)
                for _ in range(int(t[2:-2])):
                    nxt = self._state()
                    self.steps[at].append((None, nxt))
                    self.skips[nxt].append(end)
                    at = nxt
                at = end
            else:
                nxt = self._state()
                self.steps[at].append((t, nxt))
                at = nxt
        return at

    def _closed(self, states) -> frozenset:
        found, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in found:
                found.add(s)
                todo.extend(self.skips[s])
        return frozenset(found)

    def step(self, states: frozenset, word: int) -> frozenset:
        """The state after ``word``: a row of the table, made when first needed."""
        to = self.table.get((states, word))
        if to is None:
            text = self.words[word - 1] if word else ""
            to = self._closed([n for s in states for w, n in self.steps[s] if w is None or (word and w == text)])
            self.table[states, word] = to
        return to

    def labels_in(self, words: list[int]) -> dict[str, tuple[int, int]]:
        """label -> (first word, words) of its first longest accepted span."""
        found: dict[str, tuple[int, int]] = {}
        for at in range(len(words)):
            states, k = self.start, at
            while states and k < len(words):
                states = self.step(states, words[k])
                k += 1
                for s in states:
                    label = self.accepts.get(s)
                    if label and (label not in found or found[label][0] == at):
                        found[label] = (at, k - at)
        return found

    def needed(self) -> list[str]:
        """A few words of which every template needs at least one: of each
        template the mandatory word that the fewest templates use."""
        return self._needed

    @classmethod
    def compiled(cls, templates: dict[str, str]) -> Automaton:
        made = cls(templates)
        mandatory = {}
        for label, text in templates.items():
            bare = re.sub(r"\{\{\d+\}\}", " ", text)
            while "[[" in bare:
                bare = re.sub(r"\[\[[^\[\]]*\]\]", " ", bare)
            mandatory[label] = bare.split()
        made._needed = sorted({max(words, key=lambda w: (len(w), w)) for words in mandatory.values()})
        return made


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score) per document.

    n_base counts all places where a phrase's words stand one after another;
    first_word and last_word are their least and greatest start (words count
    from 0; null without a place).  ``labels`` adds those of accepted
    templates; both lists are distinct, sorted and joined by commas, empty
    without a label.  ``spans`` gives each accepted template's place as
    label:first word:words.  Score: 1 with an accepted template, 0.5 with
    phrases alone, else 0.  Null texts are empty; rows that repeat an id are
    rows of their own, null ids stay null, an empty table gives an empty
    result; other columns play no part.
    """
    prepare(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        machine = Automaton.compiled(templates)
        coded = [(word_hashes(p.split()), label) for p, label in phrases.items()]
        alphabet = word_hashes(machine.words) if machine.words else np.zeros(0, np.uint64)
        order = np.argsort(alphabet)
        needed = word_hashes(machine.needed()) if machine.words else np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                w = Words(data, offsets, i, j, SEPARATORS, lower=True)
                n, row = j - i, w.rows()
                places = np.zeros(0, np.int64)
                base: list[set[str]] = [set() for _ in range(n)]
                for words, label in coded:
                    hit = np.flatnonzero(w.hash == words[0]) if len(w) else np.zeros(0, np.int64)
                    hit = hit[hit + len(words) <= len(w)]
                    for k in range(1, len(words)):
                        hit = hit[w.hash[hit + k] == words[k]]
                    hit = hit[row[hit] == row[hit + len(words) - 1]] if len(hit) else hit
                    places = np.concatenate([places, hit])
                    for r in np.unique(row[hit]).tolist():
                        base[r].add(label)
                at = row[places]
                n_base = np.bincount(at, minlength=n)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(first, at, places - w.first[at])
                np.maximum.at(last, at, places - w.first[at])
                spans: list[dict] = [{} for _ in range(n)]
                for r in np.unique(row[np.isin(w.hash, needed)]).tolist():
                    own = w.hash[w.first[r]:w.first[r + 1]]
                    k = np.minimum(np.searchsorted(alphabet[order], own), len(order) - 1)
                    known = alphabet[order][k] == own
                    spans[r] = machine.labels_in(np.where(known, order[k] + 1, 0).tolist())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, n), pa.array(np.diff(w.first), pa.int64()), pa.array(n_base, pa.int64()),
                    pa.array(first, pa.int64(), mask=n_base == 0), pa.array(last, pa.int64(), mask=n_base == 0),
                    pa.array([",".join(sorted(b)) for b in base], pa.string()),
                    pa.array([",".join(sorted(b | set(s))) for b, s in zip(base, spans, strict=True)], pa.string()),
                    pa.array([",".join(f"{x}:{a}:{c}" for x, (a, c) in sorted(s.items())) for s in spans], pa.string()),
                    pa.array([1.0 if s else 0.5 if b else 0.0 for b, s in zip(base, spans, strict=True)], pa.float64()),
                ], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans",
                          "score"])

    picked = docs.select(F.col(id_col), F.col(text_col))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, "
                                  "last_word bigint, base_labels string, labels string, spans string, score double")
