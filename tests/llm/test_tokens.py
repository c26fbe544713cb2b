import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, pretoken

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "it's WE'LL 'S ''s x'st 123 ½² '", "<|endoftext|> hi <|startoftext|>there<|endoftext|>", "ΣΑΣ İ ﬁ é",
       "日本語 \n\n\t x", "\x00\x01 \x85 nul", "a" * 5000, "🤖👍🏽 don't!!'s\n's", "  two   spaces  "]


def odd_texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab'stredlvm 1\n!?é<|>") for _ in range(60)) for _ in range(200)]


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(WORD_FILE)


def test_encoding_equals_the_library(make, corpus, word_tokenizer):
    rows = corpus + [(1000 + k, t) for k, t in enumerate(odd_texts())]
    got = bpe.encode_documents(make(rows), WORD_FILE).collect()
    want = Counter()
    for i, t in rows:
        ids = word_tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), " ".join(map(str, ids)), word_tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in got) == want


def test_automaton_accepts_one_path_only():
    """Each word's encoding is accepted; other spellings of it are not."""
    machine, _ = bpe.load(WORD_FILE)
    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("thenglisor") for _ in range(6))
        path = machine.encode_word(word)
        assert all(machine.allows(a, b) for a, b in zip(path, path[1:]))
        single = [machine.inner[c] for c in word[:-1]] + [machine.final[word[-1]]]
        assert single == path or not all(machine.allows(a, b) for a, b in zip(single, single[1:]))


def test_repeated_pair_merges_from_the_left():
    machine = bpe.Automaton({"a": 0, "aa": 1, "b": 2, "aab": 3}, [("a", "a"), ("aa", "b")])
    assert machine.encode_word("aaaaa") == [1, 1, 0]
    assert machine.encode_word("aaab") == [1, 0, 2]
    assert machine.encode_word("aab") == [3]


@pytest.mark.parametrize("rule, path", [("word", WORD_FILE), ("byte", BYTE_FILE)])
def test_spans_equal_the_library(rule, path):
    tokenizer = Tokenizer.from_file(path)
    texts = [t for t in odd_texts() if "<|" not in t]
    if rule == "word":
        texts = [bpe.normalize(t) for t in texts]
    joined, start, end, row = pretoken.spans(texts, rule)
    got = defaultdict(list)
    for s, e, r in zip(start, end, row):
        got[r].append(joined[s:e])
    for k, t in enumerate(texts):
        assert got[k] == [t[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(t)]


def check_packing(rows, got, size, end_id):
    tokenizer = Tokenizer.from_file(BYTE_FILE)
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id], "<u4")
        head = len(ids) % size or size
        cuts = [0, *range(head, len(ids), size), len(ids)] if len(ids) > size else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= size
    return len(sequences)


def test_packing_places_every_piece(make, corpus):
    rows = corpus + [(1000 + k, t) for k, t in enumerate(ODD)]
    got = packing.pack_documents(make(rows), BYTE_FILE, size=64).collect()
    used = check_packing(rows, got, 64, 2)
    assert used <= 1.1 * sum(r["length"] for r in got) / 64 + 2


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1024, 20000) if seed % 2 else np.clip(rng.lognormal(5.5, 1, 20000), 1, 1024).astype(int)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.plan_packing(dict(zip(values.tolist(), counts.tolist())), 1024)
    fill = np.zeros(plan.sequences, np.int64)
    placed = Counter()
    for n, _, count, first, _ in plan.places:
        fill[first:first + count] += n
        placed[n] += count
    assert placed == Counter(dict(zip(values.tolist(), counts.tolist())))
    assert fill.max() <= 1024 and (fill > 0).all()
    assert plan.sequences <= 1.01 * -(-int(lengths.sum()) // 1024)


@pytest.mark.parametrize("histogram", [{}, {1: 5}, {1024: 3}, {600: 7}, {512: 3, 513: 1}])
def test_small_plans(histogram):
    plan = packing.plan_packing(histogram, 1024)
    assert dict(plan.rank) == histogram
    assert plan.sequences >= -(-sum(n * c for n, c in histogram.items()) // 1024)


def test_empty_table(make):
    empty = make([(1, "a")]).where("doc_id < 0")
    assert bpe.encode_documents(empty, WORD_FILE).count() == 0
    assert packing.pack_documents(empty, BYTE_FILE).count() == 0


def test_queries_on_the_given_tables(spark, word_tokenizer):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = QUERIES["op4_bpe_automaton"](spark, sf).collect()
    want = set()
    for i, t in docs:
        ids = word_tokenizer.encode(t or "", add_special_tokens=False).ids
        text = word_tokenizer.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(text.encode()).hexdigest()))
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
    got = QUERIES["op10_best_fit_packing"](spark, sf).collect()
    check_packing(docs, got, 1024, 2)
