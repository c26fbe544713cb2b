import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, p long, root string, conv int"


def plain(rows):
    """The trie by dictionaries."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    out, total = [], {}
    for seq in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        kids = children[seq]
        total[seq] = (sum(total[k][0] for k in kids) or 1,
                      sum(total[k][1] for k in kids) + (len(members[seq]) - 1) * words)
        ends = ",".join(str(c) for c in sorted(members[seq]) if built[c] == seq)
        out.append((min(members[seq]), len(seq), min(members[seq[:-1]]) if seq else None, len(members[seq]), len(kids),
                    *total[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def by_key(rows):
    return sorted(rows, key=lambda r: (r[1], r[0], str(r)))


def check(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = [tuple(r) for r in trie.prefix_trie(table, **more).collect()]
    assert by_key(got) == by_key(plain(rows))


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    pool = [("user", "hi there"), ("assistant", "hello you\tthere"), ("user", ""), ("assistant", None), (None, "x")]
    rows = []
    for c in [*range(0, 130), -7, -20, -33, 1000, 5001]:
        for t in range(rng.choice([1, 2, 3, 5, 6])):
            rows.append((c, t, *rng.choice(pool)) if rng.random() < 0.8 else (c, t, "user", f"only {c} {t}"))
    rows += [(c, t, "user", "the same talk") for c in range(200, 260) for t in range(5)]  # copies
    rows += [(None, 0, "user", "no id"), (0, None, "user", "null first"), (0, None, "assistant", "and again"),
             (41, 1, "user", "tie b"), (41, 1, "user", "tie a"), (41, 1, "user", "tie a")]
    rows += [(300, t, "user", f"turn {t % 7}") for t in range(150)] + [(301, t, "user", f"turn {t % 7}") for t in range(149)]
    rows += [(320, 0, "user", "w " * 30000)]
    return rows


@pytest.mark.parametrize("shards,chunk,queue_rows", [(3, 4096, 200_000), (8, 16, 10), (1, 7, 3)])
def test_against_dictionaries(spark, talks, shards, chunk, queue_rows):
    check(spark, talks, shards=shards, chunk=chunk, queue_rows=queue_rows)


def test_lists_of_ids_are_joined_in_pieces(spark, talks, monkeypatch):
    monkeypatch.setattr(trie, "LIST_CHARS", 100)
    check(spark, talks, shards=4)


def test_small_and_empty_tables(spark):
    for rows in ([(7, 0, "user", "one")], [(1, 0, "user", "a"), (2, 0, "user", "b")], [(5, None, None, None)]):
        check(spark, rows)
    table = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(table).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "x", 1)], SCHEMA)).count() == 0


def test_spilling_queue_is_a_priority_queue():
    rng = random.Random(2)
    queue, twin = trie.SpillingQueue(most=20), []
    for step in range(5000):
        if rng.random() < 0.6:
            item = (rng.randrange(1000), step)
            queue.push(item)
            twin.append(item)
        elif twin:
            twin.sort()
            assert queue.peek() == twin[0] and queue.pop() == twin.pop(0)
    assert queue.spilled > 10
    twin.sort()
    assert [queue.pop() for _ in twin] == twin and queue.peek() is None


def test_a_node_without_its_parent_is_an_error():
    import pyarrow as pa

    row = (2, 1, 1, 5, 5, False, 0, 1, 0, 0, 0, 0, "")
    batch = pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=trie.FIELDS)
    with pytest.raises(ValueError):
        list(trie.time_forward(iter([batch])))
