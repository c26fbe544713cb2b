import zlib
from collections import Counter, defaultdict

import pytest

import tidemark.llm.queries as registered
from tidemark.llm import sharding

SF = "/root/testdata/sf0.01"


def sound(rows, texts, shards):
    """Every row once, sizes right, slots gapless; bytes per shard."""
    sizes, slots = Counter({s: 0 for s in range(shards)}), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts)
    assert sum(sizes.values()) == sum(len((t or "").encode()) + 8 for _, t in texts)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    return [sizes[s] for s in range(shards)]


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registered.QUERIES["op12_sampled_sharding"](spark, SF).collect()
    sizes = sound(rows, list(docs.items()), 24)
    mean = sum(sizes) / 24
    assert max(sizes) - min(sizes) < 0.02 * mean
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    homes = defaultdict(set)
    for r in rows:
        homes[docs[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in homes.values())


def test_one_text_holds_a_third_of_all_rows(spark, corpus):
    rows = [(k, f"text number {k} " + "w " * (k % 40)) for k in range(4000)]
    rows += [(10_000 + k, "copied all over") for k in range(3000)] + [(None, "the same row")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard_documents(docs, shards=7, parts=16).collect()
    sizes = sound(got, rows, 7)
    assert max(sizes) - min(sizes) < 0.2 * sum(sizes) / 7
    spread = {r["shard"] for r in got if r["doc_id"] is None}
    assert len(spread) > 1


def test_null_empty_long_and_repeated_rows(make, spark, corpus):
    docs = make(corpus)
    got = sharding.shard_documents(docs, shards=5, carry={"text": docs["text"]})
    rows = got.collect()
    sizes = sound(rows, corpus, 5)
    longest = max(len((t or "").encode()) for _, t in corpus) + 8
    assert max(sizes) <= sum(sizes) / 5 + longest
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(corpus)
    assert sharding.shard_documents(docs.where("doc_id = -1"), shards=5).count() == 0
    few = sharding.shard_documents(make([(1, "a"), (2, None)]), shards=5).collect()
    assert sorted(r["size"] for r in few) == [8, 9]
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, shards=0)


def test_written_shards_are_read_back(make, corpus, spark, tmp_path):
    docs = make(corpus)
    sharding.write_shards(sharding.shard_documents(docs, 3, carry={"text": docs["text"]}), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(corpus) and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_quantiles_close_off_heavy_keys():
    rows = [((1, k, 0), 1.0) for k in range(2)] + [((5, k, 0), 1.0) for k in range(10)] + [((9, 0, 0), 1.0)]
    cuts = sharding.quantiles(rows, 6, 0)
    assert {sharding._key((5, 0, 0)), sharding._key((6, 0, 0))} <= cuts
    assert sharding.quantiles([((1, 1, 1), 2.0)], 1, 0) == set()
