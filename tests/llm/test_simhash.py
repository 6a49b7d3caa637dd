import random

import numpy as np
import xxhash
from conftest import SF_SMALL
from made_words import words

from termlink.llm import queries, simhash


def plain_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    grams = [" ".join(w[i: i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, bits):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    a = np.array(fps, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= bits):
            up[top(int(j))] = top(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(ids))]


def test_query_on_given_documents(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], [f"{x:016x}" for x in fps], plain_components([r.doc_id for r in rows], fps, 2)))
    assert sorted(map(tuple, queries.op5_simhash_dedup(spark, SF_SMALL).collect())) == want


def test_links_are_exact_with_and_without_crowded_keys(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:4]:      # dense neighbourhoods, chains of them, and pairs just too far away
        x = b
        for _ in range(60):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
            fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        fps |= {b ^ (1 << i) ^ (1 << j) for i in range(10) for j in range(i)}
    fps |= {0, 1, 1 << 63, (1 << 64) - 1}
    fps = sorted(fps)
    from termlink.llm.components import components
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").repartition(4)
    for bits in (1, 2, 3):
        want = plain_components(list(range(len(fps))), fps, bits)
        for crowd in (2, 1000):
            root = {r.node: r.root for r in components(simhash.links(df, bits, 5, crowd)).collect()}
            got = [root.get(x - (1 << 64) if x >> 63 else x, x - (1 << 64) if x >> 63 else x) for x in fps]
            assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_odd_rows(spark):
    long = " ".join(words("l", 70_000))
    rows = [(5, None, 1), (3, "", 1), (4, " \n\t", 1), (None, "", 1), (7, "Two words", 1), (8, "two  WORDS", 1), (7, "Two words", 1),
            (9, long, 1), (10, long + " tail", 1), (None, "only null ids here", 1), (11, "É É É É", 1), (12, "é é é é", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(3)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = plain_components([r[0] for r in rows], fps, 2)
    assert got == sorted(zip([r[0] for r in rows], fps, want), key=str)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted({c for c in want if c is not None})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.deduplicate(docs.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    from termlink.llm.components import components
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)}


def test_deduplicate_goes_by_row_not_id(spark):
    a, b, c, d, e = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcde")
    rows = [(1, a), (5, a), (5, b),                    # 5 is a copy of 1 and has a text of its own
            (2, c), (2, d), (None, d),                 # 2 is the smallest of two classes, one with a null id
            (None, c), (None, c), (None, e), (None, e),  # a class of null ids stays
            (9, None), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text or "") for r in simhash.deduplicate(docs).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (2, c), (2, d), (None, e), (None, e), (9, "")], key=str)


def test_ids_of_any_type(spark):
    texts = ["one two three four five six"] * 3 + ["something else entirely here now"] + ["one two three four five six"]
    kept = {}
    for kind, ids in (("long", [1, 2, 3, 4, None]), ("string", ["a", "b", "c", "d", None])):
        docs = spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")
        found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
        assert found == {(ids[0], ids[0]), (ids[1], ids[0]), (ids[2], ids[0]), (ids[3], ids[3]), (None, ids[0])}
        kept[kind] = sorted(ids.index(r.doc_id) for r in simhash.deduplicate(docs).collect())
    assert kept["long"] == kept["string"] == [0, 3]
