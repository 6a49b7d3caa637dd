import hashlib
import re

import pytest
from conftest import SF_SMALL
from made_words import words

from termlink.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(docs, items, window):
    """Every window of every item looked up in every document."""
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for a in range(max(1, len(w) - window + 1)) if w else []:
            windows.setdefault(tuple(w[a: a + window]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if tuple(w[a: a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a: a + n])]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc, len(w), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


@pytest.mark.parametrize("gram, bits", [(7, 26), (10, 15), (3, 20)])
def test_given_tables(spark, gram, bits):
    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontaminate.contamination(docs, bench, window=10, gram=gram, filter_bits=bits)
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], 10)
    assert rows_of(got) == want
    assert any(r[5] for r in want)


def test_short_items_edges_and_shifted_windows(spark):
    w = words("x", 40)
    items = [(1, " ".join(w[:20])), (2, " ".join(w[20:27])), (3, w[30]), (3, w[31]), (None, " ".join(w[32:36])), (4, ""), (5, None),
             (6, " ".join(w[:20])), (7, "É à ß " + w[0])]
    docs = [(i, " ".join(w[i: i + n])) for i in range(0, 30, 3) for n in (1, 4, 9, 10, 11, 25)]
    docs += [(100, None), (101, ""), (None, " ".join(w[:12])), (102, "A-" + " ".join(w[2:14]).upper() + "!"), (102, "x"),
             (103, (w[30] + " ") * 6000), (104, "é À ß " + w[0]), (105, "É à ß " + w[0]), (106, " ".join(w[5:15] * 300))]
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"), window=10)
    assert rows_of(got) == plain(docs, items, 10)


def test_clashing_columns_empty_tables_and_clean(spark):
    w = " ".join(words("y", 15))
    docs = spark.createDataFrame([(1, w, 1, "q"), (2, "nothing here", 2, "q"), (None, "x", 3, "q")],
                                 "doc_id long, text string, row long, item_id string")
    bench = spark.createDataFrame([(9, w, "z")], "item_id long, text string, doc_id string")
    kept = decontaminate.clean(docs, bench, window=10)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, None}
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_clean_drops_rows_not_ids(spark):
    item = " ".join(f"word{i}" for i in range(14))
    rows = [(None, f"see {item} here"), (None, "a clean text"), (7, f"again {item}"), (7, "another clean text"), (7, None), (8, ""), (8, item), (8, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.clean(docs, items, window=10).collect()), key=str)
    assert got == sorted([r for r in rows if "word1" not in (r[1] or "")], key=str)
