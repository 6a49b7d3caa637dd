"""Every stage of the pipeline against a brute-force version on its own input."""

import hashlib
import re
from collections import Counter

import corpus_pipeline as P
import pytest
from conftest import SF_MID
from test_decontaminate import plain as plain_contamination
from test_mixing import plain_targets
from test_packing import unpacked
from test_simhash import plain_components, plain_fingerprint

from termlink.llm import queries
from termlink.llm.tables import staged, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark):
    """The documents and what each stage made of them."""
    docs = [table(spark, SF_MID, "documents")]
    for name, stage in P.STAGES:
        docs.append(staged(stage(spark, docs[-1], SF_MID), f"test-{name}"))
    return docs


def test_shape(steps):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "packing"]
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes
    counts = [df.count() for df in steps]
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0


def test_quality(spark, steps):
    good = {r.doc_id for r in queries.op6_quality_classifier(spark, SF_MID).where("predicted = 1").collect()}
    assert {r.doc_id for r in steps[1].collect()} == good
    known = {r.doc_id: r.quality for r in table(spark, SF_MID, "labels").collect()}
    lost = [d for d in known if known[d] == 1 and d not in good]
    assert len(lost) <= 0.01 * len(known)


def test_near_duplicates(steps):
    rows = steps[1].collect()
    ids = [r.doc_id for r in rows]
    want = set(plain_components(ids, [plain_fingerprint(r.text) for r in rows], 2))
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(want)


def test_decontamination(spark, steps):
    docs = [(r.doc_id, r.text) for r in steps[2].collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF_MID, "benchmark").collect()]
    want = {r[0] for r in plain_contamination(docs, items, 10) if not r[5]}
    assert {r.doc_id for r in steps[3].collect()} == want and len(want) < len(docs)


def test_mixing(steps):
    docs = steps[3].collect()
    size = {r.doc_id: len(WORD.findall(r.text)) for r in docs}
    whole = {r.doc_id: tuple(r) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    copies = Counter()
    for r in steps[4].collect():
        assert tuple(r) == whole[r.doc_id]
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2
    names = sorted(set(source.values()))
    sizes = [sum(n for d, n in size.items() if source[d] == s) for s in names]
    for s, t in zip(names, plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])):
        took = sum(size[d] * n for d, n in copies.items() if source[d] == s)
        # the nearest cut between whole documents
        assert abs(took - t) <= max(size[d] for d in size if source[d] == s) / 2 + 1


def test_packing(spark, steps):
    rows = steps[5].collect()
    docs = Counter(r.doc_id for r in steps[4].collect())
    segments = Counter()
    for r in rows:
        segments.update(d for d, p in zip(r.doc_ids, r.parts) if p == 0)
    assert segments == docs
    once = steps[4].dropDuplicates(["doc_id"])
    packed = P.packing_stage(spark, once, SF_MID).collect()
    assert unpacked(packed) == {r.doc_id: r.text for r in once.collect()}
    assert sum(r.n_tokens for r in rows) / (2048 * len(rows)) > 0.95


def test_run_agrees_with_the_stages(spark, steps):
    def digest(df):
        return sorted(hashlib.md5(repr((sorted(zip(r.doc_ids, r.parts), key=str), r.n_tokens)).encode()).hexdigest() for r in df.collect())

    assert digest(P.run(spark, SF_MID)) == digest(steps[5])


def test_empty_and_odd_rows(spark):
    empty = table(spark, SF_MID, "documents").limit(0)
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "A plain text. " * 40, "en", "s", 5),
                                 (2, "A plain text. " * 40, "en", "s", 5)], empty.schema)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF_MID).count() == 0
        stage(spark, odd, SF_MID).collect()
