import random
from collections import Counter, defaultdict
import re

import numpy as np
import pytest

from termlink.llm import divergence


def brute(rows, min_docs=3, top=200):
    """The definition, with Python's whole numbers, over every kept term of every group."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    seen, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        seen[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang in {g[0] for g in count}:
        kept = [t for t in seen[lang] if seen[lang][t] >= min_docs]
        groups = {g[1]: count[g] for g in count if g[0] == lang}

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (total + len(kept)) for t in kept}
        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))

        def f(a, b):
            return (a - b) ** 2 // b
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def made(seed, n, vocabulary=40, sources=7):
    r = random.Random(seed)
    words = ["the", "The", "é", "Éa", "naïve", "日本", "x1y", "foo-bar"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(vocabulary)]
    return [(r.choice(["en", "de", None]), f"s{min(r.randrange(sources), r.randrange(sources))}",
             " ".join(r.choice(words[: r.randrange(1, len(words))]) for _ in range(r.randrange(30)))) for _ in range(n)]


def result(spark, rows, schema="lang string, source string, text string", **options):
    found = divergence.audit(spark.createDataFrame(rows, schema).repartition(3), **options)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed, rows", [(1, 40), (2, 300)])
def test_equals_the_definition(spark, seed, rows, monkeypatch):
    rows = made(seed, rows)
    want = brute(rows)
    assert result(spark, rows) == want
    # many small slices and blocks
    for name, value in (("_COUNTS", 2), ("_PEERS", 2)):
        monkeypatch.setattr(divergence, name, value)
    assert result(spark, rows, slice_rows=5) == want
    assert result(spark, rows, min_docs=1, top=4) == brute(rows, 1, 4)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, None, None), ("en", None, "a a a"), ("en", "s", ""), ("en", "t", "a B"), ("en", "t", "a B"),
            ("xx", "only", "a a a"), ("yy", "p", "rare"), ("yy", "q", "other"), ("en", "long", "word " * 300_000 + "a" * 3000),
            ("en", "huge", "9" * 10 + " A " * 5)]
    assert result(spark, rows) == brute(rows)
    wide = [(*r, 1, "clash") for r in rows]
    assert result(spark, wide, "lang string, source string, text string, n int, term string") == brute(rows)
    assert result(spark, rows[:0]) == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 3)
    raw = "aé bcd  éééééé e f ggggggg".encode()
    parts = list(divergence.pieces(raw))
    assert b"".join(parts) == raw and len(parts) > 3
    assert [t for p in parts for t in divergence._TERM.findall(p)] == divergence._TERM.findall(raw)


def test_row_products_in_small_scatters(monkeypatch):
    r = np.random.default_rng(1)
    group = np.concatenate([np.sort(r.choice(6, r.integers(1, 7), replace=False)) for _ in range(30)])
    ptr = np.concatenate([[0], np.flatnonzero(np.diff(group) <= 0) + 1, [len(group)]])
    p, absent = r.integers(1, 10 ** 9, len(group)), r.integers(1, 1000, 6)
    whole = [row.tolist() for _, row in divergence.row_products(group, p, absent, ptr)]
    monkeypatch.setattr(divergence, "_SCATTER", 3)
    assert [row.tolist() for _, row in divergence.row_products(group, p, absent, ptr)] == whole


def test_shares_beyond_64_bits():
    for count, total in ((1, 1), (1, 3), (7 * 10 ** 14, 9 * 10 ** 15), (8_999_999_999_999_999, 9 * 10 ** 15), (9 * 10 ** 15, 9 * 10 ** 15)):
        assert divergence.share(np.int64(count), np.array([total]))[0] == 1 + 10 ** 9 * count // total


def test_one_term_in_every_row(spark):
    rows = [("en", f"s{i % 50}", f"stop stop w{chr(97 + i % 20)}") for i in range(2000)]
    assert result(spark, rows) == brute(rows)
