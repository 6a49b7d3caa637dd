"""Jaro-Winkler scorer: fixed values and properties."""

import pytest
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from termlink.functions.jaro import jaro_similarity, jaro_winkler_distance


def naive_jaro(a, b):
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    w = max(0, max(la, lb) // 2 - 1)
    bu, au = [False] * lb, [False] * la
    for i in range(la):
        for j in range(max(0, i - w), min(lb, i + w + 1)):
            if not bu[j] and a[i] == b[j]:
                bu[j] = au[i] = True
                break
    m = sum(au)
    if m == 0:
        return 0.0
    sa = [a[i] for i in range(la) if au[i]]
    sb = [b[j] for j in range(lb) if bu[j]]
    t = sum(x != y for x, y in zip(sa, sb)) / 2
    return (m / la + m / lb + (m - t) / m) / 3


def test_fixed_values():
    assert abs(jaro_similarity(["martha"], ["marhta"])[0] - 0.9444444444444445) < 1e-12
    assert abs(jaro_winkler_distance(["martha"], ["marhta"], 0.1)[0] - 0.038888889) < 1e-9
    # odd number of out-of-order matches: t is a real half
    assert abs(jaro_similarity(["abcxyz"], ["bcaxyz"])[0] - 0.9166666666666666) < 1e-12


words = st.text(alphabet="abcdé ", max_size=14)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_matches_naive_and_symmetric(a, b):
    d_ab = jaro_similarity([a], [b])[0]
    d_ba = jaro_similarity([b], [a])[0]
    assert abs(d_ab - naive_jaro(a, b)) < 1e-12
    assert abs(d_ab - d_ba) < 1e-12


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_zero_distance_iff_equal(a, b):
    d = jaro_winkler_distance([a], [b], 0.1)[0]
    assert (d == 0.0) == (a == b) or (a != b and d > 0)
    if a == b:
        assert d == 0.0


def test_batch_equals_single():
    rng = np.random.default_rng(0)
    a = ["".join(rng.choice(list("abcde"), rng.integers(0, 30))) for _ in range(500)]
    b = ["".join(rng.choice(list("abcde"), rng.integers(0, 30))) for _ in range(500)]
    batch = jaro_winkler_distance(a, b, 0.15)
    single = np.array([jaro_winkler_distance([x], [y], 0.15)[0] for x, y in zip(a, b)])
    assert np.array_equal(batch, single)


def test_long_strings_are_matched_by_bits(monkeypatch):
    """Strings of hundreds of characters don't take the way that is quadratic in the length; both ways agree."""
    import random

    from termlink.functions import jaro
    r = random.Random(3)
    a = ["".join(r.choice("abcde é漢") for _ in range(r.randint(200, 1500))) for _ in range(120)]
    b = [x[::-1] if i % 3 == 0 else "".join(c for c in x if r.random() < 0.95) for i, x in enumerate(a)]
    with monkeypatch.context() as m:
        m.setattr(jaro, "_BIT_CHARS", 0)
        want = jaro.jaro_parts(a, b)
    with monkeypatch.context() as m:
        m.setattr(jaro, "_matched", lambda *x: pytest.fail("quadratic"))
        got = jaro.jaro_parts(a, b)
        m.setattr(jaro, "_BIT_WORDS", 1 << 14)      # in slices
        m.setattr(jaro, "_BIT_LEAST", 1)
        sliced = jaro.jaro_parts(a, b)
    assert all((x == y).all() and (x == z).all() for x, y, z in zip(want, got, sliced))
