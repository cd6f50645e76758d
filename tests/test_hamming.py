"""Hashes within a Hamming distance and components, against plain loops."""

import random

import pytest
from seqcurate.operators import components, hamming


def _roots(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


@pytest.mark.parametrize(("distance", "bucket"), [(0, 256), (1, 2), (2, 3), (3, 256), (3, 4)])
def test_every_close_pair_is_found(spark, distance, bucket):
    """Clouds of alike hashes crowd the buckets; whatever is cut again is still found."""
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(25)}
    values |= {rng.getrandbits(64) for _ in range(40)} | {k << 56 for k in range(40)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(signed(v),) for v in values], "h long")
    close = {(min(map(signed, p)), max(map(signed, p))) for p in ((a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= distance)}
    got = {tuple(r) for r in hamming.links(frame, distance, bucket).collect()}
    assert got <= close
    nodes = [signed(v) for v in values]
    assert _roots(nodes, got) == _roots(nodes, close)
    if bucket == 256:
        assert got == close


def test_groups_and_odd_hashes(spark):
    rows = [("00000000000000ff",)] * 5 + [("00000000000000fe",), ("ffffffffffffffff",), ("fffffffffffffffe",), ("0f0f0f0f0f0f0f0f",), (None,), ("",), ("xyz",), ("00FF",)]
    got = sorted(map(tuple, hamming.near_groups(spark.createDataFrame(rows, "p string"), "p", 1).collect()))
    assert got == [
        ("00000000000000fe", 1, "00000000000000fe"), ("00000000000000ff", 5, "00000000000000fe"), ("0f0f0f0f0f0f0f0f", 1, "0f0f0f0f0f0f0f0f"),
        ("fffffffffffffffe", 1, "fffffffffffffffe"), ("ffffffffffffffff", 1, "fffffffffffffffe"),
    ]
    assert hamming.near_groups(spark.createDataFrame([], "p string"), "p").count() == 0
    with pytest.raises(ValueError):
        hamming.links(spark.createDataFrame([(1,)], "h long"), 64)


def test_components(spark):
    rng = random.Random(1)
    nodes = list(range(300))
    chain = [(k, k + 1) for k in range(0, 120)]
    hub = [(200, k) for k in range(201, 260)]
    linked = chain + hub + [(rng.randrange(260, 300), rng.randrange(260, 300)) for _ in range(25)] + [(5, 4), (7, 7)]
    rng.shuffle(linked)
    want = _roots(nodes, linked)
    got = dict(map(tuple, components.components(spark.createDataFrame([*linked, (None, 3), (4, None)], "a int, b int"), "a", "b").collect()))
    touched = {n for a, b in linked if a != b for n in (a, b)}
    assert got == {n: want[n] for n in touched}
    assert components.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
