import math
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.errors import InvalidIndex, InvalidParam
from chunkloom.spec import ArraySpec

@st.composite
def geometries(draw):
    """Shape, chunk and block of up to five dimensions; lengths of zero, and chunks longer than the shape, too."""
    dims = draw(st.lists(st.tuples(st.integers(0, 37), st.integers(1, 23), st.integers(1, 11)), min_size=1, max_size=5))
    return tuple(n for n, _, _ in dims), tuple(c for _, c, _ in dims), tuple(min(b, c) for _, c, b in dims)


@settings(max_examples=120, deadline=None)
@given(geometries())
def test_geometry(drawn):
    shape, chunk, block = drawn
    s = ArraySpec(shape, chunk, block)
    assert s.nitems == math.prod(shape)
    assert all(e >= n and (not c or e % c == 0) for e, n, c in zip(s.extshape, shape, chunk))
    assert all(e >= c and (not b or e % b == 0) for e, c, b in zip(s.extchunkshape, chunk, block))
    assert ArraySpec.from_json(s.to_json()) == s
    if s.nitems:
        for flat in {0, s.nitems // 3, s.nitems - 1}:
            index = s.to_multidim(flat)
            assert index == tuple(int(i) for i in np.unravel_index(flat, shape))
            assert s.to_unidim(index) == flat


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 5), st.integers(1, 5)), min_size=1, max_size=3))
def test_storage_positions_are_unique_and_inside(dims):
    shape = tuple(n for n, _, _ in dims)
    chunk = tuple(c for _, c, _ in dims)
    block = tuple(min(b, c) for _, c, b in dims)
    s = ArraySpec(shape, chunk, block)
    seen = {s.storage_position(i) for i in product(*map(range, shape))}
    assert len(seen) == s.nitems
    assert max(seen) < s.nchunks * math.prod(s.extchunkshape)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_slice_chunks(data):
    shape = tuple(data.draw(st.lists(st.integers(1, 12), min_size=1, max_size=3)))
    chunk = tuple(data.draw(st.integers(1, 6)) for _ in shape)
    start = tuple(data.draw(st.integers(0, n)) for n in shape)
    stop = tuple(data.draw(st.integers(a, n)) for a, n in zip(start, shape))
    s = ArraySpec(shape, chunk)
    touched = sorted({s.address(i)[0] for i in product(*(range(a, b) for a, b in zip(start, stop)))})
    assert list(s.slice_chunks(start, stop)) == touched


def test_refusals():
    for bad in (dict(shape=(3,), chunkshape=(0,)), dict(shape=(3,), chunkshape=(2,), blockshape=(3,)), dict(shape=(-1,)), dict(shape=(1,) * 17), dict(shape=(3,), dtype="x9"), dict(shape=(4,), chunkshape=(2, 2)), dict(shape=(1 << 40,))):
        with pytest.raises(InvalidParam):
            ArraySpec(**bad)
    for bad in ("", "{}", "[1]", '{"shape": [2], "chunkshape": [0], "blockshape": [0], "dtype": "i4"}'):
        with pytest.raises(InvalidParam):
            ArraySpec.from_json(bad)
    s = ArraySpec((4, 5))
    with pytest.raises(InvalidIndex):
        s.to_multidim(20)
    with pytest.raises(InvalidIndex):
        s.to_unidim((4, 0))
    with pytest.raises(InvalidIndex):
        s.check_slice((0, 0), (5, 5))


def test_no_dimensions():
    s = ArraySpec(())
    assert (s.nitems, s.nchunks, s.to_multidim(0), s.to_unidim(())) == (1, 1, (), 0)
