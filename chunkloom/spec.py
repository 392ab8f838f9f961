"""The geometry of a chunked array: shape, chunk shape, block shape and dtype, without Spark."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from itertools import product

from .errors import InvalidIndex, InvalidParam

MAX_DIMS = 16
MAX_CHUNK_BYTES = (1 << 31) - 33
#: Bytes of the items of each dtype, and their Spark types (unsigned ones in the next wider signed type).
ITEM_BYTES = {"i1": 1, "i2": 2, "i4": 4, "i8": 8, "u1": 1, "u2": 2, "u4": 4, "u8": 8, "f4": 4, "f8": 8}
SPARK_TYPES = {"i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "u8": "long", "f4": "float", "f8": "double"}


def row_major(shape: Sequence[int]) -> tuple[int, ...]:
    """Strides, in items, of a C-order array."""
    out, step = [], 1
    for n in reversed(shape):
        out.append(step)
        step *= n
    return tuple(reversed(out))


@dataclass(frozen=True)
class ArraySpec:
    """An n-dimensional array of up to 16 dimensions; zero dimensions hold one item. Missing chunk or block shapes are the next larger ones."""

    shape: tuple[int, ...]
    chunkshape: tuple[int, ...] | None = None
    blockshape: tuple[int, ...] | None = None
    dtype: str = "f8"

    def __post_init__(self):
        shape = tuple(int(x) for x in self.shape)
        chunk = shape if self.chunkshape is None else tuple(int(x) for x in self.chunkshape)
        block = chunk if self.blockshape is None else tuple(int(x) for x in self.blockshape)
        object.__setattr__(self, "shape", shape)
        object.__setattr__(self, "chunkshape", chunk)
        object.__setattr__(self, "blockshape", block)
        if len(shape) > MAX_DIMS or not len(shape) == len(chunk) == len(block):
            raise InvalidParam("between 0 and 16 dimensions, as many in each shape")
        if self.dtype not in ITEM_BYTES:
            raise InvalidParam(f"unknown dtype {self.dtype!r}")
        for n, c, b in zip(shape, chunk, block, strict=True):
            if min(n, c, b) < 0:
                raise InvalidParam("negative length")
            if c and not b or n and not c:
                raise InvalidParam("a zero chunk or block length in a dimension that is not empty")
            if b > c:
                raise InvalidParam("a block longer than its chunk")
        if math.prod(self.extchunkshape) * self.itemsize > MAX_CHUNK_BYTES:
            raise InvalidParam("a chunk of more than 2 GiB")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def itemsize(self) -> int:
        return ITEM_BYTES[self.dtype]

    @property
    def nitems(self) -> int:
        return math.prod(self.shape)

    @property
    def chunk_grid(self) -> tuple[int, ...]:
        return tuple(-(-n // c) if c else 0 for n, c in zip(self.shape, self.chunkshape, strict=True))

    @property
    def block_grid(self) -> tuple[int, ...]:
        return tuple(-(-c // b) if b else 0 for c, b in zip(self.chunkshape, self.blockshape, strict=True))

    @property
    def extshape(self) -> tuple[int, ...]:
        return tuple(g * c for g, c in zip(self.chunk_grid, self.chunkshape, strict=True))

    @property
    def extchunkshape(self) -> tuple[int, ...]:
        return tuple(g * b for g, b in zip(self.block_grid, self.blockshape, strict=True))

    @property
    def nchunks(self) -> int:
        return math.prod(self.chunk_grid)

    @property
    def nblocks(self) -> int:
        """Blocks of a chunk."""
        return math.prod(self.block_grid)

    @property
    def strides(self) -> tuple[int, ...]:
        return row_major(self.shape)

    def check_index(self, index: Sequence[int]) -> None:
        if len(index) != self.ndim or any(not 0 <= i < n for i, n in zip(index, self.shape, strict=False)):
            raise InvalidIndex(f"{tuple(index)} is not in an array of shape {self.shape}")

    def check_slice(self, start: Sequence[int], stop: Sequence[int]) -> None:
        if len(start) != self.ndim or len(stop) != self.ndim or any(not 0 <= a <= b <= n for a, b, n in zip(start, stop, self.shape, strict=False)):
            raise InvalidIndex(f"[{tuple(start)}, {tuple(stop)}) is not in an array of shape {self.shape}")

    def to_multidim(self, flat: int) -> tuple[int, ...]:
        if not 0 <= flat < self.nitems:
            raise InvalidIndex(f"{flat} is not in an array of {self.nitems} items")
        return tuple(flat // s % n for s, n in zip(self.strides, self.shape, strict=True))

    def to_unidim(self, index: Sequence[int]) -> int:
        self.check_index(index)
        return sum(i * s for i, s in zip(index, self.strides, strict=True))

    def address(self, index: Sequence[int]) -> tuple[int, int, int]:
        """(chunk number, block number in the chunk, position in the block) of a cell."""
        self.check_index(index)
        at = lambda coords, grid: sum(x * s for x, s in zip(coords, row_major(grid), strict=True))
        inside = [i % c for i, c in zip(index, self.chunkshape, strict=True)]
        return (
            at([i // c for i, c in zip(index, self.chunkshape, strict=True)], self.chunk_grid),
            at([i // b for i, b in zip(inside, self.blockshape, strict=True)], self.block_grid),
            at([i % b for i, b in zip(inside, self.blockshape, strict=True)], self.blockshape),
        )

    def storage_position(self, index: Sequence[int]) -> int:
        """Position of a cell among the padded cells, chunk after chunk and block after block."""
        nchunk, nblock, offset = self.address(index)
        return nchunk * math.prod(self.extchunkshape) + nblock * math.prod(self.blockshape) + offset

    def chunk_box(self, start: Sequence[int], stop: Sequence[int]) -> tuple[tuple[int, int], ...]:
        """In each dimension the first chunk coordinate a slice touches and the one after the last."""
        self.check_slice(start, stop)
        return tuple((a // c, -(-b // c)) if b > a else (0, 0) for a, b, c in zip(start, stop, self.chunkshape, strict=True))

    def slice_chunks(self, start: Sequence[int], stop: Sequence[int]) -> Iterator[int]:
        """Numbers of the chunks a slice touches, in order."""
        grid = row_major(self.chunk_grid)
        for coords in product(*(range(a, b) for a, b in self.chunk_box(start, stop))):
            yield sum(x * s for x, s in zip(coords, grid, strict=True))

    def with_shape(self, shape: Sequence[int]) -> ArraySpec:
        return replace(self, shape=tuple(shape))

    def rechunked(self, chunkshape: Sequence[int] | None = None, blockshape: Sequence[int] | None = None) -> ArraySpec:
        """Other chunks; without a block shape the old one, cut to the new chunks."""
        chunk = self.chunkshape if chunkshape is None else tuple(chunkshape)
        block = tuple(min(b, c) for b, c in zip(self.blockshape, chunk, strict=True)) if blockshape is None else tuple(blockshape)
        return replace(self, chunkshape=chunk, blockshape=block)

    def to_json(self) -> str:
        return json.dumps({"version": 1, **asdict(self)})

    @classmethod
    def from_json(cls, text: str) -> ArraySpec:
        try:
            raw = json.loads(text)
            return cls(tuple(raw["shape"]), tuple(raw["chunkshape"]), tuple(raw["blockshape"]), raw["dtype"])
        except (TypeError, KeyError, json.JSONDecodeError) as e:
            raise InvalidParam(f"no array description: {e}") from None
