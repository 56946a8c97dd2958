"""Which hashes occur often: bit filters of a bounded size, counted in buckets behind a shuffle.

Tasks send the next 24 bits of 64-bit hashes as one binary per bucket, and a bucket's hashes are sorted
and counted in one task. What comes back is a filter's bits, never a table of hashes. A hash that is there often
enough is always in the filter; others are in it now and then, the more, the more hashes it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from gatetally.llm.wordhash import has_bit, packed

#: Bytes of text whose hashes meet in one bucket; there are more buckets for more text.
BUCKET_BYTES = 1 << 24
#: log2 of the least and most buckets, and of the least and most bits of a filter: 32 MB at most.
BUCKETS, BITS = (6, 24), (20, 28)
#: Bytes of a hash that are sent to its bucket.
_REST = 3
#: Hashes that a task gathers before it deals them out.
GATHERED = 1 << 21


class Sizes:
    """How many buckets and bits a corpus of ``n_bytes`` gets, as log2."""

    def __init__(self, n_bytes: int, bytes_per_bit: int):
        self.buckets = min(max((n_bytes // BUCKET_BYTES).bit_length(), BUCKETS[0]), BUCKETS[1])
        self.bits = min(max((n_bytes // bytes_per_bit).bit_length(), BITS[0], self.buckets + 3), BITS[1])


class HashFilter:
    """A filter for tasks to ask; its bits are broadcast once."""

    def __init__(self, bits: Broadcast, log_bits: int):
        self.bits, self.log_bits = bits, log_bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return has_bit(self.bits.value, hashes >> np.uint64(64 - self.log_bits))


class Gathered:
    """Hashes by group, gathered over the blocks of a task, so that what is sent is few rows."""

    def __init__(self) -> None:
        self.groups: dict = {}
        self.size = 0

    def add(self, group, hashes: np.ndarray) -> None:
        self.groups.setdefault(group, []).append(hashes)
        self.size += len(hashes)

    def taken(self, least: int = GATHERED) -> Iterator[tuple[object, np.ndarray]]:
        """Group and hashes of all there is, once it is ``least`` or more."""
        if self.size >= least:
            groups, self.groups, self.size = self.groups, {}, 0
            for group, parts in groups.items():
                yield group, np.concatenate(parts)


def bucketed(hashes: np.ndarray, most: int, sizes: Sizes) -> tuple[pa.Array, pa.Array]:
    """Buckets, and the rests of the hashes in each, in order; each at most ``most`` times."""
    found, n = np.unique(hashes, return_counts=True)
    found = np.repeat(found, np.minimum(n, most))
    buckets = (found >> np.uint64(64 - sizes.buckets)).astype(np.int64)
    rests = (found >> np.uint64(40 - sizes.buckets)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :_REST]
    if not len(found):
        return pa.array([], pa.int64()), pa.array([], pa.binary())
    cuts = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
    parts = [part.tobytes() for part in np.split(rests, cuts)]
    return pa.array(buckets[np.concatenate(([0], cuts))]), pa.array(parts, pa.binary())


def _frequent_bits(sizes: Sizes) -> Callable[[pa.Table], pa.Table]:
    """A bucket's part of the filter: the bits of the hashes that reach the need of their rows in a shard."""

    def run(table: pa.Table) -> pa.Table:
        shards, needs = table.column("shard").to_numpy(), table.column("need").to_numpy()
        places = []
        for shard, need in {*zip(shards.tolist(), needs.tolist(), strict=True)}:
            own = table.column("hashes").filter(pa.array((shards == shard) & (needs == need)))
            rests = np.frombuffer(b"".join(own.to_pylist()), np.uint8).reshape(-1, _REST)
            values = np.zeros((len(rests), 4), np.uint8)
            values[:, :_REST] = rests
            values = values.view("<u4")[:, 0]
            values.sort()
            last = values[need - 1 :]
            places.append(last[last == values[: len(last)]])
        places = np.concatenate(places) >> np.uint32(8 * _REST + sizes.buckets - sizes.bits)
        part = packed(places, 1 << (sizes.bits - sizes.buckets))
        return pa.table([table.column("bucket").slice(0, 1), pa.array([part], pa.binary())], ["bucket", "bits"])

    return run


def filter_of(hashes: DataFrame, sizes: Sizes) -> HashFilter:
    """The filter of a table (bucket, shard, need, hashes): of the hashes that a shard has ``need`` times.

    Need is 1 or more.
    """
    parts = hashes.groupBy("bucket").applyInArrow(_frequent_bits(sizes), "bucket long, bits binary")
    # The bits are bounded, whatever the size of the table.
    whole = np.zeros((1 << sizes.buckets, (1 << (sizes.bits - sizes.buckets)) // 8), np.uint8)
    for batch in parts.toArrow().to_batches():
        for bucket, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            whole[bucket] = np.frombuffer(part.as_buffer(), np.uint8)
    return HashFilter(hashes.sparkSession.sparkContext.broadcast(whole.reshape(-1)), sizes.bits)
