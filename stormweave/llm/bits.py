"""A bit table over 64-bit keys: a broadcast filter of bounded size that never misses a key."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormweave.llm.scan import per_groups

#: log2 of the bits, least and most: 128 KiB to 32 MiB. Sixteen bits per key while that fits; a fuller table filters
#: less and stays right.
LEAST, MOST = 20, 28
_CHUNK = 19


class BitTable:
    """Bits of the keys' highest bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self._shift = np.uint64(64 - (len(bits).bit_length() + 2))

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> BitTable:
        """The table of a column of a written table. Spark sets the bits; only the finished bytes arrive here."""
        width = min(MOST, max(LEAST, math.ceil(math.log2(max(keys.count(), 1) * 16))))
        place = F.shiftrightunsigned(F.col(column), 64 - width)
        rows = keys.select(F.shiftright(place, _CHUNK).alias("chunk"), place.alias("place"))

        def set_bits(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            chunk, places = batch.column(0).to_numpy(), batch.column(1).to_numpy() & ((1 << _CHUNK) - 1)
            pieces = []
            for start, end in zip(starts, np.append(starts[1:], len(places)), strict=True):
                bits = np.zeros(1 << _CHUNK, np.uint8)
                bits[places[start:end]] = 1
                pieces.append(np.packbits(bits, bitorder="little").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), pa.array(pieces, pa.binary())], ["chunk", "bits"])

        found = per_groups(rows, ["chunk"], set_bits, "chunk long, bits binary").toArrow()
        bits = np.zeros(1 << (width - 3), np.uint8)
        size = 1 << (_CHUNK - 3)
        for chunk, piece in zip(found["chunk"].to_pylist(), found["bits"].to_pylist(), strict=True):
            bits[chunk * size : (chunk + 1) * size] = np.frombuffer(piece, np.uint8)
        return cls(bits)

    def test(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys (uint64) that may be in the table."""
        place = keys >> self._shift
        found = self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)
        return np.flatnonzero(found & 1)

    def share(self, spark: SparkSession) -> Broadcast:
        """A broadcast of the bytes; `BitTable(shared.value)` gives the table back."""
        return spark.sparkContext.broadcast(self.bits)
