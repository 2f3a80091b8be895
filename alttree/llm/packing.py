"""Best-fit packing of token sequences, improved by a swap-based local search.

Every text's ids get the end id; only texts longer than a sequence are cut, into full pieces and a rest. Pieces are
dealt to groups of bounded size by a hash. In a group they are placed longest first, each into the fullest sequence it
still fits. Then documents of underfull sequences, emptiest first, are moved into, or exchanged one-for-one or
two-for-one with documents of, any other underfull sequence whenever this raises the sum of squared fills, until nothing
helps any more. Underfull sequences are looked up by what they can take, so neither donors nor targets are limited. Only lengths are packed; each group leaves an underfull sequence or two at most where lengths allow.

Null texts count as empty: their piece is the end id alone. Each row is packed for itself, repeated rows too; other
columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alttree.llm import bpe
from alttree.llm.tables import read


@dataclass(frozen=True)
class Params:
    size: int = 2048
    end_id: int = 0
    group: int = 20_000


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of piece numbers; longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[b].append(int(k))
        else:
            room, b = size, len(bins)
            bins.append([int(k)])
        by_room[room - n].append(b)
        if room > n:
            open_rooms |= 1 << (room - n)
    return bins


class _Room:
    """Underfull bins by what they can take: (capacity, m) -> bins with a piece of length m and room capacity - m; m is 0 for a move."""

    def __init__(self, size: int):
        self.bins: dict[tuple[int, int], dict[int, None]] = {}
        self.returned = [0] * (size + 1)  # per capacity: bit m
        self.capacities = 0

    def add(self, b: int, room: int, pieces: set[int]) -> None:
        for m in pieces:
            self.bins.setdefault((m + room, m), {})[b] = None
            self.returned[m + room] |= 1 << m
            self.capacities |= 1 << (m + room)

    def drop(self, b: int, room: int, pieces: set[int]) -> None:
        for m in pieces:
            same = self.bins[m + room, m]
            del same[b]
            if not same:
                del self.bins[m + room, m]
                self.returned[m + room] &= ~(1 << m)
                if not self.returned[m + room]:
                    self.capacities &= ~(1 << (m + room))

    def best(self, n: int, most: int) -> tuple[int, int] | None:
        """(capacity, m) of the bin with at most `most` room that n fills best, m coming back; of equals the one that gains most."""
        rest, smaller = self.capacities >> n << n, (1 << n) - 1
        while rest:
            capacity = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            least = max(0, capacity - most)
            fits = (self.returned[capacity] & smaller) >> least
            if fits:
                return capacity, least + (fits & -fits).bit_length() - 1
        return None


def improve(bins: list[list[int]], lengths: np.ndarray, size: int, effort: int | None = None) -> list[list[int]]:
    """Local search over the underfull bins until no exchange of any two raises the squared fills; returns the bins that are not empty.

    `effort` bounds nothing any more.
    """
    length = [int(n) for n in lengths]
    fill = [sum(length[k] for k in b) for b in bins]
    index = _Room(size)

    def pieces(b: int) -> set[int]:
        return {0, *(length[k] for k in bins[b])}

    for b in range(len(bins)):
        if bins[b] and fill[b] < size:
            index.add(b, size - fill[b], pieces(b))
    changed = True
    while changed:
        changed = False
        for donor in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < size), key=lambda b: fill[b]):
            if fill[donor] == size:  # filled since
                continue
            index.drop(donor, size - fill[donor], pieces(donor))
            while bins[donor] and (found := _exchange(bins[donor], length, size - fill[donor], index)):
                out, capacity, m = found
                target = next(iter(index.bins[capacity, m]))
                index.drop(target, capacity - m, pieces(target))
                back = [next(k for k in bins[target] if length[k] == m)] if m else []
                for give, take, moved in ((donor, target, out), (target, donor, back)):
                    for k in moved:
                        bins[give].remove(k)
                        bins[take].append(k)
                gain = sum(length[k] for k in out) - m
                fill[target] += gain
                fill[donor] -= gain
                if fill[target] < size:
                    index.add(target, size - fill[target], pieces(target))
                changed = True
            if bins[donor]:
                index.add(donor, size - fill[donor], pieces(donor))
    return [b for b in bins if b]


def _exchange(give: list[int], length: list[int], room: int, index: _Room) -> tuple[tuple[int, ...], int, int] | None:
    """The move, one-for-one or two-for-one exchange that leaves least room in the target, a bin at least as full: squares grow.

    Returns the pieces to give, and the target's place in the index.
    """
    of: dict[int, list[int]] = {}
    for k in give:
        of.setdefault(length[k], []).append(k)
    sets = {a + b: (of[a][0], of[b][a == b]) for a in of for b in of if a < b or a == b and len(of[a]) > 1}
    sets |= {n: (ks[0],) for n, ks in of.items()}
    best, least = None, None
    for n in sorted((n for n in sets if n), reverse=True):
        at = index.best(n, room)
        if at and (least is None or at[0] - n < least):
            best, least = (sets[n], *at), at[0] - n
            if not least:
                break
    return best


def pack_group(lengths: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    bins = improve(best_fit(lengths, p.size), lengths, p.size)
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, members in enumerate(bins):
        sizes = lengths[members]
        place[members] = b
        offset[members] = np.cumsum(sizes) - sizes
    return place, offset


def pieces(docs: DataFrame, p: Params = Params(), path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row. Written once."""
    end = np.array([p.end_id], "<u4").tobytes()

    def cut(enc: bpe.Encoder, rows: list[bytes]) -> list[pa.Array]:
        out = []
        for ids in rows:
            data = ids + end
            out.append([{"length": len(part) // 4, "crc": zlib.crc32(part)}
                        for part in (data[at:at + 4 * p.size] for at in range(0, len(data), 4 * p.size))])
        return [pa.array(out, pa.list_(pa.struct([("length", pa.int64()), ("crc", pa.int64())])))]

    coded = bpe.encode(docs, path, finish=cut, finished="pieces array<struct<length: bigint, crc: bigint>>")
    each = coded.select("doc_id", F.posexplode("pieces").alias("piece", "p"))
    return each.select(
        "doc_id", "piece", (F.col("piece").cast("long") * p.size).alias("start"), F.col("p.length").alias("length"),
        F.col("p.crc").alias("ids_crc32"))


def pack(parts: DataFrame, p: Params = Params()) -> DataFrame:
    """parts with sequence_id and offset. parts: doc_id, piece, length and more; its rows must be the same when reread."""
    groups = max(1, -(-parts.count() // p.group))
    key = F.xxhash64("doc_id", "piece")

    def group(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["_key", "length"], kind="stable")
        place, offset = pack_group(f["length"].to_numpy(), p)
        return f.assign(sequence_id=f["_group"].iloc[0] * (1 << 32) + place, offset=offset).drop(columns=["_key", "_group"])

    dealt = parts.withColumn("_key", key).withColumn("_group", F.pmod(key, F.lit(groups)))
    schema = ", ".join(f"{c} {t}" for c, t in [*parts.dtypes, ("sequence_id", "long"), ("offset", "long")])
    return dealt.groupBy("_group").applyInPandas(group, schema)


def pack_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    return pack(pieces(docs, p), p)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
