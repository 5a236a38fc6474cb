"""Byte-level BPE with a rank queue of hierarchical bitmaps.

The queue holds, for every merge rank, the places where that merge could be made. Three levels
of 64-bit words say which ranks have places; find-first-set from the top gives the next rank
in three steps. The places are those of a linked list over the bytes of all pre-tokens that
are new in a chunk of texts, so one step merges a rank's places wherever they are. Merging a
pair makes its neighbours' entries stale; they are skipped when their turn comes.

A few ranks can open a lower one, which then goes first. Of such a rank a step merges, in each
pre-token, the places up to the first one that does; the others wait in order and are not
looked at again before their turn. A pre-token of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridraft.llm.common import map_batches, table
from veridraft.llm.pretokens import Memory, chunked


class RankQueue:
    """Places by rank, as lists of arrays; ``first`` is the smallest rank that has any, or -1."""

    def __init__(self, ranks: int):
        self.places: list[list[np.ndarray] | None] = [None] * ranks
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, places: np.ndarray) -> None:
        at = self.places[rank]
        if at is not None:
            at.append(places)
            return
        self.places[rank] = [places]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def push_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Places of several ranks."""
        order = ranks.argsort(kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, some in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts)):
            self.push(rank, some)

    def first(self) -> int:
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        return a << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> np.ndarray:
        """All places of a rank in order, which leave the queue."""
        found, self.places[rank] = self.places[rank], None
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        places = found[0] if len(found) == 1 else np.concatenate(found)
        return np.sort(places)


class Waiting:
    """Places of one rank in pre-tokens that have several, taken from the left.

    An entry of a pre-token is a sorted array, how far it was read, a heap of places that came
    later, and how many places the next step may try: twice as many as long as all goes well.
    """

    def __init__(self) -> None:
        self.entries: dict[int, list] = {}

    def put(self, places: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Add sorted places; those alone in their pre-token are returned, as they need not wait."""
        own = piece[places]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(places) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(places)))
        alone = sizes == 1
        if self.entries:
            alone &= ~np.isin(own[starts], np.fromiter(self.entries, np.int64, len(self.entries)))
        for start, size in zip(starts[~alone].tolist(), sizes[~alone].tolist()):
            part = places[start : start + size]
            entry = self.entries.setdefault(int(own[start]), [part, 0, [], 1])
            if entry[0] is not part:
                for place in part.tolist():
                    heapq.heappush(entry[2], place)
        return places[starts[alone]]

    def take(self, fits) -> list[np.ndarray]:
        """The next places of every pre-token for which ``fits`` still holds, in order."""
        found = []
        for k, entry in list(self.entries.items()):
            some = np.zeros(0, np.int64)
            while not len(some) and (entry[1] < len(entry[0]) or entry[2]):
                array, at, heap, ahead = entry
                if heap:
                    some = []
                    while len(some) < ahead and (heap or entry[1] < len(array)):
                        if entry[1] == len(array) or heap and heap[0] < array[entry[1]]:
                            some.append(heapq.heappop(heap))
                        else:
                            some.append(int(array[entry[1]]))
                            entry[1] += 1
                    some = np.array(some, np.int64)
                else:
                    some = array[at : at + ahead]
                    entry[1] += len(some)
                some = some[fits(some)]
            if len(some):
                found.append(some)
            else:
                del self.entries[k]
        return found

    def settle(self, back: np.ndarray, piece: np.ndarray) -> None:
        """After a step: ``back`` are places that have to wait on."""
        again = piece[back]
        for place, k in zip(back.tolist(), again.tolist()):
            heapq.heappush(self.entries[k][2], place)
        held = set(again.tolist())
        for k, entry in list(self.entries.items()):
            entry[3] = 1 if k in held else min(2 * entry[3], 1 << 20)
            if entry[1] == len(entry[0]) and not entry[2]:
                del self.entries[k]


class BytePairs:
    """Encodes and decodes by the ranks of byte strings; a rank is the token's id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pair = np.full((256, 256), -1, np.int64)
        #: All ways to write a token as two tokens: key (left, right), sorted, and its rank.
        keys, values = [], []
        #: Ranks whose merge can open a lower rank.
        self.opens = np.zeros(self.size, bool)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
                    self.opens[left] |= rank < left
                    self.opens[right] |= rank < right
            if len(token) == 2:
                self.byte_pair[token[0], token[1]] = rank
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(values, np.int64)[order], -1)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens, -1 where they don't make a token."""
        key = left * self.size + right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of every pre-token: always the lowest rank first, the leftmost of equal ranks."""
        ids: list = [self.ranks.get(p) for p in pieces]
        open_ = [k for k, i in enumerate(ids) if i is None and pieces[k]]
        for k, part in zip(open_, self._merge([pieces[k] for k in open_]) if open_ else []):
            ids[k] = part
        return [i if isinstance(i, list) else [] if i is None else [i] for i in ids]

    def _merge(self, pieces: list[bytes]) -> list[list[int]]:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, queue = len(data), RankQueue(self.size)
        stops = np.cumsum([len(p) for p in pieces])
        piece = np.repeat(np.arange(len(pieces)), np.diff(stops, prepend=0))
        # A linked list over the bytes: a token starts at i and ends where the next one starts.
        token = self.byte[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.full(n, -1, np.int64)  # the rank of the token at i merged with the next one
        pair[:-1] = self.byte_pair[data[:-1], data[1:]]
        pair[stops - 1] = -1
        before[np.append(0, stops[:-1])] = -1
        stop = stops[piece]
        alive = np.ones(n, bool)
        start = np.flatnonzero(pair >= 0)
        if len(start):
            queue.push_all(pair[start], start)
        waiting: dict[int, Waiting] = {}
        while (rank := queue.first()) >= 0:
            places = queue.take(rank)
            places = places[pair[places] == rank]  # the others are stale
            if self.opens[rank]:
                wait = waiting.pop(rank, None)
                if wait or len(places) > 1 and not (piece[places[1:]] != piece[places[:-1]]).all():
                    wait = wait or Waiting()
                    alone = wait.put(places, piece)
                    some = wait.take(lambda x: pair[x] == rank)
                    places = np.sort(np.concatenate([alone, *some]))
                    kept = places[self._up_to_lower(rank, places, token, after, before, stop, piece)]
                    last = np.zeros(len(pieces), np.int64) - 1
                    last[piece[kept]] = kept  # the last one kept in each pre-token
                    wait.settle(places[places > last[piece[places]]], piece)
                    places = kept
                    if wait.entries:
                        waiting[rank] = wait
                        queue.push(rank, places[:0])
            else:
                places = self._every_other(places, after)
            if not len(places):
                continue
            gone = after[places]
            end = after[gone]
            after[places] = end
            token[places] = rank
            pair[gone] = -1
            pair[places] = -1
            alive[gone] = False
            inner = end < stop[places]
            before[end[inner]] = places[inner]
            back = before[places]
            left = np.concatenate((places[inner], back[back >= 0]))
            if not len(left):
                continue
            # A left neighbour that was merged in this step as well is listed once.
            left = np.unique(left)
            new = self.merged(token[left], token[after[left]])
            pair[left] = new
            found = new >= 0
            if found.any():
                queue.push_all(new[found], left[found])
        ids, owner = token[alive], piece[alive]
        cuts = np.searchsorted(owner, np.arange(1, len(pieces)))
        return [part.tolist() for part in np.split(ids, cuts)]

    @staticmethod
    def _every_other(places: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of places that share a token every other one, from the left."""
        chained = after[places[:-1]] == places[1:]
        if len(places) < 2 or not chained.any():
            return places
        k = np.arange(len(places))
        head = np.append(True, ~chained)
        return places[(k - np.maximum.accumulate(np.where(head, k, 0))) % 2 == 0]

    def _up_to_lower(self, rank, places, token, after, before, stop, piece) -> np.ndarray:
        """Which places are merged now: in each pre-token those up to the first whose merge, with all
        earlier ones made and no later one, leaves a neighbour that makes a lower rank."""
        kept = self._every_other(places, after)
        gone = after[kept]
        end, back = after[gone], before[kept]
        right = np.where(end < stop[kept], token[np.minimum(end, len(token) - 1)], -1)
        joined = np.append(False, end[:-1] == kept[1:])  # the one before it was merged just now
        left = np.where(joined, rank, np.where(back >= 0, token[back], -1))
        lower = np.zeros(len(kept), bool)
        for new, there in ((self.merged(np.full(len(kept), rank), right), right), (self.merged(left, np.full(len(kept), rank)), left)):
            lower |= (there >= 0) & (new >= 0) & (new < rank)
        own = piece[kept]
        first = np.append(True, own[1:] != own[:-1])
        earlier = np.cumsum(lower) - lower  # lower ones before it, in all pre-tokens
        start = np.maximum.accumulate(np.where(first, np.arange(len(kept)), 0))
        return np.isin(places, kept[earlier == earlier[start]], assume_unique=True)

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str) -> Memory:
    """What a Python worker keeps between chunks: (decimal ids, number of ids, decoded bytes)."""
    import regex

    pairs, cut = BytePairs(read_ranks(path)), regex.compile(pattern)
    decimal = {i: str(i) for i in pairs.bytes_of}

    def values(new: list[str]) -> list[tuple[str, int, bytes]]:
        found = [cut.findall(x) for x in new]
        pieces = list(set(chain.from_iterable(found)))
        ids = pairs.encode_pieces([p.encode() for p in pieces])
        known = {
            p: (",".join([decimal[i] for i in row]), len(row), pairs.decode(row)) for p, row in zip(pieces, ids)
        }
        out = []
        for parts in found:
            if len(parts) == 1:
                out.append(known[parts[0]])
            else:
                texts, counts, decoded = zip(*[known[p] for p in parts])
                out.append((",".join(texts), sum(counts), b"".join(decoded)))
        return out

    return Memory(values)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, text: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """Token counts and digests of every whole text: n_tokens, ids_sha256, decoded_sha256.

    ``path`` is a rank file on every worker, ``pattern`` what cuts a text into pre-tokens.
    ``columns`` (default: the id) pass through; added names replace carried ones. A null or
    empty text has no tokens. No special tokens are used: their strings are ordinary text. Texts
    and pre-tokens of any length are encoded whole. Repeated rows are rows of their own; no
    rows give no rows.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"]
    carried = [c for c in columns or ["doc_id"] if c not in added]
    rows = docs.select(*carried, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunked(batches, len(carried)):
            counts, ids, decoded = [], [], []
            for values in _worker(path, pattern).of(texts):
                counts.append(sum([v[1] for v in values]))
                ids.append(hashlib.sha256(",".join([v[0] for v in values]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([v[2] for v in values])).hexdigest())
            columns = [batch.column(i) for i in range(len(carried))]
            columns += [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, carried + added)

    fields = [(f.name, f.dataType) for f in docs.select(*carried).schema.fields]
    return map_batches(rows, run, fields + list(zip(added, [T.LongType(), T.StringType(), T.StringType()])))


def op2_byte_pairs(spark, folder: str) -> DataFrame:
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, folder, "documents"), path, public.PATTERN)
