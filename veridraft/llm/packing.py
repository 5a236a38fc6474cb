"""Packing token sequences by swap-based local search over kinds of bins.

Only lengths matter for where a piece goes, and there are at most ``capacity`` of them. The
search therefore works on the histogram of lengths and on *kinds* of bins (what lengths a bin
holds, and how many bins hold just that): its size depends on the capacity, not on the
documents. Best-fit decreasing gives the start; then, from the emptiest bins on, pieces move
or are exchanged one for one or two for one between underfull bins whenever that increases
the sum of squared fills, until bins empty or nothing improves. Each step applies to as many
bins as there are of both kinds.

Documents get their places by counting: the k-th piece of a length takes the k-th place for
that length. Counting is spread over ``parts`` groups of each length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veridraft.llm.common import map_batches, table
from veridraft.llm.pretokens import chunked
from veridraft.session import materialise

CAPACITY = 2048
END = 0  # the id put after every document
#: A kind of bin: its lengths, longest first.
Kind = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Kind]:
    """Best-fit decreasing over a histogram of lengths."""
    open_by_room: dict[int, Counter[Kind]] = {capacity: Counter()}
    closed: Counter[Kind] = Counter()
    for length in sorted(counts, reverse=True):
        left = counts[length]
        rooms = sorted(r for r in open_by_room if length <= r < capacity)
        while left:
            room = rooms[0] if rooms else capacity
            each = room // length
            if room == capacity:
                kind, bins = (), -(-left // each)
            else:
                kind, bins = next(iter(open_by_room[room].items()))
            full = min(bins, left // each)
            for k, times in ((each, full), (left - full * each if full < bins else 0, 1)):
                if not k or not times:
                    continue
                new, rest = kind + (length,) * k, room - length * k
                (open_by_room.setdefault(rest, Counter()) if rest else closed)[new] += times
                if room < capacity:
                    open_by_room[room][kind] -= times
                    open_by_room[room] += Counter()  # drops kinds without bins
                left -= k * times
            if room < capacity and not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(0)
    for kinds in open_by_room.values():
        closed.update(kinds)
    return closed


class LocalSearch:
    """Exchanges between underfull bins; every step increases the sum of squared fills.

    The kinds are rows of a table: how many bins, their fill, and their lengths, padded with
    zeros. A step compares what a giver could put out with all takers and their pieces at once.
    """

    def __init__(self, kinds: Counter[Kind], capacity: int):
        self.capacity = capacity
        self.kinds: list[Kind] = []
        self.row: dict[Kind, int] = {}
        self.bins = np.zeros(0, np.int64)
        self.fill = np.zeros(0, np.int64)
        self.pieces = np.zeros((0, 1), np.int64)
        self.full: Counter[Kind] = Counter()
        for kind, n in sorted(kinds.items()):
            self.add(kind, n)

    def add(self, kind: Kind, n: int) -> None:
        if sum(kind) == self.capacity:  # takes part in nothing any more
            self.full[kind] += n
            return
        at = self.row.setdefault(kind, len(self.kinds))
        if at == len(self.kinds):
            self.kinds.append(kind)
            distinct = sorted(set(kind), reverse=True)
            if at == len(self.bins):
                more = max(64, at)
                self.bins = np.append(self.bins, np.zeros(more, np.int64))
                self.fill = np.append(self.fill, np.zeros(more, np.int64))
                self.pieces = np.vstack([self.pieces, np.zeros((more, self.pieces.shape[1]), np.int64)])
            if len(distinct) > self.pieces.shape[1]:
                wider = np.zeros((len(self.pieces), len(distinct) - self.pieces.shape[1]), np.int64)
                self.pieces = np.hstack([self.pieces, wider])
            self.fill[at] = sum(kind)
            self.pieces[at, : len(distinct)] = distinct
        self.bins[at] += n

    def step(self, at: int) -> bool:
        """The exchange that moves most tokens out of a bin of this kind, if there is any.

        A length goes out with nothing, or against one shorter length; so may a pair.
        """
        kind, fill, n = self.kinds[at], int(self.fill[at]), len(self.kinds)
        takes = (self.bins[:n] > 0) & (self.fill[:n] >= fill)
        takes[at] &= self.bins[at] > 1
        rows = np.flatnonzero(takes)
        if not len(rows):
            return False
        rows = rows[np.lexsort((rows == at, -self.fill[rows]))]  # of equal gains the fullest taker
        room = (self.capacity - self.fill[rows])[:, None]
        # column 0: nothing comes back
        back = np.hstack([np.zeros((len(rows), 1), np.int64), self.pieces[rows]])
        real = np.hstack([np.ones((len(rows), 1), bool), self.pieces[rows] > 0])
        outs = {(x,) for x in kind} | {(a, b) for i, a in enumerate(kind) for b in kind[i + 1 :]}
        best, choice = 0, None
        for out in sorted(outs, key=lambda o: (len(o), [-x for x in o])):
            gain = sum(out) - back
            gain = np.where(real & (gain > 0) & (gain <= room), gain, 0)
            if len(out) == 2:
                gain[:, 0] = 0
            spot = int(gain.argmax())
            if gain.flat[spot] > best:
                i, j = divmod(spot, gain.shape[1])
                best, choice = int(gain.flat[spot]), (int(rows[i]), out, () if j == 0 else (int(back[i, j]),))
        if choice is None:
            return False
        taker, out, returned = choice
        times = int(self.bins[at] // 2 if taker == at else min(self.bins[at], self.bins[taker]))
        for one, minus, plus in ((at, out, returned), (taker, returned, out)):
            new = list(self.kinds[one])
            for x in minus:
                new.remove(x)
            self.bins[one] -= times
            if new or plus:
                self.add(tuple(sorted(new + list(plus), reverse=True)), times)
        return True

    def run(self) -> Counter[Kind]:
        """From the emptiest kind on, until the bins are as few as their tokens allow or a
        whole sweep finds no exchange. It ends, as every exchange raises the squared fill."""
        found = lambda: Counter({k: int(b) for k, b in zip(self.kinds, self.bins) if b}) + self.full
        least = -(-sum(sum(k) * n for k, n in found().items()) // self.capacity)
        stuck: set[int] = set()
        moved = False
        while True:
            n = len(self.kinds)
            if int(self.bins[:n].sum()) + self.full.total() <= least:
                break
            order = np.where(self.bins[:n] > 0, self.fill[:n], self.capacity)
            order[list(stuck)] = self.capacity
            at = int(order.argmin())
            if order[at] == self.capacity:
                if not moved:
                    break
                stuck, moved = set(), False  # once more, as others have changed
            elif self.step(at):
                moved = True
            else:
                stuck.add(at)
        return found()


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> Counter[Kind]:
    """Kinds of bins and their numbers for a histogram of lengths."""
    return LocalSearch(best_fit(counts, capacity), capacity).run()


def places(kinds: Counter[Kind]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, per_bin, sequence, offset): pieces of a length, counted from ``first``,
    fill bins from ``sequence`` on, ``per_bin`` in each, from ``offset``."""
    rows, sequence, used = [], 0, Counter()
    for kind, bins in sorted(kinds.items(), reverse=True):
        offset = 0
        for length, per_bin in sorted(Counter(kind).items(), reverse=True):
            rows.append((length, used[length], per_bin, sequence, offset))
            used[length] += per_bin * bins
            offset += per_bin * length
        sequence += bins
    return rows


#: How a byte-level tokenizer cuts a text into pre-tokens (a fixed value).
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with characters whose class may differ between Unicode versions, or with runs that a
#: merge by scanning takes long for, are encoded by the tokenizer's own library.
UNUSUAL = re.compile(r"[^\0-\u024f]|\S{1000}")


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=8)
def merges_by_rank(path: str) -> bool:
    """Whether merging by the ids of the merged tokens gives what the tokenizer's list of merges does.

    It does if ids rise along the list and every token is what its own bytes are merged to: then
    two neighbours that make a token, with no earlier merge left inside, are the listed pair.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in (
        "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"
    )) and spec["normalizer"] is None
    plain &= before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
    plain &= all(t["special"] and not any(t[k] for k in ("lstrip", "rstrip", "single_word", "normalized")) for t in spec["added_tokens"])
    if not plain:
        return False
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if ids != sorted(set(ids)) or ids[:1] == [-1]:
        return False
    rank = {pair: i for i, pair in enumerate(pairs)}

    def merged(token: str) -> list[str]:
        parts = list(token)
        while len(parts) > 1:
            best, at = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if best == len(rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    special = {t["content"] for t in spec["added_tokens"]}
    symbols = byte_symbols()
    tokens = [t for t in model["vocab"] if t not in special]
    return symbols.keys() <= set(tokens) and all(set(t) <= symbols.keys() and len(merged(t)) == 1 for t in tokens)


class Ids:
    """Ids of whole texts. ``by_rank``: as ``merges_by_rank`` says; usual texts then take a shorter way."""

    def __init__(self, path: str, by_rank: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.short = Tokenizer.from_file(path), None
        if by_rank:
            special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            symbols = byte_symbols()
            ranks = {
                bytes(map(symbols.__getitem__, t)): i
                for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special
            }
            self.short = tiktoken.Encoding(path, pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)

    def of(self, text: str) -> np.ndarray:
        if self.short is None or UNUSUAL.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.short.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=2)
def _worker(path: str, by_rank: bool) -> Ids:
    return Ids(path, by_rank)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int, text: str, carried: list[str]) -> DataFrame:
    """One row per piece: ``carried``, piece, start, length, ids_crc32."""
    rows = docs.select(*carried, F.col(text).alias("__text"))
    by_rank = merges_by_rank(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.uint32(END).tobytes()
        for batch, texts in chunked(batches, len(carried)):
            owner, out = [], []
            for i, t in enumerate(texts):
                ids = _worker(path, by_rank).of(t)
                n = len(ids) + 1  # with the end id
                for k, (start, size) in enumerate(cuts(n, capacity)):
                    crc = zlib.crc32(ids[start : start + size])
                    owner.append(i)
                    out.append((k, start, size, zlib.crc32(end, crc) if start + size == n else crc))
            columns = [batch.column(i).take(pa.array(owner, pa.int64())) for i in range(len(carried))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns += [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "piece", "start", "length", "ids_crc32"])

    fields = [(f.name, f.dataType) for f in docs.select(*carried).schema.fields]
    long = T.LongType()
    fields += [("piece", T.IntegerType()), ("start", long), ("length", long), ("ids_crc32", long)]
    return map_batches(rows, run, fields)


def pack_documents(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    text: str = "text",
    columns: list[str] | None = None,
    parts: int = 256,
) -> DataFrame:
    """One row per piece: ``columns`` (default: the id), piece, start, length, ids_crc32,
    sequence_id and offset. Added names replace carried ones.

    ``path`` is a tokenizer file on every worker; a text is encoded as its library does, so the
    string of a special token gives that token. A null or empty text is one piece, the end id;
    a text of any length is encoded whole and cut into pieces. Ids may repeat or be null. No
    rows give no rows. Equal rows are packed one by one; which of them gets which place is open.
    """
    added = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    carried = [c for c in columns or ["doc_id"] if c not in added]
    rows = pieces(docs, path, capacity, text, carried).withColumn("__row", F.monotonically_increasing_id())
    rows = materialise(rows, "packing-pieces")  # also fixes the row numbers
    # A full piece is a sequence of its own; below 0 these don't meet the others' numbers.
    full = rows.where(F.col("length") == capacity).select(
        *carried, *added[:4], (-F.col("__row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = rows.where(F.col("length") < capacity).withColumn("__part", F.pmod(F.xxhash64("__row"), F.lit(parts)))
    counts = materialise(rest.groupBy("length", "__part").count(), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = docs.sparkSession.createDataFrame(
        places(pack(histogram, capacity)),
        "length long, first long, per_bin long, sequence long, at long",
    ).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "per_bin", "sequence", "at"))).alias("places"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("length"), F.col("__part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    ).join(plan, "length")
    ranked = rest.withColumn("__k", F.row_number().over(Window.partitionBy("length", "__part").orderBy("__row")))
    placed = ranked.join(counts, ["length", "__part"]).withColumn("__k", F.col("before") + F.col("__k") - 1)
    spot = F.element_at(F.filter("places", lambda p: p["first"] <= F.col("__k")), -1)
    placed = placed.withColumn("__spot", spot).withColumn("__k", F.col("__k") - F.col("__spot.first"))
    return full.unionByName(placed.select(
        *carried,
        *added[:4],
        (F.col("__spot.sequence") + F.floor(F.col("__k") / F.col("__spot.per_bin"))).alias("sequence_id"),
        (F.col("__spot.at") + F.col("__k") % F.col("__spot.per_bin") * F.col("length")).alias("offset"),
    ))


def op5_packing(spark, folder: str) -> DataFrame:
    import public_tokenizers as public

    return pack_documents(table(spark, folder, "documents"), public.path("byte_bpe_50k.json"))
