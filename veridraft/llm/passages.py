"""Repeated passages, found by prefix-free parsing.

Rolling hashes over 20 bytes are the triggers: every window of 100 bytes selects the smallest
one in it, so equal windows select equal triggers at the same place in them. A phrase is the
longest stretch of windows that select one trigger, and overlaps the next phrase by 99 bytes;
every window lies in exactly one phrase.

* The *parse* is the phrases of all documents in corpus order. All windows of a phrase that
  occurred before are repeats, so repetitive text is handled phrase by phrase.
* The *dictionary* is the phrases at their first place. Windows in two different phrases can
  only be equal if the phrases share a trigger; for those phrases alone the dictionary's
  suffixes are sorted. A window is a suffix cut at 100 bytes, which is as deep as the order
  matters: suffixes with the same first 100 bytes meet, in corpus order. Suffixes are first
  taken 21 at a time: neighbours share a core of 80 bytes, and only where two blocks have one
  core but are not equal are their suffixes sorted one by one.

Each step is one sort by key, read as a stream. Before it every chunk of documents keeps
only the first place of each key, and settles the others itself, so a passage that all
documents share reaches the sort once per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridraft.llm.common import map_batches, table
from veridraft.session import materialise

LENGTH = 100
TRIGGER = 20
#: Bytes of text parsed at a time; longer documents are a chunk of their own.
CHUNK_BYTES = 3 << 20
#: Stands for a null id: it sorts before all others.
NO_ID = -(1 << 63)

LONG = T.LongType()
#: k1: what two places must share to hold equal windows; k2: equal if all their windows are.
#: ``n`` windows of ``doc`` from ``at`` on; ``lead``: from there to the trigger.
SPANS = [(c, LONG) for c in ("kind", "k1", "k2", "doc", "at", "n", "lead")]
#: Suffixes of a phrase that are taken together.
TOGETHER = 21
#: Kinds of rows: a stretch of repeated windows, or a first place that must be looked at.
REPEAT, FIRST = 0, 1
ADDED = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def rolling(data: np.ndarray) -> np.ndarray:
    """Hashes of all stretches of TRIGGER = 16 + 4 bytes: polynomial, by doubling, then mixed."""
    base = 0x100000001B3
    h, width, four = data.astype(np.uint64) + np.uint64(1), 1, None
    while width < 16:
        factor = np.uint64(pow(base, width, 1 << 64))
        h = h[:-width] * factor + h[width:]
        width *= 2
        four = h if width == 4 else four
    n = len(data) - TRIGGER + 1
    return _mixed(h[:n] * np.uint64(pow(base, 4, 1 << 64)) + four[16 : 16 + n])


def selected(h: np.ndarray) -> np.ndarray:
    """For every window the place of its trigger: the smallest upper half, leftmost of equals."""
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, width = LENGTH - TRIGGER + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, number of windows, trigger hashes, distance to the trigger) of all phrases of
    the concatenated documents."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    h = rolling(np.frombuffer(data, np.uint8))
    place = selected(h)
    total = len(data) - LENGTH + 1  # windows, also those across documents
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    first, stop = offsets[long], offsets[long + 1] - LENGTH + 1
    cut = np.empty(total, bool)
    cut[0] = True
    cut[1:] = place[1:] != place[:-1]
    cut[first] = True
    inside = np.zeros(total + 1, np.int32)
    np.add.at(inside, first, 1)
    np.add.at(inside, stop, -1)
    starts = np.flatnonzero(cut & (np.cumsum(inside[:-1]) > 0))
    owner = np.searchsorted(first, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], total), stop[owner]) if len(starts) else starts
    return starts, ends - starts, h[place[starts]].view(np.int64), place[starts] - starts


def settle(k1, k2, doc, at, n):
    """Split the places of a chunk, given in corpus order.

    Returns the index of the first place of each key, and repeated stretches as
    (doc, at, n); stretches that follow one another are joined.
    """
    order = np.lexsort((k2, k1))  # stable: corpus order within a key
    new = np.ones(len(order), bool)
    new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = np.zeros(len(order), bool)
    again[order] = ~new & ((doc[order] != doc[first]) | (at[order] != at[first]))
    spot = np.flatnonzero(again)
    joins = np.zeros(len(spot), bool)
    if len(spot):
        before = spot[:-1]
        joins[1:] = (doc[spot[1:]] == doc[before]) & (at[before] + n[before] == at[spot[1:]])
    heads = np.flatnonzero(~joins)
    sums = np.add.reduceat(n[spot], heads) if len(heads) else n[spot]
    return np.sort(order[new]), (doc[spot[heads]], at[spot[heads]], sums)


def _batch(fields, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f for f, _ in fields])


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys for rows that only pass through the sort: spread by place."""
    return _mixed((doc * 1_000_003 + at).view(np.uint64)).view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]):
    """Chunks of whole documents in corpus order: (ids, texts as bytes, other columns)."""
    ids, texts, more, size = [], [], [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if size and size + len(row[1]) > CHUNK_BYTES:
                yield _ordered(ids, texts, more)
                ids, texts, more, size = [], [], [], 0
            ids.append(NO_ID if row[0] is None else row[0])
            texts.append(row[1])
            more.append(row[2:])
            size += len(row[1])
    if ids:
        yield _ordered(ids, texts, more)


def _ordered(ids, texts, more):
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    return [ids[i] for i in order], [texts[i] for i in order], [more[i] for i in order]


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> places of phrases (FIRST) and repeats settled within the chunk (REPEAT)."""
    from xxhash import xxh3_64_intdigest

    for ids, texts, _ in _chunks(batches):
        data = b"".join(texts)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        starts, n, trigger, lead = phrases(data, offsets)
        view = memoryview(data)
        digest = np.fromiter(
            (xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), (starts + n + LENGTH - 1).tolist())),
            np.uint64, len(starts),
        ).view(np.int64)
        owner = np.searchsorted(offsets, starts, "right") - 1
        doc, at = np.array(ids, np.int64)[owner], starts - offsets[owner]
        columns = [trigger, digest, doc, at, n, lead]
        if len(set(ids)) < len(ids):  # rows with one id are one place
            order = np.lexsort((at, doc))
            columns = [c[order] for c in columns]
        yield from _places(*columns)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, phrases to look at) -> places of blocks of their suffixes.

    A block's suffixes begin up to TOGETHER - 1 bytes apart, at fixed distances from the
    trigger; k1 is the hash of the core that all suffixes at these distances have.
    """
    from xxhash import xxh3_64_intdigest

    def cut(i, text, spans):
        view = memoryview(text)
        for at, n, lead in spans:
            trigger, stop = at + lead, at + n
            while at < stop and at + LENGTH <= len(text):
                near = (trigger - at) // TOGETHER * TOGETHER  # of the block's last suffix
                end = min(stop, trigger - near + 1, len(text) - LENGTH + 1)
                core = view[trigger - near : trigger - near - TOGETHER + 1 + LENGTH]
                yield xxh3_64_intdigest(core), xxh3_64_intdigest(view[at : end + LENGTH - 1]), i, at, end - at
                at = end

    for columns in _cut_texts(batches, cut, 5):
        k1, k2 = (c.view(np.int64) for c in columns[:2])
        yield from _places(k1, k2, *(c.view(np.int64) for c in columns[2:]))


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, blocks to look at) -> places of their suffixes, one by one."""
    from xxhash import xxh3_128_intdigest

    low = (1 << 64) - 1

    def cut(i, text, spans):
        view = memoryview(text)
        for at, n, _ in spans:
            for p in range(at, min(at + n, len(text) - LENGTH + 1)):
                digest = xxh3_128_intdigest(view[p : p + LENGTH])
                yield digest >> 64, digest & low, i, p, 1

    for columns in _cut_texts(batches, cut, 5):
        yield from _places(*(c.view(np.int64) for c in columns))


def _cut_texts(batches, cut, width: int):
    """What ``cut(id, text, spans)`` yields for a chunk, as columns in corpus order."""
    for ids, texts, more in _chunks(batches):
        rows = []
        for i, text, (spans,) in zip(ids, texts, more):
            rows += cut(i % (1 << 64), text, sorted((s["at"], s["n"], s["lead"]) for s in spans))
        columns = [np.array([r[k] for r in rows], np.uint64) for k in range(width)]
        if len(set(ids)) < len(ids):
            order = np.lexsort((columns[3], columns[2].view(np.int64)))
            columns = [c[order] for c in columns]
        yield columns


def _places(k1, k2, doc, at, n, lead=None) -> Iterator[pa.RecordBatch]:
    first, (d, a, m) = settle(k1, k2, doc, at, n)
    lead = np.zeros(len(k1), np.int64) if lead is None else lead
    yield _batch(SPANS, [np.full(len(first), FIRST), *(c[first] for c in (k1, k2, doc, at, n, lead))])
    none = np.zeros(len(d), np.int64)
    yield _batch(SPANS, [np.full(len(d), REPEAT), _spread(d, a), none, d, a, m, none])


def _sorted_places(places: DataFrame) -> DataFrame:
    count = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(count, "k1").sortWithinPartitions("k1", "k2", "doc", "at")


def merge(conflicts: bool):
    """Read places sorted by key: later ones are repeats; with ``conflicts`` also put out the
    first places of different k2 that share a k1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, False  # the newest first place, and whether it was put out
        for batch in batches:
            kind, *row = (batch.column(i).to_numpy() for i in range(len(SPANS)))
            through = kind == REPEAT
            yield _batch(SPANS, [c[through] for c in (kind, *row)])
            row = [c[~through] for c in row]
            if not len(row[0]):
                continue
            if last:
                row = [np.concatenate(([x], c)) for x, c in zip(last, row)]
            k1, k2, doc, at = row[:4]
            new = np.ones(len(k1), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(k1)), 0))
            again = ~new & ((doc != doc[first]) | (at != at[first]))
            yield _batch(SPANS, [np.full(again.sum(), REPEAT), *(c[again] for c in row)])
            heads = np.flatnonzero(new)
            shared = np.zeros(len(heads), bool)
            same = k1[heads][1:] == k1[heads][:-1]
            shared[1:] |= same
            shared[:-1] |= same
            out = shared.copy()
            out[0] &= not done
            if conflicts:
                yield _batch(SPANS, [np.full(out.sum(), FIRST), *(c[heads[out]] for c in row)])
            done = bool(shared[-1]) or (len(heads) == 1 and done)
            last = [c[heads[-1]] for c in row]

    return run


def _result(with_bytes: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(columns..., text bytes, repeated stretches) -> counts, digest and what is left."""
    for batch in batches:
        texts, spans = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            gone = np.zeros(len(text) + 1, np.int8)
            if found:
                a = np.array([(s["at"], s["at"] + s["n"] + LENGTH - 1) for s in found], np.int64)
                a = np.minimum(a, len(text))
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, a[:, 0], 1)
                np.add.at(edge, a[:, 1], -1)
                gone = (np.cumsum(edge) > 0).astype(np.int8)
                gone[-1] = 0
            left = np.frombuffer(text, np.uint8)[gone[:-1] == 0].tobytes()
            runs = int((np.diff(gone, prepend=np.int8(0)) == 1).sum())
            out.append((len(text), len(text) - len(left), runs, hashlib.sha256(left).hexdigest(), left))
        columns = [batch.column(i) for i in range(batch.num_columns - 2)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns += [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]
        n = len(columns) - (not with_bytes)
        yield pa.RecordBatch.from_arrays(columns[:n], (batch.schema.names[:-2] + ADDED)[:n])


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    columns: list[str] | None = None,
    with_bytes: bool = True,
) -> DataFrame:
    """Remove every byte covered by a 100-byte string that also starts earlier.

    One row per document: ``columns`` (default: the id), n_bytes, n_removed, n_spans,
    kept_sha256 and, if asked for, kept_bytes: binary, as a cut may fall inside a character.
    Earlier means a smaller id, or the same id and an earlier start; a null id comes first.
    Rows with one id are one place: neither repeats the other, and what is found in one is
    removed from all of them at the same place.

    A null text counts as empty; texts under 100 bytes stay whole. No rows give no rows.
    """
    carried = [c for c in [doc_id] if columns is None] + [c for c in columns or [] if c not in ADDED]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__body")
    place = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("__doc")
    # By default no more than id and text go through the joins, in both as the same exchange.
    rows = docs.select(place, body, *([] if columns is None else carried))

    def looked(places: DataFrame) -> DataFrame:
        """Documents with the first places that must be looked at."""
        spans = places.where(F.col("kind") == FIRST).groupBy(F.col("doc").alias("__doc"))
        spans = spans.agg(F.collect_list(F.struct("at", "n", "lead")).alias("spans"))
        return rows.join(spans, "__doc").select("__doc", "__body", "spans")

    def sorted_merge(texts: DataFrame, step, conflicts: bool) -> DataFrame:
        return map_batches(_sorted_places(map_batches(texts, step, SPANS)), merge(conflicts), SPANS)

    whole = materialise(sorted_merge(rows.select("__doc", "__body"), parse, True), "passages")
    parts = sorted_merge(looked(whole), blocks, True)
    single = sorted_merge(looked(parts), suffixes, False)
    repeats = whole.unionByName(parts).unionByName(single).where(F.col("kind") == REPEAT)
    repeats = repeats.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("at", "n")).alias("__spans"))
    joined = rows.join(repeats, "__doc", "left")
    if columns is None:
        joined = joined.withColumn(doc_id, F.expr(f"nullif(__doc, cast({NO_ID} AS BIGINT))"))
    joined = joined.select(*carried, "__body", "__spans")
    fields = [(f.name, f.dataType) for f in joined.select(*carried).schema.fields]
    kinds = [LONG, LONG, LONG, T.StringType(), T.BinaryType()]
    fields += list(zip(ADDED, kinds))[: 5 if with_bytes else 4]
    return map_batches(joined, partial(_result, with_bytes), fields)


def op10_passages(spark, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), with_bytes=False)
