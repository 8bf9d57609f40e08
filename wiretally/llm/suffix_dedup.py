"""Removal of byte strings that earlier documents hold, by sorting suffixes in range-partitioned buckets.

A window is a string of ``length`` bytes of one document. Sorting the suffix of every position would move more than fifty times
the input, so the suffixes sorted are those that start at content-chosen places (``anchors``): equal windows choose the
same place, and a suffix stands for about 14 windows around it.

1. Documents are packed into compressed byte batches, each with a few sampled byte strings.
2. Splitters from the samples range-partition the suffixes by their leading bytes. A batch sends one 32-bit mark for each
   distinct suffix to the suffix's bucket; the bucket answers with one bit: do other documents hold this mark?
3. Batches send the marked suffixes with the bytes around them, once for each distinct context in a batch. A bucket orders
   them by multikey quicksort (8 bytes as one key character), takes runs of equal leading stretches, and orders the
   windows of runs with several contexts in the same way. Splitters compare whole leading stretches, so equal stretches meet in
   one bucket and a boundary never cuts a run.
4. Removed intervals go back to their batch, which cuts them out.

Marks may collide: that only sends a suffix to step 3 in vain, where bytes are compared. Every step is a function of its input,
and steps 1, 2 and 3 end in written tables, so lost executors cost only their own tasks.

Hot strings: what a batch holds many times reaches a bucket once, so a bucket gets at most one row for each batch and context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.anchors import GRAM, grams, groups
from wiretally.llm.common import keyed_texts, record_batch, texts_of, work_folder, written

BATCH_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20  # text bytes for each bucket: the number of buckets grows with the input
SAMPLED = 64  # byte strings that a batch gives for the splitters
SPLITTER_ROWS = 4096  # batches whose strings are looked at; balance depends on it, results do not
LEAD = 16  # leading bytes that splitters compare
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: such rows come after all others

PACKED = "ids binary, nulls binary, ends binary, data binary, sample array<binary>, n_bytes long"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Documents without the bytes covered by a ``length``-byte string that also starts in a document with a smaller id.

    Returns for each row: doc_id, n_bytes, spans (array of begin and end of the maximal removed runs), kept (the other bytes, in
    order). Strings are judged on the input; overlaps count. Null texts are empty. Rows with equal ids are one document as far
    as order goes: neither is smaller. Null ids come after all others. Texts shorter than ``length`` bytes stay whole. No rows in,
    no rows out. Columns other than the two named are not read.
    """
    if length < 24:
        raise ValueError("length must be at least 24 bytes")
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    packed = keyed_texts(docs, id_col, text_col).mapInArrow(_pack, PACKED)
    packed = written(packed.withColumn("batch", F.monotonically_increasing_id()), folder, "packed", compression="none")
    n_batches, n_bytes = packed.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    buckets = max(12, -(-n_bytes // BUCKET_BYTES))
    sampled = packed if n_batches <= SPLITTER_ROWS else packed.sample(SPLITTER_ROWS / n_batches, seed=1)
    leads = sorted(bytes(x) for row in sampled.select("sample").toLocalIterator() for x in row[0])
    splitters = np.array(sorted({leads[i * len(leads) // buckets] for i in range(1, buckets)}) if leads else [], dtype=f"S{LEAD}")

    blobs = packed.select("batch", "ids", "nulls", "ends", "data")
    marks = blobs.mapInArrow(lambda rows: _marks(rows, splitters, length), "batch long, bucket int, hashes binary, several binary")
    shared = marks.groupBy("bucket").applyInPandas(_shared, "batch long, bucket int, mask binary")
    shared = written(shared, folder, "shared")
    masks = shared.groupBy("batch").agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))

    contexts = blobs.join(masks, "batch").mapInArrow(
        lambda rows: _contexts(rows, splitters, length, buckets), "batch long, bucket int, first binary, windows binary, offsets binary, ids binary, context binary"
    )
    cut = contexts.groupBy("bucket").applyInPandas(lambda rows: _duplicates(rows, length), "batch long, begins binary, ends binary")
    cut = cut.groupBy("batch").agg(F.collect_list(F.struct("begins", "ends")).alias("cuts"))
    whole = blobs.join(cut, "batch", "left")
    return whole.mapInArrow(_remove, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


PACKED_SCHEMA = pa.schema(
    [("ids", pa.binary()), ("nulls", pa.binary()), ("ends", pa.binary()), ("data", pa.binary()), ("sample", pa.list_(pa.binary())), ("n_bytes", pa.int64())]
)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        data = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        spots = np.linspace(0, max(0, len(data) - LEAD), SAMPLED).astype(int) if data else []
        known = np.array([i is None for i in ids])
        numbers = np.array([LAST if i is None else i for i in ids], dtype=np.int64)
        columns = [numbers.tobytes()], [known.tobytes()], [ends.tobytes()], [zstandard.compress(data, 3)], [[data[s : s + LEAD] for s in spots]], [len(data)]
        return record_batch(PACKED_SCHEMA, *columns)

    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in texts_of(batch):
            raw = text.encode("utf-8", "replace")
            ids.append(doc_id)
            texts.append(raw)
            size += len(raw) + 64
            if size >= BATCH_BYTES:
                yield row(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield row(ids, texts)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Each packed row with its bytes, the ends of its texts, and their ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
            yield row, data, np.frombuffer(row["ends"], np.int64), np.frombuffer(row["ids"], np.int64)


def _in_buckets(data: np.ndarray, starts: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    lead = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(LEAD, np.uint8)), LEAD)[starts]
    return np.searchsorted(splitters, np.ascontiguousarray(lead).view(f"S{LEAD}").ravel(), side="right").astype(np.int32)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    numbers, begins = np.unique(bucket[order], return_index=True)
    for number, part in zip(numbers, np.split(order, begins[1:])):
        yield int(number), part


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 32-bit marks of 64-bit keys in order, and for each key the place of its mark."""
    return np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_inverse=True)


MARKS = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("several", pa.binary())])


def _marks(batches: Iterator[pa.RecordBatch], splitters: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    for row, data, ends, ids in _opened(batches):
        found = groups(data, ends, length)
        bucket = _in_buckets(data, found.start, splitters)
        out: tuple[list, ...] = ([], [], [], [])
        for number, part in _by_bucket(bucket):
            marks, place = _distinct(found.key[part])
            owner = ids[found.owner[part]]
            low, high = np.full(len(marks), LAST), np.full(len(marks), -LAST - 1)
            np.minimum.at(low, place, owner)
            np.maximum.at(high, place, owner)
            for column, value in zip(out, (row["batch"], number, marks.tobytes(), np.packbits(low != high).tobytes()), strict=True):
                column.append(value)
        yield record_batch(MARKS, *out)


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """For each batch, which of its marks other batches hold, or several documents of the batch."""
    marks = [np.frombuffer(x, np.uint32) for x in rows["hashes"]]
    values, counts = np.unique(np.concatenate(marks), return_counts=True)
    repeated = values[counts > 1]
    masks = []
    for own, several in zip(marks, rows["several"], strict=True):
        bits = np.unpackbits(np.frombuffer(several, np.uint8))[: len(own)].astype(bool)
        if len(repeated):
            bits |= repeated[np.minimum(np.searchsorted(repeated, own), len(repeated) - 1)] == own
        masks.append(np.packbits(bits).tobytes())
    return pd.DataFrame({"batch": rows["batch"], "bucket": rows["bucket"], "mask": masks})


CONTEXTS = pa.schema(
    [("batch", pa.int64()), ("bucket", pa.int32()), ("first", pa.binary()), ("windows", pa.binary()), ("offsets", pa.binary()), ("ids", pa.binary()), ("context", pa.binary())]
)


def _small(values: np.ndarray | bytes) -> bytes:
    return zstandard.compress(values if isinstance(values, bytes) else values.tobytes(), 3)


def _contexts(batches: Iterator[pa.RecordBatch], splitters: np.ndarray, length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The marked groups of each batch by bucket, compressed.

    A row without a context holds, as begins and ends, what smaller documents of the same batch cover; any bucket passes it on.
    """
    for row, data, ends, ids in _opened(batches):
        masks = {x["bucket"]: np.frombuffer(x["mask"], np.uint8) for x in row["masks"]}
        found = groups(data, ends, length)
        bucket = _in_buckets(data, found.start, splitters)
        raw, out = data.tobytes(), tuple([] for _ in CONTEXTS)
        covered_begin, covered_end = [], []
        for number, part in _by_bucket(bucket):
            marks, place = _distinct(found.key[part])
            part = part[np.unpackbits(masks[number])[: len(marks)].astype(bool)[place]]
            if not len(part):
                continue
            owner = ids[found.owner[part]]
            part = part[np.argsort(owner, kind="stable")]
            seen: dict[tuple[int, bytes], int] = {}
            sent, texts = [], []
            begins, finishes, starts = found.first[part].tolist(), (found.last[part] + length).tolist(), found.start[part].tolist()
            for i, (begin, end, start, doc) in enumerate(zip(begins, finishes, starts, ids[found.owner[part]].tolist(), strict=True)):
                text = raw[begin:end]
                if (smallest := seen.setdefault((start - begin, text), doc)) < doc:
                    covered_begin.append(begin)
                    covered_end.append(end)
                else:
                    sent.append(i)
                    texts.append(text)
            chosen = part[sent]
            values = (
                row["batch"], number, _small(found.first[chosen].astype(np.int64)), _small((found.last[chosen] - found.first[chosen] + 1).astype(np.uint16)),
                _small((found.start[chosen] - found.first[chosen]).astype(np.uint16)), _small(ids[found.owner[chosen]]), _small(b"".join(texts)),
            )
            for column, value in zip(out, values, strict=True):
                column.append(value)
        if covered_begin:
            begin, end = _merged(np.array(covered_begin, np.int64), np.array(covered_end, np.int64))
            for column, value in zip(out, (row["batch"], row["batch"] % buckets, begin.tobytes(), end.tobytes(), None, None, None), strict=True):
                column.append(value)
        yield record_batch(CONTEXTS, *out)


def multikey_runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the ``length``-byte strings at ``starts`` by multikey quicksort, and in that order the number of each run of equals.

    Eight bytes are one key character. A pass orders every unsettled run by its next character; strings alone in a run are settled.
    """
    order, run = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    wide = grams(np.append(data, np.zeros(8, np.uint8)))
    open_ = np.arange(len(starts))
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        character = wide[starts[order[open_]] + depth]
        ranked = np.lexsort((character, run[open_]))
        order[open_] = order[open_][ranked]
        character, old = character[ranked], run[open_]
        fresh = np.ones(len(open_), bool)
        fresh[1:] = (character[1:] != character[:-1]) | (old[1:] != old[:-1])
        settled = np.ones(len(starts), bool)
        settled[open_] = fresh
        run = np.cumsum(settled) - 1
        size = np.bincount(run)
        open_ = np.flatnonzero(size[run] > 1)
        if not len(open_):
            break
    return order, run


def _duplicates(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """For each batch, the intervals of its contexts that a document with a smaller id holds."""
    known = rows[rows["context"].isna()]
    rows = rows[rows["context"].notna()]
    out: dict[str, list] = {"batch": known["batch"].tolist(), "begins": known["first"].tolist(), "ends": known["windows"].tolist()}
    if not len(rows):
        return pd.DataFrame(out)
    opened = {name: [zstandard.decompress(x) for x in rows[name]] for name in ("first", "windows", "offsets", "ids", "context")}
    joined = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in opened[name]])
    batch = np.repeat(rows["batch"].to_numpy(), [len(x) // 8 for x in opened["first"]])
    first, windows = joined("first", np.int64), joined("windows", np.uint16).astype(np.int64)
    offset, doc = joined("offsets", np.uint16).astype(np.int64), joined("ids", np.int64)
    raw = b"".join(opened["context"])
    data = np.frombuffer(raw, np.uint8)
    size = windows + length - 1
    place = np.cumsum(size) - size
    half = (length - GRAM + 2) // 2
    order, run = multikey_runs(data, place + offset, min(length - half + 1, half + GRAM))
    runs_at = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    whole: list[int] = []  # contexts that a smaller document holds whole
    singles: list[int] = []  # contexts whose windows must be compared, each distinct one once a document
    for members in np.split(order, runs_at[1:]):
        if len(members) == 1:
            continue
        members = members[np.argsort(doc[members], kind="stable")]
        least: dict[tuple[int, bytes], int] = {}
        kept = []
        for i in members.tolist():
            smallest = least.setdefault((int(offset[i]), raw[place[i] : place[i] + size[i]]), int(doc[i]))
            (whole if smallest < doc[i] else kept).append(i)
        if len(least) > 1:
            singles += kept
    begins, ends, where = [first[whole]], [first[whole] + size[whole]], [batch[whole]]
    if singles:
        chosen = np.array(singles)
        entry = np.repeat(chosen, windows[chosen])
        step = np.arange(len(entry)) - np.repeat(np.cumsum(windows[chosen]) - windows[chosen], windows[chosen])
        order, run = multikey_runs(data, place[entry] + step, length)
        smallest = np.full(run[-1] + 1, LAST)
        np.minimum.at(smallest, run, doc[entry[order]])
        hit = order[doc[entry[order]] > smallest[run]]
        begins.append(first[entry[hit]] + step[hit])
        ends.append(first[entry[hit]] + step[hit] + length)
        where.append(batch[entry[hit]])
    begin, end, owner = np.concatenate(begins), np.concatenate(ends), np.concatenate(where)
    for number in np.unique(owner):
        low, high = _merged(begin[owner == number], end[owner == number])
        for name, value in zip(out, (number, low.tobytes(), high.tobytes()), strict=True):
            out[name].append(value)
    return pd.DataFrame(out)


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals joined where they overlap or touch."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(begin), bool)
    fresh[1:] = begin[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return begin[at], reach[np.append(at[1:], len(begin)) - 1] if len(at) else begin


KEPT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, data, ends, ids in _opened(batches):
        cuts = row["cuts"] or []
        low = np.concatenate([np.frombuffer(c["begins"], np.int64) for c in cuts] or [np.empty(0, np.int64)])
        high = np.concatenate([np.frombuffer(c["ends"], np.int64) for c in cuts] or [np.empty(0, np.int64)])
        level = np.zeros(len(data) + 1, np.int32)
        np.add.at(level, low, 1)
        np.add.at(level, high, -1)
        gone = np.cumsum(level[:-1]) > 0
        nulls = np.frombuffer(row["nulls"], bool)
        out: tuple[list, ...] = ([], [], [], [])
        begin = 0
        for doc_id, null, end in zip(ids.tolist(), nulls.tolist(), ends.tolist(), strict=True):
            mask = gone[begin:end]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans = [{"begin": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            for column, value in zip(out, (None if null else doc_id, end - begin, spans, data[begin:end][~mask].tobytes()), strict=True):
                column.append(value)
            begin = end
        yield record_batch(KEPT, *out)
