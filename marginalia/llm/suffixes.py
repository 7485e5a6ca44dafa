"""Exact substring deduplication by column-wise construction of sorted suffix collections.

1. Each window of `length` bytes is keyed by the least hash of the 24-byte
   grams inside it; neighbouring windows with one key form a span. Equal
   windows have equal keys, so spans whose key occurs in one document only
   can hold no match and go no further.
2. Spans with a shared key become short strings, equal ones are merged by
   their 128-bit names, and keys are dealt over shards of bounded size; the
   first document of each string brings its bytes, where a key has several
   strings (one alone has none to be compared with). A shard's collection is
   sorted column by column: a round inserts one symbol of every string, from its end
   to its start, and brings the Burrows-Wheeler transform and the common
   prefixes of neighbouring suffixes up to date. Rounds run in passes; between
   two passes transform, prefixes and the symbols that are left are files in
   the shared folder, which the next pass reads and writes in sequence.
   Neighbours whose common prefix reaches `length` are equal windows, and the
   least document id of each run of them is their first document.
3. A window whose first document is smaller than its own is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.blocks import released, released_group, text_slices
from marginalia.llm.shingles import mix
from marginalia.session import discard, keep, table, unused

LENGTH, GRAM = 50, 24
#: Windows of a span at most (more only share a gram where the text repeats itself), window starts of one numpy pass, bytes of strings in a shard.
SPAN, PASS, SHARD_BYTES = LENGTH - GRAM + 1, 1 << 16, 1 << 20
#: Columns inserted in one pass, shards in a file between passes, bytes of text whose spans are made at once, bytes of text for each part that keys are settled in.
COLUMNS, SHARDS_PER_FILE, TEXT_BYTES, PART_BYTES = 26, 8, 8 << 20, 16 << 20
#: Bytes that go to a Python worker at once.
BATCH_BYTES = 16 << 20
#: Rows of a slice of a batch, under 2**16.
ROWS = 20_000
#: A key with more different strings than this is dealt window by window instead.
HOT_STRINGS = 150_000
#: A shard between two passes; blobs of one number per string, of the symbols left, and of one number per suffix.
STATE = "shard long, key binary, h binary, low binary, high binary, lengths binary, place binary, done long, left binary, bwt binary, shared binary"


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and its offsets."""
    column = column.fill_null("").cast(pa.large_string())
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one integer."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), 0, (1,))


def spans(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start in its text, number of windows, key) of the spans, a pass at a time."""
    low, high = int(offsets[0]), int(offsets[-1])
    for a in range(low, high - length + 1, PASS):
        b = min(a + PASS, high - length + 1)  # window starts a <= i < b
        part = data[a : b + length - 1]
        with np.errstate(over="ignore"):
            w, n = words_at(part), len(part) - gram + 1
            h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
            for o in [*range(8, gram - 8, 8), gram - 8]:
                h = mix(h + w[o : o + n])
        need, have = length - gram + 1, 1
        while 2 * have <= need:
            h = np.minimum(h[:-have], h[have:])
            have *= 2
        if need > have:
            h = np.minimum(h[: len(h) - (need - have)], h[need - have :])
        at = np.arange(a, b)
        i, j = (np.searchsorted(offsets, (a, b - 1), side="right") - 1).tolist()
        row = np.repeat(np.arange(i, j + 1), np.diff(np.clip(offsets[i : j + 2], a, b)))
        ok = at + length <= offsets[row + 1]
        new = np.ones(len(at), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
        starts = np.flatnonzero(new)
        run = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        starts = np.flatnonzero(run % SPAN == 0)
        sizes = np.diff(np.append(starts, len(at)))
        good = ok[starts]
        starts, sizes = starts[good], sizes[good]
        yield row[starts], at[starts] - offsets[row[starts]], sizes, h[starts].view(np.int64)


@dataclass
class Columns:
    """A collection of strings after some rounds: its transform, common prefixes and where the next symbols go.

    Symbols are bytes plus one, 0 is the end of a string; the empty suffixes
    come first, in the strings' order. shared[i] counts the bytes that the
    suffixes at i - 1 and i have in common, up to `most`.
    """

    lengths: np.ndarray
    bwt: np.ndarray
    shared: np.ndarray
    place: np.ndarray  # of the last suffix of each string that had a symbol left
    done: int
    most: int

    @staticmethod
    def empty(lengths: np.ndarray, last: np.ndarray, most: int) -> Columns:
        """last: the strings' last symbols, 0 for empty strings."""
        return Columns(lengths, last.astype(np.uint8), np.zeros(len(lengths), np.uint8), np.flatnonzero(lengths > 0), 0, most)

    def insert(self, symbols: np.ndarray) -> None:
        """One round: inserts a suffix of every string that has one more symbol; symbols are those before them, 0 where nothing is left.

        The place of a new suffix is the rank of its first symbol in the
        transform. What it shares with its neighbours is one byte more than the
        least shared between that occurrence of the symbol and the ones before
        and after it.
        """
        bwt, place, n = self.bwt, self.place, len(self.lengths)
        order = np.argsort(bwt, kind="stable").astype(np.int32)
        counts = np.bincount(bwt, minlength=257)
        begin = np.concatenate([[0], np.cumsum(counts)])
        symbol = bwt[place]
        rank = np.empty(len(place), np.int64)
        by = np.argsort(symbol, kind="stable")
        ends = np.cumsum(np.bincount(symbol, minlength=256))
        for c in np.flatnonzero(np.bincount(symbol, minlength=256)).tolist():
            some = by[ends[c - 1] : ends[c]] if c else by[: ends[0]]
            rank[some] = begin[c] + np.searchsorted(order[begin[c] : begin[c + 1]], place[some])
        to = rank - counts[0] + n
        before, after = rank > begin[symbol], rank + 1 < begin[symbol.astype(np.int64) + 1]
        most = np.uint8(self.most)
        padded = np.append(self.shared, np.uint8(0))

        def least(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            if not len(low):
                return np.zeros(0, np.uint8)
            edges = np.empty(2 * len(low), np.int64)
            edges[::2], edges[1::2] = low, high + 1
            return np.minimum(np.minimum.reduceat(padded, edges)[::2], most - 1) + np.uint8(1)

        in_order = np.argsort(place)
        up, down = np.zeros(len(place), np.uint8), np.zeros(len(place), np.uint8)
        some = in_order[before[in_order]]
        up[some] = least(order[rank[some] - 1].astype(np.int64) + 1, place[some])
        some = in_order[after[in_order]]
        down[some] = least(place[some] + 1, order[rank[some] + 1].astype(np.int64))
        size = len(bwt) + len(place)
        old = np.ones(size, bool)
        old[to] = False
        grown = np.empty(size, np.uint16)  # both bytes move at once
        grown[old] = (self.shared.astype(np.uint16) << 8) | bwt
        grown[to] = (up.astype(np.uint16) << 8) | symbols
        shared = (grown >> 8).astype(np.uint8)
        below = np.flatnonzero(after)
        below = below[old[to[below] + 1]]
        shared[to[below] + 1] = down[below]
        self.done += 1
        on = self.lengths[self.lengths >= self.done] > self.done
        self.bwt, self.shared, self.place = grown.astype(np.uint8), shared, to[on]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of each window in order, where runs of equal windows begin): windows of `most` bytes by string and start."""
        n, windows = len(self.lengths), np.maximum(0, self.lengths - self.most + 1)
        base = np.concatenate([[0], np.cumsum(windows)])
        order = np.argsort(self.bwt, kind="stable")
        to = np.empty(len(order), np.int32)
        to[order] = np.arange(len(order), dtype=np.int32) - np.count_nonzero(self.bwt == 0) + n
        at, alive = np.arange(n), np.arange(n)
        window_at = np.full(len(order), -1, np.int32)
        for done in range(1, int(self.lengths.max(initial=0)) + 1):
            on = self.lengths[alive] >= done
            alive, at = alive[on], to[at[on]]
            if done >= self.most:
                window_at[at] = base[alive] + self.lengths[alive] - done
        places = np.flatnonzero(window_at >= 0)
        return window_at[places], np.flatnonzero(self.shared[places] < self.most)


def first_documents(columns: Columns, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first document of each window, first window of each string and the end), windows in the order of their strings."""
    windows = np.maximum(0, columns.lengths - columns.most + 1)
    base = np.concatenate([[0], np.cumsum(windows)])
    first = np.empty(int(base[-1]), np.int64)
    if len(first):
        ranked, begin = columns.groups()
        owner = np.repeat(np.arange(len(docs)), windows)
        least = np.minimum.reduceat(docs[owner[ranked]], begin)
        first[ranked] = np.repeat(least, np.diff(np.append(begin, len(ranked))))
    return first, base


def _blob(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def shared_keys(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """(id, keys): each document's span keys that another document has too, as blobs of their upper 48 bits.

    A batch sends each of its keys once: with the document if only one has it,
    else as a notice, and keeps the pairs themselves, which are settled. So a
    key that many documents have costs as many rows as there are batches.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            data, offsets = text_bytes(batch.column(1))
            found = [(key.view(np.uint64) >> np.uint64(16), row) for row, _, _, key in spans(data, offsets, length)]
            if not found:
                continue
            # A row of a slice is under 2**16, so a key of 48 bits and a row are one integer.
            both = np.sort(np.concatenate([(key << np.uint64(16)) | row.astype(np.uint64) for key, row in found]))
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
            key, row = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.repeat(np.diff(np.append(begin, len(key))) > 1, np.diff(np.append(begin, len(key))))
            ids = batch.column(0).to_numpy()[row]
            first = np.zeros(len(key), bool)
            first[begin] = True
            send = ~many | first
            notice = many[send]
            k, i = key[send], ids[send]
            part = (k % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            k, i, notice, part = k[order], i[order], notice[order], part[order]
            edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            out = [(int(part[x]), k[x:y], i[x:y], notice[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            lk, li = key[many], ids[many]
            where = int(mix(np.asarray([ids[0]], np.int64).view(np.uint64))[0] % np.uint64(parts)) if len(ids) else 0
            out += [(parts + (where + x) % parts, lk[x :: 8], li[x :: 8], None) for x in range(8) if len(lk) > x]
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.int64()), pa.array([o[1].astype("<u4").tobytes() for o in out], pa.binary()), pa.array([(o[1] >> np.uint64(32)).astype("<u2").tobytes() for o in out], pa.binary()),
                pa.array([o[2].astype("<i8").tobytes() for o in out], pa.binary()), pa.array([b"" if o[3] is None else np.packbits(o[3]).tobytes() for o in out], pa.binary()),
            ], ["part", "low", "high", "ids", "notice"])

    def settle(group: pa.Table) -> pa.Table:
        local = group.column("part")[0].as_py() >= parts if group.num_rows else True
        key = _blob(group.column("low"), "<u4").astype(np.uint64) | (_blob(group.column("high"), "<u2").astype(np.uint64) << np.uint64(32))
        ids = _blob(group.column("ids"), "<i8")
        if not local and len(key):
            sizes = [len(x) // 4 for x in group.column("low").to_pylist()]
            notice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(group.column("notice").to_pylist(), sizes, strict=True)]).astype(bool)
            order = np.argsort(key)
            key, ids, notice = key[order], ids[order], notice[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, len(key)))
            shared = np.repeat((size > 1) | (np.add.reduceat(notice, begin) > 0), size) & ~notice
            key, ids = key[shared], ids[shared]
        order = np.argsort(ids)
        key, ids = key[order], ids[order]
        edges = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]) if len(ids) else np.zeros(1, np.int64)
        raw = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        blobs = [raw[6 * x : 6 * y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.table([pa.array(ids[edges[:-1]]) if len(ids) else pa.array([], pa.int64()), pa.array(blobs, pa.binary())], ["id", "keys"])

    sent = docs.mapInArrow(released(find), "part long, low binary, high binary, ids binary, notice binary")
    settled = sent.groupBy("part").applyInArrow(released_group(settle), "id long, keys binary")
    return settled.groupBy("id").agg(F.collect_list("keys").alias("keys"))


def _blobs(batch: pa.RecordBatch, k: int, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[k].as_buffer(), kind)


def _state(shard: int, key: np.ndarray, h: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, columns: Columns) -> pa.RecordBatch:
    c = columns
    blobs = [key.astype("<i8"), h.astype("<i8"), low.astype("<i8"), high.astype("<i8"), c.lengths.astype("<i4"), c.place.astype("<i4"), left, c.bwt, c.shared]
    raw = [pa.array([x.tobytes()], pa.binary()) for x in blobs]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *raw[:6], pa.array([c.done], pa.int64()), *raw[6:]], [f.split()[0] for f in STATE.split(", ")])


def advance(columns: Columns, left: np.ndarray, rounds: int) -> np.ndarray:
    """Inserts up to `rounds` columns; left and the result are the symbols before those that the transform holds already."""
    sizes = np.maximum(0, columns.lengths - columns.done - 1)
    ends = np.cumsum(sizes)
    for k in range(rounds):
        if not len(columns.place):
            return left[:0]
        alive = columns.lengths > columns.done
        n, e = sizes[alive], ends[alive]
        symbols = np.zeros(len(n), np.uint8)
        symbols[n > k] = left[e[n > k] - k - 1] + np.uint8(1)
        columns.insert(symbols)
    keep_ = np.arange(len(left)) - np.repeat(ends - sizes, sizes) < np.repeat(np.maximum(0, sizes - rounds), sizes)
    return left[keep_]


def early_windows(columns: Columns, low: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(list of begin and end of each run of windows found in an earlier document, number of such runs) of each string, whose first document is `low`."""
    found, base = first_documents(columns, low)
    owner = np.repeat(np.arange(len(low)), np.diff(base))
    earlier = found < low[owner]
    marks = np.zeros(len(owner) + 1, bool)  # where runs of such windows or strings begin
    marks[1:-1] = earlier[1:] != earlier[:-1]
    marks[base] = True
    points = np.flatnonzero(marks)
    begin, end = points[:-1], points[1:]
    begin, end = begin[earlier[begin]], end[earlier[begin]]
    who = owner[begin]
    count = np.bincount(who, minlength=len(low))
    pairs = np.stack([begin - base[who], end - base[who]], 1).reshape(-1).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array((2 * np.concatenate([[0], np.cumsum(count)])).astype(np.int32)), pa.array(pairs)), count


def sorted_strings(strings: DataFrame, length: int) -> DataFrame:
    """(key, h, first, early) of the strings (shard, key, h, low, high, part) that remove anything from a document."""

    def begin(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        column = shard.column("part").cast(pa.large_binary())
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
        _, raw, data = column.buffers()
        offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + len(column) + 1]
        data, lengths = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)
        inner = np.ones(len(data), bool)
        inner[offsets[1:] - offsets[0] - 1] = False
        columns = Columns.empty(lengths, data[offsets[1:] - offsets[0] - 1] + np.uint8(1), length)
        left = advance(columns, data[inner], COLUMNS)
        numbers = (shard.column(c).to_numpy() for c in ("key", "h", "low", "high"))
        return pa.Table.from_batches([_state(shard.column("shard")[0].as_py(), *numbers, left, columns)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, Columns]]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths, place = (_blobs(batch, k, name, "<i4").astype(np.int64) for name in ("lengths", "place"))
                columns = Columns(lengths, _blobs(batch, k, "bwt", np.uint8), _blobs(batch, k, "shared", np.uint8), place, batch.column(7)[k].as_py(), length)
                left = advance(columns, _blobs(batch, k, "left", np.uint8), COLUMNS)
                yield batch.column(0)[k].as_py(), [_blobs(batch, k, name, "<i8") for name in ("key", "h", "low", "high")], left, columns

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, numbers, left, columns in read(batches):
            yield _state(shard, *numbers, left, columns)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, h, low, high), _, columns in read(batches):
            early, count = early_windows(columns, low)
            out = pa.RecordBatch.from_arrays([pa.array(key), pa.array(h), pa.array(low), early], ["key", "h", "first", "early"])
            # What one document alone has and holds no earlier window removes nothing.
            yield out.filter(pa.array((high > low) | (count > 0)))

    passes = -(-(length + SPAN - 1) // COLUMNS)
    state = keep(strings.groupBy("shard").applyInArrow(released_group(begin), STATE), "columns", rows_per_file=SHARDS_PER_FILE, batch_bytes=BATCH_BYTES)
    for _ in range(passes - 2):
        state, before = keep(state.mapInArrow(released(more), STATE), "columns", rows_per_file=SHARDS_PER_FILE, batch_bytes=BATCH_BYTES), state
        discard(before)
    out = keep(state.mapInArrow(released(finish), "key long, h long, first long, early array<int>"), "strings", batch_bytes=BATCH_BYTES)
    discard(state)
    return out


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, spans): per document the (start, end) byte ranges to remove, unsorted and overlapping; documents without any are missing.

    Rows with a null id are left out; null and empty texts and those shorter
    than `length` bytes have no spans. Equal rows with one id are one document.
    """
    if not GRAM < length < 256:
        raise ValueError(f"length must be above {GRAM} and below 256")
    docs = docs.where("id is not null")

    def named(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        whole = data.tobytes()
        parts = [whole[a:b] for a, b in zip(begin.tolist(), (begin + size + length - 1).tolist(), strict=True)]
        return parts, np.asarray(list(map(xxhash.xxh3_64_intdigest, parts)), np.uint64).view(np.int64)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            yield from text_slices(s, 1, TEXT_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of the strings of shared keys: (key, h, id, start, size)."""
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            raw = [b"".join(blobs) for blobs in batch.column(2).to_pylist()]
            counts = np.asarray([len(x) // 6 for x in raw])
            six = np.zeros((int(counts.sum()), 8), np.uint8)
            six[:, :6] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
            rows = np.repeat(np.arange(len(raw), dtype=np.uint64), counts)
            wanted = np.sort((rows << np.uint64(48)) | six.view("<u8")[:, 0])
            if not len(wanted):
                continue
            for row, start, size, key in spans(data, offsets, length):
                name = (row.astype(np.uint64) << np.uint64(48)) | (key.view(np.uint64) >> np.uint64(16))
                on = wanted[np.minimum(np.searchsorted(wanted, name), len(wanted) - 1)] == name
                row, start, size, key = row[on], start[on], size[on], key[on]
                begin = offsets[row] + start
                _, h = named(data[begin[0] : begin[-1] + size[-1] + length - 1], begin - begin[0], size) if len(begin) else ([], np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h), pa.array(ids[row]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["key", "h", "id", "start", "size"])

    def listed(batch: pa.RecordBatch, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """(row of each entry, fields of the entries) of the list column 2."""
        lists = batch.column(2)
        flat = lists.flatten()
        return np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), [flat.field(k).to_numpy(zero_copy_only=False) for k in range(fields)]

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places window by window, keyed by the window itself."""
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            row, (start, size) = listed(batch, 2)
            start = np.repeat(start.astype(np.int64), size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            row = np.repeat(row, size)
            for i in range(0, len(row), PASS):
                r, s = row[i : i + PASS], start[i : i + PASS]
                parts, h = named(data, offsets[r] + s, np.ones(len(s), np.int64))
                key = np.asarray([xxhash.xxh3_64_intdigest(p, 1) for p in parts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h), pa.array(ids[r]), pa.array(s.astype(np.int32)), pa.array(np.ones(len(s), np.int32))], ["key", "h", "id", "start", "size"])

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings that their first documents are to bring."""
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            row, (key, h, high, start, size) = listed(batch, 5)
            low = batch.column(0).to_numpy()[row]
            for i in range(0, len(row), PASS):
                k = slice(i, i + PASS)
                parts, _ = named(data, offsets[row[k]] + start[k], size[k].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(h[k]), pa.array(low[k]), pa.array(high[k]), pa.array(parts, pa.binary())], ["key", "h", "low", "high", "part"])

    def with_lists(rows: DataFrame, *fields: str) -> DataFrame:
        """(id, text, list of the fields) of documents that have rows (id, ...)."""
        lists = rows.groupBy("id").agg(F.collect_list(F.struct(*fields)).alias("list"))
        return docs.dropDuplicates(["id"]).join(lists.hint("merge"), "id").select("id", "text", "list")

    def variants_of(rows: DataFrame) -> DataFrame:
        """(key, h, low, high, start, size): the strings, with their least and greatest document and their place in the least."""
        return rows.groupBy("key", "h").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min_by("start", "id").alias("start"), F.max("size").alias("size"))

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = keep(shared_keys(docs, length, max(32, total // PART_BYTES)), "shared-keys", batch_bytes=BATCH_BYTES)
    schema = "key long, h long, id long, start int, size int"
    places = keep(docs.join(shared.hint("merge"), "id").select("id", "text", "keys").mapInArrow(released(cut), schema), "places", batch_bytes=BATCH_BYTES)
    discard(shared)
    variants = keep(variants_of(places), "variants")
    several = keep(variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
    hot = keep(several.where(F.col("n") > HOT_STRINGS).select("key"), "hot-keys")
    if not hot.isEmpty():
        windows = keep(with_lists(places.join(hot.hint("merge"), "key", "left_semi"), "start", "size").mapInArrow(released(single), schema), "windows")
        old = (places, variants, several)
        places = keep(places.join(hot.hint("merge"), "key", "left_anti").unionByName(windows), "places")
        variants = keep(variants.join(hot.hint("merge"), "key", "left_anti").unionByName(variants_of(windows)), "variants")
        several = keep(variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
        discard(windows, *old)
    # Where a key has several strings, the first document of each brings it to the key's shard; a string alone under its key has no other to be sorted with.
    wanted = variants.join(several.select("key").hint("merge"), "key", "left_semi")
    size = wanted.agg(F.sum(F.col("size") + (length - 1))).first()[0] or 0
    wanted = wanted.select(F.col("low").alias("id"), "key", "h", "high", "start", "size")
    brought = with_lists(wanted, "key", "h", "high", "start", "size").mapInArrow(released(bring), "key long, h long, low long, high long, part binary")
    sorted_ = sorted_strings(brought.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(32, size // SHARD_BYTES)))), length)
    alone = variants.where("high > low").join(several.select("key").hint("merge"), "key", "left_anti").select("key", "h", F.col("low").alias("first"), F.array().cast("array<int>").alias("early"))
    # The key and the hash are 128 bits of a string.
    joined = places.join(sorted_.unionByName(alone).hint("merge"), ["key", "h"]).where("id > first or size(early) > 0")
    # A later document loses the whole span; the string's first document only windows found in an earlier one.
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("size") + (length - 1)).alias("b")))
    some = F.expr(f"transform(sequence(0, size(early) div 2 - 1), i -> struct(start + early[2 * i] as a, start + early[2 * i + 1] + {length - 1} as b))")
    joined = joined.select("id", F.explode(F.when(F.col("id") > F.col("first"), whole).otherwise(some)).alias("span"))
    out = keep(joined.groupBy("id").agg(F.collect_list("span").alias("spans")), "removed")
    discard(places, variants, several, hot, sorted_)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the byte ranges that repeat a smaller id's text taken out.

    digest: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Else the input's
    columns with the text replaced; a character of which some bytes went goes
    as a whole. Ids are distinct (equal rows with one id are one document and
    keep a row each); rows with a null id are compared with nothing. Null text
    counts as empty; texts shorter than `length` bytes never change.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = removed_spans(source, length)

    def kept_bytes(batch: pa.RecordBatch, text: int, where: int) -> Iterator[tuple[bytes, int, int]]:
        """(kept bytes, bytes removed, runs removed) of each row; null is empty."""
        lists = batch.column(where)
        counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten()
        a, b = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        ends = np.cumsum(counts)
        for raw, n, end in zip(batch.column(text).cast(pa.binary()).to_pylist(), counts.tolist(), ends.tolist(), strict=True):
            raw = raw or b""
            if not n:
                yield raw, 0, 0
                continue
            x, y = a[end - n : end], b[end - n : end]
            order = np.argsort(x, kind="stable")
            x, y = x[order], np.maximum.accumulate(y[order])
            new = np.concatenate([[True], x[1:] > y[:-1]])
            x, y = x[new], y[np.append(np.flatnonzero(new)[1:] - 1, n - 1)]
            pieces, at = [], 0
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                pieces.append(raw[at:i])
                at = j
            pieces.append(raw[at:])
            yield b"".join(pieces), int((y - x).sum()), len(x)

    if digest:

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(len(kept) + n, n, k, hashlib.sha256(kept).hexdigest()) for kept, n, k in kept_bytes(batch, 1, 2)]
                n_bytes, n_removed, n_spans, sha = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return source.join(found.hint("merge"), "id", "left").select("id", "text", "spans").mapInArrow(released(sums), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    names = docs.columns
    where = names.index(text_col)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(where).to_pylist()
            texts = [t if not n else kept.decode("utf-8", "ignore") for t, (kept, n, _) in zip(old, kept_bytes(batch, where, len(names)), strict=True)]
            columns = [pa.array(texts, pa.string()) if k == where else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    own, runs = unused(docs, "removed_id"), unused(docs, "removed_runs")
    found = found.select(F.col("id").alias(own), F.col("spans").alias(runs))
    return docs.join(found.hint("merge"), docs[id_col].cast("long") == found[own], "left").select(*names, runs).mapInArrow(released(strip), docs.schema)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), LENGTH, digest=True)
