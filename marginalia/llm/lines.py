"""Line deduplication by pairwise alignment.

Every line is a hash of it and its ordinal among the equal lines of its
document, so an entry is unique in a document. A block that can be deleted is
a run of neighbouring entries of BLOCK_CHARS code points, so two documents can
lose lines to each other only where they share a window: the shortest run of
that length from a line on, or such a run with the short lines behind it. A
document's windows are taken from the rarest on, by the number of documents
that hold them, until they cover all lines that it shares, and it is first
aligned with the first holder of each of these, by patience diff over all
entries that both hold, which is their longest increasing subsequence; aligned
runs of neighbouring lines are deleted from the later document. Where lines of
a shared window are left after that, the document is aligned with the first
holders of all such windows, and then with more and more of their earlier
holders, until the lines are deleted or every holder has been tried. The result
is that of aligning all pairs.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.blocks import released
from marginalia.session import discard, keep, table, unused

#: Code points that a block of aligned lines must have in all to be deleted.
BLOCK_CHARS = 30
#: Holders of a window that are tried at once, and how many times more in each round until all are.
HOLDERS = 8
#: Bytes that go to a Python worker at once.
BATCH_BYTES = 16 << 20


def entries(text: str) -> tuple[list[int], list[int], list[int]]:
    """(line number, hash with ordinal, code points) of the lines that are not blank; white space at line ends does not count."""
    numbers, hashes, sizes, met = [], [], [], Counter()
    for number, line in enumerate(text.split("\n")):
        line = line.strip()
        if line:
            h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace"), met[line])
            met[line] += 1
            numbers.append(number)
            hashes.append(h - (1 << 63))
            sizes.append(len(line))
    return numbers, hashes, sizes


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (later, earlier) places, ascending in `later`, that ascends in `earlier` too."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, earlier) in enumerate(pairs):
        pile = bisect.bisect_left(tops, earlier)
        back[k] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(earlier)
            at.append(k)
        else:
            tops[pile], at[pile] = earlier, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned_blocks(later: list[int], earlier: list[int], sizes: list[int], least: int) -> list[int]:
    """Places of the later document's lines in aligned blocks of at least `least` code points."""
    by_later = sorted(zip(later, earlier, strict=True))
    size = dict(zip(later, sizes, strict=True))
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for pair in [*patience(by_later), (-9, -9)]:
        if pair != (last[0] + 1, last[1] + 1):
            if sum(size[p] for p in block) >= least and block:
                out += block
            block = []
        block.append(pair[0])
        last = pair
    return out


def windows(hashes: list[int], sizes: list[int], least: int) -> list[tuple[int, int, int]]:
    """(key, first place, last place) of runs of at least `least` code points; those inside a block cover all of it.

    From each place the shortest such run, and longer ones while what follows
    the place is under `least`. The whole document is a run too, so that copies
    find each other.
    """
    packed = np.asarray(hashes, np.int64).tobytes()
    out = []
    end, total = -1, 0  # total: code points of the places from k to end
    for k in range(len(sizes)):
        while total < least and end + 1 < len(sizes):
            end += 1
            total += sizes[end]
        if total < least:
            break
        last, behind = end, total - sizes[k]
        while True:
            out.append((xxhash.xxh3_64_intdigest(packed[8 * k : 8 * last + 8]) - (1 << 63), k, last))
            last += 1
            if last == len(sizes) or behind + sizes[last] >= least:
                break
            behind += sizes[last]
        total -= sizes[k]
    if out and out[0][2] < len(sizes) - 1:
        out.append((xxhash.xxh3_64_intdigest(packed, 1) - (1 << 63), 0, len(sizes) - 1))
    return out


def lists(column: pa.Array) -> Iterator[list]:
    """The lists of a column, one at a time."""
    for k in range(len(column)):
        yield column[k].values.to_numpy(zero_copy_only=False).tolist()


def repeated_lines(docs: DataFrame, least: int = BLOCK_CHARS) -> DataFrame:
    """(id, places array<int>): places, among its lines that are not blank, that each document loses; docs has id and text."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                ids, hashes, sizes = [], [], []
                for doc, text in zip(batch.column(0).slice(i, 500).to_pylist(), batch.column(1).slice(i, 500).to_pylist(), strict=True):
                    _, h, n = entries(text or "")
                    if h:
                        ids.append(doc)
                        hashes.append(h)
                        sizes.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], ["id", "hashes", "sizes"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = [(key, doc, a, b) for doc, h, n in zip(part.column(0).to_pylist(), lists(part.column(1)), lists(part.column(2)), strict=True) for key, a, b in windows(h, n, least)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["h", "id", "place", "end"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, sizes, theirs in zip(lists(batch.column(1)), lists(batch.column(2)), lists(batch.column(3)), strict=True):
                at = {h: k for k, h in enumerate(theirs)}
                met = [(k, at[h], sizes[k]) for k, h in enumerate(own) if h in at]
                out.append(aligned_blocks([m[0] for m in met], [m[1] for m in met], [m[2] for m in met], least))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["id", "places"])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, rows, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                gone = set(places or ())
                out += {(doc, r["h"], r["first"]) for r in rows if not gone.issuperset(range(r["place"], r["end"] + 1))}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["id", "h", "first"])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First holders of a document's windows, from the rarest on until they cover its shared lines."""
        for batch in batches:
            out = []
            for doc, rows in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                covered: set[int] = set()
                for r in sorted(rows, key=lambda r: (r["n"], r["place"], r["end"])):
                    places = range(r["place"], r["end"] + 1)
                    if not covered.issuperset(places):
                        covered.update(places)
                        out.append((doc, r["first"]))
            out = list(dict.fromkeys(out))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["id", "first"])

    def aligned(pairs: DataFrame) -> DataFrame:
        first = seqs.select(F.col("id").alias("first"), F.col("hashes").alias("theirs"))
        both = pairs.join(first.hint("merge"), "first").join(seqs.hint("merge"), "id").select("id", "hashes", "sizes", "theirs")
        return both.mapInArrow(released(align), "id long, places array<int>").where("size(places) > 0")

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))

    def remaining(hits: DataFrame, lost: DataFrame) -> DataFrame:
        return hits.join(lost.hint("merge"), "id", "left").select("id", "rows", "places").mapInArrow(released(left), "id long, h long, first long")

    # Joins of tables that grow are merged at any size, so that small inputs show what large ones do.
    seqs = keep(docs.where("id is not null").mapInArrow(released(index), "id long, hashes array<long>, sizes array<int>"), "lines", batch_bytes=BATCH_BYTES)
    runs = seqs.mapInArrow(released(cut), "h long, id long, place int, end int")
    firsts = runs.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    met = runs.join(firsts.hint("merge"), "h").where("id > first")
    hits = keep(met.groupBy("id").agg(F.collect_list(F.struct("place", "end", "h", "first", "n")).alias("rows")), "shared-lines")
    tried = keep(hits.select("id", "rows").mapInArrow(released(rarest), "id long, first long"), "pairs")
    lost = keep(merged(aligned(tried)), "lost-lines")
    rest = keep(remaining(hits, lost), "left-lines")
    pairs = rest.select("id", "first").distinct().join(tried.hint("merge"), ["id", "first"], "left_anti")
    lost, before = keep(merged(lost.unionByName(aligned(pairs))), "lost-lines"), lost
    rest, old = keep(remaining(hits.join(rest.select("id").distinct().hint("merge"), "id", "left_semi"), lost).drop("first"), "left-lines"), rest
    discard(before, old, tried)
    if rest.isEmpty():
        discard(seqs, hits, rest)
        return lost
    held = runs.join(rest.select("h").distinct().hint("merge"), "h", "left_semi").select("h", F.col("id").alias("first"))
    held = keep(held.join(held.groupBy("h").agg(F.count("*").alias("n")), "h"), "holders")
    most, reach = held.agg(F.max("n")).first()[0], HOLDERS
    while True:
        near = held.where(F.pmod(F.xxhash64("first", "h"), F.ceil(F.col("n") / reach)) == 0)
        pairs = rest.join(near, "h").where("first < id").select("id", "first").distinct()
        lost, before = keep(merged(lost.unionByName(aligned(pairs))), "lost-lines"), lost
        discard(before)
        if reach < most:
            rest, before = keep(remaining(hits.join(rest.select("id").distinct(), "id", "left_semi"), lost).drop("first"), "left-lines"), rest
            discard(before)
        if reach >= most or rest.isEmpty():
            discard(seqs, hits, held, rest)
            return lost
        reach *= HOLDERS


def drop_places(text: str, places: list[int] | None) -> str:
    if not places:
        return text
    numbers, _, _ = entries(text)
    gone = {numbers[p] for p in places if p < len(numbers)}
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)


def dedup_lines(docs: DataFrame, least: int = BLOCK_CHARS, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row, its text without the blocks of lines that an earlier document (a smaller id) holds in the same order.

    Lines are compared without white space at their ends; blank lines neither
    match nor part a block. Ids are distinct; rows with a null id are compared
    with nothing. Null stays null, an empty text stays empty. A text all of
    whose lines go becomes what blank lines it has. Very long texts are read
    whole; further columns, whatever their names, stay as they are; an empty
    table gives an empty table. digest: doc_id, n_lines
    (not blank), n_removed, kept_chars and kept_sha256 instead of the input's
    columns.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own, gone = unused(docs, "later_id"), unused(docs, "lost_places")
    lost = repeated_lines(source, least).select(F.col("id").alias(own), F.col("places").alias(gone))

    if digest:

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    kept = drop_places(text or "", places)
                    rows.append((len(entries(text or "")[0]), len(places or ()), len(kept), hashlib.sha256(kept.encode("utf-8", "replace")).hexdigest()))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_lines", "n_removed", "kept_chars", "kept_sha256"])

        return source.join(lost.hint("merge"), source["id"] == lost[own], "left").select("id", "text", gone).mapInArrow(released(sums), "doc_id long, n_lines long, n_removed long, kept_chars long, kept_sha256 string")

    names = docs.columns
    where = names.index(text_col)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not p or t is None else drop_places(t, p) for t, p in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == where else batch.column(k) for k in range(len(names))], names)

    return docs.join(lost.hint("merge"), docs[id_col].cast("long") == lost[own], "left").select(*names, gone).mapInArrow(released(strip), docs.schema)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), digest=True)
