"""Periodic runs of words by an all-lag vectorised scan.

The word ids of a batch of documents lie one behind the other, the longest
document first, so that those long enough for a shift are a prefix and each
shift is one numpy comparison for all of them. A shift is compared at probes
first: a stretch that is long enough must hold one of the windows of a few
words that begin at every step-th place, so where none of them agrees the
shift has no stretch. Where one does, the document is compared with the shift
in full and the true stretches are run-length encoded. A stretch with a shorter
period is brought down to it, and its multiples are not looked at again.

A document of more than PART_BYTES is dealt: Spark makes a row for each of its
ranges of shifts, sends them to as many tasks and gathers the runs they find.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.blocks import released, text_slices
from marginalia.session import spread, table

#: Least exponent and length of a run, words of a probe.
EXPONENT, LEAST, PROBE = 4, 6, 16
#: Bytes of text for which one task takes all shifts, and bytes of short documents scanned together.
PART_BYTES, SCAN_BYTES = 1 << 20, 4 << 20
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def smallest_period(words: np.ndarray, period: int) -> int:
    """The smallest period of words that have this one and are at least twice as long: it divides the one given."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor:
            factor += 1
            continue
        rest //= factor
        shorter = period // factor
        if np.array_equal(words[:-shorter], words[shorter:]):
            period = shorter
    return period


def stretches(words: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal stretches of at least `least` places where a word equals the one `lag` later."""
    same = np.zeros(len(words) - lag + 2, np.int8)
    same[1:-1] = words[:-lag] == words[lag:]
    edges = np.flatnonzero(np.diff(same))
    starts, ends = edges[0::2], edges[1::2]
    on = ends - starts >= least
    return starts[on], ends[on]


def scan(words: np.ndarray, sizes: np.ndarray, low: int = 1, high: int | None = None) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of documents that lie one behind the other, longest first, found at shifts low <= lag < high.

    Equal numbers are equal words of one document; no number is in two.
    """
    starts = np.cumsum(sizes) - sizes
    found: list[dict[tuple[int, int], int]] = [{} for _ in sizes]
    known: list[dict[int, list[tuple[int, int]]]] = [{} for _ in sizes]
    if not len(sizes):
        return []
    high = min(int(sizes[0]) // EXPONENT + 1, high or 1 << 62)
    for lag in range(low, high):
        shortest = max(LEAST, EXPONENT * lag)
        live = int(np.searchsorted(-sizes, -shortest, side="right"))
        if not live:
            break
        total, least = int(starts[live - 1] + sizes[live - 1]) - lag, shortest - lag
        width = min(least, PROBE)
        step = least - width + 1
        probes = (total - width) // step + 1
        if probes <= 0:
            continue
        ahead = words[lag:]
        at = np.flatnonzero(words[: total : step][:probes] == ahead[: total : step][:probes]) * step
        for k in range(1, width):
            if not len(at):
                break
            at = at[words[at + k] == ahead[at + k]]
        if not len(at):
            continue
        docs = np.searchsorted(starts, at, side="right") - 1
        for d in np.unique(docs).tolist():
            a, n = int(starts[d]), int(sizes[d])
            places = at[docs == d] - a
            for period, spans in known[d].items():
                if lag % period == 0:
                    for begin, end in spans:
                        places = places[(places < begin) | (places >= end - lag)]
            if not len(places):
                continue
            own = words[a : a + n]
            for begin, end in zip(*(x.tolist() for x in stretches(own, lag, least)), strict=True):
                stop = end + lag
                if (begin, stop - begin) not in found[d]:
                    period = smallest_period(own[begin:stop], lag)
                    found[d][begin, stop - begin] = period
                    known[d].setdefault(period, []).append((begin, stop))
    return [sorted((s, length, p) for (s, length), p in runs.items()) for runs in found]


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query has them: of one document in ten, those from a place on repeat a stretch of it."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def as_numbers(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers of all documents, longest first, their sizes, their order): numbers differ between documents."""
    sizes = np.asarray([len(x) for x in documents], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = [w for k in order.tolist() for w in documents[k]]
    coded = pa.array(flat, pa.large_binary()).dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    wide = np.repeat(np.arange(len(order), dtype=np.int64), sizes[order]) * kinds + coded.indices.to_numpy()
    return (wide.astype(np.int32) if kinds * len(order) < 1 << 31 else wide), sizes[order], order


def report(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """A row of the result; the copies of each run's first period are left out of the collapsed text."""
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for s, n, p in runs:
            change[s + p] += 1
            change[s + n] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    said = b"".join(b"%d,%d,%d\n" % r for r in runs)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *four, hashlib.sha256(said).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(8)], names)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, change=rewritten) -> DataFrame:
    """One row per document: its runs, the longest of them and the text without their copies, as digests.

    change(words, id) gives the words to look at; pass `lambda words, _: words`
    for the texts as they are. Null, empty and all-white texts have no words
    and no runs; a null id keeps its row and its words are never changed;
    repeated rows are rows of their own with equal results; ties for the
    longest run go to the smallest start, then period. Very long texts are
    scanned whole, in as many tasks as they have parts. An empty table gives an
    empty table; further columns, whatever their names, are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / part_bytes).cast("long") + 1

    def words_of(batch: pa.RecordBatch) -> list[list[bytes]]:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        return [change((t or b"").split(), i) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for batch in text_slices(many, 1, SCAN_BYTES):
                words = words_of(batch)
                numbers, sizes, order = as_numbers(words)
                runs = dict(zip(order.tolist(), scan(numbers, sizes), strict=True))
                yield _rows([report(i, w, runs[k]) for k, (i, w) in enumerate(zip(batch.column(0).to_pylist(), words, strict=True))])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of one range of shifts of one document a row."""
        for many in batches:
            for k in range(many.num_rows):
                batch = many.slice(k, 1)
                numbers, sizes, _ = as_numbers(words_of(batch))
                part, of = batch.column(2)[0].as_py(), batch.column(3)[0].as_py()
                lags = int(sizes[0]) // EXPONENT
                runs = scan(numbers, sizes, 1 + part * lags // of, 1 + (part + 1) * lags // of)[0]
                packed = np.asarray(runs, "<i8").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), pa.array([packed], pa.binary())], ["k1", "k2", "runs"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for k in range(many.num_rows):
                batch = many.slice(k, 1)
                raw = b"".join(batch.column(2)[0].as_py() or [])
                runs = sorted({tuple(r) for r in np.frombuffer(raw, "<i8").reshape(-1, 3).tolist()})
                yield _rows([report(batch.column(0)[0].as_py(), words_of(batch)[0], runs)])

    short = spread(source.where(parts == 1)).mapInArrow(released(whole), RESULT)
    long_ = source.withColumn("of", parts).where("of > 1").withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(7), "doc_id")})
    dealt = long_.dropDuplicates(["k1", "k2"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1))).repartition("k1", "k2", "part")
    found = dealt.select("doc_id", "text", "part", "of", "k1", "k2").mapInArrow(released(ranges), "k1 long, k2 long, runs binary")
    found = found.groupBy("k1", "k2").agg(F.collect_list("runs").alias("runs"))
    met = long_.join(found.hint("merge"), ["k1", "k2"], "left").select("doc_id", "text", "runs")
    return short.unionByName(met.mapInArrow(released(gathered), RESULT))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
