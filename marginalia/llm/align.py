"""Alignment of the tokens of two vocabularies over the same bytes.

Each Arrow batch is cut into chunks of text, and each chunk into runs that both
vocabularies certainly begin anew at: before a space behind a character that is
no white space, no piece of either goes on. So the different runs of a chunk
are encoded and aligned once. DuckDB does that inside the task: two tables of
token intervals, an ASOF join that brings each A token the B token holding its
last byte, a window sum over the places where both end that numbers the groups,
a range join that gives the B tokens of each group, and joins for the id pairs
of runs and documents.

Per chunk the different pairs are counted by documents; Spark merges these
partial counts, finds each A id's highest, and sends every chunk the counts of
its own pairs. What is shuffled are the pairs of chunks, not those of documents
and no occurrences.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.blocks import give_back, released, text_slices
from marginalia.llm.bpe import loaded, vocabulary
from marginalia.llm.groups import runs as grouped
from marginalia.session import keep, spread, table

#: Bytes of text in a chunk, unless one document has more, bytes that go to a Python worker at once, and encoded runs that a worker keeps.
CHUNK_BYTES, BATCH_BYTES, RUNS_HELD = 4 << 20, 8 << 20, 100_000
#: An id pair as one number: the A id above so many bits of the B id.
B_BITS = 24
ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

cut = re.compile(r"(?<=\S)(?= [\s\S])").split
odd = re.compile(r"\s[ ]| \Z").search

#: Groups of the tokens a and b (run, id, s, e: byte interval): each token, its group numbered in order of bytes.
GROUPS_SQL = """
CREATE OR REPLACE TABLE ga AS
SELECT run, id, a_s AS s, a_e AS e, (sum(ends) OVER (ORDER BY a_e ROWS UNBOUNDED PRECEDING))::BIGINT - ends AS g
FROM (SELECT a.run, a.id, a.s AS a_s, a.e AS a_e, (a.e = b.e)::BIGINT AS ends FROM a ASOF JOIN b ON a.e <= b.e);
CREATE OR REPLACE TABLE spans AS SELECT g, any_value(run) AS run, min(s) AS s, max(e) AS e FROM ga GROUP BY g;
CREATE OR REPLACE TABLE gb AS SELECT spans.run, b.id, b.e, g FROM spans JOIN b ON b.s >= spans.s AND b.s < spans.e;
"""
#: Id pairs of runs and how often tokens of them share a group.
PAIRS_SQL = f"""
CREATE OR REPLACE TABLE run_pairs AS
WITH x AS (SELECT g, any_value(run) AS run, id, count(*) AS n FROM ga GROUP BY g, id),
y AS (SELECT g, id, count(*) AS n FROM gb GROUP BY g, id)
SELECT run, (x.id::BIGINT << {B_BITS}) + y.id AS ab, sum(x.n * y.n)::BIGINT AS n FROM x JOIN y USING (g) GROUP BY ALL
"""
#: Id pairs of documents, given how often each document holds each run.
DOCUMENTS_SQL = "SELECT doc, ab, sum(held.n * run_pairs.n)::BIGINT AS n FROM held JOIN run_pairs USING (run) GROUP BY doc, ab ORDER BY doc, ab"


class Aligner:
    """Two vocabularies, loaded once a Python worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = loaded(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.most_held = RUNS_HELD
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the second vocabulary goes on behind a space: runs can't be cut there")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.asarray([len(x) for x in self.a.tokens], np.int64)
        self.b_sizes = np.asarray([len(x) for x in self.b_bytes], np.int64)
        # Each id with what follows it in the text of the groups: a token of its group, or the end of its side of it.
        self.texts = [b"%d%s" % (i, end) for n, ends in ((len(self.a_sizes), (b",", b"|")), (len(self.b_sizes), (b",", b";"))) for end in ends for i in range(n)]

    def runs(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the different runs without the space each begins with, number of the run at each place, document of each place)."""
        plain = np.asarray([not odd(" " + t) for t in texts], bool)
        full = np.asarray([bool(t) for t in texts], bool)
        split = pc.split_pattern(pa.array([t for t, on in zip(texts, (plain & full).tolist(), strict=True) if on], pa.large_string()), " ")
        others = [[r[1:] for r in cut(" " + t)] for t, on in zip(texts, (~plain & full).tolist(), strict=True) if on]
        coded = pa.concat_arrays([split.flatten().cast(pa.large_string()), pa.array(list(chain.from_iterable(others)), pa.large_string())]).dictionary_encode()
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain & full] = np.diff(split.offsets.to_numpy())
        sizes[~plain & full] = [len(x) for x in others]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        doc = np.repeat(order, sizes[order])
        by_doc = np.argsort(doc, kind="stable")
        return coded.dictionary.to_pylist(), coded.indices.to_numpy()[by_doc].astype(np.int64), doc[by_doc]

    def encode(self, runs: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """((A ids, how many a run), (B ids, how many a run), whether both give back the bytes) of a space and each run."""
        raw = [b" " + r.encode() for r in runs]
        words = np.asarray([r.isascii() and r.isalpha() for r in runs], bool)  # each is one piece of the first vocabulary with its space
        known: list[bytes] = [b""] * len(runs)
        for at, encoded in ((np.flatnonzero(words), lambda k: self.a._of([" " + runs[x] for x in k])), (np.flatnonzero(~words), lambda k: self.a._encode([raw[x] for x in k]))):
            for x, ids in zip(at.tolist(), encoded(at.tolist()), strict=True):  # strings of special tokens are plain text
                known[x] = ids
        a = np.frombuffer(b"".join(known), "<u4").astype(np.int64), np.asarray([len(x) // 4 for x in known], np.int64)
        pieces = self.b.encode(runs, num_threads=1)
        b = np.asarray(list(chain.from_iterable(pieces)), np.int64), np.asarray([len(x) for x in pieces], np.int64)
        return a, b, self._same(raw, a, self.a.tokens, self.a_sizes) & self._same(raw, b, self.b_bytes, self.b_sizes)

    def _same(self, raw: list[bytes], encoded: tuple[np.ndarray, np.ndarray], tokens: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Which runs the joined bytes of their tokens are equal to."""
        ids, counts = encoded
        stops = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        joined, same = b"".join(map(tokens.__getitem__, ids.tolist())), np.diff(stops) == [len(r) for r in raw]
        if not same.all() or joined != b"".join(raw):
            same = np.asarray([joined[x:y] == r for x, y, r in zip(stops[:-1].tolist(), stops[1:].tolist(), raw, strict=True)], bool)
        return same


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


@cache
def database():
    """A DuckDB in this worker's memory, one thread, nothing on disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def _intervals(encoded: tuple[np.ndarray, np.ndarray], sizes: np.ndarray) -> pa.Table:
    """Tokens of all runs, one behind the other, with the bytes they cover."""
    ids, counts = encoded
    ends = np.cumsum(sizes[ids])
    return pa.table({"run": np.repeat(np.arange(len(counts)), counts), "id": ids, "s": ends - sizes[ids], "e": ends})


def _spelled(own: Aligner, a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, stops: np.ndarray) -> list[bytes]:
    """The groups of each run as text with a last `;`: A and B ids (a, b) in order with the groups they are of; stops: ends of the runs in groups."""
    groups = int(stops[-1]) if len(stops) else 0
    in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    before_a, before_b = np.concatenate([[0], np.cumsum(in_a)]), np.concatenate([[0], np.cumsum(in_b)])
    last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
    code = np.zeros(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + before_b[ga]] = a + last_a * len(own.a_sizes)
    code[np.arange(len(b)) + before_a[gb + 1]] = 2 * len(own.a_sizes) + b + last_b * len(own.b_sizes)
    parts = list(map(own.texts.__getitem__, code.tolist()))
    at = [0, *(before_a[stops] + before_b[stops]).tolist()]
    return [b"".join(parts[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]


def align_chunk(texts: list[str], path_a: str, path_b: str) -> dict[str, list]:
    """The columns of ALIGNED behind doc_id for the texts of one chunk."""
    own, db = aligner(path_a, path_b), database()
    runs, flat, doc = own.runs(texts)
    a, b, same = own.encode(runs)
    a, b = ((ids[np.repeat(same, counts)], counts * same) for ids, counts in (a, b))
    ok = np.bincount(doc, weights=~same[flat], minlength=len(texts)) == 0
    doc, flat = doc[ok[doc]], flat[ok[doc]]
    pair, n = np.unique(doc * max(1, len(runs)) + flat, return_counts=True)
    counted = pa.table({"doc": pair // max(1, len(runs)), "run": pair % max(1, len(runs)), "n": n})
    for name, rows in (("a", _intervals(a, own.a_sizes)), ("b", _intervals(b, own.b_sizes)), ("held", counted)):
        db.register(name, rows)
    try:
        db.execute(GROUPS_SQL)
        db.execute(PAIRS_SQL)
        got = db.sql("SELECT g, id FROM ga ORDER BY e").to_arrow_table(), db.sql("SELECT g, id FROM gb ORDER BY e").to_arrow_table()
        per_run = db.sql("SELECT run, count(*) AS n FROM spans GROUP BY run").to_arrow_table()
        links = db.sql("SELECT run, sum(n)::BIGINT AS n FROM run_pairs GROUP BY run").to_arrow_table()
        pairs = db.sql(DOCUMENTS_SQL).to_arrow_table()
    finally:
        for name in ("a", "b", "held"):
            db.unregister(name)
        for name in ("ga", "gb", "spans", "run_pairs"):
            db.execute(f"DROP TABLE IF EXISTS {name}")
    ga, gb = (x.column("g").to_numpy().astype(np.int64) for x in got)
    groups, linked = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
    groups[per_run.column("run").to_numpy()] = per_run.column("n").to_numpy()
    linked[links.column("run").to_numpy()] = links.column("n").to_numpy()
    spelled = _spelled(own, got[0].column("id").to_numpy(), ga, got[1].column("id").to_numpy(), gb, np.cumsum(groups))
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    out: dict[str, list] = {}
    for name, per in (("n_a", a[1]), ("n_b", b[1]), ("n_groups", groups), ("n_links", linked)):
        whole = np.concatenate([[0], np.cumsum(per[flat])])[edges]
        out[name] = np.diff(whole).tolist()
    parts = list(map(spelled.__getitem__, flat.tolist()))
    out["groups_sha256"] = [hashlib.sha256(b"".join(parts[x:y])[:-1]).hexdigest() if x < y else "" for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    bounds = np.searchsorted(pairs.column("doc").to_numpy(), np.arange(len(texts) + 1))
    both = np.stack([pairs.column("ab").to_numpy(), pairs.column("n").to_numpy()]).astype("<i8")
    out["pairs"] = [np.ascontiguousarray(both[:, x:y]).tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return out


def unpacked(pairs: bytes) -> np.ndarray:
    """(id pairs, links) as two rows."""
    return np.frombuffer(pairs, "<i8").reshape(2, -1)


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: tokens, groups and links of both vocabularies, links whose count is their A id's highest, sum of counts, digest of the groups.

    Null and empty texts, and those of which either vocabulary does not give
    back the bytes, have no tokens: zeros and ''. A null id keeps its row.
    Repeated rows are documents of their own and are counted each; ties for the
    highest count all count as best. Very long texts are chunks of their own
    and aligned whole. An empty table gives an empty table; further columns,
    whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for many in batches:
            for batch in text_slices(many, 1, chunk_bytes):
                out = align_chunk([t or "" for t in batch.column(1).to_pylist()], path_a, path_b)
                kinds = {"groups_sha256": pa.string(), "pairs": pa.binary()}
                columns = [pa.array(x, kinds.get(k, pa.int64())) for k, x in out.items()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, chunk)), batch.column(0), *columns], ["chunk", "doc_id", *out])
                chunk += 1
                del out, columns
                give_back()

    def seen_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different pairs of a chunk's documents, and how many of these hold each."""
        for batch in grouped(batches, 1):
            ab, n = np.unique(np.concatenate([unpacked(x)[0] for x in batch.column(1).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ab), batch.column(0)[0].as_py())), pa.array(ab), pa.array(n)], ["chunk", "ab", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a chunk, the counts of its pairs first."""
        for batch in grouped(batches, 1):
            told = int(np.searchsorted(batch.column(1).to_numpy(), 1))
            ab = batch.column(2).slice(0, told).to_numpy().astype(np.int64)
            n, best = (batch.column(c).slice(0, told).to_numpy().astype(np.int64) for c in (3, 4))
            rows = batch.slice(told)
            n_best, total = [], []
            for x in rows.column(batch.num_columns - 1).to_pylist():
                pairs, links = unpacked(x)
                at = np.searchsorted(ab, pairs)
                n_best.append(int((links * best[at]).sum()))
                total.append(int((links * n[at]).sum()))
            c = [rows.column(k) for k in range(5, 11)]
            yield pa.RecordBatch.from_arrays([*c[:5], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), c[5]], [x.split()[0] for x in RESULT.split(", ")])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    aligned = keep(spread(source).mapInArrow(released(run), ALIGNED), "aligned", batch_bytes=BATCH_BYTES)
    seen = keep(aligned.select("chunk", "pairs").mapInArrow(released(seen_pairs), "chunk long, ab long, n long"), "pairs", batch_bytes=BATCH_BYTES)
    counts = seen.groupBy("ab").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("ab", B_BITS))
    # An A id has at most as many pairs as the second vocabulary has pieces.
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    judged = counts.join(top.hint("merge"), "a").select("ab", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    told = seen.select("chunk", "ab").distinct().join(judged.hint("merge"), "ab").select("chunk", F.lit(0).alias("kind"), "ab", "n", "best")
    rows = told.unionByName(aligned.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "kind", "ab")
    return rows.select("chunk", "kind", "ab", "n", "best", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs").mapInArrow(released(summed), RESULT)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
