"""Quality classifier: a byte-level convolutional network in numpy.

A text is a run of bytes, cut into overlapping chunks that together cover all
of it. Filters of WIDTH bytes slide over each chunk; their rectified responses
are max-pooled over the chunk. A document is the mean and the greatest of its
chunks' pooled responses, and a logistic unit makes one probability of both.
A filter is learned as a table of one weight per offset and byte, which is an
embedding and a convolution in one, so a response is a sum of looked-up rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marginalia.llm.blocks import byte_blocks, released
from marginalia.session import table

#: Filters and their width in bytes; chunk length and step in bytes.
FILTERS, WIDTH = 24, 8
CHUNK, CHUNK_STEP = 512, 448
#: Labelled documents that are learned from at most, chosen by the hash of their id, and passes over them.
TRAIN_ROWS, EPOCHS = 2500, 10
#: Bytes of text that are learned from at most; documents are taken in the same order while they fit.
TRAIN_BYTES = 64 << 20
#: The remainder of crc32(doc_id) mod 4 that is held out, and the score from which a document is predicted good.
HELD_OUT, GOOD = 2, 0.7


@dataclass
class Network:
    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    weights: np.ndarray  # (2 * FILTERS,)
    offset: float


def chunk_starts(size: int) -> np.ndarray:
    """Starts of the chunks; the last ends where the text ends and every byte is in one."""
    if size <= CHUNK:
        return np.zeros(1, np.int64)
    starts = np.arange(0, size - CHUNK, CHUNK_STEP)
    return np.append(starts, size - CHUNK)


def apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with WIDTH zeros behind each, so that no filter reaches into the next row, and where each row begins."""
    begin = offsets[:-1] + WIDTH * np.arange(len(offsets) - 1)
    out = np.zeros(int(offsets[-1]) + WIDTH * len(begin), np.uint8)
    for b, i, j in zip(begin, offsets[:-1], offsets[1:], strict=True):
        out[b : b + j - i] = data[i:j]
    return out, begin


def pooled(net: Network, data: np.ndarray, begin: np.ndarray, size: np.ndarray, positions: bool = False):
    """Each chunk's greatest rectified response per filter and, if asked, the byte where it was; data is that of apart()."""
    top = np.zeros((len(begin), FILTERS), np.float32)
    best = np.zeros((len(begin), FILTERS), np.int64)
    for i in range(0, len(begin), 64):
        b, s = begin[i : i + 64], size[i : i + 64]
        at = b[:, None] + np.arange(max(1, int(s.max())))[None, :]
        inside = at < (b + np.maximum(s, 1))[:, None]
        at = np.minimum(at, len(data) - WIDTH)
        total = np.broadcast_to(net.bias, (*at.shape, FILTERS)).copy()
        for k in range(WIDTH):
            total += net.tables[k][data[at + k]]
        total[~inside] = -np.inf
        where = total.argmax(axis=1)
        value = np.take_along_axis(total, where[:, None, :], axis=1)[:, 0, :]
        top[i : i + 64] = np.maximum(value, 0)
        if positions:
            best[i : i + 64] = np.take_along_axis(at, where, axis=1)
    return (top, best) if positions else top


def document_vectors(net: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean and greatest of the pooled responses of each row, first chunk of each row)."""
    starts = [chunk_starts(int(n)) for n in np.diff(offsets)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in starts])])
    data, rows = apart(data, offsets)
    begin = np.concatenate([s + o for s, o in zip(starts, rows, strict=True)])
    end = np.minimum(begin + CHUNK, np.repeat(rows + np.diff(offsets), np.diff(first)))
    top = pooled(net, data, begin, end - begin)
    mean = np.add.reduceat(top, first[:-1], axis=0) / np.diff(first)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(top, first[:-1], axis=0)], axis=1), first


def scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) < 2:
        return np.zeros(0)
    x, _ = document_vectors(net, data, offsets)
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64) @ net.weights + net.offset, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3, rate: float = 0.01) -> Network:
    """Learns filters and unit by Adam over small batches; a max passes its gradient to the byte where it was."""
    r = np.random.default_rng(seed)
    net = Network((r.standard_normal((WIDTH, 256, FILTERS)) * 0.15).astype(np.float32), np.zeros(FILTERS, np.float32), (r.standard_normal(2 * FILTERS) * 0.1), 0.0)
    if not len(texts) or labels.min() == labels.max():
        net.offset = 0.0 if not len(texts) else (5.0 if labels[0] else -5.0)
        return net
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = [net.tables, net.bias, net.weights, np.zeros(1)]
    moments = [(np.zeros_like(p, np.float32), np.zeros_like(p, np.float32)) for p in params]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), 50):
            batch = order[i : i + 50]
            data = np.frombuffer(b"".join(texts[k] for k in batch), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[k]) for k in batch])])
            starts = [chunk_starts(int(n)) for n in np.diff(offsets)]
            first = np.concatenate([[0], np.cumsum([len(s) for s in starts])])
            data, rows = apart(data, offsets)
            begin = np.concatenate([s + o for s, o in zip(starts, rows, strict=True)])
            end = np.minimum(begin + CHUNK, np.repeat(rows + np.diff(offsets), np.diff(first)))
            top, best = pooled(net, data, begin, end - begin, positions=True)
            chunks = np.diff(first)
            mean = np.add.reduceat(top, first[:-1], axis=0) / chunks[:, None]
            high = np.maximum.reduceat(top, first[:-1], axis=0)
            x = np.concatenate([mean, high], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ net.weights + params[3][0], -30, 30)))
            error = (p - labels[batch]) * weight[batch] / len(batch)
            back = error[:, None] * net.weights[None, :]
            owner = np.repeat(np.arange(len(batch)), chunks)
            to_top = (back[:, :FILTERS] / chunks[:, None])[owner]
            to_top = to_top + np.where(top == high[owner], back[:, FILTERS:][owner], 0)
            to_top = np.where(top > 0, to_top, 0).astype(np.float32)
            g_tables = np.zeros_like(net.tables)
            column = np.broadcast_to(np.arange(FILTERS), best.shape)
            for k in range(WIDTH):
                flat = data[best + k].astype(np.int64) * FILTERS + column
                g_tables[k] = np.bincount(flat.reshape(-1), to_top.reshape(-1), 256 * FILTERS).reshape(256, FILTERS)
            grads = [g_tables, to_top.sum(axis=0), x.T @ error + 1e-4 * net.weights, np.asarray([error.sum()])]
            step += 1
            lr = rate * (1 - epoch / epochs) + 1e-4
            for param, grad, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(param.dtype)
    # Classes were weighted evenly; the offset goes back to how often labels are 1.
    net.offset = float(params[3][0] + np.log(share / (1 - share)))
    return net


HELD_OUT_SQL = f"(pmod(crc32(cast(cast(id as string) as binary)), 4) = {HELD_OUT})"


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network learned from at most `rows` labelled documents of at most `size` bytes in all, outside the held-out quarter, those with the least id hashes.

    Ids without a label, and null ids and labels, are not learned from; a
    document labelled both ways is left out, a repeated one counts once. Null
    text counts as empty. No labels give a network that scores 0.5. Further
    columns, whatever their names, are not read.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    marked = marked.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most and not " + HELD_OUT_SQL)
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(rows).select("id", "y")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sizes = texts.select("id", F.octet_length("text").alias("n")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.max("n").alias("n")).orderBy(F.xxhash64("id"), "id").collect()
    ends = np.cumsum([r["n"] for r in sizes])
    taken = {r["id"]: float(r["y"]) for r, end in zip(sizes, ends, strict=True) if end <= size}
    if not taken:
        return fit([], np.zeros(0))
    ids = docs.sparkSession.createDataFrame([(i,) for i in taken], "id long")
    got = sorted(texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.max("text").alias("text")).collect())
    return fit([r["text"].encode() for r in got], np.asarray([taken[r["id"]] for r in got]))


def score_documents(docs: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The input's rows and columns with a score from 0 to 1 of each whole text.

    Null counts as empty; an empty text is one chunk of zeros, and all of them
    get the same score. Very long texts are scored over all their chunks;
    repeated rows are independent; an empty table gives an empty table. A
    column that already has the score's name is replaced.
    """
    docs = docs.drop(score_col)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((net.tables, net.bias, net.weights, net.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(*shared.value)
        where = names.index(text_col)
        for batch in batches:
            parts = [scores(model, data, offsets) for _, _, data, offsets in byte_blocks(batch.column(where))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], [*names, score_col])

    return docs.mapInArrow(released(run), StructType([*docs.schema, StructField(score_col, DoubleType())]))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of documents; null text is empty, a null id is in no part (held_out null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = learn(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    # The text ends where it is scored: only the other columns go back to the JVM.
    shared = spark.sparkContext.broadcast((net.tables, net.bias, net.weights, net.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(*shared.value)
        for batch in batches:
            parts = [scores(model, data, offsets) for _, _, data, offsets in byte_blocks(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "held_out", "score"])

    out = rows.mapInArrow(released(run), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
