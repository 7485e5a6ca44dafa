"""BPE encoding and decoding by forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged over, so
a cut between its two bytes is certain: both sides are encoded alone and the
ids are concatenated. A text is split at special tokens and into the pieces of
the vocabulary's pattern, and each piece at every forced pair, in all scripts;
fragments are merged by rank. Pieces repeat, and a bounded table of encoded
ones does most of the work.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.blocks import released, text_slices
from marginalia.session import table

#: Encoded pieces in the table of a Python worker; beyond it a new one is begun and the old one is kept to look up what comes again.
FRAGMENTS_HELD = 250_000
#: Pieces of a lower-cased text of the word vocabulary (a fixed value of that file).
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces of a text of the byte-level vocabulary (a fixed value of that file).
GPT_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Characters beyond the Latin letters that all tables agree on, and those that some count as white space.
ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u024f]").search
#: A byte that UTF-8 never uses stands for the end of a word.
END = b"\xff"
#: Characters for the end of a word and between fragments in a text of many ASCII fragments, and their ranks, below those of merges.
MARK, PART, MARKED, PARTED = "\x80", "\x81", 600, 601


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; a path to a file is returned as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the byte-level alphabet -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of counts[k] entries for each k, one behind the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class ForcedBoundaryBPE:
    """Encodes and decodes whole texts, given as UTF-8 bytes, with one vocabulary file of the tokenizers library.

    A vocabulary with an end-of-word suffix drops white space and lower-cases;
    the runs between white space are looked up whole. Where characters are too
    new for the pattern here, the library's own normalizer and splitter give
    the pieces; merging is done here for all of them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, suffix = byte_symbols(), spec["model"].get("end_of_word_suffix") or ""
        vocab = spec["model"]["vocab"]

        def raw(token: str) -> bytes:
            ends = bool(suffix) and token.endswith(suffix)
            return bytes(symbols[c] for c in (token[: len(token) - len(suffix)] if ends else token)) + END * ends

        self.tokens: list[bytes] = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            self.tokens[i] = raw(token).removesuffix(END)
            b = np.frombuffer(self.tokens[i], np.uint8)
            inside[b[:-1], b[1:]] = True
        self.special = {x["content"].encode(): np.asarray([x["id"]], "<u4").tobytes() for x in spec.get("added_tokens", [])}
        for x in spec.get("added_tokens", []):
            self.tokens[x["id"]] = x["content"].encode()
        self.at_special = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + b")").split
        #: forced[a, b]: no token holds byte a followed by byte b.
        self.forced = ~inside
        # Ranks: bytes, bytes that end a word, merges in their order.
        ranks = {bytes([b]): b for b in range(256)}
        if suffix:
            ranks |= {bytes([b]) + END: 256 + b for b in range(255)}
        for k, (x, y) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            ranks.setdefault(raw(x + y), 1000 + k)
        by_raw = {raw(t): i for t, i in vocab.items()}
        self.of_rank = np.zeros(max(ranks.values()) + 1, "<u4")
        for token, rank in ranks.items():
            self.of_rank[rank] = by_raw.get(token, 0)
        self.merge = tiktoken.Encoding("own", pat_str="x", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        # The same for many ASCII fragments in one text: characters beyond ASCII stand for word ends and part them.
        own = {t[:-1] + MARK.encode() if t.endswith(END) and len(t) > 1 else t: r for t, r in ranks.items()} | {MARK.encode(): MARKED, PART.encode(): PARTED}
        self.merge_all = tiktoken.Encoding("own", pat_str=f"[^{PART}]+|{PART}", mergeable_ranks=own, special_tokens={})._core_bpe.encode_ordinary
        self.words, self.held, self.older, self.most_held = bool(suffix), {}, {}, FRAGMENTS_HELD
        self.pieces = regex.compile(WORD_PIECES if suffix else GPT_PIECES).findall
        self.old: dict[str, bool] = {}

    def fragments(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """(the pieces cut at every forced pair, number of fragments of each piece); none is empty."""
        b = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        cut = np.zeros(len(b), bool)  # after which bytes
        cut[:-1] = self.forced[b[:-1], b[1:]]
        cut[ends - 1] = True
        stops = np.flatnonzero(cut) + 1
        whole, stop = b.tobytes(), stops.tolist()
        parts = [whole[x:y] for x, y in zip([0, *stop[:-1]], stop, strict=True)]
        return parts, np.diff(np.searchsorted(stops, ends, side="right"), prepend=0)

    def _learn(self, runs: list) -> dict:
        """The ids of runs: pieces of the pattern, or runs between white space and all their pieces."""
        if self.words:
            found = [[run] if run.isalpha() else [p.encode() for p in self._split(run.decode())] for run in runs]
            pieces, per_run = list(chain.from_iterable(found)), list(map(len, found))
        else:
            pieces, per_run = [run.encode() for run in runs], [1] * len(runs)
        if pieces:
            parts, per_piece = self.fragments(pieces)
            last = np.zeros(len(parts), bool)
            if self.words:
                last[np.cumsum(per_piece) - 1] = True
            ranks, counts = self._merged(parts, last)
            sizes = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per_piece)])]
            ids = self.of_rank[ranks].tobytes()
        else:
            sizes, ids = np.zeros(1, np.int64), b""
        at = (4 * sizes[np.concatenate([[0], np.cumsum(per_run)]).astype(int)]).tolist()
        return {run: ids[x:y] for run, x, y in zip(runs, at[:-1], at[1:], strict=True)}

    def _merged(self, parts: list[bytes], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks of all fragments one behind the other, their number in each); last: fragments that end a word."""
        plain = np.fromiter((p.isascii() for p in parts), bool, len(parts))
        ends = [PART, MARK + PART]
        text = "".join([p.decode() + ends[e] for p, e, on in zip(parts, last.tolist(), plain.tolist(), strict=True) if on])
        mine = np.asarray(self.merge_all(text), np.int64)
        stops = np.flatnonzero(mine == PARTED)
        other = [self.merge(p + END * e) for p, e, on in zip(parts, last.tolist(), plain.tolist(), strict=True) if not on]
        counts = np.zeros(len(parts), np.int64)
        counts[plain] = np.diff(stops, prepend=-1) - 1
        counts[~plain] = [len(x) for x in other]
        out, starts = np.zeros(int(counts.sum()), np.int64), np.cumsum(counts) - counts
        out[ragged(starts[plain], counts[plain])] = mine[mine != PARTED]
        out[ragged(starts[~plain], counts[~plain])] = list(chain.from_iterable(other))
        return out, counts

    def _known(self, text: str) -> bool:
        """Whether all characters are assigned in this Python's tables, so that all tables agree on them."""
        new = set(text).difference(self.old)
        if len(self.old) > self.most_held:
            self.old.clear()
        self.old |= {c: unicodedata.category(c) != "Cn" for c in new}
        return all(map(self.old.get, set(text)))

    def _split(self, text: str) -> list[str]:
        """Pieces of a text, or of a run between white space, normalized as the vocabulary asks."""
        if self.words:
            if not ODD(text):
                return self.pieces(text.lower())
            text = self.tokenizer.normalizer.normalize_str(text)
        elif text.isascii() or self._known(text):
            return self.pieces(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _of(self, runs: list) -> list[bytes]:
        """The ids of different runs, from the table or learned at once."""
        found = list(map(self.held.get, runs))
        missed = [run for run, ids in zip(runs, found, strict=True) if ids is None]
        before = list(map(self.older.get, missed))
        fresh = dict(zip(missed, before, strict=True)) | self._learn([run for run, ids in zip(missed, before, strict=True) if ids is None])
        if len(self.held) + len(fresh) > self.most_held:
            self.older, self.held = self.held, {}
        self.held |= fresh
        return [fresh[run] if ids is None else ids for run, ids in zip(runs, found, strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; what is new in all of them is learned at once."""
        whole = [k for k, t in enumerate(texts) if not any(x in t for x in self.special)]
        out = dict(zip(whole, self._encode([texts[k] for k in whole]), strict=True))
        for k, t in enumerate(texts):
            if k not in out:  # special tokens are ids of their own
                out[k] = b"".join(self.special[part] if part in self.special else self._encode([part])[0] for part in self.at_special(t) if part)
        return [out[k] for k in range(len(texts))]

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        """Texts without special tokens: their runs as numbers into the table of the different ones, and those back as ids."""
        if not texts:
            return []
        if self.words:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.large_string())))
            coded = lists.flatten().dictionary_encode()
            runs, code, bounds = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy()
        else:
            split = [self._split(t.decode()) for t in texts]
            number: dict[str, int] = {}
            code = np.asarray([number.setdefault(run, len(number)) for runs in split for run in runs], np.int64)
            runs, bounds = list(number), np.concatenate([[0], np.cumsum([len(x) for x in split])])
        known = self._of(runs)
        counts = np.asarray([len(x) // 4 for x in known], np.int64)
        starts, ids = np.cumsum(counts) - counts, np.frombuffer(b"".join(known), "<u4")
        ends = 4 * np.concatenate([[0], np.cumsum(counts[code])])[bounds]
        raw = ids[ragged(starts[code], counts[code])].tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def loaded(path: str) -> ForcedBoundaryBPE:
    """The vocabulary of a file, read once a Python worker, with the runs that its tasks have met."""
    return ForcedBoundaryBPE(path)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the encoded ids (binary, little-endian uint32) and the decoded text.

    Null text counts as empty: no ids, empty text. Every row of the input is a
    row of the output, repeated ids included; other columns are not read.
    No shuffle: a narrow map over the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for whole in batches:
            for batch in text_slices(whole, 1):
                ids = bpe.encode(texts_of(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())],
                    ["id", "ids", "decoded"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), "id long, ids binary, decoded string")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents() reduced to counts and digests inside the same Python pass.

    The ids and the decoded text are hashed where they are made, so neither
    goes back to the JVM. Null counts as empty; very long texts are encoded
    whole; repeated rows are independent; an empty table gives an empty table;
    further columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for whole in batches:
            for batch in text_slices(whole, 1):
                n, a, b = [], [], []
                for ids in bpe.encode(texts_of(batch.column(1))):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
