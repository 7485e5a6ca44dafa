"""Near-duplicate vectors, periodic runs and token alignment against brute-force versions, with odd rows of all kinds."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm import align, periods, pigeonhole, registry
from marginalia.llm.bpe import byte_symbols, vocabulary

VECTORS = "vec_id long, embedding array<double>, id string, g int, v array<double>, n_links long"
DOCS = "doc_id long, text string"

# 11


def planted(seed, dim, groups, size, alone):
    """(id, vector): tight groups, chains of steps just within reach, copies, scaled copies and vectors alone."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = r.normal(size=dim)
        for _ in range(size):
            rows.append(base + r.normal(size=dim) * np.sqrt(base @ base / dim) * r.choice([0.02, 0.15, 0.2]))
    step = r.normal(size=dim)
    for _ in range(12):  # each is like the next one, the ends are not alike
        rows.append(step := step + r.normal(size=dim) * 0.3 * np.sqrt(step @ step / dim))
    rows += [r.normal(size=dim) for _ in range(alone)]
    rows += [rows[0], rows[0], rows[0] * 3.0, rows[1] * 1e200, rows[2] * 1e-200]
    order = r.permutation(len(rows))
    return [(int(i), rows[k].tolist()) for i, k in enumerate(order)]


def links_of(rows, least):
    """vec_id -> (links, component) by all pairs, for rows of distinct ids."""
    ids = sorted(i for i, _ in rows)
    good = {i: np.asarray(v, float) for i, v in rows if v and None not in v and np.isfinite(np.asarray(v, float)).all() and any(v)}
    parent, count = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(good)
    unit = {i: (v := good[i] / np.abs(good[i]).max()) / np.sqrt(v @ v) for i in keys}
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                count[a] += 1
                count[b] += 1
                i, j = root(a), root(b)
                parent[max(i, j)] = min(i, j)
    return {i: (count[i], root(i)) for i in ids}


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", 1, v, 9) for i, v in rows], VECTORS).repartition(3)
    return [tuple(r) for r in pigeonhole.near_vectors(df, **how).collect()]


@pytest.mark.parametrize("dim,cell,tile,least,width", [(64, 8192, 4096, 0.95, 8), (64, 16, 8, 0.95, 8), (19, 32, 16, 0.9, 4), (3, 16, 4096, 0.99, 8), (1, 64, 64, 0.95, 8)])
def test_near_vectors(spark, dim, cell, tile, least, width):
    rows = planted(dim, dim, 6, 12, 80)
    want = links_of(rows, least)
    got = found(spark, rows, cell=cell, tile=tile, least=least, width=width)
    assert {(i, n, c, k) for i, n, c, k in got} == {(i, n, c, i == c) for i, (n, c) in want.items()} and len(got) == len(rows)


def test_near_vectors_of_odd_rows(spark):
    one, nan, inf = [1.0, 0.0, 0.5], float("nan"), float("inf")
    rows = [(1, one), (2, one), (2, one), (3, None), (4, []), (5, [0.0, -0.0, 0.0]), (6, [1.0, None, 0.5]), (7, [1.0, nan, 0.5]), (8, [inf, 0.0, 0.5]), (9, [1.0, 0.0]), (10, [1.0, -0.0, 0.5]), (None, one)]
    got = found(spark, rows)
    assert sorted(got, key=str) == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (10, 2, 1, False), (None, 0, None, True)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)], key=str)
    assert found(spark, []) == []


def test_cells_and_visits_cover_pairs_in_range():
    r = np.random.default_rng(1)
    points, budget = r.normal(size=(400, 4)), 0.4
    cells = pigeonhole.Cells(points[:150], 32)
    home = cells.home(points)
    who, box = cells.visits(points, home, budget)
    at = {(int(h), k) for k, h in enumerate(home)} | {(int(b), int(k)) for k, b in zip(who, box, strict=True)}
    x, y = np.nonzero(((points[:, None] - points[None]) ** 2).sum(axis=2) <= budget)
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        low, high = (i, j) if home[i] <= home[j] else (j, i)
        assert (int(home[low]), high) in at
    assert len(at) < 32 * 400


def test_pigeonhole_prunes_pairs():
    """A block's budget leaves few pairs to verify."""
    r = np.random.default_rng(2)
    v = r.normal(size=(600, 64))
    y = (v / np.sqrt((v * v).sum(axis=1))[:, None]).astype(np.float32)
    code = np.rint(y * pigeonhole.STEPS).astype(np.int8)
    left = [len(pigeonhole.near(y[:, a:b], y[:, a:b], 0.1 * (b - a) / 64, code, code, 0.1, True)[0]) for a, b in pigeonhole.blocks_of(64, 8)]
    assert sum(left) < 0.001 * 600 * 600


# 12


def runs_of(w):
    """Every run (start, length, period) by definition."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = j
    return sorted(out)


def by_definition(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(w)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_of(w)
    kept = [x for i, x in enumerate(w) if not any(s + p <= i < s + length for s, length, p in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(runs), *four, sha("".join(f"{s},{n_},{p}\n" for s, n_, p in runs)), sha(" ".join(kept))


def sayings(seed, n):
    r, out = random.Random(seed), []
    for k in range(n):
        size, kinds = r.choice([0, 1, 5, 7, 40, 90]), r.choice([1, 2, 3, 30])
        w = [f"w{r.randrange(kinds)}" for _ in range(size)]
        if size > 20 and r.random() < 0.7:
            for _ in range(r.randrange(1, 3)):
                p, a = r.randrange(1, 7), r.randrange(size - 8)
                stop = min(size, a + p * r.randrange(3, 8) + r.randrange(p))
                w[a:stop] = [w[a + i % p] for i in range(stop - a)]
        out.append((k, r.choice([" ", "\n", "\t \x0b"]).join(w)))
    return out


def test_runs_by_definition():
    texts = [t.encode().split() for _, t in sayings(5, 400)]
    numbers, sizes, order = periods.as_numbers(texts)
    for k, runs in zip(order.tolist(), periods.scan(numbers, sizes), strict=True):
        assert runs == runs_of(texts[k])


@pytest.mark.parametrize("low,high", [(1, 4), (4, 9), (9, 23)])
def test_ranges_of_shifts(low, high):
    """A range of shifts finds the runs whose period or a multiple of it, as far as the run allows, lies in it."""
    texts = [t.encode().split() for _, t in sayings(6, 200)]
    numbers, sizes, order = periods.as_numbers(texts)
    for k, runs in zip(order.tolist(), periods.scan(numbers, sizes, low, high), strict=True):
        assert runs == [(s, n, p) for s, n, p in runs_of(texts[k]) if any(q % p == 0 and n >= max(6, 4 * q) for q in range(low, high))]


@pytest.mark.parametrize("part", [1 << 20, 64])
def test_periodic_runs(spark, part):
    rows = [*sayings(7, 150), (900, None), (901, ""), (902, " \n"), (None, "a " * 9), (903, "one two " * 7), (904, "x " * 30), (904, "x " * 30), (904, "y " * 31)]
    got = [tuple(r) for r in periods.periodic_runs(spark.createDataFrame(rows, DOCS), part_bytes=part).collect()]
    assert sorted(got, key=str) == sorted((by_definition(i, t) for i, t in rows), key=str)
    assert any(by_definition(i, t)[1] > 1 for i, t in rows)


def test_periodic_runs_of_long_and_no_texts(spark):
    r = random.Random(8)
    w = [f"w{r.randrange(50)}" for _ in range(30_000)]
    w[5_000:17_000] = [w[5_000 + i % 2_500] for i in range(12_000)]
    rows = spark.createDataFrame([(3, " ".join(w), 1)], "Doc_id long, Text string, of int").select("doc_id", "text", "of")
    got = periods.periodic_runs(rows, part_bytes=20_000, change=lambda x, _: x).first()
    assert (got["start"], got["length"], got["period"]) == next((s, n, 2_500) for s, n in [(got["start"], got["length"])] if s <= 5_000 and s + n >= 17_000)
    assert got["exponent_milli"] == 1000 * got["length"] // 2_500
    assert periods.periodic_runs(rows.limit(0)).count() == 0


# 13

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def aligned(rows):
    """The result by the libraries and by definition."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b, symbols = sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), byte_symbols()
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows_, docs = [], defaultdict(set)
    for k, (_, t) in enumerate(rows):
        x, y, whole = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t), (" " + t).encode()) if t else ([], [], b"")
        in_a, in_b = [bytes(symbols[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if not t or b"".join(in_a) != whole or b"".join(in_b) != whole:
            rows_.append((0, 0, 0, Counter(), ""))
            continue
        ends_a, ends_b = np.cumsum([len(z) for z in in_a]), np.cumsum([len(z) for z in in_b])
        ends = np.intersect1d(ends_a, ends_b)
        ga, gb = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        links, groups = Counter(), []
        for g in range(len(ends)):
            p, q = [i for i, o in zip(x, ga, strict=True) if o == g], [i for i, o in zip(y, gb, strict=True) if o == g]
            groups.append(",".join(map(str, p)) + "|" + ",".join(map(str, q)))
            links.update((i, j) for i in p for j in q)
        for pair in links:
            docs[pair].add(k)
        rows_.append((len(x), len(y), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count, top = {p: len(d) for p, d in docs.items()}, Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return [(i, n_a, n_b, g, sum(links.values()), sum(w for p, w in links.items() if count[p] == top[p[0]]), sum(w * count[p] for p, w in links.items()), sha) for (i, _), (n_a, n_b, g, links, sha) in zip(rows, rows_, strict=True)]


def texts_for_alignment(seed, n):
    r = random.Random(seed)
    alphabet = "ab \n\t 　é'sЖ日1!▁<\x85 "
    rows = [(1, None), (2, ""), (3, " "), (4, "  "), (5, "a "), (6, " a  b \n c\t d \n\n  e"), (7, "x<s>y</s><unk> <|endoftext|> z"), (8, "日本語のテキスト 漢字"), (9, "a▁b"), (10, "<0x41> \x00 x"), (11, "abcdefgh" * 300), (12, "words " * 5000), (13, "same text"), (13, "same text"), (None, "no id"), (14, "\x1c  a\x85 b"), (15, "ﬁ é é ‍ 👩‍👩‍👧")]
    return rows + [(100 + k, "".join(r.choice(alphabet) for _ in range(r.randint(1, 12)))) for k in range(n)]


@pytest.mark.parametrize("chunk", [200, 4 << 20])
def test_alignment(spark, chunk):
    rows = texts_for_alignment(9, 400)
    df = spark.createDataFrame([(*x, "t", 1) for x in rows], DOCS + ", pairs string, chunk int").repartition(3)
    got = [tuple(r) for r in align.align_documents(df, *PATHS, chunk_bytes=chunk).collect()]
    assert sorted(got, key=str) == sorted(aligned(rows), key=str)


def test_alignment_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in registry.QUERIES["op13_align"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(aligned(rows))
    assert align.align_documents(docs.limit(0), *PATHS).count() == 0


def test_query_of_runs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r) for r in registry.QUERIES["op12_periods"](spark, sf_dir).collect()}
    short = [(i, t) for i, t in rows if len(t or "") < 6000]
    assert len(got) == len(rows) and all(got[i] == by_definition(i, t) for i, t in short[:60])


def test_query_of_vectors(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in registry.QUERIES["op11_pigeonhole"](spark, sf_dir).collect()}
    assert got == {(i, n, c) for i, (n, c) in links_of(rows, 0.95).items()}
