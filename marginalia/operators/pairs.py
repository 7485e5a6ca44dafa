"""Pair tables for link prediction: positives, seeded negatives, features, and checks of both datasets.

Nothing is drawn by chance: an order by MD5 of the key and a seed stands for
it, so the same tables give the same pairs on any cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import scores as S
from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.session import discard, keep, tidied


def canonical(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def positives(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(*canonical(F.col("src"), F.col("dst"))).distinct()


def seeded(*columns: Column, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def target_negatives(n_positive: int, n_notes: int, ratio: float = 5.0) -> int:
    return max(0, min(int(n_positive * ratio), n_notes * (n_notes - 1) // 2 - n_positive))


def random_negatives(nodes: DataFrame, taken: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n pairs that are not taken, or all there are: the first draws from the space of all pairs."""
    return drawn(nodes.select(F.lit("").alias("group"), "id"), taken, n, seed)


def group_negatives(members: DataFrame, taken: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n pairs of notes that share a group (folder or tag) and are not taken, or all there are; every group has its turn."""
    return drawn(members, taken, n, seed)


def number(text: Column, digits: int = 12) -> Column:
    """A number from the first hexadecimal digits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def numbered(df: DataFrame, key: str, within: list[str] | None = None, rows: int = 100_000) -> DataFrame:
    """Adds n = 0, 1, ... in the order of the key, and total, for the whole table or within each group.

    Rows are dealt to ranges of the groups and keys, at least one for each
    `rows` rows; ranks inside the ranges and the sums of those before them make
    the numbers, so that no group is sorted by one task.
    """
    within = within or []
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    g = keep(df.repartitionByRange(parts, *within, key).withColumn("_g", F.spark_partition_id()), "ranges")
    sums = g.groupBy(*within, "_g").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*within, *([] if within else [F.lit(0)])).orderBy("_g")  # one row a part
    sums = sums.withColumns({"_s": F.sum("_c").over(before) - F.col("_c"), "total": F.sum("_c").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}).drop("_c")
    ranked = g.withColumn("_r", F.row_number().over(Window.partitionBy(*within, "_g").orderBy(key)) - 1)
    return ranked.join(sums, [*within, "_g"]).withColumn("n", (F.col("_r") + F.col("_s")).cast("long")).drop("_g", "_r", "_s")


def unranked(df: DataFrame, k: str, i: str = "i", j: str = "j") -> DataFrame:
    """Adds i < j of the pair with number k = j (j - 1) / 2 + i; the root may be off by one in doubles."""
    g, below = F.col("_root"), lambda x: F.shiftright(x * (x - 1), 1)
    df = df.withColumn("_root", F.floor((1 + F.sqrt(1.0 + 8.0 * F.col(k))) / 2).cast("long"))
    df = df.withColumn(j, F.when(below(g) > F.col(k), g - 1).when(below(g + 1) <= F.col(k), g + 1).otherwise(g)).drop("_root")
    return df.withColumn(i, F.col(k) - below(F.col(j)))


def permuted(df: DataFrame, j: str, m: str, key: Column, out: str = "k", rounds: int = 4) -> DataFrame:
    """Adds a permutation of the numbers of the pairs of m things, keyed by a text: j-th draw -> pair number.

    m (m - 1) / 2 is a product of two numbers near m; a pair number is a place
    in that grid, and rounds move its row by a hash of its column and its
    column by a hash of its row, each of which is one to one.
    """
    even, m = F.col(m) % 2 == 0, F.col(m)
    df = df.withColumns({"_rows": F.when(even, F.shiftright(m, 1)).otherwise(m), "_columns": F.when(even, m - 1).otherwise(F.shiftright(m - 1, 1))})
    df = df.withColumns({"_u": F.floor(F.col(j) / F.col("_columns")).cast("long"), "_v": F.pmod(F.col(j), F.col("_columns"))})
    for r in range(rounds):
        own, other, size = ("_u", "_v", "_rows") if r % 2 == 0 else ("_v", "_u", "_columns")
        df = df.withColumn(own, F.pmod(F.col(own) + number(F.concat_ws("|", key, F.lit(r), F.col(other))), F.col(size)))
    return df.withColumn(out, F.col("_u") * F.col("_columns") + F.col("_v")).drop("_rows", "_columns", "_u", "_v")


#: Turns of a group that are made at once.
TURNS = 1 << 16


@tidied("draws")
def drawn(members: DataFrame, taken: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """a, b: n pairs of different ids that share a group and are not taken, or all there are, drawn without repetition.

    members (group, id). The pairs of each group have an order of their own,
    a permutation of pair numbers keyed by seed and group, so a pair is worked
    out from its place and none is made to be thrown away. Groups take turns:
    the first draws of all groups come before the second ones, as if a group
    were picked at random each time; turns of a group that has no pair left
    are void, and so are those of pairs taken or drawn before. Turns are made
    until there are n pairs; of the last turn those of the first groups, by
    hash, stay. Turns are dealt over the tasks in runs. The pairs of a single
    group differ anyway, so only those taken are looked for.
    """
    empty = taken.limit(0).select("a", "b")
    if n < 1:
        return empty
    ranked = keep(numbered(members.select("group", "id").distinct(), "id", ["group"]), "members")
    groups = keep(ranked.where("total > 1").groupBy("group").agg(F.first("total").alias("m")).withColumn("turn", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("group")))), "groups")
    known = keep(taken.select(*canonical(F.col("a"), F.col("b"))).distinct(), "taken")
    size = groups.agg(F.count("*").alias("g"), F.max(F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("most")).first()
    if not size["g"]:
        return empty
    have, done, found = 0, 0, None
    alone = size["g"] == 1
    free = max(0.05, 1.0 - known.count() / size["most"]) if alone else 1.0
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * members.sparkSession.sparkContext.defaultParallelism)
    while have < n and done < size["most"]:
        # As many turns as would do if no draw were void, and more each time.
        more = math.ceil((n - have) / free * (1.1 if done else 1.01)) + 64 if alone else -(-(n - have) * (3 if done else 2) // size["g"]) + 1
        last = F.least(F.lit(done + more), (F.col("m") * (F.col("m") - 1) / 2).cast("long"))
        runs = groups.where(last > done).withColumn("_last", last).withColumn("_from", F.explode(F.sequence(F.lit(done).cast("long"), F.col("_last") - 1, F.lit(TURNS).cast("long")))).repartition(tasks, "group", "_from")
        draws = runs.withColumn("j", F.explode(F.sequence("_from", F.least(F.col("_from") + TURNS, "_last") - 1))).drop("_from", "_last")
        # Kept, as a filter of the joins would be written out over all these steps again.
        draws = keep(unranked(permuted(draws, "j", "m", F.concat_ws("|", F.lit(str(seed)), "group")), "k", "x", "y"), "draws")
        side = lambda name, on: ranked.select("group", F.col("id").alias(name), F.col("n").alias(on))
        made = draws.join(side("p", "x").hint("merge"), ["group", "x"]).join(side("q", "y").hint("merge"), ["group", "y"]).select(*canonical(F.col("p"), F.col("q")), "j", "turn")
        if not alone:
            made = made.groupBy("a", "b").agg(F.min(F.struct("j", "turn")).alias("at")).select("a", "b", "at.j", "at.turn")
        new = made.join(known, ["a", "b"], "left_anti")
        if found is not None:
            new = (new if alone else new.join(found.select("a", "b"), ["a", "b"], "left_anti")).select("a", "b", "j", "turn").unionByName(found)
        found, before = keep(new, "found"), found
        discard(draws, *([before] if before is not None else []))
        have, done = found.count(), done + more
    return first_turns(found, n, have)


def first_turns(found: DataFrame, n: int, have: int) -> DataFrame:
    """The n pairs of (a, b, j, turn) that come first by j and turn: whole turns, and of the next one the first groups."""
    if have <= n:
        return found.select("a", "b")
    low, high, before = 0, found.agg(F.max("j")).first()[0] + 1, 0  # pairs with j < low are before
    while high - low > 1:
        width = -(-(high - low) // 256)
        counts = {r["k"]: r["n"] for r in found.where(F.col("j").between(low, high - 1)).groupBy(F.floor((F.col("j") - low) / width).alias("k")).agg(F.count("*").alias("n")).collect()}  # 256 rows at most
        for k in range(256):
            if before + counts.get(k, 0) > n:
                low, high = low + k * width, min(high, low + (k + 1) * width)
                break
            before += counts.get(k, 0)
    rest = found.where(F.col("j") == low).orderBy("turn", "a", "b").limit(n - before)
    return found.where(F.col("j") < low).select("a", "b").unionByName(rest.select("a", "b"))


def stratified_negatives(nodes: DataFrame, folders: DataFrame, tags: DataFrame, taken: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A third from folders, a third from tags, the rest at random, more at random where groups have too few; no pair twice."""
    third = n // 3
    f = keep(group_negatives(folders, taken, third, seed), "folder-pairs")
    t = keep(group_negatives(tags, taken.select("a", "b").unionByName(f), third, seed + 1), "tag-pairs")
    some = f.unionByName(t)
    return some.unionByName(random_negatives(nodes, taken.select("a", "b").unionByName(some), n - some.count(), seed + 2))


@tidied("capped")
def capped(pairs: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """The pairs that one pass in hash order takes, each if both its notes are in fewer than `most` pairs taken before.

    The pass is done in rounds. A pair is taken for sure if it is among the
    first `most` pairs of both its notes, taken and open ones together, and
    dropped for sure if a note of it has that many taken ones before it. Each
    round decides the first open pair at least, and mostly a good part of all.
    Only the first few pairs of a note are ranked, so a hub sends no more.
    """
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    h = F.struct(seeded(F.col("a"), F.col("b"), seed=seed).alias("h"), F.col("a").alias("x"), F.col("b").alias("y"))
    own = F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest")
    open_ = keep(pairs.select("a", "b", own, h.alias("at")), "open")
    taken: DataFrame | None = None
    sides = lambda df: df.select(F.explode(F.array("a", "b")).alias("id"), "at")
    while not open_.isEmpty():
        live = sides(open_) if taken is None else sides(open_).unionByName(sides(taken))
        first = live.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("at"))).where(F.col("_r") <= most)
        bound = first.groupBy("id").agg(F.max("at").alias("bound"))
        near = open_
        for side in ("a", "b"):
            near = near.join(bound.select(F.col("id").alias(side), F.col("bound").alias(f"_{side}")), side)
        sure = keep(near.where((F.col("at") <= F.col("_a")) & (F.col("at") <= F.col("_b"))).select("a", "b", "rest", "at"), "sure")
        taken, old = (keep(sure if taken is None else taken.unionByName(sure), "taken"), taken)
        full = sides(taken).groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("full")).where(F.col("n") >= most)
        left = open_.join(sure.select("a", "b", "at"), ["a", "b", "at"], "left_anti")
        for side in ("a", "b"):
            left = left.join(full.select(F.col("id").alias(side), F.col("full").alias("_full")), side, "left").where(F.col("_full").isNull() | (F.col("at") < F.col("_full"))).drop("_full")
        open_, before = keep(left.select("a", "b", "rest", "at"), "open"), open_
        discard(before, sure, *([old] if old is not None else []))
    if taken is None:
        return pairs
    out = taken.select("a", "b", "rest.*") if rest else taken.select("a", "b")
    return out.select(*pairs.columns)


def pair_features(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """Features of pairs (a, b) from notes (id, path, title, content, created, tags, quality_stage, embedding); pairs without both notes go."""
    side = lambda k: notes.select(*[F.col(c).alias(f"{k}_{c}") for c in notes.columns]).withColumnRenamed(f"{k}_id", k)
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    c = lambda n: (F.col(f"a_{n}"), F.col(f"b_{n}"))
    (pa, pb), (ca, cb), (ta, tb) = c("path"), c("content"), c("tags")
    wa, wb = T.word_count(ca), T.word_count(cb)
    la, lb = F.length(ca), F.length(cb)
    qa, qb = c("quality_stage")
    return p.select(
        *pairs.columns, V.cosine(*c("embedding")).alias("cosine_similarity"), F.size(F.array_intersect(ta, tb)).alias("tag_overlap_count"), T.jaccard(ta, tb).alias("tag_jaccard"),
        T.path_distance(pa, pb).alias("path_distance"), (F.regexp_extract(pa, "^(.*)/", 1) == F.regexp_extract(pb, "^(.*)/", 1)).alias("same_folder"), S.word_count_ratio(wa, wb).alias("word_count_ratio"),
        S.word_count_ratio(la, lb).alias("content_length_ratio"), S.day_difference(*c("created")).alias("creation_time_diff_days"), F.when((qa != "unknown") & (qa == qb), 1.0).otherwise(0.0).alias("quality_compatibility"),
        T.title_jaccard(*c("title")).alias("title_similarity"), F.lit(False).alias("semantic_cluster_match"),
    )


def dataset_stats(df: DataFrame, label: str | None = None) -> DataFrame:
    """column, nulls, distinct for every column, in one pass."""
    cols = df.columns
    a = df.agg(F.count("*").alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"n_{c}") for c in cols])
    return a.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"n_{c}"), F.lit(0)).alias("nulls")) for c in cols])).alias("s")).select("s.column", F.col("_n").alias("rows"), "s.nulls")


def duplicate_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*canonical(F.col("a"), F.col("b"))).agg(F.count("*").alias("n")).where("n > 1")


def check_pairs(pairs: DataFrame, similarity: str = "cosine_similarity", label: str = "link_exists") -> list[str]:
    """Findings about a pair table: share of positives, range and spread of similarity, self and repeated pairs."""
    r = pairs.agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("pos"), F.min(similarity).alias("lo"), F.max(similarity).alias("hi"), F.stddev(similarity).alias("sd"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("own")).first()
    if not r["n"]:
        return ["no pairs"]
    out = []
    if r["pos"] == 0:
        out.append("no positive pairs")
    elif r["pos"] > 0.8:
        out.append("too many positive pairs")
    elif r["pos"] < 0.05:
        out.append("too few positive pairs")
    if r["lo"] is not None and (r["lo"] < -1 or r["hi"] > 1):
        out.append("similarity out of range")
    if r["sd"] is not None and r["sd"] < 0.01:
        out.append("similarity hardly varies")
    if r["own"]:
        out.append("self pairs")
    if not duplicate_pairs(pairs).isEmpty():
        out.append("repeated pairs")
    return out


def consistency(pairs: DataFrame, notes: DataFrame) -> dict:
    """Share of pair members that are missing from the notes (invalid above a tenth) and of notes that are in a pair (a warning below half)."""
    used = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    n, known, total = used.count(), used.join(notes.select("id"), "id", "left_semi").count(), notes.count()
    missing, coverage = (n - known) / n if n else 0.0, known / total if total else 0.0
    return {"missing": missing, "coverage": coverage, "valid": missing <= 0.1, "warning": coverage < 0.5}


def check_notes(notes: DataFrame, counts: list[str], stage: str = "quality_stage") -> list[str]:
    """Findings about a note table: negative counts, nulls above a tenth, repeated paths, one stage only."""
    cols = notes.columns
    r = notes.agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.count_distinct(stage).alias("stages"), *[F.sum((F.col(c) < 0).cast("long")).alias(f"neg_{c}") for c in counts], *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in cols]).first()
    if not r["n"]:
        return ["no notes"]
    out = [f"negative {c}" for c in counts if r[f"neg_{c}"]] + [f"many nulls in {c}" for c in cols if r[f"null_{c}"] > 0.1 * r["n"]]
    return out + ["repeated paths"] * (r["paths"] < r["n"]) + ["a single stage"] * (r["stages"] == 1)


# What stands for features that could not be made.
FALLBACKS = {
    "semantic_similarity": 0.0, "tfidf_similarity": 0.0, "combined_similarity": 0.0, "topic_similarity": 0.0, "same_dominant_topic": False, "content_similarity": 0.0, "sentiment_score": 0.0, "sentiment_label": "neutral",
    "readability_score": 50.0, "readability_grade": 8.0, "complexity_score": 0.5, "vocabulary_richness": 0.5, "content_type": "general", "technical_density": 0.0, "concept_density": 0.0, "dominant_topic_id": -1,
    "dominant_topic_probability": 0.0, "topic_label": "Unknown Topic", "pagerank": 0.001, "betweenness_centrality": 0.0, "closeness_centrality": 0.0, "clustering_coefficient": 0.0, "eigenvector_centrality": 0.0, "community_id": -1,
    "bridge_score": 0.0, "tfidf_vocabulary_richness": 0.0, "avg_tfidf_score": 0.0, "heading_count": 0, "max_heading_depth": 0, "list_count": 0, "code_block_count": 0,
}


def with_fallbacks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that are missing, null or not a number get the values that stand for them."""
    types = dict(df.dtypes)
    fill = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")) if types[c] in ("double", "float") else F.col(c), F.lit(FALLBACKS[c]))
    return df.withColumns({c: fill(c) if c in types else F.lit(FALLBACKS[c]) for c in columns})


def coerced(df: DataFrame, numbers: list[str], flags: list[str]) -> DataFrame:
    """Numbers as doubles, 0 where a value is none; flags as booleans, false where null."""
    number = lambda c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    return df.withColumns({c: number(c) for c in numbers if c in df.columns} | {c: F.coalesce(F.col(c).try_cast("boolean"), F.lit(False)) for c in flags if c in df.columns})


def content_similarity(sentiment: tuple[Column, Column], kind: tuple[Column, Column], complexity: tuple[Column, Column]) -> Column:
    """Mean of the closeness of sentiment, the same type, and the closeness of complexity; what differs by more than the whole range does not count."""
    s, c = F.abs(sentiment[0] - sentiment[1]), F.abs(complexity[0] - complexity[1])
    parts = F.filter(F.array(F.when(s <= 2.0, 1.0 - s / 2.0), F.when(kind[0] == kind[1], 1.0).otherwise(0.0), F.when(c <= 1.0, 1.0 - c)), lambda x: x.isNotNull())
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)


def topic_similarity(a: Column, b: Column) -> Column:
    """Cosine of two topic distributions, 0 for vectors of different or no length."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (V.norm(a) > 0) & (V.norm(b) > 0), V.cosine(a, b)).otherwise(0.0)


def same_topic(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) & (a != -1), F.lit(False))


def enumerated(nodes: DataFrame, first: int = 0, most: int | None = None, block: int | None = None) -> DataFrame:
    """a, b: unordered pairs of nodes by their number in one fixed order, from the first on; chunks of it make up all pairs.

    Pair j (j - 1) / 2 + i is that of the nodes i < j, so the pairs of a node j
    have a run of numbers. Nodes meet as blocks of ids, only blocks that hold
    pairs of the chunk, and pairs are made in the tasks that have two blocks:
    what goes round are blocks, some 64 of them up to half a million nodes, and
    nothing is paired to be thrown away.
    """
    ranked = numbered(nodes.select("id"), "id").select("id", "n")
    n = ranked.count()
    block = block or min(8192, max(512, n // 64))
    blocks = keep(ranked.groupBy(F.floor(F.col("n") / block).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("of")), "blocks")
    total = n * (n - 1) // 2
    last = total if most is None else max(first, min(total, first + most))
    below = lambda x: F.shiftright(x * (x - 1), 1)
    side = lambda k: blocks.select(F.col("block").alias(f"block_{k}"), F.col("of").alias(f"of_{k}"))
    met = blocks.select(F.col("block").alias("block_j")).withColumn("block_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block_j"))))
    met = met.where((below((F.col("block_j") + 1) * block) > first) & (below(F.col("block_j") * block) < last))
    both = met.join(side("i").hint("merge"), "block_i").join(side("j").hint("merge"), "block_j")
    # As many tasks as the pairs need: the blocks are too small for that to be seen from their bytes.
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, (last - first) >> 23)
    both = both.repartition(tasks).select((F.col("block_i") * block).alias("from"), F.transform("of_i", lambda x: x["id"]).alias("ids"), F.explode("of_j").alias("y"))
    low = F.greatest(F.lit(first) - below(F.col("y.n")), F.col("from"), F.lit(0)) - F.col("from")
    high = F.least(F.lit(last) - below(F.col("y.n")), F.col("y.n"), F.col("from") + block) - F.col("from")
    own = F.slice("ids", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    return both.select(F.col("y.id").alias("y"), F.explode(own).alias("x")).select(*canonical(F.col("x"), F.col("y")))
