"""Embedding near-duplicates by spherical-cap filters from structured random product codes."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_roots, map_arrow, materialise

#: Codewords a block may have, and product codes side by side, before a further block is taken.
MOST_CODEWORDS, MOST_CODES = 4096, 8
#: Vectors from which cap height and recall are measured, and the share of pairs at the threshold to be met.
SAMPLE, RECALL = 256, 0.995
#: Filters of a vector beyond which no more recall is bought.
MOST_FILTERS = 400
#: Slack in radians when links are told by angles to centres.
SLACK = 1e-6


@dataclass(frozen=True)
class Code:
    """Product codes side by side, each with words codewords in each of blocks blocks. A vector is in the
    `filters` caps nearest to it; height is where such a list usually ends."""

    dim: int
    codes: int
    blocks: int
    words: int
    filters: int
    height: float
    seed: int
    recall: float = 0.0


@functools.lru_cache(maxsize=64)
def product_code(dim: int, blocks: int, words: int, seed: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """A random rotation and, for each block of rotated coordinates, random codewords of norm 1/sqrt(blocks)."""
    rng = np.random.default_rng([seed, dim, blocks, words])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    books = []
    for part in np.array_split(np.arange(dim), blocks):
        book = rng.standard_normal((words, len(part)))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / math.sqrt(blocks))
    return rotation, tuple(books)


def _scores(unit: np.ndarray, code) -> list[np.ndarray]:
    rotation, books = code
    turned, at, out = unit @ rotation, 0, []
    for book in books:
        out.append(turned[:, at : at + book.shape[1]] @ book.T)
        at += book.shape[1]
    return out


def _reaching(scores: list[np.ndarray], height: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one vector: codes of all products whose sum of block scores reaches height, and the sums."""
    ids, sums = np.zeros(1, np.int64), np.zeros(1)
    tops = [float(s.max()) for s in scores]
    for b, s in enumerate(scores):
        rest = sum(tops[b + 1 :])
        good = np.flatnonzero(s >= height - rest - sums.max())
        total = sums[:, None] + s[good][None, :]
        r, c = np.nonzero(total >= height - rest)
        ids, sums = ids[r] * len(s) + good[c], total[r, c]
        if not len(ids):
            break
    return ids, sums


def list_decode(unit: np.ndarray, code: Code) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each vector: all filters whose direction exceeds its cap height, sorted, the nearest, and the height.

    The height is the vector's own, so that code.filters filters exceed it: block norms differ, and one
    height for all would give some vectors thousands of filters and some none."""
    books = [_scores(unit, product_code(code.dim, code.blocks, code.words, code.seed + r)) for r in range(code.codes)]
    out, home, ends = [], np.zeros(len(unit), np.int64), np.zeros(len(unit))
    most = min(code.filters, code.codes * code.words**code.blocks)
    for i in range(len(unit)):
        want = code.height
        while True:
            ids, sums = zip(*(_reaching([s[i] for s in scores], want) for scores in books), strict=True)
            if sum(map(len, ids)) >= most or want < -2:
                break
            want -= 0.02
        of, reached = np.repeat(np.arange(code.codes), [len(x) for x in ids]).astype(np.uint64), np.concatenate(sums)
        flat = np.concatenate(ids).astype(np.uint64) * np.uint64(code.codes) + of
        mixed = (flat ^ flat >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        names = ((mixed ^ mixed >> np.uint64(32)) >> np.uint64(1)).astype(np.int64)
        home[i] = names[np.argmax(reached)]
        ends[i] = np.partition(reached, -most)[-most]
        out.append(np.unique(names[reached >= ends[i]]))
    return out, home, ends


def fit_code(n: int, sample: np.ndarray, threshold: float, filters: float = 24.0, bucket: float = 4.0, seed: int = 3) -> Code:
    """A code for n vectors, of which sample (unit rows) is a part.

    About `bucket` unrelated vectors share a filter, at any n; lists have `filters` filters, more of them,
    of more codes, until RECALL of pairs at the threshold (sample vectors with one drawn at that angle)
    share one. Heights come from the sample's scores."""
    dim, p, rng = sample.shape[1], min(0.2, bucket / max(n, 1)), np.random.default_rng(seed)
    x = sample[: SAMPLE // 2]
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = x if dim == 1 else threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    best = None
    while True:
        for codes in (4, MOST_CODES):
            each, blocks = filters / p / codes, min(2, dim)
            while blocks < dim and each ** (1 / blocks) > MOST_CODEWORDS:
                blocks += 1
            words = max(4, math.ceil(each ** (1 / blocks)))
            code = Code(dim, codes, blocks, words, round(filters), NormalDist().inv_cdf(1 - p) / math.sqrt(dim), seed)
            (a, _, ends), (b, _, _) = list_decode(x, code), list_decode(y, code)
            met = float(np.mean([np.intersect1d(s, t).size > 0 for s, t in zip(a, b, strict=True)]))
            code = replace(code, recall=met, height=float(np.median(ends)))
            best = code if best is None or met > best.recall else best
            if met >= RECALL:
                return code
        if filters * 1.5 > MOST_FILTERS:
            return best
        filters *= 1.5


def _unit(blobs: list[bytes], width: str) -> np.ndarray:
    """Rows of one length as unit vectors; the largest component is taken out first, so no norm overflows."""
    v = np.stack([np.frombuffer(x, width) for x in blobs]).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _runs(batches, keys: list[str], work):
    """work() on each run of equal keys of sorted batches; the last run of a batch waits for the next."""
    held: list = []

    def cut(t: pa.Table, last: bool):
        k = np.stack([t.column(x).to_numpy() for x in keys])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), t.num_rows]
        for s, e in zip(starts if last else starts[:-1], ends if last else ends[:-1], strict=True):
            if (out := work(t.slice(s, e - s))) is not None:
                yield out
        held[:] = [] if last else [t.slice(starts[-1])]

    for batch in batches:
        if batch.num_rows:
            yield from cut(pa.concat_tables([*held, pa.Table.from_batches([batch])]), False)
    if held:
        yield from cut(held[0], True)


def balls(unit: np.ndarray, threshold: float, width: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deals rows to balls so narrow that all members of one are linked: the number of each row's ball
    (its first row), the centre of its ball (of dtype width) and the angle up to which members reach."""
    half = math.acos(threshold) / 2 - SLACK
    ball, centre, radius = np.arange(len(unit)), unit.astype(width), np.zeros(len(unit))
    free = np.arange(len(unit))
    while len(free) > 1:
        pivot = free[0]
        near = free[unit[free] @ unit[pivot] >= threshold]
        mean = unit[near].mean(0).astype(width).astype(np.float64)
        norm = np.linalg.norm(mean)
        angle = np.arccos(np.clip(unit[free] @ mean / max(norm, 1e-300), -1, 1))
        own = angle <= half
        if len(near) < 2 or not own[0]:
            free = free[1:]
            continue
        ball[free[own]], centre[free[own]], radius[free[own]] = pivot, mean, angle[own].max() + SLACK
        free = free[~own]
    alone = np.bincount(ball, minlength=len(ball))[ball] == 1
    centre[alone], radius[alone] = unit[alone], 0.0
    return ball, centre, radius


def _gather(batches, threshold: float, width: str):
    """Runs of one home filter (or a part of it): class, ball, centre and radius."""

    def work(t: pa.Table):
        cls, blobs = t.column("cls").to_numpy(), t.column("v").to_pylist()
        ball, centre, radius = balls(_unit(blobs, width), threshold, width)
        centres = [blobs[i] if radius[i] == 0 else centre[i].tobytes() for i in range(len(cls))]
        return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(cls[ball]), pa.array(centres, pa.binary()), pa.array(radius)], names=["cls", "unit", "centre", "radius"])

    yield from _runs(batches, ["dim", "home", "part"], work)


def _cells(batches, threshold: float, width: str, rows_at_once: int = 512):
    """Runs of equal (filter, a, b). Single vectors: links of each and a star per local group (kind 0: a, b,
    n). Pairs with a ball: linked as a whole (kind 1), or some of whose members may be (kind 2).

    A pair counts in the lowest filter that both lists hold; in a cell of two parts only pairs across
    them do. A ball's list is that of one member, so its pairs may come from several filters.
    """
    limit = math.acos(threshold)

    def work(t: pa.Table):
        part, unit = t.column("part").to_numpy(), t.column("unit").to_numpy()
        size, radius = t.column("size").to_numpy(), t.column("radius").to_numpy()
        f, apart = t.column("filter")[0].as_py(), t.column("a")[0].as_py() != t.column("b")[0].as_py()
        v = _unit(t.column("centre").to_pylist(), width)
        single, n = radius == 0, len(v)
        lists, has = None, None
        links, root, pairs = np.zeros(n, np.int64), np.arange(n), []
        for at in range(0, n, rows_at_once):
            rows = slice(at, at + rows_at_once)
            cos = v[rows] @ v.T
            if single.all():
                sure, maybe = cos >= threshold, None
            else:
                angle, reach = np.arccos(np.clip(cos, -1, 1)), radius[rows, None] + radius[None, :]
                both = single[rows, None] & single[None, :]
                sure = np.where(both, cos >= threshold, angle + reach + SLACK <= limit)
                maybe = ~both & ~sure & (angle <= limit + reach + SLACK)
            later = np.arange(n)[None, :] > np.arange(at, min(at + rows_at_once, n))[:, None]
            met = (sure if maybe is None else sure | maybe) & later
            if apart:
                met &= part[rows, None] != part[None, :]
            i, j = np.nonzero(met)
            if not len(i):
                continue
            if lists is None:  # of the lower filters those that two rows here hold
                own = t.column("filters").combine_chunks()
                of = np.repeat(np.arange(n), np.diff(own.offsets.to_numpy()))
                values = own.flatten().to_numpy()
                of, values = of[values < f], values[values < f]
                lists, where, count = np.unique(values, return_inverse=True, return_counts=True)
                column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[where]
                has = np.zeros((n, int((count > 1).sum())), np.float32)
                has[of[column >= 0], column[column >= 0]] = 1
            if has.shape[1]:
                fresh = (has[rows] @ has.T)[i, j] == 0
                i, j = i[fresh], j[fresh]
            linked = sure[i, j]
            i += at
            one = single[i] & single[j]
            a, b = i[one], j[one]
            links += np.bincount(a, size[b], n).astype(np.int64) + np.bincount(b, size[a], n).astype(np.int64)
            root = local_roots(n, np.concatenate([np.arange(n), a]), np.concatenate([root, b]))
            pairs.append((unit[i[~one]], unit[j[~one]], np.where(linked[~one], 1, 2)))
        some = np.flatnonzero(links > 0)
        a = np.concatenate([unit[some], *(p[0] for p in pairs)])
        if not len(a):
            return None
        b = np.concatenate([unit[root[some]], *(p[1] for p in pairs)])
        kind = np.concatenate([np.zeros(len(some), np.int64), *(p[2] for p in pairs)])
        n_links = np.concatenate([links[some], np.zeros(len(a) - len(some), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), pa.array(a), pa.array(b), pa.array(n_links)], names=["kind", "a", "b", "n"])

    yield from _runs(batches, ["dim", "filter", "a", "b"], work)


def _between(threshold: float, width: str):
    """Members of a ball against members of the units near it: links of each class, and linked units."""

    def work(key, hosts: pa.Table, guests: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if hosts.num_rows and guests.num_rows:
            h = _unit(hosts.column("v").to_pylist(), width)
            hosts_links, size = np.zeros(len(h), np.int64), hosts.column("size").to_numpy()
            for at in range(0, guests.num_rows, 1024):
                part = guests.slice(at, 1024)
                close = _unit(part.column("v").to_pylist(), width) @ h.T >= threshold
                hosts_links += part.column("size").to_numpy() @ close
                own = close @ size
                hit = np.flatnonzero(own)
                out[0] += part.column("cls").to_numpy()[hit].tolist()
                out[1] += own[hit].tolist()
                out[2] += part.column("unit").to_numpy()[hit].tolist()
            hit = np.flatnonzero(hosts_links)
            out[0] += hosts.column("cls").to_numpy()[hit].tolist()
            out[1] += hosts_links[hit].tolist()
            out[2] += [key[0].as_py()] * len(hit)
        rows = len(out[0])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array([key[0].as_py()] * rows, pa.int64())], names=["cls", "n", "unit", "host"])

    return work


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", filters_per_vector: float = 24.0, bucket: float = 4.0, rows_per_part: int = 2048, seed: int = 3) -> DataFrame:
    """Vectors linked by cosine >= threshold (double precision), and the components of the links.

    Equal vectors are one class before any join. Each class is list-decoded to all filters whose cap
    holds it, filters_per_vector of them at first; about `bucket` unrelated vectors share a filter at any
    size of the table, and lists grow until RECALL of pairs at the threshold, measured on SAMPLE
    vectors, share one (fit_code). Classes
    with the same nearest filter are dealt to balls of half the threshold's angle, all members of which
    are linked, so a group of any number of near copies is a few balls. Balls and single vectors
    (units) join on filters by their ids; only members of filters with company are joined with their
    vectors and compared exactly, each pair in the lowest filter it shares. Large filters are dealt to
    cells of two parts of rows_per_part units. Cells return link counts and stars of single vectors,
    never their pairs, and pairs of near balls, whose members are compared where angles leave it open.

    Few links are missed; none is false. Null vectors, zero vectors and those with null or non-finite
    components link with nothing; vectors of different length never link. Rows with equal ids are
    separate vectors; an empty table gives no rows; other columns are ignored. Returns vec_id, n_links,
    component_id, kept (a null id is not kept).
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    width = "<f4" if "float" in dict(vectors.dtypes)[vector_col] else "<f8"
    itemsize = int(width[-1])

    def encode(batch):
        out = []
        for x in batch.column(1).to_pylist():
            v = np.array(x, np.float64) if x and None not in x else np.zeros(0)
            out.append((v + 0.0).astype(width).tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    rows = map_arrow(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")), encode, f"vec_id {kind}, v binary")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("row").alias("cls"), F.count("*").alias("size"), F.min("vec_id").alias("first"))
    classes = materialise(classes.withColumn("dim", (F.octet_length("v") / itemsize).cast("int")), "vector-classes")
    drawn = [r["v"] for r in classes.orderBy(F.xxhash64("v")).limit(4 * SAMPLE).select("v").collect()]
    codes = {}
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect():
        own = [x for x in drawn if len(x) == r["dim"] * itemsize][:SAMPLE]
        sample = _unit(own, width) if len(own) >= 32 else np.random.default_rng(seed).standard_normal((SAMPLE, r["dim"]))
        codes[r["dim"]] = fit_code(r["n"], sample / np.linalg.norm(sample, axis=1, keepdims=True), threshold, filters_per_vector, bucket, seed)

    def decode(batch):
        blobs = batch.column(0).to_pylist()
        lists, home = [None] * len(blobs), np.zeros(len(blobs), np.int64)
        for dim in {len(x) // itemsize for x in blobs}:
            at = [i for i, x in enumerate(blobs) if len(x) == dim * itemsize]
            for s in range(0, len(at), 256):
                some = at[s : s + 256]
                found, home[some], _ = list_decode(_unit([blobs[i] for i in some], width), codes[dim])
                for i, x in zip(some, found, strict=True):
                    lists[i] = x
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "home", "filters"])

    decoded = materialise(map_arrow(classes, decode, f"v binary, cls bigint, size bigint, first {kind}, dim int, home bigint, filters array<bigint>"), "decoded")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    crowded = decoded.groupBy("dim", "home").agg(F.count("*").alias("n")).where("n > 1").select("dim", "home", F.ceil(F.col("n") / rows_per_part).cast("int").alias("parts"))
    homes = decoded.select("dim", "home", "cls", "v").join(crowded, ["dim", "home"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("parts")
    homes = homes.repartition(tasks, "dim", "home", "part").sortWithinPartitions("dim", "home", "part", "cls")
    gathered = materialise(homes.mapInArrow(lambda b: _gather(b, threshold, width), "cls bigint, unit bigint, centre binary, radius double").where("radius > 0"), "balls")
    members = decoded.join(gathered, "cls", "left").select("dim", "cls", "v", "size", "first", "filters", F.coalesce("unit", "cls").alias("unit"), F.coalesce("centre", "v").alias("centre"), F.coalesce("radius", F.lit(0.0)).alias("radius"))
    members = materialise(members, "members")
    # a ball's own filters are those of the member that names it
    own = members.where("cls = unit").select("unit", "centre", "radius", "filters")
    sizes = members.groupBy("unit").agg(F.sum("size").alias("size"), F.count("*").alias("classes"), F.min("first").alias("first"))
    units = materialise(own.join(sizes, "unit"), "units")

    held = members.select("dim", "unit", F.explode("filters").alias("filter")).distinct()
    held = materialise(held, "held")
    company = held.groupBy("dim", "filter").agg(F.count("*").alias("n")).where("n > 1").select("dim", "filter", F.ceil(F.col("n") / rows_per_part).cast("int").alias("parts"))
    dealt = held.join(company, ["dim", "filter"]).withColumn("part", F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.select("dim", "filter", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "unit").join(units.drop("first", "classes"), "unit")
    cells = cells.repartition(tasks, "dim", "filter", "a", "b").sortWithinPartitions("dim", "filter", "a", "b")
    found = materialise(cells.mapInArrow(lambda b: _cells(b, threshold, width), "kind tinyint, a bigint, b bigint, n bigint"), "links")

    near = found.where("kind > 0").select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = materialise(near, "near-units")
    whole = near.where("kind = 1")
    count = units.select("unit", "size", "classes")
    either = whole.select(F.col("a").alias("to"), F.col("b").alias("unit")).union(whole.select(F.col("b").alias("to"), F.col("a").alias("unit")))
    unit_links = found.where("kind = 0").select(F.col("a").alias("unit"), "n").union(either.join(count, "unit").select(F.col("to").alias("unit"), F.col("size").alias("n"))).groupBy("unit").agg(F.sum("n").alias("of_unit"))

    # the larger ball of an open pair keeps its members in place, the others' come to it in slices
    count_of = lambda x: count.select(F.col("unit").alias(x), F.col("classes").alias(f"n_{x}"))
    open_pairs = near.where("kind = 2").join(count_of("a"), "a").join(count_of("b"), "b")
    first = F.col("n_a") >= F.col("n_b")
    open_pairs = open_pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("unit"), F.least("n_a", "n_b").alias("n"))
    open_pairs = materialise(open_pairs, "open-pairs")
    slices = open_pairs.groupBy("host").agg(F.ceil(F.sum("n") / (4 * rows_per_part)).cast("int").alias("slices"))
    own = members.select("unit", "cls", "v", "size")
    guests = open_pairs.drop("n").join(own, "unit").join(slices, "host").withColumn("slice", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int"))
    guests = materialise(guests, "guests")
    hosts = own.withColumnRenamed("unit", "host").join(slices, "host").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    between = hosts.groupBy("host", "slice").cogroup(guests.groupBy("host", "slice")).applyInArrow(_between(threshold, width), "cls bigint, n bigint, unit bigint, host bigint")
    between = materialise(between, "between")
    class_links = between.groupBy("cls").agg(F.sum("n").alias("of_class"))

    edges = found.where("kind = 0").select("a", "b").union(whole.select("a", "b")).union(between.where("unit <> host").select(F.col("unit").alias("a"), F.col("host").alias("b")).distinct())
    groups = components(edges)
    named = units.select("unit", F.col("size").alias("together"), "first").join(groups, F.col("unit") == F.col("node"), "left").select("unit", "together", "first", F.coalesce("root", "unit").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").join(unit_links, "unit", "left").select("unit", "component_id", (F.col("together") - 1 + F.coalesce("of_unit", F.lit(0))).alias("of_unit"))
    known = members.select("v", "cls", "unit").join(named, "unit").join(class_links, "cls", "left").select("v", "component_id", (F.col("of_unit") + F.coalesce("of_class", F.lit(0))).alias("n_links"))
    out = rows.join(known, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
