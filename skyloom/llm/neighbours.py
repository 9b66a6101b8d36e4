"""Most similar vectors for every vector, by a permutation index.

A vector is represented by its ``order`` nearest pivots, nearest first. It is posted in the inverted file of each of its
first ``depth`` pivots, and it asks in the file of its nearest pivot: there the vectors of the file are ranked by the
footrule distance of their pivot orders to its own, and the ``rerank`` best are reranked by cosine similarity. So every
vector gets its list from one task, and lists need no second exchange. Pivots are a bounded, documented sample; every
vector is indexed and every vector asks.

The footrule distance of two orders is a constant plus, for each pivot of the one, a number that depends only on its places
in both; a file therefore keeps one small table per place, and a distance is ``order`` additions of bytes.

Postings carry the vector (as bytes): the candidates that are reranked outnumber the postings of a vector by far, so
fetching their vectors by a join would move more.

Copies are collapsed to one representative before indexing, so a hot group of copies is one posting. A file longer than
``file_cap`` is divided by a second pivot (the posting key's order is raised): who asks goes by its second and by its third
pivot, and vectors are posted under each other pivot of their order. What is still longer is cut into blocks, and every pair of blocks of askers and vectors is a task of its own. Nothing is capped or sampled: candidates beyond
``rerank`` are left out only if their footrule distance is larger than that of the last one kept; ties stay in.
``exact=True`` compares all blocks of all vectors instead, for those who need every neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.operators.runs import borders, complete_runs
from skyloom.session import cut, shuffle_width

#: Least and most pivots, and most numbers that they hold together; between them this many times the square root of the number of vectors.
PIVOTS, PIVOT_NUMBERS, PER_ROOT = (16, 32_000), 4_000_000, 1.0
#: Files a vector is posted in, pivots compared by footrule (at most 15).
DEPTH, ORDER = 6, 12
#: Candidates that are reranked (ties of the last one included): so many at least, and this share of the number of pivots, as files grow with it.
RERANK, RERANK_SHARE = 256, 0.5
#: Rows of an inverted file above which it is divided.
FILE_CAP = 20_000
#: Groups of copies up to which their table is broadcast; copies from which a group is joined by itself (so at most rows / HOT of them are broadcast).
BROADCAST_GROUPS, HOT = 100_000, 100_000
#: What one task compares.
KEYS = ("f", "qi", "dj")
#: Cells of the matrices held at a time while a file is ranked.
CELLS = 500_000


def usable_vector(v: Column, size: int) -> Column:
    """Exactly ``size`` finite components, not all zero; never null."""
    ok = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither very large nor very small components overflow."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _orders(pivots: np.ndarray, order: int):
    """``x``: the bytes of the vector (float32) and of its pivot order (int16); ``top``: that order."""
    schema = pa.schema([("rep", pa.int64()), ("c", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("x", pa.binary()), ("top", pa.list_(pa.int16()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column("v").flatten().to_numpy().reshape(n, -1).astype("<f4")
            sim = _unit(v) @ pivots.T
            near = np.argpartition(-sim, order - 1, axis=1)[:, :order]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1).astype("<i2")
            x = np.concatenate([v.view(np.uint8), np.ascontiguousarray(near).view(np.uint8)], 1)
            at = lambda k: pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32))
            blob = pa.Array.from_buffers(pa.binary(), n, [None, at(x.shape[1]), pa.py_buffer(np.ascontiguousarray(x))])
            top = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * order, order, dtype=np.int32)), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("rep", "c", "h1", "h2")], blob, top], schema=schema)

    return run


def _footrule(asked: np.ndarray, perm: np.ndarray) -> np.ndarray:
    """A number that grows with the footrule distance of every order in ``asked`` to every one in ``perm``; a pivot that an order lacks is at its end.

    With ``n`` pivots in an order, the distance is twice this number less ``n (n - 1)``: per pivot at place ``j`` here and ``t`` there, the larger place.
    """
    order = perm.shape[1]
    used, local = np.unique(np.concatenate([asked, perm]), return_inverse=True)
    local = local.reshape(-1, order)
    place = np.full((len(used), len(perm)), order, np.uint8)
    place[local[len(asked) :], np.arange(len(perm))[:, None]] = np.arange(order, dtype=np.uint8)
    out, row = np.zeros((len(asked), len(perm)), np.uint8), np.empty((len(asked), len(perm)), np.uint8)
    for j in range(order):
        np.take(place, local[: len(asked), j], axis=0, out=row, mode="clip")
        np.maximum(row, np.uint8(j), out=row)
        out += row
    return out


def _rank(k: int, size: int, order: int, rerank: int | None):
    """Files, or pairs of their blocks, in; lists of ``k`` out. A group of more than ``k + 1`` copies also gets the list of those that are not posted, without an id."""
    schema = pa.schema([("id", pa.int64()), ("rep", pa.int64()), ("near_id", pa.int64()), ("place", pa.int32()), ("cos", pa.float64())])

    def blob(t: pa.Table) -> np.ndarray:
        c = t.column("x").combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        width = 4 * size + 2 * order
        begin = np.frombuffer(c.buffers()[1], np.int32)[c.offset]
        return np.frombuffer(c.buffers()[2], np.uint8, len(c) * width, begin).reshape(len(c), width)

    def best(rep: np.ndarray, u: np.ndarray, perm: np.ndarray, ask: np.ndarray, have: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows that ask, the rows of their best candidates in order (cosine, then id), and the cosines; -inf where there are fewer."""
        step = max(1, CELLS // len(have))
        for lo in range(0, len(ask), step):
            a = ask[lo : lo + step]
            if rerank is None:
                cos = u[a] @ u[have].T
                far = max(0, len(have) - k - 3)  # itself, and two more than needed, as the product's rounding depends on its shape
                i, j = np.nonzero(cos >= np.partition(cos, far, axis=1)[:, far, None])
            elif rerank + 1 < len(have):
                foot = _footrule(perm[a], perm[have]).astype(np.int16)
                own = np.minimum(np.searchsorted(have, a), len(have) - 1)
                here = np.nonzero(have[own] == a)[0]
                foot[here, own[here]] = np.iinfo(np.int16).max  # itself
                i, j = np.nonzero(foot <= np.partition(foot, rerank - 1, axis=1)[:, rerank - 1, None])
            else:
                i, j = np.divmod(np.arange(len(a) * len(have)), len(have))
            j = have[j]
            if rerank is None or rerank + 1 >= len(have):
                other = a[i] != j
                i, j = i[other], j[other]
            at = np.arange(len(i)) - np.searchsorted(i, np.arange(len(a)))[i]
            cos = np.full((len(a), max(k, int(at.max(initial=0)) + 1)), -np.inf)
            cos[i, at] = np.minimum(np.einsum("ij,ij->i", u[a[i]], u[j]), 1.0)
            near = cos[i, at] >= np.partition(cos, cos.shape[1] - k, axis=1)[i, -k]
            i, j, c = i[near], j[near], cos[i[near], at[near]]
            o = np.lexsort((rep[j], -c, i))
            i, j, c = i[o], j[o], c[o]
            at = np.arange(len(i)) - np.searchsorted(i, np.arange(len(a)))[i]
            i, j, c, at = i[at < k], j[at < k], c[at < k], at[at < k]
            who, cos = np.zeros((len(a), k), np.int64), np.full((len(a), k), -np.inf)
            who[i, at], cos[i, at] = j, c
            yield a, who, cos

    def emit(rep: np.ndarray, more: dict[int, list[int]], a: np.ndarray, j: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        many = np.zeros(len(rep), bool)
        many[list(more)] = True
        real = np.isfinite(c)
        plain = ~many[a] & ~(many[j] & real).any(1)
        i, p = np.nonzero(real & plain[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rep[a[i]], rep[a[i]], rep[j[i, p]], (p + 1).astype(np.int32), c[i, p])], schema=schema)
        rows = []
        for i in np.nonzero(~plain)[0]:
            own = more.get(int(a[i]), [int(rep[a[i]])])
            near = [(-1.0, x) for x in own] if len(own) > 1 else []
            near += [(-float(c[i, p]), x) for p in np.nonzero(real[i])[0] for x in more.get(int(j[i, p]), [int(rep[j[i, p]])])]
            near.sort()
            for x in own + [None] * (len(own) > k):
                rows += [(x, int(rep[a[i]]), y, p + 1, -s) for p, (s, y) in enumerate([q for q in near if q[1] != x][:k])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in complete_runs(batches, KEYS):
            rep, x = t.column("rep").to_numpy(), blob(t)
            ask, have = t.column("ask").to_numpy(), t.column("have").to_numpy()
            ids = t.column("more").combine_chunks()
            held = np.nonzero(ids.is_valid().to_numpy(zero_copy_only=False))[0]
            more = dict(zip(held.tolist(), ids.take(pa.array(held)).to_pylist())) if len(held) else {}
            u = _unit(np.ascontiguousarray(x[:, : 4 * size]).view("<f4"))
            perm = np.ascontiguousarray(x[:, 4 * size :]).view("<i2")
            at = [0, *np.nonzero(borders(t, KEYS))[0], len(t)]
            for lo, hi in zip(at[:-1], at[1:]):
                a, h = lo + np.nonzero(ask[lo:hi])[0], lo + np.nonzero(have[lo:hi])[0]
                if len(a) and len(h):
                    for found in best(rep, u, perm, a, h):
                        yield from emit(rep, more, *found)

    return run


def _with_groups(rows: DataFrame, groups: DataFrame, on: list[str], n: int) -> DataFrame:
    """Rows joined to their group of copies (``c``: their number; there are ``n`` groups at most). A group of many copies is joined by broadcast, so it stays spread as its rows are."""
    if n <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), on)
    hot = groups.filter(F.col("c") > HOT)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(groups.filter(F.col("c") <= HOT), on))


def _pivots(rows: DataFrame, n: int, m: int) -> list:
    """The ``m`` distinct vectors with the smallest hashes; as large a part of the rows is looked at as is needed to find them."""
    h = F.shiftrightunsigned(F.xxhash64("v"), 11) / float(1 << 53)
    share = min(1.0, 8.0 * m / n)
    while True:
        got = rows.select("v").filter(h <= share).distinct().withColumn("h", h).orderBy("h", "v").limit(m).collect()
        if len(got) == m or share >= 1.0:
            return [r["v"] for r in got]
        share = min(1.0, 8.0 * share)


def _postings(perms: DataFrame, n: int, depth: int, file_cap: int, exact: bool) -> tuple[DataFrame, bool]:
    """Rows ``(f, qi, dj, ask, have, rep, x, more)`` of the inverted files, and whether any list is found in several tasks.

    Sizes of files are counts of at most ``PIVOTS`` groups on the driver; those of divided files stay distributed.
    """
    if exact:
        posts = perms.select("rep", "x", "more", F.lit(0).cast("long").alias("f"), F.lit(True).alias("ask")).withColumn("nb", F.lit(-(-n // file_cap)))
        blocks = n > file_cap
    else:
        firsts = F.slice("top", 1, depth)
        sizes = perms.select(F.explode(firsts).alias("p")).groupBy("p").count().collect()
        hot = [r["p"] for r in sizes if r["count"] > file_cap]
        first, next_two = F.col("top")[0], F.slice("top", 2, 2)
        one = lambda p: F.struct((p.cast("long") * 65536).alias("f"), (p == first).alias("ask"))
        two = lambda p: F.transform(F.filter("top", lambda q: q != p), lambda q: F.struct((p.cast("long") * 65536 + q + 1).alias("f"), ((p == first) & F.array_contains(next_two, q)).alias("ask")))
        files = F.transform(firsts, one)
        if hot:
            files = F.flatten(F.transform(firsts, lambda p: F.when(p.isin(hot) & (F.size("top") > 1), two(p)).otherwise(F.array(one(p)))))
        posts = perms.select("rep", "x", "more", F.inline(files))
        big = posts.groupBy("f").count().filter(F.col("count") > file_cap).select("f", F.ceil(F.col("count") / file_cap).cast("int").alias("nb")) if hot else None
        n_big = big.count() if hot else 0
        blocks = n_big > 0
        if blocks:
            posts = posts.join(F.broadcast(big) if n_big <= BROADCAST_GROUPS else big, "f", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    if not blocks:
        return posts.select("f", F.lit(0).alias("qi"), F.lit(0).alias("dj"), "ask", F.lit(True).alias("have"), "rep", "x", "more"), bool(not exact and hot)
    own, every = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"), F.sequence(F.lit(0), F.col("nb") - 1)
    as_vector = F.transform(every, lambda i: F.struct(i.alias("qi"), own.alias("dj")))
    as_asker = F.when(F.col("ask"), F.transform(F.filter(every, lambda j: j != own), lambda j: F.struct(own.alias("qi"), j.alias("dj")))).otherwise(F.array().cast("array<struct<qi:int,dj:int>>"))
    posts = posts.withColumn("own", own).select("*", F.inline(F.concat(as_vector, as_asker)))
    return posts.select("f", "qi", "dj", (F.col("ask") & (F.col("qi") == F.col("own"))).alias("ask"), (F.col("dj") == F.col("own")).alias("have"), "rep", "x", "more"), True


def nearest_vectors(
    df: DataFrame,
    k: int,
    *,
    size: int,
    id_col: str = "emb_id",
    vec_col: str = "embeddings",
    per_root: float = PER_ROOT,
    depth: int = DEPTH,
    order: int = ORDER,
    rerank: int | None = None,
    file_cap: int = FILE_CAP,
    exact: bool = False,
) -> DataFrame:
    """``(id, near_id, place, cos)``: for every usable vector its ``k`` most similar other ones, best first.

    A vector is usable with exactly ``size`` finite components that are not all zero, and a non-null id. Equal
    similarities are ordered by id; a repeated id counts once. Fewer than ``k`` others give fewer rows; none give none.

    ``per_root``, ``depth``, ``order`` and ``rerank`` trade time for recall, ``file_cap`` bounds a task; with ``exact`` all pairs of
    blocks of ``file_cap`` vectors are compared and the others do not matter.
    """
    if not 0 < order <= 15 or depth < 1 or file_cap < 1 or (rerank is not None and rerank < k):
        raise ValueError("order must be 1 to 15, depth and file_cap at least 1, rerank at least k")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & usable_vector(F.col("v"), size))
    most, n = rows.groupBy("id").count().agg(F.max("count"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "id long, near_id long, place int, cos double")
    if most > 1:
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    m = min(max(PIVOTS[0], round(per_root * math.sqrt(n))), PIVOTS[1], max(PIVOTS[0], PIVOT_NUMBERS // size))
    p = _unit(np.array(_pivots(rows, n, m)))
    order, rerank = min(order, len(p)), rerank or max(RERANK, k, round(RERANK_SHARE * len(p)))
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    groups = rows.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).select("rep", "c", *hashes, "v")
    perms = cut(groups.mapInArrow(_orders(p, order), "rep long, c long, h1 long, h2 long, x binary, top array<short>"))
    copies = perms.filter("c > 1").select("h1", "h2", "rep", "c")
    longest, n_copies = copies.agg(F.max("c"), F.count(F.lit(1))).first()
    if longest:
        members = _with_groups(rows.select("id", *hashes), copies, ["h1", "h2"], n_copies).select("rep", "c", "id")
        shown = members.withColumn("i", F.row_number().over(W.partitionBy("rep").orderBy("id"))).filter(F.col("i") <= k + 1)
        shown = shown.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("more"))
        perms = perms.join(F.broadcast(shown) if n_copies <= BROADCAST_GROUPS else shown, "rep", "left")
    else:
        perms = perms.withColumn("more", F.lit(None).cast("array<long>"))
    posts, parts = _postings(perms, n, depth, file_cap, exact)
    posts = posts.repartition(shuffle_width(spark), *KEYS).sortWithinPartitions(*KEYS)
    near = posts.mapInArrow(_rank(k, size, order, None if exact else rerank), "id long, rep long, near_id long, place int, cos double")
    if parts:
        best = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("cos")).alias("c"), "near_id"))), 1, k)
        near = near.groupBy("id", "rep").agg(best.alias("l")).select("id", "rep", F.posexplode("l").alias("p", "x"))
        near = near.select("id", "rep", F.col("x.near_id").alias("near_id"), (F.col("p") + 1).alias("place"), (-F.col("x.c")).alias("cos"))
    if longest and longest > k + 1:
        near = cut(near)
        lists = near.filter("id is null").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("place", "near_id", "cos"))).alias("l"))
        lists = shown.select("rep", F.get("more", F.lit(k)).alias("last")).join(lists, "rep").join(copies.select("rep", "c"), "rep")
        rest = _with_groups(members.select("rep", "id"), lists, ["rep"], n_copies).filter("id > last").select("id", F.inline("l"))
        near = near.filter("id is not null").select("id", "near_id", "place", "cos").unionByName(rest.select("id", "near_id", "place", "cos"))
    return near.filter("id is not null").select("id", "near_id", "place", "cos")
