"""Hard negatives by lists that the anchors of a cluster share.

An anchor's positives are its best rows of the same label; for each positive, its hard negatives are the best rows of other labels whose score lies
in a band below the positive's. Scores are inner products of vectors scaled and floored to whole numbers.

* Anchors are dealt to clusters by direction, the centres fitted on at most ``sample`` anchors; a cluster is cut into groups of about
  ``anchor_rows``. For a group with centre c, all of whose members lie within an angle r of c, a row x at the angle t from c scores at
  most ``|a| |x| cos(max(0, t - r))`` with the member a.
* A group meets the other rows in blocks of about ``block_rows``, dealt by the same centres. A block's rows are sorted once, by that bound, and all
  members walk the one list: a member stops where the bound falls below what it still needs, so what it has then is certain. Blocks that no member of
  a group can need are not sent to it.
* Two walks: over rows of the anchor's label for the positives, then over the others for the negatives, where a member needs the least, over
  its positives, of the greater of the band's lower end and the last negative found. Scores against a sample of rows start both off.

Blocks keep the few best rows per anchor (and positive), windows over these give the result. No group or block depends on how many rows
one label, vector or id has: rows within a cluster are dealt by a hash of the row's place.

A row with a null label, id or vector, an empty vector, or a null, infinite or NaN component takes no part. Only vectors of equal dimension meet.
Rows with the anchor's id are neither its positives nor its negatives. Repeated rows count each as candidates; equal anchors are answered
once. Ties go to the smaller id. Scores beyond 64 bits are held at the ends of the range. Fewer rows than asked for: all that there are; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import map_batches, stored
from scorebook.llm.topk_search import best, scores, table
from scorebook.session import ship_package

#: Angles and bounds are in doubles; this covers what they can be wrong by.
LOOSE = 1 + 1e-6


def labelled(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vid, label, dim, vec`` of the rows that take part, ``vec`` the scaled and floored components."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vid"), F.col(f"`{label_col}`").cast("string").alias("label"),
                     F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vid").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)

    def make():
        def step(batch: pa.RecordBatch):
            col = batch.column("vec")
            at = col.offsets.to_numpy()
            x = np.floor(col.values.to_numpy(zero_copy_only=False) * scale).astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vid"), batch.column("label"), pa.array(np.diff(at), pa.int32()),
                 pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["vid", "label", "dim", "vec"])

        return step

    return map_batches(rows, make, "vid long, label string, dim int, vec binary")


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 (or 0), and their lengths."""
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(x).max(1, initial=0)
        y = x / np.where(top > 0, top, 1)[:, None]
        n = np.sqrt((y * y).sum(1))
        return y / np.where(n > 0, n, 1)[:, None], n * top


def angles(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Angles between directions; a row without direction counts as at a right angle, which suits its length of 0."""
    return np.arccos(np.clip(u @ c.T, -1, 1))


def centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Directions that stand for clusters of the rows: spherical k-means from rows spread over the sample."""
    u = directions(x)[0]
    c = u[np.linspace(0, len(u) - 1, min(n, len(u))).astype(int)]
    for _ in range(rounds):
        near = (u @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, u)
        c = np.where(np.abs(sums).sum(1, keepdims=True) > 0, directions(sums)[0], c)
    return c


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact whole inner products of all rows of a with all rows of x."""
    most = a.shape[1] * np.abs(a).max(initial=0) * np.abs(x).max(initial=0)
    if most < 2**24:
        return (a.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return np.rint(a @ x.T).astype(np.int64)
    return np.array([scores(x, row) for row in a]).reshape(len(a), len(x))


def walk(a: np.ndarray, x: np.ndarray, c: np.ndarray, needs: np.ndarray, allowed, take, at_once: int = 1024) -> None:
    """All rows of ``a`` walk the one list of the rows of ``x`` in the order of their bounds.

    ``allowed(members, rows, s)`` marks the hits among the scores ``s``; ``take(member, rows, s)`` keeps one member's hits and says what the member
    needs from then on.
    """
    ua, la = directions(a)
    ux, lx = directions(x)
    reach = angles(ua, c[None]).max(initial=0)
    with np.errstate(over="ignore", invalid="ignore"):
        bound = lx * np.cos(np.maximum(0, angles(ux, c[None])[:, 0] - reach))
        bound = np.where(np.isnan(bound), np.inf, bound)
    order, needs = np.argsort(-bound, kind="stable"), needs.astype(float).copy()
    for start in range(0, len(x), at_once):
        rows = order[start: start + at_once]
        with np.errstate(over="ignore", invalid="ignore"):
            top = np.maximum(la * bound[rows[0]] * LOOSE, la * bound[rows[0]] / LOOSE) + 1
        going = np.flatnonzero(np.isnan(top) | (top >= needs))
        if not len(going):
            return
        s = products(a[going], x[rows])
        hits = allowed(going, rows, s) & (s >= needs[going, None])
        for k in np.flatnonzero(hits.any(1)):
            at = np.flatnonzero(hits[k])
            needs[going[k]] = take(int(going[k]), rows[at], s[k, at])


def lower_end(score: np.ndarray, low: int) -> np.ndarray:
    """The least whole score that is at least ``low`` hundredths of ``score``."""
    return np.array([-(-int(v) * low // 100) for v in score], np.int64)


class Mined:
    """Positives and hard negatives of one table's anchors, each step stored once."""

    def __init__(self, vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                 scale: int = 256, n_positives: int = 5, n_negatives: int = 5, low: int = 80, sample: int = 2048, clusters: int = 32,
                 anchor_rows: int = 512, block_rows: int = 16384):
        self.spark = vectors.sparkSession
        ship_package(self.spark)
        self.n_positives, self.n_negatives, self.low = n_positives, n_negatives, low
        rows = stored(labelled(vectors, id_col, label_col, vector_col, scale), "negatives-rows")
        anchors = rows.where(is_anchor).distinct()
        mixed = [F.xxhash64("vid"), "vid", "label", "vec"]
        fit, known = anchors.orderBy(*mixed).limit(sample).collect(), rows.orderBy(*mixed).limit(sample).collect()
        held = {}
        for d in {r["dim"] for r in fit}:
            mine, all_ = [r for r in fit if r["dim"] == d], [r for r in known if r["dim"] == d]
            n = min(clusters, max(1, len(mine) // 64))
            held[d] = (centres(table([bytes(r["vec"]) for r in mine], d), n), table([bytes(r["vec"]) for r in all_], d) if all_ else np.zeros((0, d)),
                       np.array([r["vid"] for r in all_], np.int64), np.array([r["label"] for r in all_], object))
        self.held = self.spark.sparkContext.broadcast(held)
        self.rows = self.dealt(rows, block_rows, "negatives-blocks")
        self.anchors = self.dealt(anchors, anchor_rows, "negatives-anchors").withColumnRenamed("part", "grp")

    def dealt(self, rows: DataFrame, size: int, name: str) -> DataFrame:
        """Rows with their cluster, angle to its centre, length, and the part of the cluster that holds them; dimensions without anchors go."""
        held = self.held

        def make():
            def step(batch: pa.RecordBatch):
                dims, vec = batch.column("dim").to_numpy(), batch.column("vec").to_pylist()
                c, angle, length = np.full(len(vec), -1, np.int32), np.zeros(len(vec)), np.zeros(len(vec))
                for d in np.unique(dims):
                    if int(d) in held.value:
                        at = np.flatnonzero(dims == d)
                        u, n = directions(table([vec[i] for i in at], int(d)))
                        t = angles(u, held.value[int(d)][0])
                        c[at], angle[at], length[at] = t.argmin(1), t.min(1), n
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c), pa.array(angle), pa.array(length)],
                                                 [*batch.schema.names, "c", "angle", "length"])

            return step

        schema = "vid long, label string, dim int, vec binary, c int, angle double, length double"
        placed = stored(map_batches(rows, make, schema).where("c >= 0").withColumn("no", F.monotonically_increasing_id()), name)
        sizes = placed.groupBy("dim", "c").agg(F.ceil(F.count("*") / F.lit(size)).alias("parts"))
        part = F.concat_ws("-", F.col("c"), F.pmod(F.xxhash64("no"), F.col("parts")))
        return stored(placed.join(sizes, ["dim", "c"]).withColumn("part", part).drop("parts"), name)

    def meetings(self, members: DataFrame) -> DataFrame:
        """``dim, grp, part``: the groups and blocks whose bound reaches what some member ``need``s."""
        held = self.held
        groups = members.groupBy("dim", "grp").agg(F.first("c").alias("c"), F.max("angle").alias("angle"), F.max("length").alias("length"), F.min("need").alias("need"))
        blocks = self.rows.groupBy("dim", "part").agg(F.first("c").alias("xc"), F.max("angle").alias("x_angle"), F.max("length").alias("x_length"))
        between = [(d, i, j, float(t)) for d, (c, *_) in held.value.items() for i, row in enumerate(angles(c, c)) for j, t in enumerate(row)]
        gaps = self.spark.createDataFrame(between, "dim int, c int, xc int, gap double")  # at most 32 * 32 rows a dimension
        nearest = F.greatest(F.lit(0.0), F.col("gap") - F.col("angle") - F.col("x_angle"))
        bound = F.col("length") * F.col("x_length") * F.cos(nearest)
        bound = F.greatest(bound * LOOSE, bound / LOOSE) + 1
        # A group has few hundred anchors, a block thousands of rows: their summaries meet, not the rows.
        return groups.join(gaps, ["dim", "c"]).join(blocks, ["dim", "xc"]).where(F.isnan(bound) | (bound >= F.col("need"))).select("dim", "grp", "part")

    def met(self, members: DataFrame, meet, schema: str) -> DataFrame:
        pairs = stored(self.meetings(members), "negatives-meetings")
        left, right = members.join(pairs, ["dim", "grp"]), self.rows.join(pairs, ["dim", "part"])
        return left.groupBy("dim", "grp", "part").cogroup(right.groupBy("dim", "grp", "part")).applyInPandas(meet, schema)

    def positives(self) -> DataFrame:
        """``no, vid, pos_rank, pos_id, pos_score`` of every anchor; ``no`` tells anchors with equal ids apart."""
        held, k = self.held, self.n_positives

        def make():
            def step(batch: pa.RecordBatch):
                need = np.full(batch.num_rows, -np.inf)
                label, vid = batch.column("label").to_pylist(), batch.column("vid").to_numpy()
                for i, (d, v) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("vec").to_pylist())):
                    _, x, ids, labels = held.value[d]
                    s = scores(x[(labels == label[i]) & (ids != vid[i])], np.frombuffer(v, "<f8"))
                    if len(s) >= k:
                        need[i] = np.partition(s, len(s) - k)[len(s) - k]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(need)], [*batch.schema.names, "need"])

            return step

        schema = "dim int, c int, vid long, label string, vec binary, angle double, length double, no long, grp string, need double"
        members = stored(map_batches(self.anchors.select(*[f.split()[0] for f in schema.split(", ")[:-1]]), make, schema), "negatives-members")

        def meet(a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(a) and len(x):
                d = int(a.dim.iloc[0])
                av, xv, ids, names, own = table(a.vec, d), table(x.vec, d), x.vid.to_numpy(), a.vid.to_numpy(), a.no.to_numpy()
                lx, la, needs = x.label.to_numpy(), a.label.to_numpy(), a.need.to_numpy()
                kept = {}

                def allowed(members, rows, s):
                    return (la[members][:, None] == lx[rows][None]) & (names[members][:, None] != ids[rows][None])

                def take(m, rows, s):
                    old_s, old_v = kept.get(m, (np.empty(0, np.int64), np.empty(0, np.int64)))
                    kept[m] = best(np.concatenate([old_s, s]), np.concatenate([old_v, ids[rows]]), k)
                    return max(needs[m], kept[m][0][-1]) if len(kept[m][0]) == k else needs[m]

                c = directions(directions(av)[0].sum(0)[None])[0][0]
                walk(av, xv, c, needs, allowed, take)
                found = [(int(own[m]), int(names[m]), int(v), int(s)) for m, (ss, vs) in kept.items() for s, v in zip(ss, vs)]
            return pd.DataFrame(found, columns=["no", "vid", "pos_id", "pos_score"]).astype("int64")

        near = self.met(members, meet, "no long, vid long, pos_id long, pos_score long")
        order = Window.partitionBy("no").orderBy(F.desc("pos_score"), F.asc("pos_id"))
        return near.withColumn("pos_rank", F.row_number().over(order)).where(F.col("pos_rank") <= k).select("no", "vid", "pos_rank", "pos_id", "pos_score")

    def negatives(self) -> DataFrame:
        """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` and ``pos_rank``, the positive's own rank."""
        held, k, low = self.held, self.n_negatives, self.low
        positives = stored(self.positives().where("pos_score >= 0"), "negatives-positives")  # below 0 the band is empty
        lists = positives.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("pos_rank", "pos_id", "pos_score"))).alias("pos"))  # n_positives at most
        lists = lists.select("no", F.col("pos.pos_rank").alias("pos_rank"), F.col("pos.pos_id").alias("pos_id"), F.col("pos.pos_score").alias("pos_score"))

        def make():
            def step(batch: pa.RecordBatch):
                label, vid, pos = batch.column("label").to_pylist(), batch.column("vid").to_numpy(), batch.column("pos_score").to_pylist()
                floors = []
                for i, (d, v) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("vec").to_pylist())):
                    _, x, ids, labels = held.value[d]
                    s = np.sort(scores(x[(labels != label[i]) & (ids != vid[i])], np.frombuffer(v, "<f8")))
                    ends = np.searchsorted(s, pos[i], "right")
                    floors.append([max(int(e), int(s[n - k])) if n >= k else int(e) for e, n in zip(lower_end(pos[i], low), ends)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.list_(pa.int64())), pa.array([float(min(f)) for f in floors])],
                                                 [*batch.schema.names, "floors", "need"])

            return step

        fields = ("dim int, c int, vid long, label string, vec binary, angle double, length double, no long, grp string, "
                  "pos_rank array<int>, pos_id array<long>, pos_score array<long>")
        members = self.anchors.join(lists, "no").select(*[f.split()[0] for f in fields.split(", ")])
        members = stored(map_batches(members, make, fields + ", floors array<long>, need double"), "negatives-members")

        def meet(a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(a) and len(x):
                d = int(a.dim.iloc[0])
                av, xv, ids, names, own = table(a.vec, d), table(x.vec, d), x.vid.to_numpy(), a.vid.to_numpy(), a.no.to_numpy()
                lx, la = x.label.to_numpy(), a.label.to_numpy()
                tops, floors = [np.asarray(p, np.int64) for p in a.pos_score], [np.array(f, np.int64) for f in a.floors]
                most, kept = np.array([t.max() for t in tops]), {}

                def allowed(members, rows, s):
                    return (s <= most[members][:, None]) & (la[members][:, None] != lx[rows][None]) & (names[members][:, None] != ids[rows][None])

                def take(m, rows, s):
                    for j, top in enumerate(tops[m]):
                        fits = (s <= top) & (s >= floors[m][j])
                        if fits.any():
                            old_s, old_v = kept.get((m, j), (np.empty(0, np.int64), np.empty(0, np.int64)))
                            kept[m, j] = best(np.concatenate([old_s, s[fits]]), np.concatenate([old_v, ids[rows[fits]]]), k)
                            if len(kept[m, j][0]) == k:
                                floors[m][j] = max(floors[m][j], kept[m, j][0][-1])
                    return floors[m].min()

                c = directions(directions(av)[0].sum(0)[None])[0][0]
                walk(av, xv, c, a.need.to_numpy(), allowed, take)
                ranks, pos = list(a.pos_rank), list(a.pos_id)
                found = [(int(own[m]), int(names[m]), int(ranks[m][j]), int(pos[m][j]), int(tops[m][j]), int(v), int(s))
                         for (m, j), (ss, vs) in kept.items() for s, v in zip(ss, vs)]
            return pd.DataFrame(found, columns=["no", "anchor_id", "pos_rank", "positive_id", "positive_score", "negative_id", "negative_score"]).astype("int64")

        near = self.met(members, meet, "no long, anchor_id long, pos_rank int, positive_id long, positive_score long, negative_id long, negative_score long")
        order = Window.partitionBy("no", "pos_rank").orderBy(F.desc("negative_score"), F.asc("negative_id"))
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "pos_rank")
