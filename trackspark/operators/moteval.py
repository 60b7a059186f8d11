"""Tracking quality against sparse truth: CLEAR-MOT events, identity scores, the HOTA family.

``truth``: video_id, frame_idx, id, box; ``predictions``: variant, video_id, frame_idx, id,
box. Only frames with truth are scored. Definitions follow Bernardin & Stiefelhagen (2008),
Ristani et al. (2016) and Luiten et al. (2021).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import boxes as bx
from trackspark.functions.assign import best_pairs
from trackspark.functions.text import cage_of
from trackspark.operators.blocks import BLOCK, Neighbours, carry_forward, ordered_fold
from trackspark.operators.components import components
from trackspark.operators.tiles import _starts
from trackspark.session import cut_lineage

SEQ = ["variant", "video_id"]
FRAME = ["variant", "video_id", "frame_idx"]
ALPHAS = [round(0.05 * k, 2) for k in range(1, 20)]
EPS = 2.220446049250313e-16


def _truth_grid(truth: DataFrame, variants: DataFrame) -> DataFrame:
    """Truth rows once per variant, so that a variant without predictions is scored too."""
    return truth.crossJoin(F.broadcast(variants.select("variant").distinct()))


def scored_predictions(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions in frames that have truth."""
    frames = truth.select("video_id", "frame_idx").distinct()
    return predictions.join(frames, ["video_id", "frame_idx"], "left_semi")


#: Side of a grid cell in pixels: boxes meet in the cells that they touch.
CELL = 256.0
#: Boxes that reach farther are not compared (no camera does).
FARTHEST = 1e8


def _in_cells(df: DataFrame, mark: str, cell: float) -> DataFrame:
    """One row for each grid cell (``_cx``, ``_cy``) that the box touches; boxes without area go.

    Sides and area become plain columns, so that the join's condition stays small enough to be compiled.
    """
    b = F.col("box")
    sides = {f"{mark}_{c}": b[c] for c in ("x1", "y1", "x2", "y2")}
    x1, y1, x2, y2 = (F.col(c) for c in sides)
    sane = (x2 > x1) & (y2 > y1) & (F.greatest(*[F.abs(c) for c in (x1, y1, x2, y2)]) < FARTHEST)
    df = df.withColumns(sides).drop("box").filter(sane).withColumn(f"{mark}_area", (x2 - x1) * (y2 - y1))
    for name, low, high in (("_cx", x1, x2), ("_cy", y1, y2)):
        df = df.withColumn(name, F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    return df


def box_pairs(truth: DataFrame, predictions: DataFrame, *, min_iou: float = 0.0, cell: float = CELL) -> DataFrame:
    """Overlapping truth/prediction boxes of a frame (IoU above 0 and at least ``min_iou``).

    Boxes meet in the grid cells of the frame that both touch, and a pair counts in one of them only:
    the cell of the upper left corner of what they share.
    """
    t = _in_cells(truth.select("video_id", "frame_idx", F.col("id").alias("gt_id"), "box"), "_g", cell)
    p = _in_cells(predictions.select(*FRAME, F.col("id").alias("pred_id"), "box"), "_p", cell)
    c = F.col
    left, top = F.greatest(c("_g_x1"), c("_p_x1")), F.greatest(c("_g_y1"), c("_p_y1"))
    width, height = F.least(c("_g_x2"), c("_p_x2")) - left, F.least(c("_g_y2"), c("_p_y2")) - top
    j = t.join(p, ["video_id", "frame_idx", "_cx", "_cy"]).filter((width > 0) & (height > 0))
    j = j.filter((F.floor(left / cell) == c("_cx")) & (F.floor(top / cell) == c("_cy")))
    inter = width * height
    # Boxes apart both ways may come to a union of 0, and Spark may divide before it filters.
    iou = F.try_divide(inter, c("_g_area") + c("_p_area") - inter)
    # Boxes that touch by less than a double holds share no area.
    j = j.filter((iou >= min_iou) if min_iou > 0 else (inter > 0))
    return j.select("video_id", "frame_idx", "gt_id", "variant", "pred_id", iou.alias("iou"))


#: Frames of more boxes are not folded in one task; their boxes meet in grid cells.
WIDE = 1024

MET = "variant string, video_id string, frame_idx int, gt_id long, pred_id long, iou double, share double, alone boolean, counts boolean"


def _met_in(rows: pa.Table, starts: np.ndarray, min_iou: float) -> pa.RecordBatch:
    """The pairs of whole frames, and the predictions without one; rows by frame, variant (truth first) and id."""
    n = rows.num_rows
    fresh = np.zeros(n, bool)
    fresh[starts] = True
    frame = np.cumsum(fresh) - 1
    of = rows.column("variant").combine_chunks().dictionary_encode()
    of = of.chunk(0) if isinstance(of, pa.ChunkedArray) else of
    variant = of.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = rows.column("id").fill_null(np.iinfo(np.int64).min).to_numpy()
    x1, y1, x2, y2 = (rows.column(c).fill_null(np.nan).to_numpy() for c in ("x1", "y1", "x2", "y2"))
    far = np.maximum(np.maximum(np.abs(x1), np.abs(x2)), np.maximum(np.abs(y1), np.abs(y2)))
    sane = (x2 > x1) & (y2 > y1) & (far < FARTHEST)
    area = (x2 - x1) * (y2 - y1)
    known = variant < 0
    # Runs of one variant in a frame, and of one id in that.
    turn = fresh.copy()
    turn[1:] |= variant[1:] != variant[:-1]
    seq = np.cumsum(turn)
    turn[1:] |= ids[1:] != ids[:-1]
    own = np.cumsum(turn)
    n_truth = np.bincount(frame[known], minlength=len(starts))
    mine = np.flatnonzero(~known & (n_truth[frame] > 0))
    tries = n_truth[frame[mine]]
    b = np.repeat(mine, tries)
    a = np.repeat(starts[frame[mine]] - (np.cumsum(tries) - tries), tries) + np.arange(len(b))
    width = np.minimum(x2[a], x2[b]) - np.maximum(x1[a], x1[b])
    height = np.minimum(y2[a], y2[b]) - np.maximum(y1[a], y1[b])
    hit = (width > 0) & (height > 0) & sane[a] & sane[b]
    a, b, inter = a[hit], b[hit], (width * height)[hit]
    iou = inter / (area[a] + area[b] - inter)
    # Boxes that touch by less than a double holds share no area.
    hit = (iou >= min_iou) if min_iou > 0 else (inter > 0)
    a, b, iou = a[hit], b[hit], iou[hit]
    at_gt = np.unique(seq[b] * (n + 1) + own[a], return_inverse=True)[1]
    of_gt, of_pred = np.bincount(at_gt, iou)[at_gt], np.bincount(own[b], iou)[own[b]]
    alone = (np.bincount(at_gt)[at_gt] == 1) & (np.bincount(own[b])[own[b]] == 1)
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    lost = np.setdiff1d(mine, b)
    where, blank = np.concatenate([b, lost]), [None] * len(lost)
    heads = rows.select(["variant", "video_id", "frame_idx", "id"]).take(pa.array(where)).combine_chunks()
    column = lambda t, c: t.column(c).combine_chunks()
    pad = lambda v, kind: pa.concat_arrays([v if isinstance(v, pa.Array) else pa.array(v, kind), pa.array(blank, kind)])
    arrays = [column(heads, c) for c in ("variant", "video_id", "frame_idx")]
    arrays.append(pad(column(rows.select(["id"]).take(pa.array(a)), "id"), pa.int64()))
    arrays += [column(heads, "id"), pad(iou, pa.float64()), pad(iou / (of_gt + of_pred - iou), pa.float64()), pad(alone, pa.bool_())]
    arrays += [pa.array(np.concatenate([first, np.ones(len(lost), bool)])), pa.nulls(len(where), pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(arrays, names=NAMES)


NAMES = [part.split()[0] for part in MET.split(", ")] + ["sides"]


def _unmet(rows: pa.Table) -> pa.RecordBatch:
    """Boxes of wide frames as they came."""
    n, truth = rows.num_rows, rows.column("variant").is_null().combine_chunks()
    ids, none = rows.column("id").combine_chunks(), pa.nulls(rows.num_rows, pa.int64())
    flat = np.stack([rows.column(c).fill_null(np.nan).to_numpy() for c in ("x1", "y1", "x2", "y2")], 1).ravel()
    sides = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 4), pa.array(flat))
    arrays = [rows.column(c).combine_chunks() for c in ("variant", "video_id", "frame_idx")]
    arrays += [pc.if_else(truth, ids, none), pc.if_else(truth, none, ids)]
    arrays += [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.bool_()), sides]
    return pa.RecordBatch.from_arrays(arrays, names=NAMES)


def frame_pairs(truth: DataFrame, predictions: DataFrame, *, min_iou: float = 0.0, wide: int = WIDE) -> DataFrame:
    """:func:`box_pairs` of the scored frames, stored, with what their frame tells of them.

    ``share``: the IoU over all IoUs of both boxes' ids; ``alone``: neither id has another pair in the frame;
    ``counts``: the first row of its prediction. Predictions without a pair have a row with NULL ``iou``.
    Frames of up to ``wide`` boxes take one exchange; the boxes of wider ones meet in grid cells.
    """
    own = ["video_id", "frame_idx"]
    sides = [F.col("box")[c].cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    keys = ["video_id", F.col("frame_idx").cast("int").alias("frame_idx"), F.col("id").cast("long").alias("id"), *sides]
    rows = truth.select(F.lit(None).cast("string").alias("variant"), *keys)
    rows = rows.unionByName(predictions.filter(F.col("variant").isNotNull()).select("variant", *keys)).dropna(subset=own)
    in_order = rows.repartition(*own).sortWithinPartitions("frame_idx", "video_id", "variant", "id", "x1", "x2", "y1", "y2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = None, False  # the open frame's rows; whether rows of it have gone already
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            starts = _starts(table, own)
            sizes = np.diff(np.append(starts, table.num_rows))
            big = sizes > wide
            if crowded and held is not None:
                big[0] = True
            for k in np.flatnonzero(big).tolist():
                # One row of the open frame stays, to know it by.
                last = k == len(starts) - 1
                size = int(sizes[k]) - last
                if size:
                    yield _unmet(table.slice(int(starts[k]), size))
            crowded = bool(big[-1])
            done = ~big
            done[-1] = False
            if done.any():
                part = table.filter(pa.array(np.repeat(done, sizes))) if big[:-1].any() else table.slice(0, int(starts[-1]))
                part = part.combine_chunks()
                yield _met_in(part, _starts(part, own), min_iou)
            held = table.slice(table.num_rows - 1) if crowded else table.slice(int(starts[-1]))
        if held is not None:
            yield _unmet(held) if crowded else _met_in(held.combine_chunks(), np.zeros(1, np.int64), min_iou)

    met = cut_lineage(in_order.mapInArrow(run, MET + ", sides array<double>"), "pairs")
    left = met.filter(F.col("sides").isNotNull()).withColumn("id", F.coalesce("gt_id", "pred_id"))
    box = F.struct(*[F.get("sides", F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))]).alias("box")
    known, others = (left.filter(f"variant IS {no}NULL").select("variant", *own, "id", box) for no in ("", "NOT "))
    met = met.filter(F.col("sides").isNull()).drop("sides")
    of_gt, of_pred = Window.partitionBy(*FRAME, "gt_id"), Window.partitionBy(*FRAME, "pred_id")
    pairs = box_pairs(known, others, min_iou=min_iou).withColumns(
        {
            "share": F.col("iou") / (F.sum("iou").over(of_gt) + F.sum("iou").over(of_pred) - F.col("iou")),
            "alone": (F.count("*").over(of_gt) == 1) & (F.count("*").over(of_pred) == 1),
            "counts": F.lit(False),
        }
    )
    boxes = scored_predictions(known, others).select(*FRAME, F.col("id").alias("pred_id"), F.lit(True).alias("counts"))
    crowds = cut_lineage(pairs.unionByName(boxes, allowMissingColumns=True).select(*met.columns), "crowds")
    return met.unionByName(crowds)



def _chain_matches(rows: DataFrame) -> DataFrame:
    """Frame by frame along each chain: kept partners first, then the best assignment of the rest."""

    def step(row: dict, partner: dict | None):
        partner = {} if partner is None else partner
        partner.update((q["gt_id"], q["pred_id"]) for q in row["seeds"])
        pairs = [(q["gt_id"], q["pred_id"], q["iou"]) for q in row["pairs"]]
        valid = {(a, b): s for a, b, s in pairs}
        used_p: set = set()
        out = []
        for a in sorted({p[0] for p in pairs}):
            b = partner.get(a)
            if (a, b) in valid and b not in used_p:
                used_p.add(b)
                out.append((a, b, valid[a, b]))
        used_g = {a for a, _, _ in out}
        rest = [q for q in pairs if q[0] not in used_g and q[1] not in used_p]
        out += [rest[k] for k in best_pairs(rest, most=True)]
        partner.update((a, b) for a, b, _ in out)
        head = row["variant"], row["video_id"], row["frame_idx"]
        return partner, [(*head, *q) for q in out]

    schema = "variant string, video_id string, frame_idx int, gt_id long, pred_id long, iou double"
    return ordered_fold(rows, [*SEQ, "chain_id", "chain_start"], ["frame_idx"], step, schema)


def clear_matches(met: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``variant, video_id, frame_idx, gt_id, pred_id, iou``: the matched boxes among the :func:`frame_pairs` ``met``.

    A truth box with one valid partner that has no other is matched whatever came before, and its
    partner is then known. Only the stretches between such frames, where a choice depends on the
    partner remembered, are ordered: a stretch of one id belongs to the same chain as those it shares a
    prediction with, and each chain is folded on its own.
    """
    at_pred = Window.partitionBy(*FRAME, "pred_id")
    pairs = met.filter(F.col("iou").isNotNull()).select(*FRAME, "gt_id", "pred_id", "iou", F.col("alone").alias("plain"))
    ids = [*SEQ, "gt_id"]
    seen = pairs.groupBy(*FRAME, "gt_id").agg(F.bool_and("plain").alias("plain"), F.max(F.when(F.col("plain"), F.col("pred_id"))).alias("known"))
    before = Neighbours(seen, ids, "frame_idx", back=1, block=block)
    seen = before.with_columns({"settled": F.coalesce(before.lag("plain"), F.lit(True)), "seed": before.lag("known")})
    opens = F.when(F.col("settled"), F.col("frame_idx"))
    open_rows = seen.filter(~F.col("plain")).withColumn("seed", F.when(F.col("settled"), F.col("seed")))
    stretches = carry_forward(open_rows, ids, "frame_idx", opens, "start", block=block)
    own = F.struct(F.col("start"), F.col("gt_id"))
    rows = pairs.filter(~F.col("plain")).drop("plain").join(stretches.select(*FRAME, "gt_id", "start", "seed"), [*FRAME, "gt_id"])
    rows = cut_lineage(rows.withColumn("own", own).withColumn("first", F.min("own").over(at_pred)), "choices")
    chain = components(rows, SEQ, "own", "first").select(*SEQ, F.col("node").alias("own"), F.col("component"))
    rows = rows.join(chain, [*SEQ, "own"], "left").withColumn("_c", F.coalesce("component", "own"))
    of_chain = [*FRAME, F.col("_c.gt_id").alias("chain_id"), F.col("_c.start").alias("chain_start")]
    seed = F.when(F.col("seed").isNotNull(), F.struct("gt_id", F.col("seed").alias("pred_id")))
    frames = rows.groupBy(*of_chain).agg(
        F.sort_array(F.collect_list(F.struct("gt_id", "pred_id", "iou"))).alias("pairs"), F.collect_set(seed).alias("seeds")
    )
    return pairs.filter("plain").drop("plain").unionByName(_chain_matches(frames))


def clear_events(
    truth: DataFrame,
    predictions: DataFrame,
    variants: DataFrame,
    *,
    min_iou: float = 0.5,
    block: int = BLOCK,
    met: DataFrame | None = None,
) -> DataFrame:
    """MATCH / SWITCH / MISS / FP per scored frame.

    A match is a switch if the truth id's last match was another prediction. ``met``: the :func:`frame_pairs`, if
    they are known.
    """
    met = frame_pairs(truth, predictions, min_iou=min_iou) if met is None else met
    found = clear_matches(met, block=block)
    last = Neighbours(found, [*SEQ, "gt_id"], "frame_idx", back=1, block=block)
    found = cut_lineage(last.with_columns({"_last": last.lag("pred_id")}), "matches")
    kind = F.when(F.col("pred_id").isNull(), "MISS").when(F.col("_last") != F.col("pred_id"), "SWITCH").otherwise("MATCH")
    objects = _truth_grid(truth, variants).select(*FRAME, F.col("id").alias("gt_id")).join(found, [*FRAME, "gt_id"], "left")
    columns = [*FRAME, "type", "gt_id", "pred_id", "iou"]
    others = met.filter("counts").select(*FRAME, "pred_id").join(found, [*FRAME, "pred_id"], "left_anti")
    others = others.select(*FRAME, F.lit("FP").alias("type"), F.lit(None).cast("long").alias("gt_id"), "pred_id", F.lit(None).cast("double").alias("iou"))
    return objects.withColumn("type", kind).select(*columns).unionByName(others)


def clear_counts(events: DataFrame) -> DataFrame:
    """Additive counts per (variant, video)."""
    hit = F.col("type").isin("MATCH", "SWITCH")
    base = events.groupBy(*SEQ).agg(
        F.count_distinct(F.when(F.col("gt_id").isNotNull(), F.col("frame_idx"))).alias("num_frames"),
        F.count("gt_id").alias("num_objects"),
        F.count("pred_id").alias("num_predictions"),
        F.count_if(hit).alias("num_detections"),
        F.count_if(F.col("type") == "SWITCH").alias("num_switches"),
        F.count_if(F.col("type") == "FP").alias("num_false_positives"),
        F.count_if(F.col("type") == "MISS").alias("num_misses"),
        F.coalesce(F.sum(F.when(hit, 1 - F.col("iou"))), F.lit(0.0)).alias("distance"),
    )
    own = events.filter(F.col("gt_id").isNotNull()).withColumn("hit", hit)
    life = Window.partitionBy(*SEQ, "gt_id")
    order = life.orderBy("frame_idx")
    lost = ~F.col("hit") & F.lag("hit").over(order)
    last_hit = F.max(F.when(F.col("hit"), F.col("frame_idx"))).over(life)
    per_object = (
        own.withColumn("frag", lost & (F.col("frame_idx") < last_hit))
        .groupBy(*SEQ, "gt_id")
        .agg(F.avg(F.col("hit").cast("double")).alias("ratio"), F.count_if("frag").alias("frag"))
    )
    objects = per_object.groupBy(*SEQ).agg(
        F.count(F.lit(1)).alias("num_unique_objects"),
        F.count_if(F.col("ratio") >= 0.8).alias("mostly_tracked"),
        F.count_if((F.col("ratio") >= 0.2) & (F.col("ratio") < 0.8)).alias("partially_tracked"),
        F.count_if(F.col("ratio") < 0.2).alias("mostly_lost"),
        F.sum("frag").alias("num_fragmentations"),
    )
    return base.join(objects, SEQ, "left").withColumn("num_unique_objects", F.coalesce("num_unique_objects", F.lit(0)).cast("long"))


def identity_counts(
    truth: DataFrame, predictions: DataFrame, variants: DataFrame, *, min_iou: float = 0.5, met: DataFrame | None = None
) -> DataFrame:
    """idtp / idfn / idfp per (variant, video): one assignment of ids over all frames.

    Ids that ever meet are edges of a graph; its components are assigned one by one over their edges
    alone, so no table of all ids of a video is ever built. ``met``: the :func:`frame_pairs`, if they are known.
    """
    met = frame_pairs(truth, predictions, min_iou=min_iou) if met is None else met
    meets = met.filter(F.col("iou").isNotNull()).groupBy(*SEQ, "gt_id", "pred_id").agg(F.count(F.lit(1)).alias("n"))
    meets = meets.withColumn("a", F.struct(F.lit(0).alias("side"), F.col("gt_id").alias("id")))
    meets = cut_lineage(meets.withColumn("b", F.struct(F.lit(1).alias("side"), F.col("pred_id").alias("id"))), "meets")
    parts = components(meets, SEQ).select(*SEQ, F.col("node").alias("b"), F.col("component"))
    # Every prediction meets a truth id, and truth ids are the lesser nodes.
    meets = meets.join(parts, [*SEQ, "b"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["gt_id"], pdf["pred_id"], pdf["n"].tolist()))
        total = sum(rows[k][2] for k in best_pairs(rows, most=False))
        return pd.DataFrame({"variant": [pdf["variant"].iloc[0]], "video_id": [pdf["video_id"].iloc[0]], "n": [int(total)]})

    found = meets.drop("a", "b").groupBy(*SEQ, "component").applyInPandas(solve, "variant string, video_id string, n long")
    found = found.groupBy(*SEQ).agg(F.sum("n").alias("idtp"))
    # Counted before the variants are spelled out.
    objects = _truth_grid(truth.groupBy("video_id").agg(F.count("id").alias("_o")), variants)
    preds = met.filter("counts").groupBy(*SEQ).agg(F.count("pred_id").alias("_p"))
    out = objects.join(preds, SEQ, "left").join(found, SEQ, "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("_p", "idtp")}
    out = out.withColumns(zero)
    return out.select(*SEQ, "idtp", (F.col("_o") - F.col("idtp")).alias("idfn"), (F.col("_p") - F.col("idtp")).alias("idfp"))


def _chosen_rows(rows: pa.Table, starts: np.ndarray) -> np.ndarray:
    """Indices of the pairs that the best assignment of each frame (from ``starts``) chooses; rows by frame and truth id.

    A truth id takes its best prediction. Only frames where two of them take the same are assigned.
    """
    fresh = np.zeros(rows.num_rows, bool)
    fresh[starts] = True
    frame = np.cumsum(fresh) - 1
    gt, pred, s = (rows.column(c).to_numpy() for c in ("gt_id", "pred_id", "s"))
    heads = np.flatnonzero(fresh | (np.diff(gt, prepend=gt[0] - 1) != 0))
    owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(gt))))
    top = np.where(s == np.maximum.reduceat(s, heads)[owner], np.arange(len(s)), len(s))
    best = np.minimum.reduceat(top, heads)
    order = np.lexsort((pred[best], frame[best]))
    f, q = frame[best][order], pred[best][order]
    twice = np.zeros(frame[-1] + 1, bool)
    twice[f[1:][(f[1:] == f[:-1]) & (q[1:] == q[:-1])]] = True
    out = [best[~twice[frame[best]]]]
    edges = np.append(starts, rows.num_rows)
    for k in np.flatnonzero(twice).tolist():
        a, e = edges[k], edges[k + 1]
        pairs = list(zip(gt[a:e].tolist(), pred[a:e].tolist(), s[a:e].tolist()))
        out.append(a + np.array(best_pairs(pairs, most=False), np.int64))
    return np.sort(np.concatenate(out))


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over rows in order of frame; a frame may go on in the next batch."""
    held: list[pa.RecordBatch] = []

    def chosen(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        out = rows.select([*SEQ, "gt_id", "pred_id", "iou"]).take(pa.array(_chosen_rows(rows, starts))).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in out.columns], names=out.column_names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        starts = _starts(rows, FRAME)
        cut = int(starts[-1])
        held = rows.slice(cut).to_batches()
        if cut:
            yield chosen(rows.slice(0, cut), starts[:-1])
    if held:
        yield chosen(pa.Table.from_batches(held).combine_chunks(), np.zeros(1, np.int64))


def hota_terms(truth: DataFrame, predictions: DataFrame, variants: DataFrame) -> DataFrame:
    """Per (variant, video, alpha): TP, FN, FP and the association and localisation terms."""
    # Counted before the variants are spelled out.
    g_count = truth.groupBy("video_id", F.col("id").alias("gt_id")).agg(F.count(F.lit(1)).alias("gc"))
    g_count = cut_lineage(_truth_grid(g_count, variants).select(*SEQ, "gt_id", "gc"), "truth-counts")
    pairs = frame_pairs(truth, predictions)
    # How many alphas a match satisfies; counted before the alphas are spelled out.
    alphas = F.array(*[F.lit(a) for a in ALPHAS])
    level = F.size(F.filter(alphas, lambda a: F.col("iou") >= a - EPS))
    # A pair whose boxes have no other is matched whatever its score.
    ids = [*SEQ, "gt_id", "pred_id"]
    counts = [F.count("iou").alias("n"), F.sum("iou").alias("loc")]
    met = pairs.groupBy(*ids, F.when(F.col("alone"), level).alias("level"))
    met = cut_lineage(met.agg(*counts, F.sum("share").alias("_pot"), F.count_if("counts").alias("pc")), "meets")
    p_count = met.groupBy(*SEQ, "pred_id").agg(F.sum("pc").alias("pc"))
    potential = met.groupBy(*ids).agg(F.sum("_pot").alias("_pot"))
    aligned = (
        potential.join(g_count, [*SEQ, "gt_id"])
        .join(p_count, [*SEQ, "pred_id"])
        .withColumn("_score", F.col("_pot") / (F.col("gc") + F.col("pc") - F.col("_pot")))
    )
    scored = pairs.filter(~F.col("alone")).join(aligned.select(*ids, "_score"), ids)
    scored = scored.select(*FRAME, "gt_id", "pred_id", "iou", (F.col("_score") * F.col("iou")).alias("s"))
    in_order = scored.repartition(*FRAME).sortWithinPartitions("frame_idx", "video_id", "variant", "gt_id", "pred_id")
    matched = in_order.mapInArrow(_choose, "variant string, video_id string, gt_id long, pred_id long, iou double")
    counted = matched.groupBy(*ids, level.alias("level")).agg(*counts)
    counted = counted.unionByName(met.filter(F.col("level").isNotNull()).select(*counted.columns))
    at = F.sequence(F.lit(1), F.lit(len(ALPHAS)))
    spread = counted.withColumn("a", F.explode(F.filter(at, lambda a: a <= F.col("level"))))
    per_pair = (
        spread.groupBy(*SEQ, "gt_id", "pred_id", "a")
        .agg(F.sum("n").alias("m"), F.sum("loc").alias("loc"))
        .join(g_count, [*SEQ, "gt_id"])
        .join(p_count, [*SEQ, "pred_id"])
    )
    m = F.col("m")
    per_alpha = per_pair.groupBy(*SEQ, "a").agg(
        F.sum("m").alias("tp"),
        F.sum("loc").alias("loc"),
        F.sum(m * m / (F.col("gc") + F.col("pc") - m)).alias("ass_a"),
        F.sum(m * m / F.col("gc")).alias("ass_re"),
        F.sum(m * m / F.col("pc")).alias("ass_pr"),
    )
    totals = g_count.groupBy(*SEQ).agg(F.sum("gc").alias("_g")).join(
        p_count.groupBy(*SEQ).agg(F.sum("pc").alias("_p")), SEQ, "left"
    )
    full = totals.withColumn("a", F.explode(at)).join(per_alpha, [*SEQ, "a"], "left")
    terms = ["tp", "loc", "ass_a", "ass_re", "ass_pr", "_p"]
    full = full.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in terms})
    return full.select(
        *SEQ,
        (F.col("a") * F.lit(0.05)).alias("alpha"),
        "tp",
        (F.col("_g") - F.col("tp")).alias("fn"),
        (F.col("_p") - F.col("tp")).alias("fp"),
        "loc",
        "ass_a",
        "ass_re",
        "ass_pr",
    )


def _levels(df: DataFrame, level: str) -> tuple[DataFrame, list[str]]:
    keys = {"video": ["variant", "video_id"], "cage": ["variant", "cage"], "all": ["variant"]}[level]
    return df.withColumn("cage", cage_of("video_id")), keys


def hota_scores(terms: DataFrame, *, level: str = "video") -> DataFrame:
    """HOTA family per video, cage or variant: terms add up, then the mean over the alphas."""
    rows, keys = _levels(terms, level)
    names = ["tp", "fn", "fp", "loc", "ass_a", "ass_re", "ass_pr"]
    s = rows.groupBy(*keys, "alpha").agg(*[F.sum(c).alias(c) for c in names])
    one = F.lit(1)
    tp = F.col("tp")

    def over(num: Column, den: Column) -> Column:
        return num / F.greatest(den, one)

    s = s.withColumns(
        {
            "DetA": over(tp, tp + F.col("fn") + F.col("fp")),
            "DetRe": over(tp, tp + F.col("fn")),
            "DetPr": over(tp, tp + F.col("fp")),
            "AssA": over(F.col("ass_a"), tp),
            "AssRe": over(F.col("ass_re"), tp),
            "AssPr": over(F.col("ass_pr"), tp),
            "LocA": F.when(tp > 0, F.col("loc") / tp).otherwise(F.lit(1.0)),
        }
    )
    s = s.withColumns(
        {"HOTA": F.sqrt(F.col("DetA") * F.col("AssA")), "OWTA": F.sqrt(F.col("DetRe") * F.col("AssA"))}
    )
    out = ["HOTA", "DetA", "AssA", "LocA", "DetRe", "DetPr", "AssRe", "AssPr", "OWTA"]
    return s.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in out])


def mot_scores(counts: DataFrame, ids: DataFrame, *, level: str = "video") -> DataFrame:
    """CLEAR-MOT and identity scores per video, cage or variant from the additive counts."""
    rows, keys = _levels(counts.join(ids, SEQ), level)
    names = [c for c in rows.columns if c not in ("variant", "video_id", "cage")]
    s = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    c = {n: F.col(n) for n in names}
    ratio = lambda a, b: F.when(b > 0, a / b)
    errors = c["num_misses"] + c["num_switches"] + c["num_false_positives"]
    return s.withColumns(
        {
            "mota": 1 - ratio(errors, c["num_objects"]),
            "motp": ratio(c["distance"], c["num_detections"]),
            "precision": ratio(c["num_detections"], c["num_detections"] + c["num_false_positives"]),
            "recall": ratio(c["num_detections"], c["num_objects"]),
            "idp": ratio(c["idtp"], c["idtp"] + c["idfp"]),
            "idr": ratio(c["idtp"], c["idtp"] + c["idfn"]),
            "idf1": ratio(2 * c["idtp"], 2 * c["idtp"] + c["idfp"] + c["idfn"]),
        }
    ).drop("distance", "num_detections", "num_predictions", "idtp", "idfn", "idfp")


def variant_spread(scores: DataFrame, *, reference: str, metrics: tuple[str, ...] = ("HOTA", "idf1")) -> DataFrame:
    """Per variant: mean and sample SD of the per-video scores and the gap to ``reference``."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd")]
    per = scores.groupBy("variant").agg(*aggs)
    ref = per.filter(F.col("variant") == reference).select(
        *[F.col(f"{m}_mean").alias(f"_ref_{m}") for m in metrics]
    )
    out = per.crossJoin(F.broadcast(ref))  # one row
    out = out.withColumns({f"{m}_delta": F.col(f"{m}_mean") - F.col(f"_ref_{m}") for m in metrics})
    return out.drop(*[f"_ref_{m}" for m in metrics])


def video_by_variant(scores: DataFrame, metric: str, variants: list[str]) -> DataFrame:
    """One row per video, the metric of every variant as a column."""
    return scores.groupBy("video_id").pivot("variant", variants).agg(F.first(metric))


def mot_rows(tracks: DataFrame, *, entity: str = "tracking_id", score: str = "tracker_score") -> DataFrame:
    """Tracks or detections as text rows ``frame,id,x,y,w,h,conf,-1,-1,-1`` (untracked dropped)."""
    b = bx.box_from_array("bbox") if "bbox" in tracks.columns else bx.box()
    conf = F.coalesce(F.col(score), F.lit(1.0))
    fmt = "%d,%d,%.2f,%.2f,%.2f,%.2f,%.4f,-1,-1,-1"
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    line = F.format_string(fmt, F.col("frame_idx"), F.col(entity), b["x1"], b["y1"], w, h, conf)
    keep = [c for c in ("variant", "video_id") if c in tracks.columns]
    return tracks.filter(F.col(entity) != -1).select(
        *keep, "frame_idx", F.col(entity).alias("id"), line.alias("line")
    )


def expected_outputs(rows: DataFrame, variants: DataFrame, videos: DataFrame) -> DataFrame:
    """Row counts for every (variant, video), 0 where a variant has no output."""
    grid = variants.select("variant").distinct().crossJoin(F.broadcast(videos.select("video_id").distinct()))
    n = rows.groupBy(*SEQ).agg(F.count(F.lit(1)).alias("n_rows"))
    return grid.join(n, SEQ, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
