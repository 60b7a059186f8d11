"""Identity repair: trims, id switches and id matches from human correction actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions.text import clock
from trackspark.operators import blocks
from trackspark.operators.blocks import BLOCK
from trackspark.operators.joins import check_empty, join_keyed, with_fps


#: Frames in a stretch when rows look for the periods around them.
BUCKET = 512


def unfilled_actions(actions: DataFrame) -> DataFrame:
    """Entries a person still has to fill in: video, type and the missing field."""
    t = F.col("type")
    problem = F.concat_ws(
        ",",
        F.when((t == "id_switch") & F.col("to").isNull(), F.lit("to")),
        F.when((t == "id_switch") & F.col("from").isNull(), F.lit("from")),
        F.when((t == "id_match") & F.col("tracking_id").isNull(), F.lit("tracking_id")),
    )
    return actions.withColumn("missing", problem).filter(F.col("missing") != "")


def require_filled(actions: DataFrame) -> None:
    check_empty(unfilled_actions(actions), "action entries are unfilled")


def _outside(rows: DataFrame, cuts: DataFrame, keys: list[str], order: str, block: int) -> DataFrame:
    """Rows in no ``[_from, _to]`` of their keys.

    Rows and cuts share one line per key; along it runs the furthest end of the cuts begun so far,
    and a row is inside one exactly when that end is not before it.
    """
    line = rows.withColumn("_end", F.lit(None).cast("double")).withColumn("_row", F.lit(True))
    marks = cuts.select(*keys, F.col("_from").cast("double").alias("_at"), F.col("_to").cast("double").alias("_end"))
    line = line.withColumn("_at", F.col(order).cast("double")).unionByName(marks, allowMissingColumns=True)
    out = blocks.carry_forward(line, keys, "_at", F.col("_end"), "_last", tie=["_row"], block=block)
    inside = F.coalesce(F.col("_last") >= F.col("_at"), F.lit(False))
    return out.filter(F.col("_row") & ~inside).select(*rows.columns)


def trim(
    tracks: DataFrame,
    labels: DataFrame,
    actions: DataFrame,
    fps: DataFrame,
    *,
    entity: str = "tracking_id",
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Drop track rows inside trims; trims without an id also drop the labels there.

    Ids refer to the rows as tracked, so trims come before any renaming. A trim without a video
    cuts the labels of every video (its frames counted at the default rate) and no tracks.
    """
    cuts = actions.filter(F.col("type") == "trim").select(
        "video_id", F.col("from").alias("_from"), F.col("to").alias("_to"), F.col("id").alias(entity)
    )
    every = cuts.filter(F.col(entity).isNull()).drop(entity)
    kept = _outside(tracks, every.filter(F.col("video_id").isNotNull()), ["video_id"], "frame_idx", block)
    kept = _outside(kept, cuts.filter(F.col(entity).isNotNull()), ["video_id", entity], "frame_idx", block)
    seconds = with_fps(every, fps)
    seconds = seconds.select("video_id", (F.col("_from") / F.col("fps")).alias("_from"), (F.col("_to") / F.col("fps")).alias("_to"))
    per_block = max(1, block // 25)
    labels = _outside(labels, seconds.filter(F.col("video_id").isNotNull()), ["video_id"], "time", per_block)
    return kept, _outside(labels, seconds.filter(F.col("video_id").isNull()).drop("video_id"), [], "time", per_block)


def switch_plan(actions: DataFrame) -> DataFrame:
    """Id maps by pieces: an id before ``until`` (and after its earlier entry) becomes ``new_id``.

    The switches of a video are folded once, from the last to the first; each entry of a switch
    gives one row with the id it finally leads to. ``seq`` orders entries of one frame for one id,
    the last one wins.
    """
    switches = actions.filter(F.col("type") == "id_switch").select(
        "video_id",
        F.col("frame").cast("long").alias("f"),
        F.col("from").cast("long").alias("a"),
        F.col("to").cast("long").alias("b"),
        "seq",
    ).dropna(subset=["video_id", "f", "a", "b"])
    last = switches.groupBy("video_id", "f", "a").agg(F.max_by("b", "seq").alias("b"))
    # The renames of one frame happen at once, so they travel as one row.
    frames = last.groupBy("video_id", "f").agg(F.collect_list(F.struct("a", "b")).alias("e"))
    frames = frames.withColumn("_down", -F.col("f"))

    def step(row: dict, state):
        leads = state or {}
        new = {int(x["a"]): leads.get(int(x["b"]), int(x["b"])) for x in row["e"]}
        return {**leads, **new}, [(row["video_id"], a, int(row["f"]), b) for a, b in new.items()]

    return blocks.ordered_fold(frames, ["video_id"], ["_down"], step, "video_id string, id long, until long, new_id long")


def merge_switches(
    tracks: DataFrame, actions: DataFrame, *, entity: str = "tracking_id", block: int = BLOCK
) -> DataFrame:
    """Rename ids before each switch frame, earliest switch first.

    A row takes the next entry of its id after its frame: the entries lie on the same line as the
    rows and are carried back along it.
    """
    plan = switch_plan(actions)
    dtype = tracks.schema[entity].dataType
    marks = plan.select("video_id", F.col("id").cast(dtype).alias(entity), F.col("until").alias("_at"), "new_id")
    line = tracks.withColumns({"_at": F.col("frame_idx").cast("long"), "_row": F.lit(1)}).unionByName(
        marks.withColumn("_row", F.lit(0)), allowMissingColumns=True
    )
    entry = F.when(F.col("_row") == 0, F.struct("_at", "new_id"))
    out = blocks.carry_backward(line, ["video_id", entity], "_at", entry, "_next", tie=["_row"], block=block)
    out = out.filter(F.col("_row") == 1)
    value = F.coalesce(F.col("_next.new_id").cast(dtype), F.col(entity))
    return out.withColumn(entity, value).select(*tracks.columns)


def match_plan(tracks: DataFrame, actions: DataFrame, *, entity: str = "tracking_id") -> DataFrame:
    """``video_id, id, new_id``: where the renames of a video, in list order (``seq``), lead to.

    A match with a reference frame holds only if its id, after the earlier renames, is present
    there; only those frames are looked up, and of them only ids that matches speak of.
    """
    matches = actions.filter(F.col("type") == "id_match").select(
        "video_id",
        "seq",
        F.col("frame").cast("long").alias("f"),
        F.col("tracking_id").cast("long").alias("a"),
        F.col("protocol_id").cast("long").alias("b"),
    ).dropna(subset=["video_id", "a", "b"])
    known = matches.select("video_id", F.explode(F.array("a", "b")).alias("_id")).distinct()
    refs = matches.filter(F.col("f").isNotNull()).select("video_id", F.col("f").alias("frame_idx")).distinct()
    at = tracks.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col(entity).cast("long").alias("_id"))
    at = join_keyed(at, refs, ["video_id", "frame_idx"], "left_semi")
    at = join_keyed(at, known, ["video_id", "_id"], "left_semi")
    present = at.groupBy("video_id", F.col("frame_idx").alias("f")).agg(F.collect_set("_id").alias("ids"))
    listed = matches.join(present, ["video_id", "f"], "left").withColumn("_order", F.col("seq"))

    def step(row: dict, state):
        # id -> where it leads; the fold emits each change, the last one of an id counts.
        leads = dict(state or {})
        a, b = int(row["a"]), int(row["b"])
        there = row["ids"] is not None and any(leads.get(int(x), int(x)) == a for x in row["ids"])
        if row["f"] is None or row["f"] != row["f"] or there:
            moved = [x for x, y in leads.items() if y == a]
            moved += [a] if a not in leads else []
            leads |= {x: b for x in moved}
            return leads, [(row["video_id"], x, b, int(row["seq"])) for x in moved]
        return leads, []

    changes = blocks.ordered_fold(listed, ["video_id"], ["_order"], step, "video_id string, id long, new_id long, seq long")
    return changes.groupBy("video_id", "id").agg(F.max_by("new_id", "seq").alias("new_id"))


def match_ids(tracks: DataFrame, actions: DataFrame, *, entity: str = "tracking_id") -> DataFrame:
    """Rename tracking ids to protocol ids; the column becomes ``bird_id``."""
    plan = match_plan(tracks, actions, entity=entity)
    dtype = tracks.schema[entity].dataType
    plan = plan.select("video_id", F.col("id").cast(dtype).alias(entity), F.col("new_id").cast(dtype).alias("_new"))
    out = join_keyed(tracks, plan, ["video_id", entity], "left")
    out = out.withColumn(entity, F.coalesce("_new", entity)).select(*tracks.columns)
    return out.withColumnRenamed(entity, "bird_id")


def process_tracks(
    tracks: DataFrame, labels: DataFrame, actions: DataFrame, fps: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Trim, merge switches, match ids - for all videos in one plan."""
    require_filled(actions)
    tracks, labels = trim(tracks, labels, actions, fps)
    return match_ids(merge_switches(tracks, actions), actions), labels


def worst_id(periods: DataFrame, tracks: DataFrame, *, entity: str = "tracking_id") -> DataFrame:
    """Per period (video_id, start, end, ids): the id with the lowest mean score in range.

    The first id wins ties and is the answer when none has rows. Scores are averaged per
    (period, id) by an aggregation, so a long period is combined map-side.
    """
    # Rows meet only the periods of their id that reach into their stretch of frames.
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    keyed = periods.select("video_id", "start", "end", F.posexplode("ids").alias("pos", "_id"))
    keyed = keyed.withColumn("_bucket", F.explode(F.sequence(bucket("start"), bucket("end"))))
    rows = tracks.select("video_id", F.col(entity).alias("_id"), "frame_idx", "tracker_score").withColumn("_bucket", bucket("frame_idx"))
    inside = F.col("frame_idx").between(F.col("start"), F.col("end"))
    hit = join_keyed(rows, keyed, ["video_id", "_id", "_bucket"], "inner", condition=inside)
    means = hit.groupBy("video_id", "start", "end", "pos", "_id").agg(F.avg("tracker_score").alias("m"))
    best = (
        means.filter(F.col("m").isNotNull())
        .groupBy("video_id", "start", "end")
        .agg(F.min(F.struct("m", "pos", "_id"))["_id"].alias("worst"))
    )
    return (
        periods.join(best, ["video_id", "start", "end"], "left")
        .withColumn("worst_id", F.coalesce("worst", F.get("ids", F.lit(0))))
        .drop("worst")
    )


def action_template(
    issues: DataFrame, tracks: DataFrame, birds: DataFrame, fps: DataFrame, *, entity: str = "tracking_id"
) -> DataFrame:
    """Correction entries to review: a trim per overlap / low-score period, a switch per gained
    id, and one match per bird (``birds``: video_id, protocol_id, description)."""
    cols = ["video_id", "type", "cause", "frame", "from", "to", "id", "protocol_id", "description", "_time"]
    ev = with_fps(issues, fps)
    span = F.concat_ws("-", clock(F.col("start"), F.col("fps")), clock(F.col("end"), F.col("fps")))
    nil = F.lit(None)

    def shape(df: DataFrame, **given: Column) -> DataFrame:
        types = {
            "video_id": "string", "type": "string", "cause": "string", "description": "string",
            "_time": "string", "protocol_id": "string",
        }
        return df.select(
            *[(given.get(c, nil)).cast(types.get(c, "int")).alias(c) for c in cols]
        )

    overlap = worst_id(ev.filter(F.col("type") == "overlap"), tracks, entity=entity)
    video = F.col("video_id")
    trims = shape(
        overlap,
        video_id=video,
        type=F.lit("trim"),
        cause=F.lit("overlap"),
        **{"from": F.col("start"), "to": F.col("end")},
        id=F.col("worst_id"),
        _time=span,
    )
    lows = shape(
        ev.filter(F.col("type") == "low_score"),
        video_id=video,
        type=F.lit("trim"),
        cause=F.lit("low_score"),
        **{"from": F.col("start"), "to": F.col("end")},
        id=F.col("id"),
        _time=span,
    )
    gained = ev.filter(F.col("type") == "id_switch").withColumn("g", F.explode("gained"))
    switches = shape(
        gained,
        video_id=video,
        type=F.lit("id_switch"),
        frame=F.col("start"),
        to=F.col("g"),
        _time=clock(F.col("start"), F.col("fps")),
    )
    matches = shape(
        birds,
        video_id=video,
        type=F.lit("id_match"),
        protocol_id=F.col("protocol_id"),
        description=F.col("description"),
    )
    return trims.unionByName(lows).unionByName(switches).unionByName(matches)
