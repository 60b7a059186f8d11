"""Small string expressions: clocks, names, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clock(frame: str | Column, fps: Column | float = 25.0) -> Column:
    """Frame index as MM:SS.ff."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    t = _c(frame) / rate.cast("double")
    minutes = F.floor(t / 60)
    return F.format_string("%02d:%05.2f", minutes, t - minutes * 60)


def video_id_of(name: str | Column) -> Column:
    """``C1G3D28`` from a recording directory name; NULL when it does not parse."""
    pattern = r"(C\dG\d).*day_(\d+)"
    cage = F.regexp_extract(_c(name), pattern, 1)
    day = F.regexp_extract(_c(name), pattern, 2)
    return F.when(cage != "", F.concat(cage, F.lit("D"), day))


def stem_parts(stem: str | Column) -> Column:
    """struct(cage, group, day) of a recording stem; NULL when it does not parse."""
    pattern = r"^(C\d)(G\d)_Test_\d+_day_(\d+)_"
    s = _c(stem)
    parts = [F.regexp_extract(s, pattern, i) for i in (1, 2, 3)]
    return F.when(
        parts[0] != "",
        F.struct(parts[0].alias("cage"), parts[1].alias("group"), parts[2].cast("int").alias("day")),
    )


def cage_of(video_id: str | Column = "video_id") -> Column:
    return F.substring(_c(video_id), 1, 2)


def day_of(video_id: str | Column = "video_id") -> Column:
    return F.regexp_extract(_c(video_id), r"D(\d+)", 1)


def age_of(name: str | Column) -> Column:
    return F.nullif(F.regexp_extract(_c(name), r"age (\d+) days", 1), F.lit("")).cast("int")


def safe_name(name: str | Column) -> Column:
    """A stem made safe as a directory name; never empty."""
    s = F.regexp_replace(_c(name), r"[^\w\-]", "_")
    s = F.trim(F.regexp_replace(s, "_+", "_"), F.lit("_"))
    return F.when(s == "", F.lit("video")).otherwise(s)


def model_size(name: str | Column) -> Column:
    """Model size tag (vitb, vitl, ...) from a model name; NULL when unknown."""
    s = F.lower(_c(name))
    letter = F.regexp_extract(s, "vit([bslgh7])", 1)
    out = F.when(letter != "", F.concat(F.lit("vit"), letter))
    # Size word -> tag.
    for word, tag in (("base", "vitb"), ("large", "vitl"), ("giant", "vitg"), ("huge", "vith")):
        out = out.when(s.contains(word), F.lit(tag))
    return out


def spans_text(spans: str | Column) -> Column:
    """``[(a, b), ...]`` structs with fields start, end as 'a-b;c-d'."""
    return F.array_join(
        F.transform(_c(spans), lambda s: F.concat_ws("-", s["start"], s["end"])), ";"
    )


def parse_spans(text: str | Column) -> Column:
    def one(t: Column) -> Column:
        ab = F.split(t, "-")
        return F.struct(F.get(ab, F.lit(0)).cast("int").alias("start"), F.get(ab, F.lit(1)).cast("int").alias("end"))

    return F.transform(F.filter(F.split(_c(text), ";"), lambda t: t != ""), one)
