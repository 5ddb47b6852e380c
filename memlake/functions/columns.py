"""Column expressions of the event memory; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added weight of one reinforcement at full confidence, its cap, and the weight that confirms an edge.
INCREMENT, WEIGHT_CAP, CONFIRM_AT = 0.15, 1.0, 0.6
#: Days after which an edge that is not reinforced has half its weight.
HALF_LIFE_DAYS = 14.0
#: Stands for the subject of a fact that belongs to a place.
SCENE = "scene:"
RULE = "rule_fired:"


def event_time(ts: Column) -> Column:
    """Epoch seconds as a timestamp."""
    return F.timestamp_seconds(ts)


def local_hour(ts: Column) -> Column:
    """Hour of day on the session's clock."""
    return F.hour(event_time(ts))


def local_day(ts: Column) -> Column:
    """Calendar day on the session's clock, as yyyy-MM-dd."""
    return F.date_format(event_time(ts), "yyyy-MM-dd")


def local_weekday(ts: Column) -> Column:
    """mon .. sun on the session's clock."""
    return F.lower(F.date_format(event_time(ts), "E"))


def hour_bucket(ts: Column) -> Column:
    return F.format_string("%02dh", local_hour(ts))


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1000)))


def display_label(entity_id: Column, label: Column, kind: Column, place_name: Column) -> Column:
    """The name a subject is shown under; null where it can't be named.

    The label if there is one, else type and the end of the id; a scene subject has the
    name of its place, or the raw place.
    """
    own = F.coalesce(
        F.when(label != "", label), F.concat(capitalised(kind), F.lit(" "), F.expr("right(entity_id, 6)"))
    )
    place = F.coalesce(place_name, F.substring(entity_id, len(SCENE) + 1, 1000))
    return F.when(kind.isNotNull(), own).when(entity_id.startswith(SCENE), place)


def place_of(entity_id: Column) -> Column:
    """The place that a scene subject stands for."""
    return F.when(entity_id.startswith(SCENE), F.substring(entity_id, len(SCENE) + 1, 1000))


def scene_subject(location_id: Column, camera_id: Column) -> Column:
    return F.concat(F.lit(SCENE), F.coalesce(location_id, camera_id, F.lit("unknown")))


def keyframe_url(source_ref: Column) -> Column:
    """Where a picture is served; null for no picture."""
    name = F.element_at(F.split(source_ref, "/"), -1)
    return F.when(source_ref != "", F.concat(F.lit("/keyframe/"), name))


def rule_name(predicate: Column) -> Column:
    return F.when(predicate.startswith(RULE), F.substring(predicate, len(RULE) + 1, 1000)).otherwise(predicate)


def increment(confidence: Column, times: Column | int = 1) -> Column:
    """Weight that so many reinforcements of a confidence add (the order of operations matters at the border)."""
    times = F.lit(times) if isinstance(times, int) else times
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.lit(INCREMENT) * held * F.greatest(F.lit(1), times)


def reinforced(weight: Column, added: Column) -> Column:
    return F.least(F.lit(WEIGHT_CAP), F.coalesce(weight, F.lit(0.0)) + added)


def decayed(weight: Column, since: Column, now: Column | float, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """Weight after the time since the last reinforcement; unchanged if that lies ahead."""
    now = F.lit(now) if isinstance(now, (int, float)) else now
    days = (now - since) / 86400.0
    return F.when(days > 0, weight * F.pow(F.lit(0.5), days / half_life_days)).otherwise(weight)


def frequency_band(n: Column, days: Column) -> Column:
    rate = n / F.greatest(days, F.lit(1.0))
    return F.when(rate >= 3, "high").when(rate >= 0.5, "med").otherwise("low")


def contains_point(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon, by counting edges that a ray to the right crosses."""
    n = F.size(polygon)

    def crosses(p: Column, i: Column) -> Column:
        q = polygon[F.when(i == 0, n - 1).otherwise(i - 1)]
        level = (p["y"] > y) != (q["y"] > y)
        return level & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"] + F.lit(1e-9)) + p["x"])

    inside = F.size(F.filter(F.transform(polygon, crosses), lambda c: c)) % 2 == 1
    return F.when(polygon.isNull() | (n == 0), False).otherwise(inside)


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (structs x1, y1, x2, y2) relative to their union."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = (w * h).cast("double")
    area = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    return F.when(both == 0, F.lit(0.0)).otherwise(both / (area - both + F.lit(1e-9)))


def centre_distance(a: Column, b: Column) -> Column:
    """Distance of two boxes' centres in units of their mean size."""

    def mid(box: Column, low: str, high: str) -> Column:
        return (box[low] + box[high]) / 2

    apart = F.hypot(mid(a, "x1", "x2") - mid(b, "x1", "x2"), mid(a, "y1", "y2") - mid(b, "y1", "y2"))
    size = sum((F.abs(box[hi] - box[lo]) for box in (a, b) for lo, hi in (("x1", "x2"), ("y1", "y2"))), F.lit(0)) / 4
    return apart / (size + F.lit(1e-9))


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """A vector at length one; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: (x / size).cast("float"))).otherwise(v)


def literal_vector(q: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in q))


def title_from_question(question: Column, most: int = 58) -> Column:
    """A thread's title: white space squeezed, cut at a word, with an ellipsis where cut."""
    text = F.trim(F.regexp_replace(question, r"\s+", " "))
    head = F.substring(text, 1, most)
    cut = F.when(head.contains(" "), F.regexp_replace(head, r"\s\S*$", "")).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id from its content, so that a replay gives the same one."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12))


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")
