"""Column functions over recognised text, boxes, times, durations, captions and page metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles that only say that something went wrong.
GENERIC_TITLES = (
    "access denied", "amazon.com", "amazon.co.uk", "are you a robot?", "attention required! | cloudflare", "before you continue to youtube", "client challenge", "forbidden",
    "instagram", "just a moment...", "not found", "page not found", "perplexity", "sciencedirect", "spotify", "- youtube",
)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x, y, w, h)."""
    across = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    down = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - across * down
    return F.when(union > 0, across * down / union).otherwise(0.0)


def spatially_related(a: Column, b: Column) -> Column:
    """Overlapping boxes, or the same text row with some horizontal overlap."""
    row = F.abs(a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2) <= F.greatest(a["h"], b["h"]) * 1.15
    overlap = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    return (iou(a, b) >= 0.06) | (row & (overlap >= F.least(a["w"], b["w"]) * 0.08))


def bounding_box(points: Column) -> Column:
    """A polygon of (x, y) with the origin at the top as a box with the origin at the bottom; coordinates are shares of the frame."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    left, right, top, bottom = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.struct(left.alias("x"), (1 - bottom).alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))


def least_observations(fps: Column) -> Column:
    """(normal, short): how often normal and short text must be seen at a sampling rate."""
    normal = F.when(fps <= 0, 3).otherwise(F.greatest(F.lit(2), F.ceil(fps * 0.10)))
    short = F.when(fps <= 0, 3).otherwise(F.greatest(F.lit(3), F.ceil(fps * 0.25)))
    return F.struct(normal.cast("int").alias("normal"), short.cast("int").alias("short"))


def useful(text: Column, confidence: Column, observations: Column, fps: Column, video: Column) -> Column:
    """Whether recognised text is worth reading; a long, confident line of a video may flash by in one frame."""
    n = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    least = least_observations(fps)
    rare = video & (observations < least["normal"]) & ~((n >= 12) & (confidence >= 0.9))
    return (n > 0) & (confidence >= 0.45) & ~((n <= 3) & (observations < least["short"])) & ~rare


def duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    short = F.concat(m.cast("string"), F.lit(":"), two(s))
    return F.when(seconds.isNull() | (seconds <= 0), "").when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(short)


def from_epoch(value: Column, limit: float = 1e11) -> Column:
    """A UTC date of epoch seconds, or of milliseconds beyond the limit."""
    text = F.date_format(F.timestamp_seconds(F.when(value > limit, value / 1000).otherwise(value)), "yyyy-MM-dd")
    return F.when(value > 0, F.ltrim(text, F.lit("+")))  # years from 10000 on come with a sign


def published(numbers: list[Column], texts: list[Column]) -> Column:
    """The first usable of several (number, text) pairs as a date."""
    return F.coalesce(*(F.coalesce(from_epoch(n), F.when(F.trim(t) != "", F.replace(F.substring(F.trim(t), 1, 10), F.lit("/"), F.lit("-")))) for n, t in zip(numbers, texts)))


def utc_moment(text: Column) -> Column:
    """A moment with an offset in UTC, to the second; null without an offset."""
    iso = r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2})[T ]([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,][0-9]+)?)?)?(?:[Zz]|([+-])([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2}))?)?)$"
    part = lambda i: F.regexp_extract(text, iso, i)
    number = lambda i: F.when(part(i) == "", 0).otherwise(part(i).cast("int"))
    local = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", part(1), part(2), part(3)), F.concat(part(4), *(F.concat(F.lit(":"), F.lpad(part(i), 2, "0")) for i in (5, 6)), F.lit("+00:00"))))
    # an offset of its own hours, minutes and seconds, below a day
    offset = (number(8) * 3600 + number(9) * 60 + number(10)) * F.when(part(7) == "-", -1).otherwise(1)
    ok = text.rlike(iso) & (number(8) < 24) & (number(9) < 60) & (number(10) < 60)
    return F.when(ok, F.date_format(F.timestamp_seconds(F.unix_seconds(local) - offset), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def language_base(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, "^([^-_]*)", 1))


def caption_track(manual: Column, automatic: Column, language: Column) -> Column:
    """(key, source): the manual track of the language, exactly or by its base, else the original automatic one; a single track serves for an unknown language."""
    keys = F.filter(manual, lambda k: k != "live_chat")
    exact = F.get(F.filter(keys, lambda k: F.lower(k) == F.lower(language)), F.lit(0))
    close = F.get(F.filter(keys, lambda k: language_base(k) == language_base(language)), F.lit(0))
    only = F.when(F.size(keys) == 1, F.get(keys, F.lit(0)))
    first = F.when(language.isNull() | (language == ""), only).otherwise(F.coalesce(exact, close))
    originals = F.filter(automatic, lambda k: k.endswith("-orig"))
    mine = F.get(F.filter(originals, lambda k: language_base(k) == language_base(language)), F.lit(0))
    second = F.coalesce(mine, F.when(F.size(originals) == 1, F.get(originals, F.lit(0))))
    return F.when(first.isNotNull(), F.struct(first.alias("key"), F.lit("youtube_manual").alias("source"))).when(second.isNotNull(), F.struct(second.alias("key"), F.lit("youtube_automatic").alias("source")))


def title_or_null(raw: Column, host: Column) -> Column:
    """A title on one line; null for generic and overlong ones and those that only repeat the host."""
    x = F.trim(F.regexp_replace(raw, r"\s+", " "))
    bare = F.rtrim(F.regexp_replace(F.lower(x), r"^www\.", ""), F.lit("./ "))
    bad = (x == "") | (F.length(x) > 500) | x.rlike(r"\p{C}") | F.lower(x).isin(*GENERIC_TITLES) | F.lower(x).startswith("404 ") | (bare == host)
    return F.when(~bad, x)


def html_title(html: Column, host: Column, linked: Column | None = None) -> Column:
    """The page's own title: what it declares for sharing, then its linked data's, then `<title>`, then its first heading."""
    meta = lambda key, name: F.regexp_extract(html, rf'(?is)<meta\s+{key}="{name}"\s+content="([^"]*)"', 1)
    tag = lambda n: F.regexp_replace(F.regexp_extract(html, rf"(?is)<{n}[^>]*>(.*?)</{n}>", 1), "<[^>]*>", " ")
    found = [meta("property", "og:title"), meta("name", "twitter:title"), meta("property", "twitter:title"), tag("title"), tag("h1")]
    plain = [F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")) for x in found]
    titles = [title_or_null(x, host) for x in plain]
    if linked is not None:
        titles.insert(3, title_or_null(linked, host))
    return F.coalesce(*titles)


def refresh_target(html: Column) -> Column:
    """Where a page sends its reader: a meta refresh, or a script that is nothing but a navigation."""
    meta = F.regexp_extract(html, r"""(?is)<meta\s+http-equiv="refresh"\s+content="[^"]*?url\s*=\s*'?([^"']+)""", 1)
    script = F.regexp_extract(html, r"""(?is)<script[^>]*>\s*(?:window\s*\.\s*)?location(?:\s*\.\s*href)?\s*=\s*['"]([^'"]+)['"]\s*;?\s*</script>""", 1)
    return F.when(meta != "", F.trim(meta)).when(script != "", script)
