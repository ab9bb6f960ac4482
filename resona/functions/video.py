"""Columns derived from video records: ids in links, durations, topics, counts, dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# An id is eleven of these characters; the three link shapes that carry one.
ID = "[a-zA-Z0-9_-]{11}"
EMBED_PATTERNS = (f"v=({ID})", f"youtu\\.be/({ID})", f"shorts/({ID})")


def _first_group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def video_id_from_url(url: Column) -> Column:
    """Query parameter `v`, else the last path part of a shorts link, else the first run of eleven
    id characters, else null."""
    no_fragment = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(no_fragment, r"\?(.*)$", 1)
    raw_v = _first_group(query, r"(?:^|&)v=([^&]+)")
    v = F.coalesce(F.try_url_decode(raw_v), raw_v)
    path = F.regexp_extract(no_fragment, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?]*)?([^?]*)", 1)
    return F.coalesce(
        v,
        F.when(
            F.contains(path, F.lit("shorts")),
            F.regexp_replace(F.element_at(F.split(path, "/"), -1), ";.*$", ""),
        ),
        _first_group(url, f"({ID})"),
    )


def embed_id_from_url(url: Column) -> Column:
    """Id for the player frame: the first of the three known link shapes that occurs."""
    return F.coalesce(*[_first_group(url, p) for p in EMBED_PATTERNS])


def iso_duration_seconds(duration: Column) -> Column:
    """`PnDTnHnMnS` to seconds; null unless it starts with P. Weeks and years are not read, and an
    `M` without a `T` before it counts as minutes."""
    body = F.replace(duration, F.lit("P"), F.lit(""))
    time = F.element_at(F.split(body, "T"), -1)

    def unit(text: Column, letter: str) -> Column:
        found = F.regexp_extract(text, f"([0-9]+){letter}", 1)
        return F.coalesce(found.try_cast("double"), F.lit(0.0))

    seconds = (
        unit(body, "D") * 86400 + unit(time, "H") * 3600 + unit(time, "M") * 60 + unit(time, "S")
    )
    return F.when(F.startswith(duration, F.lit("P")), seconds)


def topics_from_wiki_urls(urls: Column) -> Column:
    """The part after the last `wiki/` of every link that has one; null gives an empty array."""
    with_topic = F.filter(F.coalesce(urls, F.array().cast("array<string>")),
                          lambda u: F.contains(u, F.lit("wiki/")))
    return F.transform(with_topic, lambda u: F.element_at(F.split(u, "wiki/"), -1))


def topics_from_wiki_text(text: Column) -> Column:
    """The same for text: one link, or a list literal such as `['https://…', '…']`."""
    as_json = F.from_json(F.translate(text, "'", '"'), "array<string>")
    urls = F.when(F.startswith(text, F.lit("[")), F.coalesce(as_json, F.array(text))).otherwise(
        F.when(text.isNotNull(), F.array(text))
    )
    return topics_from_wiki_urls(urls)


def coerce_date(text: Column) -> Column:
    """Date of a timestamp text; anything unreadable gives null."""
    return F.to_date(F.try_to_timestamp(text))


def coerce_int(value: Column) -> Column:
    """Whole number of a text or number; null, unreadable and out-of-range values give 0."""
    number = F.nanvl(value.try_cast("double"), F.lit(None))
    return F.coalesce(number.try_cast("long"), F.lit(0).cast("long"))


def combined_video_text(title: Column, description: Column, tags: Column) -> Column:
    """Title, description and tags with one space between; a missing part keeps its space."""
    empty = F.lit("")
    return F.concat(
        F.coalesce(title, empty), F.lit(" "), F.coalesce(description, empty), F.lit(" "),
        F.coalesce(F.array_join(tags, " "), empty),
    )


def engagement_rate(likes: Column, comments: Column, views: Column) -> Column:
    return (likes + comments) / F.when(views == 0, F.lit(1)).otherwise(views)
