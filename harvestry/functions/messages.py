"""Chat messages as Markdown: spans in UTF-16 units, hidden hyperlinks, locations, kinds. All of it runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as ur

ENTITY = "struct<type:string,offset:int,length:int,url:string>"
#: What a message's JSON is read as; numbers of places keep the form they are written in.
PAYLOAD = (
    f"message_id long, date long, text string, caption string, entities array<{ENTITY}>, caption_entities array<{ENTITY}>, forward_origin string, forward_from string, forward_from_chat string, forward_sender_name string, "
    "voice string, document string, photo string, video string, animation string, audio string, video_note string, venue struct<title:string,address:string,location:struct<latitude:string,longitude:string>>, location struct<latitude:string,longitude:string>"
)
# The kinds of attachments, in the order in which they name a message.
ATTACHMENTS = ("document", "photo", "video", "animation", "audio", "voice", "video_note")
FORWARDS = ("forward_origin", "forward_from", "forward_from_chat", "forward_sender_name")


def units(text: Column) -> Column:
    """A text's UTF-16 code units, two bytes each."""
    return F.encode(text, "UTF-16LE")


def _inside_pair(x: Column, at: Column) -> Column:
    """Whether a cut before unit `at` would part the two halves of a sign."""
    return F.hex(F.substring(x, 2 * at + 2, F.lit(1))).between("DC", "DF")


def _part(x: Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(x, 2 * start + 1, 2 * (end - start)), "UTF-16LE")


def entity_slice(text: Column, offset: Column, length: Column) -> Column:
    """The text under an entity; null if it is empty, leaves the text or parts a sign."""
    x, end = units(text), offset + length
    fits = (offset >= 0) & (length > 0) & (2 * end <= F.octet_length(x)) & ~_inside_pair(x, offset) & ~_inside_pair(x, end)
    return F.when(fits, _part(x, F.when(fits, offset).otherwise(0), F.when(fits, end).otherwise(0)))


def escaped_label(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\\[\]*_`])", r"\\$1")


def escaped_destination(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\()])", r"\\$1")


def with_links(text: Column, entities: Column) -> Column:
    """The text with its hidden hyperlinks as Markdown links; of overlapping ones the first counts, unusable ones are left out.

    A link needs a web address and a label on one line that isn't blank.
    """
    span = lambda e: F.struct(e["offset"].alias("at"), (e["offset"] + e["length"]).alias("end"), entity_slice(text, e["offset"], e["length"]).alias("label"), e["url"].alias("url"))
    linked = F.filter(entities, lambda e: (e["type"] == "text_link") & ur.scheme(e["url"]).isin("http", "https"))
    usable = F.filter(F.transform(linked, span), lambda s: s["label"].rlike(r"(?U)\S") & ~F.contains(s["label"], F.lit("\n")))
    x = units(text)

    def put(a, s):
        link = F.concat(F.lit("["), escaped_label(s["label"]), F.lit("]("), escaped_destination(s["url"]), F.lit(")"))
        after = F.struct(s["end"].alias("at"), F.concat(a["out"], _part(x, a["at"], s["at"]), link).alias("out"))
        return F.when(s["at"] < a["at"], a).otherwise(after)

    done = F.aggregate(F.array_sort(usable), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put)
    return F.when(F.coalesce(F.size(usable), F.lit(0)) <= 0, text).otherwise(F.concat(done["out"], _part(x, done["at"], (F.octet_length(x) / 2).cast("int"))))


def location(p: Column) -> Column:
    """A venue or place under a heading, with coordinates and a map link; empty without coordinates."""
    venue, place = p["venue"], F.when(p["venue"].isNotNull(), p["venue"]["location"]).otherwise(p["location"])
    heading = F.when(venue.isNotNull(), F.when(F.coalesce(venue["title"], F.lit("")) != "", venue["title"]).otherwise("Venue")).otherwise("Location")
    # a small number in full, not with an exponent
    plain = lambda x: F.when(F.contains(x, F.lit("E")), F.regexp_replace(x.cast("double").cast("decimal(30,15)").cast("string"), r"\.?0+$", "")).otherwise(x)
    at = F.concat_ws(",", plain(place["latitude"]), plain(place["longitude"]))
    address = F.when(venue["address"] != "", venue["address"])
    lines = F.concat_ws("\n", F.concat(F.lit("### "), heading), address, F.concat(F.lit("Coordinates: "), at), F.concat(F.lit("[Open in maps](https://www.google.com/maps/search/?api=1&query="), at, F.lit(")")))
    return F.when(place["latitude"].isNotNull() & place["longitude"].isNotNull(), lines).otherwise("")


def content(p: Column) -> Column:
    """A message's text or caption with its links, then its location."""
    body = F.when(p["text"].isNotNull(), with_links(p["text"], p["entities"])).otherwise(with_links(F.coalesce(p["caption"], F.lit("")), p["caption_entities"]))
    return F.array_join(F.array_remove(F.array(body, location(p)), ""), "\n\n")


def kind(p: Column) -> Column:
    """What a message is, `forwarded ` before it where it comes from elsewhere."""
    held = lambda name: p[name].isNotNull() & ~p[name].isin("", "[]", "{}", "false", "0")
    named = F.when(p["voice"].isNotNull(), "voice").when(p["text"].isNotNull(), "text").when(p["caption"].isNotNull(), "caption").when(p["venue"].isNotNull(), "venue").when(p["location"].isNotNull(), "location")
    for name in ATTACHMENTS:
        named = named.when(held(name), name.replace("_", "-"))
    forwarded = F.coalesce(*(p[name] for name in FORWARDS)).isNotNull()
    return F.concat(F.when(forwarded, "forwarded ").otherwise(""), named.otherwise("message"))


def kept(p: Column) -> Column:
    """Whether a message is worth keeping: it has a text or caption, a location or an attachment."""
    some = p["text"].isNotNull() | p["caption"].isNotNull() | (location(p) != "")
    for name in ATTACHMENTS:
        some = some | (p[name].isNotNull() & ~p[name].isin("", "[]", "{}", "false", "0"))
    return some


def entity_links(p: Column) -> Column:
    """(url, label, hidden) of the links that a message's entities name: hidden ones by their url, visible ones by the text they cover."""
    text = F.coalesce(p["text"], p["caption"], F.lit(""))
    entities = F.when(p["text"].isNotNull(), p["entities"]).otherwise(p["caption_entities"])
    covered = lambda e: entity_slice(text, e["offset"], e["length"])
    found = F.transform(F.filter(entities, lambda e: e["type"].isin("text_link", "url")), lambda e: F.struct(F.when(e["type"] == "text_link", e["url"]).otherwise(covered(e)).alias("url"), F.when(e["type"] == "text_link", covered(e)).alias("label"), (e["type"] == "text_link").alias("hidden")))
    return F.filter(found, lambda x: F.coalesce(F.trim(x["url"]), F.lit("")) != "")
