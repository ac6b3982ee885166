"""Column functions over text: cleaning, words, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in retrieval.
STOP = tuple(
    """a an the and or but if then than that this these those of in on at to for from by
    with without as is are was were be been being it its it's he she they them their there here
    what which who whom how why when where all any both each few more most other some such no nor
    not only own same so too very can will just don should now about into over under again further
    i you your my we our us me him her his do does did doing have has had having would could may
    might must shall me one two also new use used using make makes made get gets got like via per
    you're we're isn't doesn't""".split()
)
# Signs that cleaning replaces, bullets and arrows first.
SYMBOLS = {
    "○": "*", "🔹": "*", "🔸": "*", "•": "*", "◾": "*", "▪": "*", "∘": "*", "‣": "*",
    "👉": "->", "➡": "->", "→": "->", "↳": "->",
    "“": '"', "”": '"', "’": "'", "‘": "'", "—": "-", "–": "-", "‐": "-",
}
BULLETS = "○🔹🔸•◾▪∘‣"  # Fixed value
# Signs that stay when pictographs go.
KEPT_SIGNS = ("⭐", "🌟", "✅", "✔", "⚠️", "⚠")
# Cyrillic letters and the Latin ones they look like.
LOOKALIKES = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "ѕ": "s", "і": "i",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X", "У": "Y",
}


def strip_invisible(x: Column) -> Column:
    """Drop soft hyphens, zero-width characters, word joiners and byte order marks."""
    return F.regexp_replace(x, "[­​-‍⁠﻿]", "")


def tidy_spaces(x: Column) -> Column:
    """Single inner spaces (those at a line's start stay), none before closing punctuation or at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?<=\S) {2,}", " "), " +([.,!?;:])", "$1"))


def separator_line(x: Column) -> Column:
    """A line of two or more dashes, equal signs, underscores and dots, with a dash or equal sign among them, becomes `---`."""
    return F.when(F.trim(x).rlike(r"^[—–\-=_.]{2,}$") & F.trim(x).rlike(r"[—–\-=]"), F.lit("---")).otherwise(x)


def bullet_line(x: Column) -> Column:
    """A fancy bullet starts a list item: `-` at the margin, `*` when indented."""
    pattern = rf"^(\s*)(?:[{BULLETS}])(\s+.*)$"
    mark, rest = F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)
    return F.when(x.rlike(pattern), F.concat(mark, F.when(mark == "", "-").otherwise("*"), rest)).otherwise(x)


def keycaps(x: Column) -> Column:
    """Keycap digits become digits."""
    return F.regexp_replace(F.replace(x, F.lit("🔟"), F.lit("10")), "([0-9])️?⃣", "$1")


def symbols(x: Column) -> Column:
    """Bullets, arrows, curly quotes and dashes as plain signs."""
    one = {k: v for k, v in SYMBOLS.items() if len(v) == 1}
    x = F.translate(x, "".join(one), "".join(one.values()))
    for sign, plain in SYMBOLS.items():
        if len(plain) > 1:
            x = F.replace(x, F.lit(sign), F.lit(plain))
    return x


def unwrap_hashtags(x: Column) -> Column:
    """`#word` after a space or at the start, and `hashtag#word`, lose their sign; `#1` and fragments of urls stay."""
    return F.regexp_replace(F.regexp_replace(x, r"\bhashtag#([a-zA-Z][a-zA-Z0-9_]*)", "$1"), r"(?<!\S)#([a-zA-Z][a-zA-Z0-9_]*)", "$1")


def hashtag_line(x: Column) -> Column:
    """A line of nothing but hashtags; outline directives are none."""
    return (F.trim(x) != "") & ~x.startswith("#+") & F.trim(x).rlike(r"^[\s*•-]*(?:(?:hashtag#|#)[a-zA-Z][a-zA-Z0-9_]*\s*)+$")


def directive_line(x: Column) -> Column:
    """An outline's metadata or comment."""
    return x.startswith("#+") | x.startswith("# ")


def terms(x: Column) -> Column:
    """Retrieval terms: lower-cased runs that start with a letter or digit, longer than one sign, without stop words."""
    found = F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9][a-z0-9+.#_-]*"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP))


def words(x: Column) -> Column:
    return F.array_remove(F.split(F.trim(x), r"\s+", -1), "")


def word_count(x: Column) -> Column:
    """Words with a letter or digit in them."""
    return F.size(F.filter(words(x), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def cut_at_word(x: Column, limit: int) -> Column:
    """At most limit characters: cut before the last started word, trailing punctuation gone, with an ellipsis."""
    head = F.substring(x, 1, limit - 1)
    whole = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(whole, F.lit(" ,;:—-")), F.lit("…")))


def truncate_words(x: Column, limit: int) -> Column:
    """At most limit words, cut at a paragraph's end where whole paragraphs fit; ` …` marks a cut."""
    count = lambda p: F.size(words(p))
    empty = F.struct(F.lit(0).alias("taken"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(a, p):
        n = count(p)
        over = (a["taken"] > 0) & (a["used"] + n > limit)
        taken, used = F.when(over | a["done"], a["taken"]).otherwise(a["taken"] + 1), F.when(over | a["done"], a["used"]).otherwise(a["used"] + n)
        return F.struct(taken.alias("taken"), used.alias("used"), (a["done"] | over | (used >= limit)).alias("done"))

    parts = F.split(x, "\n\n", -1)
    fit = F.aggregate(parts, empty, step)
    cut = F.concat(strip(F.array_join(F.slice(parts, F.lit(1), fit["taken"]), "\n\n")), F.when(fit["used"] == count(x), "").otherwise(" …"))
    return F.when(count(x) <= limit, strip(x)).when(fit["used"] <= limit, cut).otherwise(F.concat(F.array_join(F.slice(words(x), 1, limit), " "), F.lit(" …")))


def short_query(x: Column, least: int = 28) -> Column:
    """Whole sentences until they have `least` words."""
    empty = F.struct(F.lit(0).alias("taken"), F.lit(0).alias("used"))
    parts = F.split(x, r"(?<=[.!?])\s", -1)
    fit = F.aggregate(parts, empty, lambda a, p: F.struct((a["taken"] + F.when(a["used"] < least, 1).otherwise(0)).alias("taken"), (a["used"] + F.when(a["used"] < least, F.size(words(p))).otherwise(0)).alias("used")))
    return F.array_join(F.slice(parts, F.lit(1), fit["taken"]), " ")


def names_nothing(x: Column) -> Column:
    """Whether a line has no word that says what it is about."""
    link_only = r"^(?:\[(?:[^\]\\]|\\.)*\]\((?:[^()\\]|\\.)*\)\s*)+$"
    marked = F.forall(words(x), lambda w: w.rlike(r"^(?:#|@|http://|https://|www\.)"))
    return ~x.rlike(r"[\p{L}\p{N}]") | x.rlike(link_only) | marked


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def blockquote(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, "\n", -1), lambda line: F.when(line == "", ">").otherwise(F.concat(F.lit("> "), line))), "\n")


def demote_heading(line: Column) -> Column:
    """Two levels deeper, six at most."""
    marks = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
    return F.when(marks > 0, F.concat(F.repeat(F.lit("#"), F.least(marks + 2, F.lit(6))), line.substr(marks + 1, F.length(line)))).otherwise(line)


def escape_label(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\\[\]*_`])", r"\\$1")


def yaml_list(xs: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(xs, yaml_scalar), ", "), F.lit("]"))


def yaml_scalar(x: Column) -> Column:
    """A double-quoted scalar on one line."""
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.concat(F.lit('"'), F.replace(F.replace(flat, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def kebab(x: Column) -> Column:
    """An exception's class as a reason."""
    return F.concat(F.lit("exception-"), F.lower(F.regexp_replace(x, "(?<=[^A-Z])(?=[A-Z])", "-")))


def duplicate_layer(x: Column) -> Column:
    """Text that was drawn twice: at least a fifth of 40 letters or more equal the letter before them."""
    letters = F.regexp_replace(F.lower(x), r"\P{L}+", "")
    n = F.length(letters)
    # a text without its twins is shorter by their number: no array of letters
    twin = n - F.length(F.regexp_replace(letters, r"(\p{L})(?=\1)", ""))
    return (n >= 40) & (twin >= 0.2 * n)


def annotate(page: Column, block: str) -> Column:
    """A page with a block before its problems, or at its end."""
    head = "\n## Problems"
    inside = F.replace(page, F.lit(head), F.lit(f"\n{block}\n{head}"))
    return F.when(F.contains(page, F.lit(head)), inside).otherwise(F.concat(F.rtrim(page, F.lit("\n")), F.lit(f"\n\n{block}\n")))


def author_names(json: Column) -> Column:
    """Names of authors given as a JSON string, an object with a name, or a list of either."""
    several = F.when(json.startswith("["), json).otherwise(F.concat(F.lit("["), json, F.lit("]")))
    one = lambda x: F.trim(F.coalesce(F.get_json_object(x, "$.name"), F.when(~x.startswith("{"), x)))
    return F.filter(F.transform(F.from_json(several, "array<string>"), one), lambda x: x.isNotNull() & (x != ""))


def first_sentence(x: Column, limit: int = 100, least: int = 4) -> Column:
    """The opening of a text that says something: whole sentences of lines that name anything, until they have `least` words and no colon at their end.

    On one line, cut at a word after `limit` characters; empty where nothing is named.
    """
    lines = F.filter(F.transform(F.split(x, r"\R", -1), lambda s: F.array_join(words(s), " ")), lambda s: (s != "") & ~names_nothing(s))
    parts = F.flatten(F.transform(lines, lambda s: F.split(s, "(?<=[.?!…]) ", -1)))

    def add(a, s):
        joined = F.when(a["text"] == "", s).otherwise(F.concat(a["text"], F.lit(" "), s))
        enough = (word_count(joined) >= least) & ~joined.endswith(":")
        return F.when(a["done"], a).otherwise(F.struct(joined.alias("text"), (enough | (F.length(joined) > limit)).alias("done")))

    opening = F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit(False).alias("done")), add)
    return F.when(x.isNull(), "").otherwise(cut_at_word(opening["text"], limit))


# Fixed value: counters that a video page's title opens with.
_COUNTERS = "^[0-9.,]+[KMB]? views · [0-9.,]+[KMB]? reactions \\| "


def page_headline(title: Column) -> Column:
    return F.regexp_replace(title, _COUNTERS, "")


def leads_with_link(x: Column) -> Column:
    """Whether the first line that isn't blank is nothing but links."""
    first = F.get(F.filter(F.split(x, r"\R", -1), lambda s: F.trim(s) != ""), F.lit(0))
    return F.coalesce(F.array_join(words(first), " ").rlike(r"^(?:\[(?:[^\]\\]|\\.)*\]\((?:[^()\\]|\\.)*\)\s*)+$"), F.lit(False))


def headline(streams: list[Column], abstract: Column, excerpt: Column, title: Column, note: Column, body: Column, label: Column, url: Column) -> Column:
    """A line that names an item: the first of eight candidates that says something, else `(untitled)`.

    streams: what was read of the item, best first; then abstract and excerpt, the page's title if a note says what to do
    with it, the note, the captured text (after the page's title where it opens with the link), title or label, address.
    """
    named = page_headline(F.coalesce(title, F.lit("")))
    captured = F.when(leads_with_link(body), F.concat(named, F.lit("\n"), body)).otherwise(body)
    address = F.regexp_replace(F.rtrim(F.regexp_replace(url, "^.*?://", ""), F.lit("/")), r"^www\.", "")
    candidates = [*streams, abstract, excerpt, F.when(note.isNotNull(), named), note, captured, F.when(named != "", named).otherwise(label), address]
    return F.coalesce(*(F.nullif(first_sentence(x), F.lit("")) for x in candidates), F.lit("(untitled)"))
