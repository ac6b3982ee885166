"""The registered queries, by family."""

from . import chat, core, details, items, links, markup, media, plans, prose, views  # noqa: F401
