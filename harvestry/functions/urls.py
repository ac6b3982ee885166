"""Column functions over URLs: parts, canonical forms, redirectors, identities, routing and priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters and prefixes that identify the sender, not the destination.
TRACKING = ("cbrd", "igsh", "si", "is", "fbclid", "rcm")
TRACKING_PREFIX = ("utm_", "cp_landing")
# Query parameters that text cleaning drops.
UNWANTED = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "rcm", "ref", "source", "mc_cid", "mc_eid", "hss_channel", "spm", "click_id")
# Hosts by what their links are.
REPOSITORY_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "medium.com", "t.me", "telegram.me", "threads.net", "tiktok.com", "twitter.com", "x.com", "youtube.com")
IMAGE_HOSTS = ("cdn.discordapp.com", "i.imgur.com", "i.redd.it", "media.licdn.com", "pbs.twimg.com", "preview.redd.it", "scontent.cdninstagram.com")
STORE_HOSTS = ("amazon.co.uk", "amazon.com", "amzn.to", "buymeacoffee.com", "eepurl.com", "gumroad.com", "patreon.com", "shopify.com")
CHAT_HOSTS = ("t.me", "telegram.me", "telegram.dog")
HASHTAG_PATHS = ("/hashtag/", "/explore/tags/", "/tags/")
# Redirectors, the parameter that holds their destination and the path they are confined to.
REDIRECTORS = (
    ("consent.google.com", ("continue",), None), ("consent.youtube.com", ("continue",), None),
    ("l.facebook.com", ("u",), "/l.php"), ("lm.facebook.com", ("u",), "/l.php"),
    ("www.google.com", ("q", "url"), "/url"), ("google.com", ("q", "url"), "/url"),
    ("www.youtube.com", ("q",), "/redirect"), ("youtube.com", ("q",), "/redirect"),
    ("link.zhihu.com", ("target",), None), ("steamcommunity.com", ("url",), None), ("away.vk.com", ("to",), None),
    ("www.linkedin.com", ("url",), "/safety/go"), ("linkedin.com", ("url",), "/safety/go"),
)
# Shorteners, and suffixes of their hosts.
SHORTENERS = tuple(
    """1url.com 2.gp 2pl.us 3.ly 4sq.com 7.ly 9qr.de a.co adf.ly alnk.to aka.ms amzn.eu amzn.to aol.it apple.co b.link bbc.in bc.vc bit.do
    bit.ly bitly.com bl.ink brlnk.io buff.ly cli.re cnn.it cos.lv cutt.ly cutt.us db.tt detne.ws dlvr.it econ.st eepurl.com fb.me flip.it
    forms.gle fur.ly g.co gg.gg git.io go2l.ink goo.gl goo.gle ht.ly hubs.la hubs.li huff.to ift.tt is.gd ity.im j.mp lat.ms lc.chat
    lnk.bio lnk.to lnkd.in mcaf.ee mzl.la n.pr nyer.cm nyti.ms on.freep.com ow.ly p4k.in qr.ae rb.gy read.bi rebrand.ly rol.st s.id
    say.ly shar.es shiny.link short.io shorturl.at shrtco.de snip.ly soo.gd spoti.fi stanford.io t.co t.ly thebea.st therin.gr tiny.cc
    tiny.one tinyurl.com tmblr.co trib.in v.gd wa.link wapo.st wp.me x.co yousend.it youtu.be""".split()
)
SHORTENER_SUFFIXES = (".trib.al", ".safelinks.protection.outlook.com")
PRIORITY = {"research": 1, "sole": 2, "repository": 3, "document": 4, "nested": 5, "deprioritized": 9}

_HEAD = "^[A-Za-z][A-Za-z0-9+.-]*://"
_HOST = r"(?:\[[^\]/?#]*\]|[^/?#:@]*)"  # an address of the sixth version stands in brackets


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(u: Column) -> Column:
    return F.regexp_extract(u, f"{_HEAD}([^/?#]*)", 1)


def host(u: Column) -> Column:
    """Lower-cased, without credentials and port; an address in brackets keeps them."""
    return F.lower(F.regexp_extract(u, f"{_HEAD}(?:[^/?#@]*@)?({_HOST})", 1))


def port(u: Column) -> Column:
    return F.regexp_extract(u, f"{_HEAD}(?:[^/?#@]*@)?{_HOST}:([0-9]+)", 1)


def bare_host(u: Column) -> Column:
    return F.regexp_replace(host(u), r"^www\.", "")


def path(u: Column) -> Column:
    return F.regexp_extract(u, f"{_HEAD}[^/?#]*([^?#]*)", 1)


def path_parts(u: Column) -> Column:
    return F.array_remove(F.split(path(u), "/", -1), "")


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def fragment(u: Column) -> Column:
    return F.regexp_extract(u, "#(.*)$", 1)


def with_scheme(u: Column) -> Column:
    return F.when(scheme(u) != "", u).otherwise(F.concat(F.lit("https://"), u))


def decode(x: Column) -> Column:
    """A form-encoded value; one with a broken escape keeps its escapes."""
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def encode(x: Column) -> Column:
    """Form encoding that leaves letters, digits and `_.-~` alone."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def parameters(u: Column) -> Column:
    """Decoded (name, value) of each parameter, blank values kept."""
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    value = lambda p: p.substr(F.length(name(p)) + 2, F.length(p))
    return F.transform(F.array_remove(F.split(query(u), "&", -1), ""), lambda p: F.struct(decode(name(p)).alias("name"), decode(value(p)).alias("value")))


def parameter(u: Column, name: str) -> Column:
    """The first non-empty value of a parameter, else null."""
    return F.get(F.filter(parameters(u), lambda p: (p["name"] == name) & (p["value"] != "")), F.lit(0))["value"]


def _joined(ps: Column) -> Column:
    return F.array_join(F.transform(ps, lambda p: F.concat(encode(p["name"]), F.lit("="), encode(p["value"]))), "&")


def _after(mark: str, x: Column) -> Column:
    return F.when(x != "", F.concat(F.lit(mark), x)).otherwise("")


def tracks(name: Column) -> Column:
    low = F.lower(name)
    out = low.isin(*TRACKING)
    for prefix in TRACKING_PREFIX:
        out = out | low.startswith(prefix)
    return out


def canonical(raw: Column) -> Column:
    """One target, one form: lower-cased scheme and host, no default port, no tracking parameters, query encoded anew, fragment kept.

    Other schemes, urls without a host and those with credentials stay as they are; null stays null.
    """
    u = F.trim(raw)
    number = port(u).cast("int")
    shown = (port(u) != "") & (number != F.when(scheme(u) == "http", 80).otherwise(443))
    kept = _joined(F.filter(parameters(u), lambda p: ~tracks(p["name"])))
    out = F.concat(scheme(u), F.lit("://"), host(u), F.when(shown, F.concat(F.lit(":"), number.cast("string"))).otherwise(""), path(u), _after("?", kept), _after("#", fragment(u)))
    return F.when(scheme(u).isin("http", "https") & (host(u) != "") & ~F.contains(authority(u), F.lit("@")), out).otherwise(raw)


def clean(u: Column) -> Column:
    """Without the parameters that text cleaning drops; a url without a query stays as it is."""
    kept = _joined(F.filter(parameters(u), lambda p: ~F.lower(p["name"]).isin(*UNWANTED)))
    return F.when(query(u) == "", u).otherwise(F.concat(scheme(u), F.lit("://"), authority(u), path(u), _after("?", kept), _after("#", fragment(u))))


def document_url(raw: Column) -> Column:
    """A document's identity: sorted parameters, no fragment, `/` for an empty path."""
    u = F.trim(raw)
    return F.concat(scheme(u), F.lit("://"), F.lower(authority(u)), F.when(path(u) == "", "/").otherwise(path(u)), _after("?", _joined(F.array_sort(parameters(u)))))


def document_id(raw: Column) -> Column:
    """A readable label of at most 70 characters, then ten digits of the identity's digest."""
    u = document_url(raw)
    last = F.regexp_extract(F.rtrim(path(u), F.lit("/")), "([^/]*)$", 1)
    stem = F.when(last == "", "index").otherwise(F.regexp_replace(last, r"^(.+)\.[^.]+$", "$1"))
    label = F.regexp_replace(F.regexp_replace(F.lower(F.concat(host(u), F.lit("-"), stem)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.substring(label, 1, 70), F.lit("-"), F.substring(F.sha2(u, 256), 1, 10))


def _destination(x: Column) -> Column:
    """A url inside a field, unescaped at most three times; null if it is no web address."""
    plain = F.trim(F.replace(x, F.lit("&amp;"), F.lit("&")))
    once = lambda a, _: F.coalesce(F.try_url_decode(F.replace(a, F.lit("+"), F.lit("%2B"))), a)
    done = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), plain, once)
    return F.get(F.filter(F.array(done), lambda v: scheme(v).isin("http", "https")), F.lit(0))


def embedded(u: Column) -> Column:
    """The destination that a known redirector carries in its url, else null."""
    h, p = host(u), path(u)
    first, second = F.lit(None).cast("string"), F.lit(None).cast("string")
    groups: dict[tuple, list[str]] = {}
    for name, keys, only in REDIRECTORS:
        groups.setdefault((keys, only), []).append(name)
    for (keys, only), names in groups.items():
        here = h.isin(*names) & (p == only) if only else h.isin(*names)
        first = F.when(here, F.lit(keys[0])).otherwise(first)
        if keys[1:]:
            second = F.when(here, F.lit(keys[1])).otherwise(second)
    first = F.when(h.endswith(SHORTENER_SUFFIXES[1]), "url").otherwise(first)
    value = lambda k: F.get(F.filter(parameters(u), lambda x: (x["name"] == k) & (x["value"] != "")), F.lit(0))["value"]
    return F.when(h == "href.li", _destination(query(u))).otherwise(F.coalesce(_destination(value(first)), _destination(value(second))))


def unwrapped(u: Column, rounds: int = 3) -> Column:
    return F.aggregate(F.array(*(F.lit(i) for i in range(rounds))), u, lambda a, _: F.coalesce(embedded(a), a))


def shortened(u: Column) -> Column:
    """Whether the url only leads to another one."""
    h = bare_host(u)
    short = h.isin(*SHORTENERS)
    for suffix in SHORTENER_SUFFIXES:
        short = short | (h == suffix[1:]) | h.endswith(suffix)
    return short | embedded(u).isNotNull()


def shortcode(u: Column) -> Column:
    """Of a photo or video post; null if the url names none."""
    found = F.regexp_extract(path(u), r"(?:^|/)(?:p|reel|reels|tv)/+([A-Za-z0-9_-]+)(?:/|$)", 1)
    return F.when(host(u).isin("instagram.com", "www.instagram.com", "m.instagram.com") & (found != ""), found)


def post_urn(u: Column) -> Column:
    """(urn_type, post_id) of a professional network's post; null if the url names none."""
    a, b = r"(?i)-(activity|share|ugcpost)-([0-9]+)(?:-|$)", r"(?i)^/feed/update/urn:li:(activity|share|ugcpost):([0-9]+)/?$"
    pick = lambda i: F.when(path(u).startswith("/posts/"), F.regexp_extract(path(u), a, i)).otherwise(F.regexp_extract(path(u), b, i))
    return F.when(host(u).isin("linkedin.com", "www.linkedin.com") & (pick(2) != ""), F.struct(F.lower(pick(1)).alias("urn_type"), pick(2).alias("post_id")))


def video_id(u: Column) -> Column:
    """Of one video; null for other pages and for playlists."""
    parts, watch = path_parts(u), F.filter(parameters(u), lambda p: (p["name"] == "v") & (p["value"] != ""))
    found = F.when((host(u) == "youtu.be") & (F.size(parts) == 1), parts[0]).when(
        host(u).isin("youtube.com", "www.youtube.com", "m.youtube.com"),
        F.when(path(u) == "/watch", F.when(F.size(watch) == 1, F.get(watch, F.lit(0))["value"])).when((F.size(parts) == 2) & (F.get(parts, F.lit(0)) == "shorts"), F.get(parts, F.lit(1))),
    )
    return F.when(found.rlike("^[A-Za-z0-9_-]{11}$") & parameter(u, "list").isNull(), found)


def is_short_url(u: Column) -> Column:
    return video_id(u).isNotNull() & (F.get(path_parts(u), F.lit(0)) == "shorts") & (host(u) != "youtu.be")


def article_id(u: Column) -> Column:
    """The twelve hexadecimal digits at the end of a story's address; null where there are none or no feed follows from it."""
    found = F.lower(F.regexp_extract(F.rtrim(path(u), F.lit("/")), "(?i)(?:^|-|/)([0-9a-f]{12})$", 1))
    home = host(u).isin("medium.com", "www.medium.com")
    bad = home & ((F.size(path_parts(u)) < 2) | (F.get(path_parts(u), F.lit(0)) == "p"))
    return F.when((scheme(u) == "https") & (host(u) != "") & ~F.contains(authority(u), F.lit("@")) & (port(u) == "") & (found != "") & ~bad, found)


def feed_url(u: Column) -> Column:
    home = host(u).isin("medium.com", "www.medium.com")
    return F.when(article_id(u).isNotNull(), F.when(home, F.concat(F.lit("https://medium.com/feed/"), F.get(path_parts(u), F.lit(0)))).otherwise(F.concat(F.lit("https://"), host(u), F.lit("/feed"))))


def paper_id(u: Column) -> Column:
    """`provider:id` of a research paper's page or file, else null."""
    # The forms of the providers' urls.
    p, h = path(u), bare_host(u)
    part = lambda pattern, i=1: F.regexp_extract(p, pattern, i)
    named = lambda provider, x, ok: F.when(ok, F.concat(F.lit(f"{provider}:"), x))
    arxiv = F.regexp_replace(part(r"(?i)^/(?:abs|pdf|html)/(.+?)/?$"), r"(?i)\.pdf$", "")
    acl = F.regexp_replace(F.trim(F.when(h == "aclweb.org", F.regexp_replace(p, "^/anthology(?=/)", "")).otherwise(p), F.lit("/")), r"(?i)\.pdf$", "")
    pmlr = r"^/(v[0-9]+)/([^/]+)(?:\.html|/\2\.pdf)/?$"
    nested = F.coalesce(parameter(u, "id"), F.when(parameter(u, "redirect").isNotNull(), parameter(F.concat(F.lit("https://x"), F.regexp_replace(parameter(u, "redirect"), r"^[^?]*", "/")), "id")))
    cvf = r"^/content/([^/]+)/(?:html|papers)/(.+?)\.(?:html|pdf)$"
    file = F.regexp_extract(p, "([^/]*)$", 1)
    jmlr = F.when(part(r"^/papers/v([0-9]+)/([^/]+)\.html$") != "", F.concat(part(r"^/papers/v([0-9]+)/([^/]+)\.html$"), F.lit("-"), part(r"^/papers/v([0-9]+)/([^/]+)\.html$", 2))).otherwise(
        F.concat(part(r"^/papers/volume([0-9]+)/([^/]+)/\2\.pdf$"), F.lit("-"), part(r"^/papers/volume([0-9]+)/([^/]+)/\2\.pdf$", 2)))
    gate = part(r"^/publication/([0-9]+)(?:_|/|$)")
    return F.coalesce(
        F.when(h == "arxiv.org", named("arxiv", arxiv, arxiv.rlike(r"(?i)^(?:[0-9]{4}\.[0-9]{4,5}|[a-z][a-z0-9.-]+(?:\.[A-Z]{2})?/[0-9]{7})(?:v[0-9]+)?$"))),
        F.when(h.isin("aclanthology.org", "aclweb.org"), named("acl", acl, acl.rlike("^[A-Za-z0-9.-]+$"))),
        F.when(h == "proceedings.mlr.press", named("pmlr", F.concat(part(pmlr), F.lit("-"), part(pmlr, 2)), part(pmlr) != "")),
        F.when((h == "openreview.net") & p.isin("/forum", "/pdf", "/challenge"), named("openreview", nested, nested.isNotNull())),
        F.when(h == "openaccess.thecvf.com", named("cvf", F.concat(F.lit("content-"), part(cvf), F.lit("-"), part(cvf, 2)), part(cvf) != "")),
        F.when(h == "proceedings.neurips.cc", named("neurips", F.split_part(file, F.lit("-"), F.lit(1)), p.rlike(r"(?i)\.(html|pdf)$") & file.rlike("-(Abstract|Paper)"))),
        F.when(h == "jmlr.org", named("jmlr", F.concat(F.lit("v"), jmlr), F.length(jmlr) > 1)),
        F.when(h == "researchgate.net", named("researchgate", gate, gate != "")),
    )


def handler(u: Column) -> Column:
    """Which reader takes the url: the first whose identity it has, else `document`."""
    return (
        F.when(shortcode(u).isNotNull(), "instagram").when(post_urn(u).isNotNull(), "linkedin").when(video_id(u).isNotNull(), "youtube")
        .when(paper_id(u).isNotNull(), "research").when(article_id(u).isNotNull(), "medium").otherwise("document")
    )


def identity(u: Column) -> Column:
    return F.coalesce(shortcode(u), post_urn(u)["post_id"], video_id(u), paper_id(u), article_id(u), document_id(u))


def chat_channel(u: Column) -> Column:
    """A chat network's link to a channel or invitation, not to a post."""
    parts = F.transform(path_parts(u), F.lower)
    first = F.get(parts, F.lit(0))
    channel = (F.size(parts) == 0) | F.coalesce(first.startswith("+") | (first == "joinchat"), F.lit(False)) | F.when(first == "s", F.size(parts) <= 2).otherwise(F.size(parts) == 1)
    return bare_host(u).isin(*CHAT_HOSTS) & channel


def bare_hostname(raw: Column, u: Column) -> Column:
    """A domain named in prose: the text had no scheme, and nothing follows the host."""
    return (scheme(F.trim(raw)) == "") & (F.trim(path(u), F.lit("/")) == "") & (query(u) == "")


def exclusion(raw: Column, u: Column) -> Column:
    return F.when(chat_channel(u), "telegram-channel").when(bare_hostname(raw, u), "bare-hostname")


def repository(u: Column) -> Column:
    return bare_host(u).isin(*REPOSITORY_HOSTS) & (F.size(path_parts(u)) >= 2)


def deprioritized(u: Column) -> Column:
    marked = F.lit(False)
    for m in HASHTAG_PATHS:
        marked = marked | F.contains(F.lower(path(u)), F.lit(m))
    return bare_host(u).isin(*IMAGE_HOSTS, *STORE_HOSTS) | marked | (bare_host(u).isin(*SOCIAL_HOSTS) & (F.size(path_parts(u)) <= 1))


def priority(u: Column, sole: Column, by: Column | None = None) -> Column:
    h = handler(u) if by is None else by
    return (
        F.when(h == "research", PRIORITY["research"]).when(deprioritized(u), PRIORITY["deprioritized"]).when(sole, PRIORITY["sole"])
        .when(repository(u), PRIORITY["repository"]).when(h.isin("medium", "document"), PRIORITY["document"]).otherwise(PRIORITY["nested"])
    )


def cache_key(u: Column) -> Column:
    return F.substring(F.sha2(u, 256), 1, 16)


def trimmed(x: Column) -> Column:
    """A bare url without the prose punctuation after it; closing brackets stay where they have an opening one."""
    out = F.regexp_replace(x, "[.,;:!?']+$", "")
    for left, right in (("(", ")"), ("{", "}")):
        count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
        tail = F.length(out) - F.length(F.rtrim(out, F.lit(right)))
        surplus = F.greatest(F.least(tail, count(out, right) - count(out, left)), F.lit(0))
        out = out.substr(F.lit(1), F.length(out) - surplus)
    return out


def failure_reason(message: Column) -> Column:
    """The stable reason of a failed resolution's message."""
    return (
        F.when(message == "redirect loop detected", "redirect-loop").when(message.startswith("shortener chain did not expose"), "destination-not-found")
        .when(message.startswith("exceeded "), "redirect-limit").when(message == "no trustworthy title found", "title-not-found")
        .when(message.startswith("unsupported content type") | message.startswith("could not parse PDF metadata"), "unsupported-content")
        .when(message.startswith("response exceeded"), "response-too-large").when(message.startswith("unsafe URL:"), "unsafe-url")
        .when(message.startswith("HTTP "), "http-error").when(message != "", "request-error").otherwise("unknown-resolution-error")
    )


def failing_status(reason: Column) -> Column:
    return F.when(reason.isin("access-blocked", "auth-wall", "login-required"), "blocked").otherwise("failed")


def _plain_path(p: Column) -> Column:
    """A path without `.` and `..` segments."""
    parts = F.split(p, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).when(x == ".", a).otherwise(F.array_append(a, x)),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def joined(base: Column, reference: Column) -> Column:
    """The address that a reference on a page of `base` leads to; an empty one leads to the page itself."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    own = F.regexp_extract(reference, "^([^?#]*)", 1)
    tail = F.substring(reference, F.length(own) + 1, F.length(reference))
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    asked = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(scheme(reference) != "", reference).when(reference.startswith("//"), F.concat(scheme(base), F.lit(":"), reference))
        .when(own.startswith("/"), F.concat(root, _plain_path(own), tail)).when(own != "", F.concat(root, _plain_path(F.concat(folder, own)), tail))
        .when(tail.startswith("?"), F.concat(root, path(base), tail)).otherwise(F.concat(root, path(base), asked, tail))
    )


#: Blocks of addresses of the fourth version that are not public, and the few public ones inside them.
PRIVATE_BLOCKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
PUBLIC_ADDRESSES = ("192.0.0.9", "192.0.0.10")


def _number(dotted: Column) -> Column:
    parts = F.split(dotted, r"\.", -1)
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + F.try_to_number(x, F.lit("999")).cast("long"))


def unsafe(u: Column) -> Column:
    """Why a url must not be fetched, else null; names are not looked up, and of the sixth version only its public block passes."""
    h, number = F.rtrim(host(u), F.lit(".")), port(u)
    dotted = h.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$")
    inside = F.lit(False)
    for block in PRIVATE_BLOCKS:
        first, bits = block.split("/")
        low = sum(int(x) << 8 * (3 - i) for i, x in enumerate(first.split(".")))
        inside = inside | _number(h).between(low, low + 2 ** (32 - int(bits)) - 1)
    six = h.startswith("[")
    private = (dotted & inside & ~h.isin(*PUBLIC_ADDRESSES)) | (six & ~h.rlike(r"^\[[23][0-9a-f]{3}:")) | six & h.rlike(r"^\[2001:(?:0?db8|[0-9a-f]{1,2}|0[01][0-9a-f]{2}):") | (h == "localhost")
    return (
        F.when(~scheme(u).isin("http", "https"), "only HTTP and HTTPS URLs are supported").when(F.contains(authority(u), F.lit("@")), "credential-bearing URLs are not allowed").when(h == "", "URL has no hostname")
        .when((number != "") & ~F.coalesce(F.try_to_number(number, F.lit("99999")).between(1, 65535), F.lit(False)), "URL port is outside the valid range")
        .when(private, "destination does not resolve exclusively to public addresses")
    )
