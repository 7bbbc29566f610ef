"""Column functions on addresses: verdicts, canonical and fetch forms, video ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import col

#: Names of tracking parameters; names with the prefix are, too.
TRACKING_PREFIX = "utm_"
TRACKING = (
    "dclid epik fbclid gbraid gclid igshid li_fat_id mc_cid mc_eid mkt_tok msclkid oly_anon_id oly_enc_id s_kwcid ttclid twclid vero_conv vero_id wbraid yclid _ga _gl _hsenc _hsmi"
).split()

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
_AUTHORITY = r"^(?:([\s\S]*)@)?(\[[^\]]*\]|[^:@]*)(?::(\d*))?$"


def with_scheme(url: str | Column) -> Column:
    """The trimmed address; one that starts with ``www.`` gets a scheme."""
    t = F.trim(F.regexp_replace(col(url), "(?U)^\\s+|\\s+$", ""))
    return F.when(~F.contains(t, F.lit("://")) & F.lower(t).startswith("www."), F.concat(F.lit("https://"), t)).otherwise(t)


class Parts:
    """The parts of an address as columns."""

    def __init__(self, url: str | Column):
        url = col(url)
        part = lambda i: F.regexp_extract(url, _PARTS, i)
        self.scheme, self.authority, self.path, self.query, self.fragment = F.lower(part(1)), part(2), part(3), part(4), part(5)
        inside = lambda i: F.regexp_extract(self.authority, _AUTHORITY, i)
        self.login, self.host, self.port = inside(1), F.lower(inside(2)), inside(3)


def verdict(url: str | Column) -> Column:
    """Null for a valid address, otherwise the reason it is none: empty, scheme, host or short_host."""
    t = with_scheme(url)
    p = Parts(t)
    return (
        F.when(t.isNull() | (t == ""), "empty").when(~p.scheme.isin("http", "https"), "scheme").when(p.host == "", "host")
        .when(~F.contains(p.host, F.lit(".")) & (p.host != "localhost"), "short_host")
    )


def is_tracking(name: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a parameter only tracks, in any case."""
    low = F.lower(F.trim(name))
    return low.startswith(TRACKING_PREFIX) | low.isin(*TRACKING, *[e.strip().lower() for e in extra])


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _form(query: Column, ordered: bool, extra: tuple[str, ...]) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.struct(_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("name"), _decode(F.regexp_extract(p, "^[^=]*=([\\s\\S]*)$", 1)).alias("value")))
    kept = F.filter(pairs, lambda p: ~is_tracking(p["name"], extra))
    encode = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    kept = F.array_sort(kept) if ordered else kept
    return F.array_join(F.transform(kept, lambda p: F.concat(encode(p["name"]), F.lit("="), encode(p["value"]))), "&")


def _quoted(path: Column) -> Column:
    """A path with what is not allowed in it percent-encoded; whole runs, as UTF-8."""
    rest = F.regexp_extract_all(path, F.lit(r"[A-Za-z0-9_.\-/%:@!$&'()*+,;=~]+|[^A-Za-z0-9_.\-/%:@!$&'()*+,;=~]+"), F.lit(0))
    encoded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.array_join(F.transform(rest, lambda c: F.when(c.rlike(r"^[A-Za-z0-9_.\-/%:@!$&'()*+,;=~]"), c).otherwise(encoded(c))), "")


def _built(url: str | Column, ordered: bool, login: bool, extra: tuple[str, ...]) -> Column:
    p = Parts(with_scheme(url))
    standard = ((p.scheme == "http") & (p.port == "80")) | ((p.scheme == "https") & (p.port == "443"))
    port = F.when((p.port == "") | standard, "").otherwise(F.concat(F.lit(":"), F.regexp_replace(p.port, "^0+(?=\\d)", "")))
    name = F.when(F.lit(login) & (p.login != ""), F.concat(p.login, F.lit("@"))).otherwise("")
    path = F.when(p.path == "", "/").otherwise(_quoted(p.path))
    query = _form(p.query, ordered, extra)
    fragment = F.when(p.fragment.rlike("^[!/]"), F.concat(F.lit("#"), p.fragment)).otherwise("")
    whole = F.concat(p.scheme, F.lit("://"), name, p.host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), fragment)
    return F.when(verdict(url).isNull(), whole)


def canonical(url: str | Column, extra: tuple[str, ...] = ()) -> Column:
    """The address as a source's identity: no login, default port, tracking or fragment, parameters sorted; null if invalid."""
    return _built(url, True, False, extra)


def fetch_form(url: str | Column, extra: tuple[str, ...] = ()) -> Column:
    """The address to fetch: as the canonical one, with login and the given order of parameters."""
    return _built(url, False, True, extra)


def without_login(url: str | Column) -> Column:
    return F.regexp_replace(col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1")


#: Hosts of the video service.
VIDEO_HOSTS = "youtube.com www.youtube.com m.youtube.com music.youtube.com youtube-nocookie.com www.youtube-nocookie.com".split()
SHORT_HOSTS = "youtu.be www.youtu.be".split()


def video(url: str | Column) -> Column:
    """Struct ``kind`` (video, playlist, channel, unknown; null for other hosts) and ``id``."""
    p = Parts(F.trim(col(url)))
    steps = F.filter(F.split(p.path, "/"), lambda s: s != "")
    first, second = F.coalesce(F.get(steps, F.lit(0)), F.lit("")), F.coalesce(F.get(steps, F.lit(1)), F.lit(""))
    kind = F.lower(first)
    named = F.coalesce(F.get(F.transform(F.filter(F.split(p.query, "&"), lambda q: q.startswith("v=") & (F.length(q) > 2)), lambda q: _decode(F.substring(q, 3, 10_000))), F.lit(0)), F.lit(""))
    listed = F.exists(F.split(p.query, "&"), lambda q: q.startswith("list=") & (F.length(q) > 5))
    short, long = p.host.isin(SHORT_HOSTS), p.host.isin(VIDEO_HOSTS)
    channel = long & (first.startswith("@") | kind.isin("channel", "c", "user"))
    candidate = F.trim(F.when(short, first).when(kind == "watch", named).when((F.size(steps) >= 2) & kind.isin("shorts", "live", "embed", "v"), second).otherwise(""))
    is_id = candidate.rlike("^[A-Za-z0-9_-]{11}$")
    playlist = long & ((kind == "playlist") | ((F.size(steps) == 0) & listed))
    what = F.when(~(short | long), F.lit(None)).when(channel, "channel").when(playlist, "playlist").when(is_id, "video").otherwise("unknown")
    return F.struct(what.alias("kind"), F.when(what == "video", candidate).alias("id"))


def video_canonical(ident: str | Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), col(ident))
