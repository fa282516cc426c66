"""URL expressions: canonical form, registered domain, source class, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values
TRACKING_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source"]
OFFICIAL = ["apple.com", "esa.int", "europa.eu", "nasa.gov", "noaa.gov", "openai.com", "un.org"]
OFFICIAL_SUFFIXES = ["ac.uk", "edu.au", "edu.cn", "gov.au", "gov.cn", "gov.uk"]
NEWS = ["apnews.com", "bbc.com", "bbc.co.uk", "reuters.com"]
USER_GENERATED = ["facebook.com", "instagram.com", "medium.com", "reddit.com", "tiktok.com", "weibo.com", "x.com", "youtube.com"]
MULTIPART_SUFFIXES = [
    "ac.uk", "co.jp", "co.uk", "com.au", "com.br", "com.cn", "com.hk", "com.sg", "edu.au", "edu.cn", "gov.au", "gov.cn",
    "gov.uk", "net.au", "org.au", "org.cn", "org.uk",
]
SENSITIVE_KEYS = ["key", "apikey", "token", "accesstoken", "credential", "googleaccessid", "ossaccesskeyid", "signature", "sig", "securitytoken"]
REDACTED = "[REDACTED]"
# addresses that are their own canonical form: plain lower-case host, path, neither query nor fragment
CANONICAL = r"\Ahttps?://[a-z0-9-]+(?:\.[a-z0-9-]+)*+(?:/|/[^?#]*[^?#/ ])\z"


def _part(url: Column, group: int) -> Column:
    """Of scheme, authority, path, query (without its mark): RFC 3986's split."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", group)


def with_scheme(url: Column) -> Column:
    text = F.trim(F.coalesce(url, F.lit("")))
    return F.when(text == "", "").when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots; empty where there is none."""
    place = F.regexp_replace(_part(with_scheme(url), 2), "^.*@", "")
    return F.regexp_replace(F.regexp_replace(F.lower(place), ":[0-9]*$", ""), r"\.+$", "")


def canonical(url: Column) -> Column:
    """http(s), lower-case host, no default port, no trailing slash, no tracking keys, sorted query, no fragment.

    Most addresses are so already; one pattern tells that, and only the others are taken apart.
    """
    text = with_scheme(url)
    scheme = F.when(F.lower(_part(text, 1)).isin("http", "https"), F.lower(_part(text, 1))).otherwise("https")
    port = F.regexp_extract(_part(text, 2), ":([0-9]+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    place = F.concat(host(url), F.when(default, "").otherwise(F.concat(F.lit(":"), port)))
    path = _part(text, 3)
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.filter(F.split(_part(text, 4), "&"), lambda p: p != "")
    key = lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1))
    pairs = F.filter(pairs, lambda p: ~key(p).startswith("utm_") & ~key(p).isin(TRACKING_KEYS))
    query = F.array_join(F.array_sort(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))), "&")
    whole = F.concat(scheme, F.lit("://"), place, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(CANONICAL), url).when(host(url) == "", "").otherwise(whole)


def registered_domain(name: Column) -> Column:
    """The last two labels of a host, three under a multipart suffix; addresses as they are."""
    labels = F.filter(F.split(F.coalesce(name, F.lit("")), r"\."), lambda x: x != "")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    deep = F.when(last(2).isin(MULTIPART_SUFFIXES), last(3)).otherwise(last(2))
    address = name.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") | F.contains(name, F.lit(":"))
    return F.when(address | (F.size(labels) <= 2), name).otherwise(deep)


def under(name: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    return reduce(lambda a, b: a | b, ((name == d) | name.endswith("." + d) for d in domains))


def source_class(name: Column) -> Column:
    official = under(name, OFFICIAL) | under(name, OFFICIAL_SUFFIXES) | name.rlike(r"\.(gov|edu|int)$")
    return F.when(under(name, USER_GENERATED), "ugc").when(official, "official").when(under(name, NEWS), "news").otherwise("unknown")


def risk_flags(name: Column) -> Column:
    """Sorted flags: user-generated hosts, and hosts that only look official."""
    lookalike = reduce(lambda a, b: a | b, (F.contains(name, F.lit(d)) for d in OFFICIAL)) & ~under(name, OFFICIAL)
    return F.array_compact(F.array(F.when(lookalike, "lookalike_official_domain"), F.when(under(name, USER_GENERATED), "user_generated_content")))


def source_family(name: Column, content: Column) -> Column:
    domain = F.coalesce(F.nullif(registered_domain(name), F.lit("")), F.nullif(name, F.lit("")), F.lit("unknown"))
    known = F.coalesce(content, F.lit("")) != ""
    return F.when(known, F.concat(F.lit("content:"), F.sha2(content.cast("binary"), 256))).otherwise(F.concat(F.lit("domain:"), domain))


def redact(url: Column) -> Column:
    """Values of credential-like query keys replaced; an http(s) URL without any is unchanged."""
    name = lambda p: F.regexp_replace(F.lower(F.regexp_extract(p, "^([^=]*)", 1)), "[^a-z0-9]", "")
    sensitive = lambda p: name(p).isin(SENSITIVE_KEYS) | name(p).startswith("xamz") | name(p).startswith("xoss") | name(p).startswith("xgoog")
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    hidden = F.transform(pairs, lambda p: F.when(sensitive(p), F.concat(F.regexp_extract(p, "^([^=]*)", 1), F.lit("=%5BREDACTED%5D"))).otherwise(p))
    whole = F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?"), F.array_join(hidden, "&"), F.regexp_extract(url, "(#.*)$", 1))
    return F.when(F.lower(url).rlike("^https?://[^/?#]") & F.exists(pairs, sensitive), whole).otherwise(url)


def archived(url: Column) -> Column:
    """The page that a web-archive address holds; other addresses as they are."""
    inner = F.regexp_extract(url, r"^https?://web\.archive\.org/web/[0-9]+[a-z_]*/(.+)$", 1)
    return F.when(inner == "", url).otherwise(inner)


def named_domain(text: Column, domains: list[str]) -> Column:
    """The longest of ``domains`` that a text names, itself or by a subdomain, in lower case with percent signs decoded; empty for none.

    A name ends where no letter, digit, dot or hyphen goes on. Where a text's percent signs are no encoding it is taken as it is.
    """
    raw = F.coalesce(text, F.lit(""))
    flat = F.lower(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))
    out = F.lit("")
    for name in sorted(domains, key=lambda d: (len(d), d)):
        escaped = name.replace(".", r"\.")
        out = F.when(flat.rlike(rf"(?<![a-z0-9.-])(?:[a-z0-9-]+\.)*{escaped}(?![a-z0-9.-])"), name).otherwise(out)
    return out
