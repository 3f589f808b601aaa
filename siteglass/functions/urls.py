"""URL functions on columns. A URL that cannot be read gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First labels and platforms of hosts that only developers see.
DEV_LABELS = ("staging", "stage", "stg", "dev", "develop", "development", "test", "testing", "qa", "uat", "preview", "sandbox")
DEV_SUFFIXES = (".vercel.app", ".netlify.app", ".pages.dev", ".herokuapp.com", ".onrender.com", ".fly.dev", ".ngrok.io", ".ngrok-free.app")
#: Second labels under which countries register organisations.
SECOND_LEVELS = ("co", "com", "org", "net", "ac", "gov", "edu")
TRACKING = "utm_[A-Za-z0-9_]*"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def search(url: Column) -> Column:
    return F.regexp_extract(url, "^[^?#]*([?][^#]*)", 1)


def site_key(url: Column) -> Column:
    """Lower-case host without a leading www."""
    return F.regexp_replace(host(url), "^www\\.", "")


def is_same_site(a: Column, b: Column) -> Column:
    return F.coalesce((site_key(a) == site_key(b)) & (site_key(a) != ""), F.lit(False))


def document(url: Column) -> Column:
    """The URL without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def is_same_document(a: Column, b: Column) -> Column:
    return F.coalesce(document(a) == document(b), F.lit(False))


def page_key(url: Column) -> Column:
    return F.concat(site_key(url), F.regexp_replace(path(url), "/+$", ""), search(url))


def group_key(url: Column) -> Column:
    """A sitemap's URL without the number before its extension."""
    return F.regexp_replace(url, "[-_]?[0-9]+([.][a-z]+)?$", "$1")


def strip_tracking(url: Column) -> Column:
    """Without utm parameters and fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    first = F.regexp_replace(bare, f"[?]{TRACKING}=[^&]*&", "?")
    return F.regexp_replace(first, f"[?&]{TRACKING}=[^&]*", "")


def has_tracking(url: Column) -> Column:
    return F.coalesce(url.rlike(f"[?&]{TRACKING}="), F.lit(False))


def is_http(url: Column) -> Column:
    return F.coalesce(url.startswith("http:"), F.lit(False))


def is_http_twin(a: Column, b: Column) -> Column:
    """The same document, once by http and once by https."""
    bare = lambda u: F.regexp_replace(document(u), "^https?://", "")
    return F.coalesce((bare(a) == bare(b)) & (is_http(a) != is_http(b)), F.lit(False))


def link_variants(link: Column, page: Column) -> Column:
    """Why a link to the own site isn't in its usual form: http on https, another host, tracking."""
    return F.array_compact(
        F.array(
            F.when(is_http(link) & page.startswith("https:"), F.lit("http")),
            F.when((host(link) != host(page)) & is_same_site(link, page), F.lit("host")),
            F.when(has_tracking(link), F.lit("tracking")),
        )
    )


def is_dev_host(url: Column, page: Column | None = None) -> Column:
    """A host that visitors should not be sent to: local names and bare addresses, an environment's label before a
    site's name, a platform of previews. The host of the page itself is none."""
    h = host(url)
    labels = F.split(h, "[.]")
    found = (h == "localhost") | h.rlike("[.](localhost|local)$") | h.rlike("^[0-9]+([.][0-9]+){3}$") | h.startswith("[")
    found = found | ((F.size(labels) >= 3) & F.get(labels, F.lit(0)).isin(*DEV_LABELS))
    for suffix in DEV_SUFFIXES:
        found = found | h.endswith(suffix)
    return F.coalesce(found if page is None else found & (h != host(page)), F.lit(False))


def organisation(url: Column) -> Column:
    """The last two labels of the host, three under a country's second level."""
    labels = F.split(host(url), "[.]")
    second = F.get(labels, F.size(labels) - 2)
    n = F.when((F.length(F.element_at(labels, -1)) == 2) & second.isin(*SECOND_LEVELS), 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def parse_website(text: Column) -> Column:
    """Origin of what a user typed, https by default; null for addresses, credentials and local names."""
    whole = F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("https://"), text))
    h = host(whole)
    good = whole.rlike("^https?://") & h.contains(".") & ~h.rlike("^[0-9.]+$") & ~whole.rlike("^[^/]*//[^/?#]*@")
    return F.when(good, F.concat(F.regexp_extract(whole, "^([a-z]+)://", 1), F.lit("://"), h))


def file_name(url: Column) -> Column:
    return F.element_at(F.split(path(url), "/"), -1)


def stem(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file_name(url), "[.][A-Za-z0-9]+$", ""), "-[0-9]+x[0-9]+$", "")


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(url), "[.]([A-Za-z0-9]+)$", 1))


#: First path segments under which sites keep redirects to others, and segments and
#: parameters of addresses that do something rather than show a page.
REDIRECT_SECTIONS = ("refer", "go", "goto", "out", "recommends", "visit", "aff", "affiliate")
ACTION_SEGMENTS = ("cart", "basket", "checkout", "login", "logout", "signin", "signout", "wp-login.php")
ACTION_PARAMETERS = ("add-to-cart", "add_to_cart", "redirect_to")
#: Networks that are not public, as (address, prefix length).
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def segments(url: Column) -> Column:
    """The lower-cased segments of the path that hold something."""
    return F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")


def _one_of(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def is_outbound_redirect(url: Column) -> Column:
    """A redirect to someone else's site, by the first segment of its path."""
    return F.coalesce(F.get(segments(url), F.lit(0)).isin(*REDIRECT_SECTIONS), F.lit(False))


def is_action_link(url: Column) -> Column:
    """A cart, a checkout, signing in or out: by a segment of the path or a parameter."""
    names = F.transform(F.split(F.substring(search(url), 2, 1 << 20), "&"), lambda p: F.substring_index(p, "=", 1))
    return F.coalesce(F.arrays_overlap(segments(url), _one_of(ACTION_SEGMENTS)) | F.arrays_overlap(names, _one_of(ACTION_PARAMETERS)), F.lit(False))


def logo_kind(url: Column, logos: Column, base: Column) -> Column:
    """'declared' where the URL is that of a declared logo, 'named' where its file is named as one (of three
    words at most), else null; host and path are compared."""

    def place(u: Column) -> Column:
        full = F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(F.concat(F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0), F.when(u.startswith("/"), F.lit("")).otherwise(F.lit("/")), u))
        return F.concat(host(full), path(full))

    words = F.filter(F.split(F.lower(stem(url)), "[-_.\\s]+"), lambda w: w != "")
    declared = F.exists(logos, lambda x: place(x) == place(url))
    return F.when(F.coalesce(declared, F.lit(False)), "declared").when(F.array_contains(words, "logo") & (F.size(words) <= 3), "named")


def is_public_address(address: Column) -> Column:
    """Whether an IP address is one that a crawler may connect to; false for what is no address."""
    mapped = F.regexp_replace(address, "(?i)^::ffff:(?=[0-9]{1,3}(\\.[0-9]{1,3}){3}$)", "")
    parts = F.transform(F.split(mapped, "\\."), lambda p: F.expr("0").cast("long") + F.coalesce(F.try_to_number(p, F.lit("999")).cast("long"), F.lit(999)))
    is_v4 = mapped.rlike("^[0-9]{1,3}(\\.[0-9]{1,3}){3}$") & ~F.exists(parts, lambda p: p > 255)
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)

    def within(network: str, length: int) -> Column:
        start = sum(int(x) << (24 - 8 * k) for k, x in enumerate(network.split(".")))
        return number.between(start, start + (1 << (32 - length)) - 1)

    private = F.lit(False)
    for network, length in PRIVATE_V4:
        private = private | within(network, length)
    low = F.lower(mapped)
    is_v6 = low.rlike("^[0-9a-f:]+$") & low.rlike(":.*:") & ~low.rlike(":::|::.*::|[0-9a-f]{5}")
    whole = low.rlike("^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$") | F.contains(low, F.lit("::"))
    local = low.rlike("^(0*:)*:?0*[01]?$") | low.rlike("^f[cd][0-9a-f]{2}:") | low.rlike("^fe[89ab][0-9a-f]:")
    return F.coalesce(F.when(is_v4, ~private).when(is_v6 & whole, ~local).otherwise(False), F.lit(False))


def is_own_page(url: Column) -> Column:
    """A page that the site vouches for: no redirect to another site, no print version of a page."""
    printed = F.exists(segments(url), lambda s: s.rlike("(^|[-_])print($|[-_])"))
    return ~(is_outbound_redirect(url) | F.coalesce(printed, F.lit(False)))
