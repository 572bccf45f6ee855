"""Keys and labels of a call as column expressions: no function here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BRACKETED = r"^\[([^\]]*)\](?::(.*))?$"
_IPV4 = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"
#: Name suffixes and networks that count as internal.
INTERNAL_SUFFIXES = (".svc.cluster.local", ".internal", ".local")
INTERNAL_IPV4 = r"^(10\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|192\.168\..*|127\..*|169\.254\..*|224\.0\.0\..*|0\.0\.0\.0)$"
INTERNAL_IPV6 = r"^(::|::1|fe[89ab][0-9a-f]:.*|ff02:.*|f[cd][0-9a-f]{2}:.*)$"
#: Default parameters: suffixes of two labels (any other last label is a suffix), suffixes under which every label is one, and names that are none although
#: such a rule covers them. The full public list can be passed instead.
WILDCARD_SUFFIXES, SUFFIX_EXCEPTIONS = ("bd", "ck", "er", "fk", "kh", "mm", "np", "pg"), ("www.ck",)
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, so that no other letter becomes an ASCII one."""
    return F.translate(text, _UPPER, _LOWER)


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def host_slug(host: Column) -> Column:
    """KEY2: lower-cased, each run of anything but a-z and 0-9 one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(ascii_lower(or_empty(host)), "[^a-z0-9]+", "-"), "^-|-$", "")


def integration_key(is_mcp: Column, direction: Column, peer_host: Column, service_name: Column) -> Column:
    """KEY1: an inbound call that is no tool call belongs to the service, any other to its peer host."""
    service, slug = F.trim(or_empty(service_name)), host_slug(peer_host)
    own = F.when((direction == "server") & ~is_mcp & (service != ""), service).when(~((direction == "server") & ~is_mcp) & (slug != ""), slug)
    return F.coalesce(own, F.lit("unknown-integration"))


def host_without_port(host: Column) -> Column:
    """Brackets and port removed; a bare IPv6 address (two colons or more) stays whole."""
    return (F.when(host.rlike(_BRACKETED), F.regexp_extract(host, _BRACKETED, 1))
            .when(F.length(host) - F.length(F.replace(host, F.lit(":"), F.lit(""))) == 1, F.substring_index(host, ":", 1)).otherwise(host))


def strip_default_port(host_port: Column, scheme: Column) -> Column:
    """KEY3: only the scheme's own default port goes."""
    bracketed = host_port.rlike(_BRACKETED)
    port = F.when(bracketed, F.regexp_extract(host_port, _BRACKETED, 2)).when(
        F.length(host_port) - F.length(F.replace(host_port, F.lit(":"), F.lit(""))) == 1, F.substring_index(host_port, ":", -1)).otherwise("")
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(default, host_without_port(host_port)).otherwise(host_port)


def url_scheme(url: Column) -> Column:
    """KEY4."""
    return ascii_lower(F.regexp_extract(or_empty(url), r"^([^:/?#]*)://", 1))


def url_host(url: Column) -> Column:
    """Host and port of an absolute URL, without user information."""
    return F.regexp_replace(F.regexp_extract(or_empty(url), r"^[^:/?#]*://([^/?#]*)", 1), "^.*@", "")


def edge_class(host: Column) -> Column:
    """KEY5: internal or external, from the host alone."""
    h = ascii_lower(host_without_port(or_empty(host)))
    is_v4 = h.rlike(_IPV4)
    is_v6 = h.contains(":")
    named = F.lit(False)
    for suffix in INTERNAL_SUFFIXES:
        named = named | h.endswith(suffix)
    internal = (h == "") | F.when(is_v4, h.rlike(INTERNAL_IPV4)).when(is_v6, h.rlike(INTERNAL_IPV6)).otherwise((h == "localhost") | named | ~h.contains("."))
    return F.when(internal, "internal").otherwise("external")


def registrable_domain(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES, wildcards: tuple[str, ...] = WILDCARD_SUFFIXES, exceptions: tuple[str, ...] = SUFFIX_EXCEPTIONS) -> Column:
    """KEY6: the longest suffix that a rule covers and one label more; an exception is a domain itself. Addresses and bare suffixes stay as they are."""
    h = F.regexp_replace(ascii_lower(host_without_port(or_empty(host))), r"\.$", "")
    labels = F.split(h, r"\.")
    n = F.size(labels)
    ending = lambda i: F.array_join(F.slice(labels, i, n), ".")  # noqa: E731  from label i on, counted from 1
    among = lambda x, names: x.isin(*names) if names else F.lit(False)
    starts = F.sequence(F.lit(1), n)
    excepted = F.get(F.filter(starts, lambda i: among(ending(i), exceptions)), 0)
    covered = F.get(F.filter(starts, lambda i: among(ending(i), suffixes) | ((i < n) & among(ending(i + 1), wildcards)) | (i == n)), 0)
    domain = F.when(excepted.isNotNull(), ending(excepted)).when(covered > 1, ending(covered - 1)).otherwise(h)
    return F.when(h.rlike(_IPV4) | h.contains(":"), h).otherwise(domain)


def role(direction: Column) -> Column:
    """KEY7: the peer's role."""
    return F.when(direction == "server", "consumer").otherwise("provider")


def orientation(direction: Column) -> Column:
    return F.when(direction == "server", "inbound").otherwise("outbound")


def endpoint_label(method: Column, template: Column) -> Column:
    """KEY8."""
    return F.concat_ws(" ", F.upper(or_empty(method)), or_empty(template))


def finding_signature(integration: Column, endpoint: Column, kind: Column, rule: Column, field_path: Column) -> Column:
    """KEY9: a null path counts as empty (concat_ws alone would skip it)."""
    return F.concat_ws("|", *[or_empty(c) for c in (integration, endpoint, kind, rule, field_path)])


def binding_host(raw: Column) -> Column:
    """KEY11: the host a contract is bound to; null if it is no valid ASCII host with an optional port."""
    text = ascii_lower(F.trim(or_empty(raw)))
    scheme = F.regexp_extract(text, r"^([a-z][a-z0-9+.-]*)://", 1)
    rest = F.regexp_replace(F.regexp_extract(F.regexp_replace(text, r"^[a-z][a-z0-9+.-]*://", ""), r"^([^/?#]*)", 1), "^.*@", "")
    bare = strip_default_port(rest, F.when(scheme == "", "https").otherwise(scheme))
    port = F.regexp_extract(bare, r"^[a-z0-9.-]+:([0-9]{1,5})$", 1)
    ok = bare.rlike(r"^([a-z0-9]([a-z0-9.-]*[a-z0-9])?|\[[0-9a-f:]+\])(:[0-9]{1,5})?$") & ((port == "") | F.coalesce(port.try_cast("int"), F.lit(0)).between(1, 65535))
    return F.when(ok, bare)


def tool_name(tool: Column, route: Column) -> Column:
    """KEY12: the attribute, or the route without one leading slash."""
    return F.coalesce(F.nullif(tool, F.lit("")), F.regexp_replace(or_empty(route), "^/", ""))


def change_kind(severity: Column, rule: Column) -> Column:
    """KEY13: of a definition change stored without its kind."""
    return (F.when(rule == "description-changed", "wording").when(rule.startswith("operation-") | rule.startswith("catalog-"), "catalog")
            .when(rule.startswith("output-"), "output").when(rule.startswith("input-"), "input").otherwise(F.when(severity == "breaking", "output").otherwise("input")))


def change_class(kind: Column, severity: Column) -> Column:
    return F.when(kind == "wording", "DESCRIPTION").when(severity == "breaking", "BREAKING").otherwise("NON-BREAKING")


def utf8_cap(text: Column, bytes_: int) -> Column:
    """The longest prefix of at most so many UTF-8 bytes that ends at a whole character (PRJ1)."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, bytes_)
    cut = F.octet_length(F.encode(text, "UTF-8")) > bytes_
    whole = F.regexp_replace(F.hex(raw), r"^((?:[0-9A-F]{2})*?)(?:(?:[CDEF][0-9A-F])(?:[89AB][0-9A-F]){0,2})$", "$1")
    tail = F.regexp_extract(F.hex(raw), r"((?:[CDEF][0-9A-F])(?:[89AB][0-9A-F]){0,2})$", 1)
    need = F.when(tail.rlike("^[CD]"), 4).when(tail.startswith("E"), 6).when(tail.startswith("F"), 8).otherwise(0)
    ended = F.when((tail != "") & (F.length(tail) < need), F.decode(F.unhex(whole), "UTF-8")).otherwise(F.decode(raw, "UTF-8"))
    return F.when(cut, ended).otherwise(text)
