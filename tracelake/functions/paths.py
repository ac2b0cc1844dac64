"""Route templates and urls as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import vocabulary as V

URL = r"(?i)https?://[A-Za-z0-9][A-Za-z0-9.\-]*(?::\d+)?(?:/[^\s\"'<>]*)?"
PATH_LITERAL = r"[\"'](/[A-Za-z0-9][A-Za-z0-9_./\-{}]*)[\"']"
VERSION = r"(?i)^v\d+$"


def normalize_path(path: Column) -> Column:
    """One form for a route template: leading slash, parameters as {}, no doubled or trailing slashes; '' for none.

    Written without branches, so that it names its argument once where it is the work of an expression: the optimiser may put
    it into filters and keys as often as it likes.
    """
    p = F.concat(F.lit("/"), F.regexp_replace(path, r"^\s+|\s+$", ""))
    p = F.regexp_replace(p, r"\{[^}]+\}|:[A-Za-z_][A-Za-z0-9_]*", "{}")
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), "(?<=.)/$", "")
    return F.when(path.isin("", "?"), "").otherwise(F.coalesce(p, F.lit("")))


def significant_segments(norm: Column) -> Column:
    """The segments of a normalised path that name a destination."""
    return F.filter(F.split(norm, "/"), lambda s: (s != "") & (s != "{}") & ~s.rlike(VERSION) & ~F.lower(s).isin(*V.GENERIC_SEGMENTS))


def only_operations(segments: Column) -> Column:
    """True if there are segments and each names an operation."""
    return (F.size(segments) > 0) & F.forall(segments, lambda s: F.lower(s).isin(*V.OPERATION_SEGMENTS))


def match_label(a: Column, b: Column, a_sig: Column, b_sig: Column) -> Column:
    """How well two normalised paths with their significant segments match: high, medium, low or null. Symmetric."""
    na, nb = F.size(a_sig), F.size(b_sig)
    shorter = F.when(na < nb, a_sig).otherwise(b_sig)
    longer = F.when(na < nb, b_sig).otherwise(a_sig)
    k = F.least(na, nb)
    prefix = F.slice(longer, F.lit(1), k) == shorter
    suffix = F.slice(longer, F.greatest(na, nb) - k + 1, k) == shorter
    label = F.when(a == b, "high").when((a_sig == b_sig) | prefix, "medium").when(suffix, "low")
    graded = F.when(label.isNotNull() & only_operations(a_sig) & only_operations(b_sig), "low").otherwise(label)
    return F.when((a == "") | (b == "") | (na == 0) | (nb == 0), None).otherwise(graded)


def matches_filter(candidate: Column, wanted: str | None) -> Column:
    """The looser test of a user's path filter: equal, one under the other, or the same tail."""
    if not wanted:
        return F.lit(True)
    c, f = normalize_path(candidate), normalize_path(F.lit(wanted))
    parts = lambda x: F.filter(F.split(x, "/"), lambda s: s != "")
    cp, fp = parts(c), parts(f)
    n = F.size(fp)
    tail = (F.size(cp) >= 2) & (n >= 1) & (F.size(cp) >= n) & (F.slice(cp, F.greatest(F.size(cp) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))) == fp)
    under = c.startswith(F.concat(f, F.lit("/"))) | f.startswith(F.concat(c, F.lit("/")))
    return (c != "") & (f != "") & ((c == f) | under | tail)


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({URL})"), 1)


def hosts(text: Column) -> Column:
    """Hosts of the urls in a text, lower-cased, without ports and noise hosts, in order."""
    found = F.transform(urls(text), lambda u: F.lower(F.regexp_extract(u, r"://([^/:]+)", 1)))
    return F.filter(found, lambda h: (h != "") & ~h.isin(*V.NOISE_HOSTS))


def paths(text: Column) -> Column:
    """Paths of the urls in a text, without query and fragment, then its quoted path literals, in order."""
    of_urls = F.transform(urls(text), lambda u: F.regexp_extract(u, r"://[^/]*(/[^?#]*)", 1))
    return F.concat(F.filter(of_urls, lambda p: (p != "") & (p != "/")), F.regexp_extract_all(text, F.lit(PATH_LITERAL), 1))


def is_noise_path(path: Column) -> Column:
    p = F.regexp_replace(F.split(path, r"\?")[0], "/+$", "")
    p = F.when(p == "", "/").otherwise(p)
    out = p.isin(*V.NOISE_PATHS)
    for prefix in V.NOISE_PATHS:
        out = out | p.startswith(prefix + "/")
    return out


def name_aliases(name: Column) -> Column:
    """Names that a repository answers to."""
    base = F.lower(name)
    plain = F.array(base, F.replace(base, F.lit("-"), F.lit("_")), F.replace(base, F.lit("-"), F.lit("")))
    return F.array_distinct(F.when(base.endswith("-service"), F.array_append(plain, F.regexp_replace(base, "-service$", ""))).otherwise(plain))


def host_names_repo(host: Column, name: Column) -> Column:
    return F.exists(name_aliases(name), lambda a: F.contains(F.lower(host), a))


def clone_path(coordinate: Column) -> Column:
    """Where a coordinate's sources are looked for: the last part of the group, then the artifact."""
    parts = F.split(coordinate, ":")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.element_at(F.split(parts[0], r"\."), -1), parts[1])).otherwise(coordinate)
