"""Field names, confidences and postures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import vocabulary as V


def lookup(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    """table[value], a literal map; default where there is none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), F.lit(default))


def by_member(value: Column, classes: dict[str, tuple[str, ...]], default: str | None = None) -> Column:
    out = F.lit(default)
    for name, members in classes.items():
        out = F.when(value.isin(*members), name).otherwise(out)
    return out


def field_key(name: Column) -> Column:
    """A field's canonical key: snake case, lower case, aliases resolved; `unknown` for none."""
    key = F.replace(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")), F.lit("-"), F.lit("_"))
    return F.when(name.isNull() | (name == ""), "unknown").otherwise(F.coalesce(lookup(key, V.FIELD_ALIASES), key))


def pii_class(name: Column) -> Column:
    return by_member(F.lower(name), V.PII_CLASSES, "unknown")


def data_class(name: Column) -> Column:
    return by_member(F.lower(name), V.DATA_CLASSES)


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).when(confidence == "low", 1).otherwise(0)


def is_internal(coordinate: Column, patterns: list[str]) -> Column:
    """True for a coordinate (group:artifact or a name) that a pattern of the organisation's matches and no external prefix does."""
    external = F.lit(False)
    for prefix in V.EXTERNAL_PREFIXES:
        external = external | coordinate.startswith(prefix)
    own = F.lit(False)
    for p in patterns:
        own = own | coordinate.rlike(p)
    return ~external & own


def store_key(vendor: Column, url: Column, bucket: Column) -> Column:
    """The canonical key of a data store, or null."""
    u = F.coalesce(url, F.lit(""))
    jdbc = r"(?i)jdbc:([a-z0-9]+)://([^/\s\"';?]+)(?:/([A-Za-z0-9_\-]+))?"

    def host(prefix: str, scheme: str) -> Column:
        rx = rf"(?i){scheme}://([^/\s\"';?]+)"
        return F.concat(F.lit(prefix), F.when(u.rlike(rx), F.lower(F.regexp_extract(u, rx, 1))).otherwise(F.substring(u, 1, 80)))

    of_jdbc = F.when(u.rlike(jdbc), F.concat(F.lit("jdbc:"), F.lower(F.regexp_extract(u, jdbc, 1)), F.lit("://"), F.lower(F.regexp_extract(u, jdbc, 2)), F.lit("/"), F.regexp_extract(u, jdbc, 3))).otherwise(F.concat(F.lit("jdbc:unknown:"), F.substring(u, 1, 80)))
    return F.when(vendor == "jdbc", of_jdbc).when(vendor == "mongodb", host("mongodb://", r"mongodb(?:\+srv)?")).when(vendor == "redis", host("redis://", "rediss?")).when((vendor == "s3") & (F.coalesce(bucket, F.lit("")) != ""), F.concat(F.lit("s3://"), bucket))


def tokens(identifier: Column) -> Column:
    """Lower-case words of an identifier in camel or snake case."""
    return F.transform(F.regexp_extract_all(identifier, F.lit("([A-Z]+(?![a-z])|[A-Z][a-z]*|[a-z]+|[0-9]+)"), 1), lambda t: F.lower(t))


def _trailing(receiver: Column) -> Column:
    return F.trim(F.element_at(F.split(receiver, r"\."), -1))


def is_database_receiver(receiver: Column) -> Column:
    """A receiver whose last identifier, a word of it or two neighbouring words are a database handle's name."""
    names = F.array(*[F.lit(n) for n in V.DATABASE_RECEIVERS])
    last = _trailing(receiver)
    t = tokens(last)
    pairs = F.zip_with(t, F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    found = F.lower(last).isin(*V.DATABASE_RECEIVERS) | F.arrays_overlap(t, names) | F.coalesce(F.arrays_overlap(F.filter(pairs, lambda p: p.isNotNull()), names), F.lit(False))
    return F.coalesce(found, F.lit(False))


def is_other_receiver(receiver: Column) -> Column:
    return F.coalesce(F.lower(F.element_at(F.split(receiver, r"\."), -1)).isin(*V.OTHER_RECEIVERS), F.lit(False))


def sql_execution(symbol: Column, hint: Column, receiver: Column, receiver_is_database: Column, file_evidence: Column) -> Column:
    """Null if a call is no SQL, else whether it executes (true) or goes through an object mapper (false)."""
    hint, db, file_evidence = (F.coalesce(c, F.lit(False)) for c in (hint, receiver_is_database, file_evidence))
    named = symbol.isin(*V.SQL_EXECUTION_NAMES, *V.SQL_ORM_NAMES) | hint
    evidence = hint | db | (~is_other_receiver(receiver) & file_evidence)
    return F.when(named & evidence, symbol.isin(*V.SQL_EXECUTION_NAMES) | hint)


def auth_maturity(patterns: Column, http_in: Column) -> Column:
    has = lambda p: F.array_contains(patterns, p)
    return F.when(has("secured-authenticated") | has("spring-pre-authorize"), "authenticated-default").when(has("permit-all-config") | has("is-anonymous"), "anonymous-or-permit-all").when((http_in > 0) & (F.size(patterns) == 0), "http-without-auth-annotations").otherwise("unknown")


def crypto_maturity(algorithms: Column, key_sources: Column) -> Column:
    return F.when((algorithms > 0) & (key_sources > 0), "config-driven").when(algorithms > 0, "hardcoded-algorithms").when(key_sources > 0, "config-keys-only").otherwise("none-detected")


def receiver_field(receiver: Column, self_name: Column) -> Column:
    """The field that a receiver names on its own object, or null: this., self. and Go's own name are taken off."""
    own = F.when(self_name.isNotNull() & (self_name != ""), F.concat(self_name, F.lit(".")))
    r = F.regexp_replace(receiver, r"^(this|self)\.", "")
    r = F.when(own.isNotNull() & r.startswith(own), F.substr(r, F.length(own) + 1)).otherwise(r)
    return F.when((r != "") & ~F.contains(r, F.lit(".")), r)


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)


def carried(text: Column, tainted: Column) -> Column:
    """The smallest tainted name that an expression mentions as a whole word, or null."""
    return F.array_min(F.array_intersect(identifiers(text), tainted))
