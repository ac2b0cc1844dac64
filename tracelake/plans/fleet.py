"""A fleet projected from the sales tables, for queries and their SQL: the same expressions make it in either engine.

Each line item is a node of some family, each supplier a repository. Expressions use only what both SQL dialects share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FAMILIES = (
    "http-in", "http-out", "sql", "pii-field", "pii-log", "pii-storage", "queue-pub", "queue-sub",
    "crypto-algorithm", "data-store", "call-site", "sql-field-marker", "auth", "entry-marker", "api-client-consumer", "config-security",
)


def _case(expression: str, *values: str | None) -> str:
    """One of the values by a remainder."""
    return f"case cast({expression} as bigint) % {len(values)} " + " ".join(f"when {k} then {v}" for k, v in enumerate(values) if v is not None) + " end"


def _q(*words: str) -> list[str]:
    return [f"'{w}'" for w in words]


FAMILY = _case("l_partkey + l_linenumber", *_q(*FAMILIES))
FIELDS = ("email", "phoneNumber", "firstName", "iban", "userAgent", "mobile", "accountNumber", "customField")
_ITEM = "cast(l_partkey % 97 as string)"

#: Columns of nodes, by what makes them from lineitem (f: the family).
NODE = {
    "ord": "((l_orderkey * 8 + l_linenumber) * 4000 + l_suppkey % 4000) * 20000 + l_partkey % 20000",
    "repo": "concat('g', cast(l_suppkey % 25 as string), '/svc-', cast(l_suppkey as string))",
    "grp": "concat('g', cast(l_suppkey % 25 as string))",
    "name": "concat('svc-', cast(l_suppkey as string))",
    "file": "concat('src/F', cast(l_partkey % 40 as string), '.java')",
    "line": "cast(l_orderkey % 400 as int) + l_linenumber",
    "language": _case("l_suppkey", *_q("java", "kotlin", "python", "javascript", "go")),
    "family": "f",
    "kind": "case when f in ('http-in', 'pii-field', 'queue-sub') then 'source' when f = 'data-store' then 'store' when f in ('call-site', 'sql-field-marker', 'entry-marker') then 'reference' when f in ('auth', 'api-client-consumer', 'config-security') then 'propagator' when f = 'sql' and l_partkey % 3 = 0 then 'source' else 'sink' end",
    "confidence": "case l_returnflag when 'A' then 'high' when 'N' then 'medium' else 'low' end",
    "path": "case f when 'http-in' then "
    + _case("l_orderkey", f"concat('/v1/item', {_ITEM})", f"concat('/item', {_ITEM}, '/{{{{id}}}}/')", f"concat('api/item', {_ITEM}, '//lines', cast(l_linenumber as string))", "'/v2/search'", "'/{{id}}'", "'?'")
    + " when 'http-out' then "
    + _case("l_orderkey", f"concat('/v1/item', {_ITEM})", f"concat('/item', {_ITEM}, '/:id')", f"concat('/item', {_ITEM}, '/lines', cast(l_linenumber as string), '/extra')", "'/search'", f"concat('/internal/item', {_ITEM}, '/')", "'/v1'", None)
    + " when 'api-client-consumer' then "
    + _case("l_orderkey", f"concat('/item', {_ITEM})", None)
    + " end",
    "method": "case when f = 'http-in' then " + _case("l_linenumber", *_q("GET", "POST")) + " end",
    "host": "case when f = 'http-out' then " + _case("l_orderkey + l_partkey", "concat('svc-', cast((l_partkey * 7 + l_orderkey) % 150 as string), '.prod.local')", "'localhost'", "concat('x-svc-', cast(l_partkey % 30 as string), '-eu.prod.local')", None, "'unknown.host'") + " end",
    "target_repo": "case when f = 'api-client-consumer' or (f = 'http-out' and l_orderkey % 13 = 0) then concat('g', cast((l_partkey % 10) % 25 as string), '/svc-', cast(l_partkey % 10 as string)) end",
    "client": "case when f = 'api-client-consumer' then concat('lib-', cast(l_partkey % 10 as string)) end",
    "topic": "case when f in ('queue-pub', 'queue-sub') then case when l_orderkey % 11 = 0 then '?' when f = 'queue-pub' then concat('topic-', cast(l_partkey % 50 as string)) else concat('topic-', cast(l_partkey % 53 as string)) end end",
    "system": "case when f in ('queue-pub', 'queue-sub') then " + _case("l_partkey", *_q("kafka", "rabbitmq", "sqs")) + " end",
    "field_name": "case when f in ('pii-field', 'pii-log') or (f = 'pii-storage' and l_orderkey % 5 <> 0) then " + _case("l_partkey", *_q(*FIELDS)) + " end",
    "pii_classification": "case when f in ('pii-field', 'pii-log', 'pii-storage') then " + _case("l_partkey", *_q("direct-pii", "direct-pii", "direct-pii", "sensitive", "quasi-id", "direct-pii", "sensitive"), None) + " end",
    "algorithm": "case when f = 'crypto-algorithm' then " + _case("l_partkey", *_q("MD5", "SHA-256", "AES", "sha1", "DES", "SHA-1", "RSA")) + " end",
    "pattern": "case when f = 'auth' then " + _case("l_partkey", *_q("spring-pre-authorize", "permit-all-config", "secured-role", "permit-all", "csrf-disabled")) + " end",
    "vendor": "case when f = 'data-store' then " + _case("l_partkey", *_q("jdbc", "mongodb", "redis", "s3")) + " end",
    "url": "case when f = 'data-store' then " + _case("l_partkey", "concat('jdbc:PostgreSQL://DB', cast(l_partkey % 60 as string), ':5432/app_', cast(l_partkey % 3 as string))", "concat('mongodb+srv://Mongo', cast(l_partkey % 60 as string), '/x')", "concat('redis:', cast(l_partkey % 60 as string))") + " end",
    "bucket": "case when f = 'data-store' and l_partkey % 4 = 3 then concat('bucket-', cast(l_partkey % 60 as string)) end",
    "symbol": "case when f in ('call-site', 'sql') then " + _case("l_partkey + l_orderkey", *_q("execute", "query", "find", "save", "m1", "m2", "m3", "executeUpdate", "m4")) + " end",
    "receiver": "case when f in ('call-site', 'sql') then " + _case("l_orderkey", "'this.userDao'", "'httpClient'", "'f1'", "'runner'", "'readOnlyJdbcTemplate'", "'a.b.c'", None, "'restTemplate'", "'f2'") + " end",
    "library_hint": "case when f = 'call-site' and l_partkey % 7 = 0 then true when f = 'call-site' and l_partkey % 7 < 4 then false end",
    "file_sql_evidence": "case when f = 'call-site' then l_partkey % 2 = 0 end",
    "parameterised": "case when f = 'sql' then " + _case("l_orderkey", *_q("parameterised", "mixed", "raw", "static"), None) + " end",
    "execution": "case when f = 'sql' then " + _case("l_partkey", "true", "false", None) + " end",
    "mechanism": "case when f = 'entry-marker' then " + _case("l_partkey", *_q("grpc", "graphql", "schedule", "cli", "file-watch")) + " end",
    "raw": "concat(f, ' ', case when l_orderkey % 29 = 0 then 'deleteAll(x)' when l_orderkey % 31 = 0 then 'undeleted' when l_orderkey % 7 = 0 then concat('GET(\"https://svc-', cast(l_partkey % 10 as string), '.prod.local/item', cast(l_partkey % 97 as string), '?q=1\")') else 'call()' end)",
    "enclosing_class": "case when f in ('call-site', 'sql', 'entry-marker', 'http-in') and l_orderkey % 10 <> 0 then concat('C', cast(l_partkey % 6 as string)) end",
    "enclosing_method": "case when f in ('call-site', 'sql', 'entry-marker', 'http-in') and l_orderkey % 10 <> 0 then concat('m', cast(l_orderkey % 5 as string)) end",
}

REPO = {
    "repo": "concat('g', cast(s_suppkey % 25 as string), '/svc-', cast(s_suppkey as string))",
    "grp": "concat('g', cast(s_suppkey % 25 as string))",
    "name": "case when s_suppkey % 9 = 0 then concat('svc-', cast(s_suppkey as string), '-service') else concat('svc-', cast(s_suppkey as string)) end",
    "ord": "s_suppkey",
    "primary_language": _case("s_suppkey", *_q("java", "kotlin", "python", "javascript", "go")),
    "git_sha": "concat('sha', cast(s_nationkey as string))",
    "detection_version": "cast(18 + s_suppkey % 2 as int)",
    "derivation_version": "cast(5 + s_nationkey % 2 as int)",
}
DEPENDENCY = {
    "repo": NODE["repo"],
    "group_id": "concat('com.acme.t', cast(l_partkey % 4 as string))",
    "artifact_id": "concat('lib-', cast(l_partkey % 30 as string), case when l_partkey % 3 = 0 then '-client' when l_partkey % 3 = 1 then '-sdk' else '' end)",
    "version": "concat('1.', cast(l_linenumber as string))",
    "version_kind": _case("l_orderkey", *_q("resolved", "range", "unresolved")),
    "ord": NODE["ord"],
}
BINDING = {
    "target_repo": "concat('g', cast(s_suppkey % 25 as string), '/svc-', cast(s_suppkey as string))",
    "maven_artifact": "case when s_suppkey % 4 = 0 then '' else concat('lib-', cast(s_suppkey as string), case when s_suppkey % 3 = 0 then '-client' when s_suppkey % 3 = 1 then '-sdk' else '' end) end",
    "path": "concat('/item', cast(s_suppkey as string))",
    "alias": "concat('svc-', cast(s_suppkey as string), '-eu')",
}
SPEC = {
    "target_repo": "concat('g', cast(s_suppkey % 25 as string), '/svc-', cast(s_suppkey as string))",
    "spec_path": "'openapi.yaml'",
    "path": "concat('/item', cast((s_suppkey * 5) % 97 as string))",
}
_FROM = {
    "node": (NODE, f"(select *, {FAMILY} as f from {{lineitem}})", ""),
    "repo": (REPO, "{supplier}", ""),
    "dependency": (DEPENDENCY, "{lineitem}", ""),
    "binding": (BINDING, "{supplier}", ""),
    "spec": (SPEC, "{supplier}", ""),
}
_NEEDS = {"node": "lineitem", "repo": "supplier", "dependency": "lineitem", "binding": "supplier", "spec": "supplier"}


def statement(name: str, only: tuple[str, ...] = ()) -> str:
    columns, source, where = _FROM[name]
    return "select " + ", ".join(f"{x} as {c}" for c, x in columns.items() if not only or c in only) + f" from {source}{where}"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = _NEEDS[name]
    return spark.sql(statement(name), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def sql(query: str, *names: str) -> str:
    """A query over projected tables for an engine that has the sales tables as views."""
    ctes = ", ".join(f"{n} as ({statement(n).format(lineitem='lineitem', supplier='supplier')})" for n in names)
    return f"with {ctes}{', ' if query.lstrip().startswith('+') else ' '}{query.lstrip().lstrip('+')}"
