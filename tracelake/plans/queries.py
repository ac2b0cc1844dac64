"""Queries over the projected fleet, each beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import fields, paths, text
from tracelake.functions import vocabulary as V
from tracelake.operators import calls, derive, fleet, inventory, privacy, resolve, routes
from tracelake.operators.inventory import COUNTED
from tracelake.plans.fleet import frame, sql
from tracelake.schema import STAGES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, tables: tuple[str, ...] = ("node",)):
    """Registers a query; its function gets the projected tables it names, its SQL finds them as common table expressions."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[frame(spark, sf_dir, t) for t in tables])

        QUERIES[name] = run
        if oracle:
            SQL[name] = sql(oracle, *tables) if tables else oracle
        return f

    return add


def raw_query(name: str, oracle: str | None = None):
    """Registers a query over the tables as they are."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if oracle:
            SQL[name] = oracle
        return f

    return add


# Pieces of SQL for DuckDB.


def s_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def s_norm(p: str) -> str:
    t = f"trim({p})"
    t = f"case when starts_with({t}, '/') then {t} else concat('/', {t}) end"
    t = rf"regexp_replace(regexp_replace({t}, '\{{[^}}]+\}}', '{{}}', 'g'), ':([A-Za-z_][A-Za-z0-9_]*)', '{{}}', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '/+', '/', 'g'), '/+$', '')"
    return f"case when {p} is null or {p} in ('', '?') then '' else case when {t} = '' then '/' else {t} end end"


def s_sig(n: str) -> str:
    return f"list_filter(string_split({n}, '/'), lambda s: s <> '' and s <> '{{}}' and not regexp_full_match(s, '(?i)v[0-9]+') and lower(s) not in {s_list(V.GENERIC_SEGMENTS)})"


def s_ops(sig: str) -> str:
    return f"(len({sig}) > 0 and len(list_filter({sig}, lambda s: lower(s) not in {s_list(V.OPERATION_SEGMENTS)})) = 0)"


def s_label(a: str, b: str, sa: str, sb: str) -> str:
    short, long = f"(case when len({sa}) < len({sb}) then {sa} else {sb} end)", f"(case when len({sa}) < len({sb}) then {sb} else {sa} end)"
    graded = f"case when {a} = {b} then 'high' when {sa} = {sb} or {long}[1:len({short})] = {short} then 'medium' when {long}[len({long}) - len({short}) + 1:] = {short} then 'low' end"
    return f"case when {a} = '' or {b} = '' or len({sa}) = 0 or len({sb}) = 0 then null when ({graded}) is not null and {s_ops(sa)} and {s_ops(sb)} then 'low' else {graded} end"


def s_case(value: str, classes: dict[str, tuple[str, ...]], default: str) -> str:
    return "case " + " ".join(f"when {value} in {s_list(m)} then '{k}'" for k, m in classes.items()) + f" else {default} end"


RANK = "case confidence when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"
S_JOIN = lambda x, cond=None: f"coalesce(string_agg(distinct {x}, ',' order by {x}){f' filter (where {cond})' if cond else ''}, '')"

# Routes matched by every path with every route, for comparison with the keyed join.
S_ROUTES = f"""routes as (select distinct n.norm, repo, path, {s_sig('n.norm')} as sig from (select *, {s_norm('path')} as norm from node where family = 'http-in' and kind = 'source') n where n.norm <> ''),
wanted as (select distinct norm, sig from (select {s_norm('path')} as norm, {s_sig(s_norm('path'))} as sig from node where family = 'http-out' and kind = 'sink' and path is not null) where len(sig) > 0),
exact as (select w.norm, w.norm as route_norm, 'high' as confidence from wanted w where w.norm in (select norm from routes)),
scored as (select w.norm, r.norm as route_norm, {s_label('w.norm', 'r.norm', 'w.sig', 'r.sig')} as confidence, -abs(len(r.sig) - len(w.sig)) as near from wanted w, (select distinct norm, sig from routes) r where w.norm not in (select norm from routes)),
ranked as (select *, rank() over (partition by norm order by {RANK} desc, near desc) as k from scored where confidence is not null),
matched as (select * from exact union all select norm, route_norm, confidence from ranked where k = 1)"""


_PUB, _SUB = "family = 'queue-pub'", "family = 'queue-sub'"


@query(
    "queue_graph",
    f"""select topic, {S_JOIN('system')} as systems, {S_JOIN('repo', _PUB)} as producers, {S_JOIN('repo', _SUB)} as consumers,
    count(distinct repo) filter (where {_PUB}) as n_producers, count(distinct repo) filter (where {_SUB}) as n_consumers,
    count(*) filter (where {_SUB}) = 0 as produce_only, count(*) filter (where {_PUB}) = 0 as consume_only
    from node where family in ('queue-pub', 'queue-sub') group by topic""",
)
def _(node):
    return inventory.queue_graph(node)


@query("queue_orphans", "select topic, count(distinct repo) filter (where family = 'queue-pub') as n_producers, count(distinct repo) filter (where family = 'queue-sub') as n_consumers from node where family in ('queue-pub', 'queue-sub') group by topic having n_producers = 0 or n_consumers = 0")
def _(node):
    return inventory.queue_graph(node).where("produce_only or consume_only").select("topic", "n_producers", "n_consumers")


_STORE_KEY = r"""case vendor when 'jdbc' then case when regexp_matches(url, '(?i)jdbc:([a-z0-9]+)://([^/\s"'';?]+)') then concat('jdbc:', lower(regexp_extract(url, '(?i)jdbc:([a-z0-9]+)://([^/\s"'';?]+)(?:/([A-Za-z0-9_\-]+))?', 1)), '://', lower(regexp_extract(url, '(?i)jdbc:([a-z0-9]+)://([^/\s"'';?]+)(?:/([A-Za-z0-9_\-]+))?', 2)), '/', regexp_extract(url, '(?i)jdbc:([a-z0-9]+)://([^/\s"'';?]+)(?:/([A-Za-z0-9_\-]+))?', 3)) else concat('jdbc:unknown:', left(url, 80)) end
when 'mongodb' then concat('mongodb://', case when regexp_matches(url, '(?i)mongodb(?:\+srv)?://([^/\s"'';?]+)') then lower(regexp_extract(url, '(?i)mongodb(?:\+srv)?://([^/\s"'';?]+)', 1)) else left(url, 80) end)
when 'redis' then concat('redis://', case when regexp_matches(url, '(?i)rediss?://([^/\s"'';?]+)') then lower(regexp_extract(url, '(?i)rediss?://([^/\s"'';?]+)', 1)) else left(url, 80) end)
when 's3' then case when coalesce(bucket, '') <> '' then concat('s3://', bucket) end end"""


@query("data_store_graph", f"select store_key, arg_min(vendor, ord) as vendor, {S_JOIN('repo')} as repos, count(distinct repo) as n_repos, arg_min(concat_ws(':', file, line), ord) as sample from (select *, {_STORE_KEY} as store_key from node where family = 'data-store' and kind = 'store') where store_key is not null group by store_key")
def _(node):
    return inventory.store_graph(node)


@query("stores_by_vendor", f"select vendor, count(*) as n_stores, cast(sum(n) as bigint) as n_links from (select store_key, arg_min(vendor, ord) as vendor, count(distinct repo) as n from (select *, {_STORE_KEY} as store_key from node where family = 'data-store' and kind = 'store') where store_key is not null group by store_key) group by vendor")
def _(node):
    return inventory.stores_by_vendor(node)


@query("sql_exec_by_repo", "select repo, count(*) as n_sql from node where family = 'sql' and kind = 'sink' and coalesce(execution, true) group by repo")
def _(node):
    return inventory.sql_executions(node)


@query("route_index", f"select norm, count(*) as n_endpoints, count(distinct repo) as n_repos from (select repo, {s_norm('path')} as norm from node where family = 'http-in' and kind = 'source') where norm <> '' group by norm")
def _(node):
    return routes.route_index(node).groupBy("norm").agg(F.count(F.lit(1)).alias("n_endpoints"), F.count_distinct("repo").alias("n_repos"))


def _matches(node):
    return routes.match_routes(routes.distinct_norms(calls.outbound_calls(node)), routes.route_index(node))


@query("route_exact_match", f"+{S_ROUTES} select e.norm, r.repo, count(*) as n_routes from exact e join routes r on e.route_norm = r.norm group by all")
def _(node):
    table = routes.route_index(node).select(F.col("norm").alias("route_norm"), "repo", "path").distinct()
    return _matches(node).where("norm = route_norm").join(table, "route_norm").groupBy("norm", "repo").agg(F.count(F.lit(1)).alias("n_routes"))


@query("route_fuzzy_best_match", f"+{S_ROUTES} select norm, route_norm, confidence from matched where norm <> route_norm")
def _(node):
    return _matches(node).where("norm != route_norm")


S_ALIAS = """names as (select ord, repo, unnest(list_distinct(case when ends_with(lower(name), '-service') then [lower(name), replace(lower(name), '-', '_'), replace(lower(name), '-', ''), left(lower(name), length(name) - 8)] else [lower(name), replace(lower(name), '-', '_'), replace(lower(name), '-', '')] end)) as alias from repo),
own_alias as (select alias, arg_max(repo, ord) as repo from names group by alias),
index as (select * from own_alias union all select lower(alias), min(target_repo) from binding where alias <> '' and lower(alias) not in (select alias from own_alias) group by 1)"""
S_HOSTS = f"""{S_ALIAS},
seen as (select distinct host, lower(host) as low from node where host is not null and host not in {s_list(V.NOISE_HOSTS)}),
direct as (select host, low, coalesce((select repo from index where alias = low), (select repo from index where alias = split_part(low, '.', 1))) as repo from seen),
contained as (select d.host, arg_min(n.repo, n.ord) as repo from direct d join names n on contains(d.low, n.alias) where d.repo is null and n.alias <> '' group by d.host),
hosted as (select host, repo from direct where repo is not null union all select host, repo from contained)"""


@query("host_to_repo", f"+{S_HOSTS} select * from hosted", ("node", "repo", "binding"))
def _(node, repo, binding):
    return routes.resolve_hosts(node.select("host"), routes.aliases(repo, binding), repo)


_EV_PATH = "concat('path literal ''', call_path, ''' in http-out')"
_REF = "concat_ws(':', file, line)"
_URL = r"(?i)https?://[A-Za-z0-9][A-Za-z0-9.\-]*(?::[0-9]+)?(?:/[^\s\"''<>]*)?"
# Host and path literals of a text.
S_LITERALS = f"""texts as (select ord, repo, file, line, family, kind, path, host, target_repo, raw, regexp_extract_all(raw, '{_URL}') as urls from node),
literal as (select *, list_filter(list_transform(urls, lambda u: lower(regexp_extract(u, '://([^/:]+)', 1))), lambda h: h <> '' and h not in {s_list(V.NOISE_HOSTS)}) as url_hosts,
list_concat(list_filter(list_transform(urls, lambda u: regexp_extract(u, '://[^/]*(/[^?#]*)', 1)), lambda p: p <> '' and p <> '/'), regexp_extract_all(raw, '["''](/[A-Za-z0-9][A-Za-z0-9_./\\-{{}}]*)["'']', 1)) as url_paths from texts)"""
S_EDGES = f"""{S_ALIAS}, {S_LITERALS},
routes as (select distinct norm, {s_sig('norm')} as sig, repo, path from (select repo, path, {s_norm('path')} as norm from node where family = 'http-in' and kind = 'source') where norm <> ''),
outs as (select * from literal where family = 'http-out' and kind = 'sink'),
call_paths as (select ord, repo, file, line, target_repo, family, call_path, {s_norm('call_path')} as norm, 0 as k from (select *, unnest(list_distinct(list_concat(case when path is null then [] else [path] end, url_paths))) as call_path from outs)
  union all select ord, repo, file, line, target_repo, family, call_path, {s_norm('call_path')} as norm, 1 as k from (select *, unnest(list_distinct(url_paths)) as call_path from literal)),
call_hosts as (select *, 0 as k from (select *, unnest(list_distinct(list_concat(case when host is null then [] else [host] end, url_hosts))) as call_host from outs) union all select *, 1 as k from (select *, unnest(list_distinct(url_hosts)) as call_host from literal)),
wanted as (select distinct norm, {s_sig('norm')} as sig from call_paths),
scored as (select w.norm, r.norm as route_norm, case when w.norm = r.norm then 'high' else {s_label('w.norm', 'r.norm', 'w.sig', 'r.sig')} end as confidence, w.norm = r.norm as same, -abs(len(r.sig) - len(w.sig)) as near from wanted w, (select distinct norm, sig from routes) r where len(w.sig) > 0),
ranked as (select *, rank() over (partition by norm order by same desc, {RANK} desc, near desc) as rk from scored where confidence is not null),
hits as (select c.*, r.repo as route_repo, r.path as route_path, m.confidence as match from call_paths c join ranked m on c.norm = m.norm and m.rk = 1 join routes r on r.norm = m.route_norm),
seen as (select distinct call_host as host, lower(call_host) as low from call_hosts where call_host not in {s_list(V.NOISE_HOSTS)}),
direct as (select host, low, coalesce((select repo from index where alias = low), (select repo from index where alias = split_part(low, '.', 1))) as repo from seen),
hosted as (select host, repo from direct where repo is not null union all select d.host, arg_min(n.repo, n.ord) from direct d join names n on contains(d.low, n.alias) where d.repo is null and n.alias <> '' group by d.host),
declared as (select o.* from outs o where target_repo is not null and not exists (select 1 from hits h where h.k = 0 and h.ord = o.ord and h.route_repo = o.target_repo)),
every as (
  select repo as source_repo, route_repo as target_repo, route_path as target_path, match as confidence, case k when 0 then {_EV_PATH} else concat('path/url reference in ', family) end as evidence, {_REF} as ref, k as kind, ord from hits
  union all select c.repo, c.target_repo, c.call_path, 'medium', concat('declared target; path ''', c.call_path, ''' at call site'), concat_ws(':', c.file, c.line), 0, c.ord from call_paths c where c.k = 0 and c.ord in (select ord from declared)
  union all select repo, target_repo, '*', 'medium', 'declared target', {_REF}, 0, ord from declared where ord not in (select ord from call_paths where k = 0)
  union all select c.repo, h.repo, '*', 'low', case k when 0 then concat('host ''', call_host, ''' in http-out') else concat('host reference in ', family) end, {_REF}, k, ord from call_hosts c join hosted h on c.call_host = h.host
  union all select repo, target_repo, coalesce(path, '*'), 'high', concat('api-client binding ', coalesce(client, 'api-client'), case when path is null then '' else ' (declared path)' end), {_REF}, 2, ord from node where family = 'api-client-consumer' and target_repo is not null),
numbered as (select *, row_number() over (partition by source_repo, target_repo, target_path, confidence order by kind, ord, evidence) as rn from every where source_repo <> target_repo),
edges as (select source_repo, target_repo, target_path, confidence, evidence, ref from numbered where rn = 1)"""
_ALL = ("node", "repo", "binding")


def _graph(node, repo, binding):
    return calls.service_graph(node, repo, binding)[0]


@query("service_call_edges", f"+{S_EDGES} select * from edges", _ALL)
def _(node, repo, binding):
    return calls.edges(_graph(node, repo, binding))


@query(
    "service_call_unmatched",
    f"""+{S_EDGES}, known as materialized (select distinct norm from ranked where rk = 1),
    own_hosts as materialized (select * from call_hosts where k = 0), own_paths as materialized (select ord, norm from call_paths where k = 0),
    caught as materialized (select p.ord from own_paths p join known using (norm) union select ord from outs where target_repo is not null),
    named as materialized (select distinct host from hosted)
    select c.repo as source_repo, call_host as host, {_REF} as ref, 'host did not resolve to a known repo' as reason from own_hosts c anti join named h on c.call_host = h.host anti join caught k on c.ord = k.ord
    union all select repo, '', {_REF}, 'no host, path, or declared target resolved' from outs o anti join caught k on o.ord = k.ord anti join own_hosts c on o.ord = c.ord""",
    _ALL,
)
def _(node, repo, binding):
    return calls.unmatched(node, repo, binding)


@query("call_edges_by_confidence", f"+{S_EDGES} select confidence, count(*) as n_edges from edges group by confidence", _ALL)
def _(node, repo, binding):
    return calls.graph_by_confidence(_graph(node, repo, binding))


@query("top_repo_pairs", f"+{S_EDGES} select source_repo, target_repo, count(*) as n_edges from edges group by all order by n_edges desc, source_repo, target_repo limit 40", _ALL)
def _(node, repo, binding):
    return calls.graph_top_pairs(_graph(node, repo, binding))


@query("binding_coverage", f"+{S_EDGES}, n as (select target_repo, count(*) as n_edges, count(*) filter (where starts_with(evidence, 'api-client')) as b from edges group by 1) select d.target_repo, coalesce(n_edges, 0) as n_edges, coalesce(b, 0) as n_binding_edges, case when coalesce(b, 0) > 0 then 'OK' when coalesce(n_edges, 0) > 0 then 'no binding-derived edges' else 'none' end as status from (select distinct target_repo from binding) d left join n using (target_repo)", _ALL)
def _(node, repo, binding):
    return calls.graph_coverage(binding, _graph(node, repo, binding))


@query("api_client_edges", "select distinct repo as source_repo, target_repo, coalesce(path, '*') as target_path from node where family = 'api-client-consumer' and target_repo is not null and repo <> target_repo")
def _(node):
    return calls.api_client_edges(node).select("source_repo", "target_repo", "target_path").distinct()


S_OPENAPI = f"""{S_LITERALS},
routes as (select distinct {s_norm('path')} as norm, target_repo as repo, path from spec), route_norms as (select distinct norm, {s_sig('norm')} as sig from routes),
outs as (select *, list_distinct(list_concat(case when path is null then [] else [path] end, url_paths)) as ps from literal where family in ('http-out', 'api-client-consumer')),
call_paths as (select ord, repo, target_repo, family, file, line, u.p as call_path, u.i as pos, {s_norm('u.p')} as norm from (select *, unnest(list_transform(range(1, len(ps) + 1), lambda i: {{'i': i, 'p': ps[i]}})) as u from outs)),
wanted as (select distinct norm, {s_sig('norm')} as sig from call_paths),
scored as (select w.norm, r.norm as route_norm, case when w.norm = r.norm then 'high' else {s_label('w.norm', 'r.norm', 'w.sig', 'r.sig')} end as confidence, w.norm = r.norm as same, -abs(len(r.sig) - len(w.sig)) as near from wanted w, route_norms r where len(w.sig) > 0),
ranked as (select *, rank() over (partition by norm order by same desc, {RANK} desc, near desc) as rk from scored where confidence is not null),
hits as (select c.*, r.repo as route_repo, r.path as route_path, r.norm as route_norm from call_paths c join ranked m on c.norm = m.norm and m.rk = 1 join routes r on r.norm = m.route_norm where c.repo <> r.repo and (c.target_repo is null or c.target_repo = r.repo)),
first as (select *, row_number() over (partition by repo, route_repo, route_norm order by ord, pos, route_path) as rn from hits),
openapi as (select repo as source_repo, route_repo as target_repo, route_path as target_path, 'openapi' as confidence, concat(family, ' path matches OpenAPI') as evidence, {_REF} as ref from first where rn = 1)"""


@query("openapi_edges", f"+{S_OPENAPI} select * from openapi", ("node", "spec"))
def _(node, spec):
    return calls.openapi_edges(node, spec)


@query("openapi_merge_anti", f"+{S_OPENAPI}, there as (select * from openapi where length(source_repo) % 2 = 0) select source_repo, target_repo, count(*) as n from (select * from there union all select * from openapi o where not exists (select 1 from there t where t.source_repo = o.source_repo and t.target_repo = o.target_repo and t.target_path = o.target_path)) group by all", ("node", "spec"))
def _(node, spec):
    found = calls.openapi_graph(node, spec)
    return calls.graph_pairs(calls.merge_graphs(calls.of_sources(found, F.length("source_repo") % 2 == 0), found))


_BUCKET = "case when family = 'sql' and kind = 'source' then 'sql-sources' when family = 'sql' and coalesce(execution, true) then 'sql-sinks' when family = 'sql' then 'sql-orm-sinks' when family = 'data-store' and kind = 'store' then 'data-store' when family in ('pii-log', 'pii-storage') then 'pii-sinks' when family in ('file', 'http-out', 'crypto-algorithm', 'crypto-key-source', 'pii-field', 'data-class-field', 'raw-code-payload', 'config-security', 'crypto-config') then family end"


@query("taint_bucket_counts", f"select bucket, count(*) as n_nodes, count(distinct repo) as n_repos, count(*) filter (where confidence = 'high') as n_high from (select * exclude (bucket), {_BUCKET} as bucket from node) where bucket is not null group by bucket")
def _(node):
    return inventory.bucket_counts(node)


@query("sql_posture_summary", "select coalesce(parameterised, 'unknown') as posture, count(*) as n_sinks, count(distinct repo) as n_repos from node where family = 'sql' and kind = 'sink' group by 1")
def _(node):
    return inventory.posture_summary(node)


_WEAK = s_list(V.WEAK_CARD_ALGORITHMS)


@query("repo_index_rows", "select r.repo, r.grp, r.primary_language, " + ", ".join(f"count(*) filter (where n.family = '{f}') as n_{f.replace('-', '_')}" for f in COUNTED) + f", count(*) filter (where n.family = 'crypto-algorithm' and upper(algorithm) in {_WEAK}) as n_weak_crypto from repo r left join node n on n.repo = r.repo group by r.repo, r.grp, r.primary_language", ("node", "repo"))
def _(node, repo):
    return inventory.index_rows(node, repo)


@query("repos_by_language", f"select primary_language, count(*) as n_repos, {S_JOIN('grp')} as groups from repo group by 1", ("repo",))
def _(repo):
    return inventory.by_language(repo)


@query("repos_by_group", f"select grp, count(*) as n_repos, {S_JOIN('primary_language')} as languages from repo group by 1", ("repo",))
def _(repo):
    return inventory.by_group(repo)


_LANG = "case line % 3 when 0 then 'a' when 1 then 'b' else 'c' end"


@query("language_breakdown", f"select repo, language as primary_language, n_files from (select repo, language, cast(sum(n) over (partition by repo) as bigint) as n_files, row_number() over (partition by repo order by n desc, f) as k from (select repo, {_LANG} as language, count(*) as n, min(ord) as f from node group by 1, 2)) where k = 1")
def _(node):
    return inventory.language_breakdown(node.select("repo", F.expr(_LANG).alias("language"), "ord"))


_WAS = "n + floor(n * (length(family) % 3) / 20.0)"


@query("family_baseline_drop", f"select family, cast({_WAS} as bigint) as was, n from (select family, count(*) as n from node group by 1) where n < ({_WAS}) * 0.95")
def _(node):
    now = inventory.family_counts(node)
    return inventory.baseline_drops(now, now.select("family", F.expr(f"cast({_WAS} as bigint) as n")))


@query("auth_cards", "select r.repo, coalesce(n_http_in, 0) as n_http_in, array_to_string(p, ',') as patterns, case when list_has_any(p, ['secured-authenticated', 'spring-pre-authorize']) then 'authenticated-default' when list_has_any(p, ['permit-all-config', 'is-anonymous']) then 'anonymous-or-permit-all' when n_http_in > 0 and len(p) = 0 then 'http-without-auth-annotations' else 'unknown' end as maturity from repo r left join (select repo, count(*) filter (where family = 'http-in') as n_http_in, coalesce(list_sort(list_distinct(list(coalesce(pattern, 'unknown')) filter (where family = 'auth'))), []) as p from node where family in ('auth', 'http-in') group by repo) using (repo)", ("node", "repo"))
def _(node, repo):
    return inventory.auth_cards(node, repo)


@query("auth_running_public_paths", "select repo, path, rank from (select *, row_number() over (partition by repo order by ord) as rank from (select *, max(case when family = 'auth' and pattern in ('permit-all-config', 'is-anonymous') then 1 else 0 end) over (partition by repo order by ord rows between unbounded preceding and current row) as o from node where family in ('auth', 'http-in')) where family = 'http-in' and o = 1 and path is not null and path <> '') where rank <= 10")
def _(node):
    return inventory.public_paths(node)


@query("crypto_cards", f"select r.repo, count(*) filter (where family = 'crypto-algorithm') as n_algorithms, count(*) filter (where family in ('crypto-config', 'config-security')) as n_key_sources, count(*) filter (where family = 'crypto-algorithm' and (a in {_WEAK} or contains(a, 'MD5') or contains(a, 'SHA1'))) as n_weak, case when n_algorithms > 0 and n_key_sources > 0 then 'config-driven' when n_algorithms > 0 then 'hardcoded-algorithms' when n_key_sources > 0 then 'config-keys-only' else 'none-detected' end as maturity from repo r left join (select *, upper(coalesce(algorithm, '?')) as a from node) n on n.repo = r.repo group by r.repo", ("node", "repo"))
def _(node, repo):
    return inventory.crypto_cards(node, repo)


@query("crypto_cards_topk", "select repo, algo, n, rank from (select *, row_number() over (partition by repo order by n desc, f) as rank from (select repo, upper(coalesce(algorithm, '?')) as algo, count(*) as n, min(ord) as f from node where family = 'crypto-algorithm' group by 1, 2)) where rank <= 3")
def _(node):
    return inventory.top_algorithms(node, 3)


# Personal data.

_KEY = "regexp_replace(field_name, '([a-z])([A-Z])', '\\1_\\2', 'g')"
S_KEY = f"case when field_name is null or field_name = '' then 'unknown' else case replace(lower({_KEY}), '-', '_') " + " ".join(f"when '{a}' then '{b}'" for a, b in V.FIELD_ALIASES.items()) + f" else replace(lower({_KEY}), '-', '_') end end"
_CLS = "coalesce(pii_classification, 'unknown')"
_DEL = r"(?i)\b(delete|remove|erase|purge|forget)\w*\b"


def s_near(stage: str, name: str, probes: str) -> str:
    return f"select repo, '{stage}', '{name}', key, f.cls, f.file, line, 'low' from (select repo, key, line, min({{'file': file, 'cls': cls}}) as f from keyed k where family = 'pii-field' and field_name <> '' and exists (select 1 from node p where p.family in {probes} and p.repo = k.repo and p.file = k.file and abs(p.line - k.line) <= 80) group by repo, key, line)"


S_TOUCH = f"""keyed as (select *, {S_KEY} as key, {_CLS} as cls from node where family in ('pii-field', 'pii-log', 'pii-storage')),
touch(repo, stage, family, field_key, pii_classification, file, line, confidence) as (
select repo, 'collect', family, key, cls, file, line, confidence from keyed where family = 'pii-field' and coalesce(field_name, '') <> ''
union all select repo, 'store', family, key, cls, file, line, confidence from keyed where family = 'pii-storage'
union all select repo, 'log', family, key, cls, file, line, confidence from keyed where family = 'pii-log'
union all {s_near('process', 'sql+near-pii-field', "('sql')")}
union all {s_near('transmit', 'http-out+near-pii-field', "('http-out')")}
union all {s_near('encrypt', 'crypto+near-pii-field', "('crypto-algorithm', 'crypto-config')")}
union all select repo, 'delete', family, key, cls, file, line, confidence from keyed k where coalesce(field_name, '') <> '' and exists (select 1 from node p where regexp_matches(p.raw, '{_DEL}') and p.repo = k.repo and p.file = k.file and abs(p.line - k.line) <= 30))"""


@query("pii_touchpoints", f"+{S_TOUCH} select * from touch")
def _(node):
    return privacy.touchpoints(node)


@query("pii_proximity_range_join", f"+{S_TOUCH} select stage, field_key, count(*) as n, count(distinct repo) as n_repos from touch where confidence = 'low' and contains(family, 'near') group by all")
def _(node):
    return privacy.proximity_touches(node).groupBy("stage", "field_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo").alias("n_repos"))


@query("pii_delete_hints", f"+{S_TOUCH} select repo, field_key, count(*) as n from touch where stage = 'delete' group by all")
def _(node):
    return privacy.delete_touches(node).groupBy("repo", "field_key").agg(F.count(F.lit(1)).alias("n"))


@query("pii_lifecycle_by_field", f"+{S_TOUCH} select field_key, pii_classification, count(*) as n_touches, " + ", ".join(f"count(distinct repo) filter (where stage = '{s}') as n_{s}" for s in STAGES) + " from touch group by 1, 2")
def _(node):
    return privacy.lifecycle(privacy.touchpoints(node))


@query("pii_by_stage", f"+{S_TOUCH} select s.stage, count(t.stage) as n from (select unnest([{', '.join(repr(s) for s in STAGES)}]) as stage) s left join touch t on s.stage = t.stage group by 1")
def _(node):
    return privacy.by_stage(privacy.touchpoints(node))


@query("pii_flow_by_class", f"select {_CLS} as pii_class, count(*) as n, count(distinct repo) as n_repos from node where family in ('pii-field', 'pii-log', 'pii-storage') group by 1")
def _(node):
    return privacy.flow_by_class(node)


@query("pii_top_fields", "select lower(field_name) as field, count(*) as n from node where family in ('pii-field', 'pii-log', 'pii-storage') and field_name is not null group by 1 order by n desc, field limit 5")
def _(node):
    return privacy.top_fields(node, 5)


@query("pii_probable_handlers", "select repo, count(*) filter (where family in ('pii-field', 'pii-log', 'pii-storage')) as n_pii, count(*) filter (where family in ('pii-field', 'pii-log', 'pii-storage') and pii_classification in ('sensitive', 'special-category-gdpr')) as n_sensitive, count(*) filter (where family = 'http-in') as n_in, count(*) filter (where family = 'http-out') as n_out from node group by repo having n_pii > 0 and n_in > 0 and n_out > 0")
def _(node):
    return privacy.probable_handlers(node)


_MATERIAL = "(family in ('pii-field', 'pii-log', 'pii-storage', 'queue-pub') or stage in ('store', 'log', 'collect', 'delete', 'encrypt') or (stage = 'transmit' and confidence <> 'low'))"
_STRONG = "(family in ('pii-log', 'pii-storage', 'queue-pub', 'queue-sub') or stage in ('store', 'log', 'delete', 'encrypt'))"


@query("pii_queue_hops", f"+{S_TOUCH}, material as (select distinct repo from touch where field_key = 'iban' and {_MATERIAL}), q as (select distinct repo, topic, family from node where family in ('queue-pub', 'queue-sub') and topic <> '?' and topic <> '' and repo in (select repo from material)), hops as (select p.repo as source_repo, c.repo as target_repo, p.topic as via from q p join q c on p.topic = c.topic and p.family = 'queue-pub' and c.family = 'queue-sub' and p.repo <> c.repo) select 'iban' as field_key, via, source_repo as repo, 'source' as role, count(*) as n_hops, 'medium' as confidence from hops group by via, source_repo union all select 'iban', via, target_repo, 'target', count(*), 'medium' from hops group by via, target_repo")
def _(node):
    return privacy.queue_hops(node, privacy.touchpoints(node), "iban")


_NOISE = " or ".join(f"p = '{x}' or starts_with(p, '{x}/')" for x in V.NOISE_PATHS)


@query("pii_http_hops", f"+{S_EDGES}, {S_TOUCH}, strong as (select distinct repo from touch where field_key = 'iban' and {_STRONG}) select 'iban' as field_key, source_repo, target_repo, target_path as via, confidence from (select *, case when regexp_replace(split_part(target_path, '?', 1), '/+$', '') = '' then '/' else regexp_replace(split_part(target_path, '?', 1), '/+$', '') end as p from edges) where confidence in ('high', 'openapi') and not ({_NOISE}) and source_repo in (select repo from strong) and target_repo in (select repo from strong)", _ALL)
def _(node, repo, binding):
    return privacy.http_hops(_graph(node, repo, binding), privacy.touchpoints(node), "iban")


_CAT = "case pii_classification " + " ".join(f"when '{k}' then '{v}'" for k, v in V.ROPA_CATEGORIES.items()) + f" else '{V.ROPA_UNKNOWN}' end"


@query(
    "ropa_activities",
    f"""+{S_TOUCH}, g as (select {_CAT} as category, pii_classification, repo, {", ".join(f"bool_or(stage = '{s}') as has_{s}" for s in STAGES)}, list_sort(list_distinct(list(field_key))) as keys from touch group by 1, 2, 3)
    select category, pii_classification, repo,
    coalesce(nullif(array_to_string(list_filter([case when has_collect or has_process then 'Service delivery / API processing' end, case when has_store then 'Persistence' end, case when has_log then 'Operations and diagnostics (logging)' end, case when has_transmit then 'Inter-service transmission' end], lambda x: x is not null), '; '), ''), 'Code references (stage unclear)') as purposes,
    array_to_string(list_filter([case when has_encrypt then 'Crypto operations near field (static)' end, case when has_log then 'Review logging sinks for field' else 'Logging exposure not detected in static scan' end], lambda x: x is not null), '; ') as security,
    case when has_transmit then 'Internal services' else 'Not inferred' end as recipients, case when has_store then 'See repo config / data-store graph' else 'Not inferred from static scan' end as retention, array_to_string(keys[1:20], ',') as field_keys from g""",
)
def _(node):
    return privacy.activities(privacy.touchpoints(node))


# Derivations.

_DBNAMES = "[" + ", ".join(f"'{x}'" for x in V.DATABASE_RECEIVERS) + "]"
_TAIL = "trim(string_split(receiver, '.')[-1])"
_TOK = f"list_transform(regexp_extract_all({_TAIL}, '[A-Z]+[0-9_]+|[A-Z][a-z]*|[a-z]+|[0-9]+'), lambda x: lower(x))"
_ISDB = f"coalesce(lower({_TAIL}) in {s_list(V.DATABASE_RECEIVERS)} or list_has_any({_TOK}, {_DBNAMES}) or list_has_any(list_transform(range(1, len({_TOK})), lambda i: concat({_TOK}[i], {_TOK}[i + 1])), {_DBNAMES}), false)"
_EXEC = f"case when (symbol in {s_list(V.SQL_EXECUTION_NAMES + V.SQL_ORM_NAMES)} or coalesce(library_hint, false)) and (coalesce(library_hint, false) or {_ISDB} or (not coalesce(lower(string_split(receiver, '.')[-1]) in {s_list(V.OTHER_RECEIVERS)}, false) and coalesce(file_sql_evidence, false))) then symbol in {s_list(V.SQL_EXECUTION_NAMES)} or coalesce(library_hint, false) end"
S_SINKS = f"sinks as (select * from (select * exclude (execution), {_EXEC} as execution from node where family = 'call-site') where execution is not null)"


@query("sql_classification", f"+{S_SINKS} select repo, symbol, execution, count(*) as n from sinks group by all")
def _(node):
    return derive.sql_sinks(node).groupBy("repo", "symbol", "execution").agg(F.count(F.lit(1)).alias("n"))


@query("raw_code_payloads", f"+{S_SINKS} select e.repo, e.file, e.p as endpoint_path, e.l as endpoint_line, m.line as field_line, s.symbol as sink_symbol, s.l as sink_line from (select repo, file, coalesce(path, '?') as p, min(line) as l from node where family = 'http-in' group by all) e join (select distinct repo, file, line from node where family = 'sql-field-marker') m using (repo, file) join (select repo, file, symbol, arg_min(line, ord) as l from sinks where execution group by all) s using (repo, file)")
def _(node):
    return derive.raw_code_payloads(node, derive.sql_sinks(node))


@query("entry_points", "select repo, file, line, mechanism, channel, mechanism <> 'schedule' as externally_triggered from (select *, case when family = 'entry-marker' then row_number() over (partition by repo, file, family, mechanism order by ord) else 1 end as k from (select repo, file, line, ord, family, case family when 'http-in' then 'http' when 'queue-sub' then 'queue' else mechanism end as mechanism, coalesce(case family when 'http-in' then path when 'queue-sub' then topic else raw end, '?') as channel from node where family in ('http-in', 'queue-sub', 'entry-marker'))) where k = 1")
def _(node):
    return derive.entry_points(node).select("repo", "file", "line", "mechanism", "channel", "externally_triggered")


@query("payload_carrier_asof", "select f.repo, f.file, f.line, f.ord, coalesce(min(c.line) filter (where c.line >= f.line), max(c.line)) as call_line from node f join node c on f.repo = c.repo and f.file = c.file and f.family = 'sql-field-marker' and c.family = 'http-out' group by f.repo, f.file, f.line, f.ord")
def _(node):
    return derive.payload_carriers(node.where("family = 'sql-field-marker'"), node.where("family = 'http-out'"))


_SPANS = "select distinct repo, file, line as start_line, line + 20 + line % 37 as end_line, concat('M', cast(line as string)) as owner from node where family = 'auth'"


@query("enclosing_method_interval", f"+spans as ({_SPANS}), ranked as (select n.repo, n.file, n.line, n.ord, s.owner, row_number() over (partition by n.ord order by s.end_line - s.start_line, s.start_line, s.owner) as k from node n left join spans s on n.repo = s.repo and n.file = s.file and n.line between s.start_line and s.end_line where n.family = 'call-site') select repo, file, line, ord, owner from ranked where k = 1")
def _(node):
    spans = node.where("family = 'auth'").selectExpr("repo", "file", "line as start_line", "line + 20 + line % 37 as end_line", "concat('M', cast(line as string)) as owner").distinct()
    return derive.enclosing(node.where("family = 'call-site'").select("repo", "file", "line", "ord"), spans)


@query("prune_unresolvable_semi", "select family, count(*) as n from node n where family <> 'call-site' or library_hint is not null or exists (select 1 from node d where d.family = 'sql' and d.repo = n.repo and d.symbol = n.symbol) group by family")
def _(node):
    return derive.prune_calls(node, node.where("family = 'sql'")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


# Symbol tables of a repository, projected: classes C0..C5 whose fields f0..f2 are of classes; C1 and C4 are interfaces.
_CALLS = "select ord as call_id, repo, concat('C', cast(line % 6 as string)) as owner, concat('m', cast(line % 5 as string)) as method, concat('m', cast(ord % 9 as string)) as symbol, case ord % 5 when 0 then 'this.f0' when 1 then 'f1' when 2 then 's.f2' when 3 then 'a.b' end as receiver, case when line % 2 = 0 then 's' end as self_name, line from {node} where family = 'call-site'"
_METHODS = "select distinct repo, concat('C', cast(line % 6 as string)) as class, concat('m', cast(ord % 7 as string)) as method from {node} where family in ('sql', 'auth')"
_TYPES = "select distinct repo, concat('C', cast(line % 6 as string)) as class, line % 6 in (1, 4) as is_interface from {node} where family = 'auth'"
_FIELDSQ = "select distinct repo, concat('C', cast(line % 6 as string)) as class, concat('f', cast(line % 3 as string)) as field, concat('C', cast((line * 5 + 1) % 6 as string)) as type from {node} where family = 'auth'"
_SUPERS = "select distinct repo, concat('C', cast(line % 6 as string)) as class, concat('C', cast((line % 6 + 1) % 6 as string)) as supertype from {node} where family = 'auth'"


def _symbols(node):
    return [node.sparkSession.sql(x, node=node) for x in (_CALLS, _METHODS, _TYPES, _FIELDSQ, _SUPERS)]


S_RESOLVE = f"""calls as ({_CALLS.format(node='node')}), methods as ({_METHODS.format(node='node')}), types as ({_TYPES.format(node='node')}), fields as ({_FIELDSQ.format(node='node')}), supers as ({_SUPERS.format(node='node')}),
plain as (select *, case when contains(r, '.') or r = '' then null else r end as f from (select *, case when self_name is not null and starts_with(regexp_replace(receiver, '^(this|self)\\.', ''), concat(self_name, '.')) then substr(regexp_replace(receiver, '^(this|self)\\.', ''), length(self_name) + 2) else regexp_replace(receiver, '^(this|self)\\.', '') end as r from calls)),
typed as (select p.*, t.type as ty, coalesce(k.is_interface, false) as iface from plain p join fields t on t.repo = p.repo and t.class = p.owner and t.field = p.f left join types k on k.repo = p.repo and k.class = t.type),
t1 as (select t.call_id, t.repo, t.symbol, 'T1' as tier, t.ty as to_class, false as ambiguous from typed t join methods m on not t.iface and m.repo = t.repo and m.class = t.ty and m.method = t.symbol),
t2 as (select call_id, repo, symbol, 'T2' as tier, to_class, count(*) over (partition by repo, call_id) > 1 as ambiguous from (select t.call_id, t.repo, t.symbol, s.class as to_class from typed t join supers s on t.iface and s.repo = t.repo and s.supertype = t.ty join methods m on m.repo = t.repo and m.class = s.class and m.method = t.symbol)),
better as (select * from t1 union all select * from t2),
once as (select repo, method, min(class) as to_class from methods group by 1, 2 having count(*) = 1),
resolved as (select * from better union all select c.call_id, c.repo, c.symbol, 'T3', o.to_class, false from calls c join once o on o.repo = c.repo and o.method = c.symbol where not exists (select 1 from better b where b.call_id = c.call_id and b.repo = c.repo)),
graded as (select *, case when ambiguous then 'low' when tier = 'T1' then 'high' when tier = 'T2' then 'medium' else 'low' end as confidence from resolved)"""


# A call graph for taint: methods n0..n11 of a repository; arguments are written from the parameters' names.
_DECL = "select distinct repo, concat('n', cast(line % 12 as string)) as scope, case line % 12 % 4 when 3 then 'b,a' else 'a,b' end as params from {node} where family in ('http-in', 'sql')"
_HOPS = "select repo, concat('n', cast(line % 12 as string)) as scope, concat('n', cast((line * 7 + k) % 12 as string)) as to_scope, case k when 0 then 'wrap(a),x' when 1 then 'x,b + 1' else 'aa,bb' end as arguments, case k when 0 then 'high' when 1 then 'medium' else 'low' end as confidence, min(ord) as ord from (select repo, line, ord % 3 as k, ord from {node} where family = 'call-site') group by 1, 2, 3, 4, 5"
_SINKS = "select distinct repo, concat('n', cast(line % 12 as string)) as scope, concat(repo, '#', cast(line % 12 as string)) as sink_id, case line % 2 when 0 then 'execute(a)' else 'run(b)' end as text from {node} where family = 'sql'"
_ENTRIES = "select distinct repo, concat('n', cast(line % 12 as string)) as scope, concat(repo, '@', cast(line % 12 as string)) as entry_id from {node} where family = 'http-in'"


def _taint(node):
    spark = node.sparkSession
    decl, hops, sinks, entries = (spark.sql(x, node=node) for x in (_DECL, _HOPS, _SINKS, _ENTRIES))
    decl = decl.withColumn("params", F.split("params", ","))
    resolved = hops.withColumn("arguments", F.split("arguments", ",")).join(decl.select("repo", F.col("scope").alias("to_scope"), F.col("params").alias("to_params")), ["repo", "to_scope"]).withColumn("tier", F.lit("T1"))
    return resolve.tainted_paths(entries, decl, resolved, sinks)


S_TAINT = f"""recursive decl as ({_DECL.format(node='node')}), hops as ({_HOPS.format(node='node')}), sinks as ({_SINKS.format(node='node')}), entries as ({_ENTRIES.format(node='node')}),
called as (select h.*, string_split(h.arguments, ',') as args, string_split(d.params, ',') as to_params from hops h join decl d on d.repo = h.repo and d.scope = h.to_scope),
walk(entry_id, repo, scope, tainted, scopes, ords, ranks) as (
  select e.entry_id, e.repo, e.scope, string_split(d.params, ','), [e.scope], cast([] as bigint[]), cast([] as integer[]) from entries e join decl d using (repo, scope)
  union all
  select w.entry_id, w.repo, c.to_scope, list_distinct(list_filter(list_transform(range(1, len(c.args) + 1), lambda i: case when list_has_any(regexp_extract_all(c.args[i], '[A-Za-z_][A-Za-z0-9_]*'), w.tainted) then c.to_params[i] end), lambda x: x is not null)),
    list_append(w.scopes, c.to_scope), list_append(w.ords, c.ord), list_append(w.ranks, case c.confidence when 'high' then 3 when 'medium' then 2 else 1 end)
  from walk w join called c on c.repo = w.repo and c.scope = w.scope
  where not list_contains(w.scopes, c.to_scope) and len(list_filter(c.args, lambda a: list_has_any(regexp_extract_all(a, '[A-Za-z_][A-Za-z0-9_]*'), w.tainted))) > 0),
found as (select w.*, s.sink_id, list_min(list_intersect(regexp_extract_all(s.text, '[A-Za-z_][A-Za-z0-9_]*'), w.tainted)) as hit, coalesce(list_min(w.ranks), 3) as rk from walk w join sinks s using (repo, scope)),
paths as (select entry_id, sink_id, repo, len(ords) as n_hops, array_to_string(scopes, '>') as path, hit as tainted_at_sink, case rk when 3 then 'high' when 2 then 'medium' else 'low' end as confidence, rk, ords from found where hit is not null)"""


def _recursive(name: str, tail: str):
    SQL[name] = "with recursive " + sql("+" + S_TAINT.removeprefix("recursive ") + tail, "node").removeprefix("with ")


@query("tainted_paths_recursive")
def _(node):
    return _taint(node).select("entry_id", "sink_id", "repo", "n_hops", "path", "tainted_at_sink", "confidence", "search_truncated")


_recursive("tainted_paths_recursive", " select entry_id, sink_id, repo, n_hops, path, tainted_at_sink, confidence, false as search_truncated from paths")


@query("taint_shortest_strongest")
def _(node):
    return resolve.shortest_strongest(_taint(node)).select("entry_id", "sink_id", "repo", "n_hops", "path", "confidence", "search_truncated")


_recursive("taint_shortest_strongest", ", best as (select *, row_number() over (partition by entry_id, sink_id order by n_hops, rk desc, ords) as k from paths) select entry_id, sink_id, repo, n_hops, path, confidence, false as search_truncated from best where k = 1")

@query("call_resolution_tiers", f"+{S_RESOLVE} select call_id, repo, symbol, tier, to_class, ambiguous, confidence from graded")
def _(node):
    return resolve.resolve_calls(*_symbols(node)).select("call_id", "repo", "symbol", "tier", "to_class", "ambiguous", "confidence")


# Producers, traces, libraries, discovery.

S_HITS = """outs as (select * from node where family = 'http-out' and kind = 'sink'),
raw_hits as (
select d.repo as source_repo, b.target_repo, 'dependency' as kind, 'high' as confidence, concat('depends on ', arg_min(d.artifact_id, d.ord)) as evidence, min(d.ord) as ord from dependency d join binding b on b.maven_artifact <> '' and contains(d.artifact_id, b.maven_artifact) group by d.repo, b.target_repo
union all select repo, target_repo, 'api-client', 'high', 'imports its client', ord from node where family = 'api-client-consumer' and target_repo in (select target_repo from binding)
union all select o.repo, b.target_repo, 'http-out', 'medium', concat('host ', o.host), o.ord from outs o join binding b on b.alias <> '' and contains(lower(o.host), lower(b.alias))
union all select o.repo, b.target_repo, 'http-out', 'low', concat('path ', o.path), o.ord from outs o join binding b on b.path <> '' and ends_with(o.path, b.path) and not coalesce(b.alias <> '' and contains(lower(o.host), lower(b.alias)), false)),
hits as (select source_repo, target_repo, kind, confidence, evidence from (select *, row_number() over (partition by source_repo, target_repo, kind order by case confidence when 'high' then 3 when 'medium' then 2 else 1 end desc, ord, evidence) as k from raw_hits where source_repo <> target_repo) where k = 1)"""
_PROD = ("node", "dependency", "binding")


@query("producer_hits_strongest", f"+{S_HITS} select * from hits", _PROD)
def _(node, dependency, binding):
    return fleet.producer_hits(node, dependency, binding).select("source_repo", "target_repo", "kind", "confidence", "evidence")


@query("trace_upstream_strongest", f"+{S_HITS}, edges as (select distinct repo as source_repo, target_repo, 'high' as confidence, 'api-client' as evidence from node where family = 'api-client-consumer' and target_repo is not null and repo <> target_repo), targets as (select target_repo from binding), u as (select target_repo, source_repo, 'graph' as kind, confidence, evidence from edges union all select target_repo, source_repo, concat('producer-', kind), confidence, evidence from hits) select * from u where target_repo in (select target_repo from targets)", _PROD)
def _(node, dependency, binding):
    edges = calls.api_client_edges(node).select("source_repo", "target_repo", F.lit("high").alias("confidence"), F.lit("api-client").alias("evidence")).distinct()
    return fleet.trace_upstream(edges, fleet.producer_hits(node, dependency, binding), binding.select("target_repo"))


@query("trace_target_facts", "select repo, count(*) filter (where family = 'http-in') as n_inbound, count(*) filter (where family = 'sql' and kind = 'sink' and coalesce(execution, true)) as n_sql_sinks, count(*) filter (where family = 'data-store') as n_stores from node where repo in (select target_repo from binding) group by repo", ("node", "binding"))
def _(node, binding):
    return fleet.target_facts(node, binding)


_CATALOGUE, _TRACED = "family = 'sql-field-marker'", "select target_repo as repo from node where family = 'api-client-consumer'"


def _traced(node):
    return node.where("family = 'api-client-consumer'").select(F.col("target_repo").alias("repo"))


@query("trace_coverage_intersect", f"select distinct repo from node where {_CATALOGUE} intersect {_TRACED}")
def _(node):
    return fleet.coverage(node.where(_CATALOGUE), _traced(node))[0]


@query("trace_coverage_except", f"select distinct repo from node where {_CATALOGUE} except {_TRACED}")
def _(node):
    return fleet.coverage(node.where(_CATALOGUE), _traced(node))[1]


@query("library_consumers", f"select concat_ws(':', group_id, artifact_id) as coordinate, count(distinct repo) as n_consumers, {S_JOIN('version')} as versions from dependency group by 1", ("dependency",))
def _(dependency):
    return fleet.library_consumers(dependency)


@query("dependency_dedupe", "select repo, group_id, artifact_id, version, version_kind from (select *, row_number() over (partition by repo, group_id, artifact_id order by ord) as k from dependency) where k = 1", ("dependency",))
def _(dependency):
    return fleet.dedupe_dependencies(dependency).drop("ord")


@query("dependency_summary", "select version_kind, count(*) as n from dependency group by 1", ("dependency",))
def _(dependency):
    return fleet.dependency_summary(dependency)


_IDENT = "select concat('com.acme.t', cast(s_suppkey % 3 as string)) as group_id, maven_artifact as artifact_id, concat(target_repo, case when length(target_repo) % 2 = 0 then '/client' else '' end) as clone_path from (select *, length(target_repo) + length(maven_artifact) as s_suppkey from {binding}) where maven_artifact <> ''"


@query("coordinate_resolution_tiers", f"+ident as ({_IDENT.format(binding='binding')}), w as (select distinct group_id, artifact_id from dependency), byname as (select artifact_id, min(clone_path) as p from ident group by 1 having count(distinct clone_path) = 1), bycoord as (select group_id, artifact_id, clone_path from (select *, row_number() over (partition by group_id, artifact_id order by length(clone_path), clone_path) as k from ident) where k = 1) select w.group_id, w.artifact_id, coalesce(c.clone_path, n.p) as clone_path, case when c.clone_path is not null then 'coordinate' when n.p is not null then 'unique-name' else 'unresolved' end as tier from w left join bycoord c using (group_id, artifact_id) left join byname n on n.artifact_id = w.artifact_id", ("dependency", "binding"))
def _(dependency, binding):
    return fleet.resolve_coordinates(dependency, dependency.sparkSession.sql(_IDENT, binding=binding))


@query("canonical_repo_longest_prefix", "+p as (select distinct concat(repo, '/', file) as path from node where family = 'auth'), k as (select repo from repo where ord % 2 = 0 union select grp from repo where ord % 5 = 0) select path, arg_max(k.repo, length(k.repo)) as repo from p left join k on p.path = k.repo or starts_with(p.path, concat(k.repo, '/')) group by path", ("node", "repo"))
def _(node, repo):
    known = repo.where("ord % 2 = 0").select("repo").union(repo.where("ord % 5 = 0").select("grp"))
    return fleet.canonical_repos(node.where("family = 'auth'").select(F.concat_ws("/", "repo", "file").alias("path")), known)


@query("client_repo_service", "+e as (select repo, name from repo where ord % 2 = 0), d as (select concat(grp, '/svc-', ord + 1, '-client') as r, concat('svc-', ord + 1) as stem from repo) select r as repo, min(e.repo) as service from d join e on string_split(e.repo, '/')[-1] in (stem, concat(stem, '-service')) group by r having count(*) = 1", ("repo",))
def _(repo):
    declaring = repo.select(F.concat(F.col("grp"), F.lit("/svc-"), (F.col("ord") + 1).cast("string"), F.lit("-client")).alias("repo"))
    return fleet.service_for_client(declaring, repo.where("ord % 2 = 0"))


_SUFFIX = " or ".join(f"ends_with(lower(artifact_id), '{s}')" for s in V.CLIENT_SUFFIXES)
S_DEMAND = f"""{S_ROUTES.replace("family = 'http-out' and kind = 'sink' and path is not null", "family = 'http-out' and path is not null and path <> ''")},
seen as (select distinct {s_norm('path')} as norm, repo, regexp_extract(file, '([^/]+?)(\\.[^./]*)?$', 1) as cls from node where family = 'http-out' and path is not null and path <> ''),
demand as (select r.repo as target_repo, count(distinct s.repo) as n_callers, count(distinct s.cls) as n_classes, {S_JOIN('r.path')} as paths from seen s join matched m on s.norm = m.norm join routes r on r.norm = m.route_norm where s.repo <> r.repo group by 1)"""
S_SUPPLY = f"supply as (select b.target_repo, min(d.artifact_id) as artifact_id, count(distinct d.repo) as n_consumers from dependency d join binding b on b.maven_artifact <> '' and b.maven_artifact = d.artifact_id where {_SUFFIX} group by 1)"


@query("demand_side_observations", f"+{S_DEMAND} select target_repo, n_callers, n_classes, paths from demand")
def _(node):
    return fleet.demand(node)


@query("client_discovery_full_outer", f"+{S_DEMAND}, {S_SUPPLY} select coalesce(s.target_repo, d.target_repo) as target_repo, coalesce(artifact_id, '') as artifact_id, coalesce(n_consumers, 0) as n_consumers, coalesce(n_callers, 0) as n_callers, coalesce(paths, '') as paths, case when artifact_id is not null and n_callers is not null then 'both' when artifact_id is not null then 'dependency' else 'call-site' end as discovery_method, case when paths <> '' then 'high' else 'medium' end as confidence from supply s full outer join demand d on s.target_repo = d.target_repo", _PROD)
def _(node, dependency, binding):
    return fleet.discovered_clients(fleet.supply(dependency, binding), fleet.demand(node))


@query("generic_classes", "select cls, count(distinct repo) as n_repos from (select regexp_extract(file, '([^/]+?)(\\.[^./]*)?$', 1) as cls, repo from node) group by 1 having n_repos > 3")
def _(node):
    return fleet.generic_classes(node)


@query("promotion_screen", "+c as (select artifact_id, case when ord % 7 = 0 then '' when ord % 3 = 0 then concat(repo, 'x') else repo end as target_repo from dependency) select artifact_id, target_repo, case when target_repo = '' then 'no target' when target_repo not in (select repo from repo) then 'unknown target' when target_repo not in (select repo from node where family = 'http-in') then 'target has no endpoints' end as refusal from c", ("node", "repo", "dependency"))
def _(node, repo, dependency):
    candidates = dependency.selectExpr("artifact_id", "case when ord % 7 = 0 then '' when ord % 3 = 0 then concat(repo, 'x') else repo end as target_repo")
    return fleet.screen_promotions(candidates, repo, node.where("family = 'http-in'"))


@query("binding_upsert", "+a as (select target_repo, maven_artifact, concat(path, '/v2') as path, alias from binding where length(alias) % 2 = 0 union all select concat(target_repo, '-new'), maven_artifact, path, alias from binding where length(alias) % 2 = 0) select * from binding b where not exists (select 1 from a where a.target_repo = b.target_repo and a.maven_artifact = b.maven_artifact) union all select * from a", ("binding",))
def _(binding):
    even = binding.where("length(alias) % 2 = 0")
    accepted = even.withColumn("path", F.concat("path", F.lit("/v2"))).unionByName(even.withColumn("target_repo", F.concat("target_repo", F.lit("-new"))))
    return fleet.upsert_bindings(binding, accepted)


@query("incremental_plan", "select repo, case when git_sha is null then 'analyse' when ord % 6 = 5 then 'analyse' when ord % 4 = 3 then 'analyse' when detection_version <> 19 then 'analyse' when derivation_version <> 6 then 're-derive' else 'skip' end as action from repo", ("repo",))
def _(repo):
    now = repo.selectExpr("repo", "case when ord % 4 = 3 then concat(git_sha, 'x') else git_sha end as git_sha")
    return fleet.incremental_plan(now, repo.where("ord % 6 <> 5"), 19, 6)


# Column functions over whole tables.


@query("normalize_path", f"select distinct path, {s_norm('path')} as norm from node where family in ('http-in', 'http-out')")
def _(node):
    return node.where("family in ('http-in', 'http-out')").select("path", paths.normalize_path(F.col("path")).alias("norm")).distinct()


@query("significant_segments", f"select distinct norm, array_to_string({s_sig('norm')}, '/') as segments, {s_ops(s_sig('norm'))} as only_operations from (select {s_norm('path')} as norm from node where family in ('http-in', 'http-out'))")
def _(node):
    sig = paths.significant_segments(F.col("norm"))
    return node.where("family in ('http-in', 'http-out')").select(paths.normalize_path(F.col("path")).alias("norm")).distinct().select("norm", F.array_join(sig, "/").alias("segments"), paths.only_operations(sig).alias("only_operations"))


@raw_query("extract_urls_paths", f"select page_id, array_to_string(list_filter(list_transform(regexp_extract_all(t, '{_URL}'), lambda u: lower(regexp_extract(u, '://([^/:]+)', 1))), lambda h: h <> '' and h not in {s_list(V.NOISE_HOSTS)}), ',') as hosts, array_to_string(list_concat(list_filter(list_transform(regexp_extract_all(t, '{_URL}'), lambda u: regexp_extract(u, '://[^/]*(/[^?#]*)', 1)), lambda p: p <> '' and p <> '/'), regexp_extract_all(t, '[\"''](/[A-Za-z0-9][A-Za-z0-9_./\\-{{}}]*)[\"'']', 1)), ',') as paths from (select page_id, concat(url, ' ', html) as t from pages)")
def _(read):
    t = F.concat("url", F.lit(" "), "html")
    return read("pages").select("page_id", F.array_join(paths.hosts(t), ",").alias("hosts"), F.array_join(paths.paths(t), ",").alias("paths"))


_DIGITS = r"[0-9][0-9\s.\-]{7,255}[0-9]"
_MAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,24}"


@raw_query(
    "redact_literals",
    f"""with m as (select doc_id, regexp_replace(text, '{_MAIL}', '<redacted-email>', 'g') as t from documents),
    p as (select doc_id, t, regexp_extract_all(t, '{_DIGITS}') as runs, string_split_regex(t, '{_DIGITS}') as parts from m)
    select doc_id, md5(array_to_string(list_transform(range(1, len(parts) + 1), lambda i: concat(parts[i], case when i <= len(runs) then case when length(regexp_replace(runs[i], '[^0-9]', '', 'g')) >= 9 then '<redacted-number>' else runs[i] end else '' end)), '')) as digest from p""",
)
def _(read):
    return read("documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("digest"))


_PII_RX = "(?i)(^|[^A-Za-z0-9_])(" + "|".join(sorted(V.PII_FIELDS, key=lambda x: (-len(x), x))) + ")($|[^A-Za-z0-9_])"


@raw_query("pii_field_scan", f"select item, field, {s_case('lower(field)', V.PII_CLASSES, chr(39) + 'unknown' + chr(39))} as pii_class, count(*) as n from (select 'p' as item, regexp_extract(concat(p_name, ' email:', p_brand, ' userAgent ', case when p_size % 3 = 0 then 'x_iban' else 'iban' end), '{_PII_RX}', 2) as field from part) group by all")
def _(read):
    t = F.expr("concat(p_name, ' email:', p_brand, ' userAgent ', case when p_size % 3 = 0 then 'x_iban' else 'iban' end)")
    return read("part").select(F.lit("p").alias("item"), F.regexp_extract(t, _PII_RX, 2).alias("field")).groupBy("item", "field").agg(F.count(F.lit(1)).alias("n")).withColumn("pii_class", fields.pii_class(F.col("field")))


@query("field_key_normalise", f"select distinct field_name, {S_KEY} as key, {s_case('lower(field_name)', V.PII_CLASSES, chr(39) + 'unknown' + chr(39))} as pii_class from (select field_name from node where family in ('pii-field', 'pii-log', 'pii-storage') union all select distinct lower(concat(system, '-', 'Name')) from node where system is not null)")
def _(node):
    names = node.where("family in ('pii-field', 'pii-log', 'pii-storage')").select("field_name").union(node.where("system is not null").select(F.lower(F.concat("system", F.lit("-Name")))).distinct())
    return names.distinct().select("field_name", fields.field_key(F.col("field_name")).alias("key"), F.coalesce(fields.pii_class(F.col("field_name")), F.lit("unknown")).alias("pii_class"))


@query("node_id_slug", "select concat_ws(':', repo, file, line, family, kind, left(sha256(concat_ws('|', family, kind, line, coalesce(symbol, ''))), 12)) as id, count(*) as n from node group by 1")
def _(node):
    c = [F.col(x) for x in ("repo", "file", "line", "family", "kind", "symbol")]
    return node.select(text.node_id(*c).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@raw_query("line_prescreen", "select reason, count(*) as n from (select case when contains(left(text, 8192), chr(0)) then 'binary content (null byte)' when length(left(text, 8192)) > 0 and (length(left(text, 8192)) - length(replace(left(text, 8192), '�', ''))) / length(left(text, 8192)) > 0.1 then 'binary or non-UTF-8 content' when len(list_filter(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: length(x) > 900)) > 0 then 'oversized line (> 900 bytes)' when contains(lower(text), 'license') then 'matched configured indicator: license' end as reason from documents) group by reason")
def _(read):
    return read("documents").select(text.skip_reason(F.col("text"), ["License"], longest=900).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@raw_query("sanitize_cells", "select doc_id, md5(c) as cell, md5(case when length(c) > 60 then concat(rtrim(left(c, 59)), '…') else c end) as short from (select doc_id, replace(regexp_replace(regexp_replace(text, '[\\r\\n\\t\\x0b\\f]', ' ', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '|', '\\|') as c from documents)")
def _(read):
    return read("documents").select("doc_id", F.md5(text.table_cell(F.col("text"))).alias("cell"), F.md5(text.markdown(F.col("text"), 60)).alias("short"))


@query("alias_search", "select raw, coalesce('g/' || nullif(regexp_extract(lower(raw), '(^|[^a-z0-9])(svc-[0-9])([^a-z0-9]|$)', 2), ''), '') as repo, count(*) as n from node group by 1, 2")
def _(node):
    from tracelake.extractors.scan import Binding, named_services

    texts = node.groupBy(F.col("raw").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return named_services(texts, [Binding(f"g/svc-{k}") for k in range(10)]).select(F.col("text").alias("raw"), F.coalesce("repo", F.lit("")).alias("repo"), "n")


@query("path_filter", "select distinct path from node where family in ('http-in', 'http-out') and path like '%lines3%' and not path like '%extra%'")
def _(node):
    return node.where("family in ('http-in', 'http-out')").where(paths.matches_filter(F.col("path"), "lines3")).select("path").distinct()


# Extraction: source files written from parts and suppliers, scanned, and their observations counted.

_SOURCE = """concat('class P', cast(p_partkey as string), ' {{\n  @GetMapping("/v1/p', cast(p_partkey % 30 as string), '")\n  void get() {{ kafkaTemplate.send("t', cast(p_size as string), '", x); }}\n  String ', case when p_partkey % 3 = 0 then 'email' else 'colour' end, ';\n}}\n')"""
_PROPERTIES = "concat('spring.datasource.url=jdbc:postgresql://db', cast(s_suppkey as string), ':5432/app\ncsrf.enabled=', case when s_suppkey % 2 = 0 then 'true' else 'false' end, '\n')"


@raw_query(
    "extract_observations",
    """select 'http-in' as family, concat('/v1/p', p_partkey % 30) as value, 2 as line, count(*) as n from part group by 2
    union all select 'queue-pub', concat('t', p_size), 3, count(*) from part group by 2
    union all select 'pii-field', 'email', 4, count(*) from part where p_partkey % 3 = 0
    union all select 'type-decl', 'P', 1, count(*) from part
    union all select 'method-decl', 'get', 3, count(*) from part
    union all select 'call-site', 'send', 3, count(*) from part""",
)
def _(read):
    from tracelake.extractors.scan import extract

    parts = read("part")
    source = parts.sparkSession.sql(f"select {_SOURCE} as text, p_partkey from {{part}}", part=parts)
    found = extract(source.select(F.concat(F.lit("g/r"), (F.col("p_partkey") % 50).cast("string")).alias("repo"), F.concat(F.lit("src/P"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("file"), F.lit("java").alias("language"), "text"))
    value = F.coalesce(*[F.get_json_object("detail", f"$.{k}") for k in ("path", "topic", "field_name")], F.when(F.col("family") == "type-decl", "P").otherwise(F.col("symbol")))
    return found.groupBy("family", value.alias("value"), "line").agg(F.count(F.lit(1)).alias("n"))


@raw_query(
    "extract_configuration",
    "select 'data-store' as family, concat('jdbc:postgresql://db', s_suppkey, ':5432/app') as value, 2 as n from supplier union all select 'config-security', concat('csrf.enabled=', case when s_suppkey % 2 = 0 then 'true' else 'false' end), count(*) from supplier group by 2",
)
def _(read):
    from tracelake.extractors.scan import extract

    suppliers = read("supplier")
    source = suppliers.sparkSession.sql(f"select {_PROPERTIES} as text, s_suppkey from {{supplier}}", supplier=suppliers)
    found = extract(source.select(F.lit("g/r").alias("repo"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string"), F.lit(".properties")).alias("file"), F.lit("config").alias("language"), "text"))
    value = F.coalesce(F.get_json_object("detail", "$.url"), F.get_json_object("detail", "$.value_line"))
    return found.groupBy("family", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
