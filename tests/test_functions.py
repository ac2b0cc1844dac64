import pytest
from pyspark.sql import functions as F

from tracelake.functions import fields, paths, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, ""), ("", ""), ("?", ""), ("a/b", "/a/b"), ("/a//b/", "/a/b"), ("/", "/"), ("/x/{id}/:n", "/x/{}/{}"), (" /v1/{a b} ", "/v1/{}")],
)
def test_normalize_path(spark, raw, want):
    assert value(spark, paths.normalize_path(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("/v1", "/v1", None),
        ("/{id}", "/{name}", None),
        ("/stock", "/stock", "high"),
        ("/v1/stock", "/stock", "medium"),
        ("/stock/dispatch", "/stock", "medium"),
        ("/orders/{id}/lines", "/lines", "low"),
        ("/search", "/search", "low"),
        ("/a/b", "/c", None),
        ("", "/a", None),
    ],
)
def test_match_label(spark, a, b, want):
    na, nb = (paths.normalize_path(F.lit(x)) for x in (a, b))
    sig = paths.significant_segments
    assert value(spark, paths.match_label(na, nb, sig(na), sig(nb))) == want
    assert value(spark, paths.match_label(nb, na, sig(nb), sig(na))) == want


@pytest.mark.parametrize(
    ("path", "wanted", "hit"),
    [("/v1/a", "/v1", True), ("/v1", "/v1/a", True), ("/x/lines", "lines", True), ("/lines", "/lines", True), ("/x", "/y", False), ("/a", None, True), ("?", "/a", False)],
)
def test_path_filter(spark, path, wanted, hit):
    assert value(spark, paths.matches_filter(F.lit(path), wanted)) is hit


def test_urls_and_paths(spark):
    t = F.lit("x = \"https://Svc.acme.com:8443/v1/a?b=1\"; y = '/orders/{id}'; http://localhost/z")
    assert value(spark, paths.hosts(t)) == ["svc.acme.com"]
    assert value(spark, paths.paths(t)) == ["/v1/a", "/z", "/orders/{id}"]


@pytest.mark.parametrize(("raw", "want"), [("phoneNumber", "phone"), ("PHONE", "phone"), ("emailAddress", "email_address"), (None, "unknown"), ("first-name", "first_name")])
def test_field_key(spark, raw, want):
    assert value(spark, fields.field_key(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("mail a.b@c.org now", "mail <redacted-email> now"),
        ("call +49 170 1234567.", "call +<redacted-number>."),
        ("on 2020-01-02 port 8080", "on 2020-01-02 port 8080"),
        ("", ""),
        ("4111 1111 1111 1111 and 123", "<redacted-number> and 123"),
    ],
)
def test_redact(spark, raw, want):
    assert value(spark, text.redact(F.lit(raw))) == want


def test_cells(spark):
    assert value(spark, text.table_cell(F.lit("a|b\n```x`y\x01"))) == "a\\|b ˋˋˋx`y"
    assert value(spark, text.markdown(F.lit("`" + "x" * 300), 10)) == "ˋ" + "x" * 8 + "…"
    assert value(spark, text.mermaid_label(F.lit('a["b"](c)|d'))) == "abcd"
    assert value(spark, text.trace_slug(F.lit("acme/svc"), F.lit("/v1/{id}"))) == "acme-svc-v1--id-"


@pytest.mark.parametrize(
    ("receiver", "hit"),
    [("jdbcTemplate", True), ("this.userDao", True), ("readOnlyJdbcTemplate", True), ("restTemplate", False), ("itemClient", False), (None, False), ("em", True), ("a.session", True)],
)
def test_database_receiver(spark, receiver, hit):
    from tracelake.extractors.declarations import database_receiver

    assert value(spark, fields.is_database_receiver(F.lit(receiver).cast("string"))) is hit
    assert database_receiver(receiver) is hit


def test_sql_execution(spark):
    def verdict(symbol, hint=None, receiver=None, evidence=None):
        r = F.lit(receiver).cast("string")
        return value(spark, fields.sql_execution(F.lit(symbol), F.lit(hint).cast("boolean"), r, fields.is_database_receiver(r), F.lit(evidence).cast("boolean")))

    assert verdict("execute", receiver="httpClient", evidence=True) is None
    assert verdict("execute", receiver="runner", evidence=True) is True
    assert verdict("save", receiver="userDao") is False
    assert verdict("other", hint=True) is True
    assert verdict("execute") is None


@pytest.mark.parametrize(
    ("vendor", "url", "bucket", "want"),
    [
        ("jdbc", "jdbc:postgresql://DB:5432/app?x", None, "jdbc:postgresql://db:5432/app"),
        ("jdbc", "odd", None, "jdbc:unknown:odd"),
        ("mongodb", "mongodb+srv://U@H/x", None, "mongodb://u@h"),
        ("redis", "rediss://R:1", None, "redis://r:1"),
        ("s3", None, "b", "s3://b"),
        ("s3", None, "", None),
        ("other", "x", None, None),
    ],
)
def test_store_key(spark, vendor, url, bucket, want):
    assert value(spark, fields.store_key(F.lit(vendor), F.lit(url).cast("string"), F.lit(bucket).cast("string"))) == want


def test_receiver_field(spark):
    cases = [("this.dao", None, "dao"), ("s.repo", "s", "repo"), ("a.b.c", None, None), (None, None, None), ("self.x", "", "x")]
    for receiver, name, want in cases:
        assert value(spark, fields.receiver_field(F.lit(receiver).cast("string"), F.lit(name).cast("string"))) == want


def test_skip_reason(spark):
    r = lambda t, **k: value(spark, text.skip_reason(F.lit(t), **k))
    assert r("ok") is None and r("") is None
    assert r("a\x00b").startswith("binary content")
    assert r("��ab").startswith("binary or")
    assert r("x" * 20, longest=10).startswith("oversized")
    assert r("my SECRET word", indicators=["secret"]).startswith("matched")
