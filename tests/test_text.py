"""Case tables for the column functions (FIXTURES.md section 4 and the reference's code comments)."""

import pytest
from pyspark.sql import functions as F

from flowlens.config import DEFAULT
from flowlens.functions import text as T


def _eval(spark, fn, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(fn(df)).collect()]


NORMALIZE_CASES = [
    ("", ""), ("/", "/"),
    ("/orders/123", "/orders/{id}"), ("orders/123", "/orders/{id}"),
    ("orders/x", "orders/x"), ("/a//7/", "/a//{id}/"), ("//7", "//{id}"),
    ("/v1/users/9", "/v1/users/{id}"), ("/12.5/x", "/12.5/x"),
    ("/internationalization", "/{id}"), ("/item000008", "/item000008"),
    ("/" + "é" * 128, "/{id}"),
    ("/v2.0/catalog/SKU-00042", "/v2.0/catalog/{id}"), ("/api/items/7", "/api/items/{id}"),
    ("/files/" + "0123456789abcdef" * 2, "/files/{id}"),
]


@pytest.mark.parametrize("inp,exp", NORMALIZE_CASES)
def test_normalize_path(spark, inp, exp):
    assert _eval(spark, lambda d: T.normalize_path(d.p, DEFAULT), [(inp,)], "p string") == [exp]


def test_lookaround_pattern_opt_in(spark):
    opts = DEFAULT.with_(allow_lookaround=True)
    assert _eval(spark, lambda d: T.normalize_path(d.p, opts), [("/carts/item000008",)], "p string") == ["/carts/{id}"]


@pytest.mark.parametrize("inp,exp", [("/orders/{orderId}", "/orders/{id}"), ("{x}", "/{id}"), ("/{}", "/{}"),
                                     ("/a/{x}.json", "/a/{x}.json"), ("", "")])
def test_normalize_target(spark, inp, exp):
    assert _eval(spark, lambda d: T.normalize_target(d.p), [(inp,)], "p string") == [exp]


@pytest.mark.parametrize("base,ctx,tgt,pt,exp", [
    ("", "/c", "/o/{id}", False, "/o/{id}"), ("/base", "ctx/", "/a", True, "/base/ctx/a"),
    ("/base", "", "/", False, "/base"), ("", "", "", False, "/"), ("", "", "/a//", False, "/a/"),
    ("", "", "//a", False, "/a")])
def test_match_path(spark, base, ctx, tgt, pt, exp):
    got = _eval(spark, lambda d: T.match_path(d.b, d.c, d.t, pt), [(base, ctx, tgt)], "b string, c string, t string")
    assert got == [exp]


@pytest.mark.parametrize("url,exp", [
    ("https://h.example.com/base/", ("h.example.com", 443, "/base")),
    ("http://[::1]:8080/a%20b/", ("::1", 8080, "/a b")),
    ("http://under_score:81", ("under_score", 81, "")),
    ("ftp://h/x", ("h", 80, "/x")),
    ("h:80/x", ("", 80, "")),
    ("", ("", 0, "")),
    ("http://svc3.shop.example.com:8080/base/", ("svc3.shop.example.com", 8080, "/base")),
])
def test_parse_endpoint(spark, url, exp):
    got = _eval(spark, lambda d: T.parse_endpoint(d.u), [(url,)], "u string")[0]
    assert (got["host"], got["port"], got["path"]) == exp


@pytest.mark.parametrize("inp,a,b", [("h:80", "h", "h"), (":80", ":80", ""), ("::1", ":", ":"), ("h", "h", "h")])
def test_strip_port(spark, inp, a, b):
    assert _eval(spark, lambda d: T.strip_port(d.p, True), [(inp,)], "p string") == [a]
    assert _eval(spark, lambda d: T.strip_port(d.p, False), [(inp,)], "p string") == [b]


@pytest.mark.parametrize("inp,exp", [("a.b", True), ("10.0.0.1", False), ("localhost", False), ("svc", False)])
def test_is_dns_name(spark, inp, exp):
    assert _eval(spark, lambda d: T.is_dns_name(d.p), [(inp,)], "p string") == [exp]


@pytest.mark.parametrize("inp,path,params", [("/a/{id}/b/{id}", "/a/{id}/b/{id2}", ["id", "id2"]),
                                             ("/a/", "/a", []), ("/", "/", []),
                                             ("/{id}/{id}/{id}", "/{id}/{id2}/{id3}", ["id", "id2", "id3"])])
def test_oas_path(spark, inp, path, params):
    got = _eval(spark, lambda d: T.oas_path(d.p), [(inp,)], "p string")[0]
    assert got["path"] == path and list(got["params"]) == params


@pytest.mark.parametrize("m,p,exp", [("GET", "/orders/{id}", "get-orders-id"), ("GET", "/", "get"),
                                     ("GET", "/a-b", "get-a-b"), ("GET", "/a/b", "get-a-b")])
def test_operation_id(spark, m, p, exp):
    assert _eval(spark, lambda d: T.operation_id(d.m, d.p), [(m, p)], "m string, p string") == [exp]


@pytest.mark.parametrize("inp,exp", [("[OWN:h] x", "h"), (" [OWN:h]", ""), ("[OWN:] [OWN:b]", "] [OWN:b")])
def test_owner_of(spark, inp, exp):
    assert _eval(spark, lambda d: T.owner_of(d.p, "OWN"), [(inp,)], "p string") == [exp]


@pytest.mark.parametrize("inp,exp", [("/files/abc?v=(3)", False), ("/orders/1?x=a&b=%20", True), ("", True)])
def test_is_enrichable(spark, inp, exp):
    assert _eval(spark, lambda d: T.is_enrichable(d.p), [(inp,)], "p string") == [exp]


@pytest.mark.parametrize("inp,exp", [
    ("2024-01-01T10:30:00.000+0530", "2024-01-01 05:00:00"),
    ("2024-01-01T10:30:00.000Z", "2024-01-01 10:30:00"),
    ("2024-01-01T10:30:00+0100", "2024-01-01 09:30:00"),
    ("2024-01-01T10:30:00Z", "2024-01-01 10:30:00"),
    ("2024-01-01T10:30:00+01:00", "2024-01-01 09:30:00"),
    ("2024-01-01 10:30:00", "2024-01-01 10:30:00"),
    ("garbage", None)])
def test_parse_api_time(spark, inp, exp):
    got = _eval(spark, lambda d: T.parse_api_time(d.p).cast("string"), [(inp,)], "p string")[0]
    assert got == exp


@pytest.mark.parametrize("raw,exp", [
    ('{"endpoint_type":"http","production_endpoints":{"url":"http://a:1"}}', ("http", "http://a:1")),
    ('{"production_endpoints":[{"url":"http://b"},{"url":"http://c"}]}', ("http", "http://b")),
    ('{"endpoint_type":"load_balance"}', ("load_balance", "")),
    ("not json", ("", "")), ("", ("", ""))])
def test_endpoint_of(spark, raw, exp):
    got = _eval(spark, lambda d: T.endpoint_of(d.p), [(raw,)], "p string")[0]
    assert (got["endpoint_type"], got["endpoint_url"]) == exp
