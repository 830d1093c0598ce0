"""Column -> Column helpers for strings, paths, URLs and times.

All are built-in Spark expressions (JVM side, no Python UDF). Where the reference works on bytes
(Go strings) the byte-level function is used (``octet_length``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import API_TIME_FORMATS, Options
from .re2 import to_java

_BIG = 1 << 30


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for each row, however often the body names it; an expression is else put
    in place of each mention, and nested ones multiply."""
    return F.transform(F.array(value), body)[0]


def nz(c) -> Column:
    """Go string view of a nullable column: NULL reads as ''."""
    return F.coalesce(col(c), F.lit(""))


def blank(c) -> Column:
    return nz(c) == ""


def nullif_blank(c) -> Column:
    c = col(c)
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def alternation(patterns) -> str | None:
    """One regex that matches when any of the (individually anchored) patterns matches."""
    ps = list(patterns)
    if not ps:
        return None
    return "|".join(f"(?:{p})" for p in ps)


def rlike_any(c: Column, patterns) -> Column:
    """Whether a pattern matches: as RE2 reads it, or as Java does where RE2 would not compile it (allow_lookaround)."""
    alt = alternation(to_java(p) or p for p in patterns)
    return F.lit(False) if alt is None else c.rlike(alt)


def trim_one_suffix(c: Column, suffix: str = "/") -> Column:
    """strings.TrimSuffix: remove one trailing occurrence."""
    return F.when(c.endswith(suffix), c.substr(F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def trim_one_prefix(c: Column, prefix: str = "/") -> Column:
    return F.when(c.startswith(prefix), c.substr(F.lit(len(prefix) + 1), F.lit(_BIG))).otherwise(c)


def _last_colon(c: Column) -> Column:
    """0-based index of the last ':' or -1."""
    return F.length(c) - F.length(F.substring_index(c, ":", -1)) - 1


def strip_port(c, keep_leading: bool = True) -> Column:
    """Cut at the last ':'; keep_leading=True cuts only at index > 0, False also at index 0 (':80' -> '')."""
    c = nz(c)
    i = _last_colon(c)
    cond = (i > 0) if keep_leading else (i >= 0)
    return F.when(cond, c.substr(F.lit(1), i)).otherwise(c)


def domain_key(c) -> Column:
    """Noise-filter view of a domain: lower-cased, port removed."""
    return strip_port(F.lower(nz(c)), keep_leading=True)


def is_dns_name(c) -> Column:
    c = nz(c)
    return (~c.isin("", "localhost", "0.0.0.0")) & c.contains(".") & c.rlike("[A-Za-z]")


def is_dns_name_loose(c) -> Column:
    c = nz(c)
    return c.contains(".") & c.rlike("[A-Za-z]")


def is_loopback(c) -> Column:
    return nz(c).isin("", "127.0.0.1", "0.0.0.0", "::1")


ENRICHABLE_RE = r"^[A-Za-z0-9/_.~:?=&%+@#,; \[\]-]*\z"


def is_enrichable(c) -> Column:
    """Sample URL made only of the allow-listed ASCII characters."""
    return nz(c).rlike(ENRICHABLE_RE)


def normalize_path(c, opts: Options) -> Column:
    """Per-segment path normalization (B8): dynamic segments become {id}."""
    p = nz(c)
    excl = opts.usable_patterns(opts.exclude_patterns)
    ids = opts.usable_patterns(opts.builtin_patterns) + opts.usable_patterns(opts.user_patterns)
    segs = F.split(trim_one_prefix(p), "/", -1)

    def seg_rule(s: Column) -> Column:
        replace = (F.when(s == "", F.lit(False))
                   .when(F.octet_length(s) > 255, F.lit(True))
                   .when(rlike_any(s, excl), F.lit(False))
                   .otherwise(rlike_any(s, ids)))
        return F.struct(F.when(replace, F.lit("{id}")).otherwise(s).alias("v"), replace.alias("r"))

    def joined(ruled: Column) -> Column:
        path = F.concat(F.lit("/"), F.array_join(F.transform(ruled, lambda x: x["v"]), "/"))
        return F.when(F.exists(ruled, lambda x: x["r"]), path).otherwise(p)
    return F.when(p.isin("", "/"), p).otherwise(once(F.transform(segs, seg_rule), joined))


def normalize_target(c) -> Column:
    """Registered operation target: a segment of more than two chars wrapped in braces -> {id}."""
    t = nz(c)
    segs = F.split(trim_one_prefix(t), "/", -1)
    is_param = lambda s: (F.length(s) > 2) & s.startswith("{") & s.endswith("}")
    changed = F.exists(segs, is_param)
    joined = F.concat(F.lit("/"), F.array_join(
        F.transform(segs, lambda s: F.when(is_param(s), F.lit("{id}")).otherwise(s)), "/"))
    return F.when(t.contains("{") & changed, joined).otherwise(t)


def normalize_context(c) -> Column:
    """Blank or '/' -> blank; leading '/' added; one trailing '/' trimmed."""
    x = nz(c)
    with_slash = F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))
    return F.when(x.isin("", "/"), F.lit("")).otherwise(trim_one_suffix(with_slash))


def match_path(basepath, context, target, pass_through: bool) -> Column:
    """Basepath + optional context + target; leading '/', one trailing '/' trimmed, then '//' collapsed."""
    base = nz(basepath)
    parts = [F.when(base != "", trim_one_suffix(base)).otherwise(F.lit(""))]
    if pass_through:
        ctx = normalize_context(context)
        parts.append(F.when(ctx != "", trim_one_suffix(ctx)).otherwise(F.lit("")))
    parts.append(nz(target))
    def cleaned(r: Column) -> Column:
        r = F.when(r.startswith("/"), r).otherwise(F.concat(F.lit("/"), r))
        r = F.when(F.length(r) > 1, trim_one_suffix(r)).otherwise(r)
        return F.regexp_replace(r, "/{2,}", "/")
    return once(F.concat(*parts), cleaned)


def endpoint_of(c) -> Column:
    """Endpoint config JSON -> struct(endpoint_type, endpoint_url); invalid JSON -> blanks."""
    return once(nz(c), _endpoint_config)


def _endpoint_config(raw: Column) -> Column:
    valid = F.ltrim(raw).startswith("{") & F.get_json_object(raw, "$").isNotNull()
    etype = F.coalesce(nullif_blank(F.get_json_object(raw, "$.endpoint_type")), F.lit("http"))
    url = F.coalesce(nullif_blank(F.get_json_object(raw, "$.production_endpoints.url")),
                     F.get_json_object(raw, "$.production_endpoints[0].url"), F.lit(""))
    return F.struct(F.when(valid, etype).otherwise(F.lit("")).alias("endpoint_type"),
                    F.when(valid, url).otherwise(F.lit("")).alias("endpoint_url"))


_URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)"


def parse_endpoint(c) -> Column:
    """URL -> struct(host, port, path). Host without brackets and port; port explicit, else 443
    for https, else 80; path percent-decoded with one trailing '/' removed; invalid -> ('', 0, '')."""
    return once(nz(c), _endpoint_parts)


def _endpoint_parts(u: Column) -> Column:
    none = F.struct(F.lit("").alias("host"), F.lit(0).alias("port"), F.lit("").alias("path"))
    parts = F.struct(F.lower(F.regexp_extract(u, _URL_RE, 1)).alias("scheme"),
                     (F.regexp_extract(u, _URL_RE, 2) != "").alias("has_auth"),
                     F.regexp_replace(F.regexp_extract(u, _URL_RE, 3), r"^.*@", "").alias("hostport"),
                     F.regexp_extract(u, _URL_RE, 4).alias("path"))

    def read(p: Column) -> Column:
        bracket = p["hostport"].startswith("[")
        port_txt = F.when(bracket, F.regexp_extract(p["hostport"], r"^\[[^\]]*\](?::([0-9]*))?\z", 1)).otherwise(
            F.regexp_extract(p["hostport"], r":([^:]*)\z", 1))
        decoded = F.try_url_decode(F.replace(p["path"], F.lit("+"), F.lit("%2B")))
        return once(F.struct(port_txt.alias("port"), decoded.alias("path")), lambda q: checked(p, q))

    def checked(p: Column, q: Column) -> Column:
        ok = q["port"].rlike(r"^[0-9]*\z") & q["path"].isNotNull() & ~u.rlike(r"[\x00-\x1f\x7f]")
        host = F.when(p["hostport"].startswith("["), F.regexp_extract(p["hostport"], r"^\[([^\]]*)\]", 1)).otherwise(
            F.regexp_replace(p["hostport"], r":[^:]*\z", ""))
        port = F.when(q["port"] != "", q["port"].cast("int")).when(p["scheme"] == "https", F.lit(443)).otherwise(F.lit(80))
        # opaque form (scheme:rest without //): no host and no path
        opaque = (p["scheme"] != "") & ~p["has_auth"] & ~p["path"].startswith("/") & (p["path"] != "")
        path = F.when(opaque, F.lit("")).otherwise(trim_one_suffix(q["path"]))
        return F.when(~ok, none).otherwise(F.struct(F.when(p["has_auth"], host).otherwise(F.lit("")).alias("host"),
                                                    port.alias("port"), path.alias("path")))
    return F.when(u == "", none).otherwise(once(parts, read))


def api_time_shape(pattern: str) -> str:
    """Regex that every text read by a datetime pattern of ``API_TIME_FORMATS`` matches: its dot, if there is one, and end."""
    ends = {"XXX": r"(?:[Zz]|[+-][0-9]{2}:[0-9]{2})", "'Z'": "[Zz]", "Z": "[+-][0-9]{4}"}
    end = next((e for mark, e in ends.items() if pattern.endswith(mark)), "[0-9]")
    body = ".*" if "[." in pattern else r"[^.]*[.][^.]*" if "." in pattern else "[^.]*"
    return rf"(?s)\A{body}{end}\z"


def parse_api_time(c) -> Column:
    """First of the accepted formats that parses, as a UTC wall-clock timestamp_ntz. A text is tried only with formats
    whose shape it has, as each failing try costs an exception."""
    x = nz(c)
    return F.coalesce(*[F.when(x.rlike(api_time_shape(f)), F.try_to_timestamp(x, F.lit(f))) for f in API_TIME_FORMATS]) \
        .cast("timestamp_ntz")


def oas_path(c) -> Column:
    """outer slashes trimmed; n-th {id} -> {id}, {id2}, {id3}...; struct(path, params)."""
    t = F.regexp_replace(nz(c), r"^/+|/+\z", "")
    segs = F.split(t, "/", -1)

    def nth(i):
        return F.size(F.filter(F.slice(segs, F.lit(1), i + 1), lambda x: x == "{id}"))

    names = F.transform(segs, lambda s, i: F.when(s == "{id}", F.when(nth(i) == 1, F.lit("id"))
                                                  .otherwise(F.concat(F.lit("id"), nth(i).cast("string")))))
    path_segs = F.transform(names, lambda n, i: F.coalesce(F.concat(F.lit("{"), n, F.lit("}")), segs[i]))
    return F.struct(F.concat(F.lit("/"), F.array_join(path_segs, "/")).alias("path"),
                    F.filter(names, lambda n: n.isNotNull()).alias("params"))


def operation_id(method, path) -> Column:
    """lower(method)-path, '/' -> '-', braces dropped, outer '-' trimmed, '--' collapsed."""
    x = F.concat(F.lower(nz(method)), F.lit("-"), nz(path))
    x = F.translate(x, "/{}", "-")
    x = F.regexp_replace(x, r"^-+|-+\z", "")
    return F.regexp_replace(x, "-{2,}", "-")


def owner_of(c, tag: str) -> Column:
    """Ownership marker ``[<tag>:<owner>]`` at the very start; blank when absent."""
    return F.regexp_extract(nz(c), r"^\[\Q" + tag + r"\E:(.+?)\]", 1)


def title_of(service_key) -> Column:
    """F1 fallback title: service key with '/' and ':' -> '-'."""
    return F.translate(nz(service_key), "/:", "--")
