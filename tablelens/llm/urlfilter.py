"""URL rules and redirect equivalence.

Rules of a host and a path are looked up by host suffix. Pages that redirect to
each other or name a canonical link are aliases: connected components over
these edges carry a block decision to all aliases that no rule allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .components import components


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and its subdomains, and paths that start so."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; null or without ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(F.substring_index(F.substring_index(rest, "#", 1), "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, *_ASCII), F.substr(rest, F.length(host) + 1)


#: Join tasks that the rows of one host are dealt to.
HOST_PARTS = 16


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """``rule``, ``verdict``, ``rule_host``, ``rule_path`` of each rule."""
    return spark.createDataFrame([(r.rule, r.verdict, r.host, r.path) for r in dict.fromkeys(rules)],
                                 "rule string, verdict string, rule_host string, rule_path string")


def with_best_rule(rows: DataFrame, rules: DataFrame, longest: int, spread: str) -> DataFrame:
    """``rows`` (with ``host`` and ``path``) plus ``best``: a struct of the longest
    rule that fits (ties: allow first, then the smaller text), else null.

    Each distinct host looks its suffixes up in the rules, grouped by host; a
    host so found carries its rules, longest first, and is joined back to the
    rows, whose paths choose. The plan does not grow with the rules, and only
    hosts with a rule are on the smaller side. ``longest``: characters of the
    longest rule host; longer suffixes of a host are not looked up. Rows of a host
    are dealt by the column ``spread``, so one with a third of all rows is no hot task."""
    order = F.struct(F.negative(F.length("rule")).alias("order"), "verdict", "rule", F.col("rule_path").alias("path"))
    by_host = rules.groupBy("rule_host").agg(F.collect_list(order).alias("fit"))
    tail = F.right("host", F.lit(longest + 1))  # a longer one that is left is no rule's host
    dots = F.length(tail) - F.length(F.replace(tail, F.lit("."), F.lit("")))
    suffixes = F.expr("transform(sequence(1, dots + 1), i -> substring_index(tail, '.', -i))")
    found = (rows.select("host").distinct().select("host", tail.alias("tail"), dots.alias("dots"))
             .select("host", F.explode(suffixes).alias("rule_host"))
             .join(by_host, "rule_host").groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("fit"))).alias("fit")))
    found = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(spread), F.lit(HOST_PARTS)).cast("int"))
    first = F.get(F.filter("fit", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    best = F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict"))
    return rows.join(found, ["host", "part"], "left").withColumn("best", best).drop("fit", "part")


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_SPACE = r"^\s+|\s+$"


def _let(value: Column, body) -> Column:
    """``body(value)``, where the value's expression stands only once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without_dots(path: Column) -> Column:
    """A path that begins with ``/``, its segments ``.`` and ``..`` resolved."""
    def fold(parts: Column) -> Column:
        kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), lambda done, s: F.when(s == ".", done)
                           .when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
        ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, ends), "/"))

    return F.when(path.rlike(r"/\.\.?(/|$)"), _let(F.split(path, "/"), fold)).otherwise(path)


def address(url: Column) -> Column:
    """The url that equal addresses share: scheme and host in lower case, no
    fragment, an empty path as ``/``, no dot segments; null without ``scheme://``."""
    def parts(whole: Column) -> Column:
        start = F.regexp_extract(whole, _SCHEME + "//[^/?]*", 0)
        return _let(start, lambda start: F.when(start != "", F.concat(F.translate(start, *_ASCII), _let(F.substr(whole, F.length(start) + 1), rest))))

    def rest(rest: Column) -> Column:
        return _let(F.substring_index(rest, "?", 1), lambda path: F.concat(
            F.when(path == "", "/").otherwise(_without_dots(path)), F.substr(rest, F.length(path) + 1)))

    return _let(F.substring_index(F.regexp_replace(url, _SPACE, ""), "#", 1), parts)


def resolved(base: Column, target: Column) -> Column:
    """``target`` as an address, where it is relative from the url ``base``."""
    def whole(base: Column, target: Column) -> Column:
        origin = F.regexp_extract(base, "^[^/]*//[^/]*", 0)
        return (F.when(target.rlike(_SCHEME + "//"), target).when(target.rlike(_SCHEME), F.lit(None))
                .when(target.startswith("//"), F.concat(F.substring_index(base, "//", 1), target))
                .when(target.startswith("/"), F.concat(origin, target))
                .when(target.startswith("?"), F.concat(F.substring_index(base, "?", 1), target))
                .when(target.startswith("#"), base)
                .otherwise(F.concat(F.regexp_extract(base, "(?s)^[^?]*/", 0), target)))

    return address(_let(address(base), lambda b: _let(target, lambda t: whole(b, t))))


_LINK, _META, _BASE = (rf"(?is)<{tag}\b[^>]*>" for tag in ("link", "meta", "base"))
_WAIT = r"(?is)^\s*(?:[\d.]+(?:\s*[;,]|\s)\s*(?:url\s*=\s*)?|url\s*=\s*)(?:\"([^\"]*)|'([^']*)|(.*))"


def _groups(text: Column, pattern: str) -> Column:
    return F.concat(*[F.regexp_extract(text, pattern, i) for i in (1, 2, 3)])


def _value(tag: Column, name: str) -> Column:
    """Value of the attribute, empty where the tag has none."""
    value = _groups(tag, rf"(?is)(?<![\w-]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
    return F.replace(F.regexp_replace(value, _SPACE, ""), F.lit("&amp;"), F.lit("&"))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a``, ``b``: addresses of a page and of what its canonical links and
    refresh redirects name. Relative targets are taken from the page's url, or
    from the base its html names."""
    html = F.col(html_col)
    # most pages have neither; a plain search spares them the patterns
    some = pages.select(F.col(url_col).alias("url"), html.alias("html")).where(
        F.col("url").isNotNull() & (html.rlike("(?i)canonical") | html.rlike("(?i)http-equiv")))
    links = F.filter(F.regexp_extract_all("html", F.lit(_LINK), 0), lambda t: F.array_contains(F.split(F.lower(_value(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(F.regexp_extract_all("html", F.lit(_META), 0), lambda t: F.lower(_value(t, "http-equiv")) == "refresh")
    targets = F.concat(F.transform(links, lambda t: _value(t, "href")),
                       F.transform(metas, lambda t: F.regexp_replace(_groups(_value(t, "content"), _WAIT), _SPACE, "")))
    base = _value(F.regexp_extract("html", _BASE, 0), "href")
    base = F.when(base != "", resolved(F.col("url"), base))
    rows = some.select("url", F.coalesce(base, "url").alias("base"), F.explode(targets).alias("target")).where("target != ''")
    return rows.select(address(F.col("url")).alias("a"), resolved(F.col("base"), F.col("target")).alias("b")).dropna()


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          redirects: DataFrame | None = None) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``
    (allow or block) and ``blocked_alias`` (whether an alias is blocked by a
    rule) for every page. A rule's own verdict stands, so an explicit allow
    outweighs blocked aliases; a page without a rule is blocked if an alias is,
    else allowed. ``redirects``: more edges (``a``, ``b``: urls). Null urls have
    empty host and path and no aliases. Repeated rows get equal verdicts; no
    page or no edge leaves the rules alone."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), address(F.col(url_col)).alias("node"))
    known, longest = rule_table(pages.sparkSession, rules), max((len(r.host) for r in rules), default=0)
    rows = with_best_rule(rows, known, longest, "id")
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")).dropna())
    edges = cut(edges.distinct())
    roots = components(edges)
    h, p = split_url(F.col("node"))
    ruled = with_best_rule(roots.select("root", "node", h.alias("host"), p.alias("path")), known, longest, "node")
    blocked = ruled.where(F.col("best.verdict") == "block").select("root").distinct()
    aliases = roots.join(blocked, "root", "left_semi").select("node", F.lit(True).alias("blocked_alias"))
    return (rows.join(aliases, "node", "left")
            .select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("blocked_alias", F.lit(False)).alias("blocked_alias"),
                    F.coalesce("best.verdict", F.when(F.col("blocked_alias"), "block").otherwise("allow")).alias("verdict")))
