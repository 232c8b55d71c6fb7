"""URL block and allow rules, spread over redirect and canonical-link aliases.

A url takes the action of its longest fitting rule.  A url that no rule fits is
blocked when its component, over redirect and canonical-link edges, holds a url
that a rule blocks; an explicit allow rule always precedes such a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, emitted, looked_up, pin, read
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts with rules, rules, or blocked aliases (about 100 bytes each) that are sent to every task; more are joined by salted shuffles.
BROADCAST_ROWS = 100_000
TAGS = r"(?i)<(?:link|meta)\b[^<>]*"
VALUE = r"\s*=\s*[\"']?\s*"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def normal_path(path: Column) -> Column:
    """Without ``.`` and ``..`` segments, as RFC 3986 removes them; in time linear in the path."""
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/")

    def step(up: Column, segment: Column) -> tuple[Column, Column]:
        # from the end: each .. takes away the next segment before it
        kept = F.when((segment != ".") & (segment != "..") & (up == 0), F.array(segment)).otherwise(F.array().cast("array<string>"))
        return F.when(segment == "..", up + 1).when((segment != ".") & (up > 0), up - 1).otherwise(up), kept

    kept = F.reverse(emitted(F.reverse(segments), F.lit(0), step, "string"))
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def url_key(url: Column) -> Column:
    """What stands for a url in the alias graph: host, path without dot segments, and query; no scheme, no fragment."""
    return F.concat(host(url), normal_path(path(url)), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1))


def _absolute(base: Column, target: Column) -> Column:
    """A link's target as a url, by RFC 3986; null for other schemes than ``://`` ones and for links within the page."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), "(?s)^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#") | (target == ""), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path(base), target))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``src, dst`` url keys of all canonical links and refresh redirects in ``url, html``.

    Targets are resolved against the page's url.  Other schemes (``mailto:``), links
    to the page itself and urls without ``://`` give no edge.  A ``base`` element is
    not looked at.
    """
    tags = F.regexp_extract_all("html", F.lit(TAGS), 0)

    def target(tag: Column) -> Column:
        canonical = tag.rlike(rf"(?is)^<link\b.*\brel{VALUE}canonical\b")
        refresh = tag.rlike(rf"(?is)^<meta\b.*\bhttp-equiv{VALUE}refresh\b")
        href = F.regexp_extract(tag, rf"(?i)\bhref{VALUE}([^\"'\s<>]+)", 1)
        url = F.regexp_extract(tag, rf"(?i)\burl{VALUE}([^\"'\s<>]+)", 1)
        return F.when(canonical, href).when(refresh, url)

    found = pages.filter(F.col("html").rlike("(?i)canonical|refresh") & F.col("url").contains("://"))
    found = found.select("url", F.explode(F.transform(tags, target)).alias("target")).filter("target <> ''")
    found = found.select(url_key(F.col("url")).alias("src"), url_key(_absolute(F.col("url"), F.replace("target", F.lit("&amp;"), F.lit("&")))).alias("dst"))
    return found.filter("src <> '' and dst <> '' and src <> dst").distinct()


def _suffixes(name: Column, most: int) -> Column:
    """The last 1 .. ``most`` labels of a name."""
    parts = F.slice(F.reverse(F.split(name, r"\.")), 1, most)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.reverse(F.slice(parts, F.lit(1), i)), "."))


def ruled(urls: DataFrame, rules: DataFrame, spread: str) -> DataFrame:
    """Adds ``rule, action`` of the longest fitting rule to rows with ``host, path``.

    Rules are looked up once for each distinct host, by as many of its last labels as
    the longest rule has.  Rows get them by a join that deals the rows of a hot host
    by ``spread``.
    """
    rules = rules.select("action", F.translate("host", UPPER, LOWER).alias("at"), F.col("path").alias("prefix"))
    labels = rules.agg(F.coalesce(F.max(F.size(F.split("at", r"\."))), F.lit(1)).alias("n")).first()["n"]
    rule = F.struct((F.length("at") + F.length("prefix")).alias("size"), "prefix", F.concat("at", "prefix").alias("rule"), "action")
    places = pin(rules.groupBy("at").agg(F.collect_set(rule).alias("found")))
    hosts = urls.select("host").distinct().select("host", F.explode(_suffixes(F.col("host"), labels)).alias("at"))
    fits = looked_up(hosts, places, ["at"], ["host"], BROADCAST_ROWS).filter("found is not null")
    fits = pin(fits.groupBy("host").agg(F.flatten(F.collect_list("found")).alias("fits")))
    # of equally long rules for the same place, allow comes first
    longest = F.array_sort(F.filter("fits", lambda r: F.startswith(F.col("path"), r["prefix"])), lambda x, y: F.when(x["size"] != y["size"], y["size"] - x["size"]).when(x["action"] < y["action"], -1).when(x["action"] > y["action"], 1).otherwise(0))
    found = looked_up(urls, fits, ["host"], [spread], BROADCAST_ROWS).withColumn("best", F.get(longest, F.lit(0)))
    return found.withColumns({"rule": F.col("best.rule"), "action": F.col("best.action")}).drop("best", "fits")


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, via`` for each row of ``page_id, url``.

    ``rules`` has ``action`` (block or allow), ``host`` and ``path``; ``links`` has
    url keys ``src, dst``.  ``via`` is rule, alias or default.  A url that is null or
    has no ``://`` has empty host and path, fits no rule and has no alias.  Repeated
    rows are judged alike.  Empty tables of any kind are allowed.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    rules = scratch.table(rules.select("action", "host", "path").distinct())
    rows = pages.select("page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "key": url_key(F.col("url"))})
    rows = ruled(rows, rules, "page_id")
    edges = scratch.table(links.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    groups = connected_components(edges, scratch)
    at = F.concat(F.lit("x://"), "id")
    nodes = ruled(groups.withColumns({"host": host(at), "path": path(at)}), rules, "id")
    blocked = pin(nodes.filter("action = 'block'").select("component", F.lit(True).alias("alias")).distinct())
    aliases = pin(looked_up(groups, blocked, ["component"], ["id"], BROADCAST_ROWS).filter("alias").select(F.col("id").alias("key"), "alias"))
    out = looked_up(rows, aliases, ["key"], ["page_id"], BROADCAST_ROWS)
    verdict = F.coalesce("action", F.when(F.col("alias"), "block").otherwise("allow"))
    via = F.when(F.col("action").isNotNull(), "rule").when(F.col("alias"), "alias").otherwise("default")
    out = scratch.table(out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), via.alias("via")))
    out = pin(out)
    scratch.close()
    return out


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return judge_urls(pages, rules, page_links(pages))


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS query
  FROM pages
), g AS (
  SELECT host, path, query, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^<>]*')) AS tag FROM p WHERE url LIKE '%://%'
), t AS (
  SELECT host, path, query, replace(CASE
    WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?\s*([^"''\s<>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?\s*([^"''\s<>]+)', 1) END, '&amp;', '&') AS target
  FROM g
), a AS (
  SELECT host, path, query, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$') THEN NULL
    WHEN starts_with(target, '//') THEN 'x:' || target
    WHEN starts_with(target, '/') THEN 'x://' || host || target
    WHEN starts_with(target, '?') THEN 'x://' || host || path || target
    WHEN path LIKE '%/%' THEN 'x://' || host || regexp_extract(path, '(?s)^.*/') || target
    ELSE 'x://' || host || '/' || target END AS dst
  FROM t
), ends AS (
  SELECT host, path, query, translate(regexp_extract(dst, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS to_host,
    regexp_extract(dst, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS to_path, regexp_extract(dst, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS to_query
  FROM a WHERE dst IS NOT NULL
), n(raw, now) AS (
  SELECT path, path FROM (SELECT path FROM p UNION SELECT to_path FROM ends)
  UNION
  SELECT raw, CASE WHEN regexp_matches(now, '/\.(/|$)') THEN regexp_replace(now, '/\.(/|$)', '/')
    WHEN regexp_matches(now, '^/\.\.(/|$)') THEN regexp_replace(now, '^/\.\.(/|$)', '/')
    ELSE regexp_replace(now, '/[^/]*/\.\.(/|$)', '/') END FROM n
), plain AS (
  SELECT raw, now FROM n WHERE NOT regexp_matches(now, '/\.\.?(/|$)')
), d AS (
  SELECT host || x.now || query AS src, to_host || y.now || to_query AS dst FROM ends JOIN plain x ON x.raw = path JOIN plain y ON y.raw = to_path
), e AS (
  SELECT src AS u, dst AS v FROM d WHERE src <> '' AND dst <> '' AND src <> dst
  UNION SELECT dst, src FROM d WHERE src <> '' AND dst <> '' AND src <> dst
), reach AS (
  SELECT u AS a, u AS b FROM e UNION SELECT reach.a, e.v FROM reach JOIN e ON e.u = reach.b
), rules(action, place, prefix) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), urls AS (
  SELECT DISTINCT host, path FROM p
  UNION SELECT regexp_extract(b, '^[^/?#]*'), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) FROM reach
), best AS (
  SELECT host, path, max_by(place || prefix, length(place || prefix)) AS rule, max_by(action, length(place || prefix)) AS action
  FROM urls JOIN rules ON (host = place OR ends_with(host, '.' || place)) AND starts_with(path, prefix) GROUP BY host, path
), aliases AS (
  SELECT DISTINCT a FROM reach JOIN best ON best.host = regexp_extract(b, '^[^/?#]*') AND best.path = regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AND action = 'block'
)
SELECT page_id, p.host, p.path, rule, coalesce(action, CASE WHEN a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN action IS NOT NULL THEN 'rule' WHEN a IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM p JOIN plain ON raw = p.path LEFT JOIN best ON best.host = p.host AND best.path = p.path LEFT JOIN aliases ON a = p.host || now || query
"""
