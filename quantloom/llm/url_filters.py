"""URL filters: explicit host and path rules, and redirect equivalence that carries blocks over to aliases.

Pages are nodes by their URL; declared canonical links and refresh redirects (outside of comments, character references
read, relative ones resolved against their page) are edges. Connected components are found by distributed hooking and
contraction. With `variants` (the default), variants of a URL are one node, for these reasons: a fragment is never sent to
the server; sites answer on http and https alike or redirect one to the other; servers redirect a folder without its
closing slash and serve its index page there; tracking parameters are read by scripts and analyses only. Without it, a URL
is its own node but for scheme and fragment. A page under an explicit rule keeps the rule's verdict, so an allow
always wins for itself; a page without one is blocked if its component holds a blocked URL and no allowed one.

Only DataFrame functions are used. Cases: a null URL or one without "://" has empty host and path, no rule and no
aliases, and is allowed; repeated rows get the same verdict; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .spark_tools import components, stage, table

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""
COMMENT = r"(?s)<!--.*?(-->|$)"
#: Character references that stand in URLs; the ampersand's comes last.
REFERENCES = [("(?i)&quot;|&#34;|&#x22;", '"'), ("(?i)&apos;|&#39;|&#x27;", "'"), ("(?i)&sol;|&#47;|&#x2f;", "/"), ("(?i)&quest;|&#63;|&#x3f;", "?"), ("(?i)&equals;|&#61;|&#x3d;", "="), ("(?i)&colon;|&#58;|&#x3a;", ":"), ("(?i)&amp;|&#38;|&#x26;", "&")]
TRACKING = r"(^|&)(utm_[a-z]+|ref|gclid|fbclid|sessionid)=[^&]*"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_index(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The index of the longest rule (host and path together; the first of equals) that fits, else null.

    The rules are a parameter, so their expression does not grow with the data.
    """
    out = F.lit(None).cast("int")
    for i, (_, h, p) in sorted(enumerate(rules), key=lambda x: (len(x[1][1]) + len(x[1][2]), -x[0])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), i).otherwise(out)
    return out


def normalized(url: Column, variants: bool = True) -> Column:
    """The URL without scheme and fragment, or the one that its variants redirect to; null without "://"."""
    if not variants:
        return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)))
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), TRACKING, "")
    query = F.regexp_replace(query, "^&", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?|/)+$", "")
    return F.when(url.contains("://"), F.concat(host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _without_dots(url: Column) -> Column:
    """An absolute URL with the steps . and .. of its path carried out."""
    parts = r"(?s)^([^/?#]*//[^/?#]*)([^?#]*)(.*)$"
    steps = F.filter(F.split(F.regexp_extract(url, parts, 2), "/"), lambda _, i: i > 0)
    open_end = F.concat(steps, F.when(F.try_element_at(steps, F.lit(-1)).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    kept = F.aggregate(
        open_end, F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    return F.when(F.regexp_extract(url, parts, 2).contains("/."), F.concat(F.regexp_extract(url, parts, 1), F.lit("/"), F.array_join(kept, "/"), F.regexp_extract(url, parts, 3))).otherwise(url)


def absolute(link: Column, url: Column) -> Column:
    """A link as an absolute URL, taken against its page."""
    for name, letter in REFERENCES:
        link = F.regexp_replace(link, name, letter)
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    root = F.concat(scheme, F.lit("//"), host_of(url))
    folder = F.concat(root, F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1))
    full = (
        F.when(F.coalesce(link, F.lit("")) == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path_of(url), link))
        .when(link.startswith("#"), url)
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/"))), link))
    )
    return _without_dots(full)


def judge_pages(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", variants: bool = True) -> DataFrame:
    """(id, host, path, rule, verdict) for each row; rule: host and path of the explicit rule, or null."""
    url, html = F.col(url_col), F.regexp_replace(F.col(html_col), COMMENT, "")

    def ruled(df: DataFrame, at: Column) -> DataFrame:
        return df.withColumn("_host", host_of(at)).withColumn("_path", path_of(at)).withColumn("_rule", rule_index(F.col("_host"), F.col("_path"), rules))

    verdicts = F.array(*[F.lit(r[0]) for r in rules]) if rules else F.array().cast("array<string>")
    names = F.array(*[F.lit(r[1] + r[2]) for r in rules]) if rules else F.array().cast("array<string>")
    pick = lambda array: F.when(F.col("_rule").isNotNull(), F.get(array, F.col("_rule")))
    rows = stage(
        ruled(pages.select(F.col(id_col).alias("_id"), url.alias("_url"), html.alias("_html")), F.col("_url")).select(
            "_id", "_host", "_path", "_rule", normalized(F.col("_url"), variants).alias("_node"),
            F.array_compact(F.array(*[absolute(F.regexp_extract("_html", p, 1), F.col("_url")) for p in (CANONICAL, REFRESH)])).alias("_links"),
        )
    )
    links = rows.where("size(_links) > 0").select("_node", F.explode("_links").alias("_to"))
    targets = stage(ruled(links.withColumn("_tonode", normalized(F.col("_to"), variants)), F.col("_to")).select("_node", "_tonode", "_rule"))
    aliases = components(targets, "_node", "_tonode")
    # what is decided for each URL: a row for each normalized URL
    decided = rows.select("_node", "_rule").union(targets.select("_tonode", "_rule")).where("_node is not null and _rule is not null").withColumn("_v", pick(verdicts))
    decided = decided.groupBy("_node").agg(F.max(F.col("_v") == "block").alias("_block"), F.max(F.col("_v") == "allow").alias("_allow"))
    named = aliases.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    groups = decided.join(named, "_node", "left").withColumn("_component", F.coalesce("_component", "_node"))
    groups = stage(groups.groupBy("_component").agg(F.max("_block").alias("_block"), F.max("_allow").alias("_allow")))
    # only pages without a rule ask their component; a hot URL is split by AQE
    asking = rows.where("_rule is null and _node is not null").join(named, "_node", "left").withColumn("_component", F.coalesce("_component", "_node"))
    asking = asking.join(groups, "_component", "left")
    block = F.coalesce(F.col("_block"), F.lit(False)) & ~F.coalesce(F.col("_allow"), F.lit(False))
    inherited = asking.select("_id", "_host", "_path", F.lit(None).cast("string").alias("rule"), F.when(block, "block").otherwise("allow").alias("verdict"))
    own = rows.where("_rule is not null or _node is null").select("_id", "_host", "_path", pick(names).alias("rule"), F.coalesce(pick(verdicts), F.lit("allow")).alias("verdict"))
    return own.union(inherited).select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", "verdict")


# The rules of the query.
RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"), RULES)
