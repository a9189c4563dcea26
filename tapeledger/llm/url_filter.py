"""URL filter: allow and block rules on hosts and paths, carried over redirects and canonical links.

Pages are joined by redirect and canonical-link edges; the connected components of these edges are sets of
aliases. A block that a rule puts on one alias reaches the others; an explicit allow rule on a URL comes
before any block that reaches it. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeledger.llm.batches import spare_names
from tapeledger.llm.components import connected_components
from tapeledger.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: rule of the registered query: (host, path, action)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty for null or where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """One name for a URL whatever its scheme and fragment; null where it has no ``://``."""
    path, rest = path_of(url), F.regexp_extract(_after(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), rest))


def _attribute(tag: Column, pattern: str) -> Column:
    parts = [F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]
    return F.replace(F.trim(F.concat(*parts)), F.lit("&amp;"), F.lit("&"))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(u, v)`` URL keys: a page and the target of its canonical link or of its meta refresh.

    Comments and scripts are left out. Relative targets are resolved against the page; targets of other
    schemes (``mailto:``) and bare fragments give no edge. Null or empty HTML gives none.
    """
    html, url = F.col(html_col), F.col(url_col)
    marked = pages.filter(html.rlike(r"(?i)canonical|refresh") & key_of(url).isNotNull())
    clean = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    link = F.regexp_extract(clean, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b[^>]*>""", 0)
    meta = F.regexp_extract(clean, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>""", 0)
    href = _attribute(link, r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
    jump = _attribute(meta, r"""(?is)\burl\s*=\s*(?:'([^'">]*)'|"([^"'>]*)"|([^"'>]+))""")
    host, path = host_of(url), path_of(url)
    directory = F.regexp_extract(F.when(path == "", F.lit("/")).otherwise(path), r"(?s)^(.*/)", 1)
    targets = marked.select(url.alias("from"), host.alias("h"), path.alias("p"), directory.alias("d"), F.explode(F.array(href, jump)).alias("t"))
    t, root = F.col("t"), F.concat(F.lit("http://"), F.col("h"))
    full = (
        F.when((t == "") | t.startswith("#"), F.lit(None).cast("string"))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.startswith("//"), F.concat(F.lit("http:"), t))
        .when(t.startswith("/"), F.concat(root, t))
        .when(t.startswith("?"), F.concat(root, F.col("p"), t))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(root, F.col("d"), t)))
    return targets.select(key_of(F.col("from")).alias("u"), key_of(full).alias("v")).filter("u <> v").distinct()


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule that decides each distinct ``(host, path)`` of ``urls``: ``(host, path, rule, action)``, matches only.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule wins, then the
    longer host, then ``allow``. Every host suffix with as many labels as some rule, with every path prefix as
    long as some rule of that host, is looked up by equality: a long rule list is never compared row by row.
    """
    rules = rules.filter("host is not null and path is not null and action in ('allow', 'block')").select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action").distinct()
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("n")).first()["n"] or 1
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    tried = urls.select("host", "path").filter("host <> ''").distinct().withColumn("rule_host", F.explode(suffixes)).join(lengths, "rule_host")
    tried = tried.withColumn("n", F.explode("lengths")).filter("n <= length(path)").withColumn("rule_path", F.expr("substring(path, 1, n)"))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.when(F.col("action") == "allow", 1).otherwise(0))
    return tried.join(rules, ["rule_host", "rule_path"]).groupBy("host", "path").agg(
        F.max_by(F.concat("rule_host", "rule_path"), rank).alias("rule"), F.max_by("action", rank).alias("action"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced).

    ``rules(host, path, action)``; ``redirects(from_url, to_url)`` adds observed redirects to the links found in
    the pages. The verdict is the rule's where one fits; else ``block`` if an alias is blocked by its rule; else
    ``allow``. Pages stay as they are, repeated ones included; a null URL or one without ``://`` has empty host
    and path, no rule and verdict ``allow``. Empty pages give no rows; without rules everything is allowed.
    """
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(key_of(F.col("from_url")).alias("u"), key_of(F.col("to_url")).alias("v")))
    edges = cut_lineage(edges.filter("u <> v").distinct(), "url_edges")
    pages = pages.drop("host", "path", "rule", "verdict")
    action, key, is_reached = spare_names(pages, "action", "key", "reached")
    pages = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if edges.isEmpty():
        found = match_rules(pages, rules).withColumnRenamed("action", action)
        return pages.join(found, ["host", "path"], "left").withColumn("verdict", F.coalesce(action, F.lit("allow"))).drop(action)
    names = connected_components(edges, "url_components")
    url = F.concat(F.lit("x://"), F.col("node"))
    nodes = cut_lineage(names.withColumns({"host": host_of(url), "path": path_of(url)}), "url_nodes")
    found = match_rules(pages.select("host", "path").unionByName(nodes.select("host", "path")), rules)
    blocked = nodes.join(found.filter("action = 'block'"), ["host", "path"]).select("component").distinct()
    reached = nodes.join(blocked, "component", "left_semi").select(F.col("node").alias(key), F.lit("block").alias(is_reached))
    out = pages.withColumn(key, key_of(F.col(url_col))).join(found.withColumnRenamed("action", action), ["host", "path"], "left").join(reached, key, "left")
    return out.withColumn("verdict", F.coalesce(action, is_reached, F.lit("allow"))).drop(action, key, is_reached)
