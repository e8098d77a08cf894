"""URL filter: fixed host/path rules, and a path-template tree learnt per host.

DataFrame functions only.  A url's path is cut into segments, and the tree grows level by level
for all hosts at once.  At each level a segment stays a branch of its own only if it is frequent
(``SUPPORT`` urls under its parent) and its labelled purity differs from that of its siblings by
``Z`` standard errors; all others, which is variable values such as ids as well as branches that
are statistically alike, merge into the wildcard ``*``.  Segments below ``DEPTH`` merge into one
tail ``**``.  A template (host and branch of the tree) is rejected when its smoothed purity,

    (good + STRENGTH * purity of the host) / (labelled + STRENGTH),

lies under ``THRESHOLD``; the host's purity is smoothed the same way towards that of all urls.

The tables that are joined back to the urls hold only branches that stay, or templates; counts
are partial sums before any shuffle, and the joins are left to adaptive execution, which splits
a host that holds a large share of the urls.

Defined results: host and path of a null url, or one without ``://``, are empty, no rule fits and
the template of the empty host decides; repeated rows are judged one by one, a null page_id stays
null; a label other than 0 and 1 counts as none, a url with several labels counts each; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadlens.session import materialize

from .common import table

#: (verdict, host, path): fixed values of the contract.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

DEPTH = 6
SUPPORT = 20
Z = 4.0
STRENGTH = 10.0
THRESHOLD = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``rule`` and ``rule_verdict`` of the longest rule that fits (host, path); null if none."""
    fits = []
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fit = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        fits.append(F.when(fit, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))))
    found = F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")
    return urls.withColumn("found", found).withColumn("rule", F.col("found.rule")).withColumn(
        "rule_verdict", F.col("found.verdict")).drop("found")


def templates(urls: DataFrame, depth: int = DEPTH, support: int = SUPPORT, z: float = Z) -> DataFrame:
    """``urls`` (host, path, good, bad, any other columns) with ``template``."""
    grown = urls.withColumn("segments", F.split(F.regexp_replace("path", r"^/", ""), "/")).withColumn(
        "template", F.lit(""))
    grown = materialize(grown, "urls")
    levels = grown.agg(F.max(F.size("segments"))).first()[0] or 0
    if levels > depth:
        levels = max(depth, _levels(grown, support))
    # segments that the template stands for; below ``depth`` only those up to the last branch
    grown = grown.withColumn("deep", F.least(F.size("segments"), F.lit(depth)))
    for level in range(levels):
        here = grown.withColumn("segment", F.get("segments", F.lit(level)))
        children = here.filter("segment IS NOT NULL").groupBy("host", "template", "segment").agg(
            F.count(F.lit(1)).alias("n"), F.sum("good").alias("g"), F.sum("bad").alias("b"))
        children = children.filter((F.col("n") >= support) & (F.col("g") + F.col("b") >= 5))
        parents = grown.filter(F.size("segments") > level).groupBy("host", "template").agg(
            F.sum("good").alias("pg"), F.sum("bad").alias("pb"))
        own = F.col("g") + F.col("b")
        others = F.col("pg") + F.col("pb") - own
        p, q = F.col("g") / own, (F.col("pg") - F.col("g")) / others
        pooled = F.col("pg") / (F.col("pg") + F.col("pb"))
        error = F.sqrt(pooled * (1 - pooled) * (1 / own + 1 / others))
        stays = children.join(parents, ["host", "template"]).filter(others >= 5).filter(
            F.abs(p - q) > z * error).select("host", "template", "segment", F.col("segment").alias("kept"))
        grown = here.join(stays, ["host", "template", "segment"], "left")
        if level < depth:
            longer = F.col("segment").isNotNull()
            between = F.lit("")
        else:
            longer = F.col("kept").isNotNull()
            between = F.repeat(F.lit("/*"), F.lit(level) - F.col("deep"))
        grown = grown.withColumn("template", F.when(longer, F.concat(
            "template", between, F.lit("/"), F.coalesce("kept", F.lit("*")))).otherwise(F.col("template")))
        if level >= depth:
            grown = grown.withColumn("deep", F.when(longer, F.lit(level + 1)).otherwise(F.col("deep")))
        grown = materialize(grown.drop("segment", "kept"), "urls")
    tail = F.when(F.size("segments") > F.col("deep"), F.lit("/**")).otherwise(F.lit(""))
    return grown.withColumn("template", F.concat("template", tail)).drop("segments", "deep")


def _levels(grown: DataFrame, support: int) -> int:
    """Levels at which a branch can stay: some host has ``support`` urls that long, and ten labels."""
    sizes = grown.groupBy("host", F.size("segments").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good") + F.col("bad")).alias("labels"))
    longer = Window.partitionBy("host").orderBy(F.col("size").desc())  # one row per length of a host's paths
    sums = sizes.select("size", F.sum("n").over(longer).alias("n"), F.sum("labels").over(longer).alias("labels"))
    return sums.filter((F.col("n") >= support) & (F.col("labels") >= 10)).agg(F.max("size")).first()[0] or 0


def judge(urls: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES,
          threshold: float = THRESHOLD, strength: float = STRENGTH) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every url (page_id, url).

    ``labelled`` (label_key string, label 0/1) marks urls by their ``label_key``, which ``urls``
    has too (null: unlabelled)."""
    host, path = host_and_path(F.col("url"))
    marks = labelled.filter("label_key IS NOT NULL").groupBy("label_key").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("good"), F.sum((F.col("label") == 0).cast("long")).alias("bad"))
    base = urls.select("page_id", "label_key", host.alias("host"), path.alias("path"))
    base = base.join(marks, "label_key", "left").select(
        "page_id", "host", "path", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    grown = templates(base)
    counts = grown.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    counts = materialize(counts, "templates")
    hosts = counts.groupBy("host").agg(F.sum("g").alias("hg"), F.sum("b").alias("hb"))
    everything = counts.agg(((F.sum("g") + 1) / (F.sum("g") + F.sum("b") + 2)).alias("purity")).first()[0]
    prior = F.lit(float(everything if everything is not None else 0.5))
    purity = counts.join(hosts, "host").withColumn(
        "host_purity", (F.col("hg") + strength * prior) / (F.col("hg") + F.col("hb") + strength)).select(
        "host", "template", ((F.col("g") + strength * F.col("host_purity")) / (F.col("g") + F.col("b") + strength)).alias("purity"))
    out = with_rule(grown, rules).join(purity, ["host", "template"], "left")
    learnt = F.when(F.col("purity") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", learnt).alias("verdict"),
                      "template", "purity")


def document_key(url: Column) -> Column:
    """The whole number that ends a url's path, by which a page names its document; null if none."""
    _, path = host_and_path(url)
    number = F.regexp_extract(path, r"([0-9]+)(?:\.[A-Za-z]+)?/?$", 1)
    return F.nullif(F.regexp_replace(number, r"^0+(?=[0-9])", ""), F.lit(""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; a page is labelled by the quality of the document that its url names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("label_key", document_key(F.col("url")))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("label_key"), F.col("quality").alias("label"))
    return judge(pages, labels)
