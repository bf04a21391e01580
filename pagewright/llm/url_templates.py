"""Verdicts on urls: stated rules first, then the purity of path templates.

Per host the paths form a tree. A segment is generalised when it is a number
by its look, or when its parent has very many children and it is a small one
among them. Sibling templates whose labelled share of blocked urls does not
differ from their common share by more than chance are merged. A template is
rejected when its smoothed share of blocked urls reaches one half; smoothing
goes to the host, and from the host to all labelled urls. The urls that a rule
decides are the labelled ones.

Everything is grouped counts and equi joins. Counts are combined before the
shuffle; a join has one row per key on the template side, so Spark may split a
host with very many urls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

DEPTH = 3  # levels of the tree; what lies deeper is one last level
FAN_OUT = 30
HOST_WEIGHT = 20.0
TEMPLATE_WEIGHT = 5.0
CHANCE = 3.8416  # squared normal quantile at 5 %
REJECT_FROM = 0.5

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def url_parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path). Null urls and urls without `://` have both empty."""
    part = lambda i: F.coalesce(F.regexp_extract("url", _URL, i), F.lit(""))
    return pages.select("page_id", F.translate(part(1), _UPPER, _LOWER).alias("host"), part(2).alias("path"))


def rule_of(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits host and path; null without one.

    The list of rules is a parameter of the plan, one branch per rule. Of rules
    of one length the first in order of their text wins.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _generalised(tree: DataFrame, level: int) -> DataFrame:
    """`tree` with segment `level` replaced by `*` where its parent has many children and it is a small one."""
    parent = ["host", *[f"s{i}" for i in range(1, level)]]
    own = f"s{level}"
    children = tree.groupBy(*parent, own).agg(F.sum("n").alias("_n"))
    parents = children.groupBy(*parent).agg(F.count("*").alias("_children"), F.sum("_n").alias("_all"))
    star = (children.join(parents, parent)
            .where((F.col(own) != "") & (F.col("_children") > FAN_OUT) & (F.col("_n") * FAN_OUT < F.col("_all")))
            .select(*parent, own, F.lit("*").alias("_star")))
    return tree.join(star, [*parent, own], "left").withColumn(own, F.coalesce("_star", own)).drop("_star")


def templates(urls: DataFrame) -> DataFrame:
    """The tree's leaves for (host, path, verdict): raw1..raw3, raw4 as keys, `template`, and `purity`, the smoothed blocked share."""
    raw = [f"raw{i}" for i in range(1, DEPTH + 2)]
    tree = (urls.groupBy("host", *raw)
            .agg(F.count("*").alias("n"), F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("bad"),
                 F.sum(F.when(F.col("verdict").isNotNull(), 1).otherwise(0)).alias("known")))
    ensure_checkpoint_dir(urls.sparkSession)
    # Every level reads the tree several times; a checkpoint between levels keeps the plan small.
    tree = tree.withColumns({f"s{i}": F.col(f"raw{i}") for i in range(1, DEPTH + 1)}).checkpoint()
    for i in range(1, DEPTH + 1):
        tree = _generalised(tree, i).checkpoint()
    leaf = ["host", *[f"s{i}" for i in range(1, DEPTH + 1)], f"raw{DEPTH + 1}"]
    leaves = tree.groupBy(*leaf).agg(F.sum("bad").cast("double").alias("bad"), F.sum("known").cast("double").alias("known"))
    branch = ["host", "s1"]
    pooled = leaves.groupBy(*branch).agg(F.sum("bad").alias("_bad"), F.sum("known").alias("_known"))
    share, common = F.try_divide("bad", "known"), F.try_divide("_bad", "_known")
    alike = F.coalesce((share - common) * (share - common) <= F.try_divide(CHANCE * common * (1 - common), F.col("known")), F.lit(True))
    leaves = leaves.join(pooled, branch).withColumn("_alike", alike).checkpoint()
    merged = (leaves.where("_alike").groupBy(*branch).agg(F.sum("bad").alias("_mb"), F.sum("known").alias("_mk")))
    hosts = leaves.groupBy("host").agg(F.sum("bad").alias("_hb"), F.sum("known").alias("_hk"))
    prior = hosts.agg(F.coalesce(F.try_divide(F.sum("_hb"), F.sum("_hk")), F.lit(0.0))).scalar()  # one value
    hosts = hosts.select("host", ((F.col("_hb") + HOST_WEIGHT * prior) / (F.col("_hk") + HOST_WEIGHT)).alias("_host_share"))
    bad = F.when(F.col("_alike"), F.col("_mb")).otherwise(F.col("bad"))
    known = F.when(F.col("_alike"), F.col("_mk")).otherwise(F.col("known"))
    purity = (bad + TEMPLATE_WEIGHT * F.col("_host_share")) / (known + TEMPLATE_WEIGHT)
    judged = (leaves.join(merged, branch, "left").join(hosts, "host").withColumn("purity", purity).select(*leaf, "purity"))
    path = F.concat(*[F.when(F.col(c) != "", F.concat(F.lit("/"), F.col(c))).otherwise("") for c in leaf[1:]])
    return tree.join(judged, leaf).select("host", *raw, path.alias("template"), "purity")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), one row per row of `pages`.

    A rule decides where one fits. Without labelled urls (no rule fits any url)
    the shares are 0 and everything is allowed. A null or malformed url is the
    empty path of the empty host. Repeated rows and null ids are kept; an empty
    table gives no rows; other columns are ignored.
    """
    text, verdict = rule_of(rules)
    urls = url_parts(pages).withColumn("rule", text).withColumn("verdict", verdict)
    segments = F.filter(F.split("path", "/", -1), lambda x: x != "")
    urls = urls.withColumn("_s", F.transform(segments, lambda x: F.regexp_replace(x, r"[0-9]+", "{n}")))
    for i in range(1, DEPTH + 1):
        urls = urls.withColumn(f"raw{i}", F.coalesce(F.get("_s", F.lit(i - 1)), F.lit("")))
    urls = urls.withColumn(f"raw{DEPTH + 1}", F.when(F.size("_s") > DEPTH, "**").otherwise("")).drop("_s")
    leaves = templates(urls)
    by = F.when(F.col("purity") >= REJECT_FROM, "block").otherwise("allow")
    return (urls.join(leaves, ["host", *[f"raw{i}" for i in range(1, DEPTH + 2)]])
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", by).alias("verdict"), "template", "purity"))
