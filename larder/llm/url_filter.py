"""URL filter (operator 8): host rules, then a listed-URL check by a blocked
Bloom filter and an exact join.

The list of canonical URLs is hashed into a table of Bloom blocks, as many as
the counted list needs: one row per block with eight 32-bit words, one bit set
in each word per listed URL. A page's URL can be on the list only if all eight
bits of its block are set; only those possible hits go on to the join with the
list itself, which removes false positives. URLs that very many possible hits
have are salted. Everything is built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import (HOT_LEAST, HOT_SHARE, Scratch, bloom_blocks, bloom_probe, bloom_table, lower_az,
                               salted)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (lower_az(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)),
            F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without trailing slashes
    and page endings; scheme, query and fragment are dropped."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""),
                    F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.html?$", ""))


def probe_list(urls: DataFrame, listed: DataFrame, scratch: Scratch, url: str = "canonical",
               blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``urls`` with a boolean column ``__maybe`` (false: surely not listed), and the distinct listed
    URLs (column ``__url``); both written, so that list and pages are each read once."""
    names = scratch.write(listed.select(F.col(f"`{url}`").alias("__url")).where("__url <> ''").distinct())
    size = blocks or bloom_blocks(names.count())
    return scratch.write(bloom_probe(urls, F.col(f"`{url}`"), bloom_table(names, "__url", size), "__maybe", size)), names


def on_list(urls: DataFrame, listed: DataFrame, url: str = "canonical", blocks: int | None = None,
            out: str = "listed") -> DataFrame:
    """``urls`` with a boolean column: is the URL on the list? Null or empty URLs are not."""
    cols = [F.col(f"`{c}`") for c in urls.columns if c != out]
    probed, names = probe_list(urls.select(*cols), listed, Scratch(urls.sparkSession), url, blocks)
    hits = probed.where("__maybe").withColumn("__key", F.col(f"`{url}`"))
    least = max(HOT_LEAST, hits.count() // HOT_SHARE)   # so fewer than HOT_SHARE URLs are hot
    hot = hits.groupBy("__key").count().where(F.col("count") > least).select("__key")
    hits, exact = salted(hits, names.select(F.col("__url").alias("__key"), F.lit(True).alias("__found")), "__key", hot)
    found = hits.join(exact, ["__key", "__salt"], "left")
    return found.select(*cols, F.coalesce("__found", F.lit(False)).alias(out)).unionByName(
        probed.where(~F.col("__maybe")).select(*cols, F.lit(False).alias(out)))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tested last, and so wins
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url",
                blocks: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict.

    The columns of ``pages`` are written once between filter and join, so pass those that are needed.
    ``listed``: one column ``canonical`` of listed URLs, of any size. The rule that fits
    decides; else a listed URL is blocked and any other allowed. A null URL or
    one without ``://`` has an empty host and path, fits no rule and is
    allowed. Repeated rows each get their row; columns of the same names as
    the new ones are replaced.
    """
    new = ["host", "path", "rule", "verdict"]
    host, path = url_parts(F.col(f"`{url}`"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    parts = pages.select(*kept, host.alias("host"), path.alias("path")) \
        .withColumn("__canonical", canonical(F.col("host"), F.col("path")))
    checked = on_list(parts, listed.select(F.col("canonical").alias("__canonical")), "__canonical", blocks, "__listed")
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return checked.select(*[F.col(f"`{c}`") for c in pages.columns if c not in new],
                          "host", "path", name.alias("rule"),
                          F.coalesce(verdict, F.when(F.col("__listed"), "block").otherwise("allow")).alias("verdict"))
