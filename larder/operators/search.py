"""J5a for a table of search texts: an inverted index of letter groups.

A single search (``catalog.catalog``) scans the product names for its text. For
many texts at once that would compare every text with every name; here
names are indexed by their groups of one, two and three neighbouring characters.
A text is looked up by the rarest group in it, and the names found there are
confirmed by LIKE. Groups of three are used where the text has them, so a
frequent letter is only followed for a text that is no longer than it.

Defined: matching is that of ``LIKE '%text%'`` with escape ``\\``: case-sensitive, ``%`` and
``_`` are wildcards, groups are taken from the literal runs between them. A
text without any literal character (empty, ``%``, ``__``) matches by length alone:
its answer is every long enough name, found through a dealt-out equality join.
NULL texts are no searches, NULL names match nothing; repeated texts are answered once.
A pattern that ends in a lone escape is refused, as LIKE does.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.tables import materialize

Tables = Mapping[str, DataFrame]
LONGEST = 3
# Copies of a text without literals, so that its long answer is made by many tasks.
SPREAD = 64


def _groups(text: Column, size: int) -> Column:
    """All groups of ``size`` neighbouring characters (an array; empty for shorter texts)."""
    last = F.char_length(text) - size + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, F.lit(size)))


def name_index(names: DataFrame, key: str, name: str) -> DataFrame:
    """(gram, key): the groups of one to ``LONGEST`` characters of every name, once for each name."""
    grams = F.array_distinct(F.concat(*[_groups(F.col(name), n) for n in range(1, LONGEST + 1)]))
    return names.where(F.col(name).isNotNull()).select(F.explode(grams).alias("gram"), key)


def _literals(text: Column) -> Column:
    """The runs between wildcards, escapes taken off: escaped characters keep their place, wildcards cut."""
    marked = F.regexp_replace(text, r"\\(.)", "\u0001$1\u0002")              # set escaped characters apart
    marked = F.regexp_replace(marked, "(?<!\u0001)[%_]", "\u0003")           # wildcards that remain
    return F.split(F.regexp_replace(marked, "[\u0001\u0002]", ""), "\u0003")


def text_groups(texts: DataFrame, text: str = "text") -> DataFrame:
    """(text, gram) for the longest groups that each text's literal runs have; texts without literals have no row."""
    runs = F.filter(_literals(F.col(text)), lambda r: F.char_length(r) > 0)
    longest = F.least(F.lit(LONGEST), F.coalesce(F.array_max(F.transform(runs, F.char_length)), F.lit(0)))
    grams = lambda n: F.flatten(F.transform(runs, lambda r: _groups(r, n)))
    chosen = F.when(longest == 1, grams(1)).when(longest == 2, grams(2)).when(longest >= 3, grams(3))
    return texts.select(text, F.explode(F.array_distinct(chosen)).alias("gram"))


def matching_names(names: DataFrame, texts: DataFrame, key: str, name: str, text: str = "text") -> DataFrame:
    """(text, key) of all names that contain a text, as ``name LIKE '%' || text || '%'``."""
    asked = materialize(texts.select(text).where(F.col(text).isNotNull()).distinct(), "search-texts")
    index = materialize(name_index(names, key, name), "search-index")
    grams = text_groups(asked, text)
    # How many names each asked group has: only asked groups are counted.
    sizes = index.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("size"))
    ranked = grams.join(sizes, "gram", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    rarest = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(text).orderBy("size", "gram"))) \
        .where((F.col("_r") == 1) & (F.col("size") > 0)).select(text, "gram")
    found = rarest.join(index, "gram").select(text, key).join(names.select(key, name), key)
    # Texts without literals: every name is a candidate, so the names are dealt to copies of the text.
    bare = asked.join(grams.select(text).distinct(), text, "left_anti") \
        .withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = names.where(F.col(name).isNotNull()).select(key, name, F.pmod(F.xxhash64(key), F.lit(SPREAD)).cast("int").alias("_deal"))
    found = found.select(text, key, name).unionByName(bare.join(dealt, "_deal").select(text, key, name))
    pattern = F.concat(F.lit("%"), F.col(text), F.lit("%"))
    return found.where(F.like(F.col(name), pattern)).select(text, key)


def search_all(t: Tables, texts: DataFrame, text: str = "text") -> DataFrame:
    """J5a for every text: (text, upc, id_product, by).

    A text that some product's name contains finds the stocked items of those products
    (``by`` = 'name'; none if no such product is stocked); any other finds the item with that UPC (``by`` = 'upc').
    """
    asked = texts.select(F.col(text).alias("text")).where(F.col(text).isNotNull()).distinct()
    hits = materialize(matching_names(t["product"].select("id_product", "product_name"), asked, "id_product", "product_name"),
                       "search-hits")
    items = t["store_product"].select("upc", "id_product")
    by_name = hits.join(items, "id_product").select("text", "upc", "id_product", F.lit("name").alias("by"))
    rest = asked.join(hits.select("text").distinct(), "text", "left_anti")
    by_upc = rest.join(items, F.col("text") == F.col("upc")).select("text", "upc", "id_product", F.lit("upc").alias("by"))
    return by_name.unionByName(by_upc)
