"""Best-match, fuzzy, vector and interval joins without cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def substrings(text: Column, least: int, most: Column | int) -> Column:
    """Distinct substrings of a short text, from `least` to `most` characters."""
    n = F.length(text)
    cut = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, size))
    sizes = F.when(n >= least, F.sequence(F.lit(least), F.least(n, F.lit(most) if isinstance(most, int) else most)))
    return F.array_distinct(F.flatten(F.transform(F.coalesce(sizes, F.array().cast("array<int>")), cut)))


def longest_contained(items: DataFrame, item: str, names: DataFrame, name: str, least: int = 2, most: int | None = None, ratio: float = 0.0) -> DataFrame:
    """For each distinct item the equal name, else the longest one it contains (at least `ratio` of it); ties: the first in order.

    Items explode into their substrings, up to the longest name's length unless `most` is given, which meet the names in an equi-join.
    """
    distinct = items.select(item).where(F.col(item).isNotNull()).distinct()
    keys = names.select(F.col(name).alias("name_")).where(F.length("name_") >= least).distinct()
    if most is None:
        most = keys.agg(F.max(F.length("name_"))).first()[0] or least  # one number
    pieces = distinct.select(item, F.explode(substrings(F.col(item), least, most)).alias("piece_"))
    hits = pieces.join(keys, pieces.piece_ == keys.name_).where(F.length("name_") >= F.length(item) * ratio)
    best = hits.groupBy(item).agg(F.min(F.struct(F.when(F.col(item) == F.col("name_"), 0).otherwise(2).alias("priority"), (-F.length("name_")).alias("minus"), F.col("name_").alias("name"))).alias("b"))
    return best.select(item, F.col("b.name").alias("match"), F.col("b.priority").alias("priority"))


def near_misses(queries: DataFrame, query: str, names: DataFrame, name: str, least: int = 8, share: float = 0.25) -> DataFrame:
    """For each query of at least `least` characters the name at the smallest edit distance, up to floor(share * length).

    With distance k, one of k + 1 parts of the query stands unchanged in the name,
    at most k places off; parts and the names' substrings of their length meet in
    an equi-join, and only those pairs are measured.
    """
    q = queries.select(F.col(query).alias("q")).where(F.length("q") >= least).distinct()
    n = F.length("q")
    k = F.floor(n * share).cast("int")
    size = F.floor(n / (k + 1)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct((i * size + 1).alias("at"), F.substring(F.col("q"), i * size + 1, size).alias("part")))
    parts = q.select("q", k.alias("k"), F.explode(starts).alias("s")).select("q", "k", "s.at", "s.part")
    lengths = [r[0] for r in parts.select(F.length("part")).distinct().collect()]  # at most 1 / share + 1, as a part is shorter than 1 / share
    keys = names.select(F.col(name).alias("name")).where("name is not null").distinct()

    def grams_of(length: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length("name") - length + 1, F.lit(1)))
        return F.transform(places, lambda i: F.struct(i.alias("place"), F.substring(F.col("name"), i, F.lit(length)).alias("part")))

    grams = [grams_of(length) for length in lengths]
    if not grams:
        return q.select("q", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("distance")).limit(0)
    pieces = keys.select("name", F.explode(F.concat(*grams)).alias("g")).select("name", "g.place", "g.part")
    pairs = parts.join(pieces, "part").where(F.abs(F.col("place") - F.col("at")) <= F.col("k")).where(F.abs(F.length("name") - F.length("q")) <= F.col("k")).select("q", "name", "k").distinct()
    scored = pairs.withColumn("distance", F.call_function("levenshtein", "q", "name", "k")).where("distance > 0")  # -1 where it is above k
    return scored.groupBy("q").agg(F.min(F.struct("distance", "name")).alias("b")).select("q", "b.name", "b.distance")


def overlapping(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: int, on: list[str] = ()) -> DataFrame:
    """Pairs of half-open spans that overlap, by an equi-join on tiles of `width`; each pair once, in its first common tile."""
    tiles = lambda d, s, name: d.withColumn(name, F.explode(F.sequence(F.floor(F.col(s[0]) / width), F.floor((F.greatest(F.col(s[1]) - 1, F.col(s[0]))) / width))))
    pairs = tiles(a, a_span, "tile_").join(tiles(b, b_span, "tile_"), [*on, "tile_"])
    first = F.floor(F.greatest(a_span[0], b_span[0]) / width)
    return pairs.where((F.col(a_span[0]) < F.col(b_span[1])) & (F.col(b_span[0]) < F.col(a_span[1])) & (F.col("tile_") == first)).drop("tile_")


def islands(df: DataFrame, partition: list[str], order: list[str], value: str, gap) -> DataFrame:
    """Numbers the groups of a partition's values in order; a new one begins after a step above `gap`."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > gap), F.lit(False)).cast("int")
    return df.withColumn("new_", new).withColumn("island", F.sum("new_").over(w)).drop("new_")


def set_pairs(df: DataFrame, key: str, items: str, least_shared: float) -> DataFrame:
    """Pairs of rows whose arrays of distinct items have a Jaccard similarity above `least_shared`.

    Items are ordered by rarity.  Two sets that are so alike share one of their first
    n - ceil(least_shared * n) + 1 items, so only these meet; sizes that differ too much
    do not, and the pairs that are left are verified on the whole arrays.
    """
    rows = df.select(key, F.col(items).alias("items_"), F.size(items).alias("n")).where("n > 0")
    each = rows.select(key, "n", F.explode("items_").alias("item"))
    ranked = each.join(each.groupBy("item").agg(F.count("*").alias("often")), "item")
    ordered = ranked.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("by"))
    first = F.slice("by", F.lit(1), F.col("n") - F.ceil(F.col("n") * least_shared - 1e-9).cast("int") + 1)
    posted = ordered.select(key, "n", F.explode(F.transform(first, lambda s: s["item"])).alias("item"))
    side = lambda name: posted.select(F.col(key).alias(name), "item", F.col("n").alias(f"n{name}"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least_shared)
    pairs = side("a").join(side("b"), "item").where(fits).select("a", "b").distinct()
    whole = lambda name: rows.select(F.col(key).alias(name), F.col("items_").alias(f"i{name}"), F.col("n").alias(f"n{name}"))
    both = pairs.join(whole("a"), "a").join(whole("b"), "b")
    common = F.size(F.array_intersect("ia", "ib"))
    return both.select("a", "b", (common / (F.col("na") + F.col("nb") - common)).alias("jaccard")).where(F.col("jaccard") > least_shared)


def cosine_pairs(weights: DataFrame, key: str, feature: str, weight: str, least: float) -> DataFrame:
    """Pairs of unit vectors, given as (key, feature, weight >= 0), whose cosine is at least `least`.

    Features are ordered by rarity.  What follows in a vector once its remaining norm is
    below `least` cannot reach it alone, so two such vectors share a feature before that;
    only these features meet, and the pairs that do are summed up over all features.
    """
    often = weights.groupBy(feature).agg(F.count("*").alias("often_"))
    w = Window.partitionBy(key).orderBy("often_", feature)
    ranked = weights.join(often, feature).withColumn("rest_", F.lit(1.0) - F.coalesce(F.sum(F.col(weight) * F.col(weight)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    posted = ranked.where(F.col("rest_") >= least * least - 1e-9)  # the norm from this feature on
    side = lambda d, name: d.select(F.col(key).alias(name), F.col(feature).alias("f"), F.col(weight).alias(f"w{name}"))
    pairs = side(posted, "a").join(side(posted, "b"), "f").where("a < b").select("a", "b").distinct()
    scored = pairs.join(side(weights, "a"), "a").join(side(weights, "b"), ["b", "f"])
    return scored.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= least - 1e-9)
