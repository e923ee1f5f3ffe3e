"""Placement trees: of each key (a host), a decision tree that tells from the tags around an element what the element is.

Trees grow level by level, all keys at once. Equal elements are counted first. A level's candidate splits are counts by
key, node, place and tag, which Spark sums before it shuffles; the best split of each node is joined back to the elements, so
no task holds a key's elements, and a tree is rows of a table. A split sends an element whose neighbour at a place is a
certain tag to the left, and any other to the right, a tag that was never seen too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions import html as H
from pagewatch.functions.names import unused
from pagewatch.sources.folders import table

#: Elements on either side that are looked at; weights of classes 0, 1 and 2 (others, iframes, invisible iframes).
SAMPLE, WEIGHTS = 10, (1, 50, 50)
#: Levels of splits, and the least gain in bits of a split.
DEPTH, LEAST_GAIN = 12, 1e-9

SPLITS = "key string, node long, place int, tag string, w0 long, w1 long, w2 long, gain double"


def elements(pages: DataFrame, key: str, html: str, sample: int = SAMPLE) -> DataFrame:
    """Key, around, label, n: how often an element of that label stands with those tags before and after it.

    around: the names of the `sample` opening tags before it, nearest last, and of those after it; empty beyond the page's ends.
    label: 2 for iframes that can't be seen (P12), 1 for other iframes, 0 for the rest. Null html has no elements.
    """
    own, found, names, at = unused(pages, "key", "found", "names", "at")
    rows = pages.select(F.col(key).cast("string").alias(own), H.tags(F.col(html), H._ANY).alias(found))
    kind = F.transform(found, lambda t: F.when(t.rlike(r"(?i)^<iframe[\s/>]"), F.when(H.invisible_iframe(t), "iframe ").otherwise("iframe")).otherwise(F.lower(F.regexp_extract(t, r"^<([^\t\n\r\f />\x00]+)", 1))))
    edge = F.array_repeat(F.lit(""), sample)
    rows = rows.select(own, F.concat(edge, kind, edge).alias(names))
    rows = rows.where(F.size(names) > 2 * sample).select(own, names, F.explode(F.sequence(F.lit(sample), F.size(names) - sample - 1)).alias(at))
    # `iframe ` is an invisible one as a label; as a neighbour it is an iframe like others
    near = F.transform(F.concat(F.slice(names, F.col(at) - sample + 1, F.lit(sample)), F.slice(names, F.col(at) + 2, F.lit(sample))), F.rtrim)
    it = F.element_at(names, F.col(at) + 1)
    label = F.when(it == "iframe ", 2).when(it == "iframe", 1).otherwise(0)
    return rows.select(F.col(own).alias("key"), near.alias("around"), label.alias("label")).groupBy("key", "around", "label").agg(F.count("*").alias("n"))


def _weighted(n: Column) -> list[Column]:
    return [F.sum(F.when(F.col("label") == c, n * w).otherwise(0)).alias(f"w{c}") for c, w in enumerate(WEIGHTS)]


def _entropy(weights: list[Column]) -> Column:
    """In bits; of sums of weights."""
    whole = reduce(Column.__add__, weights)
    parts = [F.when(w > 0, w / whole * F.log2(w / whole)).otherwise(0.0) for w in weights]
    return -reduce(Column.__add__, parts)


def _best(rows: DataFrame) -> DataFrame:
    """SPLITS: of each key and node the split with most gain (of equal ones that of the first place, then tag); none where no split gains."""
    each = rows.select("key", "node", "label", "n", F.posexplode("around").alias("place", "tag"))
    counted = each.groupBy("key", "node", "place", "tag").agg(*_weighted(F.col("n")))
    whole = rows.groupBy(F.col("key").alias("whole_key"), F.col("node").alias("whole_node")).agg(*(w.alias(f"t{c}") for c, w in enumerate(_weighted(F.col("n")))))
    both = counted.join(whole, F.col("key").eqNullSafe(F.col("whole_key")) & (F.col("node") == F.col("whole_node")))
    left, total = ([F.col(f"{p}{c}").cast("double") for c in range(3)] for p in "wt")
    right = [t - x for t, x in zip(total, left, strict=True)]
    size = lambda found: reduce(Column.__add__, found)
    gain = _entropy(total) - (size(left) * _entropy(left) + size(right) * _entropy(right)) / size(total)
    scored = both.where(size(right) > 0).withColumn("gain", F.round(gain, 9)).where(F.col("gain") > LEAST_GAIN)
    order = F.struct((-F.col("gain")).alias("g"), "place", "tag", *(f"t{c}" for c in range(3)), "gain")
    first = scored.groupBy("key", "node").agg(F.min(order).alias("s"))
    return first.select("key", "node", "s.place", "s.tag", *(F.col(f"s.t{c}").alias(f"w{c}") for c in range(3)), "s.gain")


def _moved(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of the nodes that are split, each in the child that it goes to: 2 node + 1 or 2 node + 2."""
    own = splits.select(F.col("key").alias("split_key"), F.col("node").alias("split_node"), F.col("place").alias("split_place"), F.col("tag").alias("split_tag"))
    both = rows.join(own, F.col("key").eqNullSafe(F.col("split_key")) & (F.col("node") == F.col("split_node")))
    right = (F.element_at("around", F.col("split_place") + 1) != F.col("split_tag")).cast("int")
    return both.withColumn("node", 2 * F.col("node") + 1 + right).select(rows.columns)


def train(found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """SPLITS of all keys' trees, of what elements() gives; w0 to w2 are the weights that reach a node, its root being 0.

    A node is split while some split gains, at most `depth` times from the root. A key whose elements have one label only has no
    splits; a null key is a key of its own.
    """
    rows, out = table(found.withColumn("node", F.lit(0).cast("long")), "placement-rows"), []
    for _ in range(depth):
        splits = table(_best(rows), "placement-splits")
        if splits.isEmpty():
            break
        out.append(splits)
        rows = table(_moved(rows, splits), "placement-rows")
    return reduce(DataFrame.unionByName, out) if out else found.sparkSession.createDataFrame([], SPLITS)


def leaves(found: DataFrame, splits: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows of found and the leaf of their key's tree that they reach; 0 where the key has no splits."""
    rows, out = found.withColumn("node", F.lit(0).cast("long")), []
    names = splits.select("key", "node")
    for _ in range(depth + 1):
        same = F.col("key").eqNullSafe(F.col("k")) & (F.col("node") == F.col("m"))
        out.append(rows.join(names.toDF("k", "m"), same, "left_anti"))
        rows = _moved(rows, splits)
    return reduce(DataFrame.unionByName, out).withColumnRenamed("node", "leaf")


def placed(found: DataFrame, known: DataFrame, splits: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, label, said, n: how many elements of a label stand where the trees of `splits`, learnt from `known`, expect which label.

    A leaf expects the label of most weight, of equal ones the smallest; an element of a key that wasn't known is expected to be 0.
    """
    at = leaves(known, splits, depth).groupBy("key", "leaf").agg(*_weighted(F.col("n")))
    most = F.greatest("w0", "w1", "w2")
    said = at.select(F.col("key").alias("known_key"), F.col("leaf").alias("known_leaf"), F.when(F.col("w0") == most, 0).when(F.col("w1") == most, 1).otherwise(2).alias("said"))
    same = F.col("key").eqNullSafe(F.col("known_key")) & (F.col("leaf") == F.col("known_leaf"))
    both = leaves(found, splits, depth).join(said, same, "left")
    return both.groupBy("key", "label", F.coalesce("said", F.lit(0)).alias("said")).agg(F.sum("n").alias("n"))
