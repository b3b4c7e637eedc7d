"""SpotSigs document fingerprints, in DataFrame operations only.

A spot is an anchor (a common word) with the chain of the next ``CHAIN`` content words;
anchors in between are passed over.  Every anchor of a run ("of the cat") opens a spot of
its own.  A document's fingerprint is the set of the hashes of its spots, written as sorted
hexadecimal.  A text without any anchor takes every content
word as its own anchor, so each text with words has spots.  Words are runs of letters and
digits, lower-cased.  Null texts count as empty; texts without words have the empty
fingerprint, and two empty fingerprints are alike (1.0).

``near_pairs`` finds all pairs of distinct fingerprints with Jaccard at least ``floor``:
sets are partitioned by length so that only neighbouring lengths can reach the floor,
candidates share one of the rarest spots that any such pair must share, and the Jaccard
is computed only where the lengths allow it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.llm.common import order_bounds, order_bucket, text_of

CHAIN = 3
# fixed values: common function words of English, French, German and Spanish
ANCHORS = """
a an and are as at be by for from in is it of on or that the this to was were which with
au aux ce dans de des du elle en est et il la le les ne par pas plus pour que qui sur un une
auf das dem den der des die ein eine er es für ich im ist mit nicht sich sie und von zu
al como con del el ella es las lo los más no para pero por se su y
""".split()
_MARK = "\u0001"


def _anchor_pattern() -> str:
    """Anchors grouped by first letter: one comparison passes over a whole group."""
    groups: dict[str, set[str]] = {}
    for w in ANCHORS:
        groups.setdefault(w[0], set()).add(w[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in sorted(groups.items()))


_ANCHOR = f"(?<![^ ])({_anchor_pattern()}) "


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spots(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct spot hashes (array of int) of a text without nulls."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    glued = F.regexp_replace(plain, _ANCHOR, f"$1{_MARK}")

    def of_units(units: Column) -> Column:
        return _let(F.transform(units, lambda u: F.substring_index(u, _MARK, -1)),
                    lambda words: of_words(units, words))

    def of_words(units: Column, words: Column) -> Column:
        followers = [F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))) for k in range(1, chain)]
        named = [f.alias(f"w{k}") for k, f in enumerate(followers, 1)]
        return _let(F.arrays_zip(units.alias("u"), *named), of_rows)

    def of_rows(rows: Column) -> Column:
        def rest(r: Column) -> list[Column]:
            return [r[f"w{k}"] for k in range(1, chain)]

        def of_run(r: Column) -> Column:
            """A spot for each anchor before the unit's content word."""
            return _let(F.split(r["u"], _MARK), lambda run: F.transform(
                F.slice(run, F.lit(1), F.size(run) - 1),
                lambda a: F.hash(F.concat(a, F.lit(_MARK), F.element_at(run, -1)), *rest(r))))
        anchored = F.filter(rows, lambda r: F.contains(r["u"], F.lit(_MARK)))
        return _let(anchored, lambda some: F.when(F.size(some) > 0, F.flatten(F.transform(some, of_run))).otherwise(
            F.transform(rows, lambda r: F.hash(r["u"], *rest(r)))))

    return F.when(plain == "", F.array().cast("array<int>")).otherwise(
        F.array_sort(F.array_distinct(_let(F.split(glued, " "), of_units))))


def fingerprint(spot_set: Column) -> Column:
    """The set as text: eight hexadecimal digits per spot, in order."""
    return F.array_join(F.transform(spot_set, lambda s: F.right(F.lpad(F.lower(F.hex(s)), 16, "0"), F.lit(8))), "")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard of two spot sets; 0.0 without comparing where the lengths alone keep it
    under ``floor``."""
    both = F.size(F.array_intersect(a, b))
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = both / (F.size(a) + F.size(b) - both)
    return F.when(high == 0, F.lit(1.0)).when(low < F.lit(floor) * high, F.lit(0.0)).otherwise(exact)


def with_next(rows: DataFrame, columns: list[str], bucket_rows: int = 2000, chain: int | None = None) -> DataFrame:
    """Adds next_<column>: the value in the following row by (doc_id, text), null doc_id
    first; after the last row comes the first.  With ``chain`` the spots of every row and
    its follower are added too, computed once a row and again for the head of a bucket.

    Rows are dealt into ordered buckets of about ``bucket_rows`` by quantiles of doc_id;
    only the first row of every bucket travels to the bucket before it.
    """
    n = rows.count()
    # the number of buckets bounds what one task later gathers: a head per bucket
    bounds = order_bounds(rows, "doc_id", min(10_000, n // bucket_rows + 1))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = rows.withColumn("bucket", order_bucket(F.col("doc_id"), bounds)).withColumn("key", key)
    least = rows.groupBy("bucket").agg(F.min("key").alias("key"))
    least = least.select(F.col("bucket").alias("head_bucket"), F.col("key").alias("head_key"))
    heads = rows.join(F.broadcast(least), (F.col("bucket") == F.col("head_bucket")) & (F.col("key") == F.col("head_key")))
    heads = heads.groupBy("bucket").agg(F.min(F.struct("text", *[c for c in columns if c != "text"])).alias("head"))
    if chain:
        heads = heads.withColumn("head", F.col("head").withField("spots", spots(F.col("head.text"), chain)))
        rows, columns = rows.withColumn("spots", spots(F.col("text"), chain)), [*columns, "spots"]
    order = Window.orderBy("bucket")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(order), F.first("head").over(around)).alias("after"))
    here = Window.partitionBy("bucket").orderBy("key", "text")
    rows = rows.withColumn("follower", F.lead(F.struct(*columns)).over(here))
    rows = rows.join(heads, "bucket")
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.when(F.col("follower").isNotNull(), F.col(f"follower.{c}"))
                               .otherwise(F.col(f"after.{c}")))
    return rows.drop("bucket", "key", "follower", "after")


def edited_fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of every text and of its edit (the last quarter of its code points
    replaced by the beginning of the next document), with their likeness."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = with_next(rows, ["text"], chain=chain)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "spots", "next_spots",
                       F.concat(F.left("text", n - quarter), F.left("next_text", quarter)).alias("edited"))
    rows = rows.withColumn("edited_spots", spots(F.col("edited"), chain))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint(F.col("spots")).alias("fingerprint"),
                       fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
                       likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
                       likeness(F.col("spots"), F.col("next_spots")).alias("near_next"))


def near_pairs(docs: DataFrame, floor: float = 0.8, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of representatives a < b with their likeness of at least
    ``floor``, and the representative of every doc_id (texts of equal, non-empty
    fingerprints share the smallest doc_id; rows without words or doc_id have none)."""
    sets = docs.select("doc_id", spots(text_of(), chain).alias("spots")).filter(
        (F.size("spots") > 0) & F.col("doc_id").isNotNull())
    sets = sets.withColumn("print", F.sha2(fingerprint(F.col("spots")), 256))
    reps = sets.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("spots").alias("spots"))
    members = sets.select("doc_id", "print").join(reps.select("print", "rep"), "print").select("doc_id", "rep")
    one = reps.select("rep", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    common = one.groupBy("spot").agg(F.count("*").alias("df"))
    ranked = (one.join(common, "spot").groupBy("rep", "n")
              .agg(F.sort_array(F.collect_list(F.struct("df", "spot"))).alias("by_df")))
    need = F.ceil(F.lit(floor - 1e-9) * F.col("n")).cast("int")
    prefix = F.slice("by_df", 1, F.col("n") - need + 1)
    step = math.log(1 / floor)
    keys = ranked.select("rep", "n", F.floor(F.log("n") / step + 1e-9).alias("length_part"),
                         F.explode(F.transform(prefix, lambda x: x["spot"])).alias("spot"))
    small = keys.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), "spot",
                        F.explode(F.array("length_part", F.col("length_part") + 1)).alias("length_part"))
    large = keys.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), "spot", "length_part")
    both = small.join(large, ["length_part", "spot"]).filter(
        ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
        & (F.col("n_a") >= F.lit(floor - 1e-9) * F.col("n_b"))).select("a", "b").distinct()
    left = reps.select(F.col("rep").alias("a"), F.col("spots").alias("spots_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("spots").alias("spots_b"))
    pairs = both.join(left, "a").join(right, "b").withColumn(
        "likeness", likeness(F.col("spots_a"), F.col("spots_b"), floor)).filter(F.col("likeness") >= floor)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"), members
