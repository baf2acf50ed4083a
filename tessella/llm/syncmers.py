"""Document fingerprints from closed syncmers, in Spark expressions only.

A text's units are its words; a character of a script that is written without spaces is a unit of its own. Units
hash to longs, with ``K`` - 1 blanks in front of the first. Of every ``K`` = 5 consecutive units the hashes of
the four inner pairs are compared; the five are a closed syncmer if the smallest pair stands first or last.
Whether they are one depends on nothing around them, so an edit disturbs only the anchors it touches and all
others match by content at their places. The fingerprint is the sequence of a text's anchors, each hashed with
its place; as a string it is their digest.

Matching is positional, in two ways: by place, anchors that stand at the same place of both texts; and by
distance, anchors that follow the same anchor at the same distance, wherever that is. Likeness is the larger
share that matches: twice the matches over the entries of both.

For edited texts every document needs its neighbour in the order of doc_id. Documents are dealt into
ranges of ids whose borders come from one approximate quantile aggregate; each range also gets the
first text of the next range, so one shuffle of the texts and a window within each range suffice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.text import SPACES

K = 5
RANGE_ROWS = 2000
MAX_RANGES = 1 << 16
#: Blocks of scripts written without spaces between words: Thai, Lao; Myanmar; Khmer; kana; Han.
UNSPACED = ("\u0e00-\u0eff", "\u1000-\u109f", "\u1780-\u17ff", "\u3040-\u30ff", "\u3400-\u4dbf", "\u4e00-\u9fff", "\uf900-\ufaff", "\U00020000-\U0003ffff")
_ALONE = "([" + "".join(UNSPACED) + "])"


def _hashes(text: Column) -> Column:
    """Hashes of the units behind ``K`` - 1 zeros; none for a text without units."""
    units = F.filter(F.split(F.regexp_replace(text, _ALONE, " $1 "), SPACES), lambda w: w != "")
    own = F.transform(units, lambda w: F.xxhash64(w))
    return F.concat(F.array_repeat(F.lit(0).cast("long"), K - 1), own)


def _pairs(hashes: Column) -> Column:
    return F.zip_with(F.slice(hashes, 1, F.size(hashes) - 1), F.slice(hashes, 2, F.size(hashes) - 1), lambda a, b: F.xxhash64(a, b))


def _places(pairs: Column) -> Column:
    """Indexes of the closed syncmers: their last unit, or the first as counted with the blanks."""

    def closed(i: Column) -> Column:
        a, b, c, d = (F.get(pairs, i + k) for k in range(4))
        inner = F.least(b, c)
        return ((a <= inner) & (a <= d)) | ((d <= inner) & (d <= a))

    last = F.size(pairs) - (K - 1)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), closed)).otherwise(F.array().cast("array<int>"))


def with_anchors(rows: DataFrame, text: str, name: str = "anchors") -> DataFrame:
    """``rows`` with a text's closed syncmers as ``struct<places, anchors, at, after>``.

    ``places`` are in units and ``anchors`` the hashes, in order; ``at`` has each anchor hashed with its place and
    ``after`` the distinct ones hashed with the anchor before and the distance to it. A text without units has none.
    """
    plain = rows.columns
    hashed = rows.select(*plain, _hashes(F.col(text)).alias("_hashes"))
    paired = hashed.select("*", _pairs(F.col("_hashes")).alias("_pairs"))
    placed = paired.select("*", _places(F.col("_pairs")).alias("_places"))
    syncmer = F.transform("_places", lambda i: F.xxhash64(F.get("_pairs", i), F.get("_pairs", i + 2), F.get("_hashes", i + 4)))
    found = placed.select(*plain, "_places", syncmer.alias("_anchors"))
    distance = lambda k: F.get("_places", k) - F.get("_places", k - 1)
    after = F.transform("_anchors", lambda h, k: F.xxhash64(h, F.get("_anchors", k - 1), distance(k)))
    rest = F.slice(after, 2, F.greatest(F.size("_anchors") - 1, F.lit(0)))
    at = F.zip_with("_anchors", "_places", lambda h, p: F.xxhash64(h, p))
    parts = [F.col("_places").alias("places"), F.col("_anchors").alias("anchors"), at.alias("at"), F.array_distinct(rest).alias("after")]
    return found.select(*plain, F.struct(*parts).alias(name))


def _shared(a: Column, b: Column) -> Column:
    """Twice the common entries over all; null if there are none."""
    return F.try_divide(2 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, for two columns that ``with_anchors`` made; two without anchors are alike."""
    return F.coalesce(F.greatest(_shared(a["at"], b["at"]), _shared(a["after"], b["after"])), F.lit(1.0))


def digest(anchors: Column) -> Column:
    """The fingerprint as a string: SHA-256 over all anchors with their places, in order."""
    return F.sha2(F.array_join(anchors["at"].cast("array<string>"), " "), 256)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, places, anchors, fingerprint`` for each row of ``docs(doc_id, text)``.

    Null texts are empty, and empty ones have no anchor; texts may have any length and equal texts have equal
    fingerprints; rows that repeat are returned each; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_anchors(rows, "text", "own").select("doc_id", "own.places", "own.anchors", digest(F.col("own")).alias("fingerprint"))


def _range_of(doc_id: Column, borders: list[int]) -> Column:
    """Number of borders at or above the id, found in two steps; larger ids have smaller ranges, null the last."""
    if not borders:
        return F.when(doc_id.isNull(), F.lit(1)).otherwise(F.lit(0))
    step = max(1, int(len(borders) ** 0.5))
    falling = sorted(borders, reverse=True)
    parts = [falling[k : k + step] for k in range(0, len(falling), step)]
    longs = lambda xs: "array(" + ",".join(f"{x}L" for x in xs) + ")"
    tops = F.expr(longs([p[0] for p in parts]))
    part = F.greatest(F.size(F.filter(tops, lambda b: b >= doc_id)) - 1, F.lit(0))
    nested = F.expr("array(" + ",".join(longs(p) for p in parts) + ")")
    within = F.size(F.filter(F.get(nested, part), lambda b: b >= doc_id))
    return F.when(doc_id.isNull(), F.lit(len(borders) + 1)).otherwise(part * step + within)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` against an edited text and against the next document.

    The next document has the next smaller doc_id, after the smallest comes the largest; rows that repeat a
    doc_id follow each other in the order of their texts, a null doc_id comes last. The edited text has the
    last third of the code points replaced by as many from the front of the next text, or all it has.
    Returns ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``. Null texts
    are empty; texts may have any length; a lone row is its own next; an empty table gives an empty result; other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = min(MAX_RANGES, -(-docs.count() // RANGE_ROWS))
    borders: list[int] = []
    if ranges > 1:
        at = [k / ranges for k in range(1, ranges)]
        found = rows.agg(F.percentile_approx("doc_id", at, max(10_000, 4 * ranges)).alias("b")).first()["b"]
        borders = sorted(set(found or []))
    ranged = rows.select(_range_of(F.col("doc_id"), borders).alias("range"), "doc_id", "text")
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("head"))
    up = Window.orderBy("range")
    first = F.first("head").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.lead("range").over(up).isNull()
    # One row per range, at most MAX_RANGES of two numbers.
    follows = heads.select(F.col("range").alias("for"), F.when(last, first).otherwise(F.lead("head").over(up)).alias("head"))
    tails = ranged.select("doc_id", "text").join(F.broadcast(follows), F.col("doc_id").eqNullSafe(F.col("head")))
    tails = tails.groupBy("for").agg(F.min("text").alias("text")).select(F.col("for").alias("range"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("tail"))
    order = ["range", "tail", F.col("doc_id").desc_nulls_last(), "text"]
    # Anchors are made of texts where they were dealt to, so only texts travel.
    dealt = ranged.withColumn("tail", F.lit(0)).unionByName(tails).repartition("range").sortWithinPartitions(*order)
    down = Window.partitionBy("range").orderBy(*order[1:])
    marked = with_anchors(dealt, "text", "own").withColumn("own", F.struct("own.at", "own.after"))
    pairs = marked.select("*", F.lead("text").over(down).alias("next_text"), F.lead("own").over(down).alias("next_own")).where("tail = 0")
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.left("text", F.length("text") - cut), F.left("next_text", cut))
    near = likeness(F.col("own"), F.col("next_own")).alias("near_next")
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", near)
    both = with_anchors(pairs, "edited", "changed")
    return both.select(
        "doc_id",
        "n_chars",
        "edited",
        digest(F.col("own")).alias("fingerprint"),
        digest(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        "near_next",
    )
