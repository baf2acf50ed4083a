"""Exact and near-duplicate removal, exposure filters, anti-joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import seeded_hash, surface
from tessella.operators import dedup, near_dup
from tessella.session import table
from tessella.staging import stage_table

SEED = "representative-v1"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", "n_chars", surface(F.col("text")).alias("surface"), seeded_hash(SEED, F.col("doc_id")).alias("order"))


_SURFACE = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_DOCS = f"""docs AS (
    SELECT doc_id, source, lang, n_chars, {_SURFACE} AS surface, sha256('{SEED}' || chr(31) || doc_id) AS "order" FROM documents)"""


def e1_thread_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", seeded_hash(SEED, F.col("conv_id"), F.col("turn")).alias("order"))
    return dedup.representative(rows, "conv_id", "order", "turn").select("conv_id", "turn")


def e2_surface_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per source and length class first, then one per surface: the order is part of the meaning."""
    rows = _docs(spark, sf_dir).withColumn("thread", F.concat_ws("/", "source", "n_chars"))
    first = dedup.representative(rows, "thread", "order", "doc_id")
    return dedup.representative(first, "surface", "order", "doc_id").select("doc_id")


def e3_rank_and_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).withColumn("cell", F.concat_ws("/", "lang", "source"))
    return dedup.numbered_representatives(rows, "cell", "order", "doc_id").select("doc_id", "cell", "rank", "population")


def c21_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).withColumn("digest", F.sha2("surface", 256))
    return dedup.duplicate_groups(rows, "digest", "doc_id")


def c21_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces found both in hot sources and elsewhere."""
    rows = _docs(spark, sf_dir).withColumn("digest", F.sha2("surface", 256))
    hot = F.col("source") < "src15"
    return dedup.overlap(rows.where(hot), rows.where(~hot), "digest", "doc_id", "doc_id")


def c11_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have a returned line."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    needed = line.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(needed, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


def _consumed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    orders, line, customer = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    consumed = [
        (line.where("l_returnflag = 'R' AND l_quantity > 45"), "l_orderkey", "o_orderkey"),
        (customer.where("c_mktsegment = 'BUILDING'"), "c_custkey", "o_custkey"),
        (orders.where("o_totalprice > 450000"), "o_orderdate", "o_orderdate"),
    ]
    return orders, consumed


def c13_triple_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, consumed = _consumed(spark, sf_dir)
    return dedup.drop_consumed(orders, consumed).select("o_orderkey", "o_custkey")


def c14_or_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT EXISTS with OR, as chained anti-joins."""
    orders, consumed = _consumed(spark, sf_dir)
    return dedup.drop_consumed(orders, consumed[:2]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def c15_excluded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without any order that one of three lookups excludes."""
    orders, consumed = _consumed(spark, sf_dir)
    left = dedup.drop_consumed(orders, consumed).select("o_orderkey")
    excluded = orders.join(left, "o_orderkey", "left_anti").select("o_custkey").distinct()
    return orders.join(excluded, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


def c16_identity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return dedup.identity_mismatch(orders, line, ["key"])


def c17_exposure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id, source and language, exact or normalised text no registered row has; ranking comes after."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.concat_ws("/", "source", "lang").alias("thread"), F.sha2("text", 256).alias("exact"), F.sha2(surface(F.col("text")), 256).alias("normal")
    )
    labels = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    seen = docs.join(labels, "doc_id", "left_semi")
    small = docs.where("source = 'src7'").select("thread").distinct()
    consumed = [(labels, "doc_id", "doc_id"), (small, "thread", "thread"), (seen, "exact", "exact"), (seen, "normal", "normal")]
    left = dedup.drop_consumed(docs, consumed)
    ordered = left.withColumn("order", seeded_hash(SEED, F.col("doc_id")))
    return dedup.representative(ordered, "thread", "order", "doc_id").select("doc_id", "thread")


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class representatives of equal surfaces with their SimHash and length."""
    rows = _docs(spark, sf_dir).groupBy("surface").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("members"), F.min_by("order", "doc_id").alias("order"))
    rows = rows.select("id", "members", "order", near_dup.simhash("surface").alias("print"), F.length("surface").alias("chars"))
    return stage_table(rows, "simhash-classes")


def c18_near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between classes of equal surfaces; a class is its smallest id."""
    return near_dup.near_pairs(_prints(spark, sf_dir))


def c18_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class that stands for it in ``c18_near_dup_pairs``."""
    docs = _docs(spark, sf_dir).select("doc_id", F.sha2("surface", 256).alias("digest"))
    classes = docs.groupBy("digest").agg(F.min("doc_id").alias("id"))
    return docs.join(classes, "digest").select("doc_id", "id")


def c19_near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = _prints(spark, sf_dir)
    return near_dup.near_clusters(prints, near_dup.near_links(prints), "order")


def c19_document_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: of its cluster, all copies included, the document that is first by hash."""
    prints = _prints(spark, sf_dir)
    clusters = near_dup.near_clusters(prints, near_dup.near_links(prints), "order").withColumnRenamed("representative", "cluster")
    rows = stage_table(c18_members(spark, sf_dir).join(clusters, "id").select("doc_id", "cluster"), "members")
    ordered = rows.withColumn("order", seeded_hash(SEED, F.col("doc_id")))
    best = ordered.groupBy("cluster").agg(F.min_by("doc_id", F.struct("order", "doc_id")).alias("representative"))
    return rows.join(best, "cluster").select("doc_id", "representative")


def c23_keep_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class representatives joined with the list of those that stand for their cluster."""
    prints = _prints(spark, sf_dir)
    keep = near_dup.near_clusters(prints, near_dup.near_links(prints), "order").select(F.col("representative").alias("id")).distinct()
    return prints.join(keep, "id").select("id", "members", "chars")


def c20_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of early sources against those of later ones, equal texts set aside; classes are smallest ids.

    By word trigrams, or five characters of texts under three words. A class stands on each side where it has a member.
    """
    docs = _docs(spark, sf_dir).withColumn("mark", F.xxhash64("surface"))
    sides = docs.groupBy(F.sha2("surface", 256).alias("digest")).agg(
        F.min("doc_id").alias("id"), F.first("mark").alias("mark"), F.bool_or(F.col("source") < "src15").alias("left"), F.bool_or(F.col("source") >= "src15").alias("right")
    )
    sides = stage_table(sides.where("digest IS NOT NULL AND id IS NOT NULL").select("id", "mark", "left", "right"), "jaccard-classes")
    return near_dup.similar_pairs(docs.select(F.col("doc_id").alias("id"), "mark", F.col("surface").alias("held")), sides, near_dup.text_tokens, 0.9)


_ORDERS_USED = """(EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)
    OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey AND c_mktsegment = 'BUILDING'){more})"""
_BY_DATE = " OR o.o_orderdate IN (SELECT o_orderdate FROM orders WHERE o_totalprice > 450000)"

_PRINTS = f"""{_DOCS},
    classes AS (SELECT surface, min(doc_id) AS id, arg_min("order", doc_id) AS "order", length(surface) AS chars FROM docs GROUP BY surface),
    words AS (SELECT id, surface, string_split(surface, ' ') AS w FROM classes),
    features AS (
        SELECT id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) ELSE w END) AS f FROM words),
    hashed AS (SELECT id, ('0x' || left(sha256(f), 16))::UBIGINT AS h FROM features),
    bits AS (SELECT id, count(*) AS n, {", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64))} FROM hashed GROUP BY id),
    prints AS (
        SELECT id, ({" + ".join(f"CASE WHEN 2 * b{b} >= n THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))}) AS print FROM bits),
    rows AS (SELECT id, print, chars, "order" FROM prints JOIN classes USING (id)),
    pairs AS (
        SELECT x.id AS a, y.id AS b FROM rows x JOIN rows y ON x.id < y.id AND x.chars >= 80 AND y.chars >= 80
            AND x.chars / y.chars BETWEEN 0.8 AND 1.25 AND bit_count(CAST(xor(x.print, y.print) AS BIT)) <= 3)"""

QUERIES = {
    f.__name__: f
    for f in (
        e1_thread_representative, e2_surface_representative, e3_rank_and_population, c21_duplicate_groups, c21_split_overlap, c11_semi, c13_triple_anti, c14_or_anti,
        c15_excluded_groups, c16_identity_mismatch, c17_exposure_filter, c18_near_dup_pairs, c18_members, c19_near_dup_clusters, c19_document_clusters, c20_jaccard_pairs,
        c23_keep_list,
    )
}

SQL = {
    "e1_thread_representative": f"""SELECT conv_id, turn FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY sha256('{SEED}' || chr(31) || conv_id || chr(31) || turn), turn) = 1""",
    "e2_surface_representative": f"""WITH {_DOCS},
        first AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY source, n_chars ORDER BY "order", doc_id) = 1)
        SELECT doc_id FROM first QUALIFY row_number() OVER (PARTITION BY surface ORDER BY "order", doc_id) = 1""",
    "e3_rank_and_population": f"""WITH {_DOCS}
        SELECT doc_id, lang || '/' || source AS cell, row_number() OVER (PARTITION BY lang, source ORDER BY "order", doc_id) AS rank,
            count(*) OVER (PARTITION BY lang, source) AS population FROM docs""",
    "c21_duplicate_groups": f"WITH {_DOCS} SELECT sha256(surface) AS digest, count(*) AS n, min(doc_id) AS first FROM docs GROUP BY 1 HAVING count(*) > 1",
    "c21_split_overlap": f"""WITH {_DOCS}
        SELECT sha256(surface) AS digest, count(*) FILTER (WHERE source < 'src15') AS left_n, min(doc_id) FILTER (WHERE source < 'src15') AS left_first,
            count(*) FILTER (WHERE source >= 'src15') AS right_n, min(doc_id) FILTER (WHERE source >= 'src15') AS right_first
        FROM docs GROUP BY 1 HAVING left_n > 0 AND right_n > 0""",
    "c11_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "c13_triple_anti": f"SELECT o_orderkey, o_custkey FROM orders o WHERE NOT {_ORDERS_USED.format(more=_BY_DATE)}",
    "c14_or_anti": f"SELECT o_orderpriority, count(*) AS n FROM orders o WHERE NOT {_ORDERS_USED.format(more='')} GROUP BY 1",
    "c15_excluded_groups": f"""SELECT o_orderkey, o_custkey FROM orders
        WHERE o_custkey NOT IN (SELECT o_custkey FROM orders o WHERE {_ORDERS_USED.format(more=_BY_DATE)})""",
    "c16_identity_mismatch": """WITH e AS (SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderstatus <> 'P'), o AS (SELECT DISTINCT l_orderkey AS key FROM lineitem)
        SELECT count(*) FILTER (WHERE o.key IS NULL) AS missing, count(*) FILTER (WHERE e.key IS NULL) AS unexpected,
            count(*) FILTER (WHERE e.key IS NOT NULL AND o.key IS NOT NULL) AS matched FROM e FULL OUTER JOIN o ON e.key = o.key""",
    "c17_exposure_filter": f"""WITH d AS (
            SELECT doc_id, source || '/' || lang AS thread, sha256(text) AS exact, sha256({_SURFACE}) AS normal, sha256('{SEED}' || chr(31) || doc_id) AS "order" FROM documents),
        toxic AS (SELECT doc_id FROM labels WHERE toxic = 1), seen AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM toxic)),
        kept AS (
            SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM toxic) AND thread NOT LIKE 'src7/%' AND exact NOT IN (SELECT exact FROM seen)
                AND normal NOT IN (SELECT normal FROM seen))
        SELECT doc_id, thread FROM kept QUALIFY row_number() OVER (PARTITION BY thread ORDER BY "order", doc_id) = 1""",
    "c18_near_dup_pairs": f"WITH {_PRINTS} SELECT a, b FROM pairs",
    "c19_near_dup_clusters": f"""WITH RECURSIVE {_PRINTS},
        links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach AS (SELECT id AS a, id AS b FROM rows UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT r.a AS id, arg_min(r.b, o."order") AS representative FROM reach r JOIN rows o ON r.b = o.id GROUP BY r.a""",
    "c18_members": f"WITH {_DOCS} SELECT doc_id, min(doc_id) OVER (PARTITION BY surface) AS id FROM docs",
    "c19_document_clusters": f"""WITH RECURSIVE {_PRINTS},
        links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach AS (SELECT id AS a, id AS b FROM rows UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        clusters AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a),
        members AS (SELECT doc_id, "order", min(doc_id) OVER (PARTITION BY surface) AS id FROM docs),
        best AS (SELECT cluster, arg_min(doc_id, "order") AS representative FROM members JOIN clusters USING (id) GROUP BY cluster)
        SELECT doc_id, representative FROM members JOIN clusters USING (id) JOIN best USING (cluster)""",
    "c23_keep_list": f"""WITH RECURSIVE {_PRINTS},
        links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach AS (SELECT id AS a, id AS b FROM rows UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        best AS (SELECT DISTINCT arg_min(r.b, o."order") OVER (PARTITION BY r.a) AS id FROM reach r JOIN rows o ON r.b = o.id)
        SELECT id, count(*) AS members, any_value(c.chars) AS chars FROM best JOIN classes c USING (id) JOIN docs d ON d.surface = c.surface GROUP BY id""",
    "c20_jaccard_pairs": f"""WITH {_DOCS},
        classes AS (
            SELECT min(doc_id) AS id, bool_or(source < 'src15') AS early, bool_or(source >= 'src15') AS late, surface, string_split(surface, ' ') AS w
            FROM docs GROUP BY surface HAVING length(surface) >= 30),
        grams AS (
            SELECT id, early, late, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])
                ELSE list_transform(range(1, length(surface) - 3), lambda k: substr(surface, k, 5)) END) AS g FROM classes),
        tokens AS (SELECT id, early, late, len(g) AS n, unnest(g) AS t FROM grams),
        shared AS (
            SELECT x.id AS a, y.id AS b, x.n AS xn, y.n AS yn, count(*) AS s FROM tokens x JOIN tokens y ON x.t = y.t AND x.early AND y.late AND x.id <> y.id GROUP BY ALL)
        SELECT a, b, round(s / (xn + yn - s), 6) AS jaccard FROM shared WHERE s / (xn + yn - s) >= 0.9""",
}
