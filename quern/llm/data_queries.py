"""The queries of the problems tagged for training data, with SQL for a second engine where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.sql import CURRENT_CLASSES, CURRENT_FUNCTIONS
from ..sources.tables import table
from . import documented, near_duplicates, neighbors, packing, pieces, reading, tokens


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.code_pieces(table(spark, d, "code_functions"), table(spark, d, "code_classes"))


def p1_joined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces put together again without what each repeats: the code as it was."""
    return pieces.joined(p1_pieces(spark, d)).withColumnRenamed("text", "code")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("piece_no = 0").select("seq")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.nearest_neighbours(table(spark, d, "code_vectors"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.similar_pairs(table(spark, d, "code_vectors"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_functions(table(spark, d, "code_functions")).pairs()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_functions(table(spark, d, "code_functions")).groups()


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented.described(table(spark, d, "code_functions"), table(spark, d, "code_classes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select("seq")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decoded(tokens.token_ids(table(spark, d, "documents")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(tokens.token_counts(table(spark, d, "documents")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rate(p8_containers(spark, d))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(spark, table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p9_held_out(spark: SparkSession, d: str) -> DataFrame:
    return reading.held_out(spark, table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding(p9_levels(spark, d)).select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_pieces": p1_pieces, "p1_joined": p1_joined, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_pairs": p5_pairs, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_containers": p8_containers, "p8_fill": p8_fill,
    "p9_found": p9_found, "p9_levels": p9_levels, "p9_held_out": p9_held_out,
}

ORACLES = {
    "p1_found": f"select seq from ({CURRENT_FUNCTIONS}) where length(code) > 2000 union all select seq from ({CURRENT_CLASSES}) where length(code) > 2000",
    "p2_found": """with v as (select vec_id, id, list_transform(embedding, lambda x: x::double) e from code_vectors where embedding is not null and len(embedding) = 64
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)
select a.vec_id as vec_a, b.vec_id as vec_b from v a join v b on a.vec_id < b.vec_id and a.id is distinct from b.id
where list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))""",
    "p4_found": f"""with cur as (select seq, repo, clean_path, list_transform(regexp_extract_all(code, '[A-Za-z0-9_]+'), lambda w: lower(w)) as w from ({CURRENT_FUNCTIONS}) where code is not null),
s as (select seq, repo, clean_path, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as g from cur where len(w) >= 20),
n as (select seq, count(*) as n from s group by seq),
both_ as (select a.seq as seq_a, b.seq as seq_b, count(*) as k from s a join s b on a.g = b.g and a.seq < b.seq and (a.repo is distinct from b.repo or a.clean_path is distinct from b.clean_path) group by all)
select seq_a, seq_b from both_ join n x on x.seq = seq_a join n y on y.seq = seq_b where 10 * k >= 6 * (x.n + y.n - k)""",
    "p1_joined": f"select seq, code from ({CURRENT_FUNCTIONS}) where length(code) > 2000 union all select seq, code from ({CURRENT_CLASSES}) where length(code) > 2000",
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
