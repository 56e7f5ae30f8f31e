"""References to records that do not exist.

Distinct (field, key, moment) triples are anti-joined with the parents' life spans; what is left is
joined back to the references.  The anti-join is spread by estimated load, so that a key that holds a
third of all references is worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.intervals import merge_intervals
from codeloom.operators.skew import balanced_join, plan_loads

REFERENCE_COLUMNS = ("ref_table", "ref_field", "ref_id", "key_kind", "key", "seen_at")


def references(edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """All non-null references as rows of REFERENCE_COLUMNS; ``key_kind`` says what the key names (id or label)."""

    def of(df: DataFrame, ref_table: str, field: str, ident: str, kind: str) -> DataFrame:
        return df.where(F.col(field).isNotNull()).select(F.lit(ref_table).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(ident).alias("ref_id"), F.lit(kind).alias("key_kind"), F.col(field).alias("key"), F.col("seen_at"))

    return of(edges, "edges", "target", "edge_id", "id").unionByName(of(unresolved, "unresolved_refs", "ref_name", "ref_id", "label")).unionByName(of(unresolved, "unresolved_refs", "source_node_id", "ref_id", "id"))


def life_spans(*node_tables: DataFrame) -> DataFrame:
    """Disjoint (kind, key, born, gone) spans in which a node with that id or label existed."""
    spans = None
    for nodes in node_tables:
        for kind, field in (("id", "id"), ("label", "label")):
            one = nodes.where(F.col(field).isNotNull()).select(F.concat_ws("\x1f", F.lit(kind), F.col(field)).alias("kind_key"), F.col("first_seen_at").alias("born"), F.col("removed_at").alias("gone"))
            spans = one if spans is None else spans.unionByName(one)
    return merge_intervals(spans, ["kind_key"], "born", "gone", F.to_date("born"))


def orphan_references(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``refs`` whose key named nothing at the moment they were seen.

    Null keys are no references.  A null moment lies in no span, so such a reference is an orphan.
    A span holds its start and not its end.  Repeated rows stay repeated; callers count distinct ids.
    """
    plain = refs.where(F.col("key").isNotNull()).withColumn("kind_key", F.concat_ws("\x1f", "key_kind", "key"))
    moments = plain.select("kind_key", "seen_at").distinct()
    plan = plan_loads(moments, "kind_key")  # by what is joined, not by what refers to it
    alive = (F.col("born") <= F.col("seen_at")) & (F.col("gone").isNull() | (F.col("seen_at") < F.col("gone")))
    missing = balanced_join(moments, spans, "kind_key", "left_anti", F.col("seen_at"), plan, alive)
    missing = missing.select(F.col("kind_key").alias("_kk"), F.col("seen_at").alias("_seen"))
    back = (F.col("kind_key") == F.col("_kk")) & F.col("seen_at").eqNullSafe(F.col("_seen"))
    return plain.join(missing, back, "left_semi").drop("kind_key")


def orphan_report(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per table, field and month: distinct references, orphans and their rate.  A null moment has a null month."""
    month = F.date_format(F.trunc("seen_at", "month"), "yyyy-MM")
    found = orphan_references(refs, spans).select("ref_table", "ref_field", "ref_id").distinct().withColumn("_orphan", F.lit(1))
    each = refs.where(F.col("key").isNotNull()).groupBy("ref_table", "ref_field", "ref_id").agg(F.min("seen_at").alias("seen_at"))
    joined = each.join(found, ["ref_table", "ref_field", "ref_id"], "left")
    counted = joined.groupBy("ref_table", "ref_field", month.alias("period")).agg(F.count(F.lit(1)).alias("n_refs"), F.count("_orphan").alias("n_orphans"))
    return counted.withColumn("orphan_rate", F.round(F.col("n_orphans") / F.col("n_refs"), 6))
