"""The corpus registry's statements as rewrites of its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def documents_added(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by file_path: new values win, but metadata stays where none is given."""
    old = corpus.select("file_path", F.col("doc_id").alias("_id"), F.col("metadata").alias("_meta"))
    rows = new.join(old, "file_path", "left").withColumns({"doc_id": F.coalesce("_id", "doc_id"), "metadata": F.coalesce("metadata", "_meta")}).drop("_id", "_meta")
    return corpus.join(new.select("file_path"), "file_path", "left_anti").unionByName(rows.select(corpus.columns))


def _set(rows: DataFrame, key: str, ids: list, new: dict[str, Column]) -> DataFrame:
    hit = F.col(key).isin(ids)
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def resolved(refs: DataFrame, ref_id: int, target: int, item_type: str | None, item_number: str | None, method: str, now: Column) -> DataFrame:
    return _set(refs, "ref_id", [ref_id], {"status": F.lit("resolved"), "target_doc_id": F.lit(target), "target_item_type": F.lit(item_type).cast("string"), "target_item_number": F.lit(item_number).cast("string"), "resolution_method": F.lit(method), "resolved_at": now})


def marked(refs: DataFrame, ref_id: int, status: str, notes: str) -> DataFrame:
    """ambiguous or not_in_corpus; targets stay as they were."""
    return _set(refs, "ref_id", [ref_id], {"status": F.lit(status), "notes": F.lit(notes)})


def reset(refs: DataFrame, ref_id: int) -> DataFrame:
    none = {c: F.lit(None).cast(t) for c, t in refs.dtypes if c in ("target_doc_id", "target_item_type", "target_item_number", "resolution_method", "resolved_at", "notes")}
    return _set(refs, "ref_id", [ref_id], {"status": F.lit("unresolved"), **none})


def without_document(refs: DataFrame, doc_id: int) -> DataFrame:
    return refs.where(F.col("source_doc_id") != doc_id)


def without_items(refs: DataFrame, items: DataFrame) -> DataFrame:
    """References whose source item isn't among items(source_doc_id, source_item_type, source_item_number)."""
    return refs.join(items, ["source_doc_id", "source_item_type", "source_item_number"], "left_anti")


def selected(refs: DataFrame, source_doc_id: int | None = None, status: str | None = None) -> DataFrame:
    if source_doc_id is not None:
        refs = refs.where(F.col("source_doc_id") == source_doc_id)
    if status is not None:
        refs = refs.where(F.col("status") == status)
    return refs.orderBy("source_doc_id", "ref_id")


def stats(corpus: DataFrame, refs: DataFrame) -> DataFrame:
    """Documents, references and references by status, as name and count."""
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count(corpus, "documents").unionByName(count(refs, "references")).unionByName(refs.groupBy(F.concat(F.lit("status "), F.col("status")).alias("name")).agg(F.count("*").alias("n")))


def links_added(links: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore, by parent and child."""
    return links.unionByName(new.join(links, ["parent_doc_id", "child_doc_id"], "left_anti").dropDuplicates(["parent_doc_id", "child_doc_id"]))


def by_parser(corpus: DataFrame) -> DataFrame:
    """Documents of each parser, and how far they are."""
    return corpus.groupBy("parser_type").agg(F.count("*").alias("n_docs"), *[F.count_if(F.col("stage_reached") >= s).alias(f"n_stage_{s}") for s in (1, 2, 3)])


def extracted(needs: DataFrame, definitions: DataFrame, leaves_only: DataFrame | None = None) -> DataFrame:
    """External references of units and of definitions wherever they stand, each once.

    leaves_only: rows (doc_id, unit_path) of leaves; units' references elsewhere are then left out."""
    need = needs.where("ref_type = 'External'")
    if leaves_only is not None:
        need = need.join(leaves_only.select("doc_id", "unit_path"), ["doc_id", "unit_path"], "left_semi")
    a = need.select("doc_id", F.col("unit_path").alias("source_path"), F.col("ref_value").alias("ref_text"), F.lit("need_ref").alias("ref_context"), F.lit(None).cast("string").alias("term"))
    b = definitions.where("coalesce(external_reference, '') <> ''").select("doc_id", F.col("location_path").alias("source_path"), F.col("external_reference").alias("ref_text"), F.lit("definition").alias("ref_context"), "term")
    return a.unionByName(b).distinct()
