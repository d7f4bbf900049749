"""Processed documents (one JSON tree each) as normalised tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One wide schema for all kinds of rows; `kind` tells which columns count.
SCHEMA = (
    "doc string, kind string, path string, parent_path string, org_path string, type_key string, ident string, ord long, depth int, title string, text string, annotation string, "
    "summary_1 string, summary_2 string, table_html string, breakpoints array<struct<pos:int,prio:int>>, notes array<struct<id:string,text:string>>, context array<struct<type:string,id:string>>, "
    "term string, value string, scope string, def_kind string, source_type string, source_number string, external_reference string, quality_checked boolean, ref_type string, ref_value string, "
    "operational int, is_sub_unit boolean, data_table int, name_plural string"
)
_ORG_FIELDS = ("unit_title", "unit_definitions", "summary_1", "summary_2", "indirect_definitions")


def _context(raw: list | None) -> list[dict]:
    """Both encodings of a context: {type: id} and {name, number}."""
    out = []
    for entry in raw or []:
        if "name" in entry and "number" in entry:
            out.append({"type": str(entry["name"]), "id": str(entry["number"])})
        else:
            out += [{"type": str(k), "id": str(v)} for k, v in entry.items()]
    return out


def flatten(name: str, tree: dict) -> Iterator[dict]:
    """All rows of a document: unit types, org units, units with their sub-units, definitions and needed references."""
    info = tree.get("document_information", {})
    types = {str(k): v for k, v in info.get("parameters", {}).items()}
    ord_ = 0

    def row(kind: str, **more: object) -> dict:
        nonlocal ord_
        ord_ += 1
        return {"doc": name, "kind": kind, "ord": ord_ - 1, **more}

    def definitions(entries: list | None, kind: str, path: str) -> Iterator[dict]:
        for d in entries or []:
            if isinstance(d, dict) and "term" in d:
                keep = ("term", "value", "scope", "def_kind", "external_reference", "quality_checked")
                yield row("definition", path=path, type_key=kind, **{k: d.get(k) for k in keep}, **{k: None if d.get(k) is None else str(d[k]) for k in ("source_type", "source_number")})

    yield row("document", path="", title=info.get("title"), text=info.get("long_title"), context=_context(info.get("content_scope")))
    for k, p in types.items():
        yield row("unit_type", ident=k, type_key=p.get("name"), name_plural=p.get("name_plural"), operational=p.get("operational"), is_sub_unit=bool(p.get("is_sub_unit")), data_table=int(bool(p.get("data_table"))))
    yield from definitions(info.get("document_definitions"), "document", "")

    def orgs(node: dict, path: str, depth: int) -> Iterator[dict]:
        for level, members in node.items():
            if level in _ORG_FIELDS or level.startswith(("begin_", "stop_")) or not isinstance(members, dict):
                continue
            for ident, child in members.items():
                here = f"{path}/{level}_{ident}".lstrip("/")
                yield row("org", path=here, parent_path=path or None, type_key=level, ident=str(ident), depth=depth, title=child.get("unit_title"), summary_1=child.get("summary_1"), summary_2=child.get("summary_2"))
                yield from definitions(child.get("unit_definitions"), "org", here)
                yield from orgs(child, here, depth + 1)

    yield from orgs(info.get("organization", {}).get("content", {}), "", 0)

    def units(kind: str, members: dict, parent: str | None, depth: int) -> Iterator[dict]:
        for ident, u in members.items():
            path = f"{parent or ''}/{kind}_{ident}".lstrip("/")
            context = _context(u.get("context"))
            yield row(
                "unit", path=path, parent_path=parent, type_key=kind, ident=str(ident), depth=depth, title=u.get("unit_title"), text=u.get("text"), annotation=u.get("annotation"),
                summary_1=u.get("summary_1"), summary_2=u.get("summary_2"), table_html=u.get("table_html"), context=context, org_path="/".join(f"{c['type']}_{c['id']}" for c in context),
                breakpoints=[{"pos": p, "prio": q} for p, q in u.get("breakpoints") or []], notes=[{"id": str(k), "text": v} for k, v in (u.get("notes") or {}).items()],
            )
            yield from definitions(u.get("defined_terms"), "unit", path)
            yield from definitions(u.get("ext_definitions"), "ext", path)
            for need in u.get("need_ref") or []:
                yield row("need_ref", path=path, ref_type=need.get("type"), ref_value=None if need.get("value") is None else str(need["value"]))
            for sub, inner in (u.get("sub_units") or {}).items():
                if isinstance(inner, dict):
                    yield from units(types.get(str(sub), {}).get("name") or str(sub), inner, path, depth + 1)

    for p in types.values():
        if not p.get("is_sub_unit") and isinstance(tree.get("content", {}).get(p.get("name_plural")), dict):
            yield from units(p.get("name"), tree["content"][p["name_plural"]], None, 0)


_STRUCTS = {
    "breakpoints": pa.list_(pa.struct([("pos", pa.int32()), ("prio", pa.int32())])), "notes": pa.list_(pa.struct([("id", pa.string()), ("text", pa.string())])),
    "context": pa.list_(pa.struct([("type", pa.string()), ("id", pa.string())])),
}
_SIMPLE = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_ARROW = pa.schema([(c.split(" ")[0], _STRUCTS.get(c.split(" ")[0]) or _SIMPLE[c.split(" ")[1]]) for c in SCHEMA.replace("array<struct<pos:int,prio:int>>", "x").replace("array<struct<id:string,text:string>>", "x").replace("array<struct<type:string,id:string>>", "x").split(", ")])


def rows_of(files: DataFrame) -> DataFrame:
    """All rows of files(path, content).  Files that aren't such documents give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    tree = json.loads(content)
                except ValueError:
                    continue
                if isinstance(tree, dict) and {"document_information", "content"} <= tree.keys():
                    rows = list(flatten(path, tree))
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    return rows_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The rows by kind, as documents, unit_types, orgs, units, definitions and need_refs."""
    of = lambda k: rows.where(F.col("kind") == k)
    return {
        "documents": of("document").select(F.col("doc").alias("doc_id"), "title", F.col("text").alias("long_title"), F.col("context").alias("content_scope")),
        "unit_types": of("unit_type").select(F.col("doc").alias("doc_id"), F.col("ident").alias("param_key"), "type_key", "name_plural", "operational", "is_sub_unit", "data_table"),
        "orgs": of("org").select(F.col("doc").alias("doc_id"), F.col("path").alias("org_path"), "parent_path", F.col("type_key").alias("level_type"), F.col("ident").alias("level_id"), "depth", "ord", F.col("title").alias("unit_title"), "summary_1", "summary_2"),
        "units": of("unit").select(F.col("doc").alias("doc_id"), F.col("path").alias("unit_path"), F.col("parent_path").alias("parent_unit_path"), "org_path", "type_key", F.col("ident").alias("unit_id"), "ord", "depth", F.col("title").alias("unit_title"), "text", "annotation", "summary_1", "summary_2", "table_html", "breakpoints", "notes", "context"),
        "definitions": of("definition").select(F.col("doc").alias("doc_id"), F.col("ord").alias("def_id"), F.col("type_key").alias("location_kind"), F.col("path").alias("location_path"), "term", "value", "scope", "def_kind", "source_type", "source_number", "external_reference", "quality_checked"),
        "need_refs": of("need_ref").select(F.col("doc").alias("doc_id"), F.col("path").alias("unit_path"), "ref_type", "ref_value", "ord"),
    }


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each parsed file that a manifest lists: manifest, parser_type, file, type, organizational_units."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*manifest*.json").schema("parser_type string, source_type string, source_hash string, parsed_files array<struct<file:string,type:string,organizational_units:map<string,string>>>").json(path)
    return raw.select(F.input_file_name().alias("manifest"), F.coalesce("parser_type", "source_type").alias("parser_type"), "source_hash", F.explode("parsed_files").alias("f")).select("manifest", "parser_type", "source_hash", "f.*")


def filtered(files: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Manifest rows whose organizational units are as wanted."""
    for k, v in wanted.items():
        files = files.where(F.try_element_at("organizational_units", F.lit(k)) == v)
    return files
