"""Workbooks: XML as rows of datasources, tables, fields, worksheets, dashboards and what refers to what.

Rows of (kind, payload): datasource, connection, table, field, parameter, group, set, bin, hierarchy, worksheet, shelf,
filter, sort, blend, dashboard, zone, action, sql, formula_ref, coverage, diagnostic.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import on_cycles
from .artifacts import entities

#: Elements that the reader knows; others are reported once each.
KNOWN = set("workbook datasources datasource connection named-connections named-connection relation clause expression column calculation group groupfilter set bin drill-path drill-paths field worksheets worksheet table view datasource-dependencies column-instance rows cols filter sort shelf-sorts shelf-sort computed-sort dashboards dashboard zones zone actions action source command param members member range aliases alias cols map windows window style panes pane encodings mark metadata-records metadata-record datasource-relationships datasource-relationship column-mapping datasources caption layout semantic-values semantic-value repository-location preferences stories story".split())
_REF = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|(\[(?:[^\]]|\]\])+\])(?:\.(\[(?:[^\]]|\]\])+\]))?")


def bare(name: str | None) -> str:
    """A name without its brackets, ]] read as ]."""
    n = (name or "").strip()
    return n[1:-1].replace("]]", "]") if n.startswith("[") and n.endswith("]") else n


def plain_tag(tag: str) -> str:
    """Feature-flagged and versioned tags by their plain name."""
    return re.sub(r"^_\.fcp\.[\w]+\.(?:true|false)\.\.\.", "", tag.split("}")[-1])


def formula_refs(formula: str) -> list[dict]:
    """References of a formula with their spans: fields, fields of other sources, LOD dimensions."""
    lods = [(m.start(2), m.end(2)) for m in re.finditer(r"(?is)\{\s*(FIXED|INCLUDE|EXCLUDE)\b([^:}]*):", formula)]
    out = []
    for m in _REF.finditer(formula):
        if not m[1]:
            continue
        inside = any(a <= m.start() < b for a, b in lods)
        kind = "cross_source" if m[2] else "lod_dim" if inside else "field"
        out.append({"name": bare(m[2] or m[1]), "source": bare(m[1]) if m[2] else None, "kind": kind, "start": m.start(), "end": m.end()})
    return out


def shelf_fields(text: str) -> list[dict]:
    """Fields of a shelf: [source].[agg:field:type] or AGG([field])."""
    out = []
    for m in re.finditer(r"(?:(\w+)\s*\(\s*)?\[([^\]]+)\](?:\.\[([^\]]+)\])?", text or ""):
        source, name = (m[2], m[3]) if m[3] else (None, m[2])
        parts = name.split(":")
        agg, name = (parts[0], parts[1]) if len(parts) == 3 else (None, name)
        out.append({"source": source, "field": name, "aggregation": (m[1] or agg or None)})
    return out


def _relations(e: ET.Element) -> Iterator[ET.Element]:
    """Leaf relations of a join tree."""
    kids = [c for c in e if plain_tag(c.tag) == "relation"]
    if e.get("type") == "join" or kids:
        for c in kids:
            yield from _relations(c)
    else:
        yield e


def parse_workbook(path: str, text: str) -> Iterable[tuple[str, dict]]:
    root = ET.fromstring(text)
    out: list[tuple[str, dict]] = []
    unknown: dict[str, str] = {}
    for e in root.iter():
        e.tag = plain_tag(e.tag)
        if e.tag not in KNOWN and e.tag not in unknown:
            unknown[e.tag] = path
    out += [("coverage", {"tag": t}) for t in sorted(unknown)]
    for ds in root.findall("./datasources/datasource"):
        name = ds.get("name") or ds.get("caption")
        out.append(("datasource", {"name": name, "caption": ds.get("caption") or name, "parameters": name == "Parameters"}))
        named = {}
        for nc in ds.iter("named-connection"):
            for c in nc.iter("connection"):
                named[nc.get("name")] = c.get("dbname") or ""
                out.append(("connection", {"datasource": name, "name": nc.get("name"), "class": c.get("class"), "server": c.get("server"), "database": c.get("dbname"), "schema": c.get("schema"), "has_credentials": bool(c.get("password"))}))
        top = ds.find("connection")
        for relation in (r for c in ([top] if top is not None else []) for x in c if x.tag == "relation" for r in _relations(x)):
            kind = relation.get("type") or "table"
            if kind == "text":
                out.append(("sql", {"datasource": name, "name": relation.get("name"), "text": " ".join((relation.text or "").split())}))
            else:
                table = ".".join(bare(p) for p in re.findall(r"\[[^\]]+\]|[^.\[\]]+", relation.get("table") or relation.get("name") or ""))
                db = named.get(relation.get("connection"), "")
                out.append(("table", {"datasource": name, "kind": kind, "table": f"{db}.{table}" if db and table.count(".") < 2 else table}))
        for c in ds.findall("column"):
            calc = c.find("calculation")
            formula = calc.get("formula") if calc is not None else None
            field = {"datasource": name, "name": bare(c.get("name")), "caption": c.get("caption"), "datatype": c.get("datatype"), "role": c.get("role"), "formula": formula}
            if name == "Parameters" or c.get("param-domain-type"):
                out.append(("parameter", {"name": field["name"], "caption": field["caption"], "datatype": field["datatype"], "value": c.get("value")}))
                continue
            out.append(("field", field))
            for r in formula_refs(formula or ""):
                out.append(("formula_ref", {"datasource": name, "field": field["name"]} | r))
        for g in ds.findall("group"):
            kind = "set" if g.find("groupfilter") is not None and g.get("name-style") is None and "Set" in (g.get("caption") or g.get("name") or "") else "group"
            levels = sorted({bare(f.get("level")) for f in g.iter("groupfilter") if f.get("level")})
            out.append((kind, {"datasource": name, "name": bare(g.get("name")), "fields": levels}))
        for b in ds.findall("bin"):
            out.append(("bin", {"datasource": name, "name": bare(b.get("name")), "field": bare(b.get("source") or b.get("column"))}))
        for d in ds.iter("drill-path"):
            out.append(("hierarchy", {"datasource": name, "name": d.get("name"), "levels": [bare(f.text) for f in d.findall("field")]}))
    for ws in root.findall("./worksheets/worksheet"):
        name = ws.get("name")
        sources = [d.get("name") for d in ws.findall(".//view/datasources/datasource")]
        out.append(("worksheet", {"name": name, "datasources": sources}))
        for shelf in ("rows", "cols"):
            for e in ws.iter(shelf):
                for f in shelf_fields(e.text or ""):
                    out.append(("shelf", {"worksheet": name, "shelf": shelf, "datasource": f["source"] or (sources[0] if sources else None), "field": f["field"], "aggregation": f["aggregation"]}))
        for f in ws.iter("filter"):
            refs = shelf_fields(f.get("column") or "")
            if refs:
                out.append(("filter", {"worksheet": name, "datasource": refs[0]["source"], "field": refs[0]["field"], "class": f.get("class"), "expression": " ".join(ET.tostring(f, "unicode").split())[:512]}))
        for s in [*ws.iter("sort"), *ws.iter("computed-sort")]:
            refs = shelf_fields(s.get("column") or "")
            if refs:
                out.append(("sort", {"worksheet": name, "field": refs[0]["field"], "direction": s.get("direction")}))
        if len(sources) > 1:
            links = [bare(c.get("key")) for r in ws.iter("datasource-relationship") for c in r.iter("column-mapping") for c in c.iter("map")]
            out.append(("blend", {"worksheet": name, "primary": sources[0], "secondary": sources[1:], "linked": links}))
    for db in root.findall("./dashboards/dashboard"):
        name = db.get("name")
        out.append(("dashboard", {"name": name}))
        for z in db.iter("zone"):
            out.append(("zone", {"dashboard": name, "zone": z.get("id"), "worksheet": z.get("name") if z.get("param") is None else None, "parameter": bare(z.get("param")) if z.get("param") else None, "type": z.get("type")}))
    for a in root.iter("action"):
        params = {p.get("name"): p.get("value") for p in a.iter("param")}
        origins = [s.get("worksheet") for s in a.iter("source") if s.get("worksheet")]
        targets = [t for t in (params.get("target") or "").split(",") if t]
        kind = (a.find("command").get("command") if a.find("command") is not None else "") or ""
        out += [("action", {"name": a.get("caption") or a.get("name"), "kind": kind.rsplit(":", 1)[-1], "source": s, "target": t}) for s in origins or [None] for t in targets or [None]]
    return out


def unpack(content: bytes) -> str:
    """The workbook inside a packaged one, or the bytes' own text."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            content = z.read(next(n for n in z.namelist() if n.endswith(".twb")))
    return content.decode("utf-8", "replace")


FIELD = "datasource string, name string, caption string, datatype string, role string, formula string"
REF = "datasource string, field string, name string, source string, kind string, start int, `end` int"


def field_dependencies(parsed: DataFrame) -> DataFrame:
    """(path, datasource, field, depends_on): formula fields on fields of their datasource, by name or caption.

    References to the field itself and to nothing known go; so do all edges out of fields on a cycle.
    """
    fields = entities(parsed, "field", FIELD)
    names = fields.select("path", "datasource", F.explode(F.array_distinct(F.array("name", F.coalesce("caption", "name")))).alias("ref"), F.col("name").alias("depends_on"))
    refs = entities(parsed, "formula_ref", REF).filter("source IS NULL").select("path", "datasource", "field", F.col("name").alias("ref"))
    edges = refs.join(names, ["path", "datasource", "ref"]).filter("field <> depends_on").select("path", "datasource", "field", "depends_on").distinct()
    tag = lambda c: F.concat_ws("|", "path", "datasource", c)
    cyclic = on_cycles(edges.select(tag("field").alias("src"), tag("depends_on").alias("dst")), 20)
    return edges.withColumn("id", tag("field")).join(cyclic, "id", "left_anti").drop("id")


def cross_source_refs(parsed: DataFrame) -> DataFrame:
    """(path, datasource, field, to_source, to_field): references to other datasources and to parameters that exist."""
    refs = entities(parsed, "formula_ref", REF).filter("source IS NOT NULL")
    sources = entities(parsed, "datasource", "name string, caption string").select("path", F.explode(F.array_distinct(F.array("name", "caption"))).alias("source"), F.col("name").alias("to_source"))
    fields = entities(parsed, "field", FIELD).select("path", F.col("datasource").alias("to_source"), F.explode(F.array_distinct(F.array("name", F.coalesce("caption", "name")))).alias("name"), F.col("name").alias("to_field"))
    params = entities(parsed, "parameter", "name string, caption string").select("path", F.lit("Parameters").alias("to_source"), F.explode(F.array_distinct(F.array("name", F.coalesce("caption", "name")))).alias("name"), F.col("name").alias("to_field"))
    known = fields.unionByName(params)
    return refs.join(sources, ["path", "source"]).join(known, ["path", "to_source", "name"]).select("path", "datasource", "field", "to_source", "to_field").distinct()


def dashboard_tables(parsed: DataFrame) -> DataFrame:
    """(path, dashboard, worksheet, datasource, table): tables behind a dashboard."""
    zones = entities(parsed, "zone", "dashboard string, worksheet string").filter("worksheet IS NOT NULL")
    sheets = entities(parsed, "worksheet", "name string, datasources array<string>").select("path", F.col("name").alias("worksheet"), F.explode("datasources").alias("datasource"))
    tables = entities(parsed, "table", "datasource string, `table` string")
    return zones.join(sheets, ["path", "worksheet"]).join(tables, ["path", "datasource"]).select("path", "dashboard", "worksheet", "datasource", "table").distinct()
