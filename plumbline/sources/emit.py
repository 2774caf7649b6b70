"""Emitters: graph documents, bills of materials, risk maps, split units.

Everything is ordered before it leaves, so equal graphs give equal bytes.
Rows are shaped in Spark; only rendered documents of one run reach the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import purl as P
from plumbline.functions.scalars import severity_rank

LEVELS = ("resolved", "inferred", "declared", "opaque")


def summary(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals by completeness and the distinct reasons, in order."""
    level = F.col("completeness")
    reasons = F.array_sort(F.collect_set(F.nullif("reason", F.lit(""))))
    return nodes.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("nodes"), *[F.count_if(level == x).alias(x) for x in LEVELS], reasons.alias("bounds_hit"))


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``section, ord_key, line``: a document as lines - nodes by id, edges in
    the total order of their five fields, then the summary - for any size."""
    node = nodes.select(F.lit("1 node").alias("section"), F.to_json(F.struct("id")).alias("ord_key"), F.to_json(F.struct(*sorted(nodes.columns))).alias("line"))
    fields = ("from_id", "to_id", "kind", "spec", "scope")
    edge = edges.select(*fields).distinct().select(F.lit("2 edge").alias("section"), F.to_json(F.struct(*fields)).alias("ord_key"), F.to_json(F.struct(*fields)).alias("line"))
    total = summary(nodes).select(F.lit("3 summary").alias("section"), F.lit("").alias("ord_key"), F.to_json(F.struct("*")).alias("line"))
    return node.unionByName(edge).unionByName(total).orderBy("section", "ord_key")


def json_document(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, document``: one JSON document per run, bounded by the node bound."""
    n = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in sorted(nodes.columns) if c not in (*keys, "id")]))).alias("nodes"))
    e = edges.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("from_id", "to_id", "kind", "spec", "scope"))).alias("edges"))
    s = summary(nodes, keys).select(*keys, F.struct("nodes", *LEVELS, "bounds_hit").alias("summary"))
    return n.join(e, keys, "left").join(s, keys).select(*keys, F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges"), "summary")).alias("document"))


# --- CycloneDX --------------------------------------------------------------------


def component_type(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.startswith("pkg:oci/"), "container").when(x.startswith("pkg:github/") | x.startswith("pkg:gitlab/"), "application").when(P.is_build_file(x), "file").otherwise("library")


#: Licence identifiers commonly seen; more come as a table.
SPDX_IDS = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BlueOak-1.0.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
    "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MulanPSL-2.0",
    "NCSA", "OFL-1.1", "OpenSSL", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "Unicode-3.0", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)


def licence_slot(licence: Column, ids: tuple[str, ...] = SPDX_IDS) -> Column:
    """``struct<slot, value>``: an expression, a known id, or a name; null for
    what says nothing."""
    expression = licence.rlike(r"[()]| OR | AND | WITH ")
    slot = F.when(expression, "expression").when(licence.isin(*ids), "id").otherwise("name")
    return F.when((licence != "") & (F.lower(licence) != "non-standard"), F.struct(slot.alias("slot"), licence.alias("value")))


def components(nodes: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Component rows: no shell steps; frontier nodes carry their reason."""
    rows = nodes.where(~F.col("id").startswith("pkg:generic/opaque@"))
    if facts is not None:
        rows = rows.join(facts.select(F.col("node_id").alias("id"), "licenses"), "id", "left")
    else:
        rows = rows.withColumn("licenses", F.lit(None).cast("array<string>"))
    slots = F.array_compact(F.transform(F.coalesce("licenses", F.array().cast("array<string>")), lambda x: licence_slot(x)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    frontier = (text("reason") != "") & F.col("completeness").isin("declared", "opaque")
    supplier = F.when(F.col("id").startswith("pkg:github/"), F.split_part(text("name"), F.lit("/"), F.lit(1)))
    return rows.select(
        component_type("id").alias("type"), F.col("id").alias("bom_ref"), text("name").alias("name"), text("version").alias("version"), F.col("id").alias("purl"), supplier.alias("supplier"),
        slots.alias("licenses"), F.when(frontier, text("reason")).alias("frontier"), text("completeness").alias("completeness"),
    )


def cyclonedx(run: dict, nodes: DataFrame, edges: DataFrame, facts: DataFrame | None = None) -> dict:
    """A CycloneDX 1.6 document of one run (bounded by the node bound)."""
    rows = [r.asDict(recursive=True) for r in components(nodes, facts).orderBy("bom_ref").toLocalIterator()]
    refs = {r["bom_ref"] for r in rows} | {run["root"]}
    links: dict[str, list[str]] = {}
    for e in edges.select("from_id", "to_id").distinct().orderBy("from_id", "to_id").toLocalIterator():
        if e["from_id"] in refs and e["to_id"] in refs:
            links.setdefault(e["from_id"], []).append(e["to_id"])
    body = []
    for r in rows:
        if r["bom_ref"] == run["root"]:
            continue
        item = {"type": r["type"], "bom-ref": r["bom_ref"], "name": r["name"], "version": r["version"], "purl": r["purl"]}
        if r["supplier"]:
            item["supplier"] = {"name": r["supplier"]}
        slots = [x for x in r["licenses"]]
        alone = [x for x in slots if x["slot"] == "expression"]
        if alone and len(slots) == 1:
            item["licenses"] = [{"expression": alone[0]["value"]}]
        elif slots:
            item["licenses"] = [{"license": {("name" if x["slot"] == "expression" else x["slot"]): x["value"]}} for x in slots]
        properties = [{"name": "completeness", "value": r["completeness"]}] + ([{"name": "frontier", "value": r["frontier"]}] if r["frontier"] else [])
        body.append(item | {"properties": properties})
    return {
        "bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "serialNumber": f"urn:uuid:{run['uuid']}",
        "metadata": {"timestamp": run["created_at"], "authors": [{"name": run.get("author") or run["target"]}], "component": {"type": "application", "bom-ref": run["root"], "name": run["target"], "version": run.get("ref", "")}},
        "components": body, "dependencies": [{"ref": ref, "dependsOn": links.get(ref, [])} for ref in sorted(refs)],
    }


def formulation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``file, step, to_id, kind, note``: what each build file does, in document
    order, each node where it is first seen. ``edges`` carry ``ord``."""
    built = edges.where(P.is_build_file("from_id"))
    first = built.withColumn("__rn", F.row_number().over(Window.partitionBy("from_id", "to_id").orderBy("ord"))).where("__rn = 1")
    numbered = first.withColumn("step", F.row_number().over(Window.partitionBy("from_id").orderBy("ord", "to_id")))
    notes = nodes.select(F.col("id").alias("to_id"), "note")
    return numbered.join(notes, "to_id", "left").select(F.regexp_extract("from_id", "#(.*)$", 1).alias("file"), "step", "to_id", "kind", "note")


# --- Mermaid ----------------------------------------------------------------------


def risk_map_rows(files: DataFrame, findings: DataFrame, most_files: int = 12, most_hits: int = 6) -> DataFrame:
    """``file, weight, hits, node, label, place``: the worst files and the worst
    nodes in each. ``files``: ``file, names``."""
    hits = files.select("file", F.explode("names").alias("node_id")).distinct().join(findings.select("node_id", "label"), "node_id")
    per = hits.groupBy("file", "node_id").agg(F.max_by("label", severity_rank(F.col("label"))).alias("label"), F.max(severity_rank(F.col("label"))).alias("rank"))
    ranked = per.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("rank"), "node_id")))
    total = per.groupBy("file").agg(F.sum("rank").alias("weight"), F.count(F.lit(1)).alias("hits")).orderBy(F.desc("weight"), "file").limit(most_files)
    return ranked.join(F.broadcast(total), "file").where(F.col("place") <= most_hits).select("file", "weight", "hits", F.col("node_id").alias("node"), "label", "place")


def mermaid(rows: DataFrame, title: str = "repository") -> str:
    """A flow chart of risk_map_rows(): bounded by files times hits."""
    got = sorted((r.asDict() for r in rows.collect()), key=lambda r: (-r["weight"], r["file"], r["place"]))
    safe = lambda x: re.sub(r'["\[\]{}|<>]', " ", x)
    out, seen = ["flowchart LR", f'  root["{safe(title)}"]'], {}
    for r in got:
        if r["file"] not in seen:
            seen[r["file"]] = f"f{len(seen)}"
            out += [f'  {seen[r["file"]]}["{safe(r["file"])}"]', f"  root --> {seen[r['file']]}"]
            if r["hits"] > 6:
                out.append(f'  {seen[r["file"]]} --> {seen[r["file"]]}more["{r["hits"] - 6} more"]')
        node = f"{seen[r['file']]}n{r['place']}"
        out.append(f'  {seen[r["file"]]} --> {node}["{safe(r["node"])}"]:::{r["label"].lower()}')
    colours = (("malicious", "#7f1d1d"), ("critical", "#b91c1c"), ("high", "#ea580c"), ("moderate", "#d97706"), ("low", "#65a30d"), ("unknown", "#6b7280"))
    return "\n".join(out + [f"  classDef {k} fill:{v},color:#fff" for k, v in colours]) + "\n"
