"""Change rows from entity revisions.

Revisions of an entity are read in order by one task as a stream (sorted within partitions), with only the last stored revision
held. Deleted and unreadable revisions are skipped; one without a change isn't stored and doesn't become the previous one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Pseudo properties, and the missing value.
LABEL, DESCRIPTION, SITELINK = -1, -2, -3
MISSING = "{}"
SCHEMA = (
    "kind string, revision_id long, prev_revision_id long, entity_id long, ts timestamp, property_id int, value_id string, old_value string, new_value string, old_datatype string, "
    "new_datatype string, change_target string, action string, target string, sub_property_id int, value_hash string, ref_hash string, entity_label string"
)


def compact(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True) if value else MISSING


def homogenize(value: object) -> object:
    """Datavalues that mean the same written alike: no altitude, before and after; years without leading zeros; ids from numeric ids."""
    if not isinstance(value, dict):
        return value
    v = {k: x for k, x in value.items() if k not in ("altitude", "before", "after")}
    if isinstance(v.get("time"), str) and v["time"][:1] in "+-":
        sign, rest = v["time"][0], v["time"][1:].lstrip("0")
        v["time"] = sign + (rest if not rest.startswith("-") else "0" + rest)
    if "numeric-id" in v and not v.get("id"):
        v["id"] = ("P" if v.get("entity-type") == "property" else "Q") + str(v["numeric-id"])
    return v


def parse_datavalue(snak: dict) -> tuple[str, str, dict[str, str]]:
    """(value, datatype, metadata) of a snak."""
    if snak.get("snaktype") in ("novalue", "somevalue"):
        return json.dumps(snak["snaktype"]), "string", {}
    data = snak.get("datavalue") or {}
    kind, v = data.get("type", "string"), homogenize(data.get("value"))
    if kind == "globecoordinate" and isinstance(v, dict):
        return compact({k: v.get(k) for k in ("latitude", "longitude")}), kind, {k: str(v[k]) for k in ("precision", "globe") if v.get(k) is not None}
    if kind == "quantity" and isinstance(v, dict):
        meta = {k: str(v[k]) for k in ("lowerBound", "upperBound") if v.get(k) is not None}
        return compact(v.get("amount")), kind, meta | ({"unit": str(v["unit"]).rsplit("/", 1)[-1]} if v.get("unit") else {})
    if kind == "time" and isinstance(v, dict):
        meta = {k: str(v[k]) for k in ("precision", "timezone") if v.get(k) is not None}
        return compact(v.get("time")), kind, meta | ({"calendarmodel": str(v["calendarmodel"]).rsplit("/", 1)[-1]} if v.get("calendarmodel") else {})
    if kind == "monolingualtext" and isinstance(v, dict):
        return compact(v.get("text")), kind, {"language": str(v.get("language"))}
    if isinstance(v, dict) and "id" in v:
        return compact(v["id"]), kind, {}
    return compact(v), kind, {}


def value_hash(snak: dict) -> str:
    if snak.get("snaktype") in ("novalue", "somevalue"):
        return snak.get("hash") or hashlib.sha1(snak["snaktype"].encode()).hexdigest()
    return hashlib.sha1(json.dumps(homogenize((snak.get("datavalue") or {}).get("value")), separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def _number(pid: str) -> int:
    return int(pid.lstrip("PQ"))


def flatten(entity: dict) -> dict:
    """What revisions are compared by."""
    statements = {}
    for pid, claims in (entity.get("claims") or {}).items():
        for c in claims:
            snak = c.get("mainsnak", {})
            value, kind, meta = parse_datavalue(snak)
            refs = set()
            for r in c.get("references") or []:
                snaks = sorted((_number(p), value_hash(s)) for p, ss in (r.get("snaks") or {}).items() for s in ss)
                whole = hashlib.sha1(json.dumps(snaks).encode()).hexdigest()
                refs |= {(whole, _number(p), value_hash(s), parse_datavalue(s)[0]) for p, ss in (r.get("snaks") or {}).items() for s in ss}
            qualifiers = {(_number(p), value_hash(s), parse_datavalue(s)[0]) for p, ss in (c.get("qualifiers") or {}).items() for s in ss}
            statements[c.get("id"), _number(pid)] = {"value": value, "kind": kind, "meta": meta, "hash": value_hash(snak), "rank": c.get("rank", "normal"), "qualifiers": qualifiers, "references": refs}

    def english(part: str) -> str | None:
        x = entity.get(part) or {}
        return (x.get("en") or {}).get("value") if isinstance(x, dict) else None

    links = entity.get("sitelinks") or {}
    return {
        "statements": statements, "label": english("labels"), "description": english("descriptions"), "redirect": "redirect" in entity,
        "sitelinks": {k: v.get("title") for k, v in links.items()} if isinstance(links, dict) else {},
    }


def diff(old: dict | None, new: dict) -> list[dict]:
    """Change rows between two flattened revisions; without an old one its creation, whose first row says ENTITY."""
    out: list[dict] = []

    def row(kind: str, target: str, action: str, prop: int, value_id: str, **more) -> None:
        out.append({"kind": kind, "target": target, "action": action, "property_id": prop, "value_id": value_id, "change_target": "", "old_value": MISSING, "new_value": MISSING} | more)

    before = old["statements"] if old else {}
    after = new["statements"]
    known, present = {p for _, p in before}, {p for _, p in after}
    empty = {"value": MISSING, "kind": None, "meta": {}, "rank": None, "qualifiers": set(), "references": set(), "hash": None}
    for key in sorted(before.keys() | after.keys(), key=lambda k: (k[1], str(k[0]))):
        sid, prop = key
        a, b = before.get(key, empty), after.get(key, empty)
        if key not in before:
            row("value", "PROPERTY_VALUE" if prop in known else "PROPERTY", "CREATE", prop, sid, new_value=b["value"], new_datatype=b["kind"])
        elif key not in after:
            row("value", "PROPERTY_VALUE" if prop in present else "PROPERTY", "DELETE", prop, sid, old_value=a["value"], old_datatype=a["kind"])
        elif a["hash"] != b["hash"] and (a["value"], a["kind"]) != (b["value"], b["kind"]):
            row("value", "PROPERTY_VALUE", "UPDATE", prop, sid, old_value=a["value"], new_value=b["value"], old_datatype=a["kind"], new_datatype=b["kind"])
        for k in sorted(a["meta"].keys() | b["meta"].keys()):
            x, y = a["meta"].get(k), b["meta"].get(k)
            if x != y:
                action = "CREATE" if x is None else "DELETE" if y is None else "UPDATE"
                row("metadata", "PROPERTY_DATATYPE_METADATA", action, prop, sid, change_target=k, old_value=compact(x), new_value=compact(y), old_datatype=a["kind"], new_datatype=b["kind"])
        if a["rank"] != b["rank"]:
            action = "CREATE" if a["rank"] is None else "DELETE" if b["rank"] is None else "UPDATE"
            row("rank", "RANK", action, prop, sid, change_target="rank", old_value=compact(a["rank"]), new_value=compact(b["rank"]))
        for action, some in (("DELETE", a["qualifiers"] - b["qualifiers"]), ("CREATE", b["qualifiers"] - a["qualifiers"])):
            for p, h, v in sorted(some):
                row("qualifier", "QUALIFIER", action, prop, sid, sub_property_id=p, value_hash=h, **{"new_value" if action == "CREATE" else "old_value": v})
        for action, some in (("DELETE", a["references"] - b["references"]), ("CREATE", b["references"] - a["references"])):
            for r, p, h, v in sorted(some):
                row("reference", "REFERENCE", action, prop, sid, sub_property_id=p, value_hash=h, ref_hash=r, **{"new_value" if action == "CREATE" else "old_value": v})
    for part, prop in (("label", LABEL), ("description", DESCRIPTION)):
        x, y = (old or {}).get(part), new[part]
        if x != y:
            row("value", "PROPERTY" if not (x and y) else "PROPERTY_VALUE", "CREATE" if not x else "DELETE" if not y else "UPDATE", prop, part, old_value=compact(x), new_value=compact(y), old_datatype="string" if x else None, new_datatype="string" if y else None)
    a, b = (old or {}).get("sitelinks", {}), new["sitelinks"]
    for site in sorted(a.keys() | b.keys()):
        x, y = a.get(site), b.get(site)
        if x != y:
            row("sitelink", "SITELINK", "CREATE" if x is None else "DELETE" if y is None else "UPDATE", SITELINK, site, old_value=compact(x), new_value=compact(y))
    if old is None:
        first = next((r for r in out if r["kind"] in ("value", "sitelink")), None)
        if first:
            first |= {"target": "ENTITY", "action": "CREATE"}
    return out


def sliced(batches: Iterator[pa.RecordBatch], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, in order, with about ``size`` bytes of text or one row: a batch may hold thousands of long revisions."""
    for batch in batches:
        ends, start = pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).to_numpy().cumsum(), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(int(ends.searchsorted(before + size, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def changes(revisions: DataFrame) -> DataFrame:
    """All change rows of revisions (entity_id, revision_id, ts, deleted, text), and a row of kind revision for each that is stored."""

    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in revisions.sparkSession.createDataFrame([], SCHEMA).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, old, previous, label = None, None, None, None
        for batch in sliced(batches):
            out = []
            for r in batch.to_pylist():
                if r["entity_id"] != entity:
                    entity, old, previous, label = r["entity_id"], None, None, None
                if r["deleted"] or not r["text"]:
                    continue
                try:
                    new = json.loads(r["text"])
                except ValueError:
                    continue
                if not isinstance(new, dict):
                    continue
                new = flatten(new)
                rows = [] if new["redirect"] else diff(old, new)
                if not rows and not new["redirect"]:
                    continue
                label = new["label"] or label
                rows.append({"kind": "revision", "target": "REDIRECT" if new["redirect"] else "REVISION"})
                shared = {"revision_id": r["revision_id"], "prev_revision_id": previous, "entity_id": r["entity_id"], "ts": r["ts"], "entity_label": label}
                out += [row | shared for row in rows]
                previous = r["revision_id"]
                if not new["redirect"]:
                    old = new
            yield pa.RecordBatch.from_pylist(out, kinds)

    rows = revisions.select("entity_id", "revision_id", "ts", "deleted", "text").repartition("entity_id").sortWithinPartitions("entity_id", "ts", "revision_id")
    return rows.mapInArrow(run, SCHEMA)


def page_revisions(pages: DataFrame) -> DataFrame:
    """Revisions of XML pages as ``changes`` takes them."""
    r = pages.select(F.substring("title", 2, 12).try_cast("long").alias("entity_id"), F.explode("revision").alias("r"))
    deleted = F.col("r.text._deleted").isNotNull()
    return r.select("entity_id", F.col("r.id").alias("revision_id"), F.col("r.timestamp").cast("timestamp").alias("ts"), deleted.alias("deleted"), F.col("r.text._VALUE").alias("text"))
