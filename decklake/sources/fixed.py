"""Writes fixes into decks: each deck is opened once, its fixes are applied in order, and a record says what changed.

Parts that no fix touches are copied as they are.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklake.sources.pptx import UNREADABLE, Package, attr, child, kids, local, slide_parts

_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
RECORD = "array<struct<fix_ord:bigint,rule_id:string,slide_index:int,kind:string,changed:boolean,before:string,after:string,touched:array<int>,error:string>>"


def pattern_of(fix: dict) -> re.Pattern:
    if not fix["find"]:
        raise ValueError("nothing to find")
    flags = re.IGNORECASE if fix.get("ignore_case") else 0
    return re.compile(fix["find"] if fix.get("regex") else re.escape(fix["find"]), flags)


def replaced(text: str, fix: dict) -> str:
    """As ``scalars.replaced``: a regex replacement also tidies white space, where it matched."""
    out = pattern_of(fix).sub(lambda _: fix["replacement"] or "", text)
    return re.sub(r"\s{2,}", " ", out).strip() if fix.get("regex") and out != text else out


def leaves(node: ET.Element) -> list[ET.Element]:
    return [x for x in node.iter() if x.tag == _A + "t"]


def text_of(node: ET.Element) -> str:
    return "\n".join("".join(t.text or "" for t in leaves(p)) for p in node.iter(_A + "p"))


def ensure(node: ET.Element, *tags: str) -> ET.Element:
    for tag in tags:
        found = node.find(_A + tag)
        if found is None:
            found = ET.SubElement(node, _A + tag)
        node = found
    return node


def put_fill(props: ET.Element, colour: str, front: bool = False) -> bool:
    fill = props.find(_A + "solidFill")
    if fill is None:
        fill = ET.Element(_A + "solidFill")
        props.insert(0, fill) if front else props.append(fill)
    before = attr(child(fill, "srgbClr"), "val")
    for x in list(fill):
        fill.remove(x)
    ET.SubElement(fill, _A + "srgbClr", {"val": colour})
    return before != colour


def put_text(node: ET.Element, text: str) -> bool:
    """The first text leaf takes the text, the others are emptied."""
    found = leaves(node)
    if not found:
        body = child(node, "txBody")
        if body is None:
            body = ET.SubElement(node, (_A if node.tag == _A + "tc" else _P) + "txBody")
            ET.SubElement(body, _A + "bodyPr")
        found = [ET.SubElement(ET.SubElement(ET.SubElement(body, _A + "p"), _A + "r"), _A + "t")]
    before = [x.text or "" for x in found]
    for i, x in enumerate(found):
        x.text = text if i == 0 else ""
    return before != [x.text for x in found]


def run_props(node: ET.Element) -> list[ET.Element]:
    out = []
    for run in node.iter():
        if run.tag in (_A + "r", _A + "fld") and "".join(t.text or "" for t in leaves(run)).strip():
            props = run.find(_A + "rPr")
            if props is None:
                props = ET.Element(_A + "rPr")
                run.insert(0, props)
            out.append(props)
    return out


def put(node: ET.Element, name: str, value: str) -> bool:
    changed = node.get(name) != value
    node.set(name, value)
    return changed


def shapes_of(root: ET.Element) -> list[ET.Element]:
    return [x for x in root.iter() if x.tag in (_P + "sp", _P + "pic", _P + "graphicFrame")]


def shape_id(node: ET.Element) -> str:
    return next((x.get("id", "") for x in node.iter(_P + "cNvPr")), "")


def target(root: ET.Element, fix: dict) -> ET.Element | None:
    """The shape (or table cell) of a fix; the whole slide if it names none."""
    if fix["shape_id"] is None:
        return root
    shape = next((x for x in shapes_of(root) if shape_id(x) == fix["shape_id"]), None)
    if shape is None or fix["row"] is None or fix["col"] is None:
        return shape
    rows = list(shape.iter(_A + "tr"))
    cells = kids(rows[fix["row"]], "tc") if fix["row"] < len(rows) else []
    return cells[fix["col"]] if fix["col"] < len(cells) else None


def place(node: ET.Element, rect: dict) -> bool:
    props = next((x for x in node if local(x) in ("spPr", "xfrm")), None)
    if props is None:
        return False
    xfrm = props if local(props) == "xfrm" else ensure(props, "xfrm")
    off, ext = ensure(xfrm, "off"), ensure(xfrm, "ext")
    return any([put(e, k, str(round(rect[n]))) for e, k, n in ((off, "x", "x"), (off, "y", "y"), (ext, "cx", "cx"), (ext, "cy", "cy"))])


def footer(root: ET.Element, fix: dict) -> bool:
    """Writes the footer, or adds one."""
    for x in shapes_of(root):
        if any(p.get("type") == "ftr" for p in x.iter(_P + "ph")):
            return put_text(x, fix["replacement"])
    tree = next(root.iter(_P + "spTree"))
    number = str(max([1, *(int(i) for x in root.iter(_P + "cNvPr") if (i := x.get("id", "")).isdigit())]) + 1)
    shape = ET.SubElement(tree, _P + "sp")
    head = ET.SubElement(shape, _P + "nvSpPr")
    ET.SubElement(head, _P + "cNvPr", {"id": number, "name": f"Footer {number}"})
    ET.SubElement(head, _P + "cNvSpPr")
    ET.SubElement(ET.SubElement(head, _P + "nvPr"), _P + "ph", {"type": "ftr", "idx": "16"})
    ET.SubElement(shape, _P + "spPr")
    put_text(shape, fix["replacement"])
    for props in run_props(shape):
        props.set("sz", "800")
    if fix["rect"]:
        place(shape, fix["rect"])
    return True


def each(found: list[bool]) -> bool:
    return any(found)


def apply(root: ET.Element, fix: dict) -> bool:
    """Whether the slide changed."""
    kind, node = fix["kind"], target(root, fix)
    if kind == "ensure-footer":
        return footer(root, fix)
    if node is None:
        raise LookupError("no such shape or cell")
    match kind:
        case "text-replace" | "deck-replace":
            changed = False
            for leaf in leaves(root if kind == "deck-replace" else node):
                after = replaced(leaf.text or "", fix)
                changed |= after != (leaf.text or "")
                leaf.text = after
            return changed
        case "title-rewrite" | "ai-rewrite":
            if fix["replacement"] is None:
                raise ValueError("no text to write")
            return put_text(node, fix["replacement"])
        case "font-family-set":
            return each([put(ensure(p, t), "typeface", fix["replacement"]) for p in run_props(node) for t in ("latin", "cs")])
        case "font-size-set":
            return each([put(p, "sz", str(round(fix["value"] * 100))) for p in run_props(node)])
        case "font-bold-set":
            return each([put(p, "b", "1") for p in run_props(node)])
        case "color-set":
            places = [x for x in node.iter(_A + "srgbClr") if (x.get("val") or "").upper() == (fix["find"] or "").upper()]
            return each([put(x, "val", fix["color"]) for x in places])
        case "shape-reposition":
            return place(node, fix["rect"])
        case "row-fill-set":
            shape = target(root, fix | {"row": None})
            cells = kids(list(shape.iter(_A + "tr"))[fix["row"]], "tc")
            return each([put_fill(ensure(c, "tcPr"), fix["color"]) for c in cells])
        case "border-remove":
            changed = []
            shape = target(root, fix | {"row": None})
            for row in shape.iter(_A + "tr"):
                cells = kids(row, "tc")
                for cell, edge in ((cells[0], "lnL"), (cells[-1], "lnR")) if cells else ():
                    line = child(cell, "tcPr", edge)
                    if line is not None and child(line, "noFill") is None:
                        for x in list(line):
                            line.remove(x)
                        ET.SubElement(line, _A + "noFill")
                        changed.append(True)
            return each(changed)
    raise ValueError(f"unknown fix {kind}")


def apply_all(content: bytes, fixes: list[dict]) -> tuple[bytes, list[dict]]:
    """The fixed deck and a record of each fix. A fix for the whole deck is applied once for each find and replacement."""
    source = zipfile.ZipFile(io.BytesIO(content))
    names = source.namelist()
    places = {part: at for at, part in enumerate(slide_parts(Package(content)), 1)}
    slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: (places.get(n, len(names)), n))
    open_: dict[str, ET.Element] = {}
    touched: set[str] = set()
    done: set[tuple] = set()
    records = []

    def part(name: str) -> ET.Element:
        if name not in open_:
            raw = source.read(name)
            for _, (prefix, uri) in ET.iterparse(io.BytesIO(raw), events=["start-ns"]):
                if not re.fullmatch(r"ns\d+", prefix):
                    ET.register_namespace(prefix, uri)
            open_[name] = ET.fromstring(raw)
        return open_[name]

    def slide_number(name: str) -> int:
        return places.get(name) or int(re.sub(r"\D", "", name) or 0)

    for fix in sorted(fixes, key=lambda f: f["fix_ord"]):
        record = {k: fix[k] for k in ("fix_ord", "rule_id", "slide_index", "kind")} | {"changed": False, "before": None, "after": None, "touched": [], "error": None}
        key = (fix["rule_id"], fix["find"], fix["replacement"])
        whole = fix["kind"] == "deck-replace" or fix["deck_wide"]
        if whole and key in done:
            continue
        done |= {key} if whole else set()
        try:
            for name in slides if whole else [fix["slide_path"]]:
                root = part(name)
                node = target(root, fix) if not whole else root
                before = text_of(root if node is None else node)
                if apply(root, fix | ({"shape_id": None} if whole else {})):
                    touched.add(name)
                    # the first slide's text before, the last one's after, and all slides between
                    record |= {"changed": True, "before": record["before"] or before[:200], "after": text_of(root if node is None else node)[:200], "touched": [*record["touched"], slide_number(name)]}
        except (LookupError, ValueError, KeyError, TypeError, re.error) as e:
            record["error"] = f"{type(e).__name__}: {e}"[:200]
        records.append(record)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info in source.infolist():
            raw = ET.tostring(open_[info.filename], encoding="UTF-8", xml_declaration=True) if info.filename in touched else source.read(info.filename)
            z.writestr(info, raw, zipfile.ZIP_DEFLATED, 6)
    return out.getvalue(), records


def applied(content: bytes | None, fixes: list[dict]) -> tuple[bytes | None, list[dict]]:
    """As ``apply_all``; a file that can't be read stays as it is, with an error for each fix."""
    try:
        return apply_all(content or b"", fixes)
    except UNREADABLE as e:
        said = f"{type(e).__name__}: {e}"[:200]
        return content, [{k: f[k] for k in ("fix_ord", "rule_id", "slide_index", "kind")} | {"changed": False, "before": None, "after": None, "touched": [], "error": said} for f in fixes]


def write_fixes(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """(path, length, content, records) of every file of ``files(path, length, content)``, fixed by the rows of
    ``fixes(deck_id, fix_ord, rule_id, slide_index, slide_path, shape_id, row, col, fix)``, whose deck_id is the path.

    A file that can't be read stays as it is; each of its fixes has the error. Null content stays null."""
    names = [f.name for f in fixes.schema["fix"].dataType.fields]
    one = F.struct("fix_ord", "rule_id", "slide_index", "slide_path", "shape_id", "row", "col", *[F.col(f"fix.{n}").alias(n) for n in names])
    grouped = fixes.where("fix is not null").groupBy(F.col("deck_id").alias("path")).agg(F.collect_list(one).alias("fixes"))

    @F.arrow_udf(f"struct<content:binary,records:{RECORD}>")
    def fixed(contents: pa.Array, fixes: pa.Array) -> pa.Array:
        record = [("fix_ord", pa.int64()), ("rule_id", pa.string()), ("slide_index", pa.int32()), ("kind", pa.string()), ("changed", pa.bool_()), ("before", pa.string()), ("after", pa.string()), ("touched", pa.list_(pa.int32())), ("error", pa.string())]
        rows = [dict(zip(("content", "records"), applied(c.as_py(), f.as_py() or []))) for c, f in zip(contents, fixes)]
        return pa.array(rows, pa.struct([("content", pa.binary()), ("records", pa.list_(pa.struct(record)))]))

    out = files.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).join(grouped, "path", "left").withColumn("out", fixed("content", "fixes"))
    return out.select("path", F.octet_length("out.content").cast("long").alias("length"), F.col("out.content").alias("content"), F.col("out.records").alias("records"))

