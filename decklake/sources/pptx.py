"""Presentation decks as Spark tables.

Files are read by Spark's ``binaryFile`` source, so any store works; a task unzips a deck and yields one nested row: its
slides and its style layers, as they stand in the file. Inheritance is not resolved here but by joins
(``decklake.operators.cascade``).
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decklake.sources.scratch import gathered, small_batches

#: Most bytes of a file, and of all its parts unpacked.
MAX_BYTES, MAX_UNPACKED = 30 << 20, 1 << 30
#: What reading a damaged, locked or oddly packed file may raise.
UNREADABLE = (ValueError, KeyError, AttributeError, TypeError, OverflowError, zipfile.BadZipFile, zlib.error, struct.error, EOFError, RuntimeError, NotImplementedError, ET.ParseError)
_RECT = "rect:struct<x:double,y:double,cx:double,cy:double>"
_STYLE = "size_pt:double,bold:boolean,italic:boolean,underline:boolean,strike:boolean,font:string,color:string"
_PARA = "align:string,margin_left_in:double,indent_in:double,space_before_pt:double,space_after_pt:double,line_spacing_pct:double,bullet:struct<type:string,char:string,font:string>"
_BODY = "body:struct<anchor:string,left:double,right:double,top:double,bottom:double,wrap:string>"
_RUNS = f"array<struct<run_pos:int,text:string,{_STYLE}>>"
_CELL_RUNS = f"array<struct<para_pos:int,run_pos:int,text:string,{_STYLE}>>"
_LEVELS = f"levels:array<struct<level:int,run:struct<{_STYLE}>,para:struct<{_PARA}>>>"
_CELL = f"row:int,col:int,text:string,row_span:int,grid_span:int,merged:boolean,h_merge:boolean,v_merge:boolean,fill:string,align:string,left:boolean,right:boolean,top:boolean,bottom:boolean,paras:int,runs:{_CELL_RUNS}"
_SHAPE = (
    f"shape_pos:int,shape_id:string,name:string,kind:string,ph_type:string,ph_idx:string,{_RECT},fill:string,image_path:string,image_digest:string,{_BODY},{_LEVELS},"
    f"paragraphs:array<struct<para_pos:int,level:int,{_PARA},runs:{_RUNS}>>,col_widths:array<bigint>,row_heights:array<bigint>,cells:array<struct<{_CELL}>>"
)
_SLIDE = f"slide_index:int,slide_path:string,layout_name:string,layout_type:string,notes:string,shapes:array<struct<{_SHAPE}>>"
_LAYER = f"scope:string,layout_name:string,ph_pos:int,ph_type:string,ph_idx:string,{_RECT},{_BODY},{_LEVELS}"
DECK = f"deck_id string, file_name string, size struct<cx:bigint,cy:bigint>, theme struct<major:string,minor:string>, slides array<struct<{_SLIDE}>>, layers array<struct<{_LAYER}>>, error string"

#: The types of image parts by the end of their name; vector formats have none.
_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "emf": None, "wmf": None}
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TYPE = "/slideLayout", "/notesSlide", "/slideMaster", "/theme"


def local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def kids(node: ET.Element | None, *names: str) -> list[ET.Element]:
    return [] if node is None else [x for x in node if local(x) in names]


def child(node: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        node = next(iter(kids(node, name)), None)
    return node


def attr(node: ET.Element | None, name: str) -> str | None:
    if node is None:
        return None
    return next((v for k, v in node.attrib.items() if k == name or k.endswith("}" + name)), None)


def number(node: ET.Element | None, name: str) -> float | None:
    value = attr(node, name)
    try:
        return float(value) if value is not None else None
    except ValueError:
        return None


def rels_path(part: str) -> str:
    return posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")


class Package:
    """The parts of a deck."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        self._rels: dict[str, list[tuple[str, str, str]]] = {}
        if sum(x.file_size for x in self.zip.infolist()) > MAX_UNPACKED:
            raise ValueError(f"over {MAX_UNPACKED} bytes unpacked")

    def xml(self, part: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(part)) if part in self.names else None

    def rels(self, part: str) -> list[tuple[str, str, str]]:
        """(id, type, part) of a part's relationships, parsed once."""
        if part in self._rels:
            return self._rels[part]
        root = self.xml(rels_path(part))
        out = []
        for r in kids(root, "Relationship"):
            target = r.get("Target", "")
            out.append((r.get("Id", ""), r.get("Type", ""), target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), target))))
        self._rels[part] = out
        return out

    def related(self, part: str, kind: str) -> str | None:
        return next((t for _, k, t in self.rels(part) if k.endswith(kind)), None)


def media_type(part: str) -> str | None:
    return _MIME.get(part.rpartition(".")[2].lower(), "application/octet-stream")


def slide_parts(pack: Package) -> list[str]:
    """The slides' parts, in order."""
    top = "ppt/presentation.xml"
    rels = {i: t for i, _, t in pack.rels(top)}
    return [rels.get(x.get(_REL_ID, ""), "") for x in kids(child(pack.xml(top), "sldIdLst"), "sldId")]


def solid(node: ET.Element | None) -> str | None:
    """An explicit colour; theme colours are unknown."""
    value = attr(child(node, "solidFill", "srgbClr"), "val")
    return value.upper() if value else None


def run_style(props: ET.Element | None) -> dict:
    flag = lambda name: None if attr(props, name) is None else attr(props, name) in ("1", "true")
    size = number(props, "sz")
    other = lambda name, none: None if attr(props, name) is None else attr(props, name) != none
    return {"size_pt": None if size is None else size / 100, "bold": flag("b"), "italic": flag("i"), "underline": other("u", "none"), "strike": other("strike", "noStrike"), "font": attr(child(props, "latin"), "typeface"), "color": solid(props)}


def para_style(props: ET.Element | None) -> dict:
    inch = lambda name: None if number(props, name) is None else number(props, name) / 914400
    points = lambda name: None if (v := number(child(props, name, "spcPts"), "val")) is None else v / 100
    line = number(child(props, "lnSpc", "spcPct"), "val")
    bullet = None
    if (x := child(props, "buChar")) is not None:
        bullet = {"type": "char", "char": attr(x, "char")}
    elif child(props, "buAutoNum") is not None:
        bullet = {"type": "auto", "char": None}
    elif child(props, "buNone") is not None:
        bullet = {"type": "none", "char": None}
    if bullet:
        bullet["font"] = attr(child(props, "buFont"), "typeface")
    return {"align": attr(props, "algn"), "margin_left_in": inch("marL"), "indent_in": inch("indent"), "space_before_pt": points("spcBef"), "space_after_pt": points("spcAft"), "line_spacing_pct": None if line is None else line / 1000, "bullet": bullet}


def levels(styles: ET.Element | None) -> list[dict]:
    """The styles of a list by level; level 0 falls back to the default paragraph's."""
    out = []
    for n in range(9):
        props = child(styles, f"lvl{n + 1}pPr")
        if props is None and n == 0:
            props = child(styles, "defPPr")
        if props is not None:
            out.append({"level": n, "run": run_style(child(props, "defRPr")), "para": para_style(props)})
    return out


def body(node: ET.Element | None) -> dict | None:
    props = child(node, "bodyPr")
    return None if props is None else {"anchor": attr(props, "anchor"), "left": number(props, "lIns"), "right": number(props, "rIns"), "top": number(props, "tIns"), "bottom": number(props, "bIns"), "wrap": attr(props, "wrap")}


def rect(xfrm: ET.Element | None, frame: tuple) -> dict | None:
    off, ext = child(xfrm, "off"), child(xfrm, "ext")
    if off is None or ext is None:
        return None
    sx, sy, dx, dy = frame
    return {"x": (number(off, "x") or 0) * sx + dx, "y": (number(off, "y") or 0) * sy + dy, "cx": (number(ext, "cx") or 0) * sx, "cy": (number(ext, "cy") or 0) * sy}


def inner_frame(group: ET.Element, frame: tuple) -> tuple:
    """The frame of a group's children: scale and offset on top of the group's own."""
    xfrm = child(group, "grpSpPr", "xfrm")
    if xfrm is None:
        return frame
    n = lambda tag, name, default: number(child(xfrm, tag), name) if number(child(xfrm, tag), name) is not None else default
    gx, gy = n("ext", "cx", 1) / (n("chExt", "cx", 1) or 1), n("ext", "cy", 1) / (n("chExt", "cy", 1) or 1)
    sx, sy, dx, dy = frame
    return sx * gx, sy * gy, dx + sx * (n("off", "x", 0) - n("chOff", "x", 0) * gx), dy + sy * (n("off", "y", 0) - n("chOff", "y", 0) * gy)


def runs(para: ET.Element) -> list[dict]:
    out = []
    for x in kids(para, "r", "br", "fld"):
        text = "\n" if local(x) == "br" else "".join(t.text or "" for t in kids(x, "t"))
        out.append({"run_pos": len(out), "text": text} | run_style(child(x, "rPr")))
    return out


def paragraphs(text: ET.Element | None) -> list[dict]:
    out = []
    for p in kids(text, "p"):
        props = child(p, "pPr")
        out.append({"para_pos": len(out), "level": int(number(props, "lvl") or 0), "runs": runs(p)} | para_style(props))
    return out


def text_of(text: ET.Element | None) -> str:
    return "\n".join("".join(r["text"] for r in p["runs"]) for p in paragraphs(text))


def cells(table: ET.Element) -> list[dict]:
    out = []
    for i, row in enumerate(kids(table, "tr")):
        for j, cell in enumerate(kids(row, "tc")):
            props, text = child(cell, "tcPr"), child(cell, "txBody")
            flag = lambda name, cell=cell: attr(cell, name) in ("1", "true")
            edge = lambda name, props=props: (x := child(props, name)) is not None and child(x, "noFill") is None
            lines = paragraphs(text)
            found = [dict(r, run_pos=n, para_pos=at) for n, (at, r) in enumerate((p["para_pos"], r) for p in lines for r in p["runs"])]
            out.append(
                {"row": i, "col": j, "text": text_of(text), "row_span": int(number(cell, "rowSpan") or 1), "grid_span": int(number(cell, "gridSpan") or 1)}
                | {"h_merge": flag("hMerge"), "v_merge": flag("vMerge"), "merged": flag("hMerge") or flag("vMerge"), "fill": solid(props), "align": attr(child(text, "p", "pPr"), "algn")}
                | {"left": edge("lnL"), "right": edge("lnR"), "top": edge("lnT"), "bottom": edge("lnB"), "paras": len(lines), "runs": found}
            )
    return out


def placeholder(shape: ET.Element) -> ET.Element | None:
    return next((x for nv in shape for x in nv.iter() if local(nv).startswith("nv") and local(x) == "ph"), None)


def shapes(tree: ET.Element | None, media: dict[str, tuple[str, str | None]]) -> list[dict]:
    out: list[dict] = []

    def add(node: ET.Element, kind: str, **more) -> None:
        named = next((x for x in node.iter() if local(x) == "cNvPr"), None)
        ph = placeholder(node)
        empty = {"ph_type": attr(ph, "type"), "ph_idx": attr(ph, "idx"), "rect": None, "fill": None, "image_path": None, "image_digest": None, "body": None, "levels": [], "paragraphs": [], "col_widths": None, "row_heights": None, "cells": []}
        out.append({"shape_pos": len(out), "shape_id": attr(named, "id") or "", "name": attr(named, "name") or "", "kind": kind} | empty | more)

    def walk(node: ET.Element | None, frame: tuple) -> None:
        for x in [] if node is None else node:
            props, text = child(x, "spPr"), child(x, "txBody")
            match local(x):
                case "sp":
                    add(x, "text", rect=rect(child(props, "xfrm"), frame), fill=solid(props), body=body(text), levels=levels(child(text, "lstStyle")), paragraphs=paragraphs(text))
                case "pic":
                    path, digest = media.get(attr(child(x, "blipFill", "blip"), "embed") or "", (None, None))
                    add(x, "picture", rect=rect(child(props, "xfrm"), frame), image_path=path, image_digest=digest)
                case "graphicFrame":
                    table = child(x, "graphic", "graphicData", "tbl")
                    place = rect(child(x, "xfrm"), frame)
                    if table is None:
                        add(x, "chart", rect=place)
                    else:
                        sizes = lambda nodes, name, scale: [round((number(n, name) or 0) * scale) for n in nodes]
                        widths, heights = sizes(kids(child(table, "tblGrid"), "gridCol"), "w", frame[0]), sizes(kids(table, "tr"), "h", frame[1])
                        add(x, "table", rect=place, col_widths=widths, row_heights=heights, cells=cells(table))
                case "grpSp":
                    walk(x, inner_frame(x, frame))

    walk(tree, (1.0, 1.0, 0.0, 0.0))
    return out


def placeholders(tree: ET.Element | None, scope: str, layout: str | None) -> list[dict]:
    out = []
    for x in [] if tree is None else tree.iter():
        if local(x) == "sp" and (ph := placeholder(x)) is not None and (attr(ph, "type") or attr(ph, "idx")):
            text = child(x, "txBody")
            out.append({"scope": scope, "layout_name": layout, "ph_pos": len(out), "ph_type": attr(ph, "type"), "ph_idx": attr(ph, "idx"), "rect": rect(child(x, "spPr", "xfrm"), (1.0, 1.0, 0.0, 0.0)), "body": body(text), "levels": levels(child(text, "lstStyle"))})
    return out


def parse(deck_id: str, content: bytes) -> dict:
    """A deck as one row of DECK."""
    pack = Package(content)
    top = "ppt/presentation.xml"
    root = pack.xml(top)
    if root is None:
        raise ValueError("no presentation part")
    size = child(root, "sldSz")
    master_part = "ppt/slideMasters/slideMaster1.xml"
    master = pack.xml(master_part)
    theme_part = pack.related(master_part, _TYPE[3]) or "ppt/theme/theme1.xml"
    fonts = next((x for x in (pack.xml(theme_part) or ET.Element("none")).iter() if local(x) == "fontScheme"), None)
    layers = placeholders(child(master, "cSld", "spTree"), "master", None)
    flat = {"layout_name": None, "ph_pos": 0, "ph_type": None, "ph_idx": None, "rect": None, "body": None}
    for name, part in (("title", "titleStyle"), ("body", "bodyStyle"), ("other", "otherStyle")):
        layers.append(flat | {"scope": "text", "ph_type": name, "levels": levels(child(master, "txStyles", part))})
    layers.append(flat | {"scope": "default", "levels": levels(child(root, "defaultTextStyle"))})
    known: dict[str, tuple[str, str | None]] = {}
    digests: dict[str, str] = {}

    def digest(part: str) -> str | None:
        """Of an image part that is there and has a type."""
        if part in pack.names and media_type(part) and part not in digests:
            digests[part] = hashlib.sha256(pack.zip.read(part)).hexdigest()
        return digests.get(part)

    slides = []
    for at, part in enumerate(slide_parts(pack)):
        slide = pack.xml(part)
        if slide is None:
            continue
        layout_part = pack.related(part, _TYPE[0])
        if layout_part and layout_part not in known:
            layout = pack.xml(layout_part)
            name = attr(child(layout, "cSld"), "name") or layout_part
            known[layout_part] = (name, attr(layout, "type"))
            layers += placeholders(child(layout, "cSld", "spTree"), "layout", name)
        name, kind = known.get(layout_part or "", (None, None))
        notes_part = pack.related(part, _TYPE[1])
        notes = pack.xml(notes_part) if notes_part else None
        said = [line.strip() for s in shapes(child(notes, "cSld", "spTree"), {}) if s["ph_type"] != "sldNum" for p in s["paragraphs"] if (line := "".join(r["text"] for r in p["runs"])).strip()]
        media = {i: (t, digest(t) if k.endswith("/image") else None) for i, k, t in pack.rels(part)}
        slides.append({"slide_index": at + 1, "slide_path": part, "layout_name": name, "layout_type": kind, "notes": "\n".join(said), "shapes": shapes(child(slide, "cSld", "spTree"), media)})
    latin = lambda kind: attr(child(fonts, kind, "latin"), "typeface") or "Calibri"
    return {
        "deck_id": deck_id,
        "file_name": posixpath.basename(deck_id),
        "size": {"cx": int(number(size, "cx") or 0), "cy": int(number(size, "cy") or 0)},
        "theme": {"major": latin("majorFont"), "minor": latin("minorFont")},
        "slides": slides,
        "layers": layers,
        "error": None,
    }


def deck_rows(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row of DECK for each row of ``files(path, length, content)``. Files that are too large or can't be read have
    only ``error``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(DECK)
    arrow = to_arrow_schema(schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                name = re.sub(r"^file:/+", "/", row["path"])
                try:
                    if row["content"] is None:
                        raise ValueError(f"over {max_bytes} bytes")
                    yield len(row["content"]), parse(name, row["content"])
                except UNREADABLE as e:
                    yield 0, {"deck_id": name, "file_name": posixpath.basename(name), "error": f"{type(e).__name__}: {e}"[:200]}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # files are packed, so fewer bytes of them a batch than of texts
        return gathered(found(batches), arrow, size=256 << 10)

    small_batches(files.sparkSession)
    small = files.select("path", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))
    return small.mapInArrow(read, schema)


def read_decks(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The decks under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").option("recursiveFileLookup", "true").load(path)
    return deck_rows(files, max_bytes)
