"""Writes plain decks from rows of slides: a corpus of decks for the scan, from any table with titles and texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklake.sources.scratch import gathered, small_batches

_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_P = f'{_A} xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PLACES = {"title": (457200, 274638, 7772400, 914400), "body": (457200, 1371600, 8229600, 4525963), "ftr": (457200, 6356350, 8229600, 365125)}


def _clean(text: str) -> str:
    """XML has no control characters but tab and line ends."""
    return "".join(c for c in text if c >= " " or c in "\t\n")


def _place(x: tuple[int, int, int, int], tag: str = "a:xfrm") -> str:
    return f'<{tag}><a:off x="{x[0]}" y="{x[1]}"/><a:ext cx="{x[2]}" cy="{x[3]}"/></{tag}>'


def paragraph(text: str, props: str = "", run: str = "") -> str:
    return f"<a:p>{props}<a:r><a:rPr lang=\"en-US\"{run if run.startswith(' ') else ''}>{'' if run.startswith(' ') else run}</a:rPr><a:t>{escape(_clean(text))}</a:t></a:r></a:p>"


def shape(number: int, text: str, ph: str | None = None, *, place: tuple[int, int, int, int] | None = None, fill: str = "", run: str = "", bullets: bool = False, name: str = "") -> str:
    """A text shape; ``text``'s lines are its paragraphs."""
    kind = f"<p:ph type={quoteattr(ph)}/>" if ph else ""
    props = '<a:pPr><a:buChar char="-"/></a:pPr>' if bullets else ""
    body = "".join(paragraph(t, props, run) for t in text.split("\n"))
    colour = f'<a:solidFill><a:srgbClr val="{fill}"/></a:solidFill>' if fill else ""
    return (
        f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name={quoteattr(name or f"Shape {number}")}/><p:cNvSpPr/><p:nvPr>{kind}</p:nvPr></p:nvSpPr>'
        f"<p:spPr>{_place(place) if place else ''}{colour}</p:spPr><p:txBody><a:bodyPr/><a:lstStyle/>{body}</p:txBody></p:sp>"
    )


def table(number: int, rows: list[list[dict]], place: tuple[int, int, int, int]) -> str:
    """A table of cells: text, and maybe size, fill, attrs (of the cell) and edges."""
    width, height = place[2] // max(1, len(rows[0])), place[3] // len(rows)

    def cell(x: dict) -> str:
        run = f' sz="{x["size"] * 100}"' if "size" in x else ""
        edges = "".join(f'<a:{e}><a:solidFill><a:srgbClr val="000000"/></a:solidFill></a:{e}>' for e in x.get("edges", ()))
        fill = f'<a:solidFill><a:srgbClr val="{x["fill"]}"/></a:solidFill>' if "fill" in x else ""
        return f'<a:tc{x.get("attrs", "")}><a:txBody><a:bodyPr/><a:lstStyle/>{paragraph(x["text"], "", run)}</a:txBody><a:tcPr>{edges}{fill}</a:tcPr></a:tc>'

    grid = "".join(f'<a:gridCol w="{width}"/>' for _ in rows[0])
    body = "".join(f'<a:tr h="{height}">{"".join(map(cell, r))}</a:tr>' for r in rows)
    return (
        f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{number}" name="Table {number}"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr>{_place(place, "p:xfrm")}'
        f'<a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/table"><a:tbl><a:tblGrid>{grid}</a:tblGrid>{body}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    )


def picture(number: int, rel: str, place: tuple[int, int, int, int]) -> str:
    """A picture of the part that a relationship of its slide names."""
    return (
        f'<p:pic><p:nvPicPr><p:cNvPr id="{number}" name="Picture {number}"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr>'
        f'<p:blipFill><a:blip r:embed="{rel}"/></p:blipFill><p:spPr>{_place(place)}</p:spPr></p:pic>'
    )


def _rels(rows: list[tuple[str, str, str]]) -> str:
    return _HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{_REL}/{k}" Target="{t}"/>' for i, k, t in rows) + "</Relationships>"


def _tree(shapes: str) -> str:
    return f"<p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id=\"1\" name=\"\"/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{shapes}</p:spTree></p:cSld>"


def deck(slides: list[str], *, layout_type: str = "obj", font: str = "Calibri", media: dict[str, bytes | None] | None = None) -> bytes:
    """A deck whose slides hold the given shapes; one layout and one master with title, body and footer. Each slide has a relationship to
    each of ``media``, named ``m`` and its place among them; those of None have no part."""
    media = media or {}
    holders = "".join(shape(i + 2, "", ph, place=_PLACES[ph]) for i, ph in enumerate(_PLACES))
    style = lambda size, bold: f'<a:lvl1pPr><a:defRPr sz="{size}" b="{bold}"><a:latin typeface="+mn-lt"/></a:defRPr></a:lvl1pPr>'
    n = len(slides)
    parts = {
        "[Content_Types].xml": _HEAD + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>',
        "_rels/.rels": _rels([("rId1", "officeDocument", "ppt/presentation.xml")]),
        "ppt/presentation.xml": _HEAD + f'<p:presentation {_P}><p:sldIdLst>{"".join(f"""<p:sldId id="{256 + i}" r:id="rId{i + 10}"/>""" for i in range(n))}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:defaultTextStyle>{style(1800, 0)}</p:defaultTextStyle></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _rels([("rId1", "slideMaster", "slideMasters/slideMaster1.xml"), *((f"rId{i + 10}", "slide", f"slides/slide{i + 1}.xml") for i in range(n))]),
        "ppt/slideMasters/slideMaster1.xml": _HEAD + f"<p:sldMaster {_P}>{_tree(holders)}<p:txStyles><p:titleStyle>{style(2400, 1)}</p:titleStyle><p:bodyStyle>{style(1400, 0)}</p:bodyStyle><p:otherStyle>{style(1200, 0)}</p:otherStyle></p:txStyles></p:sldMaster>",
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _rels([("rId1", "theme", "../theme/theme1.xml"), ("rId2", "slideLayout", "../slideLayouts/slideLayout1.xml")]),
        "ppt/slideLayouts/slideLayout1.xml": _HEAD + f'<p:sldLayout {_P} type="{layout_type}">{_tree(shape(2, "", "title", place=_PLACES["title"])).replace("<p:cSld>", """<p:cSld name="Plain">""")}</p:sldLayout>',
        "ppt/theme/theme1.xml": _HEAD + f'<a:theme {_A}><a:themeElements><a:fontScheme name="x"><a:majorFont><a:latin typeface="{font}"/></a:majorFont><a:minorFont><a:latin typeface="{font}"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>',
    }
    for i, shapes in enumerate(slides):
        parts[f"ppt/slides/slide{i + 1}.xml"] = _HEAD + f"<p:sld {_P}>{_tree(shapes)}</p:sld>"
        parts[f"ppt/slides/_rels/slide{i + 1}.xml.rels"] = _rels([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), *((f"m{k}", "image", f"../media/{name}") for k, name in enumerate(media))])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
        for name, raw in media.items():
            if raw is not None:
                z.writestr(zipfile.ZipInfo(f"ppt/media/{name}"), raw)
    return out.getvalue()


def decks_of(slides: DataFrame) -> DataFrame:
    """(path, length, content) of a deck for each deck_id of ``slides(deck_id, slide_index, title, body, footer)``, in the
    order of slide_index; null texts have no shape. A column ``picture`` (binary) puts a picture on its slide; pictures of one content
    share a part. A deck's slides meet in one row, as in its file."""
    columns = ["slide_index", "title", "body", "footer", *(["picture"] if "picture" in slides.columns else [])]

    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                pages, raws = [], list(dict.fromkeys(x for s in row["slides"] if (x := s.get("picture")) is not None))
                places = {x: k for k, x in enumerate(raws)}
                for s in row["slides"]:
                    shapes = [(ph, s[k]) for ph, k in (("title", "title"), ("body", "body"), ("ftr", "footer")) if s[k] is not None]
                    pages.append("".join(shape(i + 2, text, ph, bullets=ph == "body") for i, (ph, text) in enumerate(shapes)))
                    if s.get("picture") is not None:
                        pages[-1] += picture(9, f"m{places[s['picture']]}", _PLACES["body"])
                content = deck(pages, media={f"image{k}.png": x for k, x in enumerate(raws)})
                yield len(content), {"path": f"{row['deck_id']}.pptx", "length": len(content), "content": content}

    small_batches(slides.sparkSession)
    grouped = slides.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("slides"))
    return grouped.mapInArrow(lambda batches: gathered(made(batches), schema), "path string, length long, content binary")
