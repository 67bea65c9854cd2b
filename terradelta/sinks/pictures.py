"""PNG previews and the one-file viewer.  A preview is decimated by Spark to a bounded size first."""

from __future__ import annotations

import base64
import html
import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixel import clip, heat_rgba

#: Longest side of a preview, which bounds what reaches the driver.
SIDE = 1024


def png(image: np.ndarray) -> bytes:
    """Rows x columns x 3 or 4 bytes, without a library."""
    h, w, n = image.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.astype(np.uint8).reshape(h, w * n)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decimated(df: DataFrame, values: list[str], height: int, width: int, side: int = SIDE) -> tuple[DataFrame, int, int]:
    """Box means on a grid of at most side x side."""
    step = max(1, -(-max(height, width) // side))
    at = lambda c: F.floor(F.col(c) / step).cast("int").alias(c)
    return df.groupBy(at("row"), at("col")).agg(*[F.avg(v).alias(v) for v in values]), -(-height // step), -(-width // step)


def _image(df: DataFrame, bands: list, h: int, w: int) -> np.ndarray:
    pdf = df.select("row", "col", *[F.coalesce(b, F.lit(0)).cast("int").alias(f"c{i}") for i, b in enumerate(bands)]).toPandas()
    out = np.zeros((h, w, len(bands)), np.uint8)
    out[pdf["row"], pdf["col"]] = pdf[[f"c{i}" for i in range(len(bands))]]
    return out


def pair_previews(pair: DataFrame, height: int, width: int) -> tuple[bytes, bytes]:
    """Both dates under one stretch from the 2nd to the 98th percentile of what the previews hold."""
    names = [f"{s}{i}" for s in "ba" for i in (1, 2, 3)]
    small, h, w = decimated(pair, names, height, width)
    low, high = small.select(F.explode(F.array(*names)).alias("v")).where(F.col("v").isNotNull()).agg(F.percentile("v", 0.02), F.percentile("v", 0.98)).first()
    low, high = low or 0.0, high if high is not None and high > (low or 0.0) else (low or 0.0) + 1.0
    shade = lambda c: F.floor(clip((F.col(c) - low) / (high - low), 0.0, 1.0) * 255)
    return tuple(png(_image(small, [shade(f"{s}{i}") for i in (1, 2, 3)], h, w)) for s in "ba")


def heat_preview(marked: DataFrame, height: int, width: int) -> bytes:
    small, h, w = decimated(marked.where("valid"), ["score"], height, width)
    return png(_image(small, heat_rgba("score"), h, w))


def mask_preview(labels: DataFrame, height: int, width: int, colour: tuple = (6, 182, 212, 160)) -> bytes:
    small, h, w = decimated(labels.withColumn("one", F.lit(1.0)), ["one"], height, width)
    return png(_image(small, [F.lit(c) for c in colour], h, w))


PAGE = """<!doctype html><meta charset="utf-8"><title>%(title)s</title>
<style>body{font:14px sans-serif;margin:1rem}.v{position:relative;display:inline-block}.v img,.v svg{position:absolute;left:0;top:0;width:100%%;height:100%%}.v img.base{position:static;display:block}path{fill:none;stroke-width:1.5;vector-effect:non-scaling-stroke;cursor:pointer}.Critical{stroke:#dc2626}.Medium{stroke:#d97706}.Low{stroke:#16a34a}.Review{stroke:#9333ea}td,th{padding:2px 8px;text-align:left}</style>
<h1>%(title)s</h1><p id="c"></p>
<label>Tier <select id="t"><option value="">all</option></select></label> <label>Type <select id="k"><option value="">all</option></select></label> <label><input id="q" type="checkbox"> Only those with a quality flag</label> <label>After <input id="s" type="range" value="50"></label> <label><input id="h" type="checkbox"> Scores</label> <button id="x">Save decisions</button>
<div class="v" style="width:%(shown)dpx"><img class="base" style="width:100%%" src="%(before)s"><img id="a" src="%(after)s"><img id="m" src="%(heat)s" hidden><svg viewBox="0 0 %(width)d %(height)d"></svg></div><table id="r"></table>
<script>const R=%(regions)s,D=new Map(),E=i=>document.getElementById(i),S=document.querySelector('svg');
for(const[i,f]of[['t','severity_tier'],['k','type_tag']])for(const v of[...new Set(R.map(r=>r[f]))].sort())E(i).add(new Option(v,v));
function draw(){const V=R.filter(r=>(!E('t').value||r.severity_tier==E('t').value)&&(!E('k').value||r.type_tag==E('k').value)&&(!E('q').checked||(r.quality_flag||'nominal')!='nominal'));S.replaceChildren();E('r').replaceChildren();E('c').textContent=V.length+' of '+R.length+' regions';
for(const r of V){const p=document.createElementNS('http://www.w3.org/2000/svg','path');p.setAttribute('d',r.path);p.setAttribute('class',r.severity_tier);S.append(p);const w=E('r').insertRow();for(const f of['change_id','severity_tier','type_tag','area_m2','confidence','review_reasons'])w.insertCell().textContent=r[f];
const s=document.createElement('select');for(const o of['','confirmed','rejected'])s.add(new Option(o,o));s.value=(D.get(r.change_id)||{}).decision||'';s.onchange=()=>D.set(r.change_id,{change_id:r.change_id,decision:s.value,decided:new Date().toISOString()});w.insertCell().append(s)}}
E('t').onchange=E('k').onchange=E('q').onchange=draw;E('s').oninput=()=>E('a').style.clipPath='inset(0 0 0 '+E('s').value+'%%)';E('s').oninput();E('h').onchange=()=>E('m').hidden=!E('h').checked;
E('x').onclick=()=>{const l=document.createElement('a');l.href=URL.createObjectURL(new Blob([JSON.stringify([...D.values()])],{type:'application/json'}));l.download='review_decisions.json';l.click()};draw()</script>
"""


def svg_path(rings) -> str:
    """Path text of pixel rings of [x, y] corners."""
    return "".join("M" + "L".join(f"{x:g} {y:g}" for x, y in r) + "Z" for r in rings or ())


def viewer(regions: DataFrame, images: dict[str, bytes], height: int, width: int, path: str, title: str = "Change regions") -> int:
    """One HTML file with both dates, scores and all regions (rings in pixels), largest first; they stream into it a partition at a time."""
    names = ["change_id", "severity_tier", "type_tag", "area_m2", "confidence", "review_reasons", "quality_flag"]
    uri = {k: "data:image/png;base64," + base64.b64encode(v).decode() for k, v in images.items()}
    mark = "@regions@"
    page = PAGE % {"title": html.escape(title).replace(mark, ""), "width": width, "height": height, "shown": min(1200, max(400, width)), "regions": mark, **uri}
    head, tail = page.split(mark)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(head + "[")
        for n, r in enumerate(regions.orderBy(F.col("area_m2").desc(), "change_id").select(*[c for c in names if c in regions.columns], "rings").toLocalIterator(), 1):
            row = {c: r[c] for c in names if c in r} | {"path": svg_path(r["rings"])}
            f.write((",\n" if n > 1 else "") + json.dumps(row, default=float).replace("</", "<\\/"))
        f.write("]" + tail)
    return n
