"""Guidance in markdown: cleaning, charts of steps, and the tree of its headings.

A document is one row and is read line by line. Defined results: a null text has no nodes; text before the first numbered
heading, contents and footnotes are no sections; a heading that repeats an id gets its number behind it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Running headers that a converter repeats on each page.
RUNNING = (re.compile(r"(?:#{1,3}\s*)?Medical Devices\s*"), re.compile(r"#{1,3}\s*Medical Device Coordination Group Document\s*(?:MDCG\s+[0-9]{4}-[0-9]+\s*(?:Rev\.[0-9]+)?)?\s*"))
_HEADING, _NUMBERED = re.compile(r"(#{1,6})\s+(.+?)\s*$"), re.compile(r"([0-9]+(?:\.[0-9]+)*)\.?\s+(.+)")
_CHART = re.compile(r"(?:.*\b)?(?:(main)\s+chart|chart\s+([A-Z]))\b(?:\s*[:–—-]\s*(.+))?$", re.IGNORECASE)
_NOTE = re.compile(r"\s*([0-9]+)[.):]?\s+(.+?)\s*$")


def cleaned(text: str) -> tuple[str, dict[str, int]]:
    """Markdown without page separators and repeated running headers, its footnotes gathered once at the end, heading levels by their numbers; and counts of what was done."""
    counts = {"separators": 0, "headers": 0, "footnote_sections": 0, "footnotes": 0}
    lines, seen, notes, known, inside = [], set(), [], set(), False
    for line in (text or "").split("\n"):
        if re.fullmatch(r"\s*-{3,}\s*", line):
            counts["separators"] += 1
            lines.append("")
            continue
        heading = _HEADING.match(line)
        if heading and re.fullmatch(r"footnotes?", heading.group(2), re.IGNORECASE) and len(heading.group(1)) < 4:
            counts["footnote_sections"] += 1
            inside = True
            continue
        inside = inside and not (heading and len(heading.group(1)) < 4)
        if inside:
            note = _NOTE.match(line)
            key = re.sub(r"\s+", " ", note.group(2).lower()) if note else ""
            if note and len(key) > 5 and key not in known:
                known.add(key)
                notes.append(f"{note.group(1)}. {note.group(2)}")
            continue
        kind = next((k for k, p in enumerate(RUNNING) if p.fullmatch(line)), None)
        if kind is not None:
            if kind in seen:
                counts["headers"] += 1
                continue
            seen.add(kind)
        numbered = _NUMBERED.match(heading.group(2)) if heading else None
        if numbered and re.match(r"[0-9]+(?:\.[0-9]+)*\s", heading.group(2)):
            line = f"{'#' * min(numbered.group(1).count('.') + 2, 6)} {numbered.group(1)} {numbered.group(2)}"
        lines.append(line.rstrip())
    counts["footnotes"] = len(notes)
    out = re.sub(r"\n{4,}", "\n\n\n", "\n".join(lines)).strip() + "\n"
    return out + ("\n\n## Footnotes\n\n" + "\n\n".join(notes) + "\n" if notes else ""), counts


def charts(text: str) -> list[dict]:
    """Decision charts: chart, title, section, and steps (id, question, yes, no), of a chart that stands twice the longer.

    Steps are bold labels with a question, else bold questions; their branches the list items "Yes" and "No" below.
    """
    lines, found, now = (text or "").split("\n"), [], None
    for line in lines:
        heading = _HEADING.match(line)
        bold = re.fullmatch(r"\s*\*\*((?:main\s+chart|chart\s+[A-E])[^*]*)\*\*\s*", line, re.IGNORECASE)
        m = _CHART.match(heading.group(2)) if heading else _CHART.match(bold.group(1)) if bold else None
        if m:
            name = "Main" if m.group(1) else m.group(2).upper()
            now = {"chart": name, "title": (m.group(3) or "").strip(), "lines": []}
            found.append(now)
        elif now is not None:
            now["lines"].append(line)
    best: dict[str, dict] = {}
    for c in found:
        section = re.search(r"Section\s+([0-9]+(?:\.[0-9]+)*)", "\n".join(c["lines"])[:500])
        made = {"chart": c["chart"], "title": c["title"] or ("Main Chart" if c["chart"] == "Main" else f"Chart {c['chart']}"), "section": section.group(1) if section else "", "steps": steps(c["chart"], c["lines"])}
        old = best.get(c["chart"])
        if old is None or len(made["steps"]) > len(old["steps"]):
            if old and not c["title"]:
                made["title"] = old["title"]
            best[c["chart"]] = made
    return list(best.values())


def steps(chart: str, lines: list[str]) -> list[dict]:
    out: list[dict] = []
    labelled = any(re.match(r"\s*\*\*(?:Step\s+)?(?:[A-Z]?[0-9]+|[A-Z])\*\*", line) for line in lines)
    for line in lines:
        step = re.match(r"\s*\*\*(?:Step\s+)?([A-Z]?[0-9]+|[A-Z])\*\*[:\s]*(\S.*)$", line) if labelled else re.match(r"\s*\*\*(.{10,}?)\??\*\*", line)
        branch = re.match(r"\s*[-*•]\s*\*{0,2}(Yes|No)\b\*{0,2}\s*[→:–-]?\s*(.*?)\s*$", line, re.IGNORECASE)
        if branch and out:
            way = branch.group(1).lower()
            out[-1].setdefault(way, branch.group(2) or ("significant" if way == "yes" else "non-significant"))
        elif step:
            label, question = (step.group(1), step.group(2)) if labelled else (f"{chart}{len(out) + 1}", step.group(1))
            if labelled:
                label = f"Main-{label}" if chart == "Main" and len(label) == 1 else f"{chart}{label}" if label[0].isdigit() and chart != "Main" else label
            question = re.sub(r"\s+", " ", question).strip(" *")
            out.append({"id": label, "question": question if question.endswith("?") else question + "?"})
        elif labelled and out and line.strip() and not out[-1].get("yes") and not out[-1].get("no") and not line.lstrip().startswith(("-", "*", "•", "#")):
            out[-1]["question"] = out[-1]["question"].rstrip("?") + " " + line.strip() + ("" if line.strip().endswith("?") else "?")
    return out


def sections(text: str) -> list[dict]:
    """level, number, title, body, chart of each heading's section, in order; footnotes end the text."""
    out: list[dict] = []
    opened, charts_seen = False, set()
    for line in (text or "").split("\n"):
        heading = _HEADING.match(line.strip())
        if not heading:
            if out and opened:
                out[-1]["lines"].append(line)
            continue
        level, title = len(heading.group(1)), heading.group(2)
        if level < 4 and re.fullmatch("footnotes", title, re.IGNORECASE):
            break
        if level < 4 and re.fullmatch("contents", title, re.IGNORECASE):
            continue
        chart = re.fullmatch(r"(?:design changes.*–\s*)?(?:chart\s+([A-Z])|(main\s+chart)|([A-Z]))(?:\s*[-–:].*)?", title, re.IGNORECASE) if level < 4 else None
        if chart:
            name = "Main" if chart.group(2) else (chart.group(1) or chart.group(3)).upper()
            if level == 3 and name in charts_seen and out and out[-1]["chart"]:
                out[-1]["lines"].append(line.strip())
                continue
            charts_seen.add(name)
            opened = True
            out.append({"level": level, "number": None, "title": _plain(title), "chart": name, "lines": []})
            continue
        if level == 1 and re.match(r"MDCG\s+[0-9]{4}[–-][0-9]+|Guidance\s+on\s+", title, re.IGNORECASE):
            continue
        numbered = _NUMBERED.fullmatch(title)
        title = _plain(numbered.group(2) if numbered else title)
        opened = opened or bool(numbered and not re.search(r"\s[0-9]{1,3}$", title))
        if opened:
            out.append({"level": max(2, level), "number": numbered.group(1) if numbered else None, "title": title, "chart": None, "lines": []})
    return [{**{k: s[k] for k in ("level", "number", "title", "chart")}, "body": "\n".join(s["lines"]).strip()} for s in out]


def _plain(title: str) -> str:
    return re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", re.sub(r"<sup>.*?</sup>", "", title, flags=re.IGNORECASE)).strip()


def tree(text: str | None, doc_id: str, name: str) -> list[dict]:
    """The nodes of a guidance document: each section below the nearest section of a smaller level, charts below the last main one."""
    if text is None:
        return []
    root = {"id": f"{doc_id}_document", "kind": "guidance_document", "number": None, "title": name, "text": name, "path": [f"{doc_id}_document"]}
    rows, ids, open_ = [root], {root["id"]}, [(0, root)]
    for s in sections(text):
        if s["chart"]:
            kind, local, number, level = "guidance_chart", f"chart_{s['chart']}", s["chart"], 2
        else:
            level, number = s["level"], s["number"]
            deep = number.count(".") if number else max(0, level - 2)
            kind = ("guidance_section", "guidance_subsection", "guidance_paragraph")[min(deep, 2)]
            local = "sec_" + number.replace(".", "_") if number else re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", s["title"].lower()))[:50]
        node_id = f"{doc_id}_{local}"
        if node_id in ids:
            node_id = f"{node_id}_{len(rows)}"
        ids.add(node_id)
        while open_[-1][0] >= level:
            open_.pop()
        parent = open_[-1][1]
        row = {"id": node_id, "kind": kind, "number": number, "title": s["title"], "text": "\n\n".join(t for t in (s["title"], s["body"]) if t), "path": [*parent["path"], node_id]}
        rows.append(row)
        open_.append((level, row))
    return rows


NODE = T.StructType([T.StructField("celex", T.StringType()), T.StructField("seq", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("id", "kind", "number", "title", "text", "parent_id")], T.StructField("path", T.ArrayType(T.StringType()))])


def parse(documents: DataFrame) -> DataFrame:
    """The nodes of guidance documents (celex, name, text)."""
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.list_(pa.string())]

    def run(batches):
        for b in batches:
            for celex, name, text in zip(*(b.column(c).to_pylist() for c in ("celex", "name", "text"))):
                rows = [(celex, n, r["id"], r["kind"], r["number"], r["title"], r["text"], r["path"][-2] if len(r["path"]) > 1 else None, r["path"]) for n, r in enumerate(tree(text, celex or "", name or ""))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=NODE.names)

    return documents.select("celex", "name", "text").mapInArrow(run, NODE)
