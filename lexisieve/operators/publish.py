"""Pages: markdown as HTML, the index of runs, examples, turns, and a report's payload."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape
from .corpus import excerpt

# Marks of inline markdown, and the shape of rule and reference names.
CODE, LINK, BOLD, ITALIC = r"`([^`]+)`", r"\[([^\]]+)\]\(([^)]+)\)", r"\*\*([^*]+)\*\*", r"(?<!\*)\*([^*\n]+)\*(?!\*)"
AUTOLINK, REFERENCE = r"<(https?://[^>\s]+)>", r"\[([A-Z][A-Z0-9]{2,})\]"
RULE_NAME = r"\b[A-Z]{1,2}[0-9]+(?:\.[0-9]+)?\b"
_HELD = re.compile("|".join(f"(?:{p})" for p in (CODE, AUTOLINK, LINK, REFERENCE)))


def inline_html(text: str, own: str | None = None, references: str = "#references", base: str = "", rule: str = RULE_NAME) -> str:
    """Inline markdown as HTML. Code, links and reference tags are taken as they are; the rest is
    escaped (quotation marks stay), then bold, italic and names of other rules are marked."""
    entry = text.lstrip().startswith("[")  # a reference's own line does not link to itself

    def held(m: re.Match) -> str | None:
        code, auto, label, target, tag = m.groups()
        if code is not None:
            return f"<code>{html.escape(code)}</code>"
        if auto is not None:
            return f'<a href="{html.escape(auto)}">{html.escape(auto)}</a>'
        if label is not None:
            inside = not target.startswith("http") and (target.endswith(".md") or "/" in target)
            return f'<a href="{html.escape(base + target if inside else target)}">{html.escape(label)}</a>'
        return None if entry else f'<a href="{references}">[{tag}]</a>'

    kept: list[str] = []

    def put_away(m: re.Match) -> str:
        piece = held(m)
        if piece is None:
            return m.group(0)
        kept.append(piece)
        return f"\x00{len(kept) - 1}\x00"

    out = html.escape(_HELD.sub(put_away, text), quote=False)
    out = re.sub(ITALIC, r"<em>\1</em>", re.sub(BOLD, r"<strong>\1</strong>", out))
    out = re.sub(rule, lambda m: m.group(0) if m.group(0) == own else f'<a class="rule" href="#{m.group(0)}">{m.group(0)}</a>', out)
    return re.sub("\x00([0-9]+)\x00", lambda m: kept[int(m.group(1))], out)


def heading_slug(heading: str) -> str:
    return re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", heading.lower()).strip())


_BULLET, _NUMBER = re.compile(r"[-*]\s+"), re.compile(r"\d+[.)]\s+")


def _kind(line: str, after: str) -> str:
    bare = line.strip()
    if not bare:
        return "blank"
    if bare == "---":
        return "rule"
    for kind, test in (("heading", r"#{1,6}\s+"), ("table", r"\|"), ("quote", ">"), ("ul", _BULLET.pattern), ("ol", _NUMBER.pattern)):
        if re.match(test, bare):
            return kind
    if re.fullmatch(r"\*\*[^*]+\*\*", bare) and after.lstrip().startswith(":"):
        return "term"
    return "text"


def page_html(text: str, rule: str = RULE_NAME) -> str:
    """Markdown blocks as HTML: headings with anchors, rules, tables, quotes, lists, definitions, paragraphs.

    The paragraph that first defines a rule (**name**) bears the rule's name as its anchor. Lines of
    one kind make up a block; indented lines go on with a list item or a definition.
    """
    lines = text.split("\n")
    kinds = [_kind(x, y) for x, y in zip(lines, [*lines[1:], ""])]
    show = lambda x, own=None: inline_html(x, own, rule=rule)
    out, seen, i = [], set(), 0
    while i < len(lines):
        kind, j = kinds[i], i + 1
        if kind in ("table", "quote"):
            while j < len(lines) and kinds[j] == kind:
                j += 1
        elif kind in ("ul", "ol"):
            while j < len(lines) and (kinds[j] == kind or (kinds[j] != "blank" and lines[j].startswith(("  ", "\t")))):
                j += 1
        elif kind == "term":
            while j < len(lines) and (lines[j].lstrip().startswith(":") or (kinds[j] != "blank" and lines[j].startswith(" "))):
                j += 1
        elif kind == "text":
            while j < len(lines) and kinds[j] in ("text", "term"):
                j += 1
        block = [x.strip() for x in lines[i:j]]
        if kind == "rule":
            out.append("<hr>")
        elif kind == "heading":
            marks, _, title = block[0].partition(" ")
            out.append(f'<h{len(marks)} id="{heading_slug(title.strip())}">{show(title.strip())}</h{len(marks)}>')
        elif kind == "table":
            rows = [[show(c.strip()) for c in x.strip("|").split("|")] for k, x in enumerate(block) if k != 1]
            head = "".join(f"<th>{c}</th>" for c in rows[0])
            body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows[1:])
            out.append(f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
        elif kind == "quote":
            parts = re.split(r"\n{2,}", "\n".join(x[1:].strip() for x in block))
            out.append("<blockquote>\n\n" + "\n\n".join(f"<p>{show(' '.join(p.split(chr(10))))}</p>" for p in parts if p.strip()) + "\n\n</blockquote>")
        elif kind in ("ul", "ol"):
            mark, items = (_BULLET if kind == "ul" else _NUMBER), []
            for x in block:
                if m := mark.match(x):
                    items.append(x[m.end() :])
                else:
                    items[-1] += " " + x
            out.append(f"<{kind}>" + "".join(f"<li>{show(x)}</li>" for x in items) + f"</{kind}>")
        elif kind == "term":
            meaning = " ".join(re.sub(r"^:\s?", "", x) for x in block[1:])
            out.append(f"<dl><dt>{show(block[0].strip('*'))}</dt><dd>{show(meaning)}</dd></dl>")
        elif kind == "text":
            whole = " ".join(block)
            own = re.match(rf"\*\*({rule.strip(chr(92) + 'b')})\b", whole)
            name = own.group(1) if own else None
            anchor = f' id="{name}"' if name and name not in seen else ""
            seen.add(name)
            out.append(f"<p{anchor}>{show(whole, name)}</p>")
        i = j
    return "\n\n".join(out)


def _as_column(function):
    @F.arrow_udf("string")
    def run(texts):
        import pyarrow as pa

        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], pa.string())

    return run


def markdown_page(text: Column) -> Column:
    """page_html of a column. Blocks refer to each other, so this is a function of Arrow batches."""
    return _as_column(page_html)(text)


def markdown_inline(text: Column) -> Column:
    return _as_column(inline_html)(text)


# ---------------------------------------------------------------- pages of runs
def _cell(value: Column, name: str | None = None) -> Column:
    return F.concat(F.lit(f'<td class="{name}">' if name else "<td>"), F.coalesce(value, F.lit("?")), F.lit("</td>"))


def run_index(runs: DataFrame) -> DataFrame:
    """One row: the table of runs(file, date, commit, documents, arms, generation, judging, has_page), newest first."""
    esc = lambda c: html_escape(F.col(c))
    models = F.when(F.col("generation").isNull() & F.col("judging").isNull(), F.lit('<span class="missing">not recorded</span>')).otherwise(
        F.concat(F.lit("gen "), F.coalesce(esc("generation"), F.lit("?")), F.lit(", judge "), F.coalesce(esc("judging"), F.lit("?")))
    )
    link = F.concat(F.lit('<a href="'), html_escape(F.regexp_replace("file", r"\.json$", ".html")), F.lit('">report</a>'))
    row = F.concat(
        F.lit("<tr>"), _cell(esc("date")), _cell(F.concat(F.lit("<code>"), F.coalesce(esc("commit"), F.lit("?")), F.lit("</code>"))),
        _cell(F.col("documents").cast("string"), "n"), _cell(html_escape(F.nullif(F.array_join("arms", ", "), F.lit("")))), _cell(models),
        _cell(F.when(F.col("has_page"), link).otherwise(F.lit('<span class="missing">no page built</span>'))), F.lit("</tr>"),
    )
    # one row a committed run: few by nature
    rows = F.reverse(F.array_sort(F.collect_list(F.struct("file", row.alias("r")))))
    body = F.array_join(F.transform(rows, lambda x: x["r"]), "")
    head = "".join(f"<th>{h}</th>" for h in ("Date", "Commit", "Documents", "Arms", "Models", "Pages"))
    none = F.lit('<tr><td colspan="6">No results yet.</td></tr>')
    return runs.agg(F.concat(F.lit(f"<table><thead><tr>{head}</tr></thead><tbody>"), F.when(F.count("*") == 0, none).otherwise(body), F.lit("</tbody></table>")).alias("page"))


def example_panels(docs: DataFrame) -> DataFrame:
    """Each of docs(id, title, type, author, licence, url, credit, before, after) as a panel: the openings side by side."""
    esc = lambda c: html_escape(F.coalesce(F.col(c), F.lit("")))
    source = F.when(F.startswith("url", F.lit("http")), F.concat(F.lit('<a href="'), esc("url"), F.lit('">source</a>'))).otherwise(esc("url"))
    meta = F.concat(F.lit('<div class="meta">'), *[F.concat(F.lit("<span>"), x, F.lit("</span>")) for x in (esc("type"), esc("author"), esc("licence"), source)], F.lit("</div>"))
    side = lambda c, label: F.concat(F.lit(f'<div class="col {c}"><div class="label">{label}</div><div class="text">'), html_escape(F.coalesce(excerpt(F.col(c)), F.lit(""))), F.lit("</div></div>"))
    compare = F.when(F.col("after").isNull(), F.lit('<p class="missing">Not judged in a committed run yet.</p>')).otherwise(
        F.concat(F.lit('<div class="compare">'), side("before", "Before"), side("after", "After"), F.lit("</div>"))
    )
    credit = F.when(F.coalesce("credit", F.lit("")) != "", F.concat(F.lit('<p class="attribution">'), esc("credit"), F.lit("</p>"))).otherwise(F.lit(""))
    return docs.select("id", F.concat(F.lit('<div class="panel" id="panel-'), esc("id"), F.lit('"><h2>'), esc("title"), F.lit("</h2>"), meta, compare, credit, F.lit("</div>")).alias("panel"))


def turn_panels(turns: DataFrame) -> DataFrame:
    """Each of turns(name, turn, question, answer, control) as a panel: the question and both answers."""
    esc = lambda c: html_escape(F.coalesce(F.col(c), F.lit("")))
    side = lambda c, label: F.concat(F.lit(f'<div class="col"><div class="label">{label}</div><div class="text">'), esc(c), F.lit("</div></div>"))
    return turns.select("name", "turn", F.concat(F.lit('<div class="panel"><h3>'), esc("question"), F.lit("</h3>"), side("control", "Without"), side("answer", "With"), F.lit("</div>")).alias("panel"))


def report_payload(cells: DataFrame, arms: list[str], id_col: str = "doc") -> DataFrame:
    """Each document of cells(doc, title, arm, ...) as JSON: its arms in order, the source first."""
    order = [a for a in ("source",) if a in arms] + [a for a in arms if a != "source"]
    keys = [c for c in cells.columns if c not in (id_col, "title", "arm")]
    # the arms of one document: a handful
    by_arm = F.map_from_entries(F.collect_list(F.struct("arm", F.struct(*keys))))
    rows = cells.groupBy(id_col).agg(F.max("title").alias("title"), by_arm.alias("by"))
    entry = F.struct(F.col(id_col).alias("id"), "title", F.struct(*[F.try_element_at("by", F.lit(a)).alias(a) for a in order]).alias("arms"))
    return rows.select(id_col, F.to_json(entry).alias("payload"))


def page_of(template: Column, payload: Column, title: Column, note: Column) -> Column:
    """A page template with its data, title and note filled in; only the data goes in as it is."""
    out = F.replace(template, F.lit("__NOTE__"), html_escape(note))
    return F.replace(F.replace(out, F.lit("__TITLE__"), html_escape(title)), F.lit("__DATA__"), payload)
