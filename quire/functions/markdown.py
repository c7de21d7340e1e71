"""Markdown as XHTML, for the documents of reflowable packages. Plain Python: a book's text is one row."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape

_FENCE = re.compile(r"^```")
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_RULE = re.compile(r"^\s{0,3}(?:\*[ \t]*){3,}$")
_ITEM = re.compile(r"^\s{0,3}(?:[-+*]|(\d{1,9})[.)])\s+(.*)$")
_NOTE = re.compile(r"^\[\^([^\]\s]+)\]:\s?(.*)$")
_INLINE = re.compile(r"`([^`]+)`|\*\*([^*]+)\*\*|\*([^*\s][^*]*)\*|\[\^([^\]\s]+)\](?!:)|\[([^\]]*)\]\(([^()\s]+)\)")


@dataclass
class Section:
    """One document: its title (of its first-level heading, or ''), its body, and the titles below it."""

    title: str = ""
    lines: list[str] = field(default_factory=list)

    @property
    def subtitles(self) -> list[str]:
        found = map(_HEADING.match, outside_fences(self.lines))
        return [m[2] for m in found if m and len(m[1]) == 2]


def outside_fences(lines: list[str]) -> list[str]:
    """Lines that are neither fences nor within them."""
    inside, out = False, []
    for line in lines:
        if _FENCE.match(line):
            inside = not inside
        elif not inside:
            out.append(line)
    return out


def sections(md: str) -> list[Section]:
    """A text cut at its first-level headings, those in fences aside; what stands before the first one, if it is not
    blank, is a section without a title. A text without any line has one empty section."""
    out, inside = [Section()], False
    for line in md.split("\n"):
        if _FENCE.match(line):
            inside = not inside
        elif not inside and line.startswith("# "):
            out.append(Section(line[2:].strip()))
        out[-1].lines.append(line)
    return out[1:] if len(out) > 1 and not any(s.strip() for s in out[0].lines) else out


def inline(text: str) -> str:
    """Code, strong, emphasis, links and notes of one block; all else is escaped."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(escape(text[at : m.start()]))
        code, strong, slanted, note, label, link = m.groups()
        if code is not None:
            out.append(f"<code>{escape(code)}</code>")
        elif strong is not None:
            out.append(f"<strong>{inline(strong)}</strong>")
        elif slanted is not None:
            out.append(f"<em>{inline(slanted)}</em>")
        elif note is not None:
            out.append(f'<a epub:type="noteref" href="#note-{escape(note)}">{escape(note)}</a>')
        else:
            out.append(f'<a href="{escape(link)}">{inline(label)}</a>')
        at = m.end()
    out.append(escape(text[at:]))
    return re.sub(r"(?: {2,}|\\)\n", "<br/>\n", "".join(out))


#: Quotes within quotes beyond this are paragraphs.
MOST_QUOTES = 8


def body(lines: list[str], depth: int = 0) -> str:
    """The blocks of a section: fences, headings (second-level ones with an anchor), rules, quotes, lists, notes and
    paragraphs."""
    out: list[str] = []
    held: list[str] = []
    kind, n_head, at = "", 0, 0

    def flush() -> None:
        nonlocal held, kind
        if held:
            text = "\n".join(held)
            if kind in ("ul", "ol"):
                out.append(f"<{kind}>" + "".join(f"<li>{inline(x)}</li>" for x in held) + f"</{kind}>")
            elif kind == "quote":
                out.append(f"<blockquote>{body(held, depth + 1)}</blockquote>")
            else:
                out.append(f"<p>{inline(text)}</p>")
        held, kind = [], ""

    def to(new: str) -> None:
        nonlocal kind
        if kind != new:
            flush()
            kind = new

    while at < len(lines):
        line = lines[at]
        at += 1
        if _FENCE.match(line):
            flush()
            end = next((k for k in range(at, len(lines)) if _FENCE.match(lines[k])), len(lines))
            out.append("<pre><code>" + escape("\n".join(lines[at:end])) + "</code></pre>")
            at = end + 1
        elif not line.strip():
            flush()
        elif m := _HEADING.match(line):
            flush()
            n = len(m[1])
            n_head += n == 2
            anchor = f' id="part-{n_head}"' if n == 2 else ""
            out.append(f"<h{n}{anchor}>{inline(m[2])}</h{n}>")
        elif _RULE.match(line):
            flush()
            out.append("<hr/>")
        elif line.startswith(">") and depth < MOST_QUOTES:
            to("quote")
            held.append(line[1:].removeprefix(" "))
        elif m := _NOTE.match(line):
            flush()
            out.append(f'<aside epub:type="footnote" id="note-{escape(m[1])}"><p>{escape(m[1])}. {inline(m[2])}</p></aside>')
        elif m := _ITEM.match(line):
            to("ol" if m[1] else "ul")
            held.append(m[2])
        elif kind in ("ul", "ol") and line.startswith(" "):
            held[-1] += "\n" + line.strip()
        else:
            to("p")
            held.append(line)
    flush()
    return "\n".join(out)
