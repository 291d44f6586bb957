"""Other markup languages, rewritten line by line as Markdown and then parsed as that.

Each dialect says how its headings, lists, quotes, code, tables, rules and inline marks are written; what it has beyond
that stays as text. XML dialects are walked as trees.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from xml.etree import ElementTree

Lines = list[str]


def marked(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, new in rules:
        text = re.sub(pattern, new, text)
    return text


def fenced(lines: Lines, start: str, end: str | None = None) -> Lines:
    """Code between lines that match start and end, as fenced blocks; an open one ends with the text."""
    out, inside = [], False
    for line in lines:
        if not inside and (m := re.match(start, line)):
            out.append("```" + (m[1] or "" if m.groups() else ""))
            inside = True
        elif inside and re.match(end or start, line):
            out.append("```")
            inside = False
        else:
            out.append(line)
    return [*out, "```"] if inside else out


def outside(lines: Lines, change: Callable[[str], str]) -> Lines:
    """Each line that is not in a fenced block, changed."""
    out, inside = [], False
    for line in lines:
        if line.startswith("```"):
            inside = not inside
            out.append(line)
        else:
            out.append(line if inside else change(line))
    return out


def nested(line: str, bullets: str = "*", numbers: str = "#") -> str:
    """A list line whose depth is its number of marks."""
    m = re.match(rf"([{re.escape(bullets + numbers)}]+)\s+(.*)", line)
    return f"{'   ' * (len(m[1]) - 1)}{'-' if m[1][-1] in bullets else '1.'} {m[2]}" if m else line


def piped(lines: Lines, row: str = r"\|", head: str = r"\|\|") -> Lines:
    """Runs of table lines, with the line under the head that Markdown asks for."""
    out: Lines = []
    for line in lines:
        if re.match(row, line):
            line = re.sub(head, "|", line).replace("|_.", "|")
            first = not (out and out[-1].startswith("|"))
            out.append(line if line.rstrip().endswith("|") else f"{line} |")
            if first:
                out.append("|" + "---|" * (out[-1].count("|") - 1))
        else:
            out.append(line)
    return out


def org(text: str) -> str:
    text = re.sub(r"(?ms)^[ \t]*:(?!END)[A-Z]+:[ \t]*$.*?^[ \t]*:END:[ \t]*$", "", text)
    lines = fenced(text.split("\n"), r"(?i)\s*#\+begin_(?:src|example)\s*(\S*)", r"(?i)\s*#\+end_")
    quote = {"on": False}

    def line(x: str) -> str:
        if re.match(r"(?i)\s*#\+(begin|end)_quote", x):
            quote["on"] = "begin" in x.lower()
            return ""
        if m := re.match(r"(\*+)\s+(?:(?:TODO|DONE)\s+)?(.*?)(?:\s+:[\w:@]+:)?$", x):
            x = f"{'#' * min(6, len(m[1]))} {m[2]}"
        elif m := re.match(r"(?i)#\+title:\s*(.*)", x):
            x = f"# {m[1]}"
        elif re.match(r"\s*#\+|\s*(DEADLINE|SCHEDULED|CLOSED):", x):
            x = ""
        elif re.match(r"\s*\|[-+]+\|\s*$", x):
            x = re.sub(r"[+]", "|", x)
        x = marked(x, [(r"\[\[([^\]]+)\]\[([^\]]+)\]\]", r"[\2](\1)"), (r"\[\[([^\]]+)\]\]", r"<\1>"), (r"(?<!\w)\*(\S(?:[^*]*\S)?)\*(?!\w)", r"**\1**"), (r"(?<![\w:/])/(\S(?:[^/]*\S)?)/(?![\w/])", r"*\1*"), (r"(?<!\w)[=~](\S(?:[^=~]*\S)?)[=~](?!\w)", r"`\1`"), (r"(?<!\w)\+(\S(?:[^+]*\S)?)\+(?!\w)", r"~~\1~~")])
        return f"> {x}" if quote["on"] else x

    return "\n".join(outside(lines, line))


def rst(text: str) -> str:
    lines, out, levels, k = text.split("\n"), [], [], 0
    while k < len(lines):
        line, below = lines[k], lines[k + 1] if k + 1 < len(lines) else ""
        under = re.fullmatch(r"([^\w\s])\1*\s*", below)
        if re.fullmatch(r"([^\w\s])\1{2,}\s*", line) and k + 2 < len(lines) and lines[k + 2].strip() == line.strip() and below.strip():
            mark, k, title = line[0] * 2, k + 3, below.strip()
        elif line.strip() and under and len(below.rstrip()) >= len(line.rstrip()) and not line[0].isspace() and not re.fullmatch(r"([^\w\s])\1*\s*", line):
            mark, k, title = under[1], k + 2, line.strip()
        else:
            if m := re.match(r"(\s*)\.\. ([\w-]+)::\s*(.*)", line):
                k += 1
                own: Lines = []
                while k < len(lines) and (not lines[k].strip() or lines[k].startswith(m[1] + "  ")):
                    own.append(lines[k].strip() if m[2] not in ("code-block", "code") else lines[k][len(m[1]) + 3 :])
                    k += 1
                own = [x for x in own if not re.match(r":[\w-]+:", x)]
                if m[2] in ("code-block", "code"):
                    out += ["", f"```{m[3]}", *"\n".join(own).strip("\n").split("\n"), "```", ""]
                else:
                    out += ["", *(f"> {x}" for x in [m[3], *own] if x), ""]
                continue
            if re.match(r"\.\. ", line):
                k += 1
                continue
            if line.endswith("::") and not line.strip() == "::":
                line = line[:-1]
            out.append(re.sub(r"^(\s*)(?:#\.|\(?[0-9]+\))\s", r"\g<1>1. ", line))
            k += 1
            continue
        if mark not in levels:
            levels.append(mark)
        out += ["", f"{'#' * min(6, levels.index(mark) + 1)} {title}", ""]
    grid = [x for x in out if not re.fullmatch(r"\s*\+[-=+]+\+\s*", x)]
    change = lambda x: marked(x, [(r"``([^`]+)``", r"`\1`"), (r"`([^`<]+?)\s*<([^>`]+)>`_+", r"[\1](\2)"), (r":\w+:`([^`]+)`", r"`\1`")])
    return "\n".join(outside(piped(grid, r"\s*\|.*\|\s*$"), change))


INLINE_WIKI = [(r"<ref[^>]*/>|<ref[^>]*>.*?</ref>", ""), (r"'''(.+?)'''", r"**\1**"), (r"''(.+?)''", r"*\1*"), (r"\[\[(?:[^\]|]*\|)?([^\]|]+)\]\]", r"\1"), (r"\[(https?://\S+) ([^\]]+)\]", r"[\2](\1)"), (r"<code>(.*?)</code>", r"`\1`")]


def mediawiki(text: str) -> str:
    out: Lines = []
    for line in fenced(text.split("\n"), r"<(?:syntaxhighlight|source|pre)(?:[^>]*lang=\"?(\w+))?[^>]*>\s*$", r"</(?:syntaxhighlight|source|pre)>"):
        if m := re.match(r"(={1,6})\s*(.*?)\s*\1\s*$", line):
            out += ["", f"{'#' * len(m[1])} {m[2]}", ""]
        elif re.match(r"\{\||\|\}|\|-|\|\+", line):
            out += [] if re.match(r"\|-", line) else [""]
        elif re.match(r"[|!]", line):
            out.append("| " + re.sub(r"\|\||!!", " | ", line[1:]).strip() + " |")
        elif line.startswith("----"):
            out.append("***")
        else:
            out.append(re.sub(r"^[:;]\s*", "", nested(line)))
    return "\n".join(outside(piped(out), lambda x: marked(x, INLINE_WIKI)))


def textile(text: str) -> str:
    def line(x: str) -> str:
        x = re.sub(r"^h([1-6])(?:\([^)]*\))?\.\s+", lambda m: "#" * int(m[1]) + " ", nested(x))
        x = re.sub(r"^bq\.\s+", "> ", x)
        x = re.sub(r"^p(?:\([^)]*\))?\.\s+", "", x)
        return marked(x, [(r"@([^@]+)@", r"`\1`"), (r"(?<![\w*])\*(\S(?:[^*]*\S)?)\*(?![\w*])", r"**\1**"), (r"(?<!\w)-(\S(?:[^-]*\S)?)-(?!\w)", r"~~\1~~"), (r"\"([^\"]+)\":(\S+)", r"[\1](\2)")])

    out: Lines = []
    for part in re.split(r"\n\s*\n", text):
        code = re.match(r"bc(?:\([^)]*\))?\.+\s+", part)
        out += ["", "```", part[code.end() :], "```", ""] if code else ["", *(line(x) if not x.startswith("|") else x for x in part.split("\n")), ""]
    return "\n".join(piped(out, r"\|.*\|"))


def asciidoc(text: str) -> str:
    lines, out, table = fenced(fenced(text.split("\n"), r"-{4,}\s*$"), r"\.{4,}\s*$"), [], False
    for line in lines:
        if re.match(r"\|={3,}", line):
            table = not table
            out.append("")
        elif table:
            out += [line.rstrip() + " |"] if line.startswith("|") else []
        elif m := re.match(r"(={1,6})\s+(.*)", line):
            out += ["", f"{'#' * len(m[1])} {m[2]}", ""]
        elif m := re.match(r"(NOTE|TIP|WARNING|IMPORTANT|CAUTION):\s*(.*)", line):
            out += ["", f"> {m[2]}", ""]
        elif re.match(r"\[[^\]]*\]\s*$|:[\w-]+:|\.\w", line):
            out.append("")
        elif re.match(r"'{3,}\s*$", line):
            out.append("***")
        else:
            out.append(nested(nested(line, "*", ""), "", ".") if re.match(r"[*.]+\s", line) else line)
    change = lambda x: marked(x, [(r"(https?://[^\s\[]+)\[([^\]]+)\]", r"[\2](\1)"), (r"(?<![\w*`-])\*(\S(?:[^*]*\S)?)\*(?![\w*])", r"**\1**")])
    return "\n".join(outside(piped(out), change))


def latex(text: str) -> str:
    text = re.sub(r"(?<!\\)%.*", "", text)
    body = re.search(r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", text)
    title = re.search(r"\\title\{([^{}]*)\}", text)
    text = (f"# {title[1]}\n\n" if title else "") + (body[1] if body else text)
    levels = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
    text = re.sub(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: f"\n\n{'#' * levels[m[1]]} {m[2]}\n\n", text)
    text = marked(text, [(r"\\(?:emph|textit)\{([^{}]*)\}", r"*\1*"), (r"\\textbf\{([^{}]*)\}", r"**\1**"), (r"\\texttt\{([^{}]*)\}", r"`\1`"), (r"\\href\{([^{}]*)\}\{([^{}]*)\}", r"[\2](\1)"), (r"(?s)\\\[(.*?)\\\]", r"$$\1$$"), (r"(?s)\\begin\{(?:equation|align)\*?\}\s*(.*?)\s*\\end\{(?:equation|align)\*?\}", r"$$\1$$"), (r"\\\((.*?)\\\)", r"$\1$"), (r"\\(?:maketitle|tableofcontents|label\{[^{}]*\}|newpage|noindent)", "")])
    out, stack = [], []
    for line in fenced(text.split("\n"), r"\s*\\begin\{(?:verbatim|lstlisting)\}", r"\s*\\end\{(?:verbatim|lstlisting)\}"):
        if m := re.match(r"\s*\\begin\{(itemize|enumerate|quote|quotation)\}", line):
            stack.append(m[1])
            out += [""] if len(stack) == 1 else []
        elif re.match(r"\s*\\end\{(itemize|enumerate|quote|quotation)\}", line):
            stack = stack[:-1]
            out += [""] if not stack else []
        elif m := re.match(r"\s*\\item(?:\[[^\]]*\])?\s*(.*)", line):
            out.append(f"{'   ' * (len(stack) - 1)}{'1.' if stack and stack[-1] == 'enumerate' else '-'} {m[1]}")
        else:
            out.append(f"> {line.strip()}" if stack and stack[-1].startswith("quot") and line.strip() else line.strip())
    return "\n".join(x for x in out if not re.match(r"\\(?:begin|end|documentclass|usepackage)\{", x))


def jira(text: str) -> str:
    lines = fenced(text.split("\n"), r"\{(?:code|noformat)(?::(\w+))?[^}]*\}\s*$", r"\{(?:code|noformat)\}\s*$")
    quote = {"on": False}

    def line(x: str) -> str:
        if re.match(r"\{(quote|panel|info|note|warning|tip)[^}]*\}\s*$", x):
            quote["on"] = not quote["on"]
            return ""
        x = "***" if re.match(r"-{4,}", x) else nested(re.sub(r"^(-+)\s", lambda m: "*" * len(m[1]) + " ", x))
        x = re.sub(r"^h([1-6])\.\s+", lambda m: "#" * int(m[1]) + " ", x)
        x = re.sub(r"^bq\.\s+", "> ", x)
        x = marked(x, [(r"\{\{(.+?)\}\}", r"`\1`"), (r"(?<![\w*])\*(\S(?:[^*]*\S)?)\*(?![\w*])", r"**\1**"), (r"\[([^\]|]+)\|([^\]]+)\]", r"[\1](\2)"), (r"\{color[^}]*\}", "")])
        return f"> {x}" if quote["on"] else x

    return "\n".join(piped(outside(lines, line)))


def opml(text: str) -> str:
    out: Lines = []

    def walk(e: ElementTree.Element, depth: int) -> None:
        for child in e.findall("outline"):
            note = child.get("_note")
            out.append(f"{'  ' * depth}- {child.get('text', child.get('title', ''))}" + (f" ({note})" if note else ""))
            walk(child, min(depth + 1, 30))

    root = ElementTree.fromstring(text)
    name = root.findtext("head/title")
    body = root.find("body")
    walk(body if body is not None else root, 0)
    return "\n".join([*([f"# {name}", ""] if name else []), *out])


def docbook(text: str) -> str:
    out: Lines = []

    def words(e: ElementTree.Element) -> str:
        own = (e.text or "") + "".join(words(c) + (c.tail or "") for c in e)
        own = re.sub(r"\s+", " ", own)
        around = {"emphasis": "*", "literal": "`", "code": "`", "command": "`"}.get(e.tag.rpartition("}")[2])
        return f"{around}{own}{around}" if around else own

    def walk(e: ElementTree.Element, depth: int, indent: str) -> None:
        for c in e:
            name = c.tag.rpartition("}")[2]
            if name in ("title", "titleabbrev"):
                out.extend(["", f"{'#' * max(1, min(6, depth))} {words(c).strip()}", ""])
            elif name in ("para", "simpara", "term"):
                out.extend([indent + words(c).strip(), ""])
            elif name in ("programlisting", "screen", "literallayout"):
                out.extend(["", "```", ("".join(c.itertext())).strip("\n"), "```", ""])
            elif name in ("itemizedlist", "orderedlist"):
                for item in c:
                    lead = "-" if name == "itemizedlist" else "1."
                    out.append(f"{indent}{lead} {words(item[0]).strip() if len(item) else words(item).strip()}")
                    walk(item[1:] if len(item) else [], depth, indent + "   ")
                out.append("")
            elif name in ("note", "tip", "warning", "important", "caution", "blockquote"):
                out.extend(["", *(f"> {words(p).strip()}" for p in c if p.tag.rpartition("}")[2] != "title"), ""])
            elif name == "row":
                cells = " | ".join(words(x).strip() for x in c)
                out.append(f"| {cells} |")
            else:
                walk(c, depth + (name in ("section", "sect1", "sect2", "sect3", "chapter", "appendix", "article", "book")), indent)

    root = ElementTree.fromstring(text)
    walk(root, 1, "")
    return "\n".join(piped(out))


DIALECTS: dict[str, Callable[[str], str]] = {"org": org, "rst": rst, "mediawiki": mediawiki, "textile": textile, "asciidoc": asciidoc, "latex": latex, "jira": jira, "opml": opml, "docbook": docbook}
