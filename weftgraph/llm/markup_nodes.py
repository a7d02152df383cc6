"""Candidate markup of a text as a tree of nodes, and the features of each node (problem 2).

A tolerant parser: wherever a character could begin markup of one of four languages, the construct that fits best there
becomes a node, whether or not it is one, and so does what stands inside it. A node has its own marks and an extent, the
stretch it opens (an element up to its closing tag, a table up to its end); a node's parent is the innermost node whose
extent is open where it begins. Code, comments, formulas and verbatim environments are opaque once accepted. What a node
really is, is for the trees to say.

Nothing is looked for within a fixed distance: closing marks come from tables of places that are made once per text, so
the work is linear in its length.
"""

from __future__ import annotations

import html.entities
import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np

from weftgraph.functions.shipping import by_value

LANGUAGES = ("html", "markdown", "wiki", "latex")
# Names that HTML, LaTeX and MediaWiki define.
TAGS = frozenset("a abbr acronym address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split())
RAW_TAGS = frozenset(("pre", "script", "style"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WIKI_TAGS = frozenset("gallery includeonly noinclude nowiki onlyinclude ref references syntaxhighlight".split())
COMMANDS = frozenset("LaTeX TeX author begin bf bfseries bibitem bibliography bibliographystyle bigskip bottomrule caption cdot centering chapter cite citep citet clearpage date documentclass em emph end eqref footnote footnotesize frac geq hline href hspace hyperref include includegraphics input int it item itshape label large ldots left leq listoffigures maketitle mathbb mathbf mathcal mathit mathrm mbox medskip midrule newcommand newenvironment newline newpage noindent normalsize par page pageref paragraph part phantom prod qquad quad ref renewcommand right scriptsize section small smallskip sqrt subparagraph subsection subsubsection sum table tableofcontents textbf textcite textit textrm textsc textsf texttt textsuperscript text textwidth thanks times title tiny today toprule underline uppercase url usepackage verb vfill vspace alpha beta gamma delta epsilon lambda mu pi sigma theta omega infty partial approx neq to".split())
MAGIC_WORDS = frozenset("NOTOC FORCETOC TOC NOEDITSECTION NEWSECTIONLINK NONEWSECTIONLINK NOGALLERY HIDDENCAT NOCONTENTCONVERT NOCC NOTITLECONVERT NOTC INDEX NOINDEX STATICREDIRECT DISAMBIG".split())
ENVIRONMENTS = frozenset("abstract align array bmatrix cases center description displaymath document enumerate equation figure flushleft flushright gather itemize list lstlisting math matrix minipage minted multline pmatrix proof quotation quote tabbing table tabular tabularx theorem titlepage verbatim verse".split())
_RAW = ("verbatim", "lstlisting", "minted", "equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "math", "displaymath")

# Kinds whose whole extent is mark: what begins inside an accepted one is no markup of its own.
SEALED = frozenset(("h_tag", "h_close", "h_broken", "h_escaped", "h_decl", "m_refdef", "m_auto"))
# kind: language, opaque
KINDS = {
    "h_comment": (0, True), "h_raw": (0, True), "h_decl": (0, False), "h_tag": (0, False), "h_close": (0, False), "h_broken": (0, False), "h_escaped": (0, False), "h_entity": (0, False), "h_angle": (0, False),
    "m_auto": (1, False), "m_image": (1, False), "m_link": (1, False), "m_reflink": (1, False), "m_refdef": (1, False), "m_foot": (1, False), "m_open": (1, False),
    "m_strong": (1, False), "m_under": (1, False), "m_strike": (1, False), "m_em": (1, False), "m_em_": (1, False), "m_star": (1, False),
    "m_fence": (1, True), "m_code": (1, True), "m_heading": (1, False), "m_setext": (1, False), "m_hash": (1, False), "m_table": (1, False), "m_tablesep": (1, False), "m_row": (1, False),
    "m_task": (1, False), "m_item": (1, False), "m_order": (1, False), "m_quote": (1, False),
    "w_list": (2, False), "w_term": (2, False), "w_link": (2, False), "w_linkend": (2, False), "w_ext": (2, False), "w_tag": (2, False), "w_template": (2, False), "w_end": (2, False), "w_brace": (2, False),
    "w_table": (2, False), "w_row": (2, False), "w_header": (2, False), "w_field": (2, False), "w_heading": (2, False), "w_bold": (2, False), "w_italic": (2, False), "w_redirect": (2, False), "w_magic": (2, False), "w_sign": (2, False),
    "l_verbatim": (3, True), "l_verb": (3, True), "l_env": (3, False), "l_command": (3, False), "l_escape": (3, False), "l_tie": (3, False), "l_display": (3, True), "l_inline": (3, True), "l_dollar": (3, True),
}
KIND_NO = {k: i for i, k in enumerate(KINDS)}
#: Parts of a structure and the kinds they must stand in to count.
PART_OF = {"m_tablesep": ("m_table",), "m_row": ("m_table",), "w_row": ("w_table",), "w_header": ("w_table",), "w_field": ("w_table", "w_template")}
EMPHASIS = frozenset(("m_strong", "m_em", "m_em_", "m_under", "m_strike", "w_bold", "w_italic"))


class Node(NamedTuple):
    """A candidate: its marks are text[begin:end], what it opens text[begin:extent]."""

    begin: int
    end: int
    kind: str
    complete: int
    named: int
    extent: int


_R = lambda p: re.compile(p)
_TAG, _BROKEN = _R(r"<(/?)([A-Za-z][A-Za-z0-9]*(?:[-:][A-Za-z0-9]+)*)(?:\s(?:[^<>\n]|\n(?!\s*\n))*)?/?>"), _R(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s+[A-Za-z-]+=\S*|(?=\s*$))")
_DECL, _AUTO = _R(r"<(?:!(?:DOCTYPE|doctype)\b[^<>]*|!\[CDATA\[|\?[a-z]+[^<>]*\?)>?"), _R(r"<[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]+>")
_ENTITY, _ESCAPED = _R(r"&(?:([A-Za-z][A-Za-z0-9]*)|#(?:[0-9]+|[xX][0-9A-Fa-f]+));"), _R(r"&(?:amp;)*lt;[/!]?([A-Za-z][A-Za-z0-9]*)")
_DESTINATION, _LEFT_OPEN = _R(r"\([ \t]*<?[^\s()<>]*(?:\([^\s()<>]*\)[^\s()<>]*)*>?(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?[ \t]*\)"), _R(r"\([^\s)]*\)?")
_EXTERNAL, _REFDEF = _R(r"\[(?:https?://|ftp://|mailto:|//)[^\s\]]+(?:[ \t]+[^\]\n]*)?\]"), _R(r"[ \t]*<?\S+>?[^\n]*")
_MAGIC, _FENCE, _TICKS = _R(r"__([A-Z]{3,})__"), _R(r"(`{3,}|~{3,})([^\n`~]*)(?:\n|$)"), _R(r"`+")
_HEADING, _HASH = _R(r"(#{1,6})[ \t]+(?=\S)"), _R(r"#+")
_TABLESEP, _ROW, _QUOTE = _R(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*\r?(?=\n|$)|\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*\r?(?=\n|$)"), _R(r"\|[^\n]*\|[ \t]*\r?(?=\n|$)"), _R(r">+[ \t]?(?=\S)")
_TASK, _ITEM, _ORDER = _R(r"[-*+] \[[ xX]\] "), _R(r"[-*+][ \t]+(?=\S)"), _R(r"\d{1,9}[.)][ \t]+(?=\S)")
_WLIST, _WTERM, _SIGN = _R(r"(?:[*:;#]*[:;][*:;#]*[*#][*:;#]*|\*+#[*#:;]*|#+[*:][*#:;]*|\*\*+(?=[ \t])|::+)[ \t]*(?=\S)"), _R(r"[;:][ \t]*(?=\S)"), _R(r"~{3,5}(?!~)")
_WHEADING, _WREDIRECT = _R(r"(={1,6})(?!=)[^\n]*?[^=\n](={1,6})[ \t]*\r?(?=\n|$)"), _R(r"#(?:REDIRECT|WEITERLEITUNG|REDIRECCIÓN|REDIRECTION)\b[^\n]*")
_WTABLE, _WROW, _WHEADER, _WFIELD = _R(r"\{\|[^\n]*"), _R(r"\|[-+][^\n|]*(?=\n|$)"), _R(r"![ \t]*\S[^\n]*"), _R(r"\|[ \t]*[\w -]+?[ \t]*=[^\n]*")
_BEGIN, _END, _COMMAND, _VERB = _R(r"\\begin\{([A-Za-z]+\*?)\}"), _R(r"\\end\{([A-Za-z]+\*?)\}"), _R(r"\\([A-Za-z]+)\*?"), _R(r"\\verb\*?([^\sA-Za-z*])")
_OPTION = _R(r"(?:\[[^\]\n]*\])*(?=\{)")
_TRIGGER = re.compile(r"[<&\[{\\$*_`~|]|\]\]|\}\}|''|!\[|^[ \t]*(?:[#=>+!;:-]|\d{1,9}[.)][ \t])", re.MULTILINE)
_SHAPES = ((1, re.compile(r"\s*[\d.,]+\s*")), (2, re.compile(r"\s*[A-Za-z]\s*")), (4, re.compile(r"(?:[^\W\d_]|[ '’,-])+")), (3, re.compile(r"\w+")))
_MATHY, _STARTS_NUMBER = re.compile(r"[\\^_={}]"), re.compile(r"\d")

# What the tables of places are made of.
_MARKS = {
    "</pre": r"(?i)</pre\b", "</script": r"(?i)</script\b", "</style": r"(?i)</style\b", "line": r"\n", "blank": r"\s", "]": r"\]", "paragraph": r"\n[ \t\r]*\n", "-->": "-->", "\\]": r"\\\]", "\\)": r"\\\)", "$$": r"\$\$", "$": r"\$", "&gt;": r"&(?:amp;)*gt;", "`": "`+", "~~": r"(?<=\S)~~", "**": r"\*\*", "__": r"(?<=[^\s_])__(?!\w)",
    "*": r"(?<=[^\s*])\*(?!\*)", "_": r"(?<=[^\s_])_(?!\w)", "'''": r"'''", "''": r"(?<!')''(?!')", "fence`": r"(?<=\n)[ \t]*`{3,}[ \t]*\r?(?=\n|$)", "fence~": r"(?<=\n)[ \t]*~{3,}[ \t]*\r?(?=\n|$)",
}
_MARKS = {k: re.compile(p) for k, p in _MARKS.items()}


class _Places:
    """Tables of where marks stand in a text, each made when it is first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.tables: dict[str, list[int]] = {}

    def next(self, mark: str, begin: int) -> int:
        """The first place of ``mark`` from ``begin`` on, or -1."""
        if mark not in self.tables:
            self.tables[mark] = [m.start() for m in _MARKS[mark].finditer(self.text)]
        at = self.tables[mark]
        k = bisect_left(at, begin)
        return at[k] if k < len(at) else -1

    def within(self, mark: str, begin: int, border: str) -> int:
        """The same, if ``border`` (a line's or paragraph's end) does not come first."""
        at = self.next(mark, begin)
        if at < 0:
            return -1
        stop = self.next(border, begin - 1)
        return at if stop < 0 or at < stop else -1


def _matched(text: str, pattern: re.Pattern, opens) -> tuple[dict[int, int], set[int]]:
    """Where each opening mark is closed, and the closing marks without an opening one."""
    stack: list[int] = []
    pairs: dict[int, int] = {}
    lone: set[int] = set()
    for m in pattern.finditer(text):
        if opens(m):
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
        else:
            lone.add(m.start())
    return pairs, lone


_BRACKETS, _BRACES, _TEMPLATES = _R(r"[\[\]]|\n[ \t\r]*\n"), _R(r"(?<!\\)[{}]"), _R(r"\{\{|\}\}")


def _square(text: str) -> dict[int, int]:
    """Pairs of square brackets; a blank line ends what is open."""
    stack: list[int] = []
    pairs: dict[int, int] = {}
    for m in _BRACKETS.finditer(text):
        c = text[m.start()]
        if c == "[":
            stack.append(m.start())
        elif c == "]":
            if stack:
                pairs[stack.pop()] = m.start()
        else:
            stack.clear()
    return pairs


def _tables(text: str) -> list[tuple[int, int, str, int]]:
    """(begin, end, kind, complete) of tables as wholes: wiki tables, and runs of Markdown rows around a separator line."""
    out, open_, at, above, rows = [], [], 0, -1, -1
    size = len(text)
    while at < size:
        stop = text.find("\n", at)
        stop = size if stop < 0 else stop
        line = text[at:stop].strip()
        if line.startswith("{|"):
            open_.append(at)
        elif line.startswith("|}") and open_:
            out.append((open_.pop(), stop, "w_table", 1))
        elif not line and open_:  # a table may hold blank lines; an open one ends at the first if it is never closed
            pass
        if rows >= 0 and "|" not in line:
            out.append((rows, at, "m_table", 1))
            rows = -1
        elif rows < 0 and above >= 0 and "-" in line and not open_ and _TABLESEP.match(text, at + len(text[at:stop]) - len(text[at:stop].lstrip())):
            rows = above
        above = at if "|" in line else -1
        at = stop + 1
    if rows >= 0:
        out.append((rows, size, "m_table", 1))
    for b in open_:
        end = _MARKS["paragraph"].search(text, b)
        out.append((b, end.start() if end else size, "w_table", 0))
    return sorted(out)


def nodes(text: str) -> list[Node]:
    """The candidates in order, those inside others too: which of them count is for decode()."""
    size = len(text)
    places = _Places(text)
    square = _square(text)
    curly, _ = _matched(text, _BRACES, lambda m: m.group() == "{")
    doubled, lone_ends = _matched(text, _TEMPLATES, lambda m: m.group() == "{{")
    closers, curly_closers = set(square.values()), set(curly.values())
    link_ends = {c - 1 for p, c in square.items() if p + 1 in square and square[p + 1] == c - 1}
    out: list[Node] = [Node(b, b, kind, complete, int("class" in text[b : text.find("\n", b)] or "style" in text[b : text.find("\n", b)]), e) for b, e, kind, complete in _tables(text) if kind == "m_table"]
    wiki_tables = {b: (e, complete) for b, e, kind, complete in _tables(text) if kind == "w_table"}
    tags: dict[str, list[int]] = {}
    environments: dict[str, list[int]] = {}
    at = line = 0
    for t in _TRIGGER.finditer(text):
        p = t.start()
        lead = t.group()
        while lead[0] in " \t":
            p, lead = p + 1, lead[1:]
        if p < at:
            continue
        c = lead[0]
        line = max(line, text.rfind("\n", line, p) + 1)
        bol = not text[line:p].strip(" \t") if p - line < 64 else False
        begin_of_line = p == line
        hit: Node | None = None
        took = 1  # characters of the opening mark
        if c == "<":
            if text.startswith("<!--", p):
                close = places.next("-->", p + 4)
                end = close + 3 if close >= 0 else p + 4
                hit, took = Node(p, end, "h_comment", int(close >= 0), 1, end), 4
            elif m := _AUTO.match(text, p):
                hit = Node(p, m.end(), "m_auto", 1, int("://" in m.group()), m.end())
            elif m := _DECL.match(text, p):
                hit = Node(p, m.end(), "h_decl", int(m.group().endswith(">")), 1, m.end())
            elif m := _TAG.match(text, p):
                name, end = m.group(2).lower(), m.end()
                named = 1 if name in TAGS else 2 if "-" in name else 0
                kind = "w_tag" if name in WIKI_TAGS else "h_close" if m.group(1) else "h_tag"
                complete = 2 if name in VOID or m.group().endswith("/>") else 1
                if m.group(1):
                    waiting = tags.get(name) if kind == "h_close" else None
                    if waiting:
                        k = waiting.pop()
                        out[k] = out[k]._replace(complete=2, extent=end)
                        complete = 2
                elif complete == 1 and kind == "h_tag":
                    tags.setdefault(name, []).append(len(out))
                hit = Node(p, end, kind, complete, named, end)
                if kind == "h_tag" and name in RAW_TAGS and (close := places.next("</" + name, end)) >= 0:
                    stop = text.find(">", close)
                    stop = stop + 1 if stop >= 0 else size
                    hit, took = Node(p, stop, "h_raw", 2, 1, stop), end - p
                    tags[name].pop()
            elif m := _BROKEN.match(text, p):
                end = max(m.end(), p + 1)
                hit = Node(p, end, "h_broken", 0, int(m.group(1).lower() in TAGS), end)
            else:
                hit = Node(p, p + 1, "h_angle", 0, 0, p + 1)
        elif c == "&":
            if m := _ESCAPED.match(text, p):
                close = places.within("&gt;", m.end(), "line")
                end = text.find(";", close + 4 if text.startswith("&amp;", close) else close) + 1 if close >= 0 else m.end()
                hit = Node(p, end, "h_escaped", int(close >= 0), int(m.group(1).lower() in TAGS), end)
            elif m := _ENTITY.match(text, p):
                hit = Node(p, m.end(), "h_entity", 1, int(m.group(1) is None or m.group(1) + ";" in html.entities.html5), m.end())
        elif c == "!":
            if lead == "![":
                close = square.get(p + 1, -1)
                m = (_DESTINATION.match(text, close + 1) or _LEFT_OPEN.match(text, close + 1)) if close >= 0 else None
                if m:
                    hit, took = Node(p, m.end(), "m_image", int(m.group().endswith(")")), int("/" in m.group() or "." in m.group()), m.end()), 2
                elif close >= 0 and text.startswith("[", close + 1) and close + 1 in square:
                    end = square[close + 1] + 1
                    hit, took = Node(p, end, "m_image", 1, 0, end), 2
            elif bol and (m := _WHEADER.match(text, p)):
                hit = Node(p, m.end(), "w_header", 1, 0, m.end())
        elif c == "[":
            close = square.get(p, -1)
            if text.startswith("[[", p):
                took = 2
                if close >= 0 and square.get(p + 1) == close - 1:
                    inner = text[p + 2 : close - 1]
                    hit = Node(p, close + 1, "w_link", 1, 1 + int(":" in inner or "|" in inner), close + 1)
                else:
                    hit = Node(p, p + 2, "w_link", 0, int(text[p + 2 : p + 3].isalpha()) + 2 * int(places.within("]", p + 2, "line") < 0), p + 2)
            elif text.startswith("[^", p) and close > p + 2:
                end = close + 1 + text.startswith(":", close + 1)
                hit = Node(p, end, "m_foot", 1, int(end > close + 1), end)
            elif m := _EXTERNAL.match(text, p):
                hit = Node(p, m.end(), "w_ext", 1, int(" " in m.group()), m.end())
                if text[m.end() : m.end() + 1] in ("(", "["):
                    hit = Node(p, p + 1, "m_open", 0, 0, p + 1)
            elif close > p + 1:
                behind = text[close + 1 : close + 2]
                if behind == ":" and bol and (m := _REFDEF.match(text, close + 2)):
                    hit = Node(p, m.end(), "m_refdef", 1, int("://" in m.group() or text[close + 2 : m.end()].strip()[:1] in "</#."), m.end())
                elif behind == "(" and (m := _DESTINATION.match(text, close + 1) or _LEFT_OPEN.match(text, close + 1)):
                    hit = Node(p, m.end(), "m_link", int(m.group().endswith(")")), int("://" in m.group()) + int("/" in m.group() or "#" in m.group() or "." in m.group()), m.end())
                elif behind == "[" and close + 1 in square:
                    end = square[close + 1] + 1
                    hit = Node(p, end, "m_reflink", 1, int(text[p + 1 : close].replace(" ", "").isalpha()), end)
                else:
                    hit = Node(p, p + 1, "m_open", 1, 0, p + 1)
            else:
                hit = Node(p, p + 1, "m_open", 0, 0, p + 1)
        elif c == "]":
            if p not in link_ends:
                hit, took = Node(p, p + 2, "w_linkend", 0, int(p not in closers) + int(p + 1 not in closers), p + 2), 2
        elif c == "}":
            if p in lone_ends:
                hit, took = Node(p, p + 2, "w_end", 0, int(p not in curly_closers) + int(p + 1 not in curly_closers), p + 2), 2
        elif c == "{":
            if bol and (m := _WTABLE.match(text, p)):
                extent, complete = wiki_tables.get(line, (m.end(), 0))
                hit, took = Node(p, m.end(), "w_table", 1 + complete, int("class" in m.group() or "style" in m.group()), max(extent, m.end())), 2
            elif text.startswith("{{", p):
                close = doubled.get(p, -1)
                inner = text[p + 2 : close if close >= 0 else min(size, max(p + 2, places.next("line", p + 2)))]
                named = int("|" in inner) + int(inner[:1].isalpha())
                end = close + 2 if close >= 0 else p + 2
                stop = places.next("paragraph", p)
                hit, took = Node(p, end, "w_template", int(close >= 0), named, end if close >= 0 else stop if stop >= 0 else size), 2
            else:
                hit = Node(p, p + 1, "w_brace", 0, 0, p + 1)
        elif c == "|":
            if bol and text.startswith("|}", p):
                hit, took = Node(p, p + 2, "w_row", 1, 1, p + 2), 2
            elif bol and (m := _TABLESEP.match(text, p)):
                hit, took = Node(p, m.end(), "m_tablesep", 1, 1, m.end()), m.end() - p
            elif bol and (m := _WROW.match(text, p)):
                hit, took = Node(p, m.end(), "w_row", 1, 0, m.end()), m.end() - p
            elif bol and (m := _ROW.match(text, p)):
                hit = Node(p, m.end(), "m_row", 1, int(m.group().count("|") > 2), m.end())
            elif bol and (m := _WFIELD.match(text, p)):
                hit = Node(p, m.end(), "w_field", 1, 0, m.end())
            elif bol:
                stop = places.next("line", p)
                hit = Node(p, p + 1, "w_field", 0, int("||" in text[p : stop if stop >= 0 else size]), p + 1)
        elif c == "\\":
            if m := _VERB.match(text, p):
                stop = places.next("line", m.end())
                close = text.find(m.group(1), m.end(), stop if stop >= 0 else size)
                end = close + 1 if close >= 0 else m.end()
                hit, took = Node(p, end, "l_verb", int(close >= 0), 1, end), m.end() - p
            elif m := _BEGIN.match(text, p):
                name = m.group(1)
                close = text.find(f"\\end{{{name}}}", m.end()) if name in _RAW else -1
                if close >= 0:
                    end = close + len(name) + 6
                    hit, took = Node(p, end, "l_verbatim", 1, 1, end), m.end() - p
                else:
                    environments.setdefault(name, []).append(len(out))
                    hit, took = Node(p, m.end(), "l_env", 1, int(name.rstrip("*") in ENVIRONMENTS), m.end()), m.end() - p
            elif m := _END.match(text, p):
                name, complete = m.group(1), 1
                if environments.get(name):
                    k = environments[name].pop()
                    out[k] = out[k]._replace(complete=2, extent=m.end())
                    complete = 2
                hit, took = Node(p, m.end(), "l_env", complete, int(name.rstrip("*") in ENVIRONMENTS), m.end()), m.end() - p
            elif text.startswith("\\[", p) or text.startswith("\\(", p):
                mark = "\\]" if text[p + 1] == "[" else "\\)"
                close = places.within(mark, p + 2, "paragraph")
                end = close + 2 if close > p + 2 else p + 2
                hit, took = Node(p, end, "l_display" if mark == "\\]" else "l_inline", int(end > p + 2), int(bool(_MATHY.search(text, p + 2, max(p + 2, end - 2)))), end), 2
            elif m := _COMMAND.match(text, p):
                a = _OPTION.match(text, m.end())
                closed = bool(a) and a.end() in curly
                hit, took = Node(p, a.end() + 1 if a else m.end(), "l_command", 2 if closed else 1 if a else 0, int(m.group(1) in COMMANDS), curly[a.end()] + 1 if closed else a.end() + 1 if a else m.end()), m.end() - p
            else:
                hit, took = Node(p, min(size, p + 2), "l_escape", int(text[p + 1 : p + 2] in "%&_#$\\"), 0, min(size, p + 2)), 2
        elif c == "$":
            if text.startswith("$$", p):
                close = places.within("$$", p + 2, "paragraph")
                end = close + 2 if close > p + 2 else p + 2
                hit, took = Node(p, end, "l_display", int(end > p + 2), int(bool(_MATHY.search(text, p + 2, max(p + 2, end - 2)))), end), 2
            elif (close := places.within("$", p + 1, "line")) > p + 1:
                hit = Node(p, close + 1, "l_dollar", 1 + int(not (text[p + 1].isspace() or text[close - 1].isspace())), int(bool(_MATHY.search(text, p + 1, close))), close + 1)
        elif c == "*":
            if bol and (m := _TASK.match(text, p)):
                hit, took = Node(p, m.end(), "m_task", 1, 0, m.end()), m.end() - p
            elif bol and (m := _ITEM.match(text, p)):
                hit, took = Node(p, m.end(), "m_item", 1, 0, m.end()), m.end() - p
            elif begin_of_line and (m := _WLIST.match(text, p)):
                hit, took = Node(p, m.end(), "w_list", 1, 0, m.end()), m.end() - p
            elif text.startswith("**", p):
                took = 3 if text.startswith("***", p) else 2
                close = places.within("**", p + took + 1, "paragraph")
                end = close + 2 + text.startswith("*", close + 2) if close >= 0 else p + took
                tight = not text[p + took : p + took + 1].isspace() and not (close >= 0 and text[close - 1].isspace())
                hit = Node(p, end, "m_strong", int(close >= 0), int(tight), end)
            elif (close := places.within("*", p + 1, "paragraph")) > p + 1 and text[p + 1] not in " \t\r\n*":
                hit = Node(p, close + 1, "m_em", 1, int(text[p + 1].isalnum()), close + 1)
            else:
                hit = Node(p, p + 1, "m_star", 0, 0, p + 1)
        elif c == "_":
            before = text[p - 1 : p]
            if m := _MAGIC.match(text, p):
                hit, took = Node(p, m.end(), "w_magic", 1, int(m.group(1) in MAGIC_WORDS), m.end()), m.end() - p
            elif text.startswith("__", p) and not before.isalnum() and text[p + 2 : p + 3] not in ("", " ", "_", "\n", "\t"):
                close = places.within("__", p + 3, "paragraph")
                took = 2
                if close >= 0:
                    hit = Node(p, close + 2, "m_under", 1, _word_kind(text[p + 2 : close]), close + 2)
            elif not (before.isalnum() or before == "_") and text[p + 1 : p + 2] not in ("", " ", "_", "\n", "\t", "\r") and (close := places.within("_", p + 2, "paragraph")) >= 0:
                hit = Node(p, close + 1, "m_em_", 1, _word_kind(text[p + 1 : close]), close + 1)
        elif c == "`":
            if bol and (m := _FENCE.match(text, p)):
                hit, took = _fence(text, places, p, m), len(m.group(1))
            else:
                ticks = _TICKS.match(text, p).end() - p
                close = places.within("`", p + ticks, "paragraph")
                while close >= 0 and _TICKS.match(text, close).end() - close != ticks and ticks > 1:
                    close = places.within("`", _TICKS.match(text, close).end(), "paragraph")
                took = ticks
                if close > p + ticks - 1 and (ticks > 1 or places.within("`", p + 1, "line") >= 0):
                    end = min(size, close + ticks)
                    hit = Node(p, end, "m_code", 1, int(not text[p - 1 : p].isalnum()), end)
        elif c == "~":
            if bol and (m := _FENCE.match(text, p)) and (fence := _fence(text, places, p, m)).complete:
                hit, took = fence, len(m.group(1))
            elif m := _SIGN.match(text, p):
                hit, took = Node(p, m.end(), "w_sign", 1, int(m.end() - p == 4), m.end()), m.end() - p
            elif text.startswith("~~", p):
                close = places.within("~~", p + 3, "paragraph")
                took = 2
                end = close + 2 if close >= 0 else p + 2
                hit = Node(p, end, "m_strike", int(close >= 0), int(not text[p + 2 : p + 3].isspace()), end)
            elif text.startswith("~\\", p):
                hit = Node(p, p + 1, "l_tie", 1, 1, p + 1)
        elif c == "'":
            took = 3 if text.startswith("'''", p) else 2
            close = places.within("'" * took, p + took + 1, "paragraph")
            end = close + took if close >= 0 else p + took
            hit = Node(p, end, "w_bold" if took == 3 else "w_italic", int(close >= 0), int(not text[p + took : p + took + 1].isspace()), end)
            if took == 3:
                while text[p + took : p + took + 1] == "'":
                    took += 1
        elif c == "#":
            if begin_of_line and (m := _WREDIRECT.match(text, p)):
                hit = Node(p, m.end(), "w_redirect", int("[[" in m.group()), 1, m.end())
                took = m.group().find("[[") if "[[" in m.group() else m.end() - p
            elif begin_of_line and (m := _WLIST.match(text, p)):
                hit, took = Node(p, m.end(), "w_list", 1, 0, m.end()), m.end() - p
            elif m := _HEADING.match(text, p):
                stop = places.next("line", p)
                title = text[m.end() : stop if stop >= 0 else size].rstrip()
                hit, took = Node(p, m.end(), "m_heading", 1 + int(title[-1:] not in ".,;:"), min(3, title.count(" ")), m.end()), m.end() - p
            else:
                took = _HASH.match(text, p).end() - p
                hit = Node(p, p + took, "m_hash", 0, 0, p + took)
        elif c == "=":
            if m := _WHEADING.match(text, p):
                hit, took = Node(p, m.end(), "w_heading", 1 + int(m.group(1) == m.group(2)), len(m.group(1)), m.end()), len(m.group(1))
            else:
                hit = _setext(text, p)
        elif c in ";:":
            if begin_of_line and (m := _WLIST.match(text, p)):
                hit, took = Node(p, m.end(), "w_list", 1, 0, m.end()), m.end() - p
            elif begin_of_line and (m := _WTERM.match(text, p)):
                hit, took = Node(p, m.end(), "w_term", 1, int(c == ";") + int(c == ";" and ":" in text[p : max(p, places.next("line", p))]), m.end()), m.end() - p
        elif c.isdigit():
            m = _ORDER.match(text, p)
            if m:
                hit, took = Node(p, m.end(), "m_order", 1, int(m.group()[:2] in ("1.", "1)")), m.end()), m.end() - p
        elif c == "-":
            if m := _TASK.match(text, p):
                hit, took = Node(p, m.end(), "m_task", 1, 0, m.end()), m.end() - p
            elif m := _ITEM.match(text, p):
                hit, took = Node(p, m.end(), "m_item", 1, 0, m.end()), m.end() - p
            else:
                hit = _setext(text, p)
        elif c == ">":
            if m := _QUOTE.match(text, p):
                hit, took = Node(p, m.end(), "m_quote", 1, 0, m.end()), m.end() - p
        elif c == "+" and (m := _ITEM.match(text, p)):
            hit, took = Node(p, m.end(), "m_item", 1, 0, m.end()), m.end() - p
        if hit:
            if hit.kind == "m_setext":
                took = hit.end - p
            out.append(hit)
            at = p + max(1, took)
    out.sort(key=lambda n: (n.begin, -n.extent))
    return out


def _word_kind(inner: str) -> int:
    """0 for more than a word, 1 for a name with underscores or digits, 2 for a small ASCII word, 3 for another word."""
    if not inner.isidentifier():
        return 0
    return 1 if not inner.isalpha() else 2 if inner.isascii() and inner.islower() else 3


def closing(text: str, node: Node) -> int:
    """Where the closing mark of a complete emphasis begins; the node's end if it has none."""
    b, e, kind, complete = node[:4]
    if not complete:
        return e
    if kind == "m_strong":
        return e - (3 if text[e - 3 : e] == "***" and text[b : b + 3] == "***" else 2)
    return e - {"m_em": 1, "m_em_": 1, "m_under": 2, "m_strike": 2, "w_bold": 3, "w_italic": 2}.get(kind, 0)


def _fence(text: str, places: _Places, p: int, m: re.Match) -> Node:
    mark = m.group(1)
    close = places.next("fence" + mark[0], m.end())
    while close >= 0 and not text[close:].lstrip(" \t").startswith(mark):
        close = places.next("fence" + mark[0], close + 1)
    end = text.find("\n", close) if close >= 0 else m.end()
    end = len(text) if end < 0 else end
    return Node(p, end, "m_fence", int(close >= 0), 1, end)


def _setext(text: str, p: int) -> Node | None:
    end = p
    while end < len(text) and text[end] == text[p]:
        end += 1
    stop = end
    while stop < len(text) and text[stop] in " \t\r":
        stop += 1
    if end - p < 2 or (stop < len(text) and text[stop] != "\n"):
        return None
    above = text[max(0, text.rfind("\n", 0, max(0, p - 1)) + 1) : max(0, p - 1)].strip()
    return Node(p, end, "m_setext", int(bool(above)), int(abs(len(above) - (end - p)) <= 3), end)


def parents(found: list[Node]) -> list[int]:
    """The index of each node's parent, the innermost one that is open where the node begins; -1 for none."""
    out, stack = [], []
    for i, n in enumerate(found):
        while stack and found[stack[-1]].extent <= n.begin:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        if n.extent > n.end or n.end > n.begin + 1:
            stack.append(i)
    return out


def _class(c: str) -> int:
    if not c:
        return 0
    if c in "\r\n":
        return 1
    if c.isspace():
        return 2
    if c.isdigit():
        return 3
    if c.isalpha():
        return 4
    return 5 if c in ".,;:!?" else 6 if c in "\"'()[]{}<>" else 7 if c == "\\" else 8


def _shape(text: str, n: Node, places: _Places) -> int:
    """What a node encloses: nothing, a number, one letter, an identifier, words, something mathematical, a number first, other.

    Of a mark that nothing closes, the word behind it.
    """
    if n.end - n.begin <= 3 and not n.complete:
        stop = places.next("blank", n.end)
        stop = len(text) if stop < 0 else stop
        if stop - n.end > 40:  # no word
            return 7
        inner = text[n.end : stop].rstrip(".,;:?!")
    elif n.kind == "l_command" or n.end - n.begin <= 2:
        return 0
    else:
        inner = text[n.begin : n.end].strip("$*_~`'=[]{}()<>\\/!#|&;")
    if not inner:
        return 0
    for no, pattern in _SHAPES:
        if pattern.fullmatch(inner):
            return no
    return 5 if _STARTS_NUMBER.match(inner) else 6 if _MATHY.search(inner) else 7


WIDTH = 23


def features(text: str, found: list[Node]) -> np.ndarray:
    """One row of small integers per node: what it is and holds, what stands around it, and its place in the tree.

    The tree gives depth, siblings (nodes of its kind with the same parent), density of the subtree (descendants to 64
    characters of the extent) and whether the parent is of its language.
    """
    x = np.zeros((len(found), WIDTH), dtype=np.int64)
    up = parents(found)
    # bytes above 127 stand for any character that is not ASCII, most of them letters
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.minimum(raw, 128).astype(np.uint8)
    table = np.zeros((4, 129), np.int32)
    table[0, 48:58] = 1  # digits
    table[1, [c for c in range(33, 127) if not chr(c).isalnum()]] = 1  # marks
    table[2, [9, 10, 32]] = 1  # blanks
    table[3, [ord("="), ord('"')]] = 1  # attribute marks
    sums = [np.concatenate([[0], np.cumsum(row[codes])]).tolist() for row in table]
    count = lambda what, b, e: sums[what][e] - sums[what][b]
    below, siblings, kin = [0] * len(found), {}, [0, 0, 0, 0]
    depth = [0] * len(found)
    for i in range(len(found) - 1, -1, -1):
        if up[i] >= 0:
            below[up[i]] += below[i] + 1
        key = (up[i], found[i].kind)
        siblings[key] = siblings.get(key, 0) + 1
        kin[KINDS[found[i].kind][0]] += 1
    last_end, last_line = [-(1 << 30)] * 4, {}
    next_to = [0] * len(found)
    lines = [m.start() for m in _MARKS["line"].finditer(text)]
    places = _Places(text)
    for i, (b, e, kind, complete, named, extent) in enumerate(found):
        depth[i] = depth[up[i]] + 1 if up[i] >= 0 else 0
        line = bisect_left(lines, b)
        first = line == 0 or not text[lines[line - 1] + 1 : b].strip() if b - (lines[line - 1] if line else 0) < 64 else False
        if first:  # like nodes that begin neighbouring lines, a blank one may lie between
            if kind in last_line and line - last_line[kind][0] in (1, 2):
                next_to[i] += 1
                next_to[last_line[kind][1]] += 1
            last_line[kind] = (line, i)
        language = KINDS[kind][0]
        size = max(1, e - b)
        near = b - last_end[language]
        alone = 2 if first and not text[e : lines[line] if line < len(lines) else len(text)].strip() else int(first)
        x[i] = (
            KIND_NO[kind], _class(text[b - 1] if b else ""), _class(text[e] if e < len(text) else ""), complete, named, min(15, size.bit_length()),
            min(7, count(3, b, e)), min(7, count(2, b, e) + 1), 7 * count(0, b, e) // size, min(7, depth[i]), min(7, siblings[up[i], kind]),
            min(7, kin[language].bit_length()), 7 * count(1, b, e) // size, 0 if near < 3 else 1 if near < 40 else 2 if near < 400 else 3,
            min(15, 64 * below[i] // max(1, extent - b)), _class(text[b + 1] if b + 1 < len(text) else ""), _class(text[e - 2] if e - 2 > b else ""),
            alone, 0 if up[i] < 0 else 1 + int(KINDS[found[up[i]].kind][0] == language), min(2, next_to[i]), _shape(text, found[i], places),
            min(7, (extent - e).bit_length() // 2), max(0, min(15, line - bisect_left(lines, last_end[language]) if last_end[language] >= 0 else 15)),
        )
        last_end[language] = max(last_end[language], e)
    return x


by_value(__name__)
