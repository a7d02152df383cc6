"""Training texts for the markup model (problem 2): a grammar of each language's public specification, and prose.

Everything is drawn from a seed. Prose is made of syllables, numbers, dates, addresses and punctuation; look-alikes are
single expressions of a class (prices, comparisons, paths, identifiers, type names, reference marks, ...) that are set
at random places of a sentence. Constructs come from CommonMark with the usual tables, tasks, footnotes and strikes, from
HTML, MediaWiki and LaTeX; each has a name, so that whole kinds can be held out. Any construct may be broken (its end
left off), and HTML may be escaped once or twice.
"""

from __future__ import annotations

import html
import html.entities
import random
import string
from collections.abc import Callable

from weftgraph.functions.shipping import by_value
from weftgraph.llm.markup_nodes import MAGIC_WORDS, TAGS, VOID

HTML, MARKDOWN, WIKI, LATEX = range(4)
_ONSET = ("b", "br", "c", "d", "f", "g", "gl", "h", "j", "k", "l", "m", "n", "p", "pr", "qu", "r", "s", "sch", "st", "t", "tr", "v", "w", "z", "")
_RIME = ("a", "e", "i", "o", "u", "an", "el", "er", "ion", "ar", "os", "ité", "ung", "ie", "eau", "ción", "ö", "ß", "ly", "ed", "s")
_LITTLE = ("the", "of", "and", "to", "in", "is", "for", "der", "die", "und", "nicht", "mit", "le", "la", "les", "des", "est", "que", "el", "los", "para", "con", "y", "a")
_ENTITIES = tuple(sorted(n.rstrip(";") for n in html.entities.html5 if n.endswith(";") and 2 < len(n) < 9))
Span = tuple[int, int, int]


class Maker:
    """Draws words, sentences, look-alikes and constructs."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.vocabulary = ["".join(self.r.choice(_ONSET) + self.r.choice(_RIME) for _ in range(self.r.choice((1, 2, 2, 3)))) for _ in range(4000)]
        self.ascii = [x for x in self.vocabulary if x.isascii()]
        self.made = self.constructs()

    # prose

    def word(self) -> str:
        return self.vocabulary[int(self.r.random() * len(self.vocabulary))]

    def ascii_word(self) -> str:
        return self.ascii[int(self.r.random() * len(self.ascii))]

    def little(self) -> str:
        return _LITTLE[int(self.r.random() * len(_LITTLE))]

    def name(self) -> str:
        return self.word().capitalize()

    def number(self) -> str:
        r = self.r
        return r.choice((str(r.randint(0, 99)), str(r.randint(100, 9999)), f"{r.randint(1, 999)}{r.choice(',. ')}{r.randint(0, 999):03d}", f"{r.randint(0, 99)}.{r.randint(0, 99)}"))

    def words(self, least: int = 1, most: int = 5) -> str:
        pick = lambda x: self.little() if x < 0.33 else self.number() if x < 0.4 else self.word()
        return " ".join(pick(self.r.random()) for _ in range(self.r.randint(least, most)))

    def plain(self) -> str:
        """A piece of plain prose that is more than a word."""
        r = self.r
        return r.choice((
            self.number, lambda: f"{self.number()}%", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02d}", lambda: f"({self.words()})", lambda: f'"{self.words()}"', lambda: f"“{self.words()}”", lambda: f"«{self.words()}»",
            lambda: f"'{self.words(1, 2)}'", lambda: f"{self.name()}'s", lambda: f"{self.name()}-{self.name()}", lambda: f"{self.word()}—{self.word()}", lambda: f"{self.name()} {self.r.choice(string.ascii_uppercase)}. {self.name()}", lambda: f"{self.word()}/{self.word()}",
        ))()

    def sentence(self, extra: Callable[[], str] | None = None) -> str:
        """A sentence, with what ``extra`` gives set at random places."""
        r = self.r
        parts = [self.little() if r.random() < 0.35 else self.plain() if r.random() < 0.12 else self.word() for _ in range(r.randint(3, 14))]
        for _ in range(r.choice((1, 1, 2, 3)) if extra else 0):
            parts.insert(r.randint(1, len(parts)), extra())  # not first, where it could be a block
        for k in range(len(parts) - 1):
            if r.random() < 0.08:
                parts[k] += r.choice(",;:")
        parts[0] = parts[0][:1].upper() + parts[0][1:]
        return " ".join(parts) + r.choice("....?!")

    # look-alikes, by class

    def identifier(self) -> str:
        r, w = self.r, self.ascii_word
        return r.choice((f"{w()}_{w()}", f"{w()}_{w()}_{w()}", f"_{w()}", f"__{w()}__", f"{w()}.__{w()}__", f"{w().upper()}_{w().upper()}", f"__{w().upper()}__", f"{w()}_{r.randint(1, 99)}", f"self._{w()}", f"{w()}.{w()}_{w()}()", f"{w()}__{w()}"))

    def look_alike(self, only: str | None = None) -> Callable[[], str]:
        r, w, n = self.r, self.word, self.number
        v = lambda: r.choice(string.ascii_letters)
        op = lambda: r.choice(("<", ">", "<=", ">=", "==", "!=", "<>", "<<", ">>", "=", "&&", "||", "->", "<-", "=>", "<->", "≤"))
        side = lambda: r.choice((v, n, w, self.identifier))()
        gap = lambda: r.choice((" ", " ", ""))

        def generic(deep: int = 0) -> str:
            inner = lambda: generic(deep + 1) if deep < 2 and r.random() < 0.25 else r.choice((self.name(), v().upper(), r.choice(("int", "string", "bool", "float", "str", "u8", "void", "long"))))
            return f"{r.choice((self.name(), w(), 'std::' + w(), w() + '::' + self.name()))}<{r.choice((', ', ',')).join(inner() for _ in range(r.choice((1, 1, 2, 3))))}>"

        def price() -> str:
            s = r.choice("$$$$€£")
            return r.choice((f"{s}{n()}", f"{s}{n()}", f"{s} {n()}", f"{n()}{s}", f"US{s}{n()}", f"{s}{r.randint(1, 99)}k", f"{s}{n()}-{s}{n()}", f"-{s}{n()}", f"{s}{n()}/{w()}", f"({s}{n()})"))

        def path() -> str:
            b = lambda: "\\".join(r.choice((w, self.identifier, lambda: f"{w()}.{w()[:3]}", self.name))() for _ in range(r.randint(1, 4)))
            return r.choice((f"{v().upper()}:\\{b()}", f"{v().upper()}:\\{b()}\\", f"\\\\{w()}\\{b()}", f"..\\{b()}", f"%{w().upper()}%\\{b()}", f"/{w()}/{w()}_{w()}.{w()[:2]}", f"~/{w()}/{w()}", f"~{w()}/{w()}", f"./{w()}/*.{w()[:2]}", f"{w()}/**/*.{w()[:3]}", f"{w().upper()}\\{w()}", f"{w()}\\{w()}"))

        classes = {
            "price": price, "path": path, "generic": generic, "identifier": self.identifier,
            "comparison": lambda: f"{side()}{(g := gap())}{op()}{g}{side()}" + (f" {r.choice(('and', 'or', 'und', '&', '|'))} {side()} {op()} {side()}" if r.random() < 0.3 else ""),
            "bound": lambda: f"{r.choice(('<', '>', '<=', '>=', '~', '~~', '≈', '±', '#', '*', '^', '=', '-', '+', '->', '<3', '=='))}{gap()}{n()}",
            "product": lambda: r.choice((" * ", "*", " * ", "**", " x ", "^")).join(side() for _ in range(r.choice((2, 2, 3, 4)))) + r.choice(("", f" = {n()}", f" == {side()}")),
            "stars": lambda: r.choice((f"*{self.identifier()}", f"**{self.identifier()}", f"{w()}*", f"{w()}**", f"{w()} *", f"*.{w()[:3]}", f"{w()} *{w()}", f"f({v()}*, {v()}*)", f"* {w()}", "***", "* * *"[:3], f"*{n()}", f"({w()}*)", f"{r.randint(1, 5)}*")),
            "reference": lambda: r.choice((f"[{n()}]", f"[{r.randint(1, 99)}, {r.randint(1, 99)}]", f"[{self.name()} {r.randint(1900, 2030)}]", f"[{w()}]", f"[{self.words()}]", f"[{r.randint(1, 99)}]–[{r.randint(1, 99)}]", f"[{r.randint(1, 99)}][{r.randint(1, 99)}]", "[...]", "[…]", f"[{r.randint(1, 99)}, {w()}. {n()}]", f"[{self.name()} et al., {r.randint(1900, 2030)}]", f"[{r.randint(1, 99)}] ({w()})", f"[{w()}] ({self.words()})")),
            "index": lambda: r.choice((f"{w()}[{n()}]", f"{v()}[{v()}][{v()}]", f"[{n()}, {n()}]", f"[[{n()}, {n()}], [{n()}, {n()}]]", f"{v()}[{w()}[{v()}]]", f"{w()}[{r.randint(0, 9)}]({v()})", f"[{v()}, {v()})", f"{w()}['{w()}']", f"[{w()}", f"{w()}]", "[ ]", f"[ {w()}", f"[x] {w()}")),
            "hash": lambda: r.choice((f"#{n()}", f"#{w()}", f"#{w()}-{w()}", f"#{self.name()}{self.name()}", f"{v().upper()}#", f"# {n()}", f"No. #{n()}", f"{w()} #{r.randint(1, 9)}:", f"#{r.randint(0, 0xFFFFFF):06x}", "##")),
            "ampersand": lambda: r.choice((f"{v().upper()}&{v().upper()}", f"{self.name()} & {self.name()}", f"{self.name()}&{self.name()};", f"{w()} && {w()}", f"{v()}={n()}&{w()}={v()}", f"{v().upper()}&{v().upper()}; {w()}", f"& {w()}", f"{w()}&{w()}", f"{v().upper()}&{v().upper()}{v().upper()};")),
            "address": lambda: r.choice((f"https://{w()}.example/{w()}?{v()}={n()}&{w()}={n()}#{w()}", f"http://{w()}.example/~{w()}/{w()}_{w()}", f"{w()}.{w()}@{w()}.example", f"<{w()}@{w()}.example>", f"www.{w()}.example/{w()}_{w()}_{w()}", f"@{w()}_{w()}", f"https://{w()}.example/{self.identifier()}*")),
            "braces": lambda: r.choice((f"{{{w()}}}", f"{{{n()}}}", f"{{{v()}, {v()}, {v()}}}", "{}", f"${{{w().upper()}}}", f'{{"{w()}": {n()}}}', f"{{{w()}: {w()}}}", f"%{{{w()}}}", f"{w()} {{ {w()}; }}", f"{{{v()} | {v()} > {n()}}}", f"{w()}{{{n()}}}", "{", "}", f"{{{self.words()}}}", f"{{{{{n()}, {n()}}}, {{{n()}, {n()}}}}}", f"{{{v()}_{v()}}}")),
            "shell": lambda: r.choice((f"${w().upper()}", f"${w()}", f"$1 {w()} $2", f"{w()} | {w()}", f"{w()} | {w()} -{v()} | {w()}", f"|{v()}|", f"|{v()} - {v()}|", f"{w()} || {w()}", f"--{w()}", f"--{w()}-{w()}={n()}", f"-{v()}", f"{w()} -- {w()}", "--", f"$({w()})", f"{w()}; {w()}", f"`{w()}", f"`{w()}'", f"{w()}` {w()}", f"|{w()}", f"{w()}|{w()}")),
            "quotes": lambda: r.choice((f"'{r.randint(10, 99)}s", f"{self.name()}s'", "''", f"'{w()}' {w()} ''", f"'{v()}'", f"''{n()}", f"{n()}''", f"{n()}'{n()}''", f"rock 'n' {w()}", f"'{w()} '{w()}", f"`{w()}´", f"'{w()}', '{w()}'", f"\"'{self.words()}'\"", f"d'{w()}", f"'' {w()}", f"({w()}'', {w()}'')", f"l'{w()}", f"''{w()}")),
            "backslash": lambda: r.choice((f"{w()}\\{w()}", "\\n", f"\\{v()}", f"\\d+\\.{w()}", f"\\\\{w()}", f"{w()} \\ {w()}", f"\\{v()}{{{n()}}}", f"/^{w()}\\s*$/", f"{w()}\\n{w()}", f"{w()}\\", "\\o/", f"\\{w()}", "\\0", f"\\u{r.randint(0, 0xFFFF):04x}")),
            "tilde": lambda: r.choice((f"~{n()}", f"~ {n()}", f"{w()} ~ {w()}", f"~{w()}", f"{n()}~{n()}", f"{w()}~", "~", f"~~{n()}", f"{w()}~~")),
            "formula": lambda: r.choice((f"{v()}^{r.randint(2, 9)}", f"{v()}_{r.randint(0, 9)}", f"f({v()}) = {v()}", f"{v()}^2 + {v()}^2 = {v()}^2", f"10^{r.randint(2, 12)}", f"E = m{v()}^2", f"{v()}_{v()} + {v()}_{v()}", f"({v()} + {v()})^{v()}", f"{v()} * ({v()} + {v()})", f"{v()} = {n()} / {n()}", f"sqrt({v()}) > {n()}", f"{n()} + {n()} = {n()}", f"O({v()}^2)", f"{v()}'' + {v()}' = 0", f"|{v()}| < {n()}", f"{v()}! / {v()}")),
            "face": lambda: r.choice((":-)", ";-)", ":)", "<3", ">:(", "^_^", "-_-", ":-|", "\\o/", "*_*", ":*", "xD", "=)", ">.<", "<_<", "o_O", ":'(", "T_T", "¯\\_(ツ)_/¯", "</3")),
            "angle": lambda: r.choice((f"<{w()}>", f"<{w()} {w()}>", f"<{w().upper()}>", f"<{n()}>", f"< {w()} >", f"<<{w()}>>", f"<{self.name()}>", f"<{w()}_{w()}>", f"<->", f"<{n()} {w()}>", f"{w()} <{w()}", f"->{w()}", f"<={w()}", f"<{self.name()} {self.name()}>")),
        }
        return classes[only or r.choice(tuple(classes))]

    def at_line_start(self) -> str:
        """A line of prose that begins with a character that could begin a block."""
        r, w, n = self.r, self.word, self.number
        rest = self.sentence()
        return r.choice((
            f"#{w()} {rest}", f"#{n()} {rest}", f"-- {rest}", f"--\n{self.name()}", f"—{rest}", f"-{n()} {rest}", f"+{n()} {n()} {rest}", f"*{w()} {rest}", f":-) {rest}", f";-) {rest}", f"= {n()}", f"=> {rest}", f"-> {rest}", f">{n()} {w()}", f"|{r.choice('xyz')}| {rest}", f"!{w()} {rest}", f"{r.randint(1800, 2030)}. {rest}",
            f"'{r.randint(10, 99)} {rest}", f"| {self.words()} |", f"| {w()} | {w()} | {w()} |", f"|{w()}", f"&{w()} {rest}", f"== {n()}", f"~{n()} {rest}", f"_{w()} {rest}", f"**{w()}_{w()}", f"{n()}) {rest}", f":{w()}: {rest}", f"{self.name()}: {rest}", f"~{w()}", f"({n()}) {rest}", f"{r.choice('abc')}) {rest}", f"{{ {rest}", f"\\ {rest}",
        ))

    # constructs; each gives its text and whether it stands in a line

    def url(self) -> str:
        r, w = self.r, self.word
        return r.choice((f"https://{w()}.example/{w()}/{r.randint(1, 9999)}", f"http://www.{w()}.example", f"/{w()}/{w()}.html", f"#{w()}", f"{w()}.md", f"../{w()}/{w()}.png", f"https://{w()}.example/{w()}?{w()[:1]}={r.randint(1, 99)}", f"mailto:{w()}@{w()}.example"))

    def code(self) -> str:
        """A few lines of a programming language."""
        r, w = self.r, self.word
        line = lambda: r.choice((f"{w()} = {w()}({self.number()})", f"for {w()} in {w()}:", f"    {w()}[{r.randint(0, 9)}] += {r.randint(0, 9)}", f"if ({w()} < {w()}) {{", "}", f"print(\"{self.words()}\")", f"# {self.words()}", f"// {self.words()}", f"return {w()} * {w()}", f"{w()}: {self.number()}", f"$ {w()} --{w()}", f"SELECT * FROM {w()} WHERE {w()} > {r.randint(1, 9)};"))
        return "\n".join(line() for _ in range(r.randint(1, 6)))

    def maths(self) -> str:
        r = self.r
        v = lambda: r.choice(string.ascii_letters) + r.choice(("", "", f"_{r.randint(0, 9)}", f"^{r.randint(2, 9)}", f"_{{{r.choice(string.ascii_lowercase)}{r.randint(0, 99)}}}", "^{-1}", "'"))
        term = lambda: r.choice((v, v, v, lambda: f"\\{r.choice(('alpha', 'beta', 'gamma', 'lambda', 'mu', 'pi', 'sigma', 'theta', 'Delta', 'Omega'))}", lambda: f"\\frac{{{v()}}}{{{v()}}}", lambda: f"\\sqrt{{{v()}}}", lambda: str(r.randint(0, 99)), lambda: f"\\{r.choice(('mathbb', 'mathcal', 'mathbf', 'mathrm'))}{{{r.choice(string.ascii_uppercase)}}}", lambda: f"{v()}({v()})", lambda: f"\\sum_{{{v()}}} {v()}"))()
        out = term()
        for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
            out += r.choice((" + ", "+", " - ", " = ", "=", " \\cdot ", " \\leq ", " \\in ", " \\to ", " < ", " > ", ", ", " \\times ", " \\ne ")) + term()
        return out

    def constructs(self) -> dict[str, tuple[int, bool, Callable[[], str]]]:
        r, w, a, ws, n = self.r, self.word, self.ascii_word, self.words, self.number
        case = lambda t: t.upper() if r.random() < 0.1 else t
        inline_tags = ("b", "i", "em", "strong", "u", "span", "sup", "sub", "code", "small", "a", "mark", "kbd", "font", "q", "cite", "del", "s", "tt", "abbr", "var")
        block_tags = ("p", "div", "section", "article", "blockquote", "center", "aside", "header", "footer", "main", "figure", "pre", "form", "nav", "h1", "h2", "h3", "h4")
        value = lambda: r.choice((f'"{ws()}"', f'"{w()}"', f"'{w()}'", w(), f'"{self.url()}"', f'"{w()}-{r.randint(1, 99)} {w()}"', f'"{w()}: {r.randint(1, 99)}px"'))
        attributes = lambda: "".join(" " + (w() if r.random() < 0.1 else f"{r.choice(('class', 'id', 'href', 'style', 'title', 'data-' + w(), 'src', 'alt', 'lang', 'rel', 'width', 'name', 'target'))}={value()}") for _ in range(r.choice((0, 0, 0, 1, 1, 2, 3))))

        def element(tags, inner) -> str:
            t = r.choice(tags)
            return f"<{case(t)}{attributes()}>{inner}</{case(t)}>"

        entity = lambda: r.choice((f"&{r.choice(('amp', 'nbsp', 'lt', 'gt', 'quot', 'mdash', 'ndash', 'hellip', 'rsquo', 'ldquo', 'eacute', 'copy', 'apos', 'auml', 'ouml', 'uuml', 'szlig', 'euro'))};", f"&{r.choice(_ENTITIES)};", f"&#{r.randint(33, 9999)};", f"&#x{r.randint(33, 0x2FFF):X};"))
        row = lambda c, k: "<tr>" + "".join(f"<{c}>{ws(1, 2)}</{c}>" for _ in range(k)) + "</tr>"
        nl = lambda: r.choice(("", "\n"))
        lines = lambda make, least=2, most=5: "\n".join(make() for _ in range(r.randint(least, most)))
        cells = lambda k: [r.choice((ws(1, 3), n()))for _ in range(k)]

        def md_table() -> str:
            k, edge = r.randint(2, 4), r.random() < 0.8
            a, b = ("| ", " |") if edge else ("", "")
            return "\n".join([a + " | ".join(cells(k)) + b, a.strip() + "|".join(r.choice(("---", ":---", "---:", ":-:", " --- ", "-----")) for _ in range(k)) + b.strip(), *[a + " | ".join(cells(k)) + b for _ in range(r.randint(1, 4))]])

        def numbered() -> str:
            k, end = r.choice((1, 1, 1, 3)), r.choice((".", ".", ")"))
            return "\n".join(f"{k + i}{end} {r.choice((ws(2, 6), self.sentence()))}" for i in range(r.randint(2, 6)))

        def wiki_table() -> str:
            k = r.randint(1, 3)
            out = ["{|" + r.choice(("", f' class="{w()}"', f' style="{w()}: {r.randint(1, 99)}px"', " border=1"))]
            if r.random() < 0.3:
                out.append(f"|+ {ws()}")
            if r.random() < 0.7:
                out += ["|-"] * (r.random() < 0.5) + [f"! {' !! '.join(cells(k))}"]
            for _ in range(r.randint(1, 4)):
                out += ["|-", *([f"| {' || '.join(cells(k))}"] if r.random() < 0.6 else [f"| {c}" for c in cells(k)])]
            return "\n".join([*out, "|}"])

        arguments = lambda: "".join(f"|{r.choice((w(), f'{w()}={ws(1, 3)}', f'{w()} = {n()}', ws()))}" for _ in range(r.randint(0, 3)))
        heading = lambda k, gap: f"{'=' * k}{gap}{r.choice((ws(), self.name() + ' ' + ws(), ws() + ' ' + n()))}{gap}{'=' * k}"
        command = lambda: r.choice(("emph", "textbf", "textit", "texttt", "underline", "footnote", "textsc", "url", "caption", "mbox", "text", "title", "author"))
        key = lambda: r.choice((f"{w()}:{w()}", w(), f"{w()}{r.randint(1900, 2030)}", f"fig:{w()}", f"eq:{r.randint(1, 99)}"))
        env = lambda: r.choice(("itemize", "enumerate", "quote", "center", "table", "figure", "abstract", "theorem", "proof", "description", "flushleft", "minipage", "document"))

        def environment() -> str:
            e = env()
            inner = lines(lambda: f"{r.choice(('', '  '))}\\item {ws(2, 5)}") if e in ("itemize", "enumerate", "description") else r.choice((self.sentence, lambda: f"\\centering\n{self.sentence()}", lambda: f"\\includegraphics[width={r.randint(1, 9)}cm]{{{w()}}}\n\\caption{{{ws()}}}"))()
            return f"\\begin{{{e}}}{r.choice(('', '', '[ht]'))}\n{inner}\n\\end{{{e}}}"

        ticks = lambda s: f"{s}{r.choice((w, lambda: f'{w()}()', self.identifier, lambda: f'{w()} = {n()}', lambda: f'{w()} --{w()}', lambda: f'<{w()}>', lambda: f'${w().upper()}'))()}{s}"
        mark = lambda m: f"{m}{ws()}{m}"
        return {
            # HTML
            "inline element": (HTML, True, lambda: element(inline_tags, ws())), "block element": (HTML, False, lambda: element(block_tags, nl() + self.sentence() + nl())), "nested elements": (HTML, False, lambda: element(block_tags, nl() + element(block_tags[:6], ws() + " " + element(inline_tags, ws()) + " " + ws()) + nl())),
            "void element": (HTML, True, lambda: f"<{case(r.choice(('br', 'hr', 'img', 'wbr', 'input')))}{attributes()}{r.choice(('', '/', ' /'))}>"), "opening tag": (HTML, True, lambda: f"<{case(r.choice(inline_tags + block_tags))}{attributes()}>"), "closing tag": (HTML, True, lambda: f"</{case(r.choice(inline_tags + block_tags))}>"),
            "rare element": (HTML, True, lambda: element(tuple(sorted(TAGS - VOID)), ws())), "entity": (HTML, True, lambda: r.choice((f"{w()}{entity()}{w()}", f"{w()}{entity()} {w()}", f"{w()} {entity()} {w()}", entity()))), "escaped element": (HTML, True, lambda: html.escape(element(inline_tags + block_tags, ws()), quote=r.random() < 0.5)), "twice escaped": (HTML, True, lambda: html.escape(html.escape(element(inline_tags, ws())))),
            "escaped tag": (HTML, True, lambda: html.escape(f"<{r.choice(('', '/'))}{r.choice(inline_tags + block_tags)}{attributes()}>")), "half escaped": (HTML, True, lambda: f"&lt;{r.choice(('', '/'))}{r.choice(inline_tags)}"), "html list": (HTML, False, lambda: (lambda t: f"<{t}>" + nl() + "".join(f"<li>{ws()}</li>{nl()}" for _ in range(r.randint(1, 4))) + f"</{t}>")(r.choice(("ul", "ol")))),
            "html table": (HTML, False, lambda: (lambda k: f"<table{attributes()}>{nl()}{row('th', k)}{nl()}{row('td', k)}{nl()}</table>")(r.randint(1, 3))), "html comment": (HTML, True, lambda: f"<!--{r.choice((' ', ''))}{r.choice((ws(1, 8), self.code(), w() + '-' + n()))}{r.choice((' ', ''))}-->"), "doctype": (HTML, False, lambda: r.choice(("<!DOCTYPE html>", f'<!DOCTYPE html PUBLIC "-//{w()}//{ws()}">', f'<?xml version="1.{r.randint(0, 1)}"?>', f"<![CDATA[{ws()}]]>"))),
            "script": (HTML, False, lambda: (lambda t: f"<{t}{attributes()}>{nl()}{self.code()}{nl()}</{t}>")(r.choice(("script", "style")))), "html code": (HTML, False, lambda: f"<pre><code{attributes()}>{html.escape(self.code())}</code></pre>"), "custom element": (HTML, True, lambda: (lambda t: f"<{t}{attributes()}>{ws()}</{t}>")(f"{a()}-{a()}")), "cut tag": (HTML, False, lambda: f"<{r.choice(inline_tags + block_tags)} {r.choice(('class', 'href', 'style', 'id'))}={r.choice(('', value()))}"), "xml": (HTML, False, lambda: (lambda t: f"<{t}{attributes()}>{ws()}</{t}>")(a())),
            # Markdown
            "top heading": (MARKDOWN, False, lambda: f"# {r.choice((ws(2, 6), self.name() + ' ' + ws(1, 5)))}"), "heading": (MARKDOWN, False, lambda: f"{'#' * r.randint(1, 6)} {r.choice((ws(), self.name() + ' ' + ws(), n() + ' ' + ws()))}{r.choice(('', '', ' ##'))}"), "underlined heading": (MARKDOWN, False, lambda: (lambda t: f"{t}\n{r.choice('=-') * max(3, len(t) + r.choice((-2, 0, 0, 0, 2)))}")(self.name() + " " + ws(1, 4))), "strong": (MARKDOWN, True, lambda: mark("**")), "emphasis": (MARKDOWN, True, lambda: mark("*")), "underscore strong": (MARKDOWN, True, lambda: f"__{ws(1, 6)}__"), "underscored words": (MARKDOWN, True, lambda: (lambda m: f"{m}{ws(2, 5)}{m}")(r.choice(("_", "__")))), "underscore emphasis": (MARKDOWN, True, lambda: mark("_")), "strong emphasis": (MARKDOWN, True, lambda: mark("***")), "strike": (MARKDOWN, True, lambda: mark("~~")),
            "nested emphasis": (MARKDOWN, True, lambda: f"**{ws()} *{ws()}* {ws()}**"), "link": (MARKDOWN, True, lambda: f"[{ws()}]({self.url()}{r.choice(('', '', f' {chr(34)}{ws()}{chr(34)}'))})"), "reference link": (MARKDOWN, True, lambda: f"[{ws()}][{r.choice((w(), str(r.randint(1, 99)), ''))}]"), "link target": (MARKDOWN, False, lambda: f"[{r.choice((w(), str(r.randint(1, 99))))}]: {self.url()}{r.choice(('', f' {chr(34)}{ws()}{chr(34)}'))}"), "image": (MARKDOWN, True, lambda: f"![{r.choice((ws(), ''))}]({self.url()})"),
            "footnote mark": (MARKDOWN, True, lambda: f"{w()}[^{r.choice((str(r.randint(1, 99)), w()))}]"), "footnote": (MARKDOWN, False, lambda: f"[^{r.choice((str(r.randint(1, 99)), w()))}]: {self.sentence()}"), "autolink": (MARKDOWN, True, lambda: f"<{r.choice(('https', 'http', 'ftp'))}://{a()}.example/{a()}{r.choice(('', f'?{a()}={r.randint(1, 99)}'))}>"), "inline code": (MARKDOWN, True, lambda: ticks("`")), "long inline code": (MARKDOWN, True, lambda: "`" + " ".join(r.choice((f"{w()}({n()})", self.identifier(), w(), f"--{w()}", f"{w()}={n()}")) for _ in range(r.choice((3, 8, 20, 60)))) + "`"), "double ticks": (MARKDOWN, True, lambda: ticks("``")),
            "fence": (MARKDOWN, False, lambda: (lambda f: f"{f}{r.choice(('', w(), 'python', 'sh'))}\n{self.code()}\n{f}")(r.choice(("```", "```", "~~~", "````", "~~~~")))), "open fence": (MARKDOWN, False, lambda: f"```{r.choice(('', w()))}\n{self.code()}"), "bullets": (MARKDOWN, False, lambda: (lambda b: lines(lambda: f"{b} {r.choice((ws(2, 6), self.sentence()))}"))(r.choice("-*+"))), "nested bullets": (MARKDOWN, False, lambda: (lambda b: lines(lambda: f"{b} {ws(2, 5)}\n{r.choice(('  ', '    '))}{b} {ws(2, 5)}"))(r.choice("-*+"))), "numbered list": (MARKDOWN, False, numbered),
            "tasks": (MARKDOWN, False, lambda: lines(lambda: f"- [{r.choice(' xX')}] {ws(2, 6)}", 1, 4)), "quote": (MARKDOWN, False, lambda: lines(lambda: f"> {self.sentence()}", 1, 3)), "deep quote": (MARKDOWN, False, lambda: f"> {self.sentence()}\n>> {self.sentence()}"), "table": (MARKDOWN, False, md_table), "open strong": (MARKDOWN, True, lambda: f"**{ws(1, 8)}"), "open strong words": (MARKDOWN, True, lambda: f"**{ws(2, 12)}"), "open strong later": (MARKDOWN, True, lambda: f"**{n()} {ws()}"), "open strike": (MARKDOWN, True, lambda: f"~~{ws()}"), "cut link": (MARKDOWN, True, lambda: f"[{ws()}]({r.choice(('', self.url()))}"), "one bullet": (MARKDOWN, False, lambda: f"{r.choice('-*')} {ws(2, 6)}"),
            # MediaWiki
            "wiki link": (WIKI, True, lambda: f"[[{r.choice((self.name(), ws(), self.name() + ' ' + ws(), self.name() + ' (' + w() + ')'))}]]"), "piped link": (WIKI, True, lambda: f"[[{self.name()}{r.choice(('', '#' + w(), ' ' + ws()))}|{ws()}]]"), "filed": (WIKI, False, lambda: f"[[{r.choice(('Category', 'File', 'Image', 'Kategorie', 'Datei', 'Catégorie', 'Fichier', 'Categoría', 'Archivo'))}:{self.name()} {ws()}{r.choice(('', '.jpg|thumb|' + ws()))}]]"), "external link": (WIKI, True, lambda: f"[https://{w()}.example/{w()}{r.choice(('', ' ' + ws(), ' ' + ws()))}]"),
            "wiki bold": (WIKI, True, lambda: mark("'''")), "wiki italic": (WIKI, True, lambda: mark("''")), "wiki bold italic": (WIKI, True, lambda: mark("'''''")), "wiki heading": (WIKI, False, lambda: heading(r.randint(2, 6), r.choice(("", " ", " ")))), "template": (WIKI, True, lambda: f"{{{{{r.choice((w(), self.name(), ws(), 'cite ' + w(), 'lang'))}{arguments()}}}}}"), "nested template": (WIKI, True, lambda: f"{{{{{w()}|{w()}={{{{{w()}{arguments()}}}}}}}}}"),
            "infobox": (WIKI, False, lambda: "{{" + f"Infobox {ws()}\n" + lines(lambda: f"{r.choice(('|', '| ', ' | '))}{w()}{r.choice((' = ', '='))}{r.choice((ws(), n(), f'[[{self.name()}]]'))}") + "\n}}"), "wiki table": (WIKI, False, wiki_table), "redirect": (WIKI, False, lambda: f"#{r.choice(('REDIRECT', 'redirect', 'WEITERLEITUNG', 'REDIRECTION')).upper()} [[{self.name()}]]"), "magic word": (WIKI, False, lambda: f"__{r.choice(tuple(sorted(MAGIC_WORDS)))}__"), "wiki nested list": (WIKI, False, lambda: lines(lambda: f"{r.choice(('** ', '*** ', '*# ', '#* ', '*: ', ':: ', '#: ', '**# '))}{ws(2, 5)}", 1, 4)),
            "definition": (WIKI, False, lambda: lines(lambda: f";{r.choice(('', ' '))}{ws(1, 3)}{r.choice((f' : {ws(2, 5)}', chr(10) + f':{ws(2, 5)}', ''))}", 1, 3)), "indent": (WIKI, False, lambda: lines(lambda: f":{r.choice(('', ' '))}{self.sentence()}", 2, 3)), "signature": (WIKI, True, lambda: f"{ws()} {r.choice(('~~~~', '~~~~', '~~~', '--~~~~'))}"), "wiki tag": (WIKI, True, lambda: r.choice((f"<ref>{ws()}</ref>", f'<ref name="{w()}"/>', f"<nowiki>{ws()}</nowiki>", "<references />"))), "open wiki link": (WIKI, True, lambda: f"[[{r.choice((ws(), self.name() + '|' + ws()))}"), "open wiki link later": (WIKI, True, lambda: f"[[{n()} {ws()}"), "open template": (WIKI, True, lambda: f"{{{{{w()}|{w()}={n()}"),
            "lone wiki end": (WIKI, True, lambda: f"{ws()}{r.choice((']]', '}}'))}"), "open wiki bold": (WIKI, True, lambda: f"'''{ws()}"), "open wiki table": (WIKI, False, lambda: wiki_table().rsplit("\n", 1)[0]),
            # LaTeX
            "command": (LATEX, True, lambda: f"\\{command()}{{{ws()}}}"), "nested command": (LATEX, True, lambda: f"\\{command()}{{{ws()} \\{command()}{{{ws()}}} {ws()}}}"), "section": (LATEX, False, lambda: f"\\{r.choice(('chapter', 'section', 'subsection', 'subsubsection', 'section*', 'subsection*', 'paragraph', 'part'))}{{{ws()}}}"), "reference": (LATEX, True, lambda: f"{w()}{r.choice(('~', ' ', ''))}\\{r.choice(('ref', 'eqref', 'cite', 'citep', 'citet', 'pageref', 'label', 'textcite'))}{r.choice(('', '', f'[{w()}. {n()}]'))}{{{key()}}}"),
            "formula": (LATEX, True, lambda: f"${self.maths()}$"), "letter formula": (LATEX, True, lambda: f"${r.choice(string.ascii_letters)}$"), "round formula": (LATEX, True, lambda: f"\\({self.maths()}\\)"), "display": (LATEX, False, lambda: r.choice((f"$${self.maths()}$$", f"\\[{self.maths()}\\]", f"$$\n{self.maths()}\n$$", f"\\[ {self.maths()} \\]"))), "environment": (LATEX, False, environment), "equation": (LATEX, False, lambda: (lambda e: f"\\begin{{{e}}}{r.choice(('', f'{chr(92)}label{{{key()}}}'))}\n{self.maths()}\n\\end{{{e}}}")(r.choice(("equation", "align", "equation*", "gather")))),
            "verbatim": (LATEX, False, lambda: (lambda e: f"\\begin{{{e}}}\n{self.code()}\n\\end{{{e}}}")(r.choice(("verbatim", "lstlisting")))), "verb": (LATEX, True, lambda: (lambda m: f"\\verb{m}{r.choice((w, lambda: self.code().split(chr(10))[0].replace('|', '').replace('+', '').replace('!', '')))()}{m}")(r.choice("|+!"))), "bare command": (LATEX, True, lambda: f"\\{r.choice(('today', 'LaTeX', 'TeX', 'ldots', 'noindent', 'newpage', 'quad', 'maketitle', 'tableofcontents', 'par', 'centering', 'clearpage'))}{r.choice(('', '', '{}', ' '))}"),
            "symbol": (LATEX, True, lambda: f"\\{r.choice(('alpha', 'beta', 'leq', 'times', 'approx', 'infty', 'cdot', 'lambda', 'sigma'))}"), "preamble": (LATEX, False, lambda: r.choice((f"\\documentclass[{r.randint(10, 12)}pt]{{article}}", f"\\usepackage{{{w()}}}", f"\\usepackage[{w()}]{{{w()}}}", f"\\newcommand{{\\{w()}}}{{{ws()}}}", f"\\bibliography{{{w()}}}"))), "graphics": (LATEX, False, lambda: f"\\includegraphics[{r.choice(('width', 'scale'))}={r.choice(('0.5', chr(92) + 'textwidth', '3cm'))}]{{{w()}}}"), "fraction": (LATEX, True, lambda: f"\\frac{{{w()}}}{{{r.choice((w(), n()))}}}"),
            "own command": (LATEX, True, lambda: f"\\{a()}{{{ws(1, 2)}}}{{{ws(1, 2)}}}"), "open command": (LATEX, True, lambda: f"\\{command()}{{{ws()}"), "open environment": (LATEX, False, lambda: environment().rsplit("\n", 1)[0]), "cut environment": (LATEX, False, lambda: f"\\end{{{env()}}}"),
        }

    def text(self, skip: frozenset[str] = frozenset(), only: frozenset[str] | None = None) -> tuple[str, list[Span]]:
        """A text and its (begin, end, language) spans of markup, without the constructs of ``skip`` or with none but ``only``."""
        r = self.r
        # Drawn by language first, so that languages are equally frequent.
        made = self.made
        by_language = [[k for k, c in made.items() if c[0] == language and k not in skip and (only is None or k in only)] for language in range(4)]
        languages = [i for i in range(4) if by_language[i]]
        share = r.choice((0.0, 0.1, 0.3, 0.5)) if only is None else 0.3
        favourite = r.choice(languages) if r.random() < 0.6 and languages else None
        text, spans = "", []
        line_end = r.choice(("\n", "\n", "\n", "\r\n"))
        for _ in range(r.randint(1, 6)):  # paragraphs
            for _ in range(r.choice((1, 1, 2, 3, 5))):  # sentences
                if languages and r.random() < share:
                    kinds = by_language[favourite if favourite is not None and r.random() < 0.8 else r.choice(languages)]
                    language, inline, make = made[r.choice(kinds)]
                    put = make().replace("\n", line_end)
                    if inline:
                        words = self.sentence(self.look_alike() if r.random() < 0.2 else None).split(" ")
                        k = r.randint(0, len(words) - 1)
                        before = " ".join(words[:k])
                        text += before + (" " if before else "") + ("(" if (bracket := r.random() < 0.06) else "")
                        spans.append((len(text), len(text) + len(put), language))
                        text += put + (")" if bracket else "") + r.choice((" ", " ", " ", ", ", ". ")) + " ".join(words[k:]) + " "
                    else:
                        if text and not text.endswith("\n"):
                            text = text.rstrip(" ") + line_end * r.choice((1, 2))
                        spans.append((len(text), len(text) + len(put), language))
                        text += put + line_end * r.choice((1, 2))
                elif r.random() < 0.1:
                    if text and not text.endswith("\n"):
                        text = text.rstrip(" ") + line_end
                    text += self.at_line_start() + line_end
                else:
                    text += self.sentence(self.look_alike() if r.random() < 0.7 else None) + r.choice((" ", " ", " ", line_end))
            if text:
                text = text.rstrip(" ") + line_end * r.choice((1, 2, 2))
        return text, spans


by_value(__name__)
