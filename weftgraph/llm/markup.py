"""Markup residue in texts: which markup languages a text holds, and clean text that keeps its structure (problem 2).

Candidates form a tree (markup_nodes.py); gradient-boosted trees over their features (what the node is and holds, the
characters around it, attribute tokens, depth, siblings, density of the subtree) give each node's log-odds of being
markup rather than prose that uses the same characters. Hierarchical decoding goes from parents to children: a part of a
table or template counts only inside an accepted one, and what stands in accepted code or formulas is no markup.

The trees are fitted here, on ``TRAINING_TEXTS`` texts drawn from a fixed seed (markup_texts.py): a grammar of the four
languages' specifications, whole and broken, amid prose and look-alikes. The fit takes some seconds on the driver, once
per process, and depends on no data.

Defined results: null and blank texts hold nothing and clean to an empty text; records repeated by id count once; a text
without markup is returned as it is but for line ends.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.shipping import by_value
from weftgraph.llm.boosting import BoostedTrees
from weftgraph.llm.markup_nodes import EMPHASIS, KINDS, LANGUAGES, PART_OF, SEALED, Node, closing, features, nodes, parents
from weftgraph.llm.markup_texts import Maker

TRAINING_TEXTS, SEED = 4000, 20


def labelled(text: str, spans: list[tuple[int, int, int]], found: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Per node whether it is markup of its language, and whether it says anything: not inside code, formulas or comments."""
    y, counts = np.zeros(len(found)), np.ones(len(found), bool)
    opaque = -1
    for i, n in enumerate(found):
        end = max(n.end, n.begin + 1)
        y[i] = any(n.begin < se and end > sb and KINDS[n.kind][0] == language for sb, se, language in spans)
        if n.begin < opaque:
            counts[i] = False
        elif y[i] and (KINDS[n.kind][1] or n.kind in SEALED):
            opaque = n.end
    return y, counts


def training_nodes(n: int = TRAINING_TEXTS, seed: int = SEED, skip: frozenset[str] = frozenset(), only: frozenset[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of ``n`` drawn texts; ``skip`` and ``only`` leave out kinds of constructs."""
    maker = Maker(seed)
    xs, ys = [], []
    for _ in range(n):
        text, spans = maker.text(skip, only)
        found = nodes(text)
        if found:
            y, counts = labelled(text, spans, found)
            xs.append(features(text, found)[counts])
            ys.append(y[counts])
    return np.concatenate(xs), np.concatenate(ys)


_fitted: list[BoostedTrees] = []


def model() -> BoostedTrees:
    """The fitted trees, once per process."""
    if not _fitted:
        _fitted.append(BoostedTrees().fit(*training_nodes()))
    return _fitted[0]


def decode(text: str, found: list[Node], margin: np.ndarray) -> list[int]:
    """Indices of the accepted nodes, parents decided before children.

    A part of a structure is accepted only inside an accepted one (the nearest that it can be part of), nothing inside
    accepted code, formulas or tags; what closes an accepted element is accepted with it, and the closing mark of an
    accepted emphasis opens nothing.
    """
    accepted: list[int] = []
    taken = [False] * len(found)
    up = parents(found) if any(n.kind in PART_OF for n in found) else []
    opaque = -1
    closed: list[tuple[int, int]] = []
    due: set[int] = set()
    for i, n in enumerate(found):
        if (margin[i] <= 0 and not (n.end in due and n.kind in ("h_close", "l_env"))) or n.begin < opaque:
            continue
        while closed and closed[0][1] <= n.begin:
            heapq.heappop(closed)
        if closed and closed[0][0] <= n.begin:
            continue
        if wholes := PART_OF.get(n.kind):
            k = up[i]
            while k >= 0 and found[k].kind not in wholes:
                k = up[k]
            if k < 0 or not taken[k]:
                continue
        taken[i] = True
        accepted.append(i)
        if KINDS[n.kind][1] or n.kind in SEALED:
            opaque = max(opaque, n.end)
        if n.extent > n.end and n.kind in ("h_tag", "l_env"):
            due.add(n.extent)
        elif n.kind in EMPHASIS and (close := closing(text, n)) < n.end:
            heapq.heappush(closed, (close, n.end))
    return accepted


def _margins(trees: BoostedTrees, rows: np.ndarray) -> np.ndarray:
    """Log-odds of many nodes; equal rows are scored once."""
    packed = np.ascontiguousarray(rows.astype(np.int8)).view(np.dtype((np.void, rows.shape[1]))).ravel()
    _, first, back = np.unique(packed, return_index=True, return_inverse=True)
    return trees.margin(rows[first])[back]


def decoded(trees: BoostedTrees, texts: list[str]) -> Iterator[tuple[list, list[int]]]:
    """Per text its candidates and the indices of the accepted ones; scored together."""
    parsed = [nodes(t) for t in texts]
    rows = [features(t, f) for t, f in zip(texts, parsed) if f]
    margin = _margins(trees, np.concatenate(rows)) if rows else np.zeros(0)
    at = 0
    for t, f in zip(texts, parsed):
        yield f, decode(t, f, margin[at : at + len(f)])
        at += len(f)


def languages_mask(trees: BoostedTrees, texts: list[str]) -> list[int]:
    out = []
    for found, keep in decoded(trees, texts):
        mask = 0
        for i in keep:
            mask |= 1 << KINDS[found[i][2]][0]
        out.append(mask)
    return out


_FILED = re.compile(r"(?i)\[\[(category|kategorie|catégorie|categoría|file|datei|fichier|archivo):")
_ANY_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_NAME = re.compile(r"\\([A-Za-z]+)")
_BLANKS, _TRAIL = re.compile(r"\n{3,}"), re.compile(r"[ \t]+(?=\n|$)")


def _rendered(text: str, node: Node) -> tuple[int, str]:
    """Where the node's own marks end, and what to write for them: structure stays, marks go."""
    b, e, kind = node[:3]
    inner = text[b:e]
    if kind in ("h_tag", "h_close", "h_escaped"):
        tag = re.search(r"[A-Za-z][A-Za-z0-9-]*", inner.replace("&amp;", "&").replace("&lt;", "").replace("amp;", "").replace("lt;", ""))
        name = tag.group().lower() if tag else ""
        close = kind == "h_close" or "/" in inner[: inner.find(tag.group()) if tag else 0]
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return e, "\n" if close else "\n" + "#" * int(name[1]) + " "
        if name == "li":
            return e, "" if close else "\n- "
        return e, "\n" if name in ("p", "div", "br", "tr", "table", "section", "ul", "ol") else " | " if name in ("td", "th") and close else ""
    if kind == "h_raw":  # code is kept, scripts and styles go
        code = inner[inner.find(">") + 1 : inner.rfind("<")]
        return e, "\n```\n" + html.unescape(_ANY_TAG.sub("", code)).strip("\n") + "\n```\n" if inner[1:4].lower() == "pre" else ""
    if kind == "h_entity":
        return e, html.unescape(inner)
    if kind in ("h_comment", "h_decl", "h_broken", "m_setext", "m_tablesep", "m_table", "w_linkend", "w_end", "w_row", "w_redirect", "w_magic", "w_sign", "w_tag", "l_env", "l_tie", "m_foot", "m_refdef"):
        return e, ""
    if kind in ("m_fence", "m_code", "l_inline", "l_display", "l_dollar", "m_heading", "m_item", "m_order", "m_task"):
        return e, inner
    if kind == "m_auto":
        return e, inner[1:-1]
    if kind == "w_ext":
        return e, inner[1:-1].partition(" ")[2] or inner[1:-1]
    if kind in ("w_list", "w_term"):
        marks = inner.strip(" \t")
        return e, "  " * (len(marks) - 1) + ("- " if marks[-1] in "*#" else "")
    if kind == "l_verb":
        return e, "`" + inner[len(inner) - len(inner.lstrip("\\verb*")) + 1 :].rstrip(inner[-1]) + "`" if node.complete else inner
    if kind == "l_verbatim":
        return e, "```\n" + re.sub(r"\\(?:begin|end)\{[a-z*]+\}", "", inner).strip("\n") + "\n```" if "verbatim" in inner[:20] or "listing" in inner[:20] or "minted" in inner[:20] else "$$" + re.sub(r"\\(?:begin|end)\{[a-z*]+\}|\\label\{[^}]*\}", "", inner).strip() + "$$"
    if kind == "w_link" and _FILED.match(inner):
        return e, ""
    if kind == "w_template":  # one within a line is left out; a longer one loses its marks and keeps its fields
        return (e, "") if node.complete and "\n" not in inner else (b + 2, "")
    if kind == "w_table":
        return e, ""
    if kind in ("w_header", "w_field", "m_row"):
        return b + 1, ""
    if kind == "l_command":
        name = _NAME.match(inner).group(1)
        if name in ("part", "section", "chapter", "subsection", "subsubsection", "paragraph"):
            return e, {"part": "# ", "chapter": "# ", "section": "# ", "subsection": "## "}.get(name, "### ")
        if name == "item":
            return e, "- "
        if name in ("label", "ref", "cite", "citep", "citet", "eqref", "includegraphics", "usepackage", "documentclass", "bibliography") and node.complete == 2:
            return node.extent, ""
        return e, ""
    return (e, "") if kind == "m_quote" else (e, inner)


def _edits(text: str, node: Node) -> list[tuple[int, int, str]]:
    """What to write for which marks of a node: (begin, end, written). What stands between two marks is left to its own nodes."""
    b, e, kind = node[:3]
    inner = text[b:e]
    if kind in EMPHASIS:
        close = closing(text, node)
        k = b
        while k < close and text[k] in "*_~'":
            k += 1
        return [(b, k, ""), (close, e, "")] if close < e else [(b, k, "")]
    if kind in ("m_link", "m_reflink", "m_image"):
        label = inner.find("](") if kind == "m_link" else inner.find("][") if kind == "m_reflink" else inner.find("]")
        return [(b, b + inner.find("[") + 1, ""), (b + max(label, inner.find("]") if label < 0 else label), e, "")]
    if kind == "w_link" and not _FILED.match(inner):
        close = e - 2 if inner.endswith("]]") else e
        opening = max(b + 2, b + inner.rfind("|", 0, close - b) + 1)
        return [(b, opening, ""), (close, e, "")]
    if kind == "w_template" and node.complete and "\n" in inner:
        return [(b, b + 2, ""), (e - 2, e, "")]
    if kind == "w_heading":
        title = inner.strip("= \t\r")
        begin = b + inner.find(title)
        return [(b, begin, "#" * (len(inner) - len(inner.lstrip("="))) + " "), (begin + len(title), e, "")]
    if kind == "l_command" and node.complete == 2:
        at, written = _rendered(text, node)
        return [(b, at, written)] if at == node.extent else [(b, at, written), (node.extent - 1, node.extent, "")]
    at, written = _rendered(text, node)
    return [(b, at, written)]


def clean_markup(text: str, found: list, keep: list[int]) -> str:
    """The text without the marks of its accepted nodes; headings, lists, code and formulas stay as such."""
    out, at, braces = [], 0, False
    for b, e, written, kind in sorted((*edit, found[i][2]) for i in keep for edit in _edits(text, found[i])):
        if b < at:
            continue
        out.append(text[at:b])
        at = e
        braces = braces or kind == "l_command"
        out.append(written)
    out.append(text[at:])
    joined = "".join(out).replace("\r\n", "\n")
    if braces:
        joined = re.sub(r"(?<![\\_^{}\w$])?\}(?=[\s.,;:?!]|$)", "", joined)
    return _BLANKS.sub("\n\n", _TRAIL.sub("", joined)).strip()


def found_markup(records: DataFrame) -> DataFrame:
    """(record_kind, record_id, markup) of records (record_kind, record_id, text), once per record and language."""
    trees = model()
    mask = F.pandas_udf(lambda s: pd.Series(languages_mask(trees, s.tolist()), index=s.index).astype("int32"), "int")
    rows = records.where(F.col("text").isNotNull() & F.col("record_id").isNotNull() & F.col("text").rlike(r"[<>&\[\]{}|\\$*_`~#=+'-]"))
    found = rows.select("record_kind", "record_id", mask("text").alias("m"))
    kinds = F.filter(F.array(*[F.when(F.col("m").bitwiseAND(F.lit(1 << i)) != 0, F.lit(k)) for i, k in enumerate(LANGUAGES)]), lambda x: x.isNotNull())
    return found.select("record_kind", "record_id", F.explode(kinds).alias("markup")).distinct()


def cleaned_texts(records: DataFrame) -> DataFrame:
    """(record_kind, record_id, clean_text, headings, list_items, code_blocks, formulas) of every record, once."""
    trees = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            clean = [clean_markup(t, f, k) for t, (f, k) in zip(texts, decoded(trees, texts))]
            yield pd.DataFrame({
                "record_kind": batch["record_kind"], "record_id": batch["record_id"], "clean_text": clean,
                "headings": [len(re.findall(r"(?m)^#{1,6} ", c)) for c in clean], "list_items": [len(re.findall(r"(?m)^[-*+] ", c)) for c in clean],
                "code_blocks": [len(re.findall(r"(?m)^(?:```|~~~)", c)) // 2 for c in clean], "formulas": [len(re.findall(r"\$[^$\n]+\$|\\\(|\\\[", c)) for c in clean],
            })

    rows = records.where(F.col("record_id").isNotNull()).select("record_kind", "record_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["record_kind", "record_id"])
    return rows.mapInPandas(run, "record_kind string, record_id long, clean_text string, headings int, list_items int, code_blocks int, formulas int")


by_value(__name__)
