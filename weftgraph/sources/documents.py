"""Readers of documents: files, Markdown, HTML, LaTeX, notebooks, EPUB, JSON, tolerant JSON lines."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.shipping import by_value

#: extension -> reader, first match wins; ``skip`` ends quietly
READERS = (
    ("markdown", r"\.(?:md|markdown|mdx)$"), ("html", r"\.(?:html?|xhtml)$"), ("latex", r"\.(?:tex|latex)$"), ("notebook", r"\.ipynb$"), ("epub", r"\.epub$"), ("json", r"\.jsonl?$"), ("mail", r"\.(?:eml|mbox)$"), ("subtitle", r"\.(?:srt|vtt)$"),
    ("sqlite", r"\.(?:sqlite3?|db)$"), ("text", r"\.(?:txt|rst|csv|tsv|log|ya?ml|toml|ini|cfg|py|js|ts|tsx|java|go|rs|c|h|cpp|rb|sh|sql)$|(?:^|/)(?:README|LICENSE|Makefile|Dockerfile)$"), ("skip", r"."),
)


def discover(spark: SparkSession, folder: str, include: str = "*", ignore: str | None = None) -> DataFrame:
    """(path, length, content) of the files below a folder; finding none is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", include).option("recursiveFileLookup", "true").load(folder)
    kept = files.where(~F.col("path").rlike(ignore)) if ignore else files
    if kept.limit(1).count() == 0:
        raise FileNotFoundError(f"no files match {include!r} in {folder}")
    return kept.select("path", "length", "content")


def reader_of(path: Column, head: Column | None = None) -> Column:
    """The reader of a file by its name, SQLite also by its first bytes."""
    out = F.when(head.startswith("SQLite format 3"), "sqlite") if head is not None else None
    for name, pattern in READERS:
        cond = path.rlike("(?i)" + pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def markdown_parts(text: Column) -> Column:
    """Struct of a Markdown text with images numbered, and its images and links."""
    images = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    links = F.regexp_extract_all(text, F.lit(r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    numbered = F.aggregate(F.sequence(F.lit(0), F.size(images)), text, lambda t, i: F.when(i < F.size(images), F.replace(t, F.concat(F.lit("("), F.get(images, i), F.lit(")")), F.concat(F.lit("("), i.cast("string"), F.lit(")")))).otherwise(t))
    return F.struct(numbered.alias("text"), images.alias("images"), F.array_distinct(links).alias("links"))


class _Text(HTMLParser):
    SILENT = frozenset(("script", "style", "nav", "noscript", "template", "svg"))
    BLOCKS = frozenset(("p", "div", "br", "li", "tr", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "pre"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def html_text(markup: str | None) -> str:
    """Visible text of a page: scripts, styles and navigation left out, blocks on their own lines."""
    p = _Text()
    p.feed(re.sub(r"(?is)<title>.*?</title>", "", markup or ""))
    p.close()
    lines = (re.sub(r"[ \t ]+", " ", x).strip() for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def html_pages(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, title, description, json_ld, text, words, minutes, links, paragraphs) of pages, each one chunk."""
    h = F.col(markup)
    text = F.pandas_udf(lambda s: s.map(html_text), "string")(F.coalesce(h, F.lit("")))
    first = lambda *ps: F.coalesce(*[F.nullif(F.trim(F.regexp_extract(h, p, 1)), F.lit("")) for p in ps])
    title = first(r"(?is)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']*)", r"(?is)<title[^>]*>([^<]*)</title>", r"(?is)<h1[^>]*>([^<]*)</h1>")
    about = first(r"(?is)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']*)")
    rows = pages.select(key, title.alias("title"), about.alias("description"), F.regexp_extract(h, r"(?is)<script[^>]+ld\+json[^>]*>(.*?)</script>", 1).alias("json_ld"), text.alias("text"), F.regexp_count(h, F.lit(r"(?i)<a\s")).alias("links"), F.regexp_count(h, F.lit(r"(?i)<p[\s>]")).alias("paragraphs"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return rows.withColumn("words", words).withColumn("minutes", F.ceil(F.col("words") / 200).cast("int"))


def latex_text(text: Column) -> Column:
    """LaTeX without its commands: comments, preamble, environments and markup go, arguments stay."""
    for pattern, by in (
        (r"(?m)(?<!\\)%.*$", ""), (r"(?s)^.*?\\begin\{document\}", ""), (r"\\end\{document\}(?s:.*)$", ""), (r"\\(?:cite[tp]?|ref|label|eqref|pageref)\*?(?:\[[^\]]*\])*\{[^}]*\}", ""), (r"\\(?:section|subsection|subsubsection|chapter|paragraph)\*?\{([^}]*)\}", "\n$1\n"),
        (r"\\item\b", "- "), (r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?", ""), (r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1"), (r"\\[A-Za-z]+\*?", ""), (r"[{}~]", " "), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def latex_citations(text: Column) -> Column:
    keys = F.regexp_extract_all(text, F.lit(r"\\cite[tp]?\*?(?:\[[^\]]*\])*\{([^}]*)\}"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(keys, lambda k: F.split(k, ","))), lambda t: F.trim(t)), lambda k: k != ""))


_NOTEBOOK = "metadata struct<kernelspec:struct<language:string>>, cells array<struct<cell_type:string, source:array<string>, outputs:array<struct<output_type:string, text:array<string>>>>>"


def notebooks(files: DataFrame, outputs: bool = False) -> DataFrame:
    """(path, text) of notebooks: prose as it is, code fenced with the kernel's language, outputs only if asked for."""
    nb = F.from_json("content", _NOTEBOOK)

    def cell(c: Column, language: Column) -> Column:
        source = F.array_join(c["source"], "")
        printed = F.array_join(F.flatten(F.transform(F.filter(F.coalesce(c["outputs"], F.array()), lambda o: o["output_type"] == "stream"), lambda o: F.coalesce(o["text"], F.array().cast("array<string>")))), "")
        code = F.concat(F.lit("```"), language, F.lit("\n"), source, F.lit("\n```"))
        if outputs:
            code = F.concat(code, F.when(printed != "", F.concat(F.lit("\n"), printed)).otherwise(""))
        return F.when(c["cell_type"] == "code", code).otherwise(source)

    rows = files.select("path", nb.alias("nb")).where("nb.cells IS NOT NULL")
    language = F.coalesce("nb.metadata.kernelspec.language", F.lit("python"))
    return rows.select("path", F.array_join(F.filter(F.transform("nb.cells", lambda c: cell(c, language)), lambda t: t != ""), "\n\n").alias("text"))


def _chapters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    opf = next(e.attrib["full-path"] for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))
                    root = ElementTree.fromstring(z.read(opf))
                    hrefs = {e.attrib["id"]: e.attrib["href"] for e in root.iter() if e.tag.endswith("}item")}
                    base = opf.rpartition("/")[0]
                    spine = [hrefs[e.attrib["idref"]] for e in root.iter() if e.tag.endswith("}itemref") and e.attrib["idref"] in hrefs]
                    texts = [html_text(z.read(f"{base}/{h}" if base else h).decode("utf-8", "replace")) for h in spine]
            except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                continue
            kept = [t for t in texts if t]
            rows += [(path, i + 1, len(kept), t) for i, t in enumerate(kept)]
        yield pd.DataFrame(rows, columns=["path", "idx", "total", "text"])


def epub_chapters(files: DataFrame) -> DataFrame:
    """(path, idx, total, text) of the chapters of books in reading order; unreadable books give none."""
    return files.select("path", "content").mapInPandas(_chapters, "path string, idx int, total int, text string")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; malformed ones, such as a last one cut short, are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_per_key(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, record) of tolerant JSON lines, the last line of each key: order is that of the file."""
    lines = spark.read.option("wholetext", "true").text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    keyed = lines.select("n", "line", F.get_json_object("line", f"$.{key}").alias(key)).where(F.col(key).isNotNull() & F.try_parse_json("line").isNotNull())
    return keyed.groupBy(key).agg(F.max_by("line", "n").alias("record"))


def dominant_array(text: Column) -> Column:
    """The elements of the longest array of a JSON object (or of a JSON array itself), as JSON texts."""
    doc = F.try_parse_json(text)
    whole = F.try_variant_get(doc, "$", "array<variant>")
    fields = F.map_values(F.try_variant_get(doc, "$", "map<string,variant>"))
    arrays = F.filter(F.transform(fields, lambda v: F.try_variant_get(v, "$", "array<variant>")), lambda a: a.isNotNull())
    longest = F.reduce(arrays, F.array().cast("array<variant>"), lambda best, a: F.when(F.size(a) > F.size(best), a).otherwise(best))
    return F.transform(F.coalesce(whole, longest, F.array().cast("array<variant>")), lambda v: F.to_json(v))


def directory_tree(paths: DataFrame) -> DataFrame:
    """(parent, name, is_dir): every folder's entries, hidden ones left out; folders come first when sorted by order."""
    parts = F.filter(F.split(F.col("path"), "/"), lambda p: p != "")
    visible = paths.select(parts.alias("p")).where(~F.exists("p", lambda x: x.startswith(".")))
    entry = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.array_join(F.slice("p", 1, i - 1), "/").alias("parent"), F.get("p", i - 1).alias("name"), (i < F.size("p")).alias("is_dir")))
    return visible.where(F.size("p") > 0).select(F.inline(entry)).distinct().withColumn("order", F.concat(F.when(F.col("is_dir"), "0").otherwise("1"), F.col("name")))


by_value(__name__)
