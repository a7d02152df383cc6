import numpy as np
import pytest

from weftgraph.llm.boosting import BoostedTrees
from weftgraph.llm.markup import SEED, clean_markup, cleaned_texts, decoded, found_markup, languages_mask, model, training_nodes
from weftgraph.llm.markup_held_out import false_share, folds, recall_of
from weftgraph.llm.markup_nodes import LANGUAGES, nodes, parents


def languages(text):
    mask = languages_mask(model(), [text])[0]
    return {k for i, k in enumerate(LANGUAGES) if mask >> i & 1}


def cleaned(text):
    (found, keep), = decoded(model(), [text])
    return clean_markup(text, found, keep)


def test_recall_of_kinds_never_seen():
    """Trees fitted without any construct of a fold find most of its kinds by their form."""
    fold = folds(6)[0]
    trees = BoostedTrees().fit(*training_nodes(1200, SEED, skip=fold))
    recalls = {kind: recall_of(trees, kind, 25) for kind in fold}
    assert np.median(list(recalls.values())) >= 0.85, recalls
    assert false_share(trees, 200) <= 0.15


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (2000, 5))
    y = ((x[:, 0] > 2) ^ (x[:, 3] > 2)).astype(float)
    assert ((BoostedTrees(30).fit(x[:1500], y[:1500]).margin(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.97


@pytest.mark.parametrize(
    "text",
    [
        "Tickets were $9 before, now they are $11.", "Only sizes x < 40 and y > 12 fit the shelf.", "Return a Result<Vec<u8>, Error> from there.", "Look under D:\\photos\\summer\\raw for them.", "Marks & Spencer sold it to P&O.", "Earlier work [12], [Smith 1999] and [3, 4] disagree.",
        "Use len(x) * 2 or 3 * y, never both.", "The parameter max_row_count is read by __init__.", "Ticket #88 belongs to #sales-north.", "Write {name} where the '80s were meant.", "It takes a minute -- or ~2 -- to cool down.", "",
    ],
)
def test_prose_is_no_markup(text):
    assert languages(text) == set()
    assert cleaned(text) == text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1. peel the apples\n2. boil some water\n3. stir", {"markdown"}), ("Write to <https://garden.example/seeds> soon.", {"markdown"}), ("A <photo-card id=\"x\">tulip</photo-card> here.", {"html"}), ("<!DOCTYPE html>\nTulips.", {"html"}), ("Trees.\n** oak\n** beech", {"wiki"}),
        ("See [https://garden.example the garden] now.", {"wiki"}), (";oak : a tree", {"wiki"}), ("Planted by ~~~~", {"wiki"}), ("~~~~\nx = 1\n~~~~", {"markdown"}), ("Type \\verb|a_b| there.", {"latex"}), ("Printed \\today in town.", {"latex"}), ("Let $n$ be odd.", {"latex"}),
        ("Oaks <!-- " + "not shown " * 300 + "--> grow.", {"html"}), ("An [" + "old oak " * 60 + "](https://garden.example/oak) grows.", {"markdown"}), ("Oaks <em>grow</em> slowly.", {"html"}), ("Oaks &lt;em&gt;grow&lt;/em&gt; slowly.", {"html"}), ("Oaks&nbsp;grow &mdash; slowly.", {"html"}), ("Oaks **grow** slowly.", {"markdown"}),
        ("An [oak](https://garden.example/oak) grows.", {"markdown"}), ("Oaks.\n\n## Where they grow\n\nIn parks.", {"markdown"}), ("Buy:\n\n- [ ] an oak\n- [x] a beech\n", {"markdown"}), ("The [[Oak tree|oak]] grows.", {"wiki"}), ("== Where they grow ==\nIn parks.", {"wiki"}), ("Oaks '''grow''' slowly.", {"wiki"}),
        ("{| class=\"trees\"\n! tree\n|-\n| oak || 12\n|}", {"wiki"}), ("Oaks.\n__NOTOC__\nBeeches.", {"wiki"}), ("Oaks {{citation|year=1999}} grow.", {"wiki"}), ("Heights $h_{2}=h_1$ differ.", {"latex"}), ("Oaks \\emph{grow} slowly.", {"latex"}), ("\\begin{itemize}\n  \\item oak\n\\end{itemize}", {"latex"}), ("As in~\\ref{fig:oak} above.", {"latex"}),
        ("An <b>oak</b> of height $h_1=h_2$ and **more**.", {"html", "latex", "markdown"}),
    ],
)
def test_languages(text, want):
    assert languages(text) == want


def test_rows_count_only_inside_an_accepted_table():
    alone = "| oak | beech |\n\n" + "Trees grow in parks. " * 30
    assert languages(alone) == set()
    text = alone + "\n\n| tree | age |\n|---|---|\n| oak | 12 |\n"
    (found, keep), = decoded(model(), [text])
    assert {found[i].begin > len(alone) for i in keep if found[i].kind == "m_row"} == {True}


def test_parents_are_the_innermost_open_nodes():
    found = nodes("<div>a <b>c</b></div> d")
    assert [(n.kind, p) for n, p in zip(found, parents(found))] == [("h_tag", -1), ("h_tag", 0), ("h_close", 1), ("h_close", 0)]


def test_structure_survives():
    assert cleaned("<h2>Old trees</h2>\n<p>The <b>oak</b> grows.</p>") == "## Old trees\n\nThe oak grows."
    assert cleaned("== Old trees ==\nThe [[Oak tree|oak]] '''grows'''.") == "## Old trees\nThe oak grows."
    assert cleaned("Oaks **grow** in a [park](https://garden.example/p) here.") == "Oaks grow in a park here."
    assert "$h_{12}=h_1$" in cleaned("Heights $h_{12}=h_1$ are \\emph{equal} there.")
    assert cleaned("Oaks \\textbf{grow \\emph{very} slowly} here.") == "Oaks grow very slowly here."
    code = "Trees.\n\n```python\nage = rings(1)\nif age > 9:\n    cut(2)\n```\nMore."
    assert cleaned(code) == code
    assert cleaned("Do:\n<pre><code>a &lt; b\n</code></pre>\n<script>x = 1</script>End.") == "Do:\n\n```\na < b\n```\n\nEnd."


def test_rows(spark, shuffled):
    rows = [("document", 1, "It was **kept** <b>there</b>.", "x"), ("document", 1, "It was **kept** <b>there</b>.", "x"), ("markdown", 2, None, None), ("html", 3, "", None), ("html", None, "<b>x</b>", None), ("html", 4, "plain prose", None), ("document", 5, "word [x] * < " * 50_000, None)]
    df = spark.createDataFrame(rows, "record_kind string, record_id long, text string, markup string")
    assert shuffled(found_markup(df).where("record_id < 5")) == [("document", 1, "html"), ("document", 1, "markdown")]
    got = {(r.record_kind, r.record_id): r.clean_text for r in cleaned_texts(df.where("record_id < 5")).collect()}
    assert got == {("document", 1): "It was kept there.", ("markdown", 2): "", ("html", 3): "", ("html", 4): "plain prose"}
    assert found_markup(df.limit(0)).count() == 0
    assert found_markup(df.where("record_id = 5")).count() <= 4


@pytest.mark.parametrize(
    ("text", "want", "clean"),
    [
        ("The fee is $20 and <b>rises</b> to $30 a year.", {"html"}, "The fee is $20 and rises to $30 a year."), ("**see <b>x</b>** there", {"markdown", "html"}, "see x there"), ("**see [[Link]]** there", {"markdown", "wiki"}, "see Link there"),
        ("It was **open and then <b>bold</b> came.", {"markdown", "html"}, "It was open and then bold came."), ("The `a <b>x</b>` call", {"markdown"}, "The `a <b>x</b>` call"), ("== The [[Name One|alias]] head ==\ntext", {"wiki"}, "## The alias head\ntext"),
    ],
)
def test_nested_in_candidates(text, want, clean):
    assert languages(text) == want
    assert cleaned(text) == clean


LONG_CODE = "\n".join(f"row_{i} = load('\\new', <tag>, \\frac{{a}}{{b}})" for i in range(400))
LONG_MATHS = " + ".join(f"\\frac{{a_{i}}}{{b}}" for i in range(200))


@pytest.mark.parametrize(
    ("text", "inside"),
    [(f"Text.\n\n\\begin{{lstlisting}}\n{LONG_CODE}\n\\end{{lstlisting}}\nMore.", LONG_CODE), (f"Text.\n\n$$ {LONG_MATHS} $$\nMore.", LONG_MATHS), (f"Text.\n\n\\[ {LONG_MATHS} \\]\nMore.", LONG_MATHS), (f"The ${LONG_MATHS}$ rows.", LONG_MATHS), (f"The \\({LONG_MATHS}\\) rows.", LONG_MATHS)],
    ids=["listing", "dollars", "display", "dollar", "inline"],
)
def test_long_structures_stay_whole(text, inside):
    assert languages(text) == {"latex"}
    assert inside in cleaned(text)


def test_long_comment_and_inline_code():
    assert cleaned("Text <!-- " + "left out 12 " * 400 + "--> goes on.").split() == ["Text", "goes", "on."]
    code = "`" + "call_me(1) " * 60 + "x`"
    assert languages(f"The {code} rows.") == {"markdown"}
    assert code in cleaned(f"The {code} rows.")


def test_unclosed_marks_are_linear():
    for mark in ("<!-- x ", "\\[ x ", "$$$ x ", "\\begin{verbatim} ", "\\( x ", "**x", "[[", "{{", "''x ", "`` x ` ", "<pre>", "\\verb|x "):
        assert len(languages(mark * 30_000)) <= 4
