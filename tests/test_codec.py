"""Documents through the dense form and back; readers; text functions."""

import io
import random
import zipfile

import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.functions import text as tx
from gneiss.operators import phrases as ph
from gneiss.operators.diff import diff, reshape
from gneiss.operators.perturb import perturb_text
from gneiss.operators.sections import number
from gneiss.plans import codec as c
from gneiss.sources.blocks import Block, Document, read_delimited, read_docx, read_html, read_markdown, read_plain, read_pptx, read_xlsx, reader

#: Lines that read as structure, made from the wire grammar, and values that quoting, references, marks and units stumble over.
STRUCTURAL = [f"!{s} {n}" for n, s in enumerate("TDP", 3)] + ["#" * n + " x" for n in (1, 6)] + [f"{m} y" for m in "-*+>"] + ["12 z", "7. z", "`" * 3, f"{c.MAGIC} x"]
VALUES = ["^" * n for n in (1, 2)] + ["§1 and", "a|b", 'say "hi"', "x: y"] + ["!" * n + t for n, t in ((1, "hello"), (2, "P 3"))] + ["  pad ", "é漢字", "a\x0bb", "(500)", "NULL", "$1,200.50", "45%"]
HOSTILE = STRUCTURAL + VALUES


def random_document(r: random.Random) -> Document:
    text = lambda: r.choice(HOSTILE) + (" " + r.choice(HOSTILE) if r.random() < 0.5 else "")
    blocks = []
    for _ in range(r.randint(0, 10)):
        kind = r.choice(["para", "heading", "list", "table", "quote", "kv", "code", "page", "figure"])
        if kind == "list":
            blocks.append(Block(kind, items=[text() for _ in range(r.randint(1, 6))], ordered=r.random() < 0.5))
        elif kind == "table":
            n = r.randint(1, 4)
            cell = lambda: r.choice([*VALUES, "$5", "$-3", "alpha beta gamma", "12%", "7%", "", "-$4"])
            blocks.append(Block(kind, cols=[r.choice(["a", "b c", "k=v", "x:y", "p($)", "", "%"]) for _ in range(n)], rows=[[cell() for _ in range(r.randint(0, n))] for _ in range(r.choice([0, 1, 3, 5, 30, 120]))]))
        elif kind == "kv":
            blocks.append(Block(kind, pairs=[(r.choice(["key", "a:b", '"q', "!K"]), text()) for _ in range(2)]))
        elif kind == "code":
            blocks.append(Block(kind, r.choice(["x=1\n```\ny", "!T 3\n\n# a", ""]), lang="py"))
        elif kind == "page":
            blocks.append(Block(kind, number=r.randint(0, 9)))
        else:
            blocks.append(Block(kind, text(), level=r.randint(1, 6) if kind == "heading" else 0))
    return Document(r.choice(["", "Title"]), blocks)


@pytest.mark.parametrize("seed", range(150))
def test_round_trip(seed):
    d = random_document(random.Random(seed))
    for o in (*c.ARMS.values(), c.Options(clean=False)):
        e = c.encode(d, o)
        assert c.canonical(c.prepared(d, o)) == c.canonical(c.decode(e))
        assert c.compare(d, c.decode(e))["distinct_recall"] == 1
        if not o.legend:
            assert c.validate(e) == []


@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cc", "Cs")), min_size=1), max_size=6))
@settings(max_examples=200, deadline=None)
def test_any_paragraph(texts):
    assume(all(t.strip() for t in texts))
    d = Document("", [Block("para", t) for t in texts])
    o = c.Options(clean=False)
    assert c.canonical(d) == c.canonical(c.decode(c.encode(d, o)))


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_decode_never_fails(text):
    c.decode(text)
    c.decode("!T 3\n!F " + text + "\n!C a b\n" + text)


def test_dense_is_smaller():
    rows = [[f"SO-{i}", ["Germany", "United States", "France"][i % 3], "shipped yesterday", "USD", f"${i},000.00"] for i in range(60)]
    d = Document("Orders", [Block("table", cols=["id", "country", "status", "currency", "amount"], rows=rows)])
    e = c.encode(d)
    assert "!V 1" in e and "!F" in e and c.token_chars(e) < 0.7 * c.token_chars(c.markdown(d))
    assert c.decode(e).blocks[0].rows[5][4] == "$5000.00"


def test_validator_finds_missing_rows():
    assert [v[1] for v in c.validate("%DENSE1\n!T 5\n!C a b\n1 2\n")][:1] == ["declared-rows"]
    assert c.validate("no magic")[0][1] == "magic-header"


def test_set_aside_and_back():
    menu = " ".join(f"entry{i}" for i in range(200))
    d = Document("", [Block("para", "One. Two. Three."), Block("para", menu), Block("list", items=["a", menu, "b"])])
    out, store = c.set_aside(d, c.token_words)
    assert [b.kind for b in out.blocks] == ["para", "elision", "list", "elision", "list"] and set(store) == {"x1", "x2"}
    assert c.bag(c.put_back(out, store)) == c.bag(d)


def test_clean_and_numbers(spark):
    cases = [("“a” — b", '"a" - b'), ("**bold** _two words_ __init__ snake_case_x", "bold two words __init__ snake_case_x"), ("a  b", "a b"), ("re-\nfer", "refer"), (r"\*x\*", "*x*"), ("", ""), (None, "")]
    got = spark.createDataFrame([(a,) for a, _ in cases], "a string").select(tx.clean_text(F.col("a"))).collect()
    assert [r[0] for r in got] == [b for _, b in cases]
    cells = [("$1,234.00", "$1234.00"), ("(500)", "-500"), ("12.50%", "12.50%"), ("(5", "(5"), ("+7", "7"), ("x1", "x1"), ("-$100", "-$100")]
    got = spark.createDataFrame([(a,) for a, _ in cells], "a string").select(tx.normalize_cell(F.col("a"))).collect()
    assert [r[0] for r in got] == [b for _, b in cells] == [c.normalize(a) for a, _ in cells]


def test_column_escapes(spark):
    d = spark.createDataFrame([(x,) for x in [*HOSTILE, "", "^^^"]], "a string")
    a = F.col("a")
    r = d.select("a", tx.unescape_body(tx.escape_body(a)).alias("b"), tx.one_line(a).alias("one"), tx.unescape_caret(tx.escape_caret(a)).alias("k"), tx.quote_cell(a).alias("q"), tx.code_fence(F.lit("``` ````")).alias("f"), tx.bounded_count(F.lit("a b a b ab"), "a b").alias("n")).collect()
    assert all(x.b == x.one and x.k == x.a and x.f == "`" * 5 and x.n == 2 for x in r)


def test_columns_agree_with_python(spark):
    """Numbers and units of columns and of documents follow one rule."""
    r = random.Random(3)
    cells = [*HOSTILE, *("".join(r.choice("$€-+(),.%0123456789 ") for _ in range(r.randint(0, 7))) for _ in range(600))]
    got = spark.createDataFrame([(x,) for x in cells], "a string").select(tx.normalize_number(F.col("a")), tx.mark_of(F.col("a"))).collect()
    assert [tuple(x) for x in got] == [(tx.plain_number(x), tx.unit_mark(x)) for x in cells]


def test_phrases():
    p = "the quick brown fox jumps over the lazy dog today"
    texts = [f"{p} and {i}" for i in range(6)]
    entries, out = ph.build_dictionary(texts)
    assert len(entries) == 1 and "quick brown fox" in entries[0][1]
    assert [ph.expand_references(t, {n: x for n, x, _, _ in entries}) for t in out] == texts
    assert ph.build_dictionary([f"unique sentence number {i} with words{i}" for i in range(6)])[0] == []


def test_sections():
    assert number([3, 1, 2, 1]) == ["1", "2", "2.1", "3"]
    assert len(set(number([2, 1, 1, 3, 2, 2, 1]))) == 7


def test_readers():
    d = read_markdown("# T\n\n## A\ntext one\ntwo\n\n| a | b |\n|---|---|\n| 1 | x\\|y |\n\n- i\n- j\n\n1. k\n\n> q\n\n```py\ncode\n```\n![alt](u)\n")
    assert d.title == "T" and [b.kind for b in d.blocks] == ["heading", "para", "table", "list", "list", "quote", "code", "figure"]
    assert d.blocks[2].rows == [["1", "x|y"]] and d.blocks[1].text == "text one two"
    h = read_html("<title>T</title><h1>A</h1><p>x <b>y</b><p>z<script>no</p></script><ul><li>a<ul><li>n</li></ul></li><li>b</li></ul><table><caption>C</caption><tr><th>k<th>v</tr><tr><td>1</td><td>2</td></tr></table><blockquote><p>q</p></blockquote><img alt='pic'>")
    assert [(b.kind, b.text) for b in h.blocks] == [("heading", "A"), ("para", "x y"), ("para", "z"), ("list", ""), ("table", ""), ("quote", "q"), ("figure", "pic")]
    assert h.blocks[4].cols == ["k", "v"] and h.blocks[4].caption == "C" and h.blocks[3].items == ["a n", "b"]
    assert read_delimited("a,b\n1,2\n3\n").blocks[0].rows == [["1", "2"], ["3", ""]]
    assert [b.text for b in read_plain("a\nb\n\n\nc").blocks] == ["a b", "c"]
    with pytest.raises(ValueError):
        reader("exe")


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda s, t: f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    xml = f"<w:document {w}><w:body>{p('Title', 'Doc')}{p('Heading2', 'H')}{p('Normal', 'text')}{p('ListNumber', 'a')}{p('ListNumber', 'b')}<w:tbl><w:tr><w:tc>{p('Normal', 'k')}</w:tc></w:tr><w:tr><w:tc>{p('Normal', 'v')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("word/document.xml", xml)
    d = read_docx(f.getvalue())
    assert d.title == "Doc" and [b.kind for b in d.blocks] == ["heading", "para", "list", "table"] and d.blocks[2].ordered


def zipped(files: dict[str, str]) -> bytes:
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return f.getvalue()


def test_xlsx():
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda at, v, t="": f'<c r="{at}"{t}><v>{v}</v></c>'
    shared = ' t="s"'
    data = zipped({
        "xl/workbook.xml": f'<workbook xmlns:r="{r}"><sheets><sheet name="Sales" r:id="a"/><sheet name="One" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/first.xml"/><Relationship Id="b" Target="/xl/worksheets/second.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>amount</t></si><si><r><t>No</t></r><r><t>rth</t></r></si></sst>",
        "xl/worksheets/first.xml": f'<worksheet><sheetData><row>{cell("B2", 0, shared)}{cell("D2", 1, shared)}</row><row/><row>{cell("B4", 2, shared)}{cell("D4", 12)}</row></sheetData></worksheet>',
        "xl/worksheets/second.xml": '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>alone</t></is></c></row></sheetData></worksheet>',
    })
    a, b = read_xlsx(data).blocks
    assert (a.caption, a.grp, a.cols, a.rows) == ("Sales", "Sales", ["name", "amount"], [["North", "12"]])
    assert (b.cols, b.rows) == (["c1"], [["alone"]])


def test_pptx():
    """Notes belong to the slide that names them, whatever their number."""
    p = lambda *texts: "".join(f"<p><r><t>{t}</t></r></p>" for t in texts)
    slide = lambda title, *texts: f'<sld><sp><nvPr><ph type="title"/></nvPr><txBody>{p(title)}</txBody></sp><sp><txBody>{p(*texts)}</txBody></sp></sld>'
    link = '<Relationships><Relationship Id="r" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/notesSlide" Target="../notesSlides/notesSlide1.xml"/></Relationships>'
    data = zipped({
        "ppt/slides/slide1.xml": slide("First", "a", "b"), "ppt/slides/slide2.xml": slide("", "only"), "ppt/slides/slide10.xml": slide("Last"),
        "ppt/slides/_rels/slide2.xml.rels": link, "ppt/notesSlides/notesSlide1.xml": f"<notes><sp><txBody>{p('said')}</txBody></sp></notes>",
    })
    assert [(b.kind, b.text, b.items, b.pairs) for b in read_pptx(data).blocks] == [
        ("heading", "First", [], []), ("list", "", ["a", "b"], []), ("heading", "Slide 2", [], []), ("para", "only", [], []), ("kv", "", [], [("notes", "said")]), ("heading", "Last", [], [])]


def test_marks_and_numbers():
    """The scanner for emphasis, and numbers and units of cells."""
    cases = {"***a*** b": "a b", "2 * 3 * 4": "2 * 3 * 4", "**x*": "*x", "a*b*c": "abc", "_ital and_ __strong words__": "ital and strong words", r"\*a\* *b*": "*a* b", "_one_": "_one_", "`a_b`": "`a_b`"}
    assert {k: tx.clean_string(k) for k in cases} == cases
    units = {"$5": "$", "-$5": "$", "$-5": "$", "7%": "%", "-7.5%": "%", "5": None, "$5%": None, "$": None, "": None, "x%": None}
    assert {k: tx.unit_mark(k) for k in units} == units


@given(st.text(alphabet="$€-+(),.%0123456789 x", max_size=9))
@settings(max_examples=300, deadline=None)
def test_plain_number_settles(text):
    once = tx.plain_number(text)
    assert tx.plain_number(once) == once


def test_diff():
    rows = [[str(i), f"name{i}"] for i in range(5)]
    old = Document("", [Block("heading", "H", level=1), Block("para", "same text here"), Block("table", cols=["id", "n"], rows=rows)])
    new = Document("", [Block("heading", "H", level=1), Block("page", number=2), Block("para", "same text here"), Block("table", cols=["id", "n"], rows=[*rows[:2], ["2", "changed"], *rows[4:], ["9", "new"]])])
    assert diff(old, old) == "!DIFF old -> new\n!= 3\n"
    text = diff(old, new)
    assert "~ 2\tname2->changed" in text and "+ 9\tnew" in text and "- 3\tname3" in text and "(matched by key: id)" in text
    assert reshape(text, "json").startswith("[") and "##" in reshape(text, "md")
    assert "~ 2" not in diff(old, new, summary=True)


def test_perturb():
    text, changed = perturb_text("42 and 42 and 7.50 at Acme", "d1", {"Acme": "Bolt"})
    assert text.split(" ")[0] == text.split(" ")[2] == changed["42"] and "Bolt" in text
    assert perturb_text("42", "d1") == ("%s" % changed["42"].split(".")[0], {"42": changed["42"]})


def test_perturb_document():
    from gneiss.operators.perturb import perturb_document

    d = Document("Plan 42", [Block("para", "42 units"), Block("table", cols=["n"], rows=[["42"], ["7"]]), Block("page", number=42)])
    out, changed = perturb_document(d, "d")
    assert out.title == f"Plan {changed['42']}" and out.blocks[1].rows[0] == [changed["42"]] and out.blocks[2].number == 42


def test_looks_unescaped():
    assert c.looks_unescaped(Document("", [Block("para", "# x"), Block("para", "fine"), Block("heading", "# y", level=1)])) == ["# x"]


def test_sql_functions(spark):
    from gneiss.functions.register import register

    assert "clean_text" in register(spark)
    r = spark.sql("select clean_text('**a**  b'), normalize_cell('(1,200)'), dense_escape('# x'), token_chars('abcde'), clean_text(null)").first()
    assert tuple(r) == ("a b", "-1200", "!# x", 2, None)
