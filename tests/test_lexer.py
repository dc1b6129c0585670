"""The machine with a stack of modes: its maps compose, and pieces in many tasks give what one text gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import graph
from sourceloom.sources import captures, lexer

SIGNS = ["'", '"', "`", "${", "}", "{", "/*", "*/", "//", "\n", "\\", "a", "b ", "(", ")", "/", "<b>", "</b>", "<br/>", "<i a='", " return ", "=", ";", "x", "\n\n", "<", ">", "#", '"""', "'''"]


@pytest.mark.parametrize(("python", "jsx"), [(True, False), (False, False), (False, True)])
def test_maps_compose(python, jsx):
    r = random.Random(7)
    for _ in range(3000):
        text = "".join(r.choices(SIGNS, k=r.randint(0, 60)))
        pieces = lexer.cut(text, r.randint(1, 12))
        assert "".join(pieces) == text and all(p.endswith("\n") for p in pieces[:-1])
        mode, stack, code, plain = "c", "", "", ""
        for piece in pieces:
            machine = lexer.Machine(piece, python, jsx)
            c, p = machine.render(mode, stack)
            code, plain = code + c, plain + p
            mode, stack = lexer.moved(machine.map(), mode, stack)
        assert (code, plain) == lexer.Machine(text, python, jsx).render()
        assert len(code) == len(plain) == len(text) and code.count("\n") == text.count("\n")


def shown(text, python=False, jsx=True):
    return lexer.Machine(text, python, jsx).render()[0].translate({2: "s", 3: "S", 4: "{", 5: "}", 6: "r"})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("f('a\\'b', 1)", "f(ssssss, 1)"), ("p = `C:\\\\`; g(2)", "p = ssssss; g(2)"), ("'a\\\nb' + g(2)", "sss\nSs + g(2)"), ("'open\nf(1)", "sssss\nf(1)"), ("`a ${f(`b ${x}`)} c`", "ssss{f(ssss{x}s)}sss"),
        ("a / b / c", "a / b / c"), ("x = /[/\"]'/g.y", "x = rrrrrrrr.y"), ("return /'/ + f(1)", "return rrr + f(1)"), ("f(x) / 2 + '/'", "f(x) / 2 + sss"), ("a /* ' */ b // \"", "a         b     "),
        ("e = <b t='x'>it's {f(1)}</b> + 's'", "e = <b t=sss>     {f(1)}</b> + sss"), ("a < b && c > d('x')", "a < b && c > d(sss)"), ("const f = <T extends A>(x) => 'y'", "const f = <T extends A>(x) => sss"), ("} '}' f(1)", "} sss f(1)"),
    ],
)
def test_modes_of_scripts(text, want):
    assert shown(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [('x = """a\\\\"""\nf(1)', "x = sssssssss\nf(1)"), ("'''a'b\\'''c''' + f(1)", "ssssssssssssss + f(1)"), ('r"\\"" # \'\ng', "rssss    \ng"), ("'a\\\nb' + g(2)", "sss\nSs + g(2)"), ("# it's\nf('x')", "      \nf(sss)")],
)
def test_modes_of_python(text, want):
    assert shown(text, python=True) == want


def test_pieces_of_one_file_are_read_by_several_tasks(spark):
    part = "const a = `x ${f(1)\n} ${`y\n${g('}')}`}\n`; /* ' \n */ h = <b>it's {k(2)}\n</b>; // `\nm('a\\\nb', /[`']/)\n"
    rows = [("a.jsx", "javascript", part * 40), ("b.py", "python", "x = '''\n' #\n''' # '''\nf(\"#\")\n" * 40), ("c.ts", "typescript", ""), ("d.ts", "typescript", None), ("e.ts", "typescript", "x" * 500)]
    files = spark.createDataFrame(rows, "path string, language string, text string")
    whole, pieces = ({r.path: (r.text, r.code, r.plain) for r in lexer.lexed(files, size).collect()} for size in (1 << 20, 100))
    assert whole == pieces and set(whole) == {"a.jsx", "b.py", "c.ts", "e.ts"}
    assert all(r[0] == t for r, t in ((whole[p], t) for p, _, t in rows if t is not None))
    assert len(lexer.cut(part * 40, 100)) == 40


TYPED = """abstract class A<T> extends B {
  x: number = f(1);
  static async z(q) { return 1 }
  get y() { return 1 }
  q(x: string): Promise<void> {
    return g(x)
  }
  abstract p(x: number, cb: (a: string, b: number) => void): { a: string };
  over(a: string): void;
  r(m: Map<string, Array<T>>, d = ((((1, 2)))), ...rest): { b: number } | null
  {
    h(2)
  }
}
interface I {
  m(a: string): void;
  n(): string
  o(cb: (x: number) => void): Promise<Map<string, number>>
}
const w = y ? f(1) : { a: 1 };
"""


def test_methods_with_types_and_signatures(spark):
    table = captures.lines(spark.createDataFrame([("f.ts", "typescript", TYPED)], "path string, language string, text string"))
    rows = captures.definitions(table).withColumn("signature", graph.signature(F.col("header"), F.col("language"), None, F.col("params"))).orderBy("start").collect()
    raw = TYPED.encode()
    cut = {r.name: raw[r.start : r.end].decode() for r in rows}
    assert [r.signature for r in rows] == ["A(0)||class", "z(1)|?|async", "y(0)||getter", "q(1)|string|", "p(2)|number,a|", "over(1)|string|", "r(3)|Map,?,?|", "m(1)|string|", "n(0)||", "o(1)|x|"]
    assert cut["q"].endswith("g(x)\n  }") and cut["p"].endswith("{ a: string }") and cut["r"].endswith("h(2)\n  }") and cut["z"].startswith("static async z(q)")
    assert (cut["m"], cut["n"], cut["over"]) == ("m(a: string): void", "n(): string", "over(a: string): void")
    assert sorted(r.preview for r in captures.call_groups(table).collect()) == ["f(1)", "f(1)", "g(x)", "h(2)"]


def test_nested_templates_are_literals_of_their_own(spark):
    text = "a(`x ${`y ${1}`} ${''}\n z`, 'b')"
    table = captures.lines(spark.createDataFrame([("f.ts", "typescript", text)], "path string, language string, text string"))
    rows = captures.literals(table).orderBy("start").collect()
    assert [(r.kind, r.text) for r in rows] == [("lit.template", "`x ${`y ${1}`} ${''}\n z`"), ("lit.template", "`y ${1}`"), ("lit.string", "''"), ("lit.string", "'b'")]
    assert all(text.encode()[r.start : r.end].decode() == r.text for r in rows)


def test_spans_end_within_their_file(spark):
    rows = spark.createDataFrame([("f", 0, 3), ("f", 0, 9), ("g", 1, 2)], "path string, start long, end long")
    sizes = spark.createDataFrame([("f", 5), ("g", 2)], "path string, file_end long")
    assert {tuple(r) for r in captures.sane(rows, sizes).collect()} == {("f", 0, 3), ("g", 1, 2)}


CHAINED = {
    "f.ts": """class A<T> {
  map<U>(f: (x: T) => U, n?: number): A<U> {
    return this.items.map<U>(f)
  }
}
p
  // why
  .then(r => r.json())
  .catch((e) => {
    log<Map<string, (a: T) => U>>(e)
  })
if (a<b && c>(d)) e(1)
const s = [...g(1), ...h.i(2)], q = x ? (y) : z
a?.b.c?.(3)?.d(4)
""",
    "g.js": "a<b>(c)\n",
    "h.py": 'x = df \\\n  .sel(1)\ny = ("é", a.b\n  .c(2)\n\n  .d( # (\n 3))\nif a<b>(c): pass\n',
}


def test_calls_hang_on_the_line_above_and_have_types(spark):
    languages = {"ts": "typescript", "js": "javascript", "py": "python"}
    files = spark.createDataFrame([(p, languages[p[2:]], t) for p, t in CHAINED.items()], "path string, language string, text string")
    made = captures.read(files)
    rows = captures.call_groups(*made.stages).orderBy("path", "start").collect()
    assert all(CHAINED[r.path].encode()[r.start : r.end].decode() == r.preview for r in rows)
    assert [(r.path, r.line_no, r.callee, r.preview, r.n_args) for r in rows] == [
        ("f.ts", 2, "this.items.map", "this.items.map<U>(f)", 1), ("f.ts", 5, "p.then", CHAINED["f.ts"][CHAINED["f.ts"].index("p\n  //") : CHAINED["f.ts"].index("\nif")], 1), ("f.ts", 11, "e", "e(1)", 1),
        ("f.ts", 12, "g", "g(1)", 1), ("f.ts", 12, "h.i", "h.i(2)", 1), ("f.ts", 13, "a.b.c", "a?.b.c?.(3)?.d(4)", 1), ("h.py", 0, "df.sel", "df \\\n  .sel(1)", 1), ("h.py", 2, "a.b.c", "a.b\n  .c(2)\n\n  .d( # (\n 3)", 1),
    ]
    heads = captures.definitions(*made.stages).withColumn("signature", graph.signature(F.col("header"), F.col("language"), None, F.col("params")))
    assert [r.signature for r in heads.orderBy("start").collect()] == ["A(0)||class", "map(2)|x,number|"]
    assert captures.call_groups(*captures.read(files.limit(0)).stages).count() == 0
