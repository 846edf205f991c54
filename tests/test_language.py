import pytest

from tamarack.functions import vbalang as L
from tamarack.functions.formula import Err, Evaluator
from tamarack.operators import pcode


def kinds(text):
    return [(t.kind, t.text) for t in L.lex(text) if t.kind not in ("newline", "eof")]


def test_lex():
    assert kinds('x = "a""b" & 1.5E3# \' note') == [("identifier", "x"), ("operator", "="), ("string", '"a""b"'), ("operator", "&"), ("number", "1.5E3#")]
    assert [t for _, t in kinds("a = 1 _\n + 2: Rem x\nRemove")] == ["a", "=", "1", "+", "2", ":", "Remove"]
    assert [t for _, t in kinds("s$ = a&\"x\" & &HFF& & #1/2/2020#")] == ["s$", "=", "a", "&", '"x"', "&", "&HFF&", "&", "#1/2/2020#"]
    t = L.lex("é = 1\r\nb")
    assert [(x.text, x.start, x.line, x.column) for x in t if x.kind == "identifier"] == [("é", 0, 1, 1), ("b", 8, 2, 1)]


def test_expression_binding():
    def shape(s):
        def show(n):
            return n["text"] if not n["children"] else f"({n['text'] or n['kind']} {' '.join(map(show, n['children']))})"

        tree = L.parse_expression([t for t in L.lex(s) if t.kind != "eof"])
        return tree and show(tree)

    assert shape("a + b * c ^ d") == "(+ a (* b (^ c d)))"
    assert shape("Not a = b And c") == "(And (Not (= a b)) c)"
    assert shape("-2 ^ 2") == "(- (^ 2 2))"
    assert shape("a & b + c") == "(& a (+ b c))"
    assert shape("f(1, , x:=2).g!h") == "(h (g (index f 1 missing (x 2))))".replace("missing", "")
    assert shape("1 +") is None and shape("(a") is None


def test_preprocess():
    text, problems = L.preprocess("#Const A = 3\n#If A > 2 And VBA7 Then\nx\n#ElseIf A = 3 Then\ny\n#Else\nz\n#End If\nlast", {"vba7": False})
    assert text.split() == ["y", "last"] and not problems
    text, problems = L.preprocess("#If Q Then\nx\n#Else\nz\n#End If\n")
    assert text.split() == ["x", "z"] and problems[0][0] == 1
    assert L.preprocess("#End If\n#If 1 Then")[1] == [(1, "#End If without #If"), (2, "#If without #End If")]
    src = "#If 0 Then\nabc\r\n#End If\n"
    assert len(L.preprocess(src)[0]) == len(src)


def test_graph_of_loops_and_jumps():
    procs, _, problems = L.parse("Sub A()\nDo\nx = 1\nIf x Then Exit Do\nLoop Until x > 3\nGoTo out\ny = 2\nout:\nEnd Sub")
    g = L.Graph().build(procs[0]["body"])
    assert not problems and g.complete
    assert ("loop_test", "Until x > 3") in [(k, t) for _, k, t, _ in g.nodes]
    assert any(c == "(x > 3) = True" for *_, c in g.edges)
    dead = {n for n, k, t, _ in g.nodes if t == "y = 2"}
    assert not [e for e in g.edges if e[1] in dead]


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ('=CHAR(99)&CHAR(109)&CHAR(100)&"|\'/c calc\'!A0"', "cmd|'/c calc'!A0"), ("=CONCAT(OFFSET(A1,0,0,1,3))", "cmd"), ("=INDIRECT(ADDRESS(1,1))", "c"), ("=LET(x,2,x*3)", 6.0), ("=REDUCE(0,{1,2;3,4},LAMBDA(a,b,a+b))", 10.0), ('=VLOOKUP(2,{1,"a";2,"b"},2,FALSE)', "b"), ("=1/0", Err("#DIV/0!")), ('=IFERROR(1/0,"z")', "z"),
        ("=-2^2", 4.0), ("=ROUND(2.5,0)", 3.0), ("=A3", Err("#REF!")), ("=nope()", Err("#NAME?")), ("=50%+1", 1.5), ('=IMSQRT("3+4i")', "2+i"), ("=REPT(\"a\",40000)", Err("#VALUE!")), ("=SUM(SEQUENCE(3))", 6.0),
    ],
)
def test_formula(formula, want):
    cells = {("S", 1, 1): "c", ("S", 1, 2): "m", ("S", 1, 3): "d", ("S", 3, 1): "=A3"}
    assert Evaluator(cells, "S").evaluate(formula) == want


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("T.INV.2T(0.05,10)", 2.228138852), ("CHISQ.INV(0.95,3)", 7.814727903), ("BETA.INV(0.5,2,3)", 0.385727568), ("F.INV(0.9,3,7)", 3.074071994), ("BESSELJ(1.9,2)", 0.329925829), ("BESSELI(1.5,1)", 0.981666428), ("BESSELK(1.5,1)", 0.277387800), ("BESSELY(2.5,1)", 0.145918138), ("ERF(0.745)", 0.707928920),
        ("DURATION(43282,54058,0.08,0.09,2)", 10.919145282), ("IRR({-70000,12000,15000,18000,21000,26000})", 0.086630948), ("NORM.DIST(42,40,1.5,TRUE)", 0.908788780), ("GAMMA.DIST(10.00001131,9,2,TRUE)", 0.068094004), ("HYPGEOM.DIST(1,4,8,20,FALSE)", 0.363261094), ("PMT(0.08/12,10,10000)", -1037.032089359), ("TBILLEQ(39538,39600,0.0914)", 0.094151494),
    ],
)
def test_formula_numbers(formula, want):
    assert Evaluator({}).evaluate(formula) == pytest.approx(want, rel=1e-6)


def test_compiled_operators():
    i = lambda n: ("Integer", n)
    assert pcode.binary("+", i(2), ("Float", 0.5)) == ("Float", 2.5)
    assert pcode.binary("and", ("Boolean", False), pcode.NULL) == ("Boolean", False)
    assert pcode.binary("+", pcode.NULL, i(1)) == pcode.NULL
    assert pcode.binary("=", ("Error", 5), ("Error", 5)) == ("Boolean", True)
    assert pcode.binary("+", pcode.EMPTY, i(3)) == i(3)
    assert pcode.binary("/", i(-7), i(2)) == i(-3) and pcode.binary("mod", i(-7), i(2)) == i(-1)
    assert pcode.binary("*", i(2**62), i(4)) == pcode.UNKNOWN
    assert pcode.unary("not", i(0)) == i(-1) and pcode.unary("negate", pcode.EMPTY) == i(0)


def test_compiled_paths():
    code = [{"do": "load", "name": "x"}, {"do": "branch_if", "by": 3}, {"do": "push", "value": ("Integer", 1)}, {"do": "store", "name": "y"}, {"do": "return"}]
    out = pcode.run(code)
    assert sorted(p["stop"] for p in out["paths"]) == ["return", "return"] and out["unknown"] == 1
    loop = pcode.run([{"do": "branch", "by": 0}])
    assert loop["paths"][0]["stop"] == "cycle_pruned"
    assert pcode.validate_masks([0x3FF, 0xFC00]) and not pcode.validate_masks([0x3, 0x2]) and not pcode.validate_masks([0x5])


def test_gosub_returns_come_back():
    from tamarack.operators.facts import gosub_returns

    # 0 calls 5 and goes on at 1, 1 calls 5 and goes on at 2; 6 returns.
    edges = [(5, 6, None), (2, 9, None)]
    got, cut = gosub_returns(edges, {0: (5, 1), 1: (5, 2)}, {6}, 0)
    assert not cut and {(6, 1, 0), (6, 2, 0), (0, 5, 1), (1, 5, 1), (2, 9, 0)} <= set(got)
    assert not [e for e in got if e[0] == 6 and e[2] > 0]
    assert gosub_returns([], {0: (0, 1)}, set(), 0, max_depth=3)[1]
