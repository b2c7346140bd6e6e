import random
import re

import pytest

from pathloom.plans.catalog import build_catalog
from pathloom.plans.search import highlight, matches, with_path_filter
from pathloom.query import ast, regex_dialect
from pathloom.query.compiler import compile_node
from pathloom.query.parser import parse, reusable
from pathloom.session import materialize

from .data import HOME, ODD, TWO_VOLUMES, entries, volumes

HOME_CASES = {
    "plan py": ["plan.py"], "plan | cake": ["Cake.JPG", "plan.py"], "py !plan": ["beds.py"], '"plan.py"': ["plan.py"], "(plan | beds) py": ["beds.py", "plan.py"],
    "ext:py;json": ["beds.py", "plan.py", "seeds.json"], "ext:MD": ["TODO.MD", "lentil_soup.md"], "folder:": ["", "Recipes", "garden", "shed"], "file:py": ["beds.py", "plan.py"],
    r"regex:^p.*\.py$": ["plan.py"], "wfn:plan.py": ["plan.py"], "*.py": ["beds.py", "plan.py"], "case:PLAN": [], "case:plan": ["plan.py"], "nope:nope": [], "regex:(open": [],
    r"regex:^PLAN\.PY$": ["plan.py"], r"case:regex:^PLAN\.PY$": [], "path:garden": ["beds.py", "garden", "plan.py", "seeds.json", "shed", "shed_tools.csv"], "path:garden/plan": [],
    r"path:garden\plan": ["plan.py"], 'case:"PLAN.py"': ["plan.py"], "path:ec": ["Cake.JPG", "Recipes", "lentil_soup.md"],
}
TWO_VOLUME_CASES = {
    "audio:": ["closing.WAV", "intro.ogg"], "pic:": ["Cake.JPG"], "exe:": ["install.msi"], "audio:intro": ["intro.ogg"], "d: file:": ["closing.WAV", "intro.ogg"], "C: ogg": [],
    r"d:\talks\2019": ["2019", "closing.WAV"], r"parent:D:\Talks": ["2019", "intro.ogg"], "parent:d:\\talks\\": ["2019", "intro.ogg"], "parent:D:": ["Talks"], "parent:d:/talks": ["2019", "intro.ogg"],
    r"parent:C:\garden py": ["beds.py", "plan.py"], r"parent:C:\attic": [], r"case:d:\Talks": [],
}
EVERYTHING = ["", "|", "|||", "()", "<>", "ext:", "case:", "path:", "regex:", "wfn:", "parent:", '""', "***"]


@pytest.fixture(scope="module")
def catalogs(spark):
    v = volumes(spark, ((0, "C", 10), (1, "D", 70)))
    return {k: materialize(build_catalog(entries(spark, rows), v), k) for k, rows in (("home", HOME), ("two", TWO_VOLUMES), ("odd", ODD))}


def names(catalog, query):
    return sorted(r["name"] for r in matches(catalog, query).collect())


@pytest.mark.parametrize("query", HOME_CASES)
def test_home(catalogs, query):
    assert names(catalogs["home"], query) == HOME_CASES[query]


@pytest.mark.parametrize("query", TWO_VOLUME_CASES)
def test_two_volumes(catalogs, query):
    assert names(catalogs["two"], query) == TWO_VOLUME_CASES[query]


@pytest.mark.parametrize("query", EVERYTHING)
def test_no_constraint(catalogs, query):
    assert len(names(catalogs["home"], query)) == 12


def by_hand(node, name, path, is_dir):
    """Row-wise evaluation, without the compiler's rewrites."""
    def fold(x, case):
        return x if case else x.lower()

    match node:
        case ast.All():
            return True
        case ast.And(parts):
            return all(by_hand(p, name, path, is_dir) for p in parts)
        case ast.Or(parts):
            return any(by_hand(p, name, path, is_dir) for p in parts)
        case ast.Not(part):
            return not by_hand(part, name, path, is_dir)
        case ast.Kind(directory):
            return is_dir == directory
        case ast.Contains(text, case):
            return fold(text, case) in fold(name, case)
        case ast.Whole(text, case):
            return fold(text, case) == fold(name, case)
        case ast.Glob(pattern, case):
            if not pattern.strip("*"):
                return True
            body = "".join({"*": "[^\n]*", "?": "[^\n]"}.get(c, re.escape(c)) for c in fold(pattern, case))
            return re.fullmatch(body, fold(name, case)) is not None
        case ast.Rx(pattern, case):
            return re.search(pattern.replace("$", r"\Z"), name, 0 if case else re.I) is not None
        case ast.Ext(exts):
            head, dot, tail = name.rpartition(".")
            return bool(dot) and tail.lower() in exts
        case ast.InPath(text, case):
            if any(c in text for c in "\\/:"):
                return fold(text, case) in fold(path, case)
            return any(fold(text, case) in fold(p, case) for p in path[3:].split("\\"))
    raise TypeError(node)


ODD_QUERIES = [
    "plan", "PLAN", "case:PLAN", "è", "CRÈME", "straße", "*.log", "*.LOG", "p*", "*l*", "p*.py", "case:p*.py", "?lan.py", "what?.log", "50%*off.csv", "*a*e*", "*?", "wfn:notice", "case:wfn:NOTICE",
    "ext:tar", "ext:profile", "ext:c.tar", "ext:log;exe", "!ext:py", "!folder:", "file:a", "regex:^p", r"regex:\.log$", r"regex:^(plan|what)", r"case:regex:[A-Z]{3,}", r"regex:a.*\.t", "regex:è", r"regex:a.b",
    r"regex:^plan\.py$", "path:straße", "case:path:Ärger", r"path:c:\ärger", r"c:\straße", "path:notice", "(a | b) !c", "<plan|notice> file:", "a b | c d", "!!plan", "two*", "*lines.log", "two?lines.log",
    r"regex:\[1\]\{2\}", "ends.", "*.", "regex:^aa", "regex:aa$",
]


@pytest.mark.parametrize("query", ODD_QUERIES)
def test_compiled_equals_by_hand(catalogs, query):
    rows = catalogs["odd"].collect()
    node = parse(query)
    assert names(catalogs["odd"], query) == sorted(r["name"] for r in rows if by_hand(node, r["name"], r["path"], r["is_dir"]))


def test_parser():
    c = ast.Contains
    assert parse("a b|c") == ast.Or((ast.And((c("a"), c("b"))), c("c")))
    assert parse("a | b ) c") == ast.And((ast.Or((c("a"), c("b"))), c("c")))
    assert parse("!") == c("!") and parse("!!") == ast.Not(c("!")) and parse("a !") == ast.And((c("a"), c("!")))
    assert parse("(a <b> c") == ast.And((c("a"), c("b"), c("c")))
    assert parse("(regex:a(b|c)) d") == ast.And((ast.Rx("a(b|c)"), c("d")))
    assert parse("ext:jpg|png") == ast.Or((ast.Ext(("jpg",)), c("png")))
    assert parse('path:"x y"') == c("x y")
    assert parse("ext:.A;b,,a") == ast.Ext(("a", "b"))
    assert parse("file:case:x") == ast.And((ast.Kind(False), c("x", True)))
    assert parse("(" * 500 + "x" + ")" * 500) == c("x")
    parse("!" * 500 + "x")


def test_dialect():
    known = ["a(b|c)*", r"\d+\.\w", "[[:digit:]]", r"\p{L}+", "(?i)x", "(?:a)", "a|", "()", "^*", "[]a]", "[a-z&&[^x]]", r"\b{start}a", "(?-u:\\w)", r"\u{E9}", "a{2}{3}", "(?U)a+"]
    unknown = ["a(?=b)", "(?<!a)b", r"(a)\1", "(", "[a", "*a", "a{,3}", "foo{", "x{a}", "(?a)a", "a{3,2}", "(?P<n>a)(?P<n>b)", "[z-a]", r"[\d-z]", "(?)", "(?i-)a", "\\", r"\Z", r"\x{D800}", "a)", "(?-u).", "(" * 500 + ")" * 500]
    assert [p for p in known if not regex_dialect.accepts(p)] == [] and [p for p in unknown if regex_dialect.accepts(p)] == []
    assert regex_dialect.literal_shape(r"^a\.b$") == ("whole", "a.b") and regex_dialect.literal_shape("a+") is None and regex_dialect.literal_shape(r"\x{41}b") == ("contains", "Ab")
    assert regex_dialect.required_literal(r"^ab+c?def\.x") == "def.x" and regex_dialect.required_literal("foo|bar") == "" and regex_dialect.required_literal("(abc)?x") == "x"


PATTERNS = {
    r"(?P<y>\d+)": ["50%*off.csv", "x[1]{2}.bak", "αβγ_7.log"], r"(?<y>\d+)%": ["50%*off.csv"], r"^\p{Greek}+_": ["αβγ_7.log"], r"\p{sc=Greek}\d": [], r"\p{Nothing}": [], r"^\PL": ["", ".profile", "50%*off.csv"][1:], "a++b": ["aab_aa"],
    "^a{2}{1}b": ["aab_aa"], "(?x) ^ plan  # a word": ["PLAN.Py", "plan.py"], "^[a-z&&[^p]]{3}_": ["aab_aa"], r"^[\w--[α-ω]]{4}\.": ["PLAN.Py", "ends.", "plan.py", "\u212aeys.csv"], "[[:^ascii:]]$": [], "^[[:upper:]]{6}$": ["NOTICE"],
    "(?-i:^PLAN)": ["PLAN.Py"], "^s": ["\u017fetup.exe", "Straße"], "s": ["50%*off.csv", "Straße", "ends.", "inside a file.md", "two\nlines.log", "\u212aeys.csv"], "k": ["x[1]{2}.bak", "\u212aeys.csv"], "^keys": ["\u212aeys.csv"],
    "two.lines": [], "(?s)two.lines": ["two\nlines.log"], "(?m)^lines": ["two\nlines.log"], r"(?m)two$": ["two\nlines.log"], r"\bfile\b": ["inside a file.md"], "a{,3}": [], "x[1]{": ["x[1]{2}.bak"], "[1]{2": ["x[1]{2}.bak"], r"^\x{61}\u0061b": ["aab_aa"],
}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns(catalogs, pattern):
    got = sorted(r["name"] for r in catalogs["odd"].where(compile_node(ast.Rx(pattern))).collect())
    assert got == sorted(PATTERNS[pattern])


def test_no_pattern_ends_a_job(catalogs):
    """Whatever is typed gives rows: 200 made-up patterns, valid and broken."""
    rnd = random.Random(4)
    bits = ["a", "b", "é", ".", "*", "+", "?", "{2}", "{,3}", "{1,", "{", "}", "(", ")", "(?:", "(?P<n>", "(?i)", "(?-i)", "(?", "|", "[", "]", "[^", "a-z", "-", "&&", "~~", "--", "^", "$", "\\d", "\\W", "\\b", "\\", "\\1",
            "\\p{L}", "\\p{", "\\x{41}", "[:alpha:]", "(?=", "(?<!", "++", "\\Q", "\\E", "\\z", "(?x)", "#", "\\k<n>", "\\R", "\\X", "\\h"]
    made = ["".join(rnd.choices(bits, k=rnd.randrange(1, 9))) for _ in range(200)]
    hit = [compile_node(parse("regex:" + p)).cast("int").alias(f"c{i}") for i, p in enumerate(made)]
    for at in range(0, len(hit), 50):
        assert len(catalogs["odd"].select(*hit[at:at + 50]).collect()) == len(ODD)
    assert sum(map(regex_dialect.accepts, made)) > 25


REUSE = [("pl", "plan", True), ("ext:md", "ext:md soup", True), ("ext:md ", "ext:md soup", True), ("ext:m", "ext:md", False), ("ext:md", "ext:md,py", False), ("*.p", "*.py", False),
         ("wfn:pl", "wfn:plan", False), ("soup !", "soup !md", False), ("soup", "soup|cake", False), ("soup", 'soup cake"', False), ("soup", "soup (cake)", False), ("soup", "soup <cake>", False),
         ("soup|cake", "soup|cakes", False), ("!md", "!mdx", False), ("plan", "beds", False)]


@pytest.mark.parametrize("before, after, ok", REUSE)
def test_narrowing_rule(before, after, ok):
    assert reusable(before, after) is ok


def test_highlight():
    assert highlight("Report report.txt", "report !x ext:txt") == [(0, 6), (7, 13)]
    assert highlight("abcabc", "ab bc") == [(0, 6)] or highlight("abcabc", "ab bc") == [(0, 3), (3, 6)]


def test_path_filter():
    assert with_path_filter(" ext:rs ", " src ") == "path:src ext:rs" and with_path_filter("x", " ") == "x" and with_path_filter("", "src") == "path:src"
