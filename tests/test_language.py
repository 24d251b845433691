import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from subsetry.lang import LanguageError, parse
from subsetry.lang import syntax as s
from subsetry.operators.predicate import statements, translate
from subsetry.plans.plan import Plan, PlanError
from subsetry.plans.resolve import Resolver, load_plan, with_gets
from subsetry.plans.values import as_text, evaluate


def value(expression, **names):
    (x,) = parse(f"#[when({expression})] full t")
    return evaluate(x.when, names)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1 + 2 * 3 == 7", True), ("(1 + 2) * 3 == 9", True), ("-7 / 2 == -3", True), ("-7 % 2 == -1", True), ("1 == 1.0", False),
        ("1 < 1.5", True), ("!false && true", True), ("false || true && false", False), ('"a" != "b"', True), ("10 - 3 - 2 == 5", True), ("1.5 + 1 == 2.5", True),
    ],
)
def test_expressions(text, expected):
    assert value(text) is expected


@pytest.mark.parametrize("text", ["1 / 0 == 1", '"a" + 1 == 2', "1 && true", "9223372036854775807 + 1 > 0", "$nope"])
def test_expression_errors(text):
    with pytest.raises(PlanError):
        value(text)


def test_numbers_as_text():
    assert [as_text(x) for x in (3.0, 0.5, 1e21, True, None, [1, 2], -0.25)] == ["3", "0.5", "1000000000000000000000", "true", "NULL", "[1, 2]", "-0.25"]


def test_strings():
    (x,) = parse(r'preserve t where "a\{b \" \n \% {$v + 1}"')
    assert x.where.parts[0] == 'a{b " \n \\% '
    assert isinstance(x.where.parts[1], s.Binary)


def test_regex_and_division():
    x, y = parse("exclude_data /^a_b$/ #[when($a / 2 > 1)] full t, /xy|z/")
    assert x.patterns == [s.Pattern("^a_b$", True)]
    assert y.patterns == [s.Pattern("t"), s.Pattern("xy|z", True)]


def test_keywords_and_backticks():
    (x,) = parse("ignore_table `order`")
    assert x.patterns[0].text == "order"
    with pytest.raises(LanguageError) as e:
        parse("ignore_table order")
    assert "backticks" in str(e.value)
    (x,) = parse('preserve t where "{$limit}"')
    assert x.where.parts == (s.Var("limit"),)


def test_every_error_is_told():
    with pytest.raises(LanguageError) as e:
        parse('full\nrelation a.b > c.d\nvar x: int = 99999999999999999999\npreserve t where "${x}"')
    places = [p.place(e.value.source)[0] for p in e.value.problems]
    assert places == [2, 2, 3, 4]
    assert "did you mean {$name}?" in str(e.value)


def test_clauses_have_an_order():
    with pytest.raises(LanguageError):
        parse('aggregate a { root t limit 1 where "x" }')


def test_all_statements():
    text = '''
    var n: int = 3 // comment
    var names: string[] = ["a", "b"]
    faker f [...$names, "c{unique()}"]
    relation a.b -> c.d
    ignore_relation `a`.b -> c.d
    anonymize t { x -> f y -> null }
    exclude_data e
    ignore_table i
    full a, /^b/
    aggregate agg { root r where "k = {$n}" order by k desc limit $n exclude e, /f/ root_only }
    get g(p: int = 1, q: string) { agg where "k > {$p} and q = '{$q}' and n = {$n}" limit $p }
    preserve p where "x"
    set s { match a = 1, b = "x{$n}" c = -1.5 d = $n e = true }
    after { """DELETE FROM x WHERE a = "b{c}" """ "SELECT 1" }
    #[when($n == 4)] full never
    '''
    plan = load_plan(text=text)
    assert plan.fakers == {"f": ["a", "b", "c{unique()}"]}
    assert plan.aggregates[0].where == "k = 3" and plan.aggregates[0].limit == 3 and plan.aggregates[0].descending
    assert plan.sets[0].match == [("a", 1), ("b", "x3")] and plan.sets[0].assign == [("c", -1.5), ("d", 3), ("e", True)]
    assert plan.after == ['DELETE FROM x WHERE a = "b{c}" ', "SELECT 1"]
    assert not plan.full.matches("never") and plan.full.matches("bcd") and not plan.full.matches("abd")
    again = Plan.from_json(plan.to_json())
    assert again == plan
    got = with_gets(plan, [("g", {"q": "z", "p": "5"}), ("g", {"q": "y"})])
    assert [a.where for a in got.aggregates] == ["k > 5 and q = 'z' and n = 3", "k > 1 and q = 'y' and n = 3"]
    assert [a.limit for a in got.aggregates] == [5, 1] and got.aggregates[0].root_only and got.aggregates_only and not got.after
    assert got.aggregates[0].exclude.names == ["e"] and got.anonymize


@pytest.mark.parametrize(
    "text",
    [
        "anonymize t { a -> nothing }", "var x: int", 'var x: int = "a"', "full /(/", 'get g() { missing }', 'faker f ["a{unique() + 1}"]',
        'var a: string = "x" var b: string = "{$a}"', 'preserve t where "{unique()}"', "aggregate a { root t limit $x }", 'var x: string = "1" aggregate a { root t limit $x }',
    ],
)
def test_plan_errors(text):
    with pytest.raises(PlanError):
        load_plan(text=text)


def test_variables_from_outside():
    assert load_plan(text="var x: int var y: bool = true", variables={"x": "7", "y": "no"}).variables == {"x": 7, "y": False}
    assert load_plan(text="var x: float = 1").variables == {"x": 1.0}
    with pytest.raises(PlanError):
        load_plan(text="var x: int", variables={"x": "seven"})
    assert Resolver(lenient=True).source("var x: int").variables == {"x": 0}


def test_imports(tmp_path):
    (tmp_path / "c").write_text('after { "c" } var base: int = 1')
    (tmp_path / "a").write_text('import "c" after { "a" } var base: int = 2')
    (tmp_path / "b").write_text('import "c" import "root" after { "b" }')
    (tmp_path / "root").write_text('import "a" import "b" after { "root" } var mine: string = "{$base}" #[when($base == 2)] import "missing"')
    with pytest.raises(FileNotFoundError):
        load_plan(str(tmp_path / "root"), {"base": 2})
    (tmp_path / "missing").write_text("full z")
    plan = load_plan(str(tmp_path / "root"))
    assert plan.after == ["c", "a", "b", "root"] and plan.variables["mine"] == "2" and plan.full.matches("z")


def test_json(tmp_path):
    (tmp_path / "more").write_text('var from_text: int = 5 full /^x/ aggregate t { root tt } get g() { t }')
    (tmp_path / "c.json").write_text('''{
      "import": [{"path": "more"}], "variable": [{"name": "on", "type": "bool", "default": false}, {"name": "n", "type": "int", "default": 4}],
      "faker": [{"name": "e", "values": ["a{$n}"]}, {"name": "no", "values": [], "when": "$on"}],
      "relation": [{"from": "a.b", "to": "c.d"}], "exclude": [{"table": "ex"}], "ignore": [{"table": "ig", "when": "!$on"}],
      "anonymize": {"t": [{"column": "x", "faker": "e"}, {"column": "y", "null": true}]},
      "aggregate": [{"name": "r", "root": "o", "where": "k = {$n} and j = $n and z = $zz", "order_by": {"column": "k", "direction": "DESC"}, "limit": "$n"}],
      "include": [{"aggregate": "r", "where": "k = 1"}, {"aggregate": "nobody"}], "preserve": [{"table": "p", "where": "1=1"}],
      "set": [{"table": "s", "match": {"a": "x{$n}"}, "value": {"b": 1.5}}], "after": [{"sql": "DELETE FROM t WHERE n = {$n}"}]}''')
    plan = load_plan(str(tmp_path / "c.json"))
    root = next(a for a in plan.aggregates if a.name == "r")
    assert root.where == "k = 4 and j = 4 and z = $zz" and root.descending and root.limit == 4
    assert [a.where for a in plan.aggregates if "include" in a.name] == ["k = 1"]
    assert plan.fakers == {"e": ["a4"]} and plan.ignore_tables.names == ["ig"] and plan.after == ["DELETE FROM t WHERE n = 4"]
    assert plan.full.matches("xyz") and "g" in plan.gets and plan.variables["from_text"] == 5
    with pytest.raises(PlanError):
        (tmp_path / "d.json").write_text('{"after": [{"sql": "{$missing}"}]}')
        load_plan(str(tmp_path / "d.json"))


def test_sql_translation():
    assert translate("a > DATE_SUB(NOW(), INTERVAL 90 DAY)") == "a > ((NOW()) - INTERVAL 90 DAY)"
    assert translate("DATE_ADD(DATE_SUB(x, INTERVAL 1 DAY), INTERVAL 2 YEAR)") == "((((x) - INTERVAL 1 DAY)) + INTERVAL 2 YEAR)"
    assert translate('a = "it\'s" && b') == "a = 'it\\'s'  AND  b"
    assert translate("DATE_SUB(x, 3)") == "DATE_SUB(x, 3)"
    assert translate("a LIKE 'x%'", True) == "a LIKE 'x%' COLLATE UTF8_LCASE"
    assert translate("a = 'DATE_SUB(x, INTERVAL 1 DAY)'") == "a = 'DATE_SUB(x, INTERVAL 1 DAY)'"
    kinds = [type(x).__name__ for x in statements("UPDATE t SET a = f(1, 2), `b` = 'x;y' WHERE c IN (1); DELETE FROM t; TRUNCATE TABLE t; SELECT 1; INSERT INTO t (a) VALUES (1)")]
    assert kinds == ["Update", "Delete", "Delete", "Select", "Insert"]
    with pytest.raises(PlanError):
        statements("DROP TABLE t")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='abc{}"\\$/ \n#[](),.->=1', max_size=40))
def test_any_text_parses_or_fails_cleanly(text):
    try:
        parse(text)
    except LanguageError as e:
        assert str(e)
