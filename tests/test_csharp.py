import pytest

from lodestone.csharp import condition, parse


def names(source, *symbols):
    return [(d.kind, d.name, d.container) for d in parse(source, frozenset(symbols))[0]]


def test_nested_namespaces_and_signature():
    found, error = parse("namespace A.B { public class C { public static void Save(int x) { } } }")
    assert error is None
    assert found[0][:4] == ("class", "C", "A.B", "public")
    assert found[1].signature == "void (int)" and found[1].container == "A.B.C" and found[1].line == 1


def test_line_is_of_the_identifier():
    found, _ = parse("[X(\n1)]\nclass A {\n [Y]\n\n int P { get; } }")
    assert [d.line for d in found] == [3, 6]


def test_file_scoped_namespace_and_nesting():
    assert names("namespace A;\nclass O { class I { int f; } }") == [("class", "O", "A"), ("class", "I", "A.O"), ("field", "f", "A.O.I")]


def test_generic_arity_bases_and_attributes():
    found, _ = parse("[Serializable, Obsolete(\"a]\")] class R<T, U> : Base, IFoo<int> where T : class { }")
    assert (found[0].name, found[0].attributes, found[0].bases) == ("R`2", "Serializable,Obsolete", "Base,IFoo<int>")


def test_enum_members_in_order():
    assert [d.name for d in parse("enum E : byte { A = 1 << 2, [X] B, }")[0]] == ["E", "A", "B"]


def test_explicit_interfaces():
    assert [d.name for d in parse("class C { void IDisposable.Dispose() { } int I<T>.P => 1; }")[0]][1:] == ["IDisposable.Dispose", "I<T>.P"]


def test_conditional_code():
    assert names("#if PAF\nclass A { }\n#else\nclass B { }\n#endif") == [("class", "B", "")]
    assert names("#if PAF\nclass A { }\n#else\nclass B { }\n#endif", "PAF") == [("class", "A", "")]


@pytest.mark.parametrize(("text", "value"), [("A && !B", True), ("(A || B) && C", False), ("true", True), ("A == B", False), ("!(B || C)", True)])
def test_conditions(text, value):
    assert condition(text, frozenset({"A"})) is value


def test_first_error_keeps_the_class():
    found, error = parse("class A {\n void M(\n}")
    assert found[0].name == "A" and error is not None


def test_bodies_and_strings_are_skipped():
    source = 'class A { string s = $"{(x ? "}" : "{")}" + @"\\" + """ class Z { } """; void M() { int F() { return 1; } var c = \'}\'; } ~A() { } public static A operator +(A a, A b) => a; int g; }'
    assert [d.name for d in parse(source)[0]] == ["A", "s", "M", "g"]


def test_cells_are_clean():
    assert "\n" not in parse("class A { void M(Dictionary<int,\n\tint> a) { } }")[0][1].signature


def test_field_initialisers():
    assert [d.name for d in parse("class A { int a = b < c ? 1 : 2, d = F<int, int>(1, 2), e; bool f = x < y, g; }")[0]][1:] == ["a", "d", "e", "f", "g"]
