"""Text, type and tree functions on the cases that matter."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import ast as A
from quern.functions import source
from quern.functions import text as X
from quern.functions.telescope import context_and_goal, telescope
from quern.operators import blocks, views


def value(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "parts"), [("A → B → C", ["A", "B", "C"]), ("A -> (B -> C) -> D", ["A", "(B -> C)", "D"]), ("", []), ("→ A", ["A"]), ("A) → B", ["A)", "B"]), ("{x → y} → [a → b]", ["{x → y}", "[a → b]"]), ("(A → B", ["(A → B"]), ("(A] → B", ["(A] → B"]), ("[a) → b] → c", ["[a) → b]", "c"]), ("a --> b", ["a -", "b"])])
def test_split_arrows(spark, text, parts):
    assert value(spark, X.split_arrows(F.col("t")), t=text) == parts


def plain_telescope(s):
    """The same by a walk with a list as the stack."""
    at, found = 0, []
    while True:
        while at < len(s) and s[at] in " \t\n\r\f\v":
            at += 1
        if at == len(s) or s[at] not in "({":
            return found, s[at:]
        stack, end = [], None
        for k in range(at, len(s)):
            if s[k] in "({":
                stack.append(s[k])
            elif stack and s[k] in ")}" and stack[-1] == {")": "(", "}": "{"}[s[k]]:
                stack.pop()
                if not stack:
                    end = k
                    break
        if end is None:
            return found, s[at:]
        names, colon, kind = s[at + 1 : end].partition(":")
        found += [(n, kind.strip(), "implicit" if s[at] == "{" else "explicit") for n in names.split() if colon]
        at = end + 1


def test_telescope(spark):
    r = random.Random(6)
    texts = ["{a b : Set} (x : A (b)) {skip} → C", "(open → C", "", None, "  ", "{a : (x } y)} (b : ∀ {c} → d) e", "(:T)", "(a b:)(c : d : e) ", "{" * 300 + "x : y" + "}" * 300 + "→"]
    texts += ["".join(r.choice("(){}: aB→\n") for _ in range(r.randint(0, 40))) for _ in range(400)] + ["(x : " + "A → " * 20_000 + ") B"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, type string").select("k", telescope("type").alias("p"))
    for k, p in d.collect():
        assert ([tuple(b) for b in p["binders"]], p["rest"]) == plain_telescope(texts[k] or ""), texts[k]
    assert "Python" not in d._jdf.queryExecution().toString()


def test_context_and_goal(spark):
    d = spark.createDataFrame([("(x : A) → (y : B) → C",)], "type string").withColumn("p", telescope("type"))
    r = d.select(context_and_goal(F.col("p"), X.split_arrows(F.col("p.rest")), F.array(F.lit("n0"), F.lit("n1"))).alias("v")).first()["v"]
    assert [(c["name"], c["type"]) for c in r["context"]] == [("x", "A"), ("n1", "(y : B)")] and r["goal"] == "C"


def test_binders(spark):
    tree = '{"tag":"Type","term":{"tag":"Pi","binder":{"hiding":"implicit"},"cod":{"tag":"Type","term":{"tag":"Pi","binder":{"nameHint":" n "},"cod":{"tag":"Pi","cod":{"tag":"Sort"}}}}}}'
    names = A.binder_names(A.pi_binders(F.col("t")))
    assert value(spark, names, t=tree) == ["i2", "n", "x0"]
    assert value(spark, A.pi_arity(F.col("t")), t=tree) == 3
    assert [value(spark, A.resolve_index(F.col("b"), names), t=tree, b=b) for b in ("@0", "@2", "@3", "@99999999999999999999", "x")] == ["x0", "i2", None, None, None]
    assert value(spark, A.pi_arity(F.col("t")), t="odd") == 0


def test_binders_are_followed_to_the_end(spark):
    tree = '{"tag":"Pi","binder":{"nameHint":"n"},"cod":' * 100 + '{"tag":"Sort"}' + "}" * 100
    assert value(spark, F.size(A.pi_binders(F.col("t"))), t=tree) == 100 == value(spark, A.pi_arity(F.col("t")), t=tree)
    assert value(spark, A.canonical(F.col("t")) == A.canonical(F.replace("t", F.lit('"n"'), F.lit('"other"'))), t=tree)


def test_names(spark):
    assert value(spark, X.pretty_qname(F.col("q")), q="A._.b..c") == "A.b.c"
    assert value(spark, X.drop_anonymous(F.col("q")), q=" M . _ . f ") == "M.f"
    assert value(spark, X.drop_anonymous(F.col("q")), q="_._") == "_._"
    assert value(spark, F.struct(*X.split_last(F.col("q"))), q="bare")[:] == ("", "bare")
    assert [value(spark, X.looks_qualified(F.col("q")), q=q) for q in ("a.b", "a", ".a", "a.")] == [True, False, False, False]
    assert [value(spark, X.head_symbol(F.col("q")), q=q) for q in ("f x", "@0", "(x)", "g{a}")] == ["f", "@0", None, "g"]
    assert value(spark, X.dependency_tokens(F.col("q")), q="Set A → Bc.d' → Bc.d' → x1 → 9z") == ["Bc.d'", "x1"]
    assert value(spark, X.dependency_tokens(F.col("q")), q="let in where Prop ∀ forall do") == ["do", "in", "let", "where"]


def test_retrieval_tokens(spark):
    tokens = lambda t: value(spark, X.retrieval_tokens(F.col("t")), t=t)
    assert tokens("_≡_ a -> B => [x.y] 12 ∧∨ +") == ["_≡_", "a", "->", "b", "=>", "x", "y", "12", "∧∨"]
    assert tokens("_a_b_ _(x)_ __ Foo'") == ["_a_b_", "_(x)_", "foo'"]


def test_goals_and_places(spark):
    goal = lambda t: value(spark, X.plain_goal(F.col("t")), t=t)
    assert goal("x Data.Bool.∧  y") == "x ∧ y" and goal("foo.bar not (A.b'.C)") == "bar ¬ (C)" and goal("ends a.") == "ends a."
    places = lambda t: [tuple(p) for p in value(spark, X.unsolved_positions(F.col("t")), t=t)]
    assert places("x:3,5: error") == [] and places("x:3,5: error\nunsolved METAS at the\nfollowing locations:\n a:7.2-9\n b:8,1") == [(7, 2), (8, 1)]


def test_splice_and_application(spark):
    at = lambda line, col: tuple(value(spark, X.splice(F.col("t"), F.col("l"), F.col("c"), F.lit("refl")), t="a\nf = {!!} {!!}\n", l=line, c=col))
    assert at(2, 5) == ("a\nf = refl {!!}\n", None) and at(2, 10) == ("a\nf = {!!} refl\n", None)
    assert at(2, 6)[0] is None and "no {!!}" in at(2, 6)[1] and "out of range" in at(9, 1)[1] and at(2, 0)[0] is None and at(0, 1)[0] is None
    binders = F.from_json(F.lit('[{"hiding":"implicit"},{"hiding":"explicit"},{"hiding":"instance"},{"hiding":"explicit"}]'), "array<struct<hiding: string>>")
    assert value(spark, X.application(F.lit("lem"), binders, F.array(F.lit("a")))) == "lem a {!!}"
    assert value(spark, F.transform(X.remaining_binders(binders, F.lit(1)), lambda b: b["hiding"])) == ["implicit", "instance", "explicit"]


def test_fnv64(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    for s in ("", "a", "f|m|n", "é→😀" * 9):
        assert value(spark, X.fnv1a64(F.col("s")), s=s) == fnv(s)


def test_headers_and_names(spark):
    assert [value(spark, X.module_header(F.col("t"), k), t="x\n module A.b' where open B") for k in X.MODULE_HEADERS] == [None, "A.b'", None]
    assert [value(spark, X.flat_filename(F.col("t")), t=t) for t in ("a/b/C.lagda.md", "a/Index.agda", "index.md", "x.tar.gz", ".hidden")] == ["a.b.C.md", "a.md", "index.md", "x.tar.md", ".hidden.md"]
    assert value(spark, X.doc_slug(F.col("t")), t="Éa  b_c -- (d)!") == "éa-b_c-d" and value(spark, X.doc_slug(F.lit("!"))) == "section"


FILES = {
    "markdown": "{!!}\n``` agda\n{!!}\n```agda\nf = {!!}\n```\n? ?\n```haskell\nx = ?\n```\n",
    "tex": "? \\begin{code}\n-- {!!}\nf = ? \\end{code}\n  \\end{code} ?\n%\\begin{code}\n?\n",
    "org": "?\n#+BEGIN_SRC agda2 \ng = {! {! a !} ? !}\n #+end_src\n?\n",
    "rst": ".. c::\n  ?\ntext::\n\n  f = ?\n\n  g = 'x' ? '?'\nout ?\n",
    "tree": "\\agda{\nf = ?\n } ?\n",
}


@pytest.mark.parametrize(("kind", "places"), [("markdown", [(5, 5)]), ("tex", [(3, 5)]), ("org", [(3, 5)]), ("rst", [(5, 7), (7, 11)]), ("tree", [(2, 5)])])
def test_holes_of_literate_files(kind, places):
    text = FILES[kind]
    assert len(source.mask_prose(text, kind)) == len(text) == len(source.code_only(text, kind))
    assert [(h["line"], h["col"]) for h in source.find_holes(text, kind)] == places


def test_holes_among_other_tokens():
    found = lambda t: [t[h["start"] : h["end"]] for h in source.find_holes(t)]
    assert found('op? _≟?_ x--y ? -- ?\n{- {- ? -} ? -} ? "{!!} \\" ?" (?) {-# ? #-} \'?\' ?') == ["?", "?", "?", "?"]
    assert found("{! a {! b !}") == ["{! a {! b !}"] and found("") == [] and found("{- ?") == [] and found("x' ?") == ["?"] and found("'a'?") == ["?"]
    assert source.code_only("a {- b -} {! c\n!} d") == "a" + " " * 13 + "\n   d"


@given(st.text(alphabet="{!}-#?\"'\\ \nab", max_size=40))
def test_scans_end(text):
    spans = list(source.spans(text))
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:])) and len(source.code_only(text)) == len(text)


def plain_spans(text):
    """Holes, comments and pragmas by a walk over characters that knows no patterns."""
    breaks, out, i, free = " \t\n\r\x0b\x0c(){};.@\"", [], 0, True

    def nested(at, opens, closes):
        depth, k = 1, at + 2
        while k < len(text):
            two = text[k : k + 2]
            if two in (opens, closes):
                depth += 1 if two == opens else -1
                k += 2
                if not depth:
                    return k
            else:
                k += 1
        return len(text)

    while i < len(text):
        two = text[i : i + 2]
        if two == "{!":
            end = nested(i, "{!", "!}")
            out.append(("hole", i, end))
            i, free = end, True
        elif text[i : i + 3] == "{-#":
            end = text.find("#-}", i)
            end = len(text) if end < 0 else end + 3
            out.append(("pragma", i, end))
            i, free = end, True
        elif two == "{-":
            end = nested(i, "{-", "-}")
            out.append(("comment", i, end))
            i, free = end, True
        elif text[i] == '"':
            k = i + 1
            while k < len(text) and text[k] not in '"\n':
                k += 2 if text[k] == "\\" else 1
            i = min(len(text), k + 1)
            free = text[i - 1] in breaks
        elif free and two == "--":
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
            out.append(("comment", i, end))
            i, free = end, False
        elif free and text[i] == "?" and (i + 1 == len(text) or text[i + 1] in breaks):
            out.append(("hole", i, i + 1))
            i, free = i + 1, False
        elif free and text[i] == "'":
            k = i + 1
            while k < len(text) and text[k] not in "'\n":
                k += 2 if text[k] == "\\" else 1
            closed = k < len(text) and text[k] == "'"
            i, free = (k + 1, True) if closed else (i + 1, False)
        else:
            free = text[i] in breaks
            i += 1
    return out


def test_spans_as_a_walk_over_characters():
    r = random.Random(17)
    pieces = ["{!", "!}", "{-", "-}", "{-#", "#-}", "--", "?", "'", '"', "\\", "\n", " ", "a", "(", ")", ".", "{", "}", "!", "-", "x'", "'a'", "'\\''", "é"]
    for _ in range(20_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        assert list(source.spans(text)) == plain_spans(text), text


def test_holes_column(spark):
    d = spark.createDataFrame([("f = ?", "M.agda"), (None, "M.agda"), ("?", "M.lagda")], "t string, p string")
    assert [None if r["h"] is None else [(x["line"], x["col"]) for x in r["h"]] for r in d.select(source.holes(F.col("t"), F.col("p")).alias("h")).collect()] == [[(1, 5)], None, []]


def test_fnv(spark):
    def fnv(s):
        h = 0x811C9DC5
        for b in s.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h & 0x7FFFFFFF

    for s in ("", "a", "f|m|n", "é→😀"):
        assert value(spark, X.fnv1a32(F.col("s")), s=s) == fnv(s)


def test_premises(spark):
    got = value(spark, X.clean_premises(F.array(*map(F.lit, ("<lem>", "F.agda.lem", "b..", "a  c", "M.lem", "F.lem", "b"))), F.lit("F"), F.lit("M"), F.lit("lem")))
    assert got == ["a c", "b"]
    got = value(spark, X.clean_premises(F.array(*map(F.lit, ("F.lem", "a/F.lem", "M.lem"))), F.lit("a/F.agda"), F.lit(None).cast("string"), F.lit("lem")))
    assert got == ["M.lem", "a/F.lem"]


def pairs(spark, text):
    d = spark.createDataFrame([(1, text)], "k int, t string").select("k", blocks.strip_comments(F.col("t")).alias("t"))
    return sorted((r["name"], r["type"], r["proof"]) for r in blocks.declarations(blocks.lines_of(d, "k", "t"), "k").collect())


def test_comments_and_declarations(spark):
    assert pairs(spark, "f : A\n-- x : no\n{- g : no\n-}\nf = one\nf = two\nh : B\nimport z : q") == [("f", "A", "one"), ("h", "B", None)]
    assert pairs(spark, "f : A\nf : B\nf x = one") == [("f", "B", None)]
    assert pairs(spark, "f:A\nf = one\nf : C\n\tf = two = three") == [("f", "A", "one"), ("f", "C", "two = three")]
    assert pairs(spark, "-- {-\nf : A\nwhere : B\n{- a -} g : C\nx = y") == [("f", "A", None)]


def test_goal_report(spark):
    text = "PREQ_BEGIN\nPGOAL: A\nPREQ_END\nPREQ_BEGIN\nPGOAL: B\n  and\nPCTX_BEGIN\nPCTX:1:hidden:y: U : V\nPCTX:0:visible:x: T\n  more\nPCTX_END\nPREQ_END"
    r = value(spark, blocks.goal_and_context(F.col("t"), "P"), t=text)
    assert r["goal"] == "B and" and [tuple(c) for c in r["context"]] == [(0, "visible", "x", "T more"), (1, "hidden", "y", "U : V")]
    r = value(spark, blocks.goal_and_context(F.col("t")), t='REQ_BEGIN {"goal": "G", "context": [{"name": "x", "type": "T"}]} REQ_END')
    assert r["goal"] == "G" and r["context"][0]["name"] == "x"
    assert value(spark, blocks.goal_and_context(F.col("t")), t="none") is None and value(spark, blocks.goal_and_context(F.col("t")), t="REQ_BEGIN\nGOAL: a") is None


def test_diagnostics(spark):
    long = "/a/b:c.agda:1.2: error: [UnequalTerms]\n" + "\n".join(f"l{k}" for k in range(40))
    text = "before\n" + long + "\n\nerror: [UnequalTerms]\n" + "x" * 3000 + "\n\nwarning: -WFoo\n\nwarning: -WFoo"
    got = blocks.diagnostics(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("place").collect()
    assert [(r["severity"], r["code"], r["file"], r["rank"]) for r in got] == [("error", "UnequalTerms", "/a/b:c.agda", 3), ("error", "UnequalTerms", None, 3), ("warning", "Foo", None, 5)]
    assert got[0]["message"].split("\n")[-1] == "… (17 more lines)" and len(got[0]["message"].split("\n")) == 24
    assert len(got[1]["message"]) == 2000 and got[1]["message"].endswith("…") and got[2]["message"] == "Foo"


def test_holes(spark):
    assert value(spark, X.hole_count(F.col("t")), t="a {!!}\nb {!!}") == 2
    assert tuple(value(spark, X.next_hole(F.col("t")), t="ab\nc {!!}")) == (5, 2, 3)


def test_skip_reasons(spark):
    rows = [(True, True, "@0", '{"sort":{"tag":"Set"}}'), (False, True, "x", "{}"), (True, False, None, "{}"), (True, True, "a b", "{}"), (True, True, "a", None), (True, True, "a", '{"sort":{"tag":"Prop"}}')]
    d = spark.createDataFrame(rows, "ok boolean, has boolean, body string, ast string")
    got = [r["v"] for r in d.select(views.skip_reason(F.col("ok"), F.col("has"), F.col("body"), F.col("ast")).alias("v")).collect()]
    assert got == [None, "parse_error", "no_body", "not_simple_body", "output_row:type_ast", "output_row:unsupported_sort"]
