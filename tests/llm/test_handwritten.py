import pytest

from gneiss.llm import handwritten as h

CODE = "public class Total {\n    int sum(int a, int b) {\n        return a + b;\n    }\n    String name() {\n        return label.trim();\n    }\n}\n"

LICENCE = "/*\n" + " * Permission is granted.\n" * 40 + " */\n"

CASES = [
    ("src/A.java", "// Code generated by tool 1.2 from a.idl. DO NOT EDIT.\n" + CODE, "generated"),
    ("src/A.java", "package a;\n@Generated(\"tool:1.2\")\n" + CODE, "generated"),
    ("src/A.java", "﻿/*\n * @generated tool <<ab>>\n */\n" + CODE, "generated"),
    ("src/A.java", CODE + "// end of tool output (a.model, 6 entries)\n", "generated"),
    ("src/A.java", "// Strips @generated marks before the next step.\n" + CODE, None),
    ("src/A.java", "// Rejects inputs that carry a DO NOT EDIT line.\n" + CODE, None),
    ("src/A.java", CODE + "// generated ids are kept in table 4\n", None),
    ("src/A.java", CODE + "// not generated, edit freely: frame 9\n", None),
    ("src/A.java", CODE * 4 + "// Code generated by nothing\n" + CODE * 4, None),
    ("src/A.java", "// Vendored copy of lib 1.2.3; see upstream for history (4).\n" + CODE, "third_party"),
    ("src/A.java", CODE + "// vendor prices, third-party rules 3\n", None),
    ("src/A.java", "// Walks node_modules and third_party to path.\n" + CODE, None),
    ("vendor/lib/a/A.java", CODE, "third_party"),
    ("node_modules/x/lib/a.js", CODE, "third_party"),
    ("src/vendor/Prices.java", CODE, None),
    ("gen/a/b.py", CODE, None),
    ("gen/a/b.py", "".join(f"def get_{c}(self): return self.{c}_{i}\n" for i, c in enumerate("abcdefgh")), "generated"),
    ("a/b_pb2.py", CODE, "generated"),
    ("src/A.java", LICENCE + "// Code generated by protoc-gen-go. DO NOT EDIT.\n" + CODE, "generated"),
    ("src/A.java", "/* Code generated by tool. " + "x" * 600 + " */\n" + CODE, "generated"),
    ("src/a.go", "// Code generated by protoc-gen-go. DO NOT EDIT.\n// source: a.proto\n\npackage a\n" + CODE, "generated"),
    ("src/a.ts", "/* eslint-disable */\n// This file was automatically generated by json-schema-to-typescript.\n" + CODE, "generated"),
    ("src/a.py", "# -*- coding: utf-8 -*-\n# Generated by Django 4.2 on 2024-01-01 10:00\nfrom a import b\n" + CODE, "generated"),
    ("src/a.cs", "// <auto-generated>\n//     This code was generated by a tool.\n// </auto-generated>\n" + CODE, "generated"),
    ("src/a.c", "/* Created by jdoe on 2014-01-01, written by hand */\n" + CODE, None),
    ("src/a.c", "#line 1 \"a.y\"\n" + CODE + "#line 9 \"a.y\"\n" + CODE, "generated"),
    ("src/colors.ts", "".join(f"export const COLOR_{i}_NAME = 'shade {i}';\n" for i in range(12)), None),
    ("src/P.java", "class P {\n" + "".join(f"    public int getField{i}() {{\n        return field{i};\n    }}\n" for i in range(12)) + "}\n", None),
    ("tests/test_a.py", "def test_a():\n" + "".join(f"    assert f({i}) == {i * i}\n" for i in range(12)), None),
    ("app/deps/resolve.py", CODE, None),
    ("extern/ownlib/a.c", CODE, None),
    ("extern/lib/a.c", CODE, None),
    ("extern/mylib-1.2.3/a.c", CODE, "third_party"),
    ("extern/mylib/a.c", "/* mylib 1.2.3 */\n" + CODE, "third_party"),
    ("extern/orglib/A.java", "package org.orglib.io;\n" + CODE, "third_party"),
    ("src/main/java/acme/deps/resolver/A.java", "package acme.deps.resolver;\n" + CODE, None),
    ("contrib/named/a.ts", CODE, "third_party"),
    ("lib/b.ts", "// Vendored copy of named 3.1.0, see upstream.\n" + CODE, "third_party"),
    ("extern/zlibx/a.c", CODE, "third_party"),
    ("vendor/zlibx/b.c", CODE, "third_party"),
    ("web/package-lock.json", "{}", "generated"),
    ("a/x.min.js", CODE, "minified"),
    ("a/x.js", "var a=b?c.d(1):!2;if(a&&b>4)c(\"x\",5);" * 30, "minified"),
    ("a/x.js", "const t = [\n" + "".join(f"  [{i}.5, -{i}.25, {i}],\n" for i in range(30)) + "];\n", "data"),
    ("a/x.py", "blob = \"\"\"\n" + "\n".join("QUJD" * 19 for _ in range(9)) + "\n\"\"\"\n", "data"),
    ("a/X.java", "class X {\n" + "".join(f"    public static final int K_{i} = {i * 7};\n" for i in range(20)) + "}\n", None),
    ("a/X.java", "class X {\n  int[] t = [\n" + "    1, 2, 3, 4,\n" * 5 + "  ];\n" + "".join(f"    case {i}: goto state_{i * 3}; /* rule {i} */\n" for i in range(8)) + "}\n", "generated"),
    ("a/X.java", CODE + "int[] t = [\n" + "    1, 2, 3, 4,\n" * 4 + "];\n" + CODE, None),
    ("a/X.java", CODE, None),
    (None, None, None),
    ("", "", None),
    ("third_party/x/A.java", None, "third_party"),
]


@pytest.mark.parametrize("path, text, kind", CASES)
def test_cases(path, text, kind):
    assert h.classify(path, text, "java", frozenset({"zlibx", "named"})) == kind


def test_operator(spark):
    rows = [(i, p, t, None, "x", "y") for i, (p, t, _) in enumerate(CASES)] + [(None, "vendor/a/b.js", CODE, None, "x", "y"), (900, "a.js", "x" * 3_000_000, "js", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, relative_path string, content string, language string, kind string, text string")
    got = {r.doc_id: r.kind for r in h.not_handwritten(df).collect()}
    assert {k: v for k, v in got.items() if k < 900} == {i: k for i, (_, _, k) in enumerate(CASES) if k}
    assert None not in got
    assert h.not_handwritten(df.union(df)).count() == len(got)
    assert h.not_handwritten(df.limit(0)).count() == 0
