"""One-row files of many items: no rule may recurse per item."""

import pytest

from whereabouts.plans.extraction import extract

N = 20_000
ROWS = {
    "Python": ", ".join(f"a.b{i}" for i in range(N)) + " = f()",
    "JavaScript": "this" + "".join(f".a{i}" for i in range(N)) + " = 1",
    "C": "int " + "* " * N + "p;",
    "C++": "x" + "".join(f"->a{i}" for i in range(N)) + " = 1;",
    "Go": ", ".join(f"a{i}" for i in range(N)) + " = f()",
    "Rust": "use " + "::".join(f"a{i}" for i in range(N)) + ";",
    "Lua": "local " + ", ".join(f"a{i}" for i in range(N)),
    "Shell": "export " + " -x" * N + " a=1",
    "YAML": "]" * N + "\nk: '" + "x" * N + "'",
    "CSS": "}" * N,
    "Cython": "cdef int " + ", ".join(f"a{i}" for i in range(N)),
    "TypeScript": "type A = " + " | ".join(f"a{i}" for i in range(N)) + ";",
    "TSX": "<A " + " ".join(f'a{i}="x"' for i in range(N)) + " />;",
    "GLSL": "float " + ", ".join(f"a{i}" for i in range(N)) + ";",
    "Markdown": "# " + "#" * N + " a" + " *" * N,
    "HTML": "<p" + "".join(f" data-a{i}=x" for i in range(N)) + ' id="a0">',
    "TeX": "{" * N + "\\label{a0}" + "}" * N,
}
# Some names that each row defines; none where there are none.
HELD = {
    "Python": {ROWS["Python"][: -len(" = f()")]}, "JavaScript": {f"a{N - 1}"}, "C": {"p"}, "C++": {f"a{N - 1}"}, "Go": {ROWS["Go"][: -len(" = f()")]}, "Rust": set(), "Lua": {"a0", f"a{N - 1}"}, "Shell": {"a"}, "YAML": {"k"}, "CSS": set(),
    "Cython": {"a0", f"a{N - 1}"}, "TypeScript": {"A"}, "TSX": {"a0", f"a{N - 1}"}, "GLSL": {"a0", f"a{N - 1}"}, "Markdown": set(), "HTML": {"a0"}, "TeX": {"a0"},
}


@pytest.mark.parametrize("language", ROWS)
def test_long_row(spark, language):
    files = spark.createDataFrame([("f", language, ROWS[language])], "file_id string, language string, content string")
    names = {n for r in extract(files, (language,)).collect() for n in r.names}
    assert HELD[language] <= names if HELD[language] else not names & {"a", "b", "p"}
