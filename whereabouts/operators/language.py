"""Which language a file or a fragment is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sql import literal

# Public names, aliases, extensions, file names and interpreters of the languages
# that have rules, and of others that claim one of their extensions.
# (language, group, aliases, extensions, file names, interpreters)
LANGUAGES: list[tuple[str, str | None, list[str], list[str], list[str], list[str]]] = [
    ("Python", None, ["python3", "rusthon"], ["py", "gyp", "gypi", "lmi", "py3", "pyde", "pyi", "pyp", "pyt", "pyw", "rpy", "wsgi", "xpy"], ["SConstruct", "SConscript", "wscript", "Snakefile"], ["python", "python2", "python3"]),
    ("Cython", "Python", ["pyrex"], ["pyx", "pxd", "pxi"], [], []),
    ("JavaScript", None, ["js", "node"], ["js", "_js", "cjs", "es6", "jsm", "mjs", "jsx", "jss", "njs", "ssjs"], ["Jakefile"], ["node", "nodejs", "js", "qjs"]),
    ("TypeScript", None, ["ts"], ["ts", "cts", "mts"], [], ["deno", "ts-node"]),
    ("TSX", "TypeScript", [], ["tsx"], [], []),
    ("C", None, [], ["c", "cats", "h", "idc"], [], ["tcc"]),
    ("C++", None, ["cpp", "cplusplus"], ["cpp", "c++", "cc", "cp", "cxx", "h", "h++", "hh", "hpp", "hxx", "inl", "ipp", "tcc", "tpp"], [], []),
    ("GLSL", "C", [], ["glsl", "fp", "frag", "frg", "fsh", "fshader", "geom", "glslf", "glslv", "gshader", "tesc", "tese", "vert", "vrx", "vsh", "vshader"], [], []),
    ("Go", None, ["golang"], ["go"], [], []),
    ("Rust", None, ["rs"], ["rs", "rs.in"], [], ["rust-script"]),
    ("Lua", None, [], ["lua", "nse", "p8", "pd_lua", "rbxs", "rockspec", "wlua"], [".luacheckrc"], ["lua"]),
    ("Shell", None, ["sh", "shell-script", "bash", "zsh"], ["sh", "bash", "bats", "command", "ksh", "tmux", "tool", "zsh", "zsh-theme"], [".bashrc", ".profile", ".zshrc", "PKGBUILD"], ["ash", "bash", "dash", "ksh", "mksh", "pdksh", "rc", "sh", "zsh"]),
    ("HTML", None, ["xhtml"], ["html", "hta", "htm", "html.hl", "inc", "xht", "xhtml"], [], []),
    ("CSS", None, [], ["css"], [], []),
    ("Markdown", None, ["md", "pandoc"], ["md", "livemd", "markdown", "mdown", "mdwn", "mkd", "mkdn", "mkdown", "ronn", "scd", "workbook"], ["contents.lr"], []),
    ("TeX", None, ["latex"], ["tex", "aux", "bbx", "cbx", "dtx", "ins", "lbx", "ltx", "mkii", "mkiv", "mkvi", "sty", "toc"], [], []),
    ("YAML", None, ["yml"], ["yml", "yaml", "mir", "reek", "rviz", "syntax", "yaml-tmlanguage"], [".clang-format", ".clang-tidy", "CITATION.cff"], []),
    ("Jupyter Notebook", None, ["ipython notebook"], ["ipynb"], ["Notebook"], []),
    ("GCC Machine Description", None, [], ["md"], [], []),
    ("RenderScript", None, [], ["rs", "rsh"], [], []),
    ("XML", None, ["rss", "xsd", "wsdl"], ["xml", "ts", "tsx", "rss"], [], []),
    ("Objective-C", None, ["obj-c", "objc"], ["m", "h"], [], []),
    ("MATLAB", None, ["octave"], ["m"], [], []),
    ("Java", None, [], ["java", "jav", "jsh"], [], []),
    ("Ruby", None, ["rb", "jruby"], ["rb", "rake", "gemspec"], ["Gemfile", "Rakefile"], ["ruby"]),
    ("PHP", None, ["inc"], ["php", "phtml"], [], ["php"]),
    ("C#", None, ["csharp"], ["cs", "csx"], [], []),
    ("Kotlin", None, [], ["kt", "kts"], [], []),
    ("Swift", None, [], ["swift"], [], []),
    ("Scala", None, [], ["scala", "sbt"], [], ["scala"]),
    ("Perl", None, [], ["pl", "pm"], [], ["perl"]),
    ("Sage", "Python", [], ["sage", "sagews"], [], []),
    ("OpenCL", "C", [], ["cl", "opencl"], [], []),
    ("JSON5", "JavaScript", [], ["json5"], [], []),
    ("JSON", None, ["geojson", "jsonl", "topojson"], ["json", "geojson", "jsonl", "topojson", "webmanifest"], [], []),
]

# Short names from older rule files.
LEGACY = {"js": "JavaScript", "ts": "TypeScript", "cplusplus": "C++"}

# Our choice where several languages claim a key.
PREFERRED = {"md": "Markdown", "rs": "Rust", "ts": "TypeScript", "tsx": "TSX", "h": "C", "tcc": "C++"}


GROUPS = {row[0]: row[1] for row in LANGUAGES if row[1]}
SCHEMA = "language string, group_language string, aliases array<string>, extensions array<string>, filenames array<string>, interpreters array<string>"


def languages(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame([*LANGUAGES, *extra], SCHEMA)


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """A public list of languages as rows of JSON, in place of the rows above, or beside them."""
    return spark.read.schema(SCHEMA).json(path)


def aliases(table: DataFrame) -> DataFrame:
    """Alias and extension keys; keys that several languages claim are marked, never guessed."""
    keys = table.select(
        "language", "group_language", F.explode(F.array_union("aliases", "extensions")).alias("key")
    ).select("language", "group_language", F.lower("key").alias("alias")).distinct()
    owned = keys.withColumn("owners", F.count("*").over(Window.partitionBy("alias")))
    preferred = F.lit(False)
    for key, language in PREFERRED.items():
        preferred = preferred | ((F.col("alias") == key) & (F.col("language") == language))
    own = table.select("language", "group_language", F.lower("language").alias("alias"), F.lit(1).alias("owners"))
    every = owned.select("language", "group_language", "alias", F.col("owners").cast("int").alias("owners")).unionByName(own)
    return every.distinct().withColumn("preferred", (F.col("owners") == 1) | preferred)


def _keys(column: int, claimed: bool) -> dict[str, str]:
    """Key -> language, from the rows above; ``claimed`` also lets the preferred owner win."""
    owners: dict[str, list[str]] = {}
    for row in LANGUAGES:
        for key in row[column]:
            owners.setdefault(key.lower(), []).append(row[0])
    found = {k: v[0] for k, v in owners.items() if len(v) == 1}
    if claimed:
        found.update({k: PREFERRED[k] for k, v in owners.items() if len(v) > 1 and k in PREFERRED})
    return found


def _from_map(table: dict[str, str], key: Column) -> Column:
    pairs = ", ".join(literal(x) for pair in sorted(table.items()) for x in pair)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of_path(path: Column) -> Column:
    """Language from the file name, then from the extension; NULL when neither is known."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.coalesce(_from_map(_keys(4, True), F.lower(name)), _from_map(_keys(3, True), extension(path)))


def interpreter(content: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(content, r"^#!\s*(?:\S*/)?(?:env\s+(?:-\S++\s++)*+)?([\w.+-]+)", 1), r"[0-9.]+\z", "")


def language_of_shebang(content: Column) -> Column:
    return _from_map(_keys(5, True), F.lower(interpreter(content)))


def canonical(hint: Column) -> Column:
    """A hint as a language name: by alias in any case, or when it is the name itself."""
    table = {**_keys(2, True), **_keys(3, True), **LEGACY, **{row[0].lower(): row[0] for row in LANGUAGES}}
    return _from_map(table, F.lower(hint))


def hinted_language(hint: Column, content: Column) -> Column:
    return F.coalesce(F.when(hint.isNotNull(), canonical(hint)), language_of_shebang(content))


def narrow(old: Column, new: Column) -> Column:
    """Candidates after one more test: the new ones if there were none, else what both hold,
    else the old ones. The order is that of ``new``."""
    both = F.array_intersect(new, old)
    return F.when(F.size(old) == 0, new).when(F.size(both) == 0, old).otherwise(both)
