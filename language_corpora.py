"""One corpus per language, derived from ``orders``, and the rows that each name in it must show.

Every order is one block of code; 64 keys share a file. ``{k}`` stands for the order's key, ``{p}`` and ``{s}`` for its
priority and status, ``|`` for a row end and ``~`` for a backslash. Expected rows are counted from 1 within the block,
ends included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whereabouts.operators import lookup as Q
from whereabouts.operators.ranges import union_ranges
from whereabouts.plans.extraction import extract

Rows = dict[str, list[tuple[int, int]]]

TYPED = (
    'import { read as pull_{k} } from "fs";|import {|  write as push_{k},|} from "fs";|namespace Geo_{k} {|  export type Pair_{k} = [number, number];|}|'
    'abstract class Base_{k} {|  abstract area_{k}(): number;|}|interface Opts_{k} {|  "depth_{k}"?: number;|  run_{k}(): void;|}|enum Level_{k} {|  Low_{k} = 1,|  High_{k},|}'
)
TYPED_ROWS: Rows = {
    "pull_{k}": [(1, 1)], "push_{k}": [(3, 3)], "Geo_{k}": [(5, 7)], "Pair_{k}": [(6, 6)], "Base_{k}": [(8, 10)], "area_{k}": [(9, 9)], "Opts_{k}": [(11, 14)],
    "depth_{k}": [(11, 12)], "run_{k}": [(11, 11), (13, 13)], "Level_{k}": [(15, 18)], "Low_{k}": [(15, 16)], "High_{k}": [(15, 15), (17, 17)],
}
WIDE_PYTHON = (
    "import csv as table_{k}|from math import (|    pi as pie_{k},|)|type Pair_{k} = tuple[int, int]|words_{k}: list[str]|first_{k} = second_{k} = 0|"
    'setattr(words, "state_{k}", None)|words.__setitem__("slot_{k}", 1)|for row_{k} in rows:|    pass|rates_{k} = {|    "low_{k}": 1,|}|flat_{k} = {"mid_{k}": 2}|'
    "twice_{k} = lambda side_{k}: side_{k} * 2|cells_{k} = [cell_{k} for cell_{k} in rows]|with open(path) as stream_{k}:|    pass|with (|    open(path) as other_{k},|):|"
    "    pass|def reset_{k}(by_{k}):|    global total_{k}|    total_{k} = 0|"
    "def spread_{k}(|    upto_{k},|):|    pass"
)
WIDE_PYTHON_ROWS: Rows = {
    "table_{k}": [(1, 1)], "pie_{k}": [(2, 4)], "Pair_{k}": [(5, 5)], "words_{k}": [(6, 6)], "first_{k}": [(7, 7)], "second_{k}": [(7, 7)], "state_{k}": [(8, 8)], "slot_{k}": [(9, 9)],
    "row_{k}": [(10, 10)], "rates_{k}": [(12, 14)], "low_{k}": [(12, 13)], "flat_{k}": [(15, 15)], "mid_{k}": [(15, 15)], "twice_{k}": [(16, 16)], "side_{k}": [(16, 16)],
    "cells_{k}": [(17, 17)], "cell_{k}": [(17, 17)], "stream_{k}": [(18, 18)], "other_{k}": [(20, 22)], "reset_{k}": [(24, 26)], "total_{k}": [(24, 26)],
    "by_{k}": [(24, 24)], "spread_{k}": [(27, 30)], "upto_{k}": [(27, 29)],
}
SCRIPT = (
    "class Cart_{k} {|  limit_{k} = 5;|  add_{k}(|    item|  ) {|    return item;|  }|  size_{k}(unit_{k}) {|    return 1;|  }|}|function long_{k}(|  deep_{k},|) {|}|"
    "const [left_{k}, right_{k}] = pair;|let one_{k} = 1, two_{k} = 2;|window.title_{k} = function open_{k}(event_{k}) {|  close();|};|const modes_{k} = {|  plain_{k}: 1,|"
    '  "quoted_{k}": 2,|};|call({ inline_{k}: 3 });|const by_{k} = (n_{k}) => n_{k};|const { theme_{k} } = prefs;'
)
SCRIPT_ROWS: Rows = {
    "Cart_{k}": [(1, 11)], "limit_{k}": [(1, 2)], "add_{k}": [(1, 1), (3, 7)], "size_{k}": [(1, 1), (8, 10)], "unit_{k}": [(1, 1), (8, 8)], "long_{k}": [(12, 15)], "deep_{k}": [(12, 14)],
    "left_{k}": [(16, 16)], "right_{k}": [(16, 16)], "one_{k}": [(17, 17)], "two_{k}": [(17, 17)], "window.title_{k}": [(18, 20)], "title_{k}": [(18, 20)], "open_{k}": [(18, 20)], "event_{k}": [(18, 18)],
    "modes_{k}": [(21, 24)], "plain_{k}": [(21, 22)], "quoted_{k}": [(21, 21), (23, 23)], "inline_{k}": [(25, 25)], "by_{k}": [(26, 26)], "n_{k}": [(26, 26)], "theme_{k}": [(27, 27)],
}
DECLARED = (
    "typedef int (*visit_{k})(void *, int);|typedef struct {|  int size_{k};|} box_{k};|int walk_{k}(int (*each_{k})(int), int from_{k})|{|  int one_{k} = 1, two_{k};|"
    "  two_{k} = one_{k};|  return two_{k};|}|long spread_{k}(|  long base_{k}|);|typedef unsigned char byte_{k};|#define TWICE_{k}(n) ((n) + (n))|struct ring_{k} {|  int head_{k};|};"
)
DECLARED_ROWS: Rows = {
    "visit_{k}": [(1, 1)], "box_{k}": [(2, 4)], "size_{k}": [(2, 3)], "walk_{k}": [(5, 10)], "each_{k}": [(5, 5)], "from_{k}": [(5, 5)], "one_{k}": [(5, 5), (7, 7)], "two_{k}": [(5, 5), (7, 8)],
    "spread_{k}": [(11, 13)], "base_{k}": [(11, 13)], "byte_{k}": [(14, 14)], "TWICE_{k}": [(15, 15)], "ring_{k}": [(16, 18)], "head_{k}": [(16, 17)],
}

# query -> (language, block, {name: rows})
BLOCKS: dict[str, tuple[str, str, Rows]] = {
    "rows_python": (
        "Python",
        "# {p}|@wrap(|    1,|)|def run_{k}(|    by_{k},|    upto_{k}=(1,|              2),|):|    total_{k} = (by_{k} +|"
        "                 upto_{k})|    return total_{k}  # {s}",
        {"run_{k}": [(1, 12)], "by_{k}": [(5, 9)], "upto_{k}": [(5, 9)], "total_{k}": [(5, 11)]},
    ),
    "rows_cython": (
        "Cython",
        "DEF SIZE_{k} = 4|ctypedef double real_{k}|# {p}|cpdef real mix_{k}(real left_{k}, int at_{k}):|    cdef real out_{k}, rest_{k}|"
        "    for step_{k} from 0 <= step_{k} < at_{k}:|        out_{k} = left_{k}|    return out_{k}|cdef struct Pixel_{k}:|    int red_{k}|"
        "    unsigned char alpha_{k}|cdef class Canvas_{k}:|    property width_{k}:|        def __get__(self):|            return 1",
        {
            "SIZE_{k}": [(1, 1)], "real_{k}": [(2, 2)], "mix_{k}": [(3, 8)], "left_{k}": [(3, 4)], "at_{k}": [(3, 4)], "out_{k}": [(4, 7)],
            "rest_{k}": [(4, 5)], "step_{k}": [(4, 4), (6, 6)], "Pixel_{k}": [(9, 11)], "red_{k}": [(9, 10)], "alpha_{k}": [(9, 9), (11, 11)],
            "Canvas_{k}": [(12, 15)], "width_{k}": [(12, 15)],
        },
    ),
    "rows_javascript": (
        "JavaScript",
        '// order {p}|async function load_{k}(url_{k}, tries_{k} = 2) {|  var seen_{k} = "{s}; }";|  return fetch(url_{k});|}|'
        "class Basket_{k} {|  // {p}|  total_{k}(rate_{k}) {|    return this.lines;|  }|}|const { theme_{k}, size: font_{k} } = prefs;",
        {
            "load_{k}": [(1, 5)], "url_{k}": [(1, 2)], "tries_{k}": [(1, 2)], "seen_{k}": [(2, 3)], "Basket_{k}": [(6, 11)],
            "total_{k}": [(6, 10)], "rate_{k}": [(6, 8)], "theme_{k}": [(12, 12)], "font_{k}": [(12, 12)],
        },
    ),
    "rows_typescript": ("TypeScript", TYPED, TYPED_ROWS),
    "rows_tsx": (
        "TSX",
        '// {p}|export function Panel_{k}(props_{k}: Props) {|  const [open_{k}, setOpen_{k}] = useState(false);|  return (|'
        '    <div className="{s}">{open_{k}}</div>|  );|}|interface Shape_{k} {|  width_{k}: number;|}',
        {
            "Panel_{k}": [(1, 7)], "props_{k}": [(1, 2)], "open_{k}": [(2, 3)], "setOpen_{k}": [(2, 3)], "Shape_{k}": [(8, 10)],
            "width_{k}": [(8, 9)],
        },
    ),
    "rows_c": (
        "C",
        "/* {p} */|struct ring_{k} {|    int head_{k}, tail_{k};|};|// {s}|int push_{k}(struct ring *target_{k},|             int value_{k})|{|"
        "    int next_{k};|    next_{k} = value_{k} + 1;|    return next_{k};|}|#define TWICE_{k}(n) ((n) + (n))|typedef unsigned short port_{k};",
        {
            "ring_{k}": [(1, 4)], "head_{k}": [(2, 3)], "tail_{k}": [(2, 3)], "push_{k}": [(5, 12)], "target_{k}": [(5, 7)],
            "value_{k}": [(6, 7)], "next_{k}": [(6, 7), (9, 10)], "TWICE_{k}": [(13, 13)], "port_{k}": [(14, 14)],
        },
    ),
    "rows_glsl": (
        "GLSL",
        "uniform vec3 light_{k};|// {p}|vec4 shade_{k}(float gain_{k})|{|  float power_{k} = gain_{k};|  return vec4(power_{k});|}|"
        "struct Ray_{k} {|  vec3 origin_{k};|};",
        {
            "light_{k}": [(1, 1)], "shade_{k}": [(2, 7)], "gain_{k}": [(2, 3)], "power_{k}": [(3, 3), (5, 5)], "Ray_{k}": [(8, 10)],
            "origin_{k}": [(8, 9)],
        },
    ),
    "rows_cpp": (
        "C++",
        "namespace geo_{k} {|// {p}|template <typename T_{k}>|class Box_{k} {|public:|  int width_{k};|  int area_{k}(int by_{k}) {|"
        "    return by_{k};|  }|};|}",
        {
            "geo_{k}": [(1, 11)], "T_{k}": [(1, 3)], "Box_{k}": [(1, 10)], "width_{k}": [(1, 1), (4, 4), (6, 6)],
            "area_{k}": [(1, 1), (4, 4), (7, 9)], "by_{k}": [(1, 1), (4, 4), (7, 7)],
        },
    ),
    "rows_go": (
        "Go",
        "// {p}|type Point_{k} struct {|  X_{k}, Y_{k} int|}|func (p Point_{k}) Norm_{k}(scale_{k} int) int {|  var t_{k} int|"
        "  t_{k} = p.X * scale_{k}|  return t_{k}|}",
        {
            "Point_{k}": [(1, 4)], "X_{k}": [(2, 3)], "Y_{k}": [(2, 3)], "Norm_{k}": [(5, 9)], "scale_{k}": [(5, 5)], "t_{k}": [(5, 5), (7, 7)],
        },
    ),
    "rows_rust": (
        "Rust",
        "// {p}|#[derive(Debug)]|pub struct Timer_{k} {|    pub label_{k}: u32,|}|impl Timer_{k} {|    pub fn start_{k}(by_{k}: u32) -> u32 {|"
        "        let rest_{k} = by_{k};|        rest_{k}|    }|}|static COUNT_{k}: u32 = 0;",
        {
            "Timer_{k}": [(1, 11)], "label_{k}": [(3, 4)], "start_{k}": [(6, 10)], "rest_{k}": [(6, 8)],
            "COUNT_{k}": [(12, 12)],
        },
    ),
    "rows_lua": (
        "Lua",
        "-- {p}|function Mod.run_{k}(a_{k}, b_{k})|  local base_{k} = 1|  if a_{k} then|    base_{k} = 2|  end|  return { key_{k} = a_{k} }|end",
        {
            "Mod.run_{k}": [(2, 8)], "a_{k}": [(2, 2)], "b_{k}": [(2, 2)], "base_{k}": [(2, 3), (5, 5)], "key_{k}": [(2, 2), (7, 7)],
        },
    ),
    "rows_shell": (
        "Shell",
        '# {p}|greet_{k}() {|  local who_{k}=$1|  if [ -n "$who" ]; then|    echo "{s} }"|  fi|}|export COLOR_{k}=red|for item_{k} in a b; do|'
        '  echo "$item"|done',
        {"greet_{k}": [(2, 7)], "who_{k}": [(2, 3)], "COLOR_{k}": [(8, 8)], "item_{k}": [(9, 9)]},
    ),
    "rows_css": (
        "CSS",
        "/* {p} */|.card_{k},|.card > .title_{k} {|  color: #9cf;|}|#main_{k} { margin: 0 }",
        {"card_{k}": [(2, 5)], "title_{k}": [(2, 5)], "main_{k}": [(6, 6)]},
    ),
    "rows_tex": (
        "TeX",
        "~chapter{Part_{k}}~label{part_{k}}|~newcommand{~shout}[1]{#1!}|~renewcommand{~quiet}{.}|~newenvironment{aside_{k}}{}{}|~newtheorem{law_{k}}{Law}|"
        "~newacronym{acr_{k}}{A}{B}|~paragraph{Note_{k}} text {p}|~begin{figure}|  ~includegraphics{x}|  ~label{fig_{k}}|~end{figure}",
        {
            "Part_{k}": [(1, 11)], "part_{k}": [(1, 11)], "shout": [(1, 2)], "quiet": [(1, 1), (3, 3)], "aside_{k}": [(1, 1), (4, 4)], "law_{k}": [(1, 1), (5, 5)],
            "acr_{k}": [(1, 1), (6, 6)], "Note_{k}": [(1, 1), (7, 11)], "fig_{k}": [(1, 1), (7, 11)],
        },
    ),
    # what the blocks above leave out, so that every rule of every language finds something
    "more_python": ("Python", WIDE_PYTHON, WIDE_PYTHON_ROWS),
    "more_cython": ("Cython", WIDE_PYTHON, WIDE_PYTHON_ROWS),
    "more_javascript": ("JavaScript", SCRIPT, SCRIPT_ROWS),
    "more_typescript": ("TypeScript", SCRIPT, SCRIPT_ROWS),
    "more_tsx": ("TSX", SCRIPT, SCRIPT_ROWS),
    "typed_tsx": (
        "TSX",
        TYPED + '|const page_{k} = <Page wide_{k}={1} mark_{k}="{s}" />;',
        TYPED_ROWS | {"page_{k}": [(19, 19)], "wide_{k}": [(19, 19)], "mark_{k}": [(19, 19)]},
    ),
    "more_c": ("C", DECLARED, DECLARED_ROWS),
    "more_glsl": ("GLSL", DECLARED, DECLARED_ROWS),
    "declared_cpp": ("C++", DECLARED, DECLARED_ROWS),
    "more_cpp": (
        "C++",
        "namespace geo_{k} {|template <class T_{k}>|class Ring_{k} {|  Ring_{k}(int n) : size_{k}(n) {|    this->top_{k} = n;|  }|};|}",
        {
            "geo_{k}": [(1, 8)], "T_{k}": [(1, 2)], "Ring_{k}": [(1, 7)], "size_{k}": [(1, 1), (3, 4)], "this->top_{k}": [(1, 1), (3, 5)], "top_{k}": [(1, 1), (3, 5)],
        },
    ),
    "more_go": (
        "Go",
        "type (|  Ids_{k} []int|)|func Run_{k}(|  src_{k} string,|) {|  dst_{k} = src_{k}|}",
        {"Ids_{k}": [(2, 2)], "Run_{k}": [(4, 8)], "src_{k}": [(4, 6)], "dst_{k}": [(4, 7)]},
    ),
    "more_rust": (
        "Rust",
        "use std::fmt as form_{k};|use std::{|    io as inout_{k},|};|macro_rules! twice_{k} {|    ($x:expr) => { $x };|}|enum Phase_{k} {|    Idle_{k},|"
        "    Busy_{k}(u32),|}|struct Tick_{k} { left_{k}: u32 }|impl Clone for Tick_{k} {|    fn make_{k}() -> u32 {|        let more_{k} = Wide {|"
        "            depth_{k},|        };|        1|    }|}",
        {
            "form_{k}": [(1, 1)], "inout_{k}": [(3, 3)], "twice_{k}": [(5, 7)], "Phase_{k}": [(8, 11)], "Idle_{k}": [(8, 9)], "Busy_{k}": [(8, 8), (10, 10)],
            "Tick_{k}": [(12, 20)], "left_{k}": [(12, 12)], "make_{k}": [(13, 19)], "more_{k}": [(13, 17)], "depth_{k}": [(13, 16)],
        },
    ),
    "more_lua": (
        "Lua",
        'local seen_{k}, left_{k}|for at_{k} = 1, 3 do|  ::again_{k}::|  say("the end of {s}")|end|local opts_{k} = {|  wide_{k} = 1,|}',
        {"seen_{k}": [(1, 1)], "left_{k}": [(1, 1)], "at_{k}": [(2, 2)], "again_{k}": [(2, 3)], "opts_{k}": [(6, 8)], "wide_{k}": [(6, 7)]},
    ),
    "more_shell": ("Shell", "readonly one_{k} two_{k}|echo 'done if {s}'", {"one_{k}": [(1, 1)], "two_{k}": [(1, 1)]}),
    "more_markdown": ("Markdown", "# Part_{k}||Under_{k}|-----||text {p}", {"Part_{k}": [(1, 6)], "Under_{k}": [(1, 6)]}),
    "more_yaml": (
        "YAML",
        'base_{k}: &shared_{k}|  host_{k}: a|flow_{k}: {|  inner_{k}: 1,|  "odd_{k}": {low_{k}: 2}}',
        {
            "base_{k}": [(1, 2)], "shared_{k}": [(1, 1)], "host_{k}": [(2, 2)], "flow_{k}": [(3, 5)], "inner_{k}": [(4, 4)], "odd_{k}": [(5, 5)], "low_{k}": [(5, 5)],
        },
    ),
    "more_html": (
        "HTML",
        '<div id="box_{k}">|<ul name="stops_{k}">|<li>{p}</li>|</ul>|<h3>Head_{k}</h3>|</div>',
        {"box_{k}": [(1, 6)], "stops_{k}": [(1, 4)], "Head_{k}": [(1, 1), (5, 5)]},
    ),
}


def corpus(spark: SparkSession, sf_dir: str, language: str, block: str) -> DataFrame:
    marks = {"{k}": "o_orderkey", "{p}": "o_orderpriority", "{s}": "o_orderstatus"}

    def code(x: Column) -> Column:
        text = F.lit(block.replace("|", "\n").replace("~", "\\"))
        for mark, column in marks.items():
            text = F.replace(text, F.lit(mark), x[column].cast("string"))
        return text

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    parts = orders.select(F.floor(F.col("o_orderkey") / 64).cast("string").alias("file_id"), F.struct(*marks.values()).alias("part"))
    # rows are shuffled as they are, and become code where they have come together; being small, they would be coalesced to a few tasks
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_id")
    coded = F.transform(F.collect_list("part"), lambda x: F.struct(x["o_orderkey"], code(x).alias("code")))
    joined = F.array_join(F.transform(F.array_sort(coded), lambda x: x["code"]), "\n")
    return parts.groupBy("file_id").agg(joined.alias("content")).withColumn("language", F.lit(language))


def files(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return corpus(spark, sf_dir, *BLOCKS[query][:2])


def shown(found: DataFrame, *others: str) -> DataFrame:
    """Merged rows shown for every name that carries an order's key, and some others."""
    named = Q.named(found).where(F.col("name").rlike("_[0-9]+$") | F.col("name").isin(*others))
    flat = named.select("file_id", "name", F.explode("ranges").alias("r")).select("file_id", "name", "r.*")
    rows = union_ranges(flat, ["file_id", "name"], placed=True)
    return rows.select("file_id", "name", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def shown_rows(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return shown(extract(files(spark, sf_dir, query), (BLOCKS[query][0],)), *[n for n in BLOCKS[query][2] if "{k}" not in n])


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown_rows(spark, sf_dir, name)

    run.__name__ = name
    run.__doc__ = f"Rows shown for the names of a {BLOCKS[name][0]} corpus."
    return run


def expected_sql(block: str, expected: Rows) -> str:
    """The expected rows of every order's block, in its place in the file."""
    height = block.count("|") + 1
    rows = ", ".join(f"('{n}', {a}, {b})" for n, ranges in expected.items() for a, b in ranges)
    return f"""
    WITH placed AS (
      SELECT CAST(floor(o_orderkey / 64) AS bigint) AS file, o_orderkey AS k,
        (row_number() OVER (PARTITION BY CAST(floor(o_orderkey / 64) AS bigint) ORDER BY o_orderkey) - 1) * {height} AS base
      FROM orders), expected(name, first, last) AS (VALUES {rows})
    SELECT CAST(file AS varchar) AS file_id, replace(name, '{{k}}', CAST(k AS varchar)) AS name,
      CAST(base + first - 1 AS bigint) AS start_line, CAST(base + last AS bigint) AS end_line
    FROM placed CROSS JOIN expected"""


QUERIES = {name: _query(name) for name in BLOCKS}
ORACLES = {name: expected_sql(*BLOCKS[name][1:]) for name in BLOCKS}
