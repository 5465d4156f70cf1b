"""Own small sources, one per language, with the rows that each name must show.

Rows are counted from 1, ends included; touching ranges are merged.
"""

PYTHON = '''\
import math as angles

LEVELS = {"low": 1, "high": 9}


async def fetch(source, *, limit: int = 3):
    # open first
    async with source.open() as stream:
        data, size = await stream.read()
    return data


class Sensor:
    """Reads values."""
    unit = "C"

    @staticmethod
    def convert(value, scale=(
        1, 2,
    )):
        square = lambda side: side * side
        return [cell for cell in value]

    # back to nothing
    def reset(self):
        global total
        total = 0
        setattr(self, "state", None)


for index, item in enumerate(
    LEVELS
):
    first = second = item

try:
    pass
except OSError as problem:
    pass
type Pair = tuple[int, int]
words: list[str]
'''

JAVASCRIPT = '''\
// routes by name
const routes = new Map();
let { theme, size: fontSize } = preferences;

async function load(url, retries = 2) {
  var attempt = 0;
  return fetch(url);
}

export class Basket {
  #lines = [];
  static limit = 20;

  // what it costs
  async total(currency) {
    return this.lines;
  }
}

const [first, second] = words;
const labels = {
  open: "Open",
  "shut down": "Close",
};
window.onload = function begin(event) {
  load(event);
};
'''

TYPED = '''\
type Unit = "cm" | "in";

/* what a ruler can do */
interface Ruler<T extends Unit> {
  readonly marks: number[];
  "read out"(at: number): string;
}

const enum Edge {
  Near,
  Far = 7,
}

function measure(
  from: Ruler<Unit>,
): Edge {
  const gap = Edge.Far;
  return gap;
}

export const Label = ({ text, colour: ink }: Props) => (
  <span title={text} data-ink="dark">
    {text}
  </span>
);
'''

C = '''\
/* a ring of samples */
#include <stdint.h>
#define RING_NEXT(n) ((n) + 1)

typedef int (*compare_fn)(const void *, const void *);

struct ring {
    uint8_t data[32];
    int head, tail;
};

static int depth = 0, width;

// adds one sample
int ring_push(struct ring *target, uint8_t value)
{
    int next;
    next = RING_NEXT(target->head);
    depth += value;
    return next;
}

typedef unsigned short port_t;
'''

GLSL = '''\
uniform vec3 light;
struct Ray {
  vec3 origin;
};
// brightness
vec4 shade(Ray ray, float gain)
{
  float power = gain;
  return vec4(power);
}
'''

CPP = '''\
namespace geo {
// a box
template <typename T>
class Box {
public:
  Box(T w) : width(w) {}
  T width;
};
}

int geo::count(int n)
{
  return n;
}
'''

RUST = '''\
mod clock {
    pub const TICKS: u64 = 60;
}

// keeps time
#[derive(Debug)]
pub struct Timer<'a> {
    pub label: &'a str,
    left: u64,
}

impl<'a> Timer<'a> {
    pub fn start(label: &'a str) -> Self {
        let mut rest = clock::TICKS;
        Timer { label, left: rest }
    }
}

macro_rules! tick {
    ($t:expr) => { $t.left };
}

static mut COUNT: u32 = 0;
type Seconds = u64;
enum Phase {
    Idle,
    Running(Seconds),
}
'''

CYTHON = '''\
from libc.math cimport sqrt as root

ctypedef fused number:
    int
    double

cdef enum Shade:
    DARK

# distance from the middle
cpdef double reach(number across, number down=0) except -1:
    cdef double square = across * across
    return root(square + down)

cdef class Lens:
    cdef public object frame

    def __init__(self, frame):
        self.frame = frame

    property curve:
        # never flat
        def __get__(self):
            bend = 2
            return bend
'''

GO = '''\
package main

// Point is a place.
type Point struct {
	X, Y int
}

func (p Point) Norm(scale int) int {
	var t int
	t = p.X * scale
	return t
}

func main() {
}
'''

LUA = '''\
local base = 1
function Mod.run(a, b)
  if a then
    base = 2
  end
  return { key = a }
end
for i = 1, 3 do
  print(i)
end
'''

SHELL = '''\
#!/bin/bash
greet() {
  local who=$1
  if [ -n "$who" ]; then
    echo "hi"
  fi
}
export COLOR=red
for item in a b; do
  echo "$item"
done
'''

CSS = '''\
.card,
.card > .title {
  color: #9cf;
}
#main { margin: 0 }
'''

MARKDOWN = '''\
Preface without a heading.

# Garden ##

## Beds

- peas

```yaml
soil:
  depth: 3
```

### Herbs

| mint | thyme |

Paths
=====

## Tools #

    # not a heading, but code

<!-- # nor this -->

````md
# Inner

```lua
local spade = 1
```
````

# Pond
'''

HTML = '''\
<html>
<body>
<h2>Opening
hours</h2>
<div
  id="map">
  <ul name="stops">
    <li>One</li>
  </ul>
</div>
<script>
var zoom = 3;
function zoomIn(step) {
  zoom += step;
}
</script>
<style>
#map,
.omap { border: 0 }
.hint {
  margin: 2px;
}
</style>
</body>
</html>
'''

TEX = '''\
\\documentclass{book}
\\DeclareMathOperator{\\rank}{rk}
\\def\\half{1/2}
\\newacronym[type=x]{pde}{PDE}{equation}
\\begin{document}

\\chapter{Heat} \\label{ch:heat}
% warm
\\section*{Rods}
\\begin{figure}
  \\begin{center} A \\end{center}
  \\caption{B}\\label{fig:rod}
\\end{figure}
\\paragraph{Ends} cold
\\begin{equation}\\label{eq:one}
  x = 50\\% y
\\end{equation}

\\chapter[Short]{Waves}
\\begin{verbatim}
\\section{None}
\\end{verbatim}
\\end{document}
'''

YAML = '''\
base: &shared
  host: a
  ports:
    - one: 1
      two: 2
    - one: 3
"quoted": {inner: 1, 'odd key': 2}
'''

# name -> rows; a name missing here must not be found at all
CASES = {
    "Python": (PYTHON, {
        "angles": [(1, 1)], "LEVELS": [(3, 3)], "low": [(3, 3)], "fetch": [(6, 10)], "source": [(6, 6)], "limit": [(6, 6)],
        "stream": [(6, 8)], "data": [(6, 6), (8, 9)], "size": [(6, 6), (8, 9)], "Sensor": [(13, 28)], "unit": [(13, 13), (15, 15)],
        "convert": [(13, 13), (17, 22)], "value": [(13, 13), (17, 20)], "scale": [(13, 13), (17, 20)], "square": [(13, 13), (18, 21)],
        "side": [(13, 13), (18, 21)], "cell": [(13, 13), (18, 20), (22, 22)], "reset": [(13, 13), (24, 28)], "int": [], "math": [],
        "total": [(13, 13), (25, 27)], "state": [(13, 13), (25, 25), (28, 28)], "index": [(31, 33)], "item": [(31, 33)], "first": [(31, 34)],
        "second": [(31, 34)], "problem": [(38, 38)], "Pair": [(40, 40)], "words": [(41, 41)],
    }),
    "JavaScript": (JAVASCRIPT, {
        "routes": [(1, 2)], "theme": [(3, 3)], "fontSize": [(3, 3)], "size": [], "load": [(5, 8)], "url": [(5, 5)], "retries": [(5, 5)],
        "attempt": [(5, 6)], "Basket": [(10, 18)], "#lines": [(10, 11)], "limit": [(10, 10), (12, 12)], "total": [(10, 10), (14, 17)],
        "currency": [(10, 10), (14, 15)], "first": [(20, 20)], "second": [(20, 20)], "labels": [(21, 24)], "open": [(21, 22)],
        "shut down": [(21, 21), (23, 23)], "onload": [(25, 27)], "begin": [(25, 27)], "event": [(25, 25)],
    }),
    "TypeScript": (JAVASCRIPT, {"Basket": [(10, 18)], "total": [(10, 10), (14, 17)], "labels": [(21, 24)], "begin": [(25, 27)]}),
    "TSX": (TYPED, {
        "Unit": [(1, 1)], "Ruler": [(3, 7)], "marks": [(4, 5)], "read out": [(4, 4), (6, 6)], "Edge": [(9, 12)], "Near": [(9, 10)], "Far": [(9, 9), (11, 11)],
        "measure": [(14, 19)], "from": [(14, 16)], "gap": [(14, 17)], "Label": [(21, 25)], "text": [], "ink": [], "title": [(21, 22)],
        "data-ink": [(21, 22)], "colour": [], "Props": [],
    }),
    "C": (C, {
        "RING_NEXT": [(3, 3)], "compare_fn": [(5, 5)], "ring": [(7, 10)], "data": [(7, 8)], "head": [(7, 7), (9, 9)], "tail": [(7, 7), (9, 9)],
        "width": [(12, 12)], "depth": [(12, 12), (15, 15), (19, 19)], "ring_push": [(14, 21)], "target": [(14, 15)], "value": [(14, 15)],
        "next": [(15, 15), (17, 18)], "port_t": [(23, 23)], "n": [],
    }),
    "GLSL": (GLSL, {
        "light": [(1, 1)], "Ray": [(2, 4)], "origin": [(2, 3)], "shade": [(5, 10)], "ray": [(5, 6)], "gain": [(5, 6)], "power": [(6, 6), (8, 8)],
    }),
    "C++": (CPP, {"geo": [(1, 9)], "Box": [(1, 8)], "width": [(1, 1), (4, 4), (6, 7)], "count": [(11, 14)], "n": [(11, 11)], "T": [(1, 3)]}),
    "Rust": (RUST, {
        "clock": [(1, 3)], "TICKS": [(2, 2)], "Timer": [(5, 10), (12, 17)], "left": [(7, 7), (9, 9), (12, 13), (15, 15)], "start": [(12, 16)],
        "rest": [(12, 14)], "tick": [(19, 21)], "COUNT": [(23, 23)], "Seconds": [(24, 24)], "Phase": [(25, 28)], "Idle": [(25, 26)],
        "Running": [(25, 25), (27, 27)],
    }),
    "Cython": (CYTHON, {
        "root": [(1, 1)], "sqrt": [], "number": [(3, 5)], "Shade": [(7, 8)], "reach": [(10, 13)], "across": [(10, 11)], "down": [(10, 11)],
        "square": [(11, 12)], "Lens": [(15, 25)], "frame": [(15, 16), (18, 19)], "self": [(15, 15), (18, 18), (21, 23)], "curve": [(15, 15), (21, 25)], "bend": [(15, 15), (21, 21), (23, 24)],
    }),
    "Go": (GO, {"Point": [(3, 6)], "Norm": [(8, 12)], "scale": [(8, 8)], "X": [(4, 5)], "t": [(8, 8), (10, 10)], "main": [(14, 15)]}),
    "Lua": (LUA, {"base": [(1, 2), (4, 4)], "Mod.run": [(2, 7)], "a": [(2, 2)], "key": [(2, 2), (6, 6)], "i": [(8, 8)]}),
    "Shell": (SHELL, {"greet": [(2, 7)], "who": [(2, 3)], "COLOR": [(8, 8)], "item": [(9, 9)]}),
    "CSS": (CSS, {"card": [(1, 4)], "title": [(1, 4)], "main": [(5, 5)]}),
    "Markdown": (MARKDOWN, {
        "Garden": [(3, 34)], "Beds": [(3, 3), (5, 20)], "soil": [(3, 3), (5, 5), (9, 11)], "depth": [(3, 3), (5, 5), (9, 9), (11, 11)], "Herbs": [(3, 3), (5, 5), (14, 20)],
        "Paths": [(3, 3), (5, 5), (14, 20)], "Tools": [(3, 3), (21, 34)], "Inner": [(3, 3), (21, 21), (27, 32)], "spade": [(3, 3), (21, 21), (27, 28), (30, 31)],
        "Pond": [(35, 35)], "not a heading, but code": [], "nor this -->": [],
    }),
    "HTML": (HTML, {
        "Opening": [], "Opening\nhours": [(1, 4)], "map": [(1, 2), (5, 10), (17, 19)], "stops": [(1, 2), (5, 9)], "zoom": [(1, 2), (11, 12)],
        "zoomIn": [(1, 2), (11, 11), (13, 15)], "step": [(1, 2), (11, 11), (13, 13)], "omap": [(1, 2), (17, 19)], "hint": [(1, 2), (17, 17), (20, 22)],
    }),
    "TeX": (TEX, {
        "rank": [(2, 2)], "half": [(3, 3)], "pde": [(4, 4)], "Heat": [(5, 5), (7, 17)], "ch:heat": [(5, 5), (7, 17)], "Rods": [(5, 5), (7, 17)],
        "fig:rod": [(5, 5), (7, 7), (9, 13)], "Ends": [(5, 5), (7, 7), (9, 9), (14, 17)], "eq:one": [(5, 5), (7, 7), (9, 9), (14, 17)], "Waves": [(5, 5), (19, 22)], "None": [], "Short": [],
    }),
    "YAML": (YAML, {"base": [(1, 6)], "shared": [(1, 1)], "host": [(2, 2)], "ports": [(3, 6)], "one": [(4, 4), (6, 6)], "two": [(5, 5)], "quoted": [(7, 7)], "inner": [(7, 7)], "odd key": [(7, 7)]}),
}
