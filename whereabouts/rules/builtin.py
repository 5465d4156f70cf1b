"""Built-in rules. Users change them and add languages with rows of their own; see ``layers``."""

from __future__ import annotations

from ..operators.language import GROUPS
from .model import Context, Lexis, Rule, RuleSet

PY = ("Python", "Cython")
CY = ("Cython",)
JS = ("JavaScript", "TypeScript", "TSX")
TS = ("TypeScript", "TSX")
TSX = ("TSX",)
C = ("C", "GLSL")
CXX = ("C++",)
CC = C + CXX
GO = ("Go",)
RS = ("Rust",)
LUA = ("Lua",)
SH = ("Shell",)
CSS = ("CSS",)
TEX = ("TeX",)
YML = ("YAML",)
MD = ("Markdown",)
HTML = ("HTML",)

DQ = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
SQ = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
BACKTICK = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"
SLASHES = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\z)"

LEXIS: dict[tuple[str, ...], Lexis] = {
    PY: Lexis(
        token=r'#[^\n]*|"""(?s:.*?)(?:(?<!\\)"""|\z)|' + r"'''(?s:.*?)(?:(?<!\\)'''|\z)|" + DQ + "|" + SQ,
        comment=r"^#",
        blocks="indent",
        continues=r"\\\s*$",
        attach=r"^\s*@\s*\w",
        head=r"^\s*(?:async\s+)?(?:def|class|with|for|cdef|cpdef|ctypedef|property)\b",
        attaches=True,
    ),
    JS: Lexis(
        token=SLASHES + "|" + DQ + "|" + SQ + "|" + BACKTICK + r"|(?<=[=(,:&|!?]\s?)/(?![/*])(?:[^/\\\n\[]|\\.|\[[^\]\n]*\])++/",
        comment=r"^/[/*]",
        blocks="bracket",
        continues=r"(?:(?<![=!<>])=|&&|\|\||\?|=>)\s*$",
        continued=r"[{.?:&|]",
        attaches=True,
    ),
    CC: Lexis(
        token=SLASHES + "|" + DQ + r"|'(?:[^'\\\n]|\\[^\n']++|\\')'",
        comment=r"^/[/*]",
        blocks="bracket",
        continues=r"(?:(?<![=!<>])=|&&|\|\||\?|\\)\s*$",
        continued=r"[{.?:&|]",
        attaches=True,
        attach=r"^\s*template\s*<.*>\s*$",
    ),
    GO: Lexis(
        token=SLASHES + "|" + DQ + r"|`[^`]*`|'(?:[^'\\\n]|\\[^\n']++|\\')'",
        comment=r"^/[/*]",
        blocks="bracket",
        continues=r"(?:(?<![=!<>])=|&&|\|\||[+.])\s*$",
        attaches=True,
    ),
    RS: Lexis(
        token=SLASHES + r'|r(#+)"(?s:.*?)"\1|' + r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"' + r"|'(?:[^'\\\n]|\\[^\n']++|\\')'",
        comment=r"^/[/*]",
        blocks="bracket",
        continues=r"(?:(?<![=!<>])=|&&|\|\|)\s*$",
        continued=r"[{.?&|]",
        attaches=True,
        attach=r"^\s*#!?\[(?:.*\]\s*$|[^\]]*$)",
    ),
    CSS: Lexis(token=r"/\*(?s:.*?)(?:\*/|\z)|" + DQ + "|" + SQ, comment=r"^/\*", blocks="bracket", continues=r",\s*$", continued=r"\{"),
    LUA: Lexis(
        token=r"--\[(=*)\[(?s:.*?)\]\1\]|--[^\n]*|\[(=*)\[(?s:.*?)\]\2\]|" + DQ + "|" + SQ,
        comment=r"^--",
        blocks="bracket",
        openers=r"[(\[{]|\b(?:function|do|if|repeat)\b",
        closers=r"[)\]}]|\b(?:end|until)\b",
        continues=r"(?:(?<![=~<>])=|\band|\bor|\.\.)\s*$",
    ),
    SH: Lexis(
        token=r"(?<![^\s;])#[^\n]*|" + r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"' + r"|'[^']*'",
        comment=r"^#",
        blocks="bracket",
        openers=r"\{|\b(?:if|do|case)\b",
        closers=r"\}|\b(?:fi|done|esac)\b",
        continues=r"(?:\\|&&|\|\|?)\s*$",
        continued=r"\{",
    ),
    YML: Lexis(
        token=r"(?<![^\s])#[^\n]*|" + DQ + r"|(?<![^\s\[{,:])'[^'\n]*+(?:''[^'\n]*+)*+'",
        comment=r"^#",
        blocks="indent",
        head=r"^\s*(?:-\s++)*+[^\s#].*?:(?:\s|$)",
    ),
    TEX: Lexis(
        token=r"(?<!\\)%[^\n]*|\\begin\{(verbatim|lstlisting|comment)\}(?s:.*?)\\end\{\1\}",
        comment=r"^%",
        blocks="heading",
        openers=r"(?<!\\)\{|\\begin\b",
        closers=r"(?<!\\)\}|\\end\b",
        level=tuple(rf"^\s*\\{k}\*?\s*[\[{{]" for k in ("part", "chapter", "section", "subsection", "subsubsection", "paragraph")),
        attaches=True,
    ),
    MD: Lexis(
        token=r"\A---[ \t]*\n(?s:.*?)\n---[ \t]*(?=\n|\z)|(?m:^ {0,3}(`{3,}|~{3,})[^\n]*$)(?s:.*?)(?:(?m:^ {0,3}\1[`~]*[ \t]*$)|\z)|<!--(?s:.*?)-->",
        comment=r"^(?: {0,3}[`~]|---|<!--)",
        blocks="heading",
        openers=r"(?!)",
        closers=r"(?!)",
        level=tuple(rf"^ {{0,3}}#{{{k}}}(?:[ \t]|$)" for k in range(1, 7)),
        shows_first=True,
    ),
}

# ---- pieces of patterns used more than once -------------------------------------------------

PY_T = r"\*?[A-Za-z_\u0080-\uDFFF][\w.]*+(?:\[[^\]\n]*+\])*+(?:\.\w++)*+"
PY_TL = rf"\(?\s*{PY_T}(?:\s*,\s*{PY_T})*+\s*,?\s*\)?"
PY_NOT = r"(?!(?:else|try|finally|lambda|case|return|yield|assert|del|raise|print)\b)"
PY_DEF = r"^\s*(?:async\s+)?(?:def|cp?def)\b"

JS_MOD = r"""(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract|declare|accessor|export|default)\s+(?=["'*#\w$]))*+"""
JS_KEY = r"(?!(?:if|for|while|switch|catch|return|function|with|else|do|new|throw|await|typeof|case|super)\b)"
JS_METHOD = rf"^\s*{JS_MOD}\*?\s*{JS_KEY}(#?[\w$]+)\s*(?:<[^>]*>)?\([^()]*\)\s*(?::[^{{]+)?\{{"
TS_NAME = r"""["']?((?<=["'])[^"'\n]+(?=["'])|[\w$]+)["']?"""
JS_OBJECT = r"^\{.*(?:(?:^\{|[=(:,\[?&|])\s*|\breturn\s+|\bdefault\s+)\{\s*$"

C_NOT = r"(?!\s*(?:return|goto|else|case|typedef|using|delete|throw|new|if|for|while|switch|do|namespace|public|private|protected)\b)"
C_TYPE = r"(?:[\w:]++(?:<[^;()]*>)?[\s*&]++(?=[\w~]))++"
C_FUNC = rf"^{C_NOT}\s*{C_TYPE}(?:\w++::)*+~?\w+\s*\((?!\s*\*)"

RS_VIS = r"^\s*(?:pub(?:\([^)]*\))?\s+)?"
RS_PATH = r"(?:\w++::)*+(\w+)"

RULES: list[Rule] = [
    # Python, and Cython by extension
    Rule(PY, "py_block", "block", r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", "BLOCK", start=True),
    Rule(PY, "py_assign", "variable", rf"^\s*{PY_NOT}({PY_TL}?)\s*(?::[^=]*)?=(?!=)", "LOGICAL", expand="target", start=True),
    Rule(PY, "py_assign_next", "variable", rf"^\s*{PY_TL}\s*=\s*({PY_TL}?)\s*=(?!=)", "LOGICAL", expand="target", start=True),
    Rule(PY, "py_annotation", "variable", rf"^\s*{PY_NOT}([A-Za-z_\u0080-\uDFFF][\w.]*)\s*:\s*(?![=:\s])[^=]*$", "LOGICAL", expand="target", start=True),
    Rule(PY, "py_scope", "variable", r"^\s*(?:global|nonlocal)\s+(.+?)\s*$", "LOGICAL", expand="list", start=True),
    Rule(PY, "py_type", "type", r"^\s*type\s+(\w+(?:\[[^\]]*\])?)\s*=", "LOGICAL", start=True),
    Rule(PY, "py_import_as", "alias", r"\bas\s+(\w+)", gate=r"^\s*(?:from|import|cimport)\b"),
    Rule(PY, "py_import_as_row", "alias", r"\bas\s+(\w+)", parent=r"^\(\s*from\b"),
    Rule(PY, "py_as", "target", r"\bas\s+(\w+)", gate=r"^\s*(?:async\s+)?(?:with|except)\b"),
    Rule(PY, "py_as_row", "target", r"\bas\s+(\w+)", parent=r"^\(\s*(?:async\s+)?with\b"),
    Rule(PY, "py_key", "key", r"""^\s*["']([^"'\n]*)["']\s*:""", "LOGICAL", parent=r"^\{"),
    Rule(PY, "py_key_inline", "key", r"""[{,]\s*["']([^"'\n]*)["']\s*:"""),
    Rule(PY, "py_param", "parameter", r"[(,]\s*(\w+)\s*(?=[,:=)]|$)", gate=PY_DEF, bare=True),
    Rule(PY, "py_param_row", "parameter", r"(?:^|,)\s*(\w+)\s*(?=[,:=)]|$)", parent=r"^\(\s*(?:async\s+)?(?:def|cp?def)\b", bare=True),
    Rule(PY, "py_lambda", "parameter", r"\blambda\s+([^:]*):", expand="params", bare=True),
    Rule(PY, "py_for", "target", r"^\s*(?:async\s+)?for\s+(.+?)\s+in\b", "LOGICAL", expand="target", start=True),
    Rule(PY, "py_comprehension", "target", r"\bfor\s+([^()\[\]{}]+?)\s+in\b", gate=r"^(?!\s*(?:async\s+)?for\b.*:\s*$).*\bfor\b", expand="target"),
    Rule(PY, "py_setattr", "attribute", r"""(?<![\w.])setattr\s*\(\s*[^,()]+,\s*["']([^"']*)["']""", "LOGICAL"),
    Rule(PY, "py_setitem", "attribute", r"""\.__set(?:attr|item)__\s*\((?:[^()]*,)?\s*["']([^"']*)["']\s*,\s*[^,()]+\)""", "LOGICAL"),
    # Cython
    Rule(CY, "cy_constant", "variable", r"^\s*DEF\s+(\w+)", "LOGICAL", start=True),
    Rule(CY, "cy_function", "block", r"^\s*(?:cdef|cpdef)\s+(?!class\b|struct\b|enum\b|union\b|cppclass\b)[^=(]*?(\w+)\s*\((?:.*:\s*$|[^)]*$)", "BLOCK", start=True),
    Rule(CY, "cy_class", "block", r"^\s*(?:cdef|cpdef|ctypedef)\s+(?:(?:public|packed|api|extern)\s+)*+(?:class|cppclass|enum|fused|struct|union)\s+(\w+)", "BLOCK", start=True),
    Rule(CY, "cy_variable", "variable", r"(?:^\s*(?:cdef|cpdef)\b[^=,]*?[\s*&]|,[\s*&]*+)(\w+)\s*(?:\[[^\]]*+\])*+\s*(?==(?!=)|,|$)", "LOGICAL", start=True, gate=r"^\s*(?:cdef|cpdef)\s+(?!class\b|struct\b|enum\b|union\b|cppclass\b)[^():]*(?:=.*)?$"),
    Rule(CY, "cy_field", "variable", r"(?:[\s*&])(\w+)\s*(?:\[[^\]]*+\])*+\s*$", "LOGICAL", start=True, gate=r"^\s+(?!(?:return|yield|import|from|raise|assert|del|global|nonlocal|cdef|cpdef|ctypedef|not|print|include|type|pass|break|continue)\b)[\w.]+(?:\s+[\w.]+)*[\s*&]+\w+\s*(?:\[[^\]]*+\])*+\s*$"),
    Rule(CY, "cy_typedef", "type", r"^\s*ctypedef\s+(?!class\b|struct\b|enum\b|union\b|fused\b)[^()]*?[\s*](\w+)\s*$", "LOGICAL", start=True),
    Rule(CY, "cy_param", "parameter", r"[(,]\s*(?:[\w.\[\]:]++[\s*&]++(?=\w))++(\w+)\s*(?==|,|\)|not\b|or\b|$)", gate=PY_DEF),
    Rule(CY, "cy_property", "block", r"^\s*property\s+(\w+)\s*:", "BLOCK", start=True),
    Rule(CY, "cy_for_from", "target", r"^\s*for\s+(\w+)\s+from\b", "LOGICAL", start=True),
    # JavaScript family
    Rule(JS, "js_function", "block", r"\bfunction\s*\*?\s*(\w[\w$]*)", "LOGICAL"),
    Rule(JS, "js_method", "block", JS_METHOD, "LOGICAL"),
    Rule(JS, "js_method_rows", "block", rf"^\s*{JS_MOD}\*?\s*{JS_KEY}(#?[\w$]+)\s*(?:<[^>]*>)?\(\s*$", "LOGICAL", parent=r"^\{.*\bclass\b"),
    Rule(JS, "js_param", "parameter", r"\bfunction\s*\*?\s*[\w$]*\s*(?:<[^>]*>)?\(([^()]*)", expand="params", bare=True),
    Rule(JS, "js_param_arrow", "parameter", r"\(([^()]*)\)\s*(?::[^=]+?)?=>", expand="params", bare=True),
    Rule(JS, "js_param_method", "parameter", rf"^\s*{JS_MOD}\*?\s*{JS_KEY}#?[\w$]+\s*(?:<[^>]*>)?\(([^()]*)\)\s*(?::[^{{]+)?\{{", expand="params", bare=True),
    Rule(JS, "js_param_row", "parameter", r"^\s*(?:\.\.\.)?([\w$]+)\s*\??\s*(?=[:=,)]|$)", parent=rf"^\((?:.*\bfunction\b[^()]*\($|.*=\s*(?:async\s*)?\(\s*$|\s*{JS_MOD}{JS_KEY}[\w$]+\s*\(\s*$)"),
    Rule(JS, "js_variable", "variable", r"\b(?:let|const|var)\s+([\w$]+)", "LOGICAL"),
    Rule(JS, "js_variable_next", "variable", r",\s*([\w$]+)\s*(?==(?![=>])|,|;|$)", gate=r"^\s*(?:export\s+)?(?:let|const|var)\s+[\w$]+\s*(?:=[^()\[\]{}=]*)?,"),
    Rule(JS, "js_array_pattern", "variable", r"(?:\b(?:let|const|var)\s+|^\s*)\[([^\]=]*)\]\s*=(?![=>])", "LOGICAL", expand="list"),
    Rule(JS, "js_object_pattern", "variable", r"(?:\b(?:let|const|var)\s+|^\s*\(\s*)\{([^{}]*)\}\s*=(?![=>])", "LOGICAL", expand="object_pattern"),
    Rule(JS, "js_assign", "variable", r"^\s*((?:this|[\w$]+)(?:\.#?[\w$]++|\[[^\]]*+\])*+)\s*=(?![=>])", "LOGICAL", expand="member"),
    Rule(JS, "js_key", "key", r"""^\s*["']([^"']+)["']\s*:""", "LOGICAL", parent=JS_OBJECT),
    Rule(JS, "js_key_bare", "key", r"^\s*([\w$]+)\s*:(?!:)", "LOGICAL", parent=JS_OBJECT),
    Rule(JS, "js_key_inline", "key", r"""[{,]\s*["']?([\w$]+)["']?\s*:(?!:)""", gate=r"^(?!.*\(\s*\{[^{}]*\}[^()]*\)\s*(?::[^=]+)?(?:=>|\{)).*(?:[=(:,\[]|\breturn)\s*\{[^{}]*:"),
    Rule(JS, "js_class", "block", r"\bclass\s+(?!extends\b)([\w$]+)", "LOGICAL"),
    Rule(JS, "js_field", "field", rf"^\s*{JS_MOD}(#?[\w$]+)\s*[?!]?\s*(?::[^()=]*)?(?:=(?![=>]).*|;?\s*)$", "LOGICAL", parent=r"^\{.*\bclass\b"),
    Rule(TS, "ts_block", "block", r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:const\s+)?(?:interface|enum|namespace|module)\s+([\w$.]+)", "LOGICAL"),
    Rule(TS, "ts_type", "type", r"^\s*(?:export\s+)?(?:declare\s+)?type\s+([\w$]+)[^=]*=", "LOGICAL"),
    Rule(TS, "ts_signature", "field", rf"""^\s*{JS_MOD}{TS_NAME}\s*\??\s*(?:<[^>]*>)?[(:]""", "LOGICAL", parent=r"^\{.*\b(?:interface|type)\b"),
    Rule(TS, "ts_enum_member", "field", rf"""^\s*{TS_NAME}\s*(?:=|,|$)""", parent=r"^\{.*\benum\b"),
    Rule(TS, "ts_abstract", "block", r"^\s*(?:(?:public|private|protected)\s+)?abstract\s+(?!class\b)([\w$]+)\s*\(", "LOGICAL"),
    Rule(TS, "ts_alias", "alias", r"\bas\s+([\w$]+)", gate=r"^\s*(?:import|export)\b.*\{"),
    Rule(TS, "ts_alias_row", "alias", r"\bas\s+([\w$]+)", parent=r"^\{\s*(?:import|export)\b"),
    Rule(TSX, "tsx_attribute", "attribute", r"""\s([A-Za-z_][\w-]*)=(?=["'{])""", gate=r"<[A-Za-z][\w.]*\b"),
    # C, GLSL and C++
    Rule(CC, "c_macro", "macro", r"^\s*#\s*(?:define|undef)\s+(\w+)", "LOGICAL"),
    Rule(CC, "c_struct", "block", r"\bstruct\s+(\w+)\s*(?::[^{;]*)?(?:\{|$)", "LOGICAL"),
    Rule(CC, "c_typedef", "type", r"^\s*typedef\b[^;{(]*?[\s*](\w+)\s*(?:\[[^\]]*+\])*+\s*;", "LOGICAL"),
    Rule(CC, "c_typedef_function", "type", r"^\s*typedef\b[^;{]*?\(\s*\*+\s*(\w+)\s*\)\s*\(", "LOGICAL"),
    Rule(CC, "c_closing_name", "type", r"^\s*\}\s*\**\s*(\w+)\s*(?:\[[^\]]*+\])*+\s*(?:;|=)", "CLOSES"),
    Rule(CC, "c_declaration", "variable", rf"^{C_NOT}\s*{C_TYPE}(\w+)\s*(?:\[[^\]]*+\]\s*)*+(?:=(?!=)|;|,|:\s*\d)", "LOGICAL"),
    Rule(CC, "c_declaration_next", "variable", r",\s*\**\s*(\w+)\s*(?:\[[^\]]*+\]\s*)*+(?==(?!=)|;|,)", gate=rf"^{C_NOT}\s*{C_TYPE}\w+\s*(?:\[[^\]]*+\]\s*)*+(?:=[^()]*)?,[^()]*;"),
    Rule(CC, "c_function", "block", rf"^{C_NOT}\s*{C_TYPE}(?:\w++::)*+(~?\w+)\s*\((?!\s*\*)", "LOGICAL"),
    Rule(CC, "c_param", "parameter", r"[(,]\s*(?:[\w:]++(?:<[^()]*>)?[\s*&]++(?=\w))++(\w+)\s*(?:\[[^\]]*+\])*+\s*(?==|[,)]|$)", gate=C_FUNC),
    Rule(CC, "c_param_row", "parameter", r"^\s*(?:[\w:]++(?:<[^()]*>)?[\s*&]++(?=\w))++(\w+)\s*(?:\[[^\]]*+\])*+\s*(?==|[,)]|$)", parent=rf"^\({C_FUNC[1:]}"),
    Rule(CC, "c_param_function", "parameter", r"\(\s*\*+\s*(\w+)\s*\)\s*\(", gate=r"^(?!\s*typedef\b)"),
    Rule(C, "c_assign", "variable", r"^\s*\**\s*(\w+)\s*(?:[-+*/%&|^]|<<|>>)?=(?!=)", "LOGICAL"),
    Rule(CXX, "cxx_assign", "variable", r"^\s*(\*{0,2}\s*\w+(?:(?:\.|->)\w++)*+)\s*(?:[-+*/%&|^]|<<|>>)?=(?!=)", "LOGICAL", expand="member"),
    Rule(CXX, "cxx_constructor", "block", r"^\s*(?:explicit\s+|virtual\s+)?(?:\w++::)*+(~?\w+)\s*\([^;]*\)\s*(?:noexcept\s*)?(?::[^;]*)?\{", "LOGICAL", gate=r"^(?!\s*(?:if|for|while|switch|catch|return)\b)"),
    Rule(CXX, "cxx_class", "block", r"\bclass\s+(\w+)(?!\s*[;,>=\w])", "LOGICAL"),
    Rule(CXX, "cxx_namespace", "block", r"^\s*(?:inline\s+)?namespace\s+([\w:]+)", "LOGICAL"),
    Rule(CXX, "cxx_type_parameter", "parameter", r"\b(?:typename|class)\s+(\w+)\s*(?=[,>=])", gate=r"^\s*template\s*<"),
    Rule(CXX, "cxx_initializer", "field", r"[:,]\s*(\w+)\s*[({]", gate=r"\)\s*:[^:]|^\s*[:,][^:]"),
    # Go
    Rule(GO, "go_type", "type", r"^\s*type\s+(\w+)", "LOGICAL"),
    Rule(GO, "go_type_row", "type", r"^\s*(\w+)\s+\S", "LOGICAL", parent=r"^\(\s*type\b"),
    Rule(GO, "go_function", "block", r"^\s*func\s+(\w+)", "LOGICAL"),
    Rule(GO, "go_method", "block", r"^\s*func\s*\([^)]*\)\s*(\w+)", "LOGICAL"),
    Rule(GO, "go_field", "field", r"^\s*(\w+(?:\s*,\s*\w++)*+)\s+[\w*\[\].(]", parent=r"^\{.*\bstruct\b", expand="list", policy="LOGICAL"),
    Rule(GO, "go_param", "parameter", r"[(,]\s*(\w+)\s*(?=,|\s[\w*\[.(])", gate=r"\bfunc\b"),
    Rule(GO, "go_param_row", "parameter", r"^\s*(\w+)\s+[\w*\[\].(]", parent=r"^\(.*\bfunc\b"),
    Rule(GO, "go_assign", "variable", r"^\s*([\w.\[\]]+(?:\s*,\s*[\w.\[\]]++)*+)\s*(?:[-+*/%&|^]|<<|>>)?=(?!=)", "LOGICAL"),
    # Rust
    Rule(RS, "rs_function", "block", rf"{RS_VIS}(?:(?:default|const|async|unsafe|extern(?:\s+(?!fn\b)\S+)?)\s+)*+fn\s+(\w+)", "LOGICAL"),
    Rule(RS, "rs_let", "variable", r"\blet\s+(?:mut\s+)?(\w+)\s*(?=[:=;])", "LOGICAL"),
    Rule(RS, "rs_item", "block", rf"{RS_VIS}(?:unsafe\s+)?(?:const|enum|mod|static(?:\s+mut)?|struct|trait|type|union)\s+(?!fn\b|mut\b)(\w+)", "LOGICAL"),
    Rule(RS, "rs_macro", "macro", r"^\s*macro_rules!\s*(\w+)", "LOGICAL"),
    Rule(RS, "rs_impl", "block", rf"^\s*(?:unsafe\s+)?impl\b(?:\s*<[^{{]*?>(?=\s))?\s+(?:!\s*)?{RS_PATH}(?=\s*(?:<.*>)?\s*(?:\{{|for\b|where\b|$))", "LOGICAL"),
    Rule(RS, "rs_impl_for", "block", rf"^\s*(?:unsafe\s+)?impl\b.*\bfor\s+&?{RS_PATH}", "LOGICAL"),
    Rule(RS, "rs_variant", "field", r"^\s*([A-Z]\w*)\s*(?:[({,]|=(?![=>])|$)", "LOGICAL", parent=r"^\{.*\benum\b"),
    Rule(RS, "rs_field", "field", rf"{RS_VIS}(\w+)\s*:(?!:)", "LOGICAL", parent=r"^\{(?!.*\b(?:fn|match|if|else|for|while|loop|impl|trait|mod|unsafe)\b)"),
    Rule(RS, "rs_field_inline", "field", r"[{,]\s*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:(?!:)", gate=r"^(?!.*\bfn\b).*\w\s*\{[^{}]*:"),
    Rule(RS, "rs_shorthand", "field", r"^\s*(\w+)\s*,?\s*$", parent=r"^\{.*(?:^\{|[=(,]|\breturn\b|::|Some|Ok|Err)\s*(?:\w++::)*+[A-Z]\w*\s*\{\s*$"),
    Rule(RS, "rs_use_as", "alias", r"\bas\s+(\w+)", gate=rf"{RS_VIS}use\b"),
    Rule(RS, "rs_use_as_row", "alias", r"\bas\s+(\w+)", parent=r"^\{\s*(?:pub(?:\([^)]*\))?\s+)?use\b"),
    # Lua
    Rule(LUA, "lua_function", "block", r"\bfunction\s+([\w.:]+)\s*\(", "LOGICAL"),
    Rule(LUA, "lua_assign", "variable", r"^\s*(?:local\s+)?([\w.\[\]]+(?:\s*,\s*[\w.\[\]]++)*+)\s*=(?!=)", "LOGICAL", expand="list", parent=r"^(?!\{)"),
    Rule(LUA, "lua_local", "variable", r"^\s*local\s+(?!function\b)(\w+(?:\s*,\s*\w++)*+)\s*(?:<\w+>)?\s*$", "LOGICAL", expand="list"),
    Rule(LUA, "lua_for", "target", r"^\s*for\s+(.+?)\s*(?:=|\bin\b)", expand="list"),
    Rule(LUA, "lua_field", "field", r"^\s*(\w+)\s*=(?!=)", "LOGICAL", parent=r"^\{"),
    Rule(LUA, "lua_field_inline", "field", r"[{,]\s*(\w+)\s*=(?!=)", gate=r"\{"),
    Rule(LUA, "lua_param", "parameter", r"\bfunction\b[\w\s.:]*\(([^()]*)", expand="params"),
    Rule(LUA, "lua_label", "label", r"::\s*(\w+)\s*::"),
    # Shell
    Rule(SH, "sh_function", "block", r"^\s*(?:function\s+([\w:.-]+)|([\w:.-]+)\s*\(\s*\))", "LOGICAL", group=0, transform="shell_function"),
    Rule(SH, "sh_assign", "variable", r"(?:^|[;&|]|\b(?:export|local|readonly|declare|typeset|then|do|else)\b(?:\s+-\w++)*+)\s*(\w+)(?:\[[^\]]*\])?\+?=", "LOGICAL"),
    Rule(SH, "sh_declare", "variable", r"^\s*(?:export|local|readonly|declare|typeset)\b(?:\s+-\w++)*+\s+([\w\s]+?)\s*$", "LOGICAL", expand="spaced"),
    Rule(SH, "sh_for", "target", r"\bfor\s+(\w+)\b"),
    # CSS
    Rule(CSS, "css_class", "selector", r"\.(-?[A-Za-z_][\w-]*)", "LOGICAL", gate=r"^(?!\s*[\w-]+\s*:\s*[^{]*;\s*\}?\s*$)(?!\s*@import).*(?:\{|,\s*$|^\s*[.#\w:>+~*\[])"),
    Rule(CSS, "css_id", "selector", r"#(-?[A-Za-z_][\w-]*)", "LOGICAL", gate=r"^(?!\s*[\w-]+\s*:[^{]*$).*(?:\{|,\s*$|^\s*[.#\w])"),
    # Markdown
    Rule(MD, "md_section", "section", r"^ {0,3}#{1,6}[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", "BLOCK"),
    Rule(MD, "md_underlined", "section", r"^ {0,3}(?![#>]|[-*+]\s)(\S.*?)[ \t]*$", "SECTION", transform="underlined"),
    Rule(MD, "md_fence", "fragment", r"^( {0,3}[`~]{3})"),
    Rule(MD, "md_front_matter", "fragment", r"^(---)[ \t]*$", gate="", transform="first_row"),
    # TeX
    Rule(TEX, "tex_label", "label", r"\\label\s*\{([^{}]*)\}"),
    Rule(TEX, "tex_label_inside", "label", r"\\label\s*\{([^{}]*)\}", "INSIDE"),
    Rule(TEX, "tex_command", "command", r"\\(?:re|provide)?(?:newcommand|DeclareRobustCommand|DeclareMathOperator)\*?\s*\{?\s*(\\[A-Za-z@]+)", "LOGICAL", transform="tex_command"),
    Rule(TEX, "tex_renew", "command", r"\\(?:renewcommand|providecommand|def|let)\*?\s*\{?\s*(\\[A-Za-z@]+)", "LOGICAL", transform="tex_command"),
    Rule(TEX, "tex_environment", "command", r"\\(?:re)?newenvironment\*?\s*\{([^{}]*)\}", "LOGICAL"),
    Rule(TEX, "tex_theorem", "command", r"\\(?:newtheorem|declaretheorem)\*?\s*(?:\[[^\]]*\])?\{([^{}]*)\}", "LOGICAL"),
    Rule(TEX, "tex_glossary", "command", r"\\(?:newacronym|newglossaryentry|DeclareAcronym)\s*(?:\[[^\]]*\])?\{([^{}]*)\}", "LOGICAL"),
    Rule(TEX, "tex_section", "section", r"^\s*\\(?:part|chapter|section|subsection|subsubsection|paragraph)\*?\s*(?:\[[^\]]*\])?\{(.*?)\}", "BLOCK"),
    # YAML, and keys of flow mappings (JSON objects)
    Rule(YML, "yaml_anchor", "anchor", r"(?<![^\s\[{,])&([^\s,\[\]{}]+)"),
    Rule(YML, "yaml_key", "key", r"""^\s*(?:-\s++)*+((?:"[^"\n]*"|'[^'\n]*'|[^\s\-#&*!|>'"%@`{\[][^\n#]*?))\s*:(?=\s|$)""", "BLOCK", start=True, transform="yaml_quotes"),
    Rule(YML, "yaml_flow_key", "key", r"""[{,]\s*("[^"\n]*"|'[^'\n]*'|[^\s"'{}\[\],:]+)\s*:(?=\s|["'{\[]|$)""", transform="yaml_quotes"),
    Rule(YML, "yaml_flow_key_row", "key", r"""^\s*("[^"\n]*"|'[^'\n]*'|[^\s"'{}\[\],:]+)\s*:(?=\s|["'{\[]|$)""", "LOGICAL", parent=r"^\{", transform="yaml_quotes"),
]

# Words without which a rule cannot match.
NEEDS: dict[str, str] = {
    "py_block": "def class", "py_assign": "=", "py_assign_next": "=", "py_annotation": ":", "py_scope": "global nonlocal",
    "py_type": "type", "py_import_as": "as", "py_import_as_row": "as", "py_as": "as", "py_as_row": "as", "py_key": ":",
    "py_key_inline": ":", "py_param": "def", "py_lambda": "lambda", "py_for": "for", "py_comprehension": "for",
    "py_setattr": "setattr", "py_setitem": "__set", "cy_constant": "DEF", "cy_function": "def", "cy_class": "def",
    "cy_variable": "def", "cy_typedef": "ctypedef", "cy_param": "def", "cy_property": "property", "cy_for_from": "for",
    "js_function": "function", "js_method": "(", "js_method_rows": "(", "js_param": "function", "js_param_arrow": "=>",
    "js_param_method": "(", "js_variable": "let const var", "js_variable_next": "let const var", "js_array_pattern": "=",
    "js_object_pattern": "=", "js_assign": "=", "js_key": ":", "js_key_bare": ":", "js_key_inline": ":", "js_class": "class",
    "ts_block": "interface enum namespace module", "ts_type": "type", "ts_abstract": "abstract", "ts_alias": "as",
    "ts_alias_row": "as", "tsx_attribute": "=", "c_macro": "#", "c_struct": "struct", "c_typedef": "typedef",
    "c_typedef_function": "typedef", "c_closing_name": "}", "c_function": "(", "c_param": "(", "c_param_function": "*",
    "c_assign": "=", "cxx_assign": "=", "cxx_constructor": "(", "cxx_class": "class", "cxx_namespace": "namespace",
    "cxx_type_parameter": "template", "cxx_initializer": "( {", "go_type": "type", "go_function": "func", "go_method": "func",
    "go_param": "func", "go_assign": "=", "rs_function": "fn", "rs_let": "let", "rs_macro": "macro_rules", "rs_impl": "impl",
    "rs_impl_for": "impl", "rs_field": ":", "rs_field_inline": ":", "rs_use_as": "as", "rs_use_as_row": "as",
    "lua_function": "function", "lua_assign": "=", "lua_local": "local", "lua_for": "for", "lua_field": "=",
    "lua_field_inline": "=", "lua_param": "function", "lua_label": "::", "sh_assign": "=", "sh_for": "for", "css_class": ".",
    "css_id": "#", "md_section": "#", "tex_label": "label", "tex_label_inside": "label", "yaml_anchor": "&", "yaml_key": ":",
    "yaml_flow_key": ":", "yaml_flow_key_row": ":",
}
RULES = [rule._replace(needs=NEEDS.get(rule.rule_id, "")) for rule in RULES]

CONTEXTS: list[Context] = [
    Context(PY, r"^\s*(?:async\s+)?(?:def|class|with|for|cdef|cpdef|ctypedef\s+(?:class|struct|enum|union|fused)|property)\b", "HEADER"),
    Context(PY, r"^\s*from\b.*\bimport\b", "WHOLE"),
    Context(PY, rf"^\s*{PY_TL}\s*(?::[^=]*)?=(?!=)", "ROW"),
    Context(JS, rf"\bfunction\b|(?<!\babstract\s)\bclass\b|=>\s*\{{?\s*$|{JS_METHOD}|=\s*(?:async\s*)?\(\s*$", "HEADER"),
    Context(JS, r"\b(?:let|const|var)\b|^\s*(?:this|[\w$]+)(?:\.#?[\w$]++|\[[^\]]*+\])*+\s*=(?![=>])", "ROW"),
    Context(TS, r"""\b(?:interface|enum)\b|^\s*(?:export\s+)?type\b|^\s*["']?[\w$]+["']?\s*\??\s*:""", "ROW"),
    Context(TSX, r"^\s*<[A-Za-z][\w.]*(?:\s|$)", "ROW"),
    Context(CC, rf"{C_FUNC}|\(\s*\*+\s*\w+\s*\)\s*\(", "HEADER"),
    Context(CC, r"^\s*typedef\b|\bstruct\b", "ROW"),
    Context(CXX, r"^\s*(?:inline\s+)?namespace\b|\bclass\b", "ROW"),
    Context(CXX, r"^\s*(?:explicit\s+)?(?!(?:if|for|while|switch|catch)\b)(?:\w++::)*+~?\w+\s*\([^;]*\)\s*(?::[^;]*)?\{", "HEADER"),
    Context(GO, r"\bfunc\b", "HEADER"),
    Context(GO, r"^\s*type\b(?!\s*\()|^\s*\w+\s+(?:struct|interface)\s*\{\s*$", "ROW"),
    Context(RS, r"\bfn\b", "HEADER"),
    Context(RS, r"\b(?:impl|struct|enum|trait)\b|^\s*(?:\w++::)*+\w+!\s*[({\[]|(?:^\s*|[=(,]\s*|\breturn\s+)(?:\w++::)*+[A-Z]\w*\s*\{\s*$", "ROW"),
    Context(LUA, r"\bfunction\b|^\s*for\b", "HEADER"),
    Context(LUA, r"\{", "ROW"),
    Context(SH, r"^\s*(?:function\s+[\w:.-]+|[\w:.-]+\s*\(\s*\))", "ROW"),
    Context(CSS, r"", "WHOLE"),
    Context(TEX, r"\\begin\b", "ROW"),
]

CALL_NOT = (
    r"(?:if|elif|while|for|in|not|and|or|return|yield|assert|del|raise|print|with|as|is|import|from|else|except|await|async"
    r"|global|nonlocal|pass|case|match|lambda|def|class)"
)

# Rows that refer to names: calls that may be followed, and imports that tell where to look.
REFERENCES: list[Rule] = [
    Rule(PY, "py_call", "call", rf"(?<!\bdef\s)(?<!\bclass\s)(?<!\w)(?!{CALL_NOT}\b)([A-Za-z_\u0080-\uDFFF]\w*)\s*\(", needs="("),
    Rule(PY, "py_from", "import", r"^\s*(from\s+\S+\s+import\b.*?)\s*$", needs="import"),
    Rule(PY, "py_from_row", "import", r"^\s*([^()]*?)\s*$", parent=r"^\(\s*from\b"),
    Rule(PY, "py_dotted", "dotted", r"(?<![\w.])([A-Za-z_\u0080-\uDFFF]\w*+(?:\.\w++)++)", needs=".", gate=r"^(?!\s*(?:from|import)\b)"),
]

BUILTIN = RuleSet(RULES, CONTEXTS, LEXIS, REFERENCES, GROUPS)
