"""What stands where in a source text: element and import patterns of each language.

Each language is a table of patterns written from its grammar, with horizontal
white space only, so that a match never starts on the blank lines before it.
A pattern names the kind, the element type and how its block ends; the group
``name`` holds the name, everything before it on the line the modifiers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

H = r"[ \t]*"
S = r"[ \t]+"
ID = r"[A-Za-z_$][\w$]*"
GEN = r"(?:<[^<>{};]*(?:<[^<>]*>[^<>]*)*>)?"
STOP = frozenset("if for while switch catch return else do try new throw case when with using lock foreach elseif match loop unless until sizeof typeof await yield function class def".split())


@dataclass(frozen=True)
class Pattern:
    kind: str
    type: str
    regex: re.Pattern
    end: str  # line, brace, indent, end (keyword), semi, tag


@dataclass(frozen=True)
class Import:
    kind: str
    regex: re.Pattern  # groups: source, name, alias, names (a list to be split)


@dataclass(frozen=True)
class Language:
    name: str
    patterns: tuple[Pattern, ...]
    imports: tuple[Import, ...] = ()
    visibility: str = "words"
    default_visibility: str = "public"
    line_comment: str = "//"
    extra: tuple[str, ...] = field(default=())
    #: a parser of its own, text in, elements and dependencies out, in place of patterns
    parser: Callable[[str], tuple[list, list]] | None = None


def _p(kind: str, type: str, rx: str, end: str = "brace") -> Pattern:
    return Pattern(kind, type, re.compile("(?m)^(?P<lead>[ \\t]*)" + rx), end)


def _i(kind: str, rx: str) -> Import:
    return Import(kind, re.compile("(?m)^[ \\t]*" + rx))


_MODS = r"(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|sealed|async|readonly|const|partial|extern|unsafe|native|synchronized|transient|volatile|strictfp|default|required|new|open|inline|suspend|operator|infix|data|inner|lateinit|companion|tailrec|external|annotation|actual|expect|value|enum|mutating|nonmutating|lazy|weak|unowned|fileprivate|indirect|convenience|optional|dynamic|class)\b[ \t]*)*)"
_JAVA_TYPE = rf"[A-Za-z_$][\w$.]*{GEN}(?:\[\])*"

_JS = (
    _p("function", "function", rf"(?:export{S}(?:default{S})?)?(?P<mods>async{S})?function\b{H}\*?{H}(?P<name>{ID}){H}(?={GEN}\()"),
    _p("class", "class", rf"(?:export{S}(?:default{S})?)?(?P<mods>abstract{S})?class{S}(?P<name>{ID})"),
    _p("arrow", "function", rf"(?:export{S})?(?:const|let|var){S}(?P<name>{ID})(?:{H}:[^=\n]+)?{H}={H}(?P<mods>async{H})?(?:{GEN}\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)(?:{H}:[^=\n]+)?|{ID}){H}=>"),
    _p("method", "method", rf"(?P<mods>(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract){S})*)\*?(?P<name>#?{ID}){H}{GEN}\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)(?:{H}:[^{{\n]+)?{H}\{{"),
    _p("assigned", "function", rf"(?:module\.)?exports\.(?P<name>{ID}){H}={H}(?P<mods>async{S})?(?:function\b|\([^()\n]*\){H}=>|{ID}{H}=>)"),
    _p("object_method", "function", rf"(?P<name>{ID}){H}:{H}(?P<mods>async{H})?(?:function\b[^\n{{]*|\([^()\n]*\){H}=>{H})\{{"),
    _p("const", "constant", rf"(?:export{S})?const{S}(?P<name>{ID})(?:{H}:[^=\n]+)?{H}=(?!{H}(?:async{H})?(?:\([^()\n]*\)(?:{H}:[^=\n]+)?|{ID}){H}=>)", "line"),
    _p("variable", "variable", rf"(?:export{S})?(?:let|var){S}(?P<name>{ID})(?=[^=\n]*(?:=(?!{H}(?:async{H})?(?:\([^()\n]*\)|{ID}){H}=>)|;|$))", "line"),
)
_JS_IMPORTS = (
    _i("import", rf"import{S}(?P<names>[^'\"\n;]*?\bfrom\b){H}['\"](?P<source>[^'\"\n]+)['\"]"),
    _i("import", rf"import{S}['\"](?P<source>[^'\"\n]+)['\"]"),
    _i("require", rf"(?:(?:const|let|var){S}(?P<names>\{{[^}}\n]*\}}|{ID}){H}={H})?require{H}\({H}['\"](?P<source>[^'\"\n]+)['\"]{H}\)"),
    _i("export", rf"export{S}(?P<names>[^'\"\n;]*?\bfrom\b){H}['\"](?P<source>[^'\"\n]+)['\"]"),
)
_TS = _JS + (
    _p("interface", "interface", rf"(?:export{S})?(?:default{S})?(?:declare{S})?interface{S}(?P<name>{ID})"),
    _p("type", "class", rf"(?:export{S})?(?:declare{S})?type{S}(?P<name>{ID}){H}{GEN}{H}=", "line"),
    _p("enum", "enum", rf"(?:export{S})?(?:declare{S})?(?P<mods>const{S})?enum{S}(?P<name>{ID})"),
    _p("namespace", "namespace", rf"(?:export{S})?(?:declare{S})?(?:namespace|module){S}(?P<name>[\w.$]+|'[^'\n]+'){H}\{{"),
    _p("decorator", "class", rf"(?P<name>@{ID}(?:\.{ID})*)", "line"),
)
_TS_IMPORTS = _JS_IMPORTS + (_i("reference", r"///[ \t]*<reference[ \t]+(?:path|types|lib)=['\"](?P<source>[^'\"\n]+)['\"]"), _i("import", rf"import{S}(?P<name>{ID}){H}={H}require\(['\"](?P<source>[^'\"\n]+)['\"]\)"))
_REACT = (
    _p("component", "class", rf"(?:export{S}(?:default{S})?)?function{S}(?P<name>[A-Z]\w*){H}\("),
    _p("component", "class", rf"(?:export{S})?const{S}(?P<name>[A-Z]\w*)(?:{H}:[^=\n]+)?{H}={H}(?:React\.)?(?:memo\(|forwardRef\()?{H}(?:\([^()\n]*\)|{ID}){H}=>"),
    _p("class_component", "class", rf"(?:export{S}(?:default{S})?)?class{S}(?P<name>[A-Z]\w*){S}extends{S}(?:React\.)?(?:Pure)?Component\b"),
    _p("custom_hook", "function", rf"(?:export{S}(?:default{S})?)?(?:function{S}|const{S})(?P<name>use[A-Z]\w*)"),
    _p("hook", "variable", rf"(?:const|let){S}(?P<name>\[[^\]\n]*\]|{ID}){H}={H}(?:React\.)?use[A-Z]\w*\(", "line"),
    _p("hoc", "function", rf"(?:export{S}(?:default{S})?)?(?:function{S}|const{S})(?P<name>with[A-Z]\w*)"),
    _p("context", "constant", rf"(?:export{S})?const{S}(?P<name>{ID}){H}={H}(?:React\.)?createContext\b", "line"),
    _p("reducer", "function", rf"(?:export{S})?(?:function{S}|const{S})(?P<name>\w*[rR]educer)\b"),
)
_REACT_IMPORTS = (_i("react_import", rf"import{S}(?P<names>[^'\"\n;]*?\bfrom\b){H}['\"](?P<source>react|react-dom|@react/[^'\"\n]+)['\"]"),)
_NEXT_IMPORTS = (
    _i("nextjs_import", rf"import{S}(?P<names>[^'\"\n;]*?\bfrom\b){H}['\"](?P<source>@?next/[^'\"\n]+)['\"]"),
    _i("dynamic_import", rf"(?:const|let|var){S}(?P<name>{ID}){H}={H}dynamic\([^'\"\n]*import\(['\"](?P<source>[^'\"\n]+)['\"]"),
)
_NEXT = (
    _p("route_handler", "function", rf"export{S}(?P<mods>async{S})?function{S}(?P<name>GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"),
    _p("data", "function", rf"export{S}(?:const{S}|(?P<mods>async{S})?function{S})(?P<name>getServerSideProps|getStaticProps|getStaticPaths|generateStaticParams|generateMetadata)\b"),
    _p("middleware", "function", rf"export{S}(?P<mods>async{S})?function{S}(?P<name>middleware)\b"),
    _p("layout", "class", rf"export{S}default{S}(?:async{S})?function{S}(?P<name>\w*Layout)\b"),
    _p("page", "class", rf"export{S}default{S}(?:async{S})?function{S}(?P<name>\w*Page)\b"),
    _p("api_route", "function", rf"export{S}default{S}(?:async{S})?function{S}(?P<name>handler)\b"),
)
_C = (
    _p("function", "function", rf"(?P<mods>(?:(?:static|extern|inline|const|unsigned|signed|volatile|register|struct|enum|union|virtual|explicit|constexpr|friend){S})*)[A-Za-z_]\w*(?:::\w+)*(?:{GEN}|)[ \t*&]+(?P<name>~?[A-Za-z_]\w*(?:::~?\w+)*){H}\([^;{{}}]*\)(?:{S}(?:const|noexcept|override|final))*{H}(?:\n[ \t]*)?\{{"),
    _p("prototype", "function", rf"(?P<mods>(?:(?:static|extern|inline|const|unsigned|signed|struct|virtual){S})*)[A-Za-z_]\w*[ \t*&]+(?P<name>[A-Za-z_]\w*){H}\([^;{{}}\n]*\){H}(?:const)?{H};", "line"),
    _p("struct", "struct", rf"(?:typedef{S})?struct{S}(?P<name>[A-Za-z_]\w*){H}(?:\n[ \t]*)?\{{"),
    _p("union", "struct", rf"(?:typedef{S})?union{S}(?P<name>[A-Za-z_]\w*){H}\{{"),
    _p("enum", "enum", rf"(?:typedef{S})?enum{S}(?:class{S})?(?P<name>[A-Za-z_]\w*)(?:{H}:[^{{\n]+)?{H}\{{"),
    _p("typedef", "class", rf"typedef{S}(?!struct{S}\w+{H}\{{|enum\b|union\b)[^;{{}}\n]*?(?P<name>[A-Za-z_]\w*){H};", "semi"),
    _p("macro", "constant", rf"#{H}define{S}(?P<name>[A-Za-z_]\w*)", "line"),
    _p("global", "variable", rf"(?<![ \t])(?P<mods>(?:(?:static|extern|const|volatile){S})*)(?!return|typedef|using|goto|else)[A-Za-z_]\w*[ \t*]+(?P<name>[A-Za-z_]\w*)(?:\[[^\]\n]*\])?{H}(?:=[^;\n]*)?;", "line"),
)
_C_IMPORTS = (_i("system_include", rf"#{H}include{H}<(?P<source>[^>\n]+)>"), _i("local_include", rf"#{H}include{H}\"(?P<source>[^\"\n]+)\""))

LANGUAGES: dict[str, Language] = {}


#: fixed values: language -> parser, suffix -> parser, for files whose language names none
BY_LANGUAGE = {"python": "python", "rust": "rust", "javascript": "javascript", "typescript": "typescript", "java": "java", "cpp": "cpp", "c": "c", "csharp": "csharp", "php": "php", "ruby": "ruby", "bash": "bash", "sql": "sql", "html": "html", "css": "css"}
BY_SUFFIX = {
    ".go": "golang", ".jsx": "nextjs", ".tsx": "nextjs", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".dart": "dart", ".mjs": "javascript", ".cjs": "javascript", ".pyw": "python", ".cc": "cpp", ".cxx": "cpp",
    ".hh": "cpp", ".hxx": "cpp", ".htm": "html", ".xhtml": "html", ".sass": "css", ".scss": "generic", ".less": "generic", ".zsh": "bash", ".fish": "bash", ".ksh": "bash", ".xml": "generic", ".md": "generic",
    ".txt": "generic", ".rst": "generic", ".toml": "generic", ".ini": "generic", ".cfg": "generic", ".conf": "generic", ".dockerfile": "generic", ".makefile": "generic", ".cmake": "generic", ".gradle": "generic",
}
#: languages of this module; what is added to or replaced in ``LANGUAGES`` later travels to the workers with each job
BUILT_IN: dict[str, Language] = {}


def register(lang: Language, *, languages: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> Language:
    """Adds or replaces a language, and sends files of these languages and suffixes to it; users register their own the same way."""
    LANGUAGES[lang.name] = lang
    BY_LANGUAGE.update(dict.fromkeys(languages, lang.name))
    BY_SUFFIX.update({s.lower(): lang.name for s in suffixes})
    return lang


def added() -> dict[str, Language]:
    """Languages registered beside or in place of those of this module."""
    return {k: v for k, v in LANGUAGES.items() if BUILT_IN.get(k) is not v}


register(Language("javascript", _JS, _JS_IMPORTS, "export"))
register(Language("typescript", _TS, _TS_IMPORTS, "export"))
register(Language("react", _REACT + _JS, _JS_IMPORTS + _REACT_IMPORTS, "export"))
register(Language("nextjs", _NEXT + _REACT + _JS, _JS_IMPORTS + _REACT_IMPORTS + _NEXT_IMPORTS, "export"))
register(
    Language(
        "rust",
        (
            _p("function", "function", rf"(?P<mods>(?:pub(?:\([^)\n]*\))?{S})?(?:(?:async|unsafe|const|extern(?:{S}\"[^\"\n]*\")?){S})*)fn{S}(?P<name>\w+)"),
            _p("struct", "struct", rf"(?P<mods>(?:pub(?:\([^)\n]*\))?{S})?)struct{S}(?P<name>\w+)"),
            _p("enum", "enum", rf"(?P<mods>(?:pub(?:\([^)\n]*\))?{S})?)enum{S}(?P<name>\w+)"),
            _p("trait", "trait", rf"(?P<mods>(?:pub(?:\([^)\n]*\))?{S})?(?:unsafe{S})?)trait{S}(?P<name>\w+)"),
            _p("impl", "class", rf"(?P<mods>(?:unsafe{S})?)impl{GEN}{S}(?P<name>[\w:<>, '&]+?){H}(?:where\b|\{{)"),
            _p("mod", "class", rf"(?P<mods>(?:pub(?:\([^)\n]*\))?{S})?)mod{S}(?P<name>\w+)"),
            _p("const", "constant", rf"(?P<mods>(?:pub(?:\([^)\n]*\))?{S})?)(?:const|static){S}(?:mut{S})?(?P<name>[A-Z_]\w*){H}:", "line"),
            _p("macro", "function", rf"macro_rules!{S}(?P<name>\w+)"),
        ),
        (_i("use", rf"(?:pub(?:\([^)\n]*\))?{S})?use{S}(?P<names>[^;]+);"),),
        "pub",
        "private",
    )
)
register(
    Language(
        "golang",
        (
            _p("method", "method", rf"func{H}\((?P<receiver>[^)\n]*)\){H}(?P<name>\w+)"),
            _p("function", "function", rf"func{S}(?P<name>\w+){H}[\[(]"),
            _p("struct", "struct", rf"type{S}(?P<name>\w+)(?:\[[^\]\n]*\])?{S}struct\b"),
            _p("interface", "interface", rf"type{S}(?P<name>\w+)(?:\[[^\]\n]*\])?{S}interface\b"),
            _p("alias", "class", rf"type{S}(?P<name>\w+){S}(?:={H})?(?!struct\b|interface\b)[\w\[*.]", "line"),
            _p("var", "variable", rf"var{S}(?P<name>\w+)", "line"),
            _p("const", "constant", rf"const{S}(?P<name>\w+)", "line"),
            _p("var_block", "variable", rf"(?P<name>var){H}\(", "paren"),
            _p("const_block", "constant", rf"(?P<name>const){H}\(", "paren"),
        ),
        (_i("import", rf"import{S}(?P<alias>[\w.]+{S})?\"(?P<source>[^\"\n]+)\""), _i("import_block", rf"import{H}\((?P<block>[^)]*)\)")),
        "case",
    )
)
register(
    Language(
        "java",
        (
            _p("class", "class", rf"{_MODS}class{S}(?P<name>\w+)"),
            _p("interface", "interface", rf"{_MODS}interface{S}(?P<name>\w+)"),
            _p("enum", "enum", rf"{_MODS}enum{S}(?P<name>\w+)"),
            _p("record", "class", rf"{_MODS}record{S}(?P<name>\w+){H}{GEN}{H}\("),
            _p("method", "method", rf"(?!return\b|new\b|else\b|throw\b){_MODS}(?:{GEN}{H})(?!return\b|new\b|else\b|throw\b|public\b|private\b|protected\b|static\b|final\b){_JAVA_TYPE}{S}(?P<name>\w+){H}\([^;{{}}]*\)(?:{H}throws{S}[\w., ]+)?{H}(?:\{{|;|\n[ \t]*\{{)"),
            _p("constructor", "method", rf"(?P<mods>(?:(?:public|private|protected){S})?)(?P<name>[A-Z]\w*){H}\([^;{{}}]*\)(?:{H}throws{S}[\w., ]+)?{H}\{{"),
            _p("field", "variable", rf"(?P<mods>(?:(?:public|private|protected|static|final|transient|volatile){S})+){_JAVA_TYPE}{S}(?P<name>\w+){H}(?:=[^;\n]*)?;", "line"),
            _p("annotation", "class", rf"(?P<mods>(?:public{S})?)@interface{S}(?P<name>\w+)"),
        ),
        (_i("package", rf"package{S}(?P<source>[\w.]+){H};"), _i("static_import", rf"import{S}static{S}(?P<source>[\w.*]+){H};"), _i("import", rf"import{S}(?!static\b)(?P<source>[\w.*]+){H};")),
        "words",
        "internal",
    )
)
register(
    Language(
        "kotlin",
        (
            _p("class", "class", rf"{_MODS}class{S}(?P<name>\w+)"),
            _p("interface", "interface", rf"{_MODS}(?:fun{S})?interface{S}(?P<name>\w+)"),
            _p("object", "class", rf"{_MODS}object{S}(?P<name>\w+)"),
            _p("companion", "class", rf"(?P<name>companion){S}object\b"),
            _p("fun", "function", rf"{_MODS}fun{S}(?:{GEN}{S})?(?:[\w<>?]+\.)?(?P<name>\w+){H}\("),
            _p("property", "variable", rf"{_MODS}va[lr]{S}(?P<name>\w+)", "line"),
        ),
        (_i("package", rf"package{S}(?P<source>[\w.]+)"), _i("import", rf"import{S}(?P<source>[\w.*]+)(?:{S}as{S}(?P<alias>\w+))?")),
    )
)
register(Language("c", _C, _C_IMPORTS, "static"))
register(
    Language(
        "cpp",
        _C
        + (
            _p("class", "class", rf"(?:template{H}<[^>\n]*>{H}\n?[ \t]*)?class{S}(?P<name>\w+)(?:{S}final)?(?:{H}:[^{{;\n]+)?{H}(?:\n[ \t]*)?\{{"),
            _p("namespace", "namespace", rf"(?:inline{S})?namespace{S}(?P<name>[\w:]+){H}\{{"),
            _p("constructor", "method", rf"(?P<mods>(?:explicit{S})?)(?P<name>~?[A-Z]\w*){H}\([^;{{}}\n]*\){H}(?::[^{{;\n]+)?(?:\{{|;|={H}default)"),
        ),
        _C_IMPORTS + (_i("using_namespace", rf"using{S}namespace{S}(?P<source>[\w:]+){H};"), _i("using", rf"using{S}(?!namespace\b)(?P<source>[\w:]+){H};")),
        "section",
        "private",
    )
)
register(
    Language(
        "csharp",
        (
            _p("namespace", "namespace", rf"namespace{S}(?P<name>[\w.]+)"),
            _p("class", "class", rf"{_MODS}(?:class|record){S}(?P<name>\w+)"),
            _p("interface", "interface", rf"{_MODS}interface{S}(?P<name>\w+)"),
            _p("struct", "struct", rf"{_MODS}struct{S}(?P<name>\w+)"),
            _p("enum", "enum", rf"{_MODS}enum{S}(?P<name>\w+)"),
            _p("property", "variable", rf"{_MODS}(?!return\b|new\b|class\b|namespace\b)[\w.<>?\[\], ]+?{S}(?P<name>\w+){H}\{{{H}(?:get|set|init)\b", "line"),
            _p("method", "method", rf"{_MODS}(?!return\b|new\b|else\b|throw\b|await\b)[\w.]+(?:<[^>\n]*>)?(?:\[\])?\??{S}(?P<name>\w+){H}(?:<[^>\n]*>)?\([^;{{}}]*\){H}(?:where[^{{\n]*)?(?:\n[ \t]*)?(?:\{{|=>|;)"),
            _p("field", "variable", rf"(?P<mods>(?:(?:public|private|protected|internal|static|readonly|const|volatile){S})+)[\w.<>?\[\], ]+?{S}(?P<name>\w+){H}(?:=[^;\n]*)?;", "line"),
            _p("attribute", "class", r"\[(?P<name>[A-Z]\w*)(?:\([^\]\n]*\))?\][ \t]*$", "line"),
        ),
        (_i("static_using", rf"using{S}static{S}(?P<source>[\w.]+){H};"), _i("using", rf"using{S}(?!static\b)(?:(?P<alias>\w+){H}={H})?(?P<source>[\w.<>]+){H};")),
        "words",
        "internal",
    )
)
register(
    Language(
        "swift",
        (
            _p("func", "function", rf"(?P<attrs>(?:@\w+{S})*){_MODS}func{S}(?P<name>\w+|[+\-*/=<>!]+){H}(?:<[^>\n]*>)?\("),
            _p("class", "class", rf"(?P<mods>(?:(?:public|private|open|internal|fileprivate|final){S})*)class{S}(?!func\b|var\b)(?P<name>\w+)"),
            _p("struct", "struct", rf"{_MODS}struct{S}(?P<name>\w+)"),
            _p("protocol", "interface", rf"{_MODS}protocol{S}(?P<name>\w+)"),
            _p("enum", "enum", rf"(?P<mods>(?:(?:public|private|internal|fileprivate|indirect){S})*)enum{S}(?P<name>\w+)"),
            _p("extension", "class", rf"{_MODS}extension{S}(?P<name>[\w.]+)"),
            _p("property", "variable", rf"{_MODS}(?:var|let){S}(?P<name>\w+)", "line"),
            _p("init", "method", rf"(?P<mods>(?:(?:public|private|convenience|required|override){S})*)(?P<name>init)[?!]?{H}\("),
        ),
        (_i("import_kind", rf"import{S}(?:class|struct|func|enum|protocol|var|let|typealias){S}(?P<source>[\w.]+)"), _i("import", rf"(?:@testable{S})?import{S}(?!class\b|struct\b|func\b|enum\b|protocol\b|var\b|let\b|typealias\b)(?P<source>[\w.]+)")),
        "words",
        "internal",
    )
)
register(
    Language(
        "ruby",
        (
            _p("class", "class", rf"class{S}(?P<name>[A-Z][\w:]*)", "end"),
            _p("module", "module", rf"module{S}(?P<name>[A-Z][\w:]*)", "end"),
            _p("def", "method", rf"def{S}(?P<mods>self\.)?(?P<name>\w+[?!=]?)", "end"),
            _p("attr", "variable", rf"attr_(?:reader|writer|accessor){S}:(?P<name>\w+)", "line"),
            _p("constant", "constant", rf"(?P<name>[A-Z][A-Z0-9_]*){H}=(?!=)", "line"),
        ),
        (
            _i("require", rf"require{S}['\"](?P<source>[^'\"\n]+)['\"]"),
            _i("require_relative", rf"require_relative{S}['\"](?P<source>[^'\"\n]+)['\"]"),
            _i("load", rf"load{S}['\"](?P<source>[^'\"\n]+)['\"]"),
            _i("include", rf"include{S}(?P<source>[A-Z][\w:]*)"),
            _i("extend", rf"extend{S}(?P<source>[A-Z][\w:]*)"),
            _i("prepend", rf"prepend{S}(?P<source>[A-Z][\w:]*)"),
        ),
        "ruby",
        "public",
        "#",
    )
)
register(
    Language(
        "php",
        (
            _p("class", "class", rf"(?P<mods>(?:(?:abstract|final|readonly){S})*)class{S}(?P<name>\w+)"),
            _p("interface", "interface", rf"interface{S}(?P<name>\w+)"),
            _p("trait", "trait", rf"trait{S}(?P<name>\w+)"),
            _p("enum", "enum", rf"enum{S}(?P<name>\w+)"),
            _p("function", "function", rf"(?P<mods>(?:(?:public|private|protected|static|abstract|final){S})*)function{S}&?(?P<name>\w+){H}\("),
            _p("property", "variable", rf"(?P<mods>(?:(?:public|private|protected|static|readonly|var){S})+)(?:\??[\w\\|]+{S})?\$(?P<name>\w+)", "line"),
            _p("const", "constant", rf"(?P<mods>(?:(?:public|private|protected|final){S})*)const{S}(?:\w+{S})?(?P<name>[A-Z_]\w*){H}=", "line"),
        ),
        (_i("namespace", rf"namespace{S}(?P<source>[\w\\]+)"), _i("use", rf"use{S}(?:function{S}|const{S})?(?P<source>[\w\\]+)(?:{S}as{S}(?P<alias>\w+))?{H};"), _i("require", rf"(?:require|include)(?:_once)?{H}\(?{H}['\"](?P<source>[^'\"\n]+)['\"]")),
    )
)
register(
    Language(
        "css",
        (
            _p("at_rule", "class", r"@(?P<name>(?:media|supports|container|layer|font-face|keyframes|-webkit-keyframes|page|mixin|include|property)[^{;\n]*?)[ \t]*\{"),
            _p("at_statement", "import", r"@(?P<name>(?:charset|namespace|use|forward)[^;\n]*);", "line"),
            _p("rule", "class", r"(?P<name>(?![@}])(?:[.#*:\[&A-Za-z][^{};@\n]*?))[ \t]*\{"),
            _p("custom_property", "variable", r"(?P<name>--[\w-]+)[ \t]*:", "line"),
            _p("scss_variable", "variable", r"(?P<name>[$@][\w-]+)[ \t]*:(?!:)", "line"),
        ),
        (
            _i("import", r"@(?:import|use|forward)[ \t]+(?:url\()?['\"]?(?P<source>[^'\")\s;]+)"),
            _i("font", r"src[ \t]*:[^;\n]*url\(['\"]?(?P<source>[^'\")\n]+\.(?:woff2?|ttf|otf|eot)[^'\")\n]*)['\"]?\)"),
            _i("data_url", r"[^\n]*url\(['\"]?(?P<source>data:[^'\")\n]{0,80})"),
            _i("resource", r"[^\n]*url\(['\"]?(?P<source>(?!data:)(?![^'\")\n]+\.(?:png|jpe?g|gif|svg|webp|avif|woff2?|ttf|otf|eot|css|scss)\b)[^'\")\n]+)['\"]?\)"),
            _i("image", r"[^\n]*url\(['\"]?(?P<source>(?!data:)[^'\")\n]+\.(?:png|jpe?g|gif|svg|webp|avif)[^'\")\n]*)['\"]?\)"),
        ),
    )
)
register(
    Language(
        "sql",
        (
            _p("table", "class", r"(?i:create)[ \t]+(?i:or[ \t]+replace[ \t]+)?(?P<mods>(?i:(?:temp(?:orary)?|external|unlogged|global|local)[ \t]+)*)(?i:table)[ \t]+(?i:if[ \t]+not[ \t]+exists[ \t]+)?(?P<name>[\w.\"`\[\]]+)", "semi"),
            _p("view", "class", r"(?i:create)[ \t]+(?i:or[ \t]+replace[ \t]+)?(?i:(?:materialized|temp(?:orary)?)[ \t]+)*(?i:view)[ \t]+(?i:if[ \t]+not[ \t]+exists[ \t]+)?(?P<name>[\w.\"`\[\]]+)", "semi"),
            _p("function", "function", r"(?i:create)[ \t]+(?i:or[ \t]+replace[ \t]+)?(?i:function|procedure)[ \t]+(?P<name>[\w.\"`]+)", "semi"),
            _p("trigger", "function", r"(?i:create)[ \t]+(?i:or[ \t]+replace[ \t]+)?(?i:trigger)[ \t]+(?P<name>[\w.\"`]+)", "semi"),
            _p("index", "variable", r"(?i:create)[ \t]+(?P<mods>(?i:unique[ \t]+)?)(?i:index)[ \t]+(?i:concurrently[ \t]+)?(?i:if[ \t]+not[ \t]+exists[ \t]+)?(?P<name>[\w.\"`]+)", "semi"),
            _p("sequence", "variable", r"(?i:create)[ \t]+(?i:sequence)[ \t]+(?P<name>[\w.\"`]+)", "semi"),
            _p("schema", "namespace", r"(?i:create)[ \t]+(?i:schema|database)[ \t]+(?i:if[ \t]+not[ \t]+exists[ \t]+)?(?P<name>[\w.\"`]+)", "semi"),
            _p("type", "struct", r"(?i:create)[ \t]+(?i:type|domain)[ \t]+(?P<name>[\w.\"`]+)", "semi"),
        ),
        (
            Import("from", re.compile(r"(?i)\bfrom[ \t]+(?P<source>[A-Za-z_][\w.]*)")),
            Import("join", re.compile(r"(?i)\bjoin[ \t]+(?P<source>[A-Za-z_][\w.]*)")),
            Import("into", re.compile(r"(?i)\binto[ \t]+(?P<source>[A-Za-z_][\w.]*)")),
            Import("update", re.compile(r"(?i)\bupdate[ \t]+(?P<source>[A-Za-z_][\w.]*)[ \t]+set\b")),
        ),
        line_comment="--",
    )
)
register(
    Language(
        "bash",
        (
            _p("function", "function", rf"function{S}(?P<name>[\w.:-]+){H}(?:\(\))?{H}\{{?", "shell"),
            _p("function", "function", rf"(?P<name>[A-Za-z_][\w.:-]*){H}\(\){H}(?:\n[ \t]*)?\{{", "shell"),
            _p("alias", "constant", rf"alias{S}(?P<name>[\w.-]+)=", "line"),
            _p("export", "variable", rf"export{S}(?P<name>\w+)", "line"),
            _p("local", "variable", rf"local{S}(?:-\w+{S})?(?P<name>\w+)", "line"),
            _p("array", "variable", rf"(?:declare{S}-[aA]{S})?(?P<name>\w+)=\(", "line"),
            _p("readonly", "constant", rf"readonly{S}(?P<name>\w+)", "line"),
            _p("variable", "variable", r"(?P<name>[A-Za-z_]\w*)\+?=(?!\()", "line"),
        ),
        (_i("source", rf"(?:source|\.){S}['\"]?(?P<source>[^\s'\";&|]+)"), _i("bash", rf"(?:bash|sh|zsh){S}['\"]?(?P<source>[^\s'\";&|-][^\s'\";&|]*)")),
        line_comment="#",
    )
)
register(
    Language(
        "dart",
        (
            _p("widget", "class", rf"class{S}(?P<name>\w+){S}extends{S}(?:Stateless|Stateful|Inherited|Consumer|Hook)Widget\b"),
            _p("state", "class", rf"class{S}(?P<name>\w+){S}extends{S}(?:Consumer)?State<"),
            _p("class", "class", rf"(?P<mods>(?:(?:abstract|sealed|base|final|interface){S})*)class{S}(?P<name>\w+)\b(?!{S}extends{S}(?:Stateless|Stateful|Inherited|Consumer|Hook)Widget\b|{S}extends{S}(?:Consumer)?State<)"),
            _p("mixin", "class", rf"mixin{S}(?P<name>\w+)"),
            _p("extension", "class", rf"extension{S}(?P<name>\w+){S}on\b"),
            _p("enum", "enum", rf"enum{S}(?P<name>\w+)"),
            _p("build", "method", rf"Widget{S}(?P<name>build){H}\("),
            _p("function", "function", rf"(?P<mods>(?:(?:static|external){S})*)(?!return\b|new\b|await\b|else\b|throw\b|class\b|enum\b)(?:[A-Z]\w*(?:<[^>\n]*>)?\??|void|int|double|bool|num|dynamic|var){S}(?P<name>(?!build\b)\w+){H}\([^;]*?\){H}(?:async\*?{H})?(?:\{{|=>)"),
            _p("field", "variable", rf"(?P<mods>(?:(?:final|const|late|static|var){S})+)(?:[\w<>?, ]+{S})?(?P<name>\w+){H}(?:=[^;\n]*)?;", "line"),
        ),
        (
            _i("flutter", rf"import{S}['\"](?P<source>package:flutter/[^'\"\n]+)['\"]"),
            _i("package", rf"import{S}['\"](?P<source>package:(?!flutter/)[^'\"\n]+)['\"](?:{S}as{S}(?P<alias>\w+))?"),
            _i("dart_core", rf"import{S}['\"](?P<source>dart:[^'\"\n]+)['\"](?:{S}as{S}(?P<alias>\w+))?"),
            _i("relative", rf"import{S}['\"](?P<source>(?!package:|dart:)[^'\"\n]+)['\"](?:{S}as{S}(?P<alias>\w+))?"),
            _i("export", rf"export{S}['\"](?P<source>[^'\"\n]+)['\"]"),
        ),
        "underscore",
    )
)
register(
    Language(
        "generic",
        (
            _p("function", "function", rf"{_MODS}(?:function|func|fn|def|sub|proc){S}(?P<name>\w+)"),
            _p("class", "class", rf"{_MODS}(?:class|struct|interface|trait){S}(?P<name>\w+)"),
            _p("enum", "enum", rf"{_MODS}enum{S}(?P<name>\w+)"),
            _p("namespace", "namespace", rf"(?:namespace|package|module){S}(?P<name>[\w.:]+){H}[{{;]?{H}$"),
            _p("constant", "constant", rf"(?:const{S}|#{H}define{S}|final{S})(?:\w+{S})?(?P<name>[A-Z_][A-Z0-9_]*)\b", "line"),
            _p("section", "namespace", r"\[(?P<name>[^\]\n]+)\][ \t]*$", "line"),
            _p("key", "variable", r"(?P<name>[A-Za-z_][\w.-]*)[ \t]*[=:](?![=:])", "line"),
            _p("heading", "namespace", r"#{1,6}[ \t]+(?P<name>[^\n]+)", "line"),
        ),
        (
            _i("include", rf"#?{H}include{S}[<\"']?(?P<source>[^>\"'\s;]+)"),
            _i("import", rf"import{S}(?P<source>[\w./:\"'-]+)"),
            _i("from", rf"from{S}(?P<source>[\w./-]+){S}import\b"),
            _i("using", rf"using{S}(?P<source>[\w.:]+)"),
            _i("require", rf"require{H}\(?{H}['\"](?P<source>[^'\"\n]+)['\"]"),
        ),
    )
)
register(Language("python", (), ()))
register(Language("html", (), ()))

BUILT_IN.update(LANGUAGES)
