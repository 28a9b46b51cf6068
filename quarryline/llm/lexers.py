"""Token streams for the grammars of this package.

Each lexer returns ``(tokens, offsets, semi)``: the terminal names the grammar
uses, the offset of each token in the text, and, for languages with automatic
semicolons, where one may be supplied.  A character no token of the language
can start with, or a literal that never ends, becomes the token ``BAD``, which
no grammar contains.
"""

from __future__ import annotations

import io
import re
import tokenize

_ID = r"[^\W\d][\w]*"


def _words(s: str) -> frozenset[str]:
    return frozenset(s.split())


# -- JSON
_JSON = re.compile(
    r"""[ \t\r\n]*(?:(?P<STR>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUM>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.]))|(?P<W>(?:true|false|null)\b)|(?P<P>[{}\[\],:])|(?P<END>$(?!\n))|(?P<BAD>.))""",
    re.S,
)


def lex_json(text: str):
    toks, at = [], []
    for m in _JSON.finditer(text):
        k = m.lastgroup
        if k == "END" or k is None:
            break
        toks.append(m.group(k) if k == "P" else "LIT" if k == "W" else k)
        at.append(m.start(k))
    return toks, at, None


# -- Python: the standard tokenizer gives names, literals, indents and f-string parts
_PY_KW = _words("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type")


_PY_SKIP = frozenset((tokenize.COMMENT, tokenize.NL, tokenize.ENCODING, tokenize.ENDMARKER))
_PY_NAME, _PY_OP = tokenize.NAME, tokenize.OP
_PY_KINDS = {
    getattr(tokenize, a): b
    for a, b in {"NUMBER": "NUM", "STRING": "STR", "NEWLINE": "NEWLINE", "INDENT": "INDENT", "DEDENT": "DEDENT", "FSTRING_START": "FS", "FSTRING_MIDDLE": "FM", "FSTRING_END": "FE"}.items()
    if hasattr(tokenize, a)
}


def lex_python(text: str):
    toks, at = [], []
    t = tokenize
    lines = [0]
    for line in text.splitlines(True) if "\r" not in text else io.StringIO(text, newline=None).read().splitlines(True):
        lines.append(lines[-1] + len(line))
    try:
        if "\x00" in text:
            raise SyntaxError
        put, put_at, most, kw = toks.append, at.append, len(lines) - 1, _PY_KW
        for y, s, (row, col), _, _ in t.generate_tokens(io.StringIO(text, newline=None).readline):
            if y in _PY_SKIP:
                continue
            put_at(lines[row - 1 if row <= most else most] + col)
            if y == _PY_NAME:
                put(s if s in kw else "NAME")
            elif y == _PY_OP:
                put(s)
            else:
                put(k := _PY_KINDS.get(y, "BAD"))
                if k == "BAD":
                    break
    except (tokenize.TokenError, SyntaxError, IndentationError, UnicodeError, ValueError):
        toks.append("BAD")
        at.append(at[-1] if at else 0)
    return toks, at, None


# -- JavaScript and TypeScript
_JS_KW = _words(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false"
    " async await of get set static let yield"
)
_TS_KW = _JS_KW | _words(
    "enum as satisfies using interface type namespace module declare abstract readonly public private protected implements is keyof infer unique asserts override accessor require global from any unknown never void out"
)
_JS_TOK = re.compile(
    r"""(?P<WS>(?:[ \t\v\f\u00a0\ufeff\u2028\u2029\r\n]+|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)+)|(?P<ID>\#?(?:[A-Za-z_$\u0080-\U0010ffff]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[\w$\u200c\u200d]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*)|(?P<NUM>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:[0-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?n?)(?![\w$]))|(?P<STR>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')|(?P<P>\.\.\.|=>|\?\?=|\?\?|\?\.(?![0-9])|\*\*=|\*\*|\+\+|--|&&=|\|\|=|&&|\|\||<<=|<<|>=|<=|===|!==|==|!=|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"""
)
_JS_RE = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_JS_TPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JS_OPERAND_END = _words("NAME NUM STR REGEX TEMPL TT ) ] } this super null true false PRIV of get set static let as type from")
_BINOPS = _words("+ - * / % & | ^ << ** && || ?? == != === !== <= >= instanceof in")
_ASSIGN = _words("+= -= *= /= %= &= |= ^= <<= **= &&= ||= ??=")


#: signs that stand for a class of signs, all others for themselves
_JS_SIGNS = {**dict.fromkeys(_BINOPS - _words("+ - * | & < >= in instanceof"), "BINOP"), **dict.fromkeys(_ASSIGN, "ASSIGN"), "++": "INC", "--": "INC"}


def _lex_js(text: str, kw: frozenset[str]):
    toks: list[str] = []
    at: list[int] = []
    semi: list[bool] = []
    braces: list[bool] = []
    pos, n, nl, last = 0, len(text), False, ""
    signs = _JS_SIGNS
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else n
    match = _JS_TOK.match
    while pos < n:
        c = text[pos]
        if c == "`" or (c == "}" and braces and braces[-1]):
            head = c == "`"
            m = _JS_TPL.match(text, pos + 1)
            end = m.end()
            if end < n and text[end] == "`":
                tok = "TEMPL" if head else "TT"
                if not head:
                    braces.pop()
                end += 1
            elif text.startswith("${", end):
                tok = "TH" if head else "TM"
                if head:
                    braces.append(True)
                end += 2
            else:
                tok = "BAD"
            toks.append(tok)
            at.append(pos)
            semi.append(nl)
            nl = False
            last = tok
            pos = end
            if tok == "BAD":
                break
            continue
        m = None
        if c == "/" and last not in _JS_OPERAND_END and text[pos + 1 : pos + 2] not in ("/", "*"):
            m = _JS_RE.match(text, pos)
            if m:
                toks.append("REGEX")
                at.append(pos)
                semi.append(nl)
                nl, last, pos = False, "REGEX", m.end()
                continue
        m = match(text, pos)
        if m is None:
            toks.append("BAD")
            at.append(pos)
            semi.append(nl)
            break
        k = m.lastgroup
        s = m.group()
        pos = m.end()
        if k == "WS":
            if "\n" in s or "\r" in s or "\u2028" in s or "\u2029" in s:
                nl = True
                if last in ("return", "break", "continue", "throw"):
                    toks.append("ASI")
                    at.append(m.start())
                    semi.append(False)
                    last = ";"
            continue
        if k == "ID":
            if s[0] == "#":
                tok = "PRIV"
            elif s in kw:
                tok = s
            else:
                tok = "NAME"
        elif k == "P":
            tok = signs.get(s, s)
            if s == "{":
                braces.append(False)
            elif s == "}":
                if braces:
                    braces.pop()
            elif s == ">=" and kw is _TS_KW:
                tok, pos = ">", pos - 1  # closes type arguments or is joined again by the grammar
            elif tok == "INC" and nl and last in _JS_OPERAND_END:
                toks.append("ASI")
                at.append(m.start())
                semi.append(False)
                nl = False
        else:
            tok = k
        toks.append(tok)
        at.append(m.start())
        semi.append(nl or tok == "}")
        nl = False
        last = tok
    semi.append(True)
    return toks, at, semi


def lex_javascript(text: str):
    return _lex_js(text, _JS_KW)


def lex_typescript(text: str):
    return _lex_js(text, _TS_KW)


# -- Go
_GO_KW = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
_GO_TOK = re.compile(
    r"""(?P<WS>(?:[ \t\r]+|//[^\n]*)+)|(?P<NL>\n)|(?P<CM>/\*(?:[^*]|\*(?!/))*\*/)|(?P<ID>[^\W\d]\w*)|(?P<NUM>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)i?(?!\w))|(?P<STR>"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))*"|`[^`]*`)|(?P<CHR>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))')|(?P<P><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|<<|>>|&\^|[-+*/%&|^]=|[-+*/%&|^<>=!()\[\]{},;.:~])"""
)
_GO_BIN = _words("|| && == != < <= > >= / % << >> &^")
_GO_ASG = _words("+= -= *= /= %= &= |= ^= <<= >>= &^=")
_GO_END = _words("NAME NUM STR CHR break continue fallthrough return INC ) ] }")


def lex_go(text: str):
    toks, at = [], []
    pos, n, last = 0, len(text), ""
    match = _GO_TOK.match
    while pos < n:
        m = match(text, pos)
        if m is None:
            toks.append("BAD")
            at.append(pos)
            return toks, at, None
        k, s, pos = m.lastgroup, m.group(), m.end()
        if k == "WS":
            continue
        if k == "NL" or (k == "CM" and "\n" in s):
            if last in _GO_END:
                toks.append(";")
                at.append(m.start())
                last = ";"
            continue
        if k == "CM":
            continue
        if k == "ID":
            tok = s if s in _GO_KW else "NAME"
        elif k == "P":
            tok = "BIN" if s in _GO_BIN else "ASG" if s in _GO_ASG else "INC" if s in ("++", "--") else s
        elif k == "CHR":
            tok = "NUM"
        else:
            tok = k
        toks.append(tok)
        at.append(m.start())
        last = tok
    if last in _GO_END:
        toks.append(";")
        at.append(n)
    return toks, at, None


# -- Java
_JAVA_KW = _words(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
    " var record sealed permits yield non when module open requires exports opens uses provides to with transitive"
)
_JAVA_TOK = re.compile(
    r'''(?P<WS>(?:[ \t\f\r\n]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)+)|(?P<ID>[^\W\d$][\w$]*|\$[\w$]*)|(?P<NUM>(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)[lLfFdD]?(?![\w$]))|(?P<TXT>"""[ \t\f]*\r?\n(?:[^\\"]|\\[\s\S]|"(?!""))*""")|(?P<STR>"(?:[^"\\\n]|\\(?:[btnfrs0-7"'\\]|u+[0-9a-fA-F]{4}))*")|(?P<CHR>'(?:[^'\\\n]|\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))')|(?P<P>->|::|\.\.\.|\+\+|--|&&|\|\||==|!=|<=|>=|<<=|<<|[-+*/%&|^]=|[-+*/%&|^<>=!~?:;,.()\[\]{}@])'''
)
_JAVA_BIN = _words("|| && == != <= / % ^ <<")
_JAVA_ASG = _words("+= -= *= /= %= &= |= ^= <<=")


def lex_java(text: str):
    return _plain(text, _JAVA_TOK, _JAVA_KW, _JAVA_BIN, _JAVA_ASG, {"TXT": "LIT", "STR": "LIT", "CHR": "LIT", "NUM": "LIT"})


def _plain(text, rx, kw, bins, asg, names):
    toks, at = [], []
    pos, n = 0, len(text)
    match = rx.match
    if text.startswith("\ufeff"):
        pos = 1
    while pos < n:
        m = match(text, pos)
        if m is None:
            toks.append("BAD")
            at.append(pos)
            break
        k, s, pos = m.lastgroup, m.group(), m.end()
        if k == "WS":
            continue
        if k == "ID":
            tok = s if s in kw else "NAME"
        elif k == "P":
            tok = "BIN" if s in bins else "ASG" if s in asg else "INC" if s in ("++", "--") else s
        else:
            tok = names.get(k, k)
        toks.append(tok)
        at.append(m.start())
    return toks, at, None


# -- Rust
_RUST_KW = _words(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union default macro_rules auto yield"
)
_RUST_TOK = re.compile(
    r"""(?P<WS>(?:[ \t\f\r\n\u0085\u200e\u200f\u2028\u2029]+|//[^\n]*)+)|(?P<STR>(?:b|c)?"(?:[^"\\]|\\[\s\S])*")|(?P<RAW>(?:br|cr|r)(?P<H>\#*)"[\s\S]*?"(?P=H))|(?P<CHR>b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')|(?P<LIFE>'(?:r\#)?[^\W\d]\w*(?!'))|(?P<ID>(?:r\#)?[^\W\d]\w*)|(?P<NUM>0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)|0o[0-7_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)|0b[01_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)|[0-9][0-9_]*(?:(?:\.[0-9][0-9_]*)?(?:[eE][+-]?_*[0-9][0-9_]*)?(?:(?:[iu](?:8|16|32|64|128|size)|f32|f64))?(?!\w)|\.(?![.\w])))|(?P<P>\.\.\.|\.\.=|\.\.|::|->|=>|&&|\|\||==|!=|<=|>=|<<=|<<|[-+*/%&|^]=|[-+*/%&|^<>=!~?:;,.()\[\]{}@\#$])"""
)
_RUST_BIN = _words("== != <= << / % ^")
_RUST_ASG = _words("+= -= *= /= %= &= |= ^= <<=")


def lex_rust(text: str):
    toks, at = [], []
    pos, n = 0, len(text)
    match = _RUST_TOK.match
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        pos = text.find("\n") if "\n" in text else n
    while pos < n:
        if text.startswith("/*", pos):
            depth, p = 1, pos + 2
            while depth:
                a, b = text.find("/*", p), text.find("*/", p)
                if b < 0:
                    break
                if 0 <= a < b:
                    depth, p = depth + 1, a + 2
                else:
                    depth, p = depth - 1, b + 2
            if depth:
                toks.append("BAD")
                at.append(pos)
                break
            pos = p
            continue
        m = match(text, pos)
        if m is None:
            toks.append("BAD")
            at.append(pos)
            break
        k, s, pos = m.lastgroup, m.group(), m.end()
        if k == "WS":
            continue
        if k == "ID":
            tok = s if s in _RUST_KW or s == "_" else "NAME"
        elif k == "P":
            tok = "BIN" if s in _RUST_BIN else "ASG" if s in _RUST_ASG else s
        elif k in ("STR", "RAW", "CHR"):
            tok = "STR"
        else:
            tok = k
        toks.append(tok)
        at.append(m.start())
    return toks, at, None
