"""Compiled parsers of the bundled grammars."""

from __future__ import annotations

import re
from functools import lru_cache
from importlib import resources

from . import lexers
from .glr import Grammar, recognise

#: file suffix -> grammar
LANGUAGE_OF_SUFFIX = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "rs": "rust", "json": "json"}
_LEX = {
    "json": lexers.lex_json,
    "python": lexers.lex_python,
    "javascript": lexers.lex_javascript,
    "typescript": lexers.lex_typescript,
    "go": lexers.lex_go,
    "java": lexers.lex_java,
    "rust": lexers.lex_rust,
}


def _alternatives(words) -> str:
    return " | ".join(f"'{w}'" for w in sorted(words))


@lru_cache(None)
def grammar(language: str) -> Grammar:
    """Parse table of a language, built once per process from its grammar text."""
    text = resources.files(__package__).joinpath("grammars", f"{language}.gram").read_text()
    if language in ("javascript", "typescript"):
        kw = lexers._JS_KW if language == "javascript" else lexers._TS_KW
        soft = set(re.findall(r"'(\w+)'", re.search(r"(?s)(?:soft|ident) : (.*?);", text)[1]))
        text += f"\nplainkw : {_alternatives(kw - soft - {'enum', 'void'} if language == 'typescript' else kw - soft)} ;"
        text = text.replace("PLAINKW", "plainkw")
    if language == "rust":
        text = text.replace("ANYKW", "anykw") + f"\nanykw : {_alternatives(lexers._RUST_KW)} ;"
    return Grammar(text)


def first_error(language: str, text: str | None) -> tuple[int, str] | None:
    """Line (from 1) and text of the first token no reading accepts; None if the text is valid.

    Null and blank texts are valid.
    """
    if text is None or not text.strip():
        return None
    toks, at, semi = _LEX[language](text)
    bad = recognise(grammar(language), toks, semi)
    if bad < 0:
        return None
    if bad >= len(toks):
        return text.count("\n") + 1, "<end>"
    pos = at[bad] if bad < len(at) else len(text)
    return text.count("\n", 0, pos) + 1, text[pos : pos + 24].split("\n")[0] or toks[bad]
