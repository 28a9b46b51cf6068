"""Credentials in source, settings and prose (problem 6).

A keyword automaton reads each text once; texts and lines without a keyword
need no further work.  Issuer formats, key blocks, connection texts, headers
and assignments are then matched on the lines that hold a hit, each match is
checked by structure (length, alphabet, mixture of characters, no placeholder,
no reference), and the value is replaced by a placeholder of the same length
and alphabet, so code keeps its shape.

Defined results: null and empty texts hold nothing and stay as they are; a
line with several secrets gives one row; a private key counts at its first
line, and the whole of its body is replaced.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrow import arrow_udf

#: fixed values: words one of which stands on every line that can hold a secret
KEYWORDS = (
    "pass pw secret token key credential bearer auth login connect open( session( dial( bind( --with curl authorization basic dsn connection identified :// "
    "private akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xox sk- sk_ rk_ aiza eyj npm_ pypi- sg. hf_ dop_v1_ shp -u pin salt"
).split() + ["open as", "session as"]
#: fixed values: issuer formats
ISSUERS = (
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{50,}",
    r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}",
    r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{16,}",
    r"(?<![A-Za-z0-9_-])sk-(?:[a-z]+-)?[A-Za-z0-9_-]{32,}",
    r"(?<![A-Za-z0-9])(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}",
    r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])pypi-[A-Za-z0-9_-]{32,}",
    r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"(?<![A-Za-z0-9])hf_[A-Za-z0-9]{30,}",
    r"(?<![A-Za-z0-9])dop_v1_[0-9a-f]{64}(?![0-9a-f])",
    r"(?<![A-Za-z0-9])shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}(?![0-9a-fA-F])",
)
_ISSUER = re.compile("|".join(ISSUERS))
# values have no greatest length; where one may run to the end of the line, its end is looked up once for all that share it; only values nested in one another are read again
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_SCHEME = re.compile(r"\b[a-z]")
_SCHEME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_USER_END = re.compile(r"[\s:/@\"'`<>]")
_PASS_END = re.compile(r"[\s@\"'`]")
_HOST = re.compile(r"[\w\[$<{.-]")
_HEADER = re.compile(
    r"(?i)\b(?:authorization|proxy-authorization)\s*+[\"']?\s*+[:=,]\s*+[\"']?(?:bearer|basic|token|apikey)\s++([^\s\"'`,;)]++)|\b(?:bearer|basic)\s++([A-Za-z0-9+/=._~-]{16,}+)"
)
_LETTERS = re.compile(r"(?i)[a-z-]*+")
_CUSTOM_REST = re.compile(r"\s*+[\"']?\s*+[:=,]\s*+[\"']?([^\s\"'`,;)]++)")
_CUSTOM_ENDS = ("key", "token", "secret", "auth")
_CALL = re.compile(r"(?i)\b(?:auth|login|log_in|sign_?in|authenticate|connect|basic_?auth|open|dial|bind|session|set_?credentials|credentials|set_?password|with_?password)\s*+\(\s*+")
_LAST_ARG = re.compile(r"(?:\"([^\"\s]++)\"|'([^'\s]++)'|`([^`\s]++)`)(?:\.to_string\(\)|\.into\(\))?\s*+\)")
_ARG = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|`[^`]*+`|[\w.]++)\s*+,\s*+")
_FLAG = re.compile(r"(?i)(?:--?(?:password|passwd|pass|token|secret|api-?key)[= ]|\bsshpass -p ?|\s-u ?[\w.-]++:|\bidentified by |\bpassword (?=['\"]))(?:\"([^\"\s]++)\"|'([^'\s]++)'|([^\s\"';]++))")
# a name of a secret, then an optional type, a separator, an optional wrapper and the value; nothing here is read twice from one name, and no two names share more than a value's ends
_RUN = re.compile(r"[\w$.\-]++")
_NAME = re.compile(r"[A-Za-z_$][\w$.\-]*+")
_TWO_WORDS = ("key", "token", "secret", "password", "passphrase")
_ASSIGNED = re.compile(
    r"[\"'`]?\s*+\]?\s*+\)?(?:\s*+:\s*+(?:&?(?:'static\s++)?[A-Za-z_](?:[\w.<>\[\]|]*+(?: ++[\w.<>\[\]|]++)*+))?(?=\s*+(?:=|:|\?\?=|,)))?\s*+(?:=>|:=|\?\?=|\|\|=|==?|:|,)\s*+"
    r"(?:(?:concat!|dict|dictionary|Some|String::from|SecretStr|new\s++\w++|str|bytes|b|r|f|u)?\s*+[\(\{\[]\s*+)*+(?:[\"'`]?(?:value|default|secret|val|password|token)[\"'`]?\s*+[:=]\s*+)?(?:[bru]{1,2}(?=[\"'`]))?"
    r"(?:\"([^\"\\]*+(?:\\.[^\"\\]*+)*+)\"|'([^'\\]*+(?:\\.[^'\\]*+)*+)'|`([^`]*+)`|([^\s\"'`,;(){}\[\]<>$]))"
)
# of a value without quotes the first character is matched, the rest goes up to one of these
_BARE_END = re.compile(r"[\s\"'`,;()<>{}]")
_CALLED = re.compile(r"\s*+\(")
_MORE = re.compile(r"\s*+[+,.]?\s*+(?:\"([^\"]*+)\"|'([^']*+)')")
_PROSE = re.compile(
    r"(?i)((?:password|passphrase|passwd|pass|pwd|pw|secret|token|(?:api|access|private|signing|deploy) key|credentials?|bearer|login)(?: (?:label|hint|field|kind|help|name|id|url|policy|type))?)"
    r"(?:(?: (?:on|for|of|in|to|from) (?:the |our |this )?[\w-]++(?: [\w-]++){0,3}?)? (?:is|was|are|be|=|being|now) (?:still |now |just |set to )?|:? ++)[`'\"]?([^\s`'\"]++)"
)
_PROSE_KEY = re.compile(r"\b(?:pass|pwd|pw|secret|token|api|access|private|signing|deploy|credential|bearer|login)")
#: fixed values: words that make a name a secret, and words that make it speak about one
_SECRET_WORDS = frozenset("password passwd passphrase passcode pass pwd pw secret secrets token credential credentials bearer apikey authkey accesskey secretkey privatekey passwort contrasena".split())
_KEY_OF = frozenset("api access private signing deploy secret encryption auth master service account storage shared license licence ssh hmac webhook llm".split())
_ABOUT = frozenset(
    "hint label help kind name names field url uri link type policy length len min max ttl limit public id ids count file path dir env ref prompt message regex pattern placeholder rotation expiry expires "
    "index size number num docs doc title text desc description checksum hash digest sha md5 fingerprint version header format prefix suffix tokens count column input usage cost budget per kinds vocab page next cursor csrf".split()
)
#: fixed values: names whose value may be a user and a password joined by a colon
_PAIR_NAMES = frozenset("auth connect connection login basic creds account userpass user upstream broker dsn proxy".split())
_PAIR = re.compile(r"[\"'`]?\s*+\]?(?:\s*+:\s*+&?(?:'static\s++)?\w++(?=\s*+[:=]))?\s*+[:=]\s*+(?:dict\(value=|\{\s*+value:\s*+)?[\"'`]?[A-Za-z][\w.-]*+:(?!//)([^\s\"'`,;:]{6,}+)")
_DB_USER = re.compile(r"(?i)(?:\s-u[ =]?|--user[ =])(?=\S)")
_BLANK = re.compile(r"\s|\Z")
_DB_PASS = re.compile(r"(?i)(?:\s-p ?|--pass(?:word)?[ =])(?:\"([^\"\s]+)\"|'([^'\s]+)'|([^\s\"';]+))")
_LOGIN = re.compile(r"(?i)\b(?:log-?in|open|auth|connect|sign-?in|session|bind)(?::| as|) ++[\w.@-]++ *+/ *+(\S++)|--with[= ]++(\S++)|\bkey is ++[`'\"]?([^\s`'\"]++)|\bpass(?:word)?/user: *+[^\s/]++ *+/ *+(\S++)")
#: what every name of a secret holds
_NAME_RX = re.compile("pass|pw|secret|token|credential|bearer|key|login|contrasena")
_PAIR_RX = re.compile("|".join(sorted(_PAIR_NAMES)))
# a value that begins so, or is so, is a reference or a placeholder; beginnings decide without the rest being read
_BEGINS = re.compile(
    r"(?i)\$|%\(\w++\)[sd]|\{\{|env[:.(]|vault[:/]|secret[:/]|ref[:/]|arn:|file:|ssm:|aws:|gcp:|azure:|op://|keyring:|process\.env|os\.(?:environ|getenv)|System\.getenv|getenv|config\.|settings\.|self\.|this\.|std::env"
    r"|change[-_]?me|replace|your|todo|example|placeholder|redacted|insert|none\b|(?:fill|enter|put)(?:[-_. ]|your|here|the|some|me|in[-_]|\Z)"
)
_WHOLE = re.compile(
    r"(?i)(?:(?-i:%[A-Z_][A-Z0-9_]*+%)|%[sdv]|<[^>]*+>?|<.*+(?<=>)|\{[^}]*+\}|\[.*+(?<=\])|(.)\1{3,}+|x{3}[\w-]*+|\*++|\.++|-++|_++|my[-_]?(?:secret|password|token|key)"
    r"|tbd|fixme|null|nil|undefined|true|false|yes|no|on|off|empty|dummy|sample|hidden|masked|removed|secret|password|token|string|str|not[-_ ]?set|test)\Z"
)
# a value that begins so, or is so, is an address, a path, a figure, a checksum, a name or plain words
_BEGINS_PLAIN = re.compile(r"(?i)https?://|\.{1,2}/|(?:sha\d++|md5)[-:]|ssh-(?:rsa|ed25519|dss)|data:")
_PLAIN = re.compile(
    r"(?:(?i:[\w-]++\.(?:py|js|ts|go|rs|java|json|ya?ml|toml|txt|md|pem|key|crt|env|html?|example\S*+)|\d++(?:\.\d++)*+|v\d++(?:\.\d++)++|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
    r"|(?:/(?:[a-z0-9_.-]++|[A-Z][a-z_.-]++))++/?|[a-z]++(?:[_-][a-z]++)*+|[A-Z]++(?:_[A-Z]++)*+|[A-Z][A-Z0-9]*+(?:_[A-Z0-9]++)++|[A-Za-z]++\.[A-Za-z_.]++|(?:[A-Z]?[a-z]++){1,4}|[a-z]++(?:_[a-z]++)*+_\d{1,2})\Z"
)
_DOTTED = re.compile(r"(?i)[a-z_]\w*+(?:\.\w++)++\Z")
_URL_NONE = re.compile(r"(?i)(?:pass|pwd|\{.*+(?<=\}))\Z")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def is_secret_name(name: str) -> bool:
    """Whether a name stands for a secret itself, not for something about one."""
    ws = name_words(name)
    if any(w in _ABOUT for w in ws):
        return False
    if any(w in _SECRET_WORDS for w in ws):
        return True
    return any(a in _KEY_OF and b in ("key", "keys") for a, b in zip(ws, ws[1:]))


def _entropy(v: str | Counter) -> float:
    counts = Counter(v) if isinstance(v, str) else v
    n = sum(counts.values())
    return -sum(k / n * math.log2(k / n) for k in counts.values())


def is_value(v: str, least: int = 6, start: int = 0, end: int | None = None, counts: Counter | None = None) -> bool:
    """Whether a literal can be a secret: no placeholder, reference, path or plain word.

    The literal is ``v`` from ``start`` to ``end``; ``counts`` holds its
    characters where the caller has them already.
    """
    if end is None:
        v = v.strip()
        end = len(v)
    if end - start < least or any(rx.match(v, start, end) for rx in (_BEGINS, _WHOLE, _BEGINS_PLAIN, _PLAIN)):
        return False
    if counts is None:
        if " " in v or "${" in v or "{{" in v or v.endswith("("):
            return False
        counts = Counter(v)
    chars = "".join(counts)
    classes = bool(re.search(r"[a-z]", chars)) + bool(re.search(r"[A-Z]", chars)) + bool(re.search(r"\d", chars)) + bool(re.search(r"[^\w]|_", chars))
    return classes >= 2 and _entropy(counts) >= 2.0


_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})")


def has_checksum(token: str) -> bool:
    """Whether the last six characters are the CRC-32 of the body in base 62, as these issuers write it."""
    m = _CHECKED.fullmatch(token)
    if not m:
        return False
    n, digits = zlib.crc32(m[1].encode()), ""
    while n:
        n, k = divmod(n, 62)
        digits = _DIGITS62[k] + digits
    return digits.rjust(6, "0") == m[2]


def is_issued(token: str) -> bool:
    """A token of an issuer's format: its checksum holds, its first part is a signed header, or its body looks random."""
    if has_checksum(token):
        return True
    if token.startswith("eyJ"):
        head = token.partition(".")[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, TypeError):
            pass
    body = re.sub(r"^[A-Za-z]{2,10}[-_.]", "", token)
    return _entropy(body) >= 2.5 and not re.search(r"(?i)(.)\1{7}|example|xxxx", body)


class _Ends:
    """Where a pattern of one character comes next in a line; asked in rising order, each character is read once."""

    def __init__(self, rx: re.Pattern, line: str):
        self.rx, self.line, self.asked, self.end = rx, line, 0, -1

    def after(self, i: int) -> int:
        if not self.asked <= i <= self.end:
            m = self.rx.search(self.line, i)
            self.asked, self.end = i, m.start() if m else len(self.line)
        return self.end


def _url_passwords(line: str):
    """Spans between a user and ``@`` of scheme://user:password@host."""
    stop, done, i = _Ends(_PASS_END, line), 0, line.find("://")
    while i >= 0:
        u, a = _USER_END.search(line, i + 3), i
        while a > done and line[a - 1] in _SCHEME_CHARS:
            a -= 1
        if u and u[0] == ":" and _SCHEME.search(line, a, i):
            e = stop.after(u.end())
            if e > u.end() and line.startswith("@", e) and _HOST.match(line, e + 1):
                yield u.end(), e
                done = i = e + 1
                i = line.find("://", i)
                continue
        done, i = i + 3, line.find("://", i + 3)


def _db_passwords(line: str):
    """Spans of the password after a user, both as flags: the first behind the word of the user, else the last glued to it."""
    pos = 0
    while (u := _DB_USER.search(line, pos)) and (m := _DB_PASS.search(line, u.end() + 1)):
        word = _BLANK.search(line, u.end()).start()
        if m.start() < word:
            m = _DB_PASS.search(line, word) or next(x for i in range(word - 1, u.end(), -1) if (x := _DB_PASS.match(line, i)))
        yield m.span(next(i for i in (1, 2, 3) if m[i] is not None))
        pos = m.end()


def _bare_spans(line: str, starts: list[int], end: int) -> list[tuple[int, int]]:
    """Of values without quotes that end at one place the longest that can be a secret; each character is counted once."""
    if _CALLED.match(line, end):
        return []
    out, counts, right = [], Counter(), end
    low = min(starts)
    # a value that holds one of these is none
    begin = max(line.rfind("-----BEGIN", low, end), line.rfind("${", low, end), line.rfind("{{", low, end))
    for a in sorted(set(starts), reverse=True):
        counts.update(line[a:right])
        right = a
        if begin < a and not _DOTTED.match(line, a, end) and is_value(line, start=a, end=end, counts=counts):
            out = [(a, end)]
    return out


def _call_spans(line: str):
    """Last arguments of calls that log in or connect; an argument two calls share is read once."""
    last: dict[int, tuple[int, int] | None] = {}
    for m in _CALL.finditer(line):
        at, seen = m.end(), []
        while at not in last:
            seen.append(at)
            if x := _LAST_ARG.match(line, at):
                last[at] = x.span(x.lastindex)
            elif x := _ARG.match(line, at):
                at = x.end()
            else:
                last[at] = None
        for i in seen:
            last[i] = last[at]
        if last[at]:
            yield last[at]


def _custom_spans(line: str):
    """Values of headers named x-...-key, -token, -secret or -auth."""
    done = 0
    for m in re.finditer(r"(?i)\bx-", line):
        if m.start() < done:
            continue
        done = _LETTERS.match(line, m.end()).end()
        if line[m.end() : done].lower().endswith(_CUSTOM_ENDS) and (x := _CUSTOM_REST.match(line, done)):
            yield x.span(1)


def _run_start(line: str, i: int, least: int) -> int:
    while i > least and (line[i - 1].isalnum() or line[i - 1] in "_$.-"):
        i -= 1
    return i


def _names(line: str, low: str, parts: re.Pattern):
    """(name, end) of the words of a line that hold one of the parts; a word such as key takes the word before it along."""
    pos = 0
    while m := parts.search(low, pos):
        a = _run_start(line, m.start(), pos)
        pos = _RUN.match(line, a).end()
        if not (name := _NAME.search(line, a, pos)):
            continue
        word = name[0]
        if word in _TWO_WORDS and name.start() == a and line[a - 1 : a] == " " and (before := _NAME.search(line, _run_start(line, a - 1, 0), a - 1)):
            word = f"{before[0]} {word}"
        yield word, pos


def _prose(line: str, low: str):
    """(name, match) of a secret told in words; the word before takes part in the name."""
    pos = 0
    while k := _PROSE_KEY.search(low, pos):
        a = b = k.start()
        m = _PROSE.match(line, a)
        if m is None:
            pos = a + 1
            continue
        if a > pos and line[a - 1] == " ":
            b = a - 1
            while b > pos and (line[b - 1] == "-" or "a" <= low[b - 1] <= "z"):
                b -= 1
        pos = m.end()
        yield line[b : m.end(1)], m


def _line_spans(line: str) -> list[tuple[int, int]]:
    """Spans of secret values in one line (key blocks apart)."""
    out = []
    for a, b in _url_passwords(line) if "://" in line else ():
        v = line[a:b]
        if len(v) >= 4 and "${" not in v and "{{" not in v and not _BEGINS.match(v) and not _WHOLE.match(v) and not _URL_NONE.match(v):
            out.append((a, b))
    for m in _ISSUER.finditer(line):
        if is_issued(m[0]):
            out.append(m.span())
    low = line.lower()
    if len(low) != len(line):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in line)
    ways = [_HEADER] if "bearer" in low or "basic" in low or "author" in low else []
    ways += [_FLAG] if "-" in line or " by " in low or "password " in low else []
    ways += [_LOGIN] if "/" in line or "key is" in low or "--with" in low else []
    for rx in ways:
        for m in rx.finditer(line):
            if m.lastindex and is_value(m[m.lastindex]):
                out.append(m.span(m.lastindex))
    if "(" in line:
        out += [(a, b) for a, b in _call_spans(line) if is_value(line[a:b])]
    if "x-" in low:
        out += [(a, b) for a, b in _custom_spans(line) if is_value(line[a:b])]
    if "-" in line:
        out += [(a, b) for a, b in _db_passwords(line) if is_value(line[a:b])]
    for name, end in _names(line, low, _PAIR_RX) if ":" in line else ():
        if (m := _PAIR.match(line, end)) and _PAIR_NAMES & set(name_words(name)) and is_value(m[1]):
            out.append(m.span(1))
    ends, bare = _Ends(_BARE_END, line), {}
    for name, end in _names(line, low, _NAME_RX):
        if not is_secret_name(name) or not (m := _ASSIGNED.match(line, end)):
            continue
        k = m.lastindex
        if k == 4:
            if "," not in line[end : m.start(4)]:
                bare.setdefault(ends.after(m.start(4) + 1), []).append(m.start(4))
            continue
        span, v = m.span(k), m[k]
        if (more := _MORE.match(line, m.end())) and ("+" in line[m.end() : more.start(more.lastindex)] or "concat!(" in line[end : m.start(k)]):
            j = more.lastindex
            if is_value(v + more[j]):
                out += [span, more.span(j)]
                continue
        if is_value(v) and not ("-----BEGIN" in v):
            out.append(span)
    for end, starts in bare.items():
        out += _bare_spans(line, starts, end)
    for name, m in _prose(line, low):
        v = m[2].rstrip(".,;:!?)") if len(m[2]) > 24 else m[2]
        if is_secret_name(name) and is_value(v, 8) and re.search(r"\d|[^\w.,'-]", v) and not v.endswith("(") and not re.match(r"(?i)[a-z_]++[=:(\[]", v):
            out.append((m.start(2), m.start(2) + len(v)))
    return out


@lru_cache(None)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in KEYWORDS:
        a.add_word(w, w)
    a.make_automaton()
    return a


def find(text: str | None) -> tuple[list[int], list[tuple[int, int]]]:
    """(lines from 1 that hold a secret, spans of all secret values in the text)."""
    if not text:
        return [], []
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = sorted({end for end, _ in _automaton().iter(low)})
    if not hits:
        return [], []
    lines: set[int] = set()
    spans: list[tuple[int, int]] = []
    keys: list[tuple[int, int]] = []
    begins = list(_PEM.finditer(text)) if "-----BEGIN" in text else []
    ends = [m.start() for m in _PEM_END.finditer(text)] if begins else []
    number, counted = 1, 0
    for m, nxt in zip(begins, [*(x.start() for x in begins[1:]), len(text)]):
        e = bisect_left(ends, m.end())
        stop = min(ends[e], nxt) if e < len(ends) else nxt
        body = text[m.end() : stop]
        flat = re.sub(r"\\n|[^A-Za-z0-9+/=]", "", body)
        if len(flat) < 24 or _entropy(flat) < 3.0:
            continue
        number += text.count("\n", counted, m.start())
        counted = m.start()
        lines.add(number)
        keys.append((m.start(), stop))
        spans += [(m.end() + w.start(), m.end() + w.end()) for w in re.finditer(r"(?:(?<=\\n)|(?<!\\))[A-Za-z0-9+/=]{8,}", body)]
    done = -1
    k = 0
    number, counted = 1, 0
    for h in hits:
        if h <= done:
            continue
        a = text.rfind("\n", 0, h) + 1
        b = text.find("\n", h)
        b = len(text) if b < 0 else b
        done = b
        while k < len(keys) and keys[k][1] <= a:
            k += 1
        if k < len(keys) and keys[k][0] < a < keys[k][1]:
            continue
        number += text.count("\n", counted, a)
        counted = a
        got = _line_spans(text[a:b])
        if k < len(keys) and a <= keys[k][0] < b:
            got = [(x, y) for x, y in got if a + y <= keys[k][0] or a + x >= keys[k][1]]
        if got:
            lines.add(number)
            spans += [(a + x, a + y) for x, y in got]
    return sorted(lines), spans


_MASK = {**{c: "0" for c in "0123456789"}, **{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}}


def redact_text(text: str | None) -> str | None:
    """The text with every secret value replaced, same length and alphabet."""
    _, spans = find(text)
    if not spans:
        return text
    out = list(text)
    done = 0
    for a, b in sorted(spans):
        for i in range(max(a, done), b):
            if not (out[i] == "n" and i and out[i - 1] == "\\"):
                out[i] = _MASK.get(out[i], out[i])
        done = max(done, b)
    return "".join(out)


def secret_lines(df: DataFrame, *, id: str = "request_id", text: str = "content") -> DataFrame:
    """One row (id, line_no) for each line that holds a secret."""

    @arrow_udf("array<long>")
    def lines(t: pd.Series) -> pd.Series:
        return t.map(lambda x: find(x)[0])

    rows = df.select(F.col(id).alias(id), lines(F.col(text)).alias("__lines"))
    return rows.select(id, F.explode("__lines").alias("line_no")).distinct()


def redact(df: DataFrame, *, text: str = "content", out: str = "redacted") -> DataFrame:
    """The rows with one more column, the text without its secrets."""

    @arrow_udf("string")
    def clean(t: pd.Series) -> pd.Series:
        return t.map(redact_text)

    return df.withColumn(out, clean(F.col(text)))
